"""Enums, flags, locales, durations, dates, codes and loose JSON as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_light

#: Locale bits.
LOCALES = {"UND": 1, "EN": 2, "ES": 4, "FR": 8, "HAK": 16, "HI": 32, "JA": 64, "KO": 128, "MAP": 256, "NAN": 512, "TH": 1024, "VI": 2048, "YUE": 4096, "ZH": 8192, "ZH_HANS": 16384, "ZH_HANT": 32768}
#: Language names for locale tags.
LANGUAGES = {"english": "EN", "spanish": "ES", "french": "FR", "hindi": "HI", "japanese": "JA", "korean": "KO", "thai": "TH", "vietnamese": "VI", "mandarin": "ZH", "hakka": "HAK", "taiwanese": "NAN", "cantonese": "YUE"}
_REGIONAL = ("en", "es", "fr", "hi", "ja", "ko", "th", "vi")
_EXACT = {"zh": "ZH", "hak": "HAK", "map": "MAP", "nan": "NAN", "yue": "YUE", "zh-Hans": "ZH_HANS", "zh-Hant": "ZH_HANT", "zs": "ZH_HANS", "zt": "ZH_HANT"}
#: Locale codes of edited documents and their bits.
LOCALE_CODES = {"und": 1} | {c: LOCALES[c.upper()] for c in _REGIONAL} | {c: LOCALES[n] for c, n in _EXACT.items() if c not in ("zs", "zt")}
#: The 41 genre bits in order.
GENRES = """CLASSICAL COUNTRY DANCE HIPHOP INSTRUMENTAL POP RNB ROCK BASS_COLOR BASS_FUTURE BASS_KAWAII BASS_MELODIC DOWNTEMPO
DRUMNBASS DUBSTEP_BROSTEP DUBSTEP_CHILLSTEP DUBSTEP_MELODIC DUBSTEP_RIDDIM FUNK GLITCHHOP HARD_ARTCORE HARD_FUTURECORE
HARD_HAPPYCORE HARD_HARDCORE HARD_HARDSTYLE HARD_JCORE HOUSE_AMBIENT HOUSE_COMPLEXTRO HOUSE_ELECTRO HOUSE_FUTURE
HOUSE_PROGRESSIVE HOUSE_SLAP HOUSE_TROPICAL JAZZ LOFI ROCK_ALTERNATIVE ROCK_METAL ROCK_SOFT SYNTHWAVE TRANCE TRAP""".split()
#: Which genres stand below which in the gallery; a prefix groups the dance styles.
GENRE_PARENTS = {"RNB": ["FUNK"], "ROCK": ["ROCK_ALTERNATIVE", "ROCK_METAL", "ROCK_SOFT"], "DANCE": ["BASS", "DOWNTEMPO", "DRUMNBASS", "DUBSTEP", "GLITCHHOP", "HARD", "HOUSE", "LOFI", "SYNTHWAVE", "TRANCE", "TRAP"]}
#: Enums by name.
ALBUM_TYPES = {"SINGLE": 0, "EP": 1, "ALBUM": 2, "COMPILATION": 3}
AUTHORITIES = {"ISRC": 0, "APPLE_MUSIC": 1, "ITUNES": 2, "SPOTIFY": 3, "SOUNDCLOUD": 4, "YOUTUBE": 5, "DISCOGS": 6, "RATEYOURMUSIC": 7}
ROLES = {"MAIN": 0, "FEAT": 1, "REMIX": 2}
STATUSES = {"PENDING": 0, "CONFIRMED": 1, "REJECTED": 2}
METHODS = {"APPLE": 0, "EXACT": 1, "FUZZY": 2, "MANUAL": 3}
#: Text slots of a localised name in the order of preference.
SLOTS = ("zt", "zs", "ja", "ko", "fr", "en")


def genre_nodes() -> list[tuple[str, int]]:
    """(key, mask) of every gallery node: its own bit and those below."""
    bit = {g: 1 << i for i, g in enumerate(GENRES)}

    def mask(name: str) -> int:
        below = GENRE_PARENTS.get(name) or ([g for g in GENRES if g.startswith(f"{name}_")] if name not in bit else [])
        total = bit.get(name, 0)
        for b in below:
            total |= mask(b)
        return total

    names = dict.fromkeys([*GENRES, *GENRE_PARENTS, "BASS", "DUBSTEP", "HARD", "HOUSE"])
    return [(n, mask(n)) for n in names]


def locale_bit(col: Column) -> Column:
    """Names, tags and aliases to a locale bit; - and zxx are no language (0), unknown ones undetermined (1)."""
    out = F.lit(LOCALES["UND"])
    low = F.lower(col)
    for name, key in LANGUAGES.items():
        out = F.when(low == name, LOCALES[key]).otherwise(out)
    for tag, key in _EXACT.items():
        out = F.when(col == tag, LOCALES[key]).otherwise(out)
    for tag in _REGIONAL:
        out = F.when((col == tag) | col.startswith(f"{tag}-"), LOCALES[tag.upper()]).otherwise(out)
    return F.when(col.isin("zxx", "-") | (low == "acoustic"), 0).otherwise(out)


def select_localized(names: Column, preferred: str | None = None, english: bool = False, slots: tuple = SLOTS) -> Column:
    """From a struct of text slots: the preferred, then English if asked, then the sole distinct value, then a fixed order."""
    filled = lambda s: F.nullif(F.trim(names[s]), F.lit(""))
    values = F.array_distinct(F.array_compact(F.array(*[filled(s) for s in slots])))
    chain = [filled(preferred)] if preferred else []
    chain += [filled("en")] if english else []
    chain.append(F.when(F.size(values) == 1, F.element_at(values, 1)))
    return F.coalesce(*chain, *[filled(s) for s in slots])


def display_title(titles: Column, ranks: dict[int, int], fallback_rank: int = 50) -> Column:
    """From an array of (locale, fallback, title): the least by rank of locale, then locale."""
    rank = lambda x: F.coalesce(*[F.when(x["locale"] == k, v) for k, v in ranks.items()], F.when(x["fallback"], fallback_rank), F.lit(99))
    keyed = F.transform(F.filter(titles, lambda x: F.trim(x["title"]) != ""), lambda x: F.struct(rank(x).alias("r"), x["locale"].alias("l"), x["title"].alias("t")))
    return F.coalesce(F.try_element_at(F.array_sort(keyed), F.lit(1))["t"], F.lit(""))


def infer_fallback_locale(audio: Column, title_locales: Column, titles_equal: Column, artist_vote: Column) -> Column:
    """The audio's locale if a title has it; else English if all titles are equal and one is English; else the artists' vote."""
    return F.when(F.array_contains(title_locales, audio), audio).when(titles_equal & F.array_contains(title_locales, LOCALES["EN"]), LOCALES["EN"]).otherwise(artist_vote)


def encode_flags(names: Column, bits: dict[str, int], sep: str = ",") -> Column:
    """A separated list of names to the OR of their bits; unknown names count as none."""
    table = F.create_map(*[F.lit(x) for kv in bits.items() for x in kv])
    parts = F.transform(F.split(F.coalesce(names, F.lit("")), sep), lambda x: F.coalesce(F.try_element_at(table, F.upper(F.trim(x))), F.lit(0)).cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def decode_flags(mask: Column, bits: dict[str, int]) -> Column:
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(b).cast("long")) != 0, F.lit(n)) for n, b in bits.items()]))


def release_type(title: Column) -> Column:
    return F.when(title.rlike(r"(?i)\s*-\s*ep$"), "EP").when(title.rlike(r"(?i)\s*-\s*single$"), "SINGLE").otherwise("ALBUM")


def infer_role(artist: Column, title: Column, credit: Column) -> Column:
    """REMIX if named in a mix bracket, FEAT if in another bracket, after feat, or not in the credit text; else MAIN."""
    name = F.concat(F.lit(r"\Q"), artist, F.lit(r"\E"))
    in_mix = F.rlike(title, F.concat(F.lit(r"(?i)[(\[{][^)\]}]*"), name, F.lit(r"[^)\]}]*mix[^)\]}]*[)\]}]")))
    bracket = F.rlike(title, F.concat(F.lit(r"(?i)[(\[{][^)\]}]*"), name, F.lit(r"[^)\]}]*[)\]}]")))
    feat = F.rlike(title, F.concat(F.lit(r"(?i)\b(?:ft\.?|feat\.?|featuring)\s.*"), name))
    return F.when(in_mix, "REMIX").when(bracket | feat | ~F.contains(F.lower(credit), F.lower(artist)), "FEAT").otherwise("MAIN")


def parse_duration(col: Column) -> Column:
    """m:ss to milliseconds; null if malformed or seconds above 59."""
    ok = col.rlike(r"^\d+:[0-5]\d$")
    return F.when(ok, (F.try_element_at(F.split(col, ":"), F.lit(1)).cast("long") * 60 + F.try_element_at(F.split(col, ":"), F.lit(2)).cast("long")) * 1000)


def format_duration(ms: Column) -> Column:
    s = F.floor((ms + 500) / 1000)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def to_date_tolerant(col: Column) -> Column:
    """ISO instants and days, YYYY-MM and YYYY; else null."""
    return F.coalesce(F.try_to_timestamp(F.substring(col, 1, 10), F.lit("yyyy-MM-dd")).cast("date"), F.try_to_timestamp(col, F.lit("yyyy-MM")).cast("date"), F.when(col.rlike(r"^\d{4}$"), F.try_to_timestamp(col, F.lit("yyyy")).cast("date")))


def json_first(col: Column, paths: list[str]) -> Column:
    return F.coalesce(*[F.get_json_object(col, p) for p in paths])


def json_values_contain(col: Column, term: str) -> Column:
    return F.coalesce(F.exists(F.map_values(F.from_json(col, "map<string,string>")), lambda v: F.contains(F.lower(v), F.lit(term.lower()))), F.lit(False))


def title_rows(variant: Column) -> Column:
    """Loose titles (a string, a map by locale, or an array of either) to an array of (locale, title)."""
    as_map = F.from_json(variant, "map<string,string>")
    as_list = F.from_json(variant, "array<struct<locale:string,title:string>>")
    text = F.when(~variant.rlike(r"^\s*[\[{]"), F.array(F.struct(F.lit("und").alias("locale"), F.trim(F.regexp_replace(variant, '^"|"$', "")).alias("title"))))
    entries = F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("locale"), e["value"].alias("title")))
    return F.array_distinct(F.coalesce(text, F.when(variant.rlike(r"^\s*\{"), entries), as_list))


def join_distinct(*cols: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*cols)))), ", ")


def parse_code(col: Column) -> Column:
    """m or r and a number; a bare number is of kind m."""
    m = F.regexp_extract(F.lower(F.trim(col)), r"^([mr]?)(\d+)$", 2)
    kind = F.regexp_extract(F.lower(F.trim(col)), r"^([mr]?)(\d+)$", 1)
    return F.when(m != "", F.struct(F.when(kind == "", "m").otherwise(kind).alias("kind"), m.cast("long").alias("number")))


#: Rank of a code kind in natural order.
CODE_RANK = {"m": 0, "r": 1}


def code_sort_key(col: Column) -> Column:
    c = parse_code(col)
    return F.struct(F.coalesce(*[F.when(c["kind"] == k, r) for k, r in CODE_RANK.items()], F.lit(2)).alias("rank"), c["number"].alias("number"), col.alias("text"))


#: Authority, what the page is of, the page without its host's scheme, with the code as group 1, and what goes
#: before the code. Patterns ignore case.
URL_PATTERNS = [
    ("APPLE_MUSIC", "album", r"music\.apple\.com/[^/]+/album/(?:[^/?#]+/)?(\d+)(?:[/?#].*)?", ""),
    ("APPLE_MUSIC", "artist", r"music\.apple\.com/[^/]+/artist/(?:[^/?#]+/)?(\d+)(?:[/?#].*)?", ""),
    ("APPLE_MUSIC", "song", r"music\.apple\.com/[^/]+/song/(?:[^/?#]+/)?(\d+)(?:[/?#].*)?", ""),
    ("SPOTIFY", "album", r"open\.spotify\.com/album/([A-Za-z0-9]+)(?:[/?#].*)?", ""),
    ("SPOTIFY", "artist", r"open\.spotify\.com/artist/([A-Za-z0-9]+)(?:[/?#].*)?", ""),
    ("SPOTIFY", "song", r"open\.spotify\.com/track/([A-Za-z0-9]+)(?:[/?#].*)?", ""),
    ("SOUNDCLOUD", "album", r"soundcloud\.com/([^?#]*[^/?#])/?(?:[?#].*)?", ""),
    ("SOUNDCLOUD", "artist", r"soundcloud\.com/([^?#]*[^/?#])/?(?:[?#].*)?", ""),
    ("SOUNDCLOUD", "song", r"soundcloud\.com/([^?#]*[^/?#])/?(?:[?#].*)?", ""),
    ("YOUTUBE_MUSIC", "album", r"music\.youtube\.com/playlist\?(?:[^#]*&)?list=([A-Za-z0-9_-]+)(?:[&#].*)?", ""),
    ("YOUTUBE_MUSIC", "artist", r"music\.youtube\.com/(@[A-Za-z0-9_-]+)(?:[/?#].*)?", ""),
    ("YOUTUBE_MUSIC", "artist", r"music\.youtube\.com/channel/([A-Za-z0-9_-]+)(?:[/?#].*)?", ""),
    ("YOUTUBE_MUSIC", "song", r"music\.youtube\.com/watch\?(?:[^#]*&)?v=([A-Za-z0-9_-]+)(?:[&#].*)?", ""),
    ("DISCOGS", "album", r"www\.discogs\.com/master/(\d+)(?:-[^/?#]+)?(?:[/?#].*)?", "m"),
    ("DISCOGS", "album", r"www\.discogs\.com/release/(\d+)(?:-[^/?#]+)?(?:[/?#].*)?", "r"),
    ("DISCOGS", "artist", r"www\.discogs\.com/artist/(\d+)(?:-[^/?#]+)?(?:[/?#].*)?", ""),
    ("RATE_YOUR_MUSIC", "album", r"rateyourmusic\.com/release/album/([^?#]*[^/?#])/?(?:[?#].*)?", "a/"),
    ("RATE_YOUR_MUSIC", "album", r"rateyourmusic\.com/release/comp/([^?#]*[^/?#])/?(?:[?#].*)?", "c/"),
    ("RATE_YOUR_MUSIC", "album", r"rateyourmusic\.com/release/ep/([^?#]*[^/?#])/?(?:[?#].*)?", "e/"),
    ("RATE_YOUR_MUSIC", "album", r"rateyourmusic\.com/release/single/([^?#]*[^/?#])/?(?:[?#].*)?", "s/"),
    ("RATE_YOUR_MUSIC", "album", r"rateyourmusic\.com/work/([^?#]*[^/?#])/?(?:[?#].*)?", "w/"),
    ("RATE_YOUR_MUSIC", "artist", r"rateyourmusic\.com/artist/([^/?#]+)(?:[/?#].*)?", ""),
    ("RATE_YOUR_MUSIC", "song", r"rateyourmusic\.com/song/([^?#]*[^/?#])/?(?:[?#].*)?", ""),
    ("RATE_YOUR_MUSIC", "song", r"rateyourmusic\.com/work/([^?#]*[^/?#])/?(?:[?#].*)?", "w/"),
]
#: The page of a code.
URLS = {
    ("APPLE_MUSIC", "song"): "https://music.apple.com/us/song/{}",
    ("SPOTIFY", "song"): "https://open.spotify.com/track/{}",
    ("YOUTUBE_MUSIC", "song"): "https://music.youtube.com/watch?v={}",
    ("SOUNDCLOUD", "song"): "https://soundcloud.com/{}",
    ("DISCOGS", "artist"): "https://www.discogs.com/artist/{}",
}


def code_from_url(col: Column, context: str = "song") -> Column:
    """(authority, code) of the first pattern of the context that fits, percent-decoded; else null."""
    found = [(a, rf"(?i)^https://{p}$", before) for a, c, p, before in URL_PATTERNS if c == context]
    return F.coalesce(*[F.when(F.regexp_extract(col, p, 1) != "", F.struct(F.lit(a).alias("authority"), F.concat(F.lit(before), F.try_url_decode(F.regexp_extract(col, p, 1))).alias("code"))) for a, p, before in found])


def url_from_code(authority: Column, code: Column, context: str = "song") -> Column:
    return F.coalesce(*[F.when(authority == a, F.concat(F.lit(u.split("{}")[0]), code)) for (a, c), u in URLS.items() if c == context])


def pos_int(col: Column, default: int) -> Column:
    n = col.try_cast("long")
    return F.when(n > 0, n).otherwise(F.lit(default))


def compare_flags(title: Column, other_title: Column, ms: Column, other_ms: Column, gap: int = 2000) -> Column:
    """Warnings of a candidate pair."""
    return F.array_compact(F.array(F.when(F.trim(normalize_light(title, True)) != F.trim(normalize_light(other_title, True)), F.lit("title")), F.when(F.abs(ms - other_ms) > gap, F.lit("duration"))))


def artwork_base(col: Column) -> Column:
    """The URL without its last path segment."""
    return F.regexp_replace(col, r"/[^/]*$", "")


def artwork_url(col: Column, prefix: str) -> Column:
    return F.when(col.rlike("^https?://"), col).when(col.startswith("/"), F.concat(F.lit(prefix), col))
