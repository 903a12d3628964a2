"""Token counts and packing.

Text is cut where no merge can reach: a token never holds a space after another character, so what lies
between such places encodes alone. Counts and ids of those pieces are kept in a bounded table per worker.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries of a worker's table of pieces; it is emptied when full.
TABLE_SIZE = 400_000
#: Longer pieces are not kept.
KEPT_LENGTH = 64
COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

_models: dict = {}


def piece_model(path: str):
    """The sentencepiece model at path with its proven table {piece: 1}, loaded once a worker.

    Proof, per vocabulary string that begins with a space mark: the model itself encodes the string alone as
    one token. It also checks that no vocabulary string has a space mark after another character, on which
    the cutting rests.
    """
    if path not in _models:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        cuttable = not any("▁" in p.lstrip("▁") for p in names)
        plain = [p[1:] for p in names if p.startswith("▁") and "▁" not in p[1:] and p[1:]]
        whole = {p: 1 for p, ids in zip(plain, model.encode(plain, num_threads=1)) if len(ids) == 1}
        marked = np.asarray([model.id_to_piece(i).startswith("▁") for i in range(model.get_piece_size())])
        _models[path] = (model, cuttable, whole, marked)
    return _models[path]


def _fill(table: dict, words: list[list], encode) -> list:
    """Put what the table lacks of these pieces into it; returns those that must go again, once used."""
    missing = set().union(*words).difference(table)
    if not missing:
        return []
    room, todo = TABLE_SIZE - len(table), list(missing)
    table.update(zip(todo, encode(todo)))
    short = [w for w in todo if len(w) <= KEPT_LENGTH]
    return todo if room <= 0 else [*short[room:], *(w for w in todo if len(w) > KEPT_LENGTH)]


def count_pieces(texts: list[str], path: str) -> list[int]:
    """Tokens of every text, equal to the library's count of the whole text.

    An empty text has no token. Runs of spaces stay joined to the word that follows them; texts with the space
    mark itself go to the library whole.
    """
    model, cuttable, table, marked = piece_model(path)
    out = [0] * len(texts)
    odd = [i for i, t in enumerate(texts) if t and (not cuttable or "▁" in t or "\0" in t)]
    skip = set(odd)
    # the library puts a mark before the text, so every piece begins with one
    split = [[] if not t or i in skip else t.split(" ") if "  " not in t and t[0] != " " and t[-1] != " " else [w[1:] for w in re.findall(r" +[^ ]+| +", " " + t)] for i, t in enumerate(texts)]

    def encode(words: list[str]) -> list[int]:
        plain = [w for w in words if w and " " not in w]
        ids = np.asarray(model.encode(" ".join(plain), num_threads=1) if plain else [], np.int64)
        n = dict(zip(plain, np.diff(np.flatnonzero(marked[ids]), append=len(ids)).tolist()))
        # alone, a space or a run of them: the library has no token for an empty text, so it is counted after a word
        return [n[w] if w in n else len(model.encode("a " + w)) - len(model.encode("a")) for w in words]

    again = _fill(table, split, encode)
    get = table.__getitem__
    for i, words in enumerate(split):
        out[i] = sum(map(get, words))
    for w in again:
        del table[w]
    for i in odd:
        out[i] = len(model.encode(texts[i]))
    return out


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text by the whole-token shortcut.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated results; extra columns are not
    read; an empty table gives an empty result.
    """
    from .common import chunks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [x for i, j in chunks(texts) for x in count_pieces(texts[i:j], model_path)]
            yield pa.record_batch([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, COUNT_SCHEMA)


# packing


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_tokenizers: dict = {}
_GAP = re.compile(r"\s ")
_RUN = re.compile(r"\s*\S+|\s+")


def tokenizer(path: str):
    """Loaded once a worker: the library's tokenizer at path, a merger of plain pieces, the byte length of its ids, a table of pieces.

    The merger is tiktoken over the same vocabulary, ranks being ids; it is taken only if the file's merges are
    in the order of their ids and every merge makes the token of its rank.
    """
    if path not in _tokenizers:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t.content for t in model.get_added_tokens_decoder().values()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
        plain = all(spec["vocab"][x + y] == 256 + i for i, (x, y) in enumerate(merges))
        merger = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain else None
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        sizes[list(ranks.values())] = [len(b) for b in ranks]
        _tokenizers[path] = (model, merger, sizes, special, {})
    return _tokenizers[path]


def encode_bytes(texts: list[str], path: str) -> list[bytes]:
    """The ids of every text as little-endian unsigned 32-bit, equal to the library's for the whole text.

    Its split pattern ends a token before a space that follows another character, so those pieces are encoded
    alone, each distinct one once.
    """
    model, merger, sizes, special, table = tokenizer(path)
    split = []
    for t in texts:
        if not t:
            split.append([])
        elif _GAP.search(t):
            split.append(_RUN.findall(t))
        else:
            first, *rest = t.split(" ")
            split.append([first, *[" " + w for w in rest]] if first else [" " + w for w in rest])

    def encode(words: list[str]) -> list[bytes]:
        odd = [w for w in words if not merger or w[0] != " " or w[-1].isspace() or any(x in w for x in special)]
        skip = set(odd)
        plain = [w for w in words if w not in skip] if odd else words
        found = dict(zip(odd, (np.asarray(e.ids, "<u4").tobytes() for e in model.encode_batch_fast(odd, add_special_tokens=False))))
        if plain:  # each begins with a space after another character, so the merger sees each alone
            ids = np.asarray(merger.encode_to_numpy("".join(plain)), "<u4")
            ends = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum([len(w.encode()) for w in plain])) + 1
            raw, at = ids.tobytes(), 0
            for w, end in zip(plain, (4 * ends).tolist()):
                found[w] = raw[at:end]
                at = end
        return [found[w] for w in words]

    again = _fill(table, split, encode)
    get = table.__getitem__
    out = [b"".join(map(get, words)) for words in split]
    for w in again:
        del table[w]
    return out


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of at most capacity tokens; of a longer document the first piece may be shorter."""
    from .common import chunks

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            texts, ids = [t or "" for t in b.column(1).to_pylist()], b.column(0).to_pylist()
            rows = []
            for i, j in chunks(texts, 2_000_000):
                for doc, raw in zip(ids[i:j], encode_bytes(texts[i:j], tokenizer_path)):
                    raw += end
                    n = len(raw) // 4
                    at = 0
                    for k in range(-(-n // capacity)):
                        size = (n - 1) % capacity + 1 if k == 0 else capacity
                        rows.append((doc, k, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
                        at += size
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECE_SCHEMA)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts of lengths, longest first: rows (length, first rank, ranks, first sequence, offset, copies).

    Ranks first .. first+ranks-1 of that length fill `copies` neighbouring places in each of ranks/copies
    sequences. Bins that look alike are one class, and a length splits at most two classes, so the plan has at
    most a few rows for each length whatever the number of documents.
    """
    classes: dict[int, list[tuple[int, int]]] = {capacity: []}  # room left: (first sequence, sequences)
    rows, made = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def fill(seq: int, n: int, room: int, each: int) -> None:
            nonlocal left, rank
            rows.append((length, rank, n * each, seq, capacity - room, each))
            rank += n * each
            left -= n * each
            if room > each * length:
                classes.setdefault(room - each * length, []).append((seq, n))

        for room in sorted(r for r in classes if r >= length):
            each = room // length
            while left and classes[room]:
                seq, n = classes[room].pop()
                full = min(n, left // each)
                if full:
                    fill(seq, full, room, each)
                    if full < n:
                        classes[room].append((seq + full, n - full))
                elif left:
                    part = left
                    if n > 1:
                        classes[room].append((seq + 1, n - 1))
                    fill(seq, 1, room, part)
        each = capacity // length
        if left >= each:
            n = left // each
            fill(made, n, capacity, each)
            made += n
        if left:
            fill(made, 1, capacity, left)
            made += 1
    return rows


def _rank(pieces: DataFrame, buckets: int) -> DataFrame:
    """A rank within each length, dealt over buckets so that no length is one task."""
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    return salted.withColumn("own", own).join(before.select("length", "bucket", "before"), ["length", "bucket"]).withColumn("rank", F.col("own") + F.coalesce("before", F.lit(0)))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Best-fit packing planned on the histogram of lengths; pieces take planned slots by rank within length.

    A null or empty text is its end token alone. Repeated rows are packed each. Only the histogram, at most
    `capacity` rows, and the plan, a few rows for each length, reach the driver and are broadcast.
    """
    from .common import stored

    spark = docs.sparkSession
    pieces = stored(cut(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(best_fit_plan(counts, capacity), "length long, first long, ranks long, sequence long, at long, copies long")
    ranked = _rank(pieces, max(1, sum(counts.values()) // 20_000))
    within: Column = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks"))
    i = F.col("rank") - F.col("first")
    placed = ranked.join(F.broadcast(plan), "length").where(within)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(i / F.col("copies"))).cast("long").alias("sequence_id"), (F.col("at") + (i % F.col("copies")) * F.col("length")).cast("long").alias("offset"))
