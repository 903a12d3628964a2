"""Matching, curation and views composed of operators."""
