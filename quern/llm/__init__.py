"""Operators of a large text corpus: formatting, encoding, dedup, scoring and mixing."""
