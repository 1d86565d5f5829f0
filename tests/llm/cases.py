"""Awkward documents that every operator has to take."""

from __future__ import annotations

ROWS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "word"), (4, "two words"), (5, "Grüße, ÉCOLE! 12,3 <|endoftext|> it's 日本語 🙂"),
    (6, "a b c d e f g h i j k l"), (7, "a b c d e f g h i j k l"), (7, "a b c d e f g h i j k l"), (None, "no key here at all"), (8, "x" * 5000),
    (9, "lorem ipsum dolor " * 20000), (10, "\x1c odd \x85 space here \x00 nul"), (11, "MIT License and mit license, CC BY"),
]


def documents(spark, rows=None):
    """doc_id, text and columns whose names the operators use themselves."""
    rows = ROWS if rows is None else rows
    schema = "doc_id long, text string, k string, t string, n_bytes string, token string, rid string, score double, size long, row string, label string, mean string, y int"
    return spark.createDataFrame([(a, b, "k", "t", "n", "tok", "rid", 0.5, 9, "r", "l", "m", 1) for a, b in rows], schema)


def ids(rows):
    return sorted((r[0] for r in rows), key=lambda v: (v is None, v))
