"""Small frames that every operator must cope with, and plain reference versions."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that an operator might use for its own columns.
CLASHING = ("score", "kept", "row", "key", "id", "body", "fp", "root", "row_key", "number", "removed", "at", "words", "ids")


def frame(spark, rows, clashing=False):
    """documents from (doc_id, text) pairs."""
    data = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(data, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(c).alias(c) for c in CLASHING))
    return df


def awkward(seed=3):
    """Nulls in both columns, empty and blank texts, a very long one, repeated rows, ties."""
    pick = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]

    def prose(n):
        return " ".join(pick.choice(words) for _ in range(n))

    a, b = prose(80), prose(120)
    long_text = "\n".join(prose(40) for _ in range(400))
    return [
        (1, a),
        (2, a),
        (2, a),
        (3, a.upper()),
        (4, b),
        (5, b + " " + a),
        (6, None),
        (7, ""),
        (8, " \n\t "),
        (9, long_text),
        (10, long_text),
        (None, a),
        (None, None),
        (None, prose(60)),
        (11, "one"),
        (12, "one two"),
        (12, prose(50)),
        (13, "▁ mark \u0000 and 😀 日本語"),
    ]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


class Union:
    """Sets with the smallest member as their name."""

    def __init__(self, n):
        self.up = list(range(n))

    def __getitem__(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        a, b = self[i], self[j]
        self.up[max(a, b)] = min(a, b)
