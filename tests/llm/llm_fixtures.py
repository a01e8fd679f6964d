"""Rows that every operator must stand: nulls, empty and long texts, repeats, columns whose names clash."""

SCHEMA = "doc_id bigint, text string, lang string, n_words string, h string"
ODD = [None, "", " \t\n ", "a", "É é   ſ K", "x" * 5000, "tok " * 3000, "same text here", "same text here", "l1\nl1\nl2\n\nl1"]


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "x", "y") for i, t in enumerate(texts)], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    """Words parted by the ASCII white space of the contracts."""
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def vector_rows():
    """(vec_id, vector): 64 components and others, nulls, non-finite ones, copies, ties and null ids."""
    import random

    rng = random.Random(8)
    spread = [[rng.gauss(0, 0.4) for _ in range(64)] for _ in range(150)]
    near = [[x + rng.gauss(0, 0.01) for x in spread[k % 5]] for k in range(120)]
    odd = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.5] * 63, [float("nan")] + [0.0] * 63, [float("inf")] * 64, [-0.001] * 64, [0.0] * 64, [-0.0] * 64]
    rows = list(enumerate(spread + near + odd)) + [(5000 + i, spread[7]) for i in range(90)]
    return rows + [(None, spread[1]), (None, spread[2]), (3, spread[3]), (3, spread[4]), (9, [1e30] * 64)]


def good_vector(v):
    import math

    return v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
