"""Small tables for the corpus operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark: SparkSession, rows: list[tuple], schema: str = DOCS) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def words(rng: random.Random, n: int, pool: int = 400) -> list[str]:
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def corpus(seed: int = 1, n: int = 120) -> list[tuple]:
    """Texts of all kinds: copies, near copies, shared lines, empty, null, very long, repeated rows."""
    rng = random.Random(seed)
    out: list[tuple] = []
    line = " ".join(words(rng, 25))
    base = words(rng, 80)
    for i in range(n):
        kind = i % 8
        if kind == 0:
            t = " ".join(words(rng, rng.randrange(1, 60)))
        elif kind == 1:
            t = line + "\n" + " ".join(words(rng, 30))
        elif kind in (2, 3):
            near = list(base)
            for _ in range(rng.randrange(0, 5)):
                near[rng.randrange(len(near))] = f"x{rng.randrange(9)}"
            t = " ".join(near)
        elif kind == 4:
            t = " ".join(base).upper() if i % 16 == 4 else " ".join(base)
        elif kind == 5:
            t = " ".join(words(rng, rng.randrange(0, 6), 3))
        elif kind == 6:
            t = ["", "  \n ", "a b c d", "a b c d e", "A  b\tc d"][rng.randrange(5)]
        else:
            t = " ".join(words(rng, 400, 60))
        out.append((i, t, ["en", "fr", None][i % 3], ["a", "b", "c", None][rng.randrange(4)], len(t)))
    out += [(n, None, None, None, None), (n + 1, "é ü 日本 w1. " * 3000, "de", "a", 1), out[10], out[12]]
    return out
