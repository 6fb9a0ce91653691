import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A DataFrame of documents from (doc_id, text) rows."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Small texts with copies, near copies, shared lines and passages, odd texts and ties."""
    rng = random.Random(11)
    words = ["".join(rng.choice(["an", "er", "th", "ou", "é", "ö", "la"]) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = line(70)
    block = "\n".join(line(6) for _ in range(4))
    rows = []
    for i in range(60):
        parts = [line(rng.randrange(3, 14)) for _ in range(rng.randrange(1, 9))]
        if i % 5 == 0:
            parts.insert(rng.randrange(len(parts) + 1), shared)
        if i % 7 == 0:
            parts.insert(rng.randrange(len(parts) + 1), block)
        rows.append((i, "\n".join(parts)))
    for i in range(60, 75):
        rows.append((i, rows[rng.randrange(60)][1]))
    for i in range(75, 95):
        w = rows[rng.randrange(60)][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    odd = [None, "", " \n\t ", "a", "A b C", "x" * 700, "ab" * 400, ("la la la " * 200), "日本語 " * 60, "\n\n\n", "\0 \0", "end\n" * 30, "</s>[INST] \\b", "▁ ▁"]
    rows += [(100 + i, t) for i, t in enumerate(odd)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def clashing():
    """Add columns with names that an operator might use itself."""
    from pyspark.sql import functions as F

    def add(df):
        return df.withColumns({c: F.lit(c) for c in ("count", "score", "row", "marks", "n", "u", "v", "k", "low", "first", "ids", "least", "whole", "__x")})

    return add
