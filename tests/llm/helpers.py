"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string"
#: Null, empty, blank, one word, few words, odd bytes, a very long text, and one very long word.
ODD = [None, "", "   \n\t ", "word", "one two three", "Übergrößenträger naïve 東京     x", "lorem ipsum dolor " * 4000, "a" * 70_000, "\x00\x07 bell", "İstanbul ﬁne ß"]


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def documents(seed: int = 1, n: int = 60) -> list[tuple[int, str | None]]:
    """Texts with exact and near copies, and the odd ones."""
    rng, out = random.Random(seed), []
    for i in range(n):
        text = words(rng, rng.randrange(3, 160))
        out.append(text)
        if i % 4 == 0:
            out.append(list(text))
        if i % 3 == 0:
            near = list(text)
            for _ in range(1 + len(near) // 90):
                near[rng.randrange(len(near))] = "changed"
            out.append(near)
    rng.shuffle(out)
    texts: list[str | None] = [" ".join(t) for t in out] + ODD
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def table(spark, rows, schema: str = DOCS):
    return spark.createDataFrame(rows, schema)


def write_tables(spark, folder: str, **tables) -> str:
    """Writes DataFrames as the tables of a folder and returns it."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return folder
