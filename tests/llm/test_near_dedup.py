"""Near duplicates against all pairs, components against a plain forest, and the odd rows."""

from __future__ import annotations

import re

import numpy as np
import pytest

from tidegauge.llm import queries
from tidegauge.llm.components import components
from tidegauge.llm.near_dedup import HASHES, banding, keep_one, least_matches, near_duplicates

from ..oracle_tools import compare
from .helpers import DOCS, documents, table


def shingles(text: str | None) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def forest(links) -> dict[int, int]:
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def brute(rows) -> dict[int, tuple[int, int]]:
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[:n] if a and b and 100 * len(a & b) >= 85 * len(a | b)]
    root = forest(links)
    return {i: (len(s), root.get(i, i)) for i, s in sets}


def found(df) -> dict[int, tuple[int, int, bool]]:
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_pairs(spark, seed):
    rows = documents(seed)
    want = brute(rows)
    assert found(near_duplicates(table(spark, rows))) == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert any(c != i for i, (_, c) in want.items())


def test_keys_that_are_shuffled(spark, monkeypatch):
    """Beyond the bound of a broadcast the keys meet the texts by a shuffle, with the same result."""
    rows = documents(4, 40)
    want = found(near_duplicates(table(spark, rows)))
    kept = sorted(map(str, keep_one(table(spark, rows)).collect()))
    monkeypatch.setattr("tidegauge.llm.near_dedup.BROADCAST_ROWS", 0)
    assert found(near_duplicates(table(spark, rows))) == want
    assert sorted(map(str, keep_one(table(spark, rows)).collect())) == kept


def test_tiles_of_many_outsiders(spark, monkeypatch):
    """A family whose leader is no copy of most, in blocks of a few rows: every link between outsiders is found."""
    monkeypatch.setattr("tidegauge.llm.near_dedup.TILE", 4)
    rng = np.random.default_rng(11)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(40):
        text = list(base)
        for at in rng.choice(120, 3 + k % 4, replace=False):
            text[at] = f"v{k // 2}"
        rows.append((k, " ".join(text)))
    want = brute(rows)
    assert {i: c for i, (_, c, _) in found(near_duplicates(table(spark, rows))).items()} == {i: c for i, (_, c) in want.items()}


def test_chain_of_copies(spark):
    """Each text differs from the one before in a few words: one component by way of neighbours."""
    text, rows = [f"w{i}" for i in range(300)], []
    for k in range(30):
        text = list(text)
        text[(k * 10) % 300] = f"new{k}"
        rows.append((100 - k, " ".join(text)))
    want = brute(rows)
    assert len({c for _, c in want.values()}) == 1
    assert {i: c for i, (_, c, _) in found(near_duplicates(table(spark, rows))).items()} == {i: c for i, (_, c) in want.items()}


def test_copies_of_one_original_that_are_no_copies_of_each_other(spark):
    rng = np.random.default_rng(8)
    original = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(original))]
    for k in range(1, 40):
        text = list(original)
        for at in rng.choice(200, 2, replace=False):
            text[at] = f"x{k}"
        rows.append((k, " ".join(text)))
    want = brute(rows)
    assert {i: c for i, (_, c, _) in found(near_duplicates(table(spark, rows))).items()} == {i: c for i, (_, c) in want.items()}


def test_ties_nulls_repeats_and_other_columns(spark):
    text = "the same five words and more"
    rows = [(5, text, "a"), (5, text, "b"), (7, text, None), (None, text, "c"), (None, None, None), (8, None, "d"), (9, "", "e"), (9, "", "f")]
    df = table(spark, rows, DOCS + ", kept string")
    got = sorted(map(tuple, near_duplicates(df.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == sorted([(5, 2, 5, True)] * 2 + [(7, 2, 5, False), (None, 2, None, True), (None, 0, None, True), (8, 0, 8, True)] + [(9, 0, 9, True)] * 2, key=str)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == [(5, text), (8, None), (9, "")]
    assert kept.filter("doc_id is null").count() == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_duplicates(empty).count() == keep_one(empty).count() == 0


def test_components_in_one_task_and_in_many(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    df = table(spark, links, "a long, b long")
    want = forest([(a, b) for a, b in links if a != b])
    for per_task in (1 << 20, 40):
        assert {r.node: r.component for r in components(df, per_task=per_task).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_a_pair_at_the_threshold_is_hardly_ever_given_up():
    rng, miss = np.random.default_rng(1), 1e-3
    bounds = least_matches(85, miss)
    alive = np.ones(20_000, bool)
    hits = (rng.random((20_000, 128)) < 0.85).cumsum(1)
    for n, least in bounds:
        alive &= hits[:, n - 1] >= least
    assert 1 - alive.mean() < 0.02
    assert [n for n, _ in bounds] == [32, 64, 96, 128]


def test_bands_hold_at_every_threshold():
    assert banding(85) == (25, 5)
    for percent in range(50, 100):
        bands, rows = banding(percent)
        assert bands * rows <= HASHES and (1 - (percent / 100) ** rows) ** bands <= 1e-6


def test_query_is_its_sql(spark, small):
    assert compare(spark, queries.op4_near_dedup, queries.ORACLE_SQL["op4_near_dedup"], small) == []
