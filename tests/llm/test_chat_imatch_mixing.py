"""Chat repair against exhaustive search, fingerprints and mixtures against NumPy and plain Python."""

from __future__ import annotations

import functools
import hashlib
import itertools
import operator
import random
import re
import warnings
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidegauge.llm import chat, imatch, mixing, queries

from .helpers import DOCS, ODD, documents, table

CHAT = "conv_id long, turn long, role string, text string"


def legal(roles: tuple[str, ...]) -> bool:
    rest = roles[1:] if roles[:1] == ("system",) else roles
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(rest)) and len(rest) % 2 == 0


def exhaustive(roles: list[str | None]) -> float:
    """Least cost over all labels, merges and insertions of up to two turns between."""
    states = {0: 0.0}  # automaton state -> cost, by brute enumeration of paths of added turns
    for role in roles:
        after: dict[int, float] = {}
        for state, cost in states.items():
            for target in (1, 2, 3):
                label = 0.0 if (role or "").strip().lower() == chat.ROLES[target - 1] else chat.RELABEL if (role or "").strip().lower() in chat.ROLES else chat.UNKNOWN
                ways = [chat.MERGE] if state == target else []
                for n in range(3):
                    for path in itertools.product((1, 2, 3), repeat=n):
                        walk = (state, *path, target)
                        if all(b in chat.NEXT[a] for a, b in itertools.pairwise(walk)):
                            ways.append(n * chat.INSERT)
                for way in ways:
                    after[target] = min(after.get(target, 1e9), cost + label + way)
        states = after
    ends = []
    for state, cost in states.items():
        for n in range(3):
            for path in itertools.product((1, 2, 3), repeat=n):
                walk = (state, *path)
                if all(b in chat.NEXT[a] for a, b in itertools.pairwise(walk)) and walk[-1] in (0, 3):
                    ends.append(cost + n * chat.INSERT)
    return min(ends)


@pytest.mark.parametrize("seed", range(40))
def test_cheapest_repair(seed):
    rng = random.Random(seed)
    roles = [rng.choice(["system", "user", "assistant", "User ", "tool", None]) for _ in range(rng.randrange(0, 9))]
    cost, turns = chat.repair([(r, f"t{i}") for i, r in enumerate(roles)])
    assert cost == pytest.approx(exhaustive(roles))
    assert legal(tuple(t["role"] for t in turns))
    assert sum(t["messages"] for t in turns) == len(roles)
    said = [x for t in turns if t["text"] for x in t["text"].split("\n\n")]
    assert said == [f"t{i}" for i in range(len(roles))]


def test_blocks_join_up(spark):
    rng = random.Random(5)
    rows = []
    for conv in (1, 2, None):
        for turn in range(60):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), f"{conv}:{turn}"))
    rows += [(3, 1, "user", "alone"), (4, 7, None, None)]
    df = spark.createDataFrame(rows, CHAT)

    def whole(block):
        out = chat.format_chats(df, block).orderBy("conv_id", "block", "position").collect()
        by: dict = {}
        for r in out:
            by.setdefault(r.conv_id, [[], 0.0, {}])
            by[r.conv_id][0].append(r.rendered)
            by[r.conv_id][2][r.block] = r.block_cost
        return {k: ("".join(v[0]), round(sum(v[2].values()), 6)) for k, v in by.items()}

    one, many = whole(10_000), whole(7)
    assert one.keys() == many.keys() == {1, 2, 3, 4, None}
    for k in one:
        assert one[k][1] == many[k][1], k  # the same cost; ways of equal cost may differ
        want = exhaustive([r for c, _, r, _ in rows if c == k])
        assert one[k][1] == pytest.approx(want)
        assert many[k][0].count("<|end|>") == many[k][0].count("<|user|>") + many[k][0].count("<|assistant|>") + many[k][0].count("<|system|>")


def test_messages_without_conversation_and_turn_are_dealt_out(spark):
    """One key with most rows: no block has more messages than asked for, whatever their turns are."""
    rng = random.Random(6)
    rows = [(None, None, rng.choice(["user", "assistant", "system", None]), f"m{i % 300}") for i in range(1500)]
    rows += [(7, 3, "user", "x")] * 400 + [(8, t, "user", "y" * 50_000) for t in range(3)]
    got = chat.format_chats(spark.createDataFrame([(*r, 1) for r in rows], CHAT + ", block int"), 64).collect()
    sizes: Counter = Counter()
    for r in got:
        sizes[r.conv_id, r.block] += r.messages
    assert max(sizes.values()) == 64 and sum(sizes.values()) == len(rows)
    for conv in (None, 7, 8):
        own = sorted((r.block, r.position, r) for r in got if r.conv_id == conv)
        assert legal(tuple(r.role for _, _, r in own if not r.rendered.startswith("\n\n")))
        cost = sum({r.block: r.block_cost for _, _, r in own}.values())
        order = sorted((role or "", t) for c, t, role, _ in rows if c == conv)
        assert cost == pytest.approx(exhaustive([role or None for role, _ in order]))


def test_rendering_ties_and_empty_tables(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "assistant", "a"), (1, 2, "user", "c"), (1, 3, "assistant", "d")]
    got = chat.format_chats(spark.createDataFrame(rows, CHAT + "")).orderBy("block", "position").collect()
    # of the two messages of turn 1 the assistant's comes first; to relabel it is cheaper than to insert
    assert "".join(r.rendered for r in got) == "<|system|>\na<|end|>\n<|user|>\nb\n\nc<|end|>\n<|assistant|>\nd<|end|>\n"
    assert chat.format_chats(spark.createDataFrame([], CHAT)).count() == 0
    assert chat.format_chats(spark.createDataFrame([(1, 1, "user", "x" * 200_000, 5)], CHAT + ", block int")).count() == 2


def test_chat_query(spark, small):
    rows = queries.op3_chat(spark, small).orderBy("conv_id", "block", "position").collect()
    said = Counter(r.conv_id for r in spark.read.parquet(f"{small}/conversations.parquet").collect())
    by: dict = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(r)
    assert {c: sum(r.messages for r in own) for c, own in by.items()} == dict(said)
    assert all(legal(tuple(r.role for r in own)) for own in by.values())


# ---------------------------------------------------------------- fingerprints


def edited(rows: list[tuple[int, str]]) -> list[str]:
    out = []
    for k, (_, t) in enumerate(rows):
        n = len(t) // 4
        out.append(t[: len(t) - n] + rows[(k + 1) % len(rows)][1][:n])
    return out


def test_fingerprints(spark):
    rows = sorted((i, t or "") for i, t in documents(7, 50) if t is None or "\x00" not in t)
    got = {r.doc_id: r for r in imatch.fingerprints(table(spark, rows), rarest=1000, commonest=2).collect()}
    assert got.keys() == {i for i, _ in rows}
    by_text: dict = {}
    for (i, t), e in zip(rows, edited(rows), strict=True):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    for k, (i, t) in enumerate(rows):
        if t == rows[(k + 1) % len(rows)][1]:
            assert got[i].near_next == 1
    assert np.mean([got[i].near_edited for i, t in rows if len(t) > 100]) > np.mean([got[i].near_next for i, t in rows if len(t) > 100]) + 0.2


def xx(value: int, size: int, seed: int = 42) -> int:
    """Spark's xxhash64 of a long or an int, as a signed number."""
    n = xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), seed % (1 << 64))
    return n - (1 << 64) if n >> 63 else n


def plain_terms(text: str) -> list[str]:
    return list(dict.fromkeys(re.split(r"[ \t\n\x0b\f\r!-/:-@\[-`{-~]+", text.lower())))


def plain_hash(term: str) -> int:
    n = xxhash.xxh64_intdigest(term.encode(), 42)
    return n - (1 << 64) if n >> 63 else n


def plain_print(text: str, band: set[str]) -> list[str]:
    found = plain_terms(text)
    early = found[: len(found) - len(found) // 4]
    own = [t for t in found if t and (t in band or sum(x in band for x in early) < imatch.FEWEST)]
    out = []
    for j in range(imatch.LEVELS * imatch.PER_LEVEL):
        share = (2 << j // imatch.PER_LEVEL) - 1
        drawn = [h for h in map(plain_hash, own) if xx(j % imatch.PER_LEVEL, 4, xx(h, 8)) & share == 0]
        digest = functools.reduce(operator.xor, drawn, 0)
        out.append(f"{digest % (1 << 64):016X}"[8:] if drawn else "")
    if text and not any(out):
        out[: imatch.PER_LEVEL] = [f"{plain_hash(text) % (1 << 64):016X}"[8:]] * imatch.PER_LEVEL
    return out


def plain_likeness(a: list[str], b: list[str]) -> float:
    if a == b:
        return 1.0
    best = 0.0
    for k in range(0, len(a), imatch.PER_LEVEL):
        pairs = [(x, y) for x, y in zip(a[k : k + imatch.PER_LEVEL], b[k : k + imatch.PER_LEVEL], strict=True) if x or y]
        best = max(best, sum(x == y for x, y in pairs) / max(3, len(pairs)))
    return best


@pytest.mark.parametrize("seed,rarest,commonest", [(11, 1000, 2), (12, 20, 4), (13, 2000, 8)])
def test_fingerprints_are_those_of_plain_python(spark, monkeypatch, seed, rarest, commonest):
    """Lexicon, digests and likeness recomputed for each text and edited text, with the lexicon broadcast and shuffled."""
    rows = sorted((i, t or "") for i, t in documents(seed, 50) if t is None or "\x00" not in t)
    counts = Counter(t for _, text in rows for t in plain_terms(text) if t)
    band = {t for t, n in counts.items() if 1 / rarest <= n / len(rows) <= 1 / commonest}
    prints = [plain_print(t, band) for _, t in rows]
    changed = [plain_print(e, band) for e in edited(rows)]
    for most in (imatch.BROADCAST_TERMS, 0):
        monkeypatch.setattr(imatch, "BROADCAST_TERMS", most)
        got = {r.doc_id: r for r in imatch.fingerprints(table(spark, rows), rarest=rarest, commonest=commonest).collect()}
        for k, (i, _) in enumerate(rows):
            r = got[i]
            assert (r.fingerprint.split("."), r.edited_fingerprint.split(".")) == (prints[k], changed[k])
            assert r.near_edited == pytest.approx(plain_likeness(prints[k], changed[k]))
            assert r.near_next == pytest.approx(plain_likeness(prints[k], prints[(k + 1) % len(rows)]))


def test_fingerprint_partitions_do_not_matter(spark):
    rows = [(i, t) for i, t in documents(8, 40)]
    want = sorted(map(str, imatch.fingerprints(table(spark, rows)).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert sorted(map(str, imatch.fingerprints(table(spark, rows).repartition(5)).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_texts_outside_the_band(spark):
    """A large group of copies, whose terms are all too frequent, and texts of punctuation or odd words alone."""
    rng = random.Random(3)
    group = [f"g{i}" for i in range(60)]
    rows = []
    for i in range(120):  # every other text is a near copy of one
        own = [*group] if i % 2 else [f"w{rng.randrange(400)}" for _ in range(60)]
        if i % 2:
            own[rng.randrange(40)] = f"g{rng.randrange(60)}"
        rows.append((i, " ".join(own)))
    rows += [(200, "!!!"), (201, "..."), (202, "solo"), (203, "g1"), (204, ""), (205, "?!")]
    got = {r.doc_id: r for r in imatch.fingerprints(table(spark, rows)).collect()}
    texts, prints = dict(rows), {}
    for i, r in got.items():
        prints.setdefault(r.fingerprint, set()).add(frozenset(texts[i].split()))
    assert all(len(x) == 1 for x in prints.values())  # texts of different terms differ
    assert [i for i, r in got.items() if not r.fingerprint.strip(".")] == [204]
    assert [i for i, r in got.items() if not r.edited_fingerprint.strip(".")] == [204]
    assert np.mean([got[i].near_edited for i in range(1, 119, 2)]) > 0.3
    assert max(got[i].near_next for i in range(118)) < 0.5 and got[200].near_next == got[201].near_next == got[202].near_next == 0


def test_odd_fingerprints(spark):
    assert imatch.fingerprints(spark.createDataFrame([], DOCS)).count() == 0
    one = imatch.fingerprints(table(spark, [(4, "a lonely text of some words")])).collect()
    assert len(one) == 1 and one[0].near_next == 1
    rows = [(1, "same"), (1, "same"), (1, "other"), (None, None), (2, None), (3, ODD[6])]
    got = imatch.fingerprints(table(spark, [(*r, 1) for r in rows], DOCS + ", place int").select("doc_id", "text"))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "1", "1", "2", "3", "None"]


# ---------------------------------------------------------------- mixing


def texts(seed: int = 2, n: int = 200):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = ("k", "w", "o")[i % 3 if i % 2 else 0]
        rows.append((i, " ".join(rng.choice(["a", lang, "e"]) + lang * rng.randrange(1, 4) + "tn" for _ in range(rng.randrange(5, 80))), lang))
    return rows


def solved(p: np.ndarray, t: np.ndarray, target: np.ndarray, present: np.ndarray, iterations: int = 60) -> np.ndarray:
    """Projected gradient steps on all documents at once, each domain scaled by its token mass."""
    h = (p * t[:, None]).T @ p
    scale = np.maximum(np.diag(h), 1e-12 * t.sum())
    length = 1 / max((h / scale).sum(1)[present])
    r = np.ones(len(t))
    for _ in range(iterations):
        gap = np.where(present, (p * (t * r)[:, None]).sum(0) - target, 0)
        if np.abs(gap).max() <= 1e-9 * t.sum():
            break
        r = np.maximum(0, r - length * (p / scale) @ gap)
    return r


@pytest.mark.parametrize("weights", [None, {"k": 1.0, "w": 1.0, "o": 1.0}, {"k": 1.0, "w": 5.0}])
def test_rates_are_numpy_descent(spark, weights):
    rows = texts()
    df = table(spark, rows, DOCS + ", lang string")
    labels = spark.createDataFrame([(i,) for i, _, _ in rows if i % 2], "doc_id long")
    mix = mixing.learn(df, "lang", labels)
    known = mixing.measured(df, "lang", mix)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        mix = mixing.fit(known, mix, weights)
    assert bool([w for w in said if "miss their targets" in str(w.message)]) == (mix.residual > 0.01)
    got = {r.doc_id: r for r in mixing.rates(known, mix).collect()}
    order = sorted(got)
    p, t = np.array([got[i].posterior for i in order]), np.array([got[i].t for i in order])
    assert np.allclose(p.sum(1), 1)
    assert [t_ for i, t_ in zip(order, t, strict=True)] == [len(dict((a, b) for a, b, _ in rows)[i].split(" ")) for i in order]
    now = (p * t[:, None]).sum(0)
    w = np.array([(now[k] / now.sum()) ** 0.8 if weights is None else weights.get(d, 0.0) for k, d in enumerate(mix.domains)])
    target = w / w.sum() * now.sum()
    want = solved(p, t, target, now > 1e-9 * now.sum())
    assert np.allclose([got[i].rate for i in order], want, atol=1e-6)
    if weights is None or len(weights) == 3:
        assert np.allclose((p * (t * want)[:, None]).sum(0), target, rtol=0.01)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got.values())
    best = [mix.domains[int(np.argmax(got[i].posterior))] for i in order]
    assert np.mean([b == lang for b, (_, _, lang) in zip(best, sorted(rows), strict=True)]) > 0.95


def test_odd_mixtures(spark):
    schema = DOCS + ", lang string, copies int"
    rows = [(i, t, None, None) for i, t in enumerate(ODD)] + [(None, "k k", "k", 1), (1, "w", "w", 2), (1, "w", "w", 2)]
    df = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "doc_id long")
    def fitted(df, labels):
        mix = mixing.learn(df, "lang", labels)
        return mixing.fit(mixing.measured(df, "lang", mix), mix)

    mix = fitted(df, none)
    assert mix.domains == ["all"] and {r.rate for r in mixing.rates(mixing.measured(df, "lang", mix), mix).collect()} == {1.0}
    assert sorted(map(str, mixing.mixed(df, mix).collect())) == sorted(map(str, df.collect()))
    some = fitted(df, spark.createDataFrame([(1,), (None,), (0,)], "doc_id long"))
    assert mixing.mixed(df, some).columns == df.columns
    empty = df.limit(0)
    assert mixing.mixed(empty, fitted(empty, none)).count() == 0


def test_mixed_rows_follow_their_copies(spark):
    rows = texts(3, 90)
    df = table(spark, rows, DOCS + ", lang string")
    mix = mixing.learn(df, "lang", spark.createDataFrame([(i,) for i, _, _ in rows], "doc_id long"))
    known = mixing.measured(df, "lang", mix)
    mix = mixing.fit(known, mix, {"k": 1.0, "w": 3.0, "o": 3.0})
    copies = {r.doc_id: r.copies for r in mixing.rates(known, mix).collect()}
    got = Counter(r.doc_id for r in mixing.mixed(df, mix).collect())
    assert got == {i: n for i, n in copies.items() if n}


def plain_posterior(text: str, mix: mixing.Mix) -> np.ndarray:
    found = [plain_hash(w[: mixing.START]) % mixing.BUCKETS for w in re.split("[ \n\r\t]", text.lower())]
    raw = np.array(mix.prior) + min(len(found), mixing.SURE) / max(len(found), 1) * sum(np.array([t[b] for t in mix.table]) for b in found)
    return np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum()


def test_posteriors_and_more_domains_than_are_told_apart(spark):
    """Naive Bayes over hashed word starts in plain Python; the rarest domains count as one; ties are halves."""
    rows = [(i, t, f"d{i % 7}" if i % 9 else "rare" + str(i)) for i, (_, t, _) in enumerate(texts(5, 90))] + [(900, "б в г д", "кир"), (901, "б в г", "кир"), (902, "both", "d1"), (903, "both", "d2")]
    df = table(spark, rows, DOCS + ", lang string")
    ids = spark.createDataFrame([(i,) for i, _, _ in rows], "doc_id long")
    mix = mixing.learn(df, "lang", ids, most_domains=9)
    assert len(mix.domains) == 9 and mix.domains[-1] == mixing.OTHERS and all(d.startswith("rare") for d in mix.merged)
    got = {r.doc_id: r.p for r in mixing.measured(df, "lang", mix).collect()}
    for i, t, _ in rows:
        assert got[i] == pytest.approx(plain_posterior(t, mix), abs=1e-9)
    assert mix.domains[int(np.argmax(got[901]))] == "кир"
    again = mixing.fit(mixing.measured(df, "lang", mix), mix, {d: 1.0 for d in mix.domains} | {"rare0": 2.0})
    assert again.targets[-1] == pytest.approx(3 / 11 * sum(again.targets))


def test_domain_totals_meet_their_targets(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    mix = mixing.learn(docs, "lang", spark.read.parquet(f"{larger}/labels.parquet"))
    known = mixing.measured(docs, "lang", mix)
    mix = mixing.fit(known, mix)
    got = mixing.rates(known, mix)
    sums = got.agg(*(F.sum(F.col("t") * F.col("rate") * F.col("posterior")[i]) for i in range(len(mix.domains)))).first()
    assert list(sums) == pytest.approx(mix.targets, rel=1e-4) and mix.residual < 1e-4
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    right = got.select((F.element_at(F.array(*map(F.lit, mix.domains)), best) == F.col("domain")).cast("double").alias("y")).agg(F.avg("y")).first()[0]
    assert right > 0.98, right


def test_mixing_query(spark, small):
    df = queries.op9_mixing(spark, small)
    total = df.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("rate"))).first()
    assert df.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    assert total[1] == pytest.approx(total[0], rel=0.02)
