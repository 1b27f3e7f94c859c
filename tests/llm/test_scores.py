"""Quality and toxicity: statistics by hand, trees and automata against plain searches, held-out accuracy."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import quality, queries, toxicity

from .helpers import DOCS, ODD, table

LABELS = "doc_id long, quality int, toxic int"


def test_statistics_by_hand():
    texts = ["Ab ab, ab!\nline line\nline line", *[t or "" for t in ODD]]
    x = quality.statistics(pa.array(texts, pa.large_string()))
    named = dict(zip(quality.FEATURES, x[0], strict=True))
    n = len(texts[0])
    assert named["log_bytes"] == pytest.approx(math.log1p(n))
    assert named["share_upper"] == pytest.approx(1 / n)
    assert named["share_comma"] == named["share_exclaim"] == pytest.approx(1 / n)
    assert named["log_words"] == pytest.approx(math.log1p(7))
    assert named["distinct_words"] == pytest.approx(4 / 7)
    assert named["top_word"] == pytest.approx(4 / 7)
    assert named["distinct_lines"] == pytest.approx(2 / 3) and named["top_line"] == pytest.approx(2 / 3)
    counts = np.bincount(np.frombuffer(texts[0].encode(), np.uint8), minlength=256) / n
    assert named["byte_entropy"] == pytest.approx(-sum(c * math.log2(c) for c in counts if c))
    assert np.isfinite(x).all() and (x[1] == 0).all()
    for i, t in enumerate(texts):  # a text's statistics don't depend on its neighbours
        assert np.allclose(quality.statistics(pa.array([t], pa.large_string()))[0], x[i])


def walk(model: quality.Trees, row: np.ndarray) -> float:
    total = model.base
    for node in model.roots.tolist():
        while model.left[node] != node:
            node = int(model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node])
        total += model.value[node]
    return 1 / (1 + math.exp(-total))


def test_flat_trees_are_walked_trees():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    model = quality.fit_trees(x[:400], y[:400])
    scores = model.score(x)
    assert np.allclose(scores, [walk(model, r) for r in x])
    assert ((scores[400:] > 0.5) == y[400:]).mean() > 0.95


@pytest.mark.parametrize("y", [[], [0.0] * 5, [1.0] * 5])
def test_trees_of_one_class(y):
    x = np.arange(len(y) * 2.0).reshape(-1, 2)
    model = quality.fit_trees(x, np.array(y))
    assert not len(model.roots)
    assert np.unique(model.score(np.zeros((3, 2)))).size == 1


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_automaton_is_plain_distances(seed):
    rng = random.Random(seed)
    terms = ["idiot", "moron", "stupidity", "vermin*", "fool", "sub*", "übel"]
    machine = toxicity.Automaton(terms)
    words = ["", "x", "ab"]
    for t in terms:
        base = t.rstrip("*")
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(w) + 1)
                what = rng.randrange(3)
                if what == 0:
                    w.insert(at, rng.choice("abdimotuüz"))
                elif w and at < len(w):
                    if what == 1:
                        w.pop(at)
                    else:
                        w[at] = rng.choice("abdimotuüz")
            words.append("".join(w) + (rng.choice(["", "ous", "x" * 80]) if t.endswith("*") else ""))
    final = machine.run(words)
    for w, state in zip(words, final.tolist(), strict=True):
        want = {}
        for i, t in enumerate(terms):
            base = t.rstrip("*")
            least = min((distance(base, w[:k]) for k in range(len(w) + 1)), default=99) if t.endswith("*") else distance(base, w)
            if least <= toxicity.budget(t):
                want[i] = least
        assert machine.accepts[state] == want, w


def test_letters_of_all_scripts():
    terms = ["дурак", "βλάκας", "غبي", "טיפש", "笨蛋", "𐐀𐐁𐐂𐐃𐐄", "plain"]
    machine = toxicity.Automaton(terms)
    for k, term in enumerate(terms):
        assert machine.accepts[machine.run([term])[0]].get(k) == 0
    assert machine.accepts[machine.run(["дурка"])[0]] == {} and machine.accepts[machine.run(["дурок"])[0]] == {0: 1}
    assert machine.accepts[machine.run(["ɐɐɐɐɐ"])[0]] == {}


def test_quotation_weighs_less_than_abuse():
    model = toxicity.Model(["vermin"], {("vermin", 0): 1.0, (0, 0): 2.0, (0, 1): 1.0}, np.array([-2.0, 1.0, 1.0, 1.0, 0.5, 0.5]))
    filler = "plain words stand here and there to make the text longer than a window of words would be on its own " * 2
    abuse, quoted, missed, clean = model.score(pa.array([f"{filler} you vermin {filler}", f'{filler} he wrote "vermin" in it {filler}', f"{filler} you vermn {filler}", filler], pa.large_string()))
    assert abuse > quoted > clean
    assert abuse > missed > clean


PAIRED = ["“{}”", "„{}“", "„{}”", "«{}»", "»{}«", "‘{}’", "‚{}‘", "‹{}›", "›{}‹", '"{}"', "'{}'", "« {} »"]


@pytest.mark.parametrize("marks", PAIRED)
def test_quotation_marks_come_in_pairs(marks):
    """English, German and French quotation of one word and of several; what is not closed, or is an
    apostrophe, or stands outside is none."""
    term = "vermin"
    model = toxicity.Model([term], {(0, 0): 2.0}, np.zeros(6))

    def factor(text: str) -> list[float]:
        ((_, found, _),) = model.hits(pa.array([text], pa.large_string()))
        return [f for _, _, f, _ in found]

    for body in (f"{term}", f"such {term} here", f"such {term}.", f"it's {term}", f"l’un {term}, d’autre"):
        assert factor(f"one two {marks.format(body)} three {term} four") == [toxicity.QUOTED, 1.0], body
        assert factor(f"{term} one two ({marks.format(body)}), three") == [1.0, toxicity.QUOTED], body
    assert factor(f"one {marks[0]} two {term} three") == [1.0]
    assert factor(f"don’t {term} can’t") == factor(f"don't {term} can't") == [1.0]
    assert factor(f"{marks.format('one')} {term} {marks.format('two')}") == [1.0]
    assert factor(f"{marks.format('one')} {marks.format(term)} {term}") == [toxicity.QUOTED, 1.0]


def spans_by_search(text: str, marks: str) -> list[bool]:
    """Of each word, whether an opening mark before it is closed after it, for one kind of marks."""
    opening, closing = marks.split("{}")
    words, out = text.split(" "), []
    for i in range(len(words)):
        left = [k for k in range(i + 1) if words[k].startswith(opening)]
        right = [k for k in range(i, len(words)) if words[k].endswith(closing)]
        inner = left and right and not any(words[k].endswith(closing) for k in range(left[-1], i))
        out.append(bool(inner))
    return out


@pytest.mark.parametrize("marks", ["“{}”", "„{}“", "«{}»", "»{}«"])
def test_quoted_words_are_those_of_a_search(marks):
    rng = random.Random(7)
    opening, closing = marks.split("{}")
    for _ in range(60):
        words, inside = [], False
        for _ in range(30):
            w = "word"
            if not inside and rng.random() < 0.2:
                w, inside = opening + w, True
            if inside and rng.random() < 0.3:
                w, inside = w + closing, False
            words.append(w)
        if inside:
            words[-1] += closing
        tokens = [(i, *m) for i, w in enumerate(words) for m in toxicity.marks_of(w)]
        spans = toxicity.quoted(tokens)
        assert [any(a < i < b for a, b in spans) for i in range(len(words))] == spans_by_search(" ".join(words), marks)


def test_every_telling_term_is_looked_at(spark):
    """More candidate terms than any bound on their number would hold, the telling ones the rarest."""
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(240):
        toxic = i % 3 == 0
        words = [f"{rng.choice('bcdfghjklm')}{rng.choice('aeiou')}{rng.choice('nprstvwxz')}{rng.choice('aeiou')}{rng.choice('bcdfgklm')}" for _ in range(400)]
        if toxic:
            words[rng.randrange(400)] = f"loathsome{'abcdefgh'[i // 3 % 8] * 3}"
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    model = toxicity.fit(table(spark, docs), spark.createDataFrame(labels, LABELS), F.lit(True))
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(table(spark, docs), model).collect()}
    assert np.mean([(score[i] > 0.5) == bool(t) for i, _, t in labels]) > 0.95


def best_split(x, g, h, rows, edges, least, l2):
    """The split of greatest gain by trying every edge of every feature."""
    best = (1e-9, None, None)
    for j in range(x.shape[1]):
        for e in edges[j]:
            left = [r for r in rows if x[r, j] <= e]
            right = [r for r in rows if x[r, j] > e]
            if len(left) < least or len(right) < least:
                continue
            part = lambda rs: g[rs].sum() ** 2 / (h[rs].sum() + l2)
            gain = part(left) + part(right) - part(rows)
            if gain > best[0] + 1e-12:
                best = (gain, j, e)
    return best


def test_boosting_is_plain_boosting():
    """The trees against a boosting that looks at each split by itself."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(80, 3)), 1)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=80) * 0.2 > 0.6).astype(float)
    trees, depth, rate, bins, l2, least = 6, 2, 0.3, 8, 1.0, 2
    model = quality.fit_trees(x, y, trees=trees, depth=depth, rate=rate, bins=bins, l2=l2, least=least)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(3)]
    raw = np.full(80, np.log((y.sum() + 1) / (80 - y.sum() + 1)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        todo = [(list(range(80)), 0)]
        while todo:
            rows, d = todo.pop()
            _, j, e = best_split(x, g, h, rows, edges, least, l2) if d < depth and len(rows) >= 2 * least else (0, None, None)
            if j is None:
                raw[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
            else:
                todo += [([r for r in rows if x[r, j] <= e], d + 1), ([r for r in rows if x[r, j] > e], d + 1)]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-raw)))


def labelled(n: int = 400):
    rng = random.Random(9)
    common = [f"{a}{b}" for a in ("ta", "re", "mo", "li", "su", "ne", "ko", "pa") for b in ("ran", "lin", "mer", "tok", "vas", "dil")]
    bad = ["scumbag", "dimwit", "loathsome"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randrange(20, 80))]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for b in rng.sample(bad, 2):
                w = list(b)
                if rng.random() < 0.3:
                    w[rng.randrange(1, len(w))] = rng.choice("abcdeo")
                words.insert(rng.randrange(len(words)), "".join(w))
        text = " ".join(words).capitalize() + "." if good else " ".join(rng.choice(["###", "a1b2", words[0], "$$"]) for _ in words)
        docs.append((i, text if good or not toxic else text + " " + " ".join(bad)))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_held_out(spark):
    docs, labels = labelled()
    df, lb = table(spark, docs), spark.createDataFrame(labels, LABELS)
    learn = F.col("doc_id") % 2 == 0
    want = {i: (q, t) for i, q, t in labels}
    scored = quality.score_quality(df, quality.fit(df, lb, learn))
    assert np.mean([(r.score > 0.5) == want[r.doc_id][0] for r in scored.collect() if r.doc_id % 2]) > 0.95
    scored = toxicity.score_toxicity(df, toxicity.fit(df, lb, learn))
    assert np.mean([(r.score > 0.5) == want[r.doc_id][1] for r in scored.collect() if r.doc_id % 2]) > 0.93


@pytest.mark.parametrize("fit,score", [(quality.fit, quality.score_quality), (toxicity.fit, toxicity.score_toxicity)])
def test_odd_rows_and_columns(spark, fit, score):
    docs, labels = labelled(120)
    rows = [(i, t, "a", 0.5) for i, t in docs] + [(1000 + i, t, None, None) for i, t in enumerate(ODD)] + [(None, "x", None, None), (5, None, "b", 1.0), (5, None, "b", 1.0)]
    df = table(spark, rows, DOCS + ", label string, Score double")
    lb = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1), (5, 0, 0), (5, 1, 1)], LABELS)
    model = fit(df, lb, F.lit(True))
    got = score(df, model, "score").collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5 and r.text is None}) == 1
    empty = fit(df.limit(0), lb.limit(0), F.lit(True))
    assert score(df.limit(0), empty).count() == 0
    assert len({r.s for r in score(df, empty, "s").collect()}) == 1


@pytest.mark.parametrize("name,modulus,left,label,least", [("op2_quality", 4, 2, "quality", 0.8), ("op7_toxicity", 5, 0, "toxic", 0.9)])
def test_queries(spark, largest, name, modulus, left, label, least):
    """Over sf0.1: the smaller tables hold out six toxic rows, too few to tell."""
    from zlib import crc32

    rows = queries.QUERIES[name](spark, largest).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{largest}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{largest}/documents.parquet").count()
    cut = 0.7 if name == "op2_quality" else 0.5
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % modulus == left)
        assert r.predicted == int(r.score >= cut)
    tested = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    high, low = ([s for s, y in tested if y == k] for k in (1, 0))
    assert len(high) > 50 and len(low) > 50
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in high for b in low])
    assert auc > least, auc


def test_words_are_found_by_the_same_pattern():
    assert re.findall(toxicity._WORDS, "don't_stop, Über!") == ["don", "t", "stop", "Über"]
