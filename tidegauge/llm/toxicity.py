"""Toxicity: Levenshtein automata over a lexicon trie, with context windows (operator 7)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, materialise, small_batches, texts_of
from .quality import SAMPLE_ROWS, sampled_labels

#: A term of the lexicon occurs in so many toxic rows at least, and is so much commoner there: its rate
#: in toxic rows over the sum of its rates in both classes.
SUPPORT, PRECISION = 4, 0.85
#: A toxic document counts as explained once this many chosen terms occur in it.
COVER = 3
WINDOW = 12
#: Share of a hit's weight that remains where the window shows quotation, or reported speech.
QUOTED, REPORTED, ADDRESSED = 0.4, 0.7, 1.25

_WORDS = re.compile(r"[^\W_]+")
_PREFIXES = range(3, 9)
#: What closes each opening mark: English, German (both ways) and French quotation.
_CLOSED_BY = {"“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’", "‹": "›", "›": "‹", '"': '"', "'": "'"}
_MARKS = frozenset("".join(_CLOSED_BY) + "".join(_CLOSED_BY.values()))
_REPORTING = frozenset("said says wrote writes quote quoted quotes called calls according claimed reported word term sagte sagt schrieb zitat nannte laut dit dixit écrit selon citation appelé dijo dice escribió según cita llamó".split())
_ADDRESS = frozenset("you your you're u ur yourself du dich dir dein deine sie ihr tu te toi ton ta vous votre tú ti usted ustedes eres vos".split())


def budget(term: str) -> int:
    """Edits that a term is matched within: none under 4 letters, two from 8 on."""
    n = len(term.rstrip("*"))
    return 0 if n < 4 else 1 if n < 8 else 2


class Automaton:
    """All words within their budget of edits of a lexicon, as a deterministic automaton made on demand.

    A state is a set of (trie node, edits): the Levenshtein automata of all terms, run along the
    shared trie at once. Terms that end in ``*`` match any word that starts near them. Words are
    matched many at a time: one table look-up per letter for all of them.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.room = [0]
        for t, term in enumerate(terms):
            node = 0
            self.room[0] = max(self.room[0], budget(term))
            for c in term.rstrip("*"):
                if c not in self.kids[node]:
                    self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.ends.append([])
                    self.room.append(0)
                node = self.kids[node][c]
                self.room[node] = max(self.room[node], budget(term))
            self.ends[node].append(t)
        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for t in terms for c in t.rstrip("*")}))}
        self.names = {i: c for c, i in self.letters.items()}
        #: The letters' code points in order; a letter's code is its place from 1 on. The last is none's.
        self.points = np.array([*map(ord, self.letters), 0xFFFFFFFF], np.uint32)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.table = np.full((64, len(self.letters) + 1), -1, np.int64)
        self.accepts: list[dict[int, int]] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({0: 0}, {}))

    def _closed(self, nodes: dict[int, int], done: dict[int, int]) -> frozenset:
        """With skipped letters followed, as pairs (node, least edits) and (-1 - term, edits) for
        starred terms that have matched."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            e = nodes[node]
            for kid in self.kids[node].values():
                if e + 1 <= self.room[kid] and nodes.get(kid, 99) > e + 1:
                    nodes[kid] = e + 1
                    todo.append(kid)
        for node, e in nodes.items():
            for t in self.ends[node]:
                if self.terms[t].endswith("*") and e <= budget(self.terms[t]):
                    done[t] = min(done.get(t, 99), e)
        return frozenset([*nodes.items(), *((-1 - t, e) for t, e in done.items())])

    def _state(self, members: frozenset) -> int:
        if members not in self.states:
            self.states[members] = len(self.sets)
            self.sets.append(members)
            found: dict[int, int] = {}
            for node, e in members:
                for t in [-1 - node] if node < 0 else self.ends[node]:
                    if e <= budget(self.terms[t]):
                        found[t] = min(found.get(t, 99), e)
            self.accepts.append(found)
            if len(self.sets) > len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
        return self.states[members]

    def _step(self, state: int, code: int) -> int:
        letter, nodes, done = self.names.get(code), {}, {}
        for node, e in self.sets[state]:
            if node < 0:
                done[-1 - node] = e
                continue
            for c, kid in self.kids[node].items():
                cost = e + (c != letter)
                if cost <= self.room[kid]:
                    nodes[kid] = min(nodes.get(kid, 99), cost)
            if e + 1 <= self.room[node]:
                nodes[node] = min(nodes.get(node, 99), e + 1)
        return self._state(self._closed(nodes, done))

    def run(self, words: list[str]) -> np.ndarray:
        """The final state of each word; ``accepts`` of it has the terms matched and their edits."""
        out = np.full(len(words), self.dead, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for least, most in ((1, 16), (17, 64), (65, 1 << 40)):
            rows = np.flatnonzero((lengths >= least) & (lengths <= most))
            if not len(rows):
                continue
            if most > 64:  # one by one, so that a very long word needs no wide table of all
                for r in rows.tolist():
                    state = self.start
                    for c in words[r]:
                        state = self._to(state, self.letters.get(c, 0))
                        if state == self.dead:
                            break
                    out[r] = state
                continue
            wide = np.array([words[r] for r in rows.tolist()], dtype=f"U{most}")
            points = wide.view(np.uint32).reshape(len(rows), most)
            place = np.searchsorted(self.points, points)
            codes = np.where(self.points[place] == points, place + 1, 0)
            size = lengths[rows]
            live, state = np.arange(len(rows)), np.full(len(rows), self.start)
            for i in range(most):
                live = live[(size[live] > i) & (state[live] != self.dead)]
                if not len(live):
                    break
                to = self.table[state[live], codes[live, i]]
                for at, code in {(s, c) for s, c in zip(state[live[to < 0]].tolist(), codes[live[to < 0], i].tolist(), strict=True)}:
                    self._to(at, code)
                state[live] = self.table[state[live], codes[live, i]]
            out[rows] = state
        return out

    def _to(self, state: int, code: int) -> int:
        if self.table[state, code] < 0:
            to = self._step(state, code)
            self.table[state, code] = to
        return int(self.table[state, code])


def marks_of(token: str) -> list[tuple[str, bool, bool]]:
    """The quotation marks of a token as (mark, letter before it, letter after it)."""
    if _MARKS.isdisjoint(token):
        return []
    sides = [False, *map(str.isalnum, token), False]
    return [(c, sides[i], sides[i + 2]) for i, c in enumerate(token) if c in _MARKS]


def quoted(marks: list[tuple[int, str, bool, bool]]) -> list[tuple[float, float]]:
    """Spans between paired quotation marks, for marks (token, mark, letter before, letter after) in order.

    A span runs from before the token that it opens to after the one that it closes. A mark between
    two letters is an apostrophe. A mark that can close an open pair does so unless it stands right
    before a word, and pairs left open within that one are none; else a mark that can open and has
    no letter before it opens a pair. What is never closed is no quotation."""
    spans, pending = [], []
    for at, mark, before, after in marks:
        if before and after and mark in "'’‘":
            continue
        inner = next((i for i in range(len(pending) - 1, -1, -1) if mark in _CLOSED_BY[pending[i][0]]), None)
        if inner is not None and (before or not after or mark == '"'):
            spans.append((pending[inner][1], at + 0.5))
            del pending[inner:]
        elif mark in _CLOSED_BY and not before:
            pending.append((mark, at - 0.5 if after else at + 0.5))
    return spans


@dataclass
class Model:
    """terms, the weight of each (term, edits), and the logistic function over a text's evidence."""

    terms: list[str]
    weights: dict[tuple[int, int], float]
    beta: np.ndarray
    automaton: Automaton = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float, float]], int]]:
        """For each text: its number, hits as (term, edits, context factor, window's share), words."""
        if self.automaton is None:
            self.automaton = Automaton(self.terms)
        n = len(texts)
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        tokens, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        parts = [_WORDS.findall(t.lower()) for t in tokens]
        single = [p[0] if p else "" for p in parts]
        final = self.automaton.run(single)
        best: dict[int, list[tuple[int, int]]] = {}
        accepting = np.array([bool(a) for a in self.automaton.accepts])
        for u in np.flatnonzero(accepting[final]).tolist():
            best.setdefault(u, []).append(self._pick(int(final[u])))
        more = [(u, w) for u, p in enumerate(parts) if len(p) > 1 for w in p[1:]]
        if more:
            last = self.automaton.run([w for _, w in more])
            accepting = np.array([bool(a) for a in self.automaton.accepts])
            for k in np.flatnonzero(accepting[last]).tolist():
                best.setdefault(more[k][0], []).append(self._pick(int(last[k])))
        best = {u: kept for u, found in best.items() if (kept := [x for x in found if x])}
        is_hit = np.zeros(len(tokens) + 1, bool)
        is_hit[list(best)] = True
        hit_at = np.flatnonzero(is_hit[code]) if len(code) else np.zeros(0, np.int64)
        words = np.diff(bounds)
        if not len(hit_at):
            yield from ((i, [], int(words[i])) for i in range(n))
            return
        owner = np.searchsorted(bounds, hit_at, "right") - 1
        flags = {name: np.array([any(x in words for x in p) for p in parts], np.int64) for name, words in (("report", _REPORTING), ("address", _ADDRESS))}
        marks = [marks_of(t) for t in tokens]
        marked = np.flatnonzero(np.array([bool(m) for m in marks])[code])
        spans: dict[int, list[tuple[float, float]]] = {}
        for d in np.unique(owner).tolist():
            own = marked[np.searchsorted(marked, bounds[d]) : np.searchsorted(marked, bounds[d + 1])]
            spans[d] = quoted([(at, *m) for at in own.tolist() for m in marks[code[at]]]) if len(own) else []
        sums = {k: np.append(0, np.cumsum(v[code])) for k, v in flags.items()}
        begin, end = bounds[owner], bounds[owner + 1]
        low, high = np.maximum(begin, hit_at - WINDOW), np.minimum(end, hit_at + WINDOW + 1)
        is_quoted = np.zeros(len(hit_at), bool)
        for d, own in spans.items():
            first, last = np.searchsorted(hit_at, bounds[d]), np.searchsorted(hit_at, bounds[d + 1])
            for x, y in own:
                is_quoted[first + np.searchsorted(hit_at[first:last], x) : first + np.searchsorted(hit_at[first:last], y)] = True
        seen: dict[int, list] = {}
        for k, at in enumerate(hit_at.tolist()):
            u, a, b = int(code[at]), low[k], high[k]
            inside = is_quoted[k]
            factor = (QUOTED if inside else 1.0) * (REPORTED if sums["report"][b] > sums["report"][a] else 1.0) * (ADDRESSED if sums["address"][b] > sums["address"][a] else 1.0)
            near = (np.searchsorted(hit_at, b) - np.searchsorted(hit_at, a)) / float(b - a)
            seen.setdefault(int(owner[k]), []).extend((t, d, factor, float(near)) for t, d in best[u])
        yield from ((i, seen.get(i, []), int(words[i])) for i in range(n))

    def _pick(self, state: int) -> tuple[int, int] | None:
        """Of the terms that a word matches, the one that weighs most; none that weighs nothing."""
        found = [(self.weights.get((t, e), 0.0), -e, t) for t, e in self.automaton.accepts[state].items()]
        weight, e, t = max(found)
        return (t, -e) if weight > 0 else None

    def evidence(self, hits: list[tuple[int, int, float, float]], words: int) -> list[float]:
        each = [self.weights[t, d] * f for t, d, f, _ in hits]
        total = sum(each)
        dense = np.log1p(1000 * total / max(words, 20)) / 5
        return [1.0, np.log1p(total), max(each, default=0.0), dense, max((h[3] for h in hits), default=0.0), np.log1p(total) * dense]

    def score(self, texts: pa.Array) -> np.ndarray:
        x = np.array([self.evidence(h, n) for _, h, n in self.hits(texts)]).reshape(len(texts), len(self.beta))
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30)))


def _terms_of(texts: pa.Array) -> Iterator[set[str]]:
    """The distinct words of each text, and their starts as starred terms."""
    for text in texts.to_pylist():
        words = set(_WORDS.findall(text.lower()))
        yield {w for w in words if len(w) >= 3} | {w[:k] + "*" for w in words for k in _PREFIXES if len(w) > k}


def _choose(docs: list[list[int]], terms: list[str], *, support: int = SUPPORT, cover: int = COVER) -> list[str]:
    """Of the telling terms that each toxic document has, a lexicon: by greedy covering that favours
    whole words over starts and long terms over short. A document that ``cover`` chosen terms explain
    speaks for no more, so that what copies of one document share by chance is not taken for
    vocabulary."""
    of: dict[int, list[int]] = {}
    for d, s in enumerate(docs):
        for t in s:
            of.setdefault(t, []).append(d)
    need, chosen = np.full(len(docs), cover), []
    gain = {t: len(ds) for t, ds in of.items()}
    worth = lambda t: gain[t] * (0.7 if terms[t].endswith("*") else 1.0) * (1 + 0.03 * len(terms[t]))
    threshold = max(support, len(docs) // 200)
    while gain:
        t = max(gain, key=lambda t: (worth(t), terms[t]))
        gain.pop(t)
        now = sum(need[d] > 0 for d in of[t])
        if now < threshold:  # others may still explain more: worth is not support alone
            continue
        gain[t] = now
        if len(gain) > 1 and worth(t) < max(worth(o) for o in gain if o != t):
            continue
        gain.pop(t)
        chosen.append(terms[t])
        for d in of[t]:
            need[d] -= 1
        stem = terms[t].rstrip("*")
        for other in [o for o in gain if terms[o].rstrip("*").startswith(stem) or (stem.startswith(terms[o].rstrip("*")) and len(of[o]) <= 1.1 * len(of[t]))]:
            gain.pop(other)
    return chosen


def fit(docs: DataFrame, labels: DataFrame, learn: "F.Column", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon, weights and scoring function learnt from at most ``rows`` labelled documents.

    Without toxic rows the lexicon is empty and every score is the same."""
    spark = docs.sparkSession
    small_batches(spark)
    known = F.broadcast(sampled_labels(labels, label, learn, rows))
    sample = materialise(docs.selectExpr("cast(doc_id as long) as doc_id", "text").join(known, "doc_id"), "toxicity-sample")

    def counted(known: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts: dict[str, int] = {}
                for part in blocks(batch):
                    for terms in _terms_of(texts_of(part)):
                        for t in terms if known is None else terms & known:
                            counts[t] = counts.get(t, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        return run

    # every term is counted in all sampled rows: first in the toxic ones, then those of enough support in the others
    toxic, clean = sample.filter("label > 0").select("text"), sample.filter("not label > 0").select("text")
    total = lambda rows, known: rows.mapInArrow(counted(known), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    bad_in = {r.term: r.n for r in total(toxic, None).filter(F.col("n") >= SUPPORT).collect()}
    clean_in = {r.term: r.n for r in total(clean, frozenset(bad_in)).collect()} if bad_in else {}
    sizes = {bad: max(1, n) for bad, n in ((r.bad, r["count"]) for r in sample.groupBy((F.col("label") > 0).alias("bad")).count().collect())}
    rate = lambda t: bad_in[t] / sizes[True]
    terms = sorted(t for t in bad_in if rate(t) >= PRECISION * (rate(t) + clean_in.get(t, 0) / sizes.get(False, 1)))
    number = {t: i for i, t in enumerate(terms)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [sorted(number[t] for t in own if t in number) for own in _terms_of(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32()))], ["ids"])

    lexicon = _choose([list(r.ids) for r in toxic.mapInArrow(present, "ids array<int>").collect()], terms)
    model = Model(lexicon, {(t, e): 1.0 for t, term in enumerate(lexicon) for e in range(budget(term) + 1)}, np.zeros(6))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(str([(t, d, f, round(w, 4)) for t, d, f, w in h]), n) for _, h, n in model.hits(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), batch.column(1)], ["hits", "words", "label"])

    import ast

    rows_hit = [(ast.literal_eval(r.hits), r.words, r.label > 0) for r in sample.select("text", "label").mapInArrow(matched, "hits string, words long, label double").collect()]
    n = [max(1, sum(words for _, words, bad in rows_hit if bad == k)) for k in (False, True)]
    counts: dict[tuple[int, int], list[int]] = {}
    for hits, _, bad in rows_hit:
        for t, d, _, _ in hits:
            counts.setdefault((t, d), [0, 0])[bad] += 1
    ratio = lambda clean, bad: float(np.log((bad + 0.5) / n[1]) - np.log((clean + 0.5) / n[0]))  # noqa: E731  of the rates a word
    for t, e in list(model.weights):
        clean, bad = counts.get((t, e), (0, 0))
        if e and not bad and not clean and not lexicon[t].endswith("*"):
            # a misspelling that the sample has not at all: somewhat less than the term itself
            odds = 0.7**e * ratio(*counts.get((t, 0), (0, 0)))
        else:
            odds = ratio(clean, bad) if bad else 0.0
        model.weights[t, e] = min(odds / 4, 2.0) if odds > 1.2 else 0.0
    kept = [([h for h in hits if model.weights[h[0], h[1]] > 0], words, bad) for hits, words, bad in rows_hit]
    x = np.array([model.evidence(h, w) for h, w, _ in kept]).reshape(len(kept), 6)
    model.beta = _logistic(x, np.array([r[2] for r in kept], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> np.ndarray:
    """Newton's method for a logistic regression; the constant is hardly held back."""
    beta = np.zeros(x.shape[1])
    hold = np.diag([1e-3, *[l2] * (x.shape[1] - 1)])
    for _ in range(50 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ beta)
        beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return beta


def score_toxicity(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score appended under the name ``column``; an older column of that name is replaced.

    A null text counts as empty, an empty text scores like one without hits, repeated rows are scored
    each for itself, and an empty table gives no rows. Other columns pass through."""
    small_batches(docs.sparkSession)
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                scores = pa.array(model.score(texts_of(part)), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, column])

    return docs.mapInArrow(run, schema)
