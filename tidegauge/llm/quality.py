"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, small_batches, texts_of

#: Labelled rows that a model is fitted on at most: those whose ids hash lowest. Models are small;
#: more rows than this change their held-out accuracy little, and the driver's memory is bounded.
SAMPLE_ROWS = 20_000

_CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "exclaim", "quote", "bracket", "symbol", "control", "high")
FEATURES = (
    "log_bytes", *(f"share_{c}" for c in _CLASSES), "log_words", "mean_word", "sd_word", "max_word", "distinct_words",
    "top_word", "adjacent_repeats", "distinct_pairs", "log_lines", "distinct_lines", "top_line", "mean_line", "byte_entropy",
)


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("symbol"), np.uint8)
    for name, members in (("control", [*range(32), 127]), ("high", range(128, 256)), ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", [9, 32]), ("newline", [10, 13]), ("stop", b".?"), ("comma", b",;:-"), ("exclaim", b"!"), ("quote", b"'\""), ("bracket", b"()[]{}<>")):
        table[list(members)] = _CLASSES.index(name)
    return table


_TABLE = _class_table()


def _per_doc(owner: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: how many distinct codes it has, and how often its commonest one occurs."""
    if not len(code):
        return np.zeros(n), np.zeros(n)
    keys = np.sort(owner * (int(code.max()) + 1) + code)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    whose = keys[first] // (int(code.max()) + 1)
    counts = np.diff(np.append(first, len(keys)))
    most = np.zeros(n)
    np.maximum.at(most, whose, counts)
    return np.bincount(whose, minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each whole text; an empty text has zeros throughout."""
    n = len(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    sizes = np.diff(ends)
    data = data[ends[0] : ends[-1]]
    owner = np.repeat(np.arange(n), sizes)
    histogram = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256)
    classes = np.zeros((n, len(_CLASSES)))
    for k in range(len(_CLASSES)):
        classes[:, k] = histogram[:, k == _TABLE].sum(1)
    length = np.maximum(sizes, 1).astype(float)
    share = histogram / length[:, None]
    entropy = -(share * np.log2(share, out=np.zeros_like(share), where=share > 0)).sum(1)

    split = pc.ascii_split_whitespace(texts)
    bounds = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    long = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(float)
    word_owner = np.repeat(np.arange(n), np.diff(bounds))
    real = long[code] > 0 if len(code) else np.zeros(0, bool)
    code, word_owner = code[real], word_owner[real]
    word_size = long[code]
    words = np.bincount(word_owner, minlength=n).astype(float)
    some = np.maximum(words, 1)
    mean = np.bincount(word_owner, word_size, n) / some
    sd = np.sqrt(np.maximum(np.bincount(word_owner, word_size**2, n) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, word_owner, word_size)
    distinct, top = _per_doc(word_owner, code, n)
    together = word_owner[1:] == word_owner[:-1]
    repeats = np.bincount(word_owner[1:][together & (code[1:] == code[:-1])], minlength=n)
    pair = (code[:-1] * 1_000_003 + code[1:])[together] % (1 << 31)
    pairs = np.maximum(np.bincount(word_owner[1:][together], minlength=n), 1)
    distinct_pairs, _ = _per_doc(word_owner[1:][together], pair, n)

    lines = pc.split_pattern(texts, "\n")
    line_owner = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    line_coded = lines.flatten().dictionary_encode()
    n_lines = np.maximum(np.bincount(line_owner, minlength=n), 1)
    distinct_lines, top_line = _per_doc(line_owner, line_coded.indices.to_numpy().astype(np.int64), n)
    out = np.column_stack([
        np.log1p(sizes), classes / length[:, None], np.log1p(words), mean, sd, np.log1p(longest), distinct / some, top / some, repeats / some,
        distinct_pairs / pairs, np.log(n_lines), distinct_lines / n_lines, top_line / n_lines, np.log1p(sizes / n_lines), entropy,
    ])
    out[sizes == 0] = 0
    return out


@dataclass
class Trees:
    """All trees in flat arrays of one node per place; a leaf is its own child."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; all rows go down all trees together, a level at a time."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])
        raw = self.base + self.value[node].sum(1)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss; splits are searched over quantile histograms.

    Without rows the score is 1/2 everywhere; with rows of one class only it is a constant."""
    n, m = x.shape
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]) if n else np.zeros((0, m), np.int64)
    flat = binned + np.arange(m) * bins
    nodes: list[list] = []
    roots, raw = [], np.full(n, base)
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        level = [(roots[-1], np.arange(n))]
        for d in range(depth + 1):
            below = []
            for at, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                nodes[at][4] = float(-rate * gs / (hs + l2))
                if d == depth or len(rows) < 2 * least:
                    raw[rows] += nodes[at][4]
                    continue
                places = flat[rows].ravel()
                hg = np.bincount(places, np.repeat(g[rows], m), m * bins).reshape(m, bins).cumsum(1)
                hh = np.bincount(places, np.repeat(h[rows], m), m * bins).reshape(m, bins).cumsum(1)
                cnt = np.bincount(places, minlength=m * bins).reshape(m, bins).cumsum(1)
                gain = hg**2 / (hh + l2) + (gs - hg) ** 2 / (hs - hh + l2) - gs**2 / (hs + l2)
                gain[(cnt < least) | (len(rows) - cnt < least)] = -np.inf
                j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if not gain[j, b] > 1e-9:
                    raw[rows] += nodes[at][4]
                    continue
                left = binned[rows, j] <= b
                kids = len(nodes), len(nodes) + 1
                nodes += [[0, np.inf, k, k, 0.0] for k in kids]
                nodes[at][:4] = [int(j), float(edges[j][b]), *kids]
                nodes[at][4] = 0.0
                below += [(kids[0], rows[left]), (kids[1], rows[~left])]
            level = below
    columns = list(zip(*nodes, strict=True)) or [()] * 5
    return Trees(base, *(np.array(c, k) for c, k in zip(columns, (np.int64, float, np.int64, np.int64, float), strict=True)), np.array(roots, np.int64), depth)


def sampled_labels(labels: DataFrame, label: str, learn: "F.Column", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled ids that may be learnt from: those that hash
    lowest. Several labels of one id count as the lowest; null labels and ids as none."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("double").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, label and the statistics of each text as an array; docs needs doc_id, text, label."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                x = statistics(texts_of(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64())), part.column(2)], ["doc_id", "x", "label"])

    return docs.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, x array<double>, label double")


def fit(docs: DataFrame, labels: DataFrame, learn: "F.Column", label: str = "quality", rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on the labelled documents that the ``learn`` condition over labels lets through."""
    known = F.broadcast(sampled_labels(labels, label, learn, rows))
    found = features(docs.selectExpr("cast(doc_id as long) as doc_id", "text").join(known, "doc_id")).orderBy("doc_id").collect()
    x = np.array([r.x for r in found]).reshape(len(found), len(FEATURES))
    return fit_trees(x, np.array([float(r.label) for r in found]))


def score_quality(docs: DataFrame, model: Trees, column: str = "score") -> DataFrame:
    """docs with a score appended under the name ``column``; an older column of that name is replaced.

    A null text counts as empty, an empty text has a score like any other, repeated rows are scored
    each for itself, and an empty table gives no rows. Other columns pass through."""
    small_batches(docs.sparkSession)
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                scores = model.score(statistics(texts_of(part)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, column])

    return docs.mapInArrow(run, schema)
