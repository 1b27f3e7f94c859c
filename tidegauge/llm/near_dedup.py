"""MinHash near-duplicates with sequential Bayesian verification (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, fresh, materialise, small_batches, texts_of
from .components import components, roots

SHINGLE = 5
HASHES = 128
BATCH = 32
#: Keys of up to three longs (at most some 80 MB) that are broadcast to texts instead of shuffling those.
BROADCAST_ROWS = 1 << 20
#: Rows and shingles of a block of outsiders, or of candidates for them, on average.
TILE, TILE_SHINGLES = 256, 1 << 18
#: Bytes of right texts that are cut into shingles together.
PAIR_BYTES = 1 << 20
#: Shingles of left texts that a worker remembers while it confirms pairs.
KNOWN_SHINGLES = 1 << 20

_MULTIPLY = np.random.default_rng(20240611).integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = np.random.default_rng(20240612).integers(0, 1 << 32, HASHES, dtype=np.uint32)
_P = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(SHINGLE + 1)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles.

    A-Z are lower-cased and words are what stands between ASCII white space. A text with fewer words
    than ``size`` has its whole sequence as one shingle, a text without words has none."""
    split = pc.ascii_split_whitespace(texts)
    bounds = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    # the words, not the texts, are lower-cased: on a slice ascii_lower reads beyond its values
    words = pc.ascii_lower(coded.dictionary).to_numpy(zero_copy_only=False)
    of_word = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)
    code = coded.indices.to_numpy()
    real = (words != "")[code] if len(words) else np.zeros(0, bool)
    hashes = of_word[code][real]
    ends = np.append(0, np.cumsum(real))[bounds]
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            rolled += hashes[k : k + len(rolled)] * _P[size - k]
        rolled = _mix(rolled)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = _mix(np.array([whole * _P[1] + h]))[0]
            out.append(np.array([whole]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima over a set, in pieces that stay in the cache."""
    low = hashes.astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        least = np.minimum(least, (low[i : i + 1024, None] * _MULTIPLY + _ADD).min(0))
    return least


def text_hashes() -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), "text").alias("text_hash"), F.xxhash64(F.lit(2), "text").alias("text_hash2")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and the MinHash signature of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                sets = shingle_sets(texts_of(part))
                with np.errstate(over="ignore"):
                    first = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                    second = np.array([_mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                sigs = pa.array([minhash(s).tobytes() if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(first), pa.array(second), sigs, part.column(2), part.column(3)], ["doc_id", "n_shingles", "h1", "h2", "sig", "text_hash", "text_hash2"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_hashes())
    return keyed.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary, text_hash long, text_hash2 long")


def least_matches(percent: int, miss: float, batch: int = BATCH, hashes: int = HASHES) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches to go on) for each batch.

    With a uniform prior on the similarity s, m matches of n leave P(s >= t) equal to the chance of
    at most m successes in n + 1 draws of probability t; a pair under ``miss`` is given up."""
    t, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                out.append((n, m))
                break
    return out


def banding(percent: int, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows of each) of a signature: the longest rows with which a pair at the threshold shares
    no band with a probability of at most ``miss``; 25 of 5 for 85 percent, 32 of 4 for 80."""
    fits = [r for r in range(2, 9) if (1 - (percent / 100) ** r) ** (HASHES // r) <= miss]
    return (HASHES // max(fits), max(fits)) if fits else (HASHES, 1)


def _similar(pairs: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose signatures leave the threshold likely enough."""
    bounds = least_matches(percent, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(n, HASHES) for k in (2, 3))
            live, matches, done = np.arange(n), np.zeros(n, np.int64), 0
            for upto, least in bounds:
                matches[live] += (x[live, done:upto] == y[live, done:upto]).sum(1)
                live, done = live[matches[live] >= least], upto
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(live)), batch.column(1).take(pa.array(live))], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Pairs (a, b, text_a, text_b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        held = 0
        for batch in batches:
            for part in blocks(batch, "text_b", PAIR_BYTES):
                keep = []
                lefts = part.column(2).to_pylist()
                for i, (text, b) in enumerate(zip(lefts, shingle_sets(texts_of(part, "text_b"), shingle), strict=True)):
                    if (a := known.get(text)) is None:
                        if held > KNOWN_SHINGLES:
                            known.clear()
                            held = 0
                        a = known[text] = shingle_sets(pa.array([text or ""], pa.large_string()), shingle)[0]
                        held += len(a)
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * common >= percent * (len(a) + len(b) - common):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), part.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int, miss: float) -> DataFrame:
    """The candidate pairs (a, b) that their signatures leave likely enough."""
    of = lambda side: reps.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"))
    sized = pairs.join(of("b"), "b").join(of("a"), "a").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return _similar(sized, percent, miss)


def bounded(keys: DataFrame, rows: int) -> DataFrame:
    """keys of at most ``rows`` rows as the side of a join: broadcast if that is few, else shuffled."""
    return F.broadcast(keys) if rows <= BROADCAST_ROWS else keys


def _exact(likely: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The likely pairs (a, b) that are links, on the full texts; each text is read from docs once."""
    likely = materialise(likely, "likely-pairs")
    ids = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct()
    ids = bounded(ids, 2 * likely.count())
    texts = materialise(docs.selectExpr("cast(doc_id as long) as doc_id", "text").join(ids, "doc_id", "left_semi"), "candidate-texts")
    text = lambda side: texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}"))
    links = materialise(_confirmed(likely.join(text("b"), "b").join(text("a"), "a"), percent, SHINGLE), "links")
    discard(likely, texts)
    return links


def _outsiders(led: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, miss: float) -> DataFrame | None:
    """Links (a, b) that no comparison with a leader has settled, contracted, or None.

    Of n shingles of x, u are in no other unsettled text. So x and y share at most
    m = min(n_x - u_x, n_y - u_y), and are no link if m is too few for their sizes. The outsiders that
    this leaves are the query set: blocks of them meet blocks of all rows of their leader, each pair of
    blocks in a task of its own choosing, and a tile gives a forest of its links alone."""
    label = lambda key, name: found.select(F.col("node").alias(key), F.col("component").alias(name))
    placed = led.join(label("b", "own"), "b", "left").join(label("a", "main"), "a", "left")
    placed = placed.select("a", "b", F.coalesce("own", "b").alias("own"), F.coalesce("main", "a").alias("main"))
    unsettled = placed.groupBy("a").agg(F.min("own").alias("_least"), F.max("own").alias("_most")).filter("_least < _most").select("a")
    rows = materialise(placed.join(unsettled, "a", "left_semi"), "unsettled")
    if not rows.count():
        return None
    nodes = rows.select(F.col("b").alias("doc_id")).distinct()
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "text").join(bounded(nodes, nodes.count()), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                sets = pa.array([x.tobytes() for x in shingle_sets(texts_of(part))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["b", "s"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, s in zip(batch.column(0), batch.column(1), strict=True):
                each = np.frombuffer(s.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), node.as_py())), pa.array(each)], ["node", "s"])

    sets = materialise(texts.mapInArrow(hashed, "b long, s binary"), "sets")
    single = sets.mapInArrow(split, "node long, s long").groupBy("s").agg(F.min("node").alias("node"), F.max("node").alias("_last"))
    own = single.filter("node = _last").groupBy("node").agg(F.count("*").alias("u"))
    sized = reps.groupBy("node").agg(F.min("n_shingles").alias("n_least"), F.max("n_shingles").alias("n"))
    known = rows.join(sized.withColumnRenamed("node", "b"), "b").join(own.withColumnRenamed("node", "b"), "b", "left")
    # where a doc_id stands on several rows, its sizes and shingles are not one text's: nothing is excluded
    known = known.withColumns({"u": F.when(F.col("n_least") == F.col("n"), F.coalesce("u", F.lit(0))).otherwise(0)}).drop("n_least")
    # an outsider whose own shingles leave no size that a partner could have is settled
    share = percent / 100
    most = F.least(F.col("n") / share, (F.col("n") - F.col("u")) / share - F.col("u")) * (1 + 1e-9)
    known = known.withColumn("asks", (F.col("own") != F.col("main")) & (most >= F.greatest(F.lit(1.0), F.col("n") * share * (1 - 1e-9))))
    known = known_table = materialise(known, "unsettled")
    weight = lambda rows, n: F.ceil(F.greatest(rows / F.lit(TILE), n / F.lit(TILE_SHINGLES)))
    counts = known.groupBy("a").agg(F.count("*").alias("_rows"), F.sum("n").alias("_all"), F.count_if("asks").alias("_asking"), F.sum(F.when(F.col("asks"), F.col("n"))).alias("_asked")).filter("_asking > 0")
    counts = counts.select("a", weight(F.col("_asking"), F.col("_asked")).alias("nx"), weight(F.col("_rows"), F.col("_all")).alias("ny"))
    own_block = lambda n: F.pmod(F.xxhash64("b"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    known = known.join(counts, "a")
    asking = known.filter("asks").select("*", own_block("nx").alias("x"), F.lit(True).alias("asker")).select("*", each("ny").alias("y"))
    asked = known.select("*", own_block("ny").alias("y"), F.lit(False).alias("asker")).select("*", each("nx").alias("x"))
    both = asking.unionByName(asked).join(sets, "b").join(reps.select(F.col("node").alias("b"), "sig"), "b")
    tiles = both.select("a", "x", "y", "asker", F.col("b").alias("id"), "own", (F.col("own") == F.col("main")).alias("inside"), "u", "sig", "s")
    bounds = least_matches(percent, miss)

    def met(tile: pa.Table) -> pa.Table:
        return _tile_links(tile, percent, bounds)

    links = materialise(tiles.groupBy("a", "x", "y").applyInArrow(met, "a long, b long"), "links")
    discard(rows, known_table, sets)
    return links


def _common(xs: list[np.ndarray], ys: list[np.ndarray], columns: int = 1 << 12) -> np.ndarray:
    """How many elements each of xs shares with each of ys: products of their incidence matrices over
    the elements that both sides have, some columns at a time."""
    shared = np.intersect1d(np.unique(np.concatenate(xs)), np.unique(np.concatenate(ys)), assume_unique=True)
    out = np.zeros((len(xs), len(ys)), np.int64)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
        at = np.searchsorted(shared, every)
        there = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == every)
        order = np.argsort(at[there], kind="stable")
        return owner[there][order], at[there][order]

    if len(shared):
        sides = [(*places(s), len(s)) for s in (xs, ys)]
        for low in range(0, len(shared), columns):
            width = min(columns, len(shared) - low)
            parts = []
            for owner, at, n in sides:
                some = slice(np.searchsorted(at, low), np.searchsorted(at, low + width))
                part = np.zeros((n, width), np.float32)
                part[owner[some], at[some] - low] = 1
                parts.append(part)
            out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _tile_links(tile: pa.Table, percent: int, bounds: list[tuple[int, int]]) -> pa.Table:
    """The links of a tile's askers with its asked rows, as a forest (a, b): pairs that sizes, own
    shingles and batches of their signatures leave likely are compared on their full sets."""
    asker = tile.column("asker").to_numpy()
    sides = [tile.filter(pa.array(m)) for m in (asker, ~asker)]
    (xi, xo, _, xu), (yi, yo, inside, yu) = ([t.column(c).to_numpy() for c in ("id", "own", "inside", "u")] for t in sides)
    xn, yn = (pc.binary_length(t.column("s")).to_numpy().astype(np.int64) // 8 for t in sides)
    xs, ys = (np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES) for t in sides)
    m = np.minimum((xn - xu)[:, None], yn - yu)
    fits = (xo[:, None] != yo) & (inside | (xi[:, None] < yi)) & (100 * m >= percent * (xn[:, None] + yn - m))
    fits &= 100 * np.minimum(xn[:, None], yn) >= percent * np.maximum(xn[:, None], yn)
    found = []
    for first in range(0, len(xi), 32):
        i, j = np.nonzero(fits[first : first + 32])
        i, matches, done = i + first, np.zeros(len(i), np.int64), 0
        for upto, least in bounds:
            matches = matches + (xs[i, done:upto] == ys[j, done:upto]).sum(1)
            keep = matches >= least
            i, j, matches, done = i[keep], j[keep], matches[keep], upto
        found.append((i, j))
    i, j = (np.concatenate(c) if found else np.zeros(0, np.int64) for c in zip(*found, strict=True))
    u = v = np.zeros(0, np.int64)
    if len(i):
        some_x, at_x = np.unique(i, return_inverse=True)
        some_y, at_y = np.unique(j, return_inverse=True)
        of = lambda t, rows: [np.frombuffer(s, np.int64) for s in t.column("s").take(pa.array(rows)).to_pylist()]
        sets_x, sets_y = of(sides[0], some_x), of(sides[1], some_y)
        common = _common(sets_x, sets_y)[at_x, at_y]
        sizes = np.array(list(map(len, sets_x)))[at_x] + np.array(list(map(len, sets_y)))[at_y]
        linked = 100 * common >= percent * (sizes - common)
        nodes, root = roots(xi[i[linked]], yi[j[linked]])
        u, v = root[nodes != root], nodes[nodes != root]
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["a", "b"])


def _checked_classes(some: DataFrame, docs: DataFrame) -> None:
    """Compares the full sets of the different texts of each class; unequal ones are an error, as two
    128-bit hashes of different sets would have to be equal for it."""
    key = ["h1", "h2", "n_shingles"]
    each = some.groupBy(*key, "text_hash", "text_hash2").agg(F.min("doc_id").alias("doc_id"))
    whole = F.struct("doc_id", "text_hash", "text_hash2")
    first = each.groupBy(*key).agg(F.min(whole).alias("x"), F.count("*").alias("_texts")).filter("_texts > 1")
    pairs = materialise(each.join(first, key).select(whole.alias("y"), "x").filter("x != y"), "equal-sets")
    if not (n := pairs.count()):
        return
    named = pairs.select(F.explode(F.array("x", "y")).alias("k")).select("k.*").distinct()
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_hashes()).join(bounded(named, 2 * n), ["doc_id", "text_hash", "text_hash2"], "left_semi")
    known = materialise(known.groupBy("doc_id", "text_hash", "text_hash2").agg(F.first("text").alias("text")), "equal-texts")
    side = lambda c: known.select(whole.alias(c), F.col("text").alias(f"text_{c}"))
    joined = pairs.join(side("y"), "y").join(side("x"), "x").select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("text_x").alias("text_a"), F.col("text_y").alias("text_b"))
    same = _confirmed(joined, 100, SHINGLE).count()
    discard(pairs, known)
    if same != n:
        raise RuntimeError(f"{n - same} of {n} texts have another set than the class that their hashes tell")


def near_duplicates(docs: DataFrame, *, percent: int = 85, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and two hashes of the text for each row of docs
    (doc_id, text).

    Rows with equal shingle sets are one class, told by two hashes and the size; the different texts of a
    class are compared on their full sets. Classes that share
    a band of their signatures are candidates. Each bucket is led by its member with the most bucket
    mates over all bands, which the original of many copies is, and all are compared with it. Where
    that leaves several components among those that a leader leads, its outsiders are compared with
    the others that they are not joined to, unless their sizes and the shingles that no other
    candidate has show that the pair can't be a link. So every candidate pair of different components
    is compared or excluded by proof, and no pairs are made within a component. A pair is given up
    when the posterior chance that its similarity reaches the threshold falls under ``miss``; what
    stays is confirmed on the full sets. A pair at the threshold shares no band with probability
    (1 - 0.85**5)**25, which is 4e-7; other thresholds have the ``banding`` that keeps it under 1e-6.

    Texts without words (null and empty ones too) are linked with nothing. Rows that repeat a doc_id
    are compared each for itself. A row without doc_id has no component and is kept. An empty table
    gives no rows."""
    rows = materialise(signatures(docs), "signatures")
    some = rows.filter("n_shingles > 0 and doc_id is not null")
    # equal sets have equal signatures
    classes = materialise(some.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node"), F.min("sig").alias("sig")), "classes")
    _checked_classes(some, docs)
    reps = classes.select("node", "n_shingles", "sig")
    n_bands, n_rows = banding(percent)
    width = 4 * n_rows
    bands = reps.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width))))).alias("band"))
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    shared = materialise(bands.join(sizes, "band"), "buckets")
    degree = shared.groupBy("node").agg(F.sum("size").alias("degree"))
    leaders = shared.join(degree, "node").groupBy("band").agg((-F.max(F.struct("degree", (-F.col("node")).alias("n")))["n"]).alias("a"))
    first = shared.join(leaders, "band").filter("node != a").select("a", F.col("node").alias("b")).distinct()
    first = materialise(first, "led")
    links = _exact(_likely(first, reps, percent, miss), docs, percent)
    found = materialise(components(links), "components")
    second = _outsiders(first, found, reps, docs, percent, miss)
    if second is not None:
        if not second.isEmpty():
            found = materialise(components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(second)), "components")
    discard(shared, first, links)
    named = classes.join(found, "node", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "node").alias("_component"))
    out = rows.drop("sig").join(named, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("_component"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash", "text_hash2").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, *, percent: int = 85, miss: float = 1e-6) -> DataFrame:
    """docs without the rows that are not kept, and of rows with equal doc_id and text only one.

    Rows without doc_id all stay. All columns pass through."""
    names = docs.columns
    found = materialise(near_duplicates(docs, percent=percent, miss=miss).select("doc_id", "text_hash", "text_hash2", "kept"), "decisions")
    key = ["doc_id", "text_hash", "text_hash2"]
    prefix = fresh(docs, "_key")
    first, second = text_hashes()
    keyed = docs.withColumns({f"{prefix}0": F.col("doc_id").cast("long"), f"{prefix}1": first, f"{prefix}2": second})
    on = lambda other: [F.col(f"{prefix}{i}") == other[k] for i, k in enumerate(key)]
    gone = materialise(found.filter("not kept").select(*key).distinct(), "gone")
    gone = bounded(gone, gone.count())
    rest = keyed.join(gone, on(gone), "left_anti")
    twice = materialise(found.filter("kept and doc_id is not null").groupBy(*key).count().filter("count > 1").select(*key), "repeated")
    if n := twice.count():
        twice = bounded(twice, n)
        once = rest.join(twice, on(twice), "left_semi").dropDuplicates([f"{prefix}{i}" for i in range(3)])
        rest = rest.join(twice, on(twice), "left_anti").unionByName(once)
    return rest.select(*names)
