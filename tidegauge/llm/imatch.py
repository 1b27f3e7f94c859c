"""I-Match fingerprints with randomised lexicons, in DataFrame functions only (operator 8)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Terms in at least one of RAREST and at most one of COMMONEST documents are the lexicon's. As each
#: document adds its distinct terms to the document frequencies once, at most RAREST times the mean
#: number of distinct terms of a document can be that frequent, whatever the number of documents.
RAREST, COMMONEST = 2000, 8
#: A text with fewer terms of the band among the first three quarters of its terms is printed over all.
FEWEST = 8
#: A lexicon of up to so many terms is broadcast (some 60 MB); beyond, the join shuffles the terms.
BROADCAST_TERMS = 1_000_000
LEVELS, PER_LEVEL = 8, 5
#: Ranges of doc_id that texts are dealt into at most, which bounds what the driver holds of them; more
#: rows than that make the ranges longer, and their sorts spill.
MOST_BUCKETS = 1 << 16
ROWS_PER_BUCKET, SAMPLED_PER_BUCKET = 4096, 32


def terms(text: Column) -> Column:
    """The distinct lower-case terms of a text by first occurrence: runs between white space and ASCII
    punctuation, with an empty one where the text begins or ends with such. There is always one, so they
    are exploded by the outer generators: before the others Spark puts a filter that splits all again."""
    return F.array_distinct(F.split(F.lower(text), r"[\s\p{Punct}]+"))


def term_hash(term: Column) -> Column:
    """What stands for a term in lexicon and digests: its 64-bit hash; null for the empty term."""
    return F.when(term != "", F.xxhash64(term))


def lexicon(docs: DataFrame, total: int, rarest: int = RAREST, commonest: int = COMMONEST) -> DataFrame:
    """h: the (hashes of) terms of docs (text) in the band of inverse document frequency."""
    each = docs.select(F.explode_outer(terms(F.col("text"))).alias("term")).select(term_hash(F.col("term")).alias("h")).filter("h is not null")
    idf = -F.log(F.col("count") / F.lit(float(max(total, 1))))
    return each.groupBy("h").count().filter((idf <= math.log(rarest)) & (idf >= math.log(commonest))).select("h")


def draws_of(h: Column) -> list[Column]:
    """PER_LEVEL random numbers of a term, from which all its randomised lexicons are told."""
    return [F.xxhash64(h, F.lit(k)) for k in range(PER_LEVEL)]


def in_sub_lexicon(draws: list[Column], j: int) -> Column:
    """Whether a term is drawn for randomised lexicon j; one of level l has one in 2**(l + 1) of the terms,
    and the k-th of each level lies within that of the level before."""
    return draws[j % PER_LEVEL].bitwiseAND((2 << j // PER_LEVEL) - 1) == 0


def _numbers(values: list[int]) -> Column:
    """An array literal of longs that takes one call to make."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text) with key, h, bucket and ghost, dealt so that a window by bucket sees each
    row's successor: the buckets are ranges of (doc_id, hash of the text), and the first rows of each
    range come into the range before as ghosts (those of the first range into the last). And the
    number of rows.

    The bounds are quantiles of a sample by hash. The driver holds bounds and first rows of at most
    MOST_BUCKETS ranges, and SAMPLED_PER_BUCKET pairs of numbers for each while it makes them."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "h": F.xxhash64("text")})
    total = keyed.count()
    if not total:
        return keyed.withColumns({"bucket": F.lit(0), "ghost": F.lit(False)}), 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(MOST_BUCKETS, 1 << math.ceil(math.log2(max(2, 4 * parts, total / ROWS_PER_BUCKET))))
    stride = max(1, total // (SAMPLED_PER_BUCKET * n))
    some = sorted(keyed.filter(F.pmod(F.xxhash64("key", "h", F.lit(7)), F.lit(stride)) == 0).select("key", "h").distinct().collect())
    bounds = [tuple(some[len(some) * i // n]) for i in range(1, n)] if some else []
    bounds = sorted({b for b in bounds if b != tuple(some[0])})
    bucket = F.lit(0)
    if bounds:  # binary search: how many bounds are not over the row
        steps = (len(bounds) + 1).bit_length()
        padded = bounds + [((1 << 63) - 1, (1 << 63) - 1)] * ((1 << steps) - len(bounds))
        keys, hashes = (_numbers([b[c] for b in padded]) for c in (0, 1))
        under = lambda at: (F.element_at(keys, at) < F.col("key")) | ((F.element_at(keys, at) == F.col("key")) & (F.element_at(hashes, at) <= F.col("h")))
        bucket = F.aggregate(F.lit([1 << s for s in range(steps - 1, -1, -1)]), bucket, lambda at, step: F.when(under(at + step), at + step).otherwise(at))
    keyed = keyed.withColumn("own", bucket)
    firsts = {r.own: tuple(r.first) for r in keyed.groupBy("own").agg(F.min(F.struct("key", "h")).alias("first")).collect()}
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    all_of = range(order[-1] + 1)
    at = lambda values: F.element_at(_numbers(list(values)), F.col("own") + 1)
    is_first = (F.col("key") == at(firsts.get(b, (0, 0))[0] for b in all_of)) & (F.col("h") == at(firsts.get(b, (0, 0))[1] for b in all_of))
    copy = lambda bucket, ghost: F.struct(bucket.cast("int").alias("bucket"), F.lit(ghost).alias("ghost"))
    copies = F.when(is_first, F.array(copy(F.col("own"), False), copy(at(before.get(b, 0) for b in all_of), True))).otherwise(F.array(copy(F.col("own"), False)))
    return keyed.select("doc_id", "text", "key", "h", F.explode(copies).alias("c")).select("doc_id", "text", "key", "h", "c.bucket", "c.ghost"), total


def likeness(a: Column, b: Column) -> Column:
    """Of the levels the best share of equal digests among the sub-lexicons that either text has
    terms in (counted as three at least); texts with all digests equal are alike."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == "") & (y == ""), 0).when(x == y, 1).otherwise(2))  # neither, equal, different

    def share(level: Column) -> Column:
        own = F.slice(pairs, level * PER_LEVEL + 1, PER_LEVEL)
        return F.size(F.filter(own, lambda k: k == 1)) / F.greatest(F.size(F.filter(own, lambda k: k > 0)), F.lit(3)).cast("double")

    return F.when(F.exists(pairs, lambda k: k == 2), F.array_max(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), share))).otherwise(1.0)


def _hex(h: Column) -> Column:
    return F.substring(F.lpad(F.hex(h), 16, "0"), 9, 8)


def fingerprints(docs: DataFrame, *, rarest: int = RAREST, commonest: int = COMMONEST) -> DataFrame:
    """For each row of docs (doc_id, text): fingerprints of the text and of its edited text, and how
    like they are to each other and to the next document's.

    A text's terms are those in the band of inverse document frequency, or all of them where fewer
    than FEWEST of the band are among the first three quarters of its terms. A fingerprint is a digest
    for each randomised lexicon: a hash of the distinct terms that it has of the text, empty without
    any. I-Match sorts the terms so that their hash does not depend on their order; here it is the
    exclusive or of the terms' hashes, which has no order, so that one pass of sums makes all digests. A text without any digest has the hash of the whole text (none if it is empty) as
    those of the first level. Fingerprints depend on text and lexicon alone.

    The edited text has its last quarter (floor of n_chars / 4 code points) replaced by the start of
    the next document's text, by ascending doc_id, after the last the first. Texts are shuffled once,
    by ranges of doc_id; terms are joined to the lexicon and gathered in that partitioning. Null
    texts count as empty; rows that share a doc_id follow each other by the hash of their text; a null
    doc_id comes first; a single row follows itself. An empty table gives no rows."""
    placed, total = _placed(docs)
    known = materialise(lexicon(docs.select("text").fillna("", ["text"]), total, rarest, commonest), "lexicon").withColumn("band", F.lit(True))
    if known.count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    window = Window.partitionBy("bucket").orderBy("ghost", "key", "h", "text")
    rows = placed.withColumns({"place": F.row_number().over(window), "next": F.lead("text").over(window)})
    n = F.char_length("text")
    cut = F.floor(n / F.lit(4)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    rows = rows.select("bucket", "place", "ghost", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(F.col("ghost"), F.lit("")).otherwise(edited).alias("edited"))
    # in four numbers: Spark's hash aggregation, which is compiled, takes buffers of fixed size alone
    rows = rows.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
    rows = rows.withColumns({f"sha{k}": F.conv(F.substring("sha", 16 * k + 1, 16), 16, -10).cast("long") for k in range(4)}).drop("sha")
    once = ("ghost", "doc_id", "n_chars", "sha0", "sha1", "sha2", "sha3", "whole")
    each = rows.select("bucket", "place", *once[:-1], F.posexplode(F.array("text", "edited")).alias("which", "body"))
    each = each.select("bucket", "place", "which", *once[:-1], F.when(F.col("body") != "", F.xxhash64("body")).alias("whole"), terms(F.col("body")).alias("terms"))
    each = each.withColumn("size", F.size("terms")).select("*", F.posexplode_outer("terms").alias("at", "term")).drop("terms")
    # what is a text's own goes with one of its rows alone: all are sorted
    each = each.select("bucket", "place", "which", term_hash(F.col("term")).alias("h"), (F.col("at") < F.col("size") - F.floor(F.col("size") / F.lit(4))).alias("early"), *(F.when(F.col("at") == 0, F.col(c)).alias(c) for c in once))
    each = each.join(known, "h", "left")
    each = each.withColumns({f"g{k}": g for k, g in enumerate(draws_of(F.col("h")))}).withColumn("band", F.coalesce("band", F.lit(False)))
    has = lambda j: in_sub_lexicon([F.col(f"g{k}") for k in range(PER_LEVEL)], j)
    of_band = [F.bit_xor(F.when(has(j) & F.col("band"), F.col("h"))).alias(f"b{j}") for j in range(LEVELS * PER_LEVEL)]
    of_all = [F.bit_xor(F.when(has(j), F.col("h"))).alias(f"a{j}") for j in range(LEVELS * PER_LEVEL)]
    early = F.count_if(F.col("early") & F.col("band")).alias("early")
    grouped = each.groupBy("bucket", "place", "which").agg(early, *of_band, *of_all, *(F.max(c).alias(c) for c in once))
    poor = F.col("early") < FEWEST
    digests = [F.coalesce(_hex(F.when(poor, F.col(f"a{j}")).otherwise(F.col(f"b{j}"))), F.lit("")) for j in range(LEVELS * PER_LEVEL)]
    printed = grouped.select("bucket", "place", "which", *once, F.array(*digests).alias("d"))
    bare = F.col("whole").isNotNull() & (F.array_max("d") == "")
    print_of = F.when(bare, F.concat(F.array_repeat(_hex(F.col("whole")), PER_LEVEL), F.slice("d", PER_LEVEL + 1, (LEVELS - 1) * PER_LEVEL))).otherwise(F.col("d"))
    printed = printed.select("bucket", "place", "which", *once[:-1], print_of.alias("a"))
    order = Window.partitionBy("bucket").orderBy("place", "which")  # a text, its edited text, the next text
    after = printed.withColumns({"b": F.lead("a", 1).over(order), "c": F.lead("a", 2).over(order)}).filter("which = 0 and not ghost")
    sha = F.lower(F.concat(*(F.lpad(F.hex(f"sha{k}"), 16, "0") for k in range(4))))
    return after.select(
        "doc_id", "n_chars", sha.alias("edited_sha256"),
        F.array_join("a", ".").alias("fingerprint"), F.array_join("b", ".").alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
