"""Mixing to target weights by soft domain membership, in DataFrame functions only (operator 9)."""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Labelled rows that the classifier is fitted on at most (those whose ids hash lowest).
SAMPLE_ROWS = 20_000
#: Domains that a model tells apart; of more, the rarest labelled ones are counted together as OTHERS.
#: Their number is the size of all that the driver gathers.
MOST_DOMAINS = 64
OTHERS = "(others)"
#: Words are told by their first START letters, hashed modulo BUCKETS: whole words are too rare to be
#: learnt one by one (starts tell 99.9 % of the languages over sf0.1, words 97.0 %, ends 97.2 %). A text
#: speaks for its domain by its mean word, and for as many words as it has, but no more than SURE.
START, BUCKETS, SURE = 3, 4096, 40
#: Steps after which the rates of all documents are written down, so that a pass folds no more than these.
WRITE_EVERY = 8
_LEAST_MASS = 1e-9  # share of the tokens under which a domain counts as absent


def tokens(text: Column) -> Column:
    """White-space-separated pieces of a text, counted by its blanks and line ends."""
    text = F.coalesce(text, F.lit(""))
    return (1 + F.octet_length(text) - F.octet_length(F.translate(text, " \n", ""))).cast("double")


def words(text: Column) -> Column:
    """The starts of the lower-case words of a text between blanks, tabs and line ends, as bucket numbers."""
    pieces = F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\n\r\t", "   "), " ")
    return F.transform(pieces, lambda w: F.pmod(F.xxhash64(F.substring(w, 1, START)), F.lit(BUCKETS)).cast("int"))


@dataclass
class Mix:
    """What makes a document's rate: the classifier (log priors, and log probabilities of the buckets by
    domain), and the steps of the fit in order. ``residual`` is the largest difference between a
    domain's expected tokens and its target, as a share of all tokens."""

    domains: list[str]
    prior: list[float]
    table: list[list[float]]
    steps: list[list[float]] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)
    totals: list[float] = field(default_factory=list)
    residual: float = 0.0
    merged: list[str] = field(default_factory=list)


def _array(values: list) -> Column:
    return F.array(*(_array(v) if isinstance(v, list) else F.lit(float(v)) for v in values))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def posterior(text: Column, mix: Mix) -> Column:
    """Domain posteriors of a text under naive Bayes over its hashed word starts; the priors for an empty one."""
    by_bucket = [[mix.table[c][b] for c in range(len(mix.domains))] for b in range(BUCKETS)]
    table = F.from_json(F.lit(json.dumps(by_bucket)), "array<array<double>>")  # a constant of the plan
    start = F.array_repeat(F.lit(0.0), len(mix.domains))
    total = lambda found: F.aggregate(found, start, lambda at, w: F.zip_with(at, F.element_at(table, w + 1), lambda a, b: a + b))
    scores = lambda found: let(F.least(F.size(found), F.lit(SURE)) / F.greatest(F.size(found), F.lit(1)), lambda sure: F.zip_with(total(found), _array(mix.prior), lambda a, p: p + sure * a))
    weights = lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda a: F.exp(a - top)))
    shares = lambda w: let(F.aggregate(w, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(w, lambda a: a / total))
    return let(words(text), lambda found: let(scores(found), lambda s: let(weights(s), shares)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)


def rate(p: Column, steps: list[list[float]], start: Column | None = None) -> Column:
    """A document's rate after the steps of projected gradient descent, from ``start`` (1) on."""
    start = F.lit(1.0) if start is None else start
    if not steps:
        return start
    return F.aggregate(_array(steps), start, lambda r, g: F.greatest(F.lit(0.0), r - _dot(p, g)))


def learn(docs: DataFrame, domain: str, labels: DataFrame, rows: int = SAMPLE_ROWS, most_domains: int = MOST_DOMAINS) -> Mix:
    """The classifier, from docs (doc_id, text and the named domain column) whose ids are in labels, of
    which at most ``rows`` are used. Null ids and domains are left out; without labels there is one
    domain. Of more domains than ``most_domains`` the rarest labelled ones (ties by name) are one."""
    ids = labels.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain).cast("string").alias("domain"), "text").filter("domain is not null").join(F.broadcast(ids), "doc_id", "left_semi")
    known = materialise(known.select("domain", words(F.col("text")).alias("w")), "mixing-sample")
    sizes = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    if not sizes:
        return Mix(["all"], [0.0], [[0.0] * BUCKETS])
    order = sorted(sizes, key=lambda d: (-sizes[d], d))
    merged = sorted(order[most_domains - 1 :]) if len(order) > most_domains else []
    domains = sorted(set(order) - set(merged)) + ([OTHERS] if merged else [])
    at = {d: i for i, d in enumerate(domains)} | dict.fromkeys(merged, len(domains) - 1)
    number = known.join(F.broadcast(known.sparkSession.createDataFrame(list(at.items()), "domain string, c int")), "domain")
    counts = [[0.0] * BUCKETS for _ in domains]
    for r in number.select("c", F.explode("w").alias("b")).groupBy("c", "b").count().collect():
        counts[r.c][r.b] = float(r["count"])
    discard(known)
    prior = [0.0] * len(domains)
    for d, n in sizes.items():
        prior[at[d]] += n
    table = [[math.log((x + 0.5) / (sum(c) + 0.5 * BUCKETS)) for x in c] for c in counts]
    return Mix(domains, [math.log(n / sum(prior)) for n in prior], table, merged=merged)


def measured(docs: DataFrame, domain: str, mix: Mix) -> DataFrame:
    """doc_id, domain, tokens t and posteriors p of docs (doc_id, text and the named domain column), as
    a written table: the texts are read once for all that ``fit`` does."""
    text = F.col("text")
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain).cast("string").alias("domain"), tokens(text).alias("t"), posterior(text, mix).alias("p")), "measured")


def fit(table: DataFrame, mix: Mix, weights: dict[str, float] | None = None, *, temperature: float = 0.8, total_tokens: float | None = None, iterations: int = 60, tolerance: float = 1e-9, warn_over: float = 0.01) -> Mix:
    """Fits nonnegative document rates so that the expected tokens of each domain match the targets.

    table comes from ``measured`` with the same mix, which is changed and returned. The objective is
    half the sum over the domains of the squared difference between expected and target tokens; each
    step moves a document against the gradient, scaled by its domains' token mass, and projects its
    rate to zero or more. A document's rate is the fold of all steps over its posterior; every few
    steps the rates are written down, so a pass of sums over the table folds only the latest.

    Targets default to the present shares raised to ``temperature`` and normalised, and to the
    present total. A target of a domain without any mass is spread over the others, the weights of
    merged domains are one. What the last step leaves is the mix's ``residual``; over ``warn_over`` there
    is a warning, as where nonnegative rates cannot meet the targets or the iterations do not suffice."""
    k = len(mix.domains)
    mix.steps, p = [], [F.col("p")[i] for i in range(k)]
    first = table.agg(*(F.sum(F.col("t") * c).alias(f"s{i}") for i, c in enumerate(p)), *(F.sum(F.col("t") * p[i] * p[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k))).first()
    now = [first[f"s{i}"] or 0.0 for i in range(k)]
    whole = sum(now)
    if not whole or k == 1:
        mix.targets, mix.totals = list(now), list(now)
        return mix
    given = dict(weights or {})
    if mix.merged:
        given[OTHERS] = given.get(OTHERS, 0.0) + sum(given.pop(d, 0.0) for d in mix.merged)
    present = [s > _LEAST_MASS * whole for s in now]
    wanted = [(given.get(d, 0.0) if weights is not None else (s / whole) ** temperature) * here for d, s, here in zip(mix.domains, now, present, strict=True)]
    if not sum(wanted):
        raise ValueError("no target weight belongs to a domain that has tokens")
    mix.targets = [w / sum(wanted) * (total_tokens or whole) for w in wanted]
    h = [[first[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]
    scale = [max(h[i][i], 1e-12 * whole) for i in range(k)]
    length = 1.0 / max(sum(h[i][j] / scale[j] for j in range(k)) for i in range(k) if present[i])
    held, new = table.select("t", "p", F.lit(1.0).alias("r")), []
    kept = None
    for _ in range(iterations):
        gap = [(a - b) if here else 0.0 for a, b, here in zip(now, mix.targets, present, strict=True)]
        if max(abs(g) for g in gap) <= tolerance * whole:
            break
        new.append([length * g / s for g, s in zip(gap, scale, strict=True)])
        mix.steps.append(new[-1])
        after = held.select("t", "p", rate(F.col("p"), new, F.col("r")).alias("r"))
        if len(new) == WRITE_EVERY:
            held, new, old = materialise(after, "rates"), [], kept
            after = kept = held
            if old is not None:
                discard(old)
        now = list(after.agg(*(F.sum(F.col("t") * F.col("r") * F.col("p")[i]).alias(f"s{i}") for i in range(k))).first())
    if kept is not None:
        discard(kept)
    mix.totals = now
    mix.residual = max(abs(a - b) for a, b, here in zip(now, mix.targets, present, strict=True) if here) / whole
    if mix.residual > warn_over:
        warnings.warn(f"the domains' expected tokens miss their targets by up to {mix.residual:.1%} of all tokens", stacklevel=2)
    return mix


def _outcome(p: Column, key: Column, mix: Mix, seed: int) -> Column:
    """Posterior, rate and copies of a posterior array, as one struct."""
    chance = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))
    copies = lambda r: (F.floor(r) + (chance < r - F.floor(r)).cast("int")).cast("int")
    return let(p, lambda p: let(rate(p, mix.steps), lambda r: F.struct(p.alias("posterior"), r.alias("rate"), copies(r).alias("copies"))))


def rates(table: DataFrame, mix: Mix, seed: int = 17) -> DataFrame:
    """table (doc_id, t, p and any others) with posterior, rate and copies in place of p.

    A rate of 2.3 is two copies, and a third for the three in ten ids that a hash picks. Rows with
    equal posteriors have equal rates, and repeated rows equal copies. An empty table gives no rows."""
    names = [c for c in table.columns if c != "p"]
    return table.select(*names, _outcome(F.col("p"), F.col("doc_id"), mix, seed).alias("_o")).select(*names, "_o.*")


def mixed(docs: DataFrame, mix: Mix, seed: int = 17) -> DataFrame:
    """The documents as the mixture has them: each row as often as its copies say, same columns.

    Null texts count as empty."""
    copies = _outcome(posterior(F.col("text"), mix), F.col("doc_id").cast("long"), mix, seed)["copies"]
    each = let(copies, lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))
    return docs.select(F.struct(*docs.columns).alias("row"), F.explode(each)).select("row.*")
