"""URL filters: host and path rules, then association rules mined from labels (operator 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Labelled URLs that rules are mined from at most: those whose ids hash lowest. A rule has its tokens in
#: LEAST_PAGES blocked ones at least, so what few pages share by chance is no rule, and the frequent sets
#: are no more than the subsets of the sampled URLs' tokens over that.
SAMPLE_ROWS = 50_000
LEAST_PAGES = 20
_BLOCK = "=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The fixed rules of the registered query: (verdict, host and path).
FIXED = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and path; both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def fixed_rule(host: Column, path: Column, rules=FIXED) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule = verdict = None
    for decision, text in sorted(rules, key=lambda r: -len(r[1])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    return rule, verdict


_PARTS = re.compile(r"[^\W\d_]{2,}(?:-[^\W\d_]+)*")


def url_tokens(url: str | None) -> set[str]:
    """Tokens of scheme, host (with place), path and query names; numbers say nothing in common."""
    scheme, found, rest = (url or "").lower().partition("://")
    if not found:
        return set()
    host, path, query = re.match(r"([^/?#]*)([^?#]*)(.*)", rest, re.S).groups()
    labels = host.split(".")
    out = {f"s:{scheme}", *(f"h:{x}" for x in labels if x), f"t:{labels[-1]}"}
    out |= {f"p:{x}" for x in _PARTS.findall(path)} | {f"q:{x}" for x in _PARTS.findall(query)}
    return {t for t in out if not t.startswith("=")}


@dataclass
class Rules:
    """Token sets with confidence, indexed under the rarest token of each."""

    sets: list[frozenset]
    confidence: list[float]
    index: dict[str, list[int]]

    def score(self, url: str | None) -> float:
        """The confidence of the surest rule whose tokens the URL all has; 0 without one."""
        own, best = url_tokens(url), 0.0
        for token in own:
            for r in self.index.get(token, ()):
                if self.confidence[r] > best and self.sets[r] <= own:
                    best = self.confidence[r]
        return best


def mine(labelled: DataFrame, *, support: float = 0.0008, confidence: float = 0.6, least_pages: int = LEAST_PAGES, rows: int = SAMPLE_ROWS) -> Rules:
    """Rules "these tokens: blocked" from labelled URLs (page_id, url, blocked boolean).

    Spark's FP-growth mines the frequent token sets of the blocked URLs; their confidence is counted
    against all sampled URLs. A rule stays if its support (as a share of the sample, and in pages) and
    confidence reach the bounds and no rule with fewer of its tokens is as sure. Null labels are left
    out; without enough blocked URLs there are no rules."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    sample = labelled.filter("blocked is not null").select("page_id", "url", "blocked").orderBy(F.xxhash64("page_id"), "page_id", "url").limit(rows).collect()
    tokens = [(url_tokens(r.url), bool(r.blocked)) for r in sample]
    # tokens that occur in the same sampled URLs tell the same and are one item, named by the first of
    # them; else a few copies of one long URL would have all subsets of its tokens as frequent sets
    places: dict[str, list[int]] = {}
    for i, (t, _) in enumerate(tokens):
        for x in t:
            places.setdefault(x, []).append(i)
    first: dict[tuple, str] = {}
    for x in sorted(places):
        first.setdefault(tuple(places[x]), x)
    tokens = [({x for x in t if first[tuple(places[x])] == x}, b) for t, b in tokens]
    blocked = [sorted(t) for t, b in tokens if b and t]
    if not blocked:
        return Rules([], [], {})
    items = spark.createDataFrame([(t,) for t in blocked], "items array<string>")
    least = max(least_pages, support * len(tokens)) / len(blocked)
    if least > 1:
        return Rules([], [], {})
    frequent = FPGrowth(itemsCol="items", minSupport=least, minConfidence=1.0).fit(items).freqItemsets
    sets = [(frozenset(r["items"]), r["freq"]) for r in frequent.collect()]
    counts: dict[str, int] = {}
    for t, _ in tokens:
        for x in t:
            counts[x] = counts.get(x, 0) + 1
    anchored: dict[str, list[int]] = {}
    for i, (s, _) in enumerate(sets):
        anchored.setdefault(min(s, key=lambda x: (counts[x], x)), []).append(i)
    clean = [0] * len(sets)
    for t, b in tokens:
        if not b:
            for x in t:
                for i in anchored.get(x, ()):
                    clean[i] += sets[i][0] <= t
    known: dict[frozenset, float] = {}
    for (s, n), c in sorted(zip(sets, clean, strict=True), key=lambda x: (len(x[0][0]), sorted(x[0][0]))):
        sure = (n + 0.0) / (n + c)
        if sure >= confidence and not any(known.get(s - {x}, 0.0) >= sure for x in s):
            known[s] = sure
        elif len(s) > 1:  # what a smaller set knows holds for larger ones too
            known.setdefault(s, max((known.get(s - {x}, 0.0) for x in s), default=0.0))
    rules = []
    for s, n in sets:
        smaller = max((known.get(s - {x}, 0.0) for x in s), default=0.0) if len(s) > 1 else 0.0
        if known.get(s, 0.0) >= confidence and known[s] > smaller:
            rules.append((known[s], n, s))
    rules = sorted(rules, key=lambda r: (-r[0], -r[1], sorted(r[2])))
    index: dict[str, list[int]] = {}
    for i, (_, _, s) in enumerate(rules):
        index.setdefault(min(s, key=lambda x: (counts[x], x)), []).append(i)
    return Rules([r[2] for r in rules], [r[0] for r in rules], index)


def judge(pages: DataFrame, rules: Rules, fixed=FIXED) -> DataFrame:
    """page_id, host, path, rule, verdict and score of each row of pages (page_id, url).

    The longest fixed rule that fits decides; else a URL is blocked if a mined rule matches it. Null
    and empty URLs and those without ``://`` have no tokens and are allowed. Repeated rows are judged
    each for itself; an empty table gives no rows. There is no join and no shuffle."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [rules.score(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    host, path = host_and_path(F.col("url"))
    parted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, url string, score double").select("page_id", host.alias("host"), path.alias("path"), "score")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    return parted.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
