"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


#: A document is kept if its quality score is at least this.
QUALITY_CUT = 0.7


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .matroska import read_back, to_media

    return read_back(to_media(table(spark, sf_dir, "documents")))


#: A document is toxic if its toxicity score is at least this.
TOXIC_CUT = 0.5


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document with its number: quality 0 is a URL to block."""
    from .url_rules import judge, mine

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").filter("quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("blocked"))
    return judge(pages, mine(pages.join(labels, "page_id"))).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_CUT).cast("int").alias("predicted"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import fingerprints

    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains are languages. Those of the rows in ``labels`` are taken as known, those of all rows
    as uncertain: the classifier's posteriors, never the lang column, make a document's rate."""
    from .mixing import fit, learn, measured, rates

    docs = table(spark, sf_dir, "documents")
    mix = learn(docs, "lang", table(spark, sf_dir, "labels"))
    known = measured(docs, "lang", mix)
    mix = fit(known, mix)
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    domain = F.element_at(F.array(*map(F.lit, mix.domains)), best)
    return rates(known, mix).select("doc_id", F.col("t").cast("long").alias("tokens"), domain.alias("domain"), F.array_max("posterior").alias("posterior"), "rate", "copies")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    return archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_packing": op1_packing, "op2_quality": op2_quality, "op3_chat": op3_chat, "op4_near_dedup": op4_near_dedup, "op5_matroska": op5_matroska, "op6_url_rules": op6_url_rules, "op7_toxicity": op7_toxicity, "op8_imatch": op8_imatch, "op9_mixing": op9_mixing, "op10_warc": op10_warc}

#: SQL can express neither tokenizers nor fitted models, containers, hashes of the JVM nor iterations.
ORACLE_SQL: dict[str, str] = {
    "op4_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, len(w) AS k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
f AS (SELECT doc_id, k, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT DISTINCT doc_id, g FROM f WHERE k >= 5 AND i <= k - 4 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT l.b, r.r FROM r JOIN l ON l.a = r.v)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM r JOIN documents ON doc_id = v LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op10_warc": r"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, list_transform(generate_series(0, 39), lambda i: instr('0123456789abcdef', h[i + 1:i + 1]) - 1) AS d FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM b)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((d[5 * (i // 4) + 1] * 65536 + d[5 * (i // 4) + 2] * 4096 + d[5 * (i // 4) + 3] * 256 + d[5 * (i // 4) + 4] * 16 + d[5 * (i // 4) + 5]) // CAST(pow(2, 15 - 5 * (i % 4)) AS BIGINT)) % 32), 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
}
