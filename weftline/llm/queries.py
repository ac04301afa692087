"""The ten operators as queries over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import capfilter, decontam, langmix, lattice, licences, linedup, simhash, siteprior, toxicpu, warcseg
from .session import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langmix.detect(docs, langmix.fit(docs))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return siteprior.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicpu.detect(docs, toxicpu.fit(docs, table(spark, sf_dir, "labels")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.runs(table(spark, sf_dir, "documents")).drop("th")


def op6_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.encode(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.groups(table(spark, sf_dir, "embeddings"))


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warcseg.reassemble(warcseg.records(warcseg.archive(table(spark, sf_dir, "pages"))))
    return found.select(
        F.expr("try_cast(split(origin_id, ':')[2] as bigint)").alias("page_id"),
        F.col("target_uri").alias("url"),
        F.col("payload_bytes"),
        F.col("segments").cast("long").alias("segments"),
        F.length("body").cast("long").alias("body_bytes"),
        F.md5("body").alias("body_md5"),
        "status",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_language_id": op2_language_id,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_sentencepiece_sampling": op6_sentencepiece_sampling,
    "op7_license_scan": op7_license_scan,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_warc_segments": op10_warc_segments,
}

_FRAMED = "72 + n + 7 * (n // 1000) + CASE WHEN n % 1000 = 0 THEN 5 WHEN n % 1000 < 16 THEN 10 WHEN n % 1000 < 256 THEN 11 ELSE 12 END"

ORACLES: dict[str, str] = {
    # windows of 50 words that begin or end at a line, by their content; the later ones are merged where they touch
    "op5_line_dedup": r"""
        WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text <> ''),
        l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS pos FROM t),
        n AS (SELECT *, len(regexp_extract_all(line, '[^ \t\n\v\f\r]+')) AS words, count(*) OVER (PARTITION BY line) AS times FROM l),
        c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM n),
        p AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM c WHERE times > 1),
        w AS (SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.seg = a.seg AND b.pos >= a.pos AND b.upto - a.upto + a.words >= 50 GROUP BY ALL
            UNION SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.seg = a.seg AND b.pos >= a.pos AND b.upto - a.upto + a.words >= 50 GROUP BY b.doc_id, b.pos),
        k AS (SELECT w.doc_id, s, e, md5(string_agg(line, chr(10) ORDER BY pos)) AS content FROM w JOIN p ON p.doc_id = w.doc_id AND pos BETWEEN s AND e GROUP BY w.doc_id, s, e),
        f AS (SELECT *, min(row(doc_id, s)) OVER (PARTITION BY content, e - s) AS first FROM k),
        g AS (SELECT *, row_number() OVER o AS rn, coalesce(s > max(e + 1) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM f WHERE row(doc_id, s) > first WINDOW o AS (PARTITION BY doc_id ORDER BY s, e)),
        r AS (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY doc_id ORDER BY rn) AS run FROM g)
        SELECT doc_id, CAST(min(s) AS INT) AS start_line, CAST(max(e) + 1 - min(s) AS INT) AS n_lines, struct_extract(min_by(first, rn), 1) AS first_doc_id, CAST(struct_extract(min_by(first, rn), 2) AS INT) AS first_line FROM r GROUP BY doc_id, run
    """,
    "op9_embedding_near_dedup": """
        WITH RECURSIVE near AS (SELECT a.vec_id AS a, b.vec_id AS b, a.embedding = b.embedding AS equal FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding, b.embedding) >= 0.95),
        reach AS (SELECT vec_id AS id, vec_id AS g FROM embeddings UNION SELECT near.b, reach.g FROM reach JOIN near ON near.a = reach.id)
        SELECT vec_id, min(g) AS "group", (SELECT count(*) FILTER (WHERE NOT equal) FROM near WHERE near.a = vec_id) AS links,
            (SELECT count(*) FILTER (WHERE equal) FROM near WHERE near.a = vec_id) AS copies, vec_id = min(g) AS kept
        FROM embeddings JOIN reach ON reach.id = vec_id GROUP BY vec_id
    """,
    # 72 bytes of head, 7 of framing for each full chunk of 1000, 5 for the end and 5 to 7 for a shorter last chunk
    "op10_warc_segments": f"""
        SELECT page_id, url, payload_bytes, (payload_bytes + 2047) // 2048 AS segments, n AS body_bytes, body_md5, 'ok' AS status
        FROM (SELECT page_id, url, n, body_md5, CAST({_FRAMED} AS BIGINT) AS payload_bytes
              FROM (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS n, md5(html) AS body_md5 FROM pages))
    """,
}
