"""Registered queries of the training-data operators: thin calls and digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warmgrid.llm import chosenpath, decontaminate, divergence, editprint, langid, linededup, mixing, periodic, prefixjoin, quality, recurrent, tokencount, warc
from warmgrid.llm.common import WORD, id_remainder, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 4) == 2
    net = langid.fit(docs.where(~held_out))
    scored = langid.predict(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


@query
def op9_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op6_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(quality.document_statistics(table(spark, sf_dir, "documents")), "quality-stats")
    held_out = id_remainder("doc_id", 5) == 0
    trees = quality.fit(stats, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score(stats, trees)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc_archive"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"),
        F.transform("hits", lambda h: h["item_id"]).alias("item_ids"), F.array_min(F.transform("hits", lambda h: h["distance"])).alias("least_distance"))


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_counts(table(spark, sf_dir, "documents"))


@query
def op1_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder("doc_id", 7) == 2
    return recurrent.score_documents(table(spark, sf_dir, "documents"), ~held_out, {"held_out": held_out})


def stretched(docs: DataFrame) -> DataFrame:
    """doc_id and text; where h = crc32(doc_id as text) ends in 0, the words from a = g % n on repeat with period p (g = h / 10)."""
    g = F.expr("crc32(CAST(coalesce(CAST(doc_id AS string), '') AS binary)) div 10")
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    named = docs.select("doc_id", "text", F.when(id_remainder("doc_id", 10) == 0, words).alias("w"), g.alias("g"))
    sized = named.withColumns({"n": F.size("w"), "a": F.expr("CAST(g % size(w) AS int)")})
    p = F.expr("1 + CAST((n - a) div (3 + g % 8) AS int)")
    again = F.expr("array_join(transform(sequence(0, n - 1), i -> element_at(w, 1 + IF(i < a, i, a + (i - a) % p))), ' ')")
    return sized.withColumn("p", p).select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(stretched(table(spark, sf_dir, "documents")))
    best = found.withColumn("best", periodic.strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixjoin.jaccard_join(table(spark, sf_dir, "documents"))


ORACLES["op12_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS items FROM d
), e AS MATERIALIZED (
  SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s
), links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.item = y.item AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.items)
"""


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), t AS (
  SELECT row_id, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3
), v AS (
  SELECT lang, count(*) AS kinds, sum(n) AS total FROM kept GROUP BY lang
), own AS (
  SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n
  FROM g JOIN kept k ON g.lang = k.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), priced AS (
  SELECT o.lang, o.source, o.term, o.n, 1 + (1000000000::HUGEINT * (o.n + 1)) // (sum(o.n) OVER (PARTITION BY o.lang, o.source) + v.kinds)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (o.lang_n + 1)) // (v.total + v.kinds)::HUGEINT AS q
  FROM own o JOIN v ON v.lang = o.lang
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM priced WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
