"""Queries that apply each text operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import langid, pii, quality, toxicity, warc
from tideline.llm.alignment import align_tokenizers, paths
from tideline.llm.common import fold, in_sample, sample_share, table
from tideline.llm.decontamination import mark_leaks
from tideline.llm.jaccard_join import near_duplicates
from tideline.llm.line_dedup import deduplicate_lines
from tideline.llm.neighbours import nearest
from tideline.llm.packing import pack
from tideline.llm.rollups import maintain_counts
from tideline.llm.spelling import group_variants


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "dedup.n_lines", "dedup.n_dropped", "dedup.words_dropped", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning reads the labelled documents' statistics; scoring reads every document's."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    labelled = docs.where(in_sample("doc_id", sample_share(labels.count(), 20_000))).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    rules = quality.learn_rules(quality.with_statistics(labelled).select("doc_id", "stats"), labels)
    judged = quality.judge(quality.with_statistics(docs), rules)
    return judged.select("doc_id", "base.*", "base_failed", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.learn(docs))
    counts = [F.size(F.filter("base_spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base_spans"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def _of_kind(kind: str):
    def test(x):
        return x["kind"] == kind

    return test


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_records(warc.locate_records(archives), archives)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn_profiles(langid.learning_rows(docs))
    return langid.identify(docs.select("doc_id", "text"), profiles).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "language.lang_pred", "language.score")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain_counts(table(spark, sf_dir, "documents")).totals()


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50, against all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 50 = 0"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents").select("doc_id", "text"), *paths())


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_toxicity, op4_ngram_jaccard_join, op5_pii, op6_warc, op7_language_id, op8_best_fit_packing, op9_token_counts, op10_benchmark_decontamination, op11_spelling_variants, op12_nearest_neighbours, op13_tokenizer_alignment)}

# DuckDB SQL for the same rows. The other queries learn, search or tokenise, and are tested against brute force.
ORACLE: dict[str, str] = {
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
 e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
 r AS (SELECT a AS doc_id, a AS node FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.node = e.a),
 c AS (SELECT doc_id, min(node) AS least FROM r GROUP BY 1)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, t.doc_id) AS component_id FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages), k AS (SELECT h, max(page_id) AS top FROM p GROUP BY 1),
 d AS (SELECT page_id, h, list_transform(range(8), lambda g: ('0x' || substr(s, CAST(5 * g + 1 AS INTEGER), 5))::BIGINT) AS v FROM p)
SELECT page_id, strlen(h) AS payload_bytes, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> b) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d JOIN k USING (h)""",
}
