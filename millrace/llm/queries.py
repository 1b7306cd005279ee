"""The queries of the training-data operators, with production parameters, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, lang_id, license_scan, line_crf, line_dedup, pieces, quality_rules, token_output, url_filter
from .common import crc_bucket, read

#: Fixed values of op1's contract.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, else trees fitted on at most 20,000 distinct URLs, labelled by what their pages hold."""
    pages = read(spark, sf_dir, "pages")
    model = url_filter.fit_urls(url_filter.label_pages(pages, bound=20_000), bound=20_000)
    return url_filter.judge_urls(pages.select("page_id", "url"), model, URL_RULES, keep=["page_id"]).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring runs of lines with 50 words or more; ``text`` is what stays."""
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50).select("doc_id", "n_lines", "n_removed", "text")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    files = token_output.write_tokens(docs, token_output.token_folder(spark), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_output.read_tokens(files, with_ids=False)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    cutoffs = quality_rules.fit_cutoffs(docs, read(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, cutoffs, keep=["doc_id"]).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs, keep=["doc_id"]).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are learned only from rows outside the held-out fifth."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_crf.fit_crf(docs, read(spark, sf_dir, "labels").where(crc_bucket(F.col("doc_id"), 5) != 0), bound=4_000)
    scored = line_crf.score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and language are learned only from rows outside the held-out quarter."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.fit_languages(docs.where(crc_bucket(F.col("doc_id"), 4) != 2), per_language=500)
    found = lang_id.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of five-word shingles; links from a similarity of 75 percent."""
    return jaccard_join.join_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), k=5, percent=75).select("doc_id", "n_shingles", "component_id")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding, round trip and two sampled segmentations of every whole text, as digests of the ids."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2, keep=["doc_id"], packed=True)
    digest = lambda x: F.struct((F.length(x["ids"]) / 2).cast("long").alias("n_ids"), F.crc32(x["ids"]).alias("ids_crc32"), x["log_prob"].alias("log_prob"), x["inclusion"].alias("inclusion"))
    return out.select("doc_id", (F.length("ids") / 2).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "decoded", F.transform("samples", digest).alias("samples"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_line_dedup, op3_token_output, op4_quality_rules, op5_decontamination, op6_license_scan, op7_quality_classifier, op8_language_id, op9_jaccard_join, op10_pieces)}

#: DuckDB SQL for those that SQL can express.
_WORDS = r"[^\x20\x09-\x0D]+"
SQL: dict[str, str] = {
    "op2_line_dedup": rf"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
y AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '{_WORDS}')) AS w FROM x WHERE regexp_matches(line, '{_WORDS}')),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM y),
runs AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM z a JOIN z b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= 50 GROUP BY a.doc_id, a.i
  UNION SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM z a JOIN z b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.w >= 50 GROUP BY b.doc_id, b.i),
texts AS (SELECT r.doc_id, s, e, string_agg(line, chr(10) ORDER BY z.i) AS t FROM runs r JOIN z ON z.doc_id = r.doc_id AND z.i BETWEEN s AND e GROUP BY r.doc_id, s, e),
later AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS r FROM texts) WHERE r > 1),
gone AS (SELECT doc_id, list(pos) AS ps FROM (SELECT DISTINCT z.doc_id, z.pos FROM later JOIN z ON z.doc_id = later.doc_id AND z.i BETWEEN s AND e) GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ps), 0)::BIGINT AS n_removed,
  CASE WHEN ps IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ls[i]), chr(10)) END AS text
FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id""",
    "op9_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}'), []) AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS t FROM w),
n AS (SELECT w.doc_id, count(t) AS n FROM w LEFT JOIN g ON w.doc_id = g.doc_id GROUP BY w.doc_id),
links AS (SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id) p
  JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * p.c >= 75 * (a.n + b.n - p.c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, links.y FROM r JOIN links ON links.x = r.c)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m ON n.doc_id = m.doc_id""",
}
