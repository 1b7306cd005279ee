import duckdb
import pytest

import __spark_entry__ as entry
from millrace.llm.queries import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, sf).select(*want.columns)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LETTERS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(AZ.format("coalesce(text, '')"))
#: For operators with learned columns: SQL for the columns that their contracts fix.
FIXED = {
    "op1_url_filter": f"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, {AZ.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM p),
r(verdict, rule, rhost, rpath) AS (SELECT a, b, split_part(b, '/', 1), substr(b, strpos(b, '/')) FROM (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')) v(a, b)),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled FROM q JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT q.page_id, host, path, rule, ruled FROM q LEFT JOIN m ON q.page_id = m.page_id""",
    "op4_quality_rules": rf"""
WITH w AS (SELECT doc_id, text, {WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
h AS (SELECT doc_id, count(DISTINCT i + d.range) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS c FROM g), range(3) d WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(h.n, 0) AS n_repeat_words
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN h ON w.doc_id = h.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c""",
    "op6_license_scan": f"""
WITH w AS (SELECT doc_id, {LETTERS} AS ws FROM documents),
p(phrase, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
x AS (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) JOIN p ON ws[i:i + len(phrase) - 1] = phrase)
SELECT w.doc_id, len(ws) AS n_words, count(label) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM w LEFT JOIN x ON w.doc_id = x.doc_id GROUP BY w.doc_id, ws""",
}


@pytest.mark.parametrize("name", sorted(FIXED))
def test_fixed_columns(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(FIXED[name])
    df = entry.queries()[name](spark, sf)
    if name == "op1_url_filter":
        df = df.selectExpr("*", "if(rule is null, null, verdict) as ruled")
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_held_out_rows(spark, sf):
    """crc32 of the id as text, by another library."""
    import zlib

    for name, n, r in (("op7_quality_classifier", 5, 0), ("op8_language_id", 4, 2)):
        assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % n == r) for x in entry.queries()[name](spark, sf).collect())
