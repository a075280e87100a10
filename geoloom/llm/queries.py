"""One query for each operator, over the whole table, with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm import (byte_bpe, divergence, exact_dedup, license_scan, line_dedup, mixing, periodic_runs, quality_gam, quality_rules,
                         repair, simhash, substring_dedup, url_filter)
from geoloom.llm.common import place, table
from geoloom.session import settle


def tokenizer_file(name: str) -> bytes:
    """The content of a public vocabulary file, read on the driver and sent with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, folder, "documents")).withColumnRenamed("key", "doc_id")


def op2_token_file(spark: SparkSession, folder: str) -> DataFrame:
    path = place(spark)
    docs = table(spark, folder, "documents")
    repair.write_tokens(docs, path, tokenizer_file("word_bpe_49k.json"))
    return repair.read_tokens(spark, path).select(F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                                                  F.crc32("ids").alias("ids_crc32"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = settle(quality_rules.ledger(table(spark, folder, "documents")))  # the ledger is stored; policies read its bits
    both = quality_rules.judged(quality_rules.judged(rows, "base", "base_kept"))
    return both.withColumn("base_failed", ~F.col("base_kept")).drop("base_kept").withColumnRenamed("key", "doc_id")


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.remove_later_runs(table(spark, folder, "documents")).select(
        F.col("key").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents")).select(
        F.col("key").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents")).withColumnRenamed("key", "doc_id")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).withColumn("rate", F.round("rate", 9))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    return quality_gam.scored(table(spark, folder, "documents"), table(spark, folder, "labels")).withColumnRenamed("key", "doc_id")


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic_runs.with_planted_periods(table(spark, folder, "documents"))
    return periodic_runs.summary(periodic_runs.periodic_runs(docs, "key")).withColumnRenamed("key", "doc_id")


def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, folder, "pages")).withColumnRenamed("key", "page_id")


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_token_file, op3_quality_rules, op4_line_dedup, op5_substring_dedup, op6_exact_dedup,
                                   op7_mixing, op8_simhash, op9_quality_gam, op10_byte_bpe, op11_periodic_runs, op12_url_filter, op13_source_divergence)}

LINES_SQL = r"""
WITH l AS (SELECT doc_id, t[i] AS line, i FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents))),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, least(3, 1 + len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) // 10) AS size FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
u AS (SELECT doc_id, k, part, line || chr(10) || part AS unit FROM f, LATERAL (SELECT unnest(range(0, size)) AS part)
  UNION ALL SELECT doc_id, NULL, part, chr(10) || part FROM (SELECT doc_id, sum(size)::INT AS n FROM f GROUP BY doc_id HAVING sum(size) < 3), LATERAL (SELECT unnest(range(0, 3 - n)) AS part)),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k NULLS LAST, part) AS p FROM u),
r AS (SELECT doc_id, p, unit || chr(10) || lead(unit, 1) OVER w || chr(10) || lead(unit, 2) OVER w AS run FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS nth FROM r WHERE run IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, k FROM p JOIN (SELECT DISTINCT doc_id, p + s AS p FROM later, range(0, 3) t(s)) USING (doc_id, p) WHERE k IS NOT NULL),
j AS (SELECT l.doc_id, l.i, l.line, f.k IS NOT NULL AS full_line, gone.k IS NOT NULL AS gone FROM l LEFT JOIN f USING (doc_id, i) LEFT JOIN gone ON gone.doc_id = f.doc_id AND gone.k = f.k)
SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""

PASSAGES_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY sha256(run)) AS n FROM u) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + s AS i FROM again, range(0, 35) t(s)),
x AS (SELECT w.doc_id, w.i, w.word, gone.i IS NOT NULL AS gone FROM (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)) w LEFT JOIN gone USING (doc_id, i)),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM x GROUP BY doc_id)
SELECT doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

RUNS_SQL = r"""
WITH b AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])) AS bytes FROM documents),
h AS (SELECT row, doc_id, w, len(w) AS n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], bytes::BIGINT[]), lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) AS h FROM b),
a AS (SELECT *, (h // 10) % greatest(n, 1) AS a, 3 + (h // 10) % 8 AS d FROM h),
t AS (SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[1 + a + (i - a) % (1 + (n - a) // d)] END) ELSE w END AS w FROM a),
x AS (SELECT row, i, w[i + 1] AS word FROM (SELECT row, w, unnest(range(0, n)) AS i FROM t)),
s AS (SELECT row, i, md5(array_to_string(w[i + 1:i + 6], ' ')) AS six FROM (SELECT row, w, unnest(range(0, n - 5)) AS i FROM t)),
e AS (SELECT p.row, p.i, q.i - p.i AS period FROM s p JOIN s q ON p.row = q.row AND p.six = q.six AND q.i > p.i),
isle AS (SELECT row, period, min(i) AS start, max(i) - min(i) + 6 + period AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY row, period ORDER BY i) AS part FROM e) GROUP BY row, period, part),
r AS (SELECT row, start, length, min(period) AS period FROM isle WHERE length >= 12 AND length >= 2 * period GROUP BY row, start, length),
u AS (SELECT row, count(*) AS n_runs, arg_max({'s': start, 'l': length, 'p': period}, [length, -start, -period]) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM t LEFT JOIN u USING (row) LEFT JOIN k USING (row)
"""

COPIES_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256 FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

ORACLES = {"op3_quality_rules": quality_rules.RULES_SQL, "op4_line_dedup": LINES_SQL, "op5_substring_dedup": PASSAGES_SQL, "op6_exact_dedup": COPIES_SQL,
           "op7_mixing": mixing.MIX_SQL, "op11_periodic_runs": RUNS_SQL, "op12_url_filter": url_filter.URLS_SQL,
           "op13_source_divergence": divergence.AUDIT_SQL}
