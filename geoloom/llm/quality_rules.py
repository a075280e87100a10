"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit for each failed
rule. Policies are versioned masks of rules, so a new policy, or what each rule alone rejects, is read from the
bits without the texts. Everything is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from geoloom.functions.faces import steady
from geoloom.llm.common import free, named

SPACE = r"[\x20\x09-\x0D]"
# Rule names in bit order; a rule is never moved or reused, so old ledgers keep their meaning.
RULES = ("too_few_words", "repeated_words", "symbol_heavy", "odd_word_length", "repeated_lines", "shouting")
# Versioned policies: the rules that reject.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbol_heavy", "odd_word_length"),
    "v2": RULES,
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(1 << RULES.index(rule) for rule in POLICIES[policy])


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and the measurements of each text; each array is built once, behind a one-row generator."""
    t, n = F.col("t"), F.col("n_words")
    rows = docs.select(named(key).alias("key"), F.coalesce(named(text), F.lit("")).alias("t"))
    rows = steady(rows, "w", F.array_remove(F.split("t", SPACE + "+"), ""))
    rows = steady(rows, "lines", F.filter(F.split("t", "\n"), lambda line: F.length(F.regexp_replace(line, SPACE + "+", "")) > 0))
    rows = rows.select(
        "key", "w", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.length(t) - F.length(F.regexp_replace(t, "!+", ""))).cast("long").alias("n_shouts"))
    kept = ["key", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_shouts"]
    # A hash for each window of three words. Different hashes are different windows, so most texts end here.
    at = F.when(n >= 3, F.sequence(F.lit(0), (n - 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = steady(rows.select(*kept, "w"), "h", F.transform(at, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    rows = rows.select(*kept, "w", "h", (F.size(F.array_distinct("h")) < F.size("h")).alias("again"))
    # Only where a hash comes twice are windows sorted, by hash and then by their words.
    window = lambda x, i: F.struct(x.alias("h"), F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("s"), i.alias("i"))
    none = F.array().cast("array<struct<h:bigint,s:string,i:int>>")
    rows = steady(rows, "z", F.when(F.col("again"), F.sort_array(F.transform("h", window))).otherwise(none)).select(*kept, "z")
    same = lambda a, b: F.coalesce((a["h"] == b["h"]) & (a["s"] == b["s"]), F.lit(False))
    places = F.transform("z", lambda e, k: F.when(same(e, F.get("z", k - 1)) | same(e, F.get("z", k + 1)), e["i"]).otherwise(-1))
    rows = steady(rows, "p", F.sort_array(F.filter(places, lambda p: p >= 0))).select(*kept, "p")
    # A repeated window adds the words that the one before it does not hold.
    added = F.transform("p", lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get("p", k - 1))))
    return rows.select(*kept, F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def failures() -> dict[str, Column]:
    """When each rule fails, in whole numbers."""
    n, c = F.col("n_words"), F.col
    return {
        "too_few_words": n < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * n,
        "symbol_heavy": 100 * c("n_symbols") > 20 * n,
        "odd_word_length": (c("word_chars") < 2 * n) | (c("word_chars") > 15 * n),
        "repeated_lines": 100 * c("n_dup_lines") > 40 * c("n_lines"),
        "shouting": 100 * c("n_shouts") > 50 * n,
    }


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, the measurements and failed_bits.

    Words are runs of characters other than the six ASCII spaces. Null texts count as empty and fail the first
    rule; null keys and repeated rows stay; other columns are not read; an empty table gives no rows.
    """
    bits = [F.when(fails, F.lit(1 << RULES.index(rule)).cast("long")).otherwise(0) for rule, fails in failures().items()]
    return measured(docs, key, text).withColumn("failed_bits", reduce(Column.__add__, bits))


def judged(rows: DataFrame, policy: str = CURRENT, out: str = "kept") -> DataFrame:
    """Add the verdict of a policy: no failed rule is in its mask."""
    return rows.withColumn(out, F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablation(rows: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """What each rule does in each policy: policy, rule, failing, rejected_alone, kept_without.

    One pass over the bits: they are counted by value first (at most 2 ** rules rows), then split by rule.
    """
    counts = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(rule).alias("rule"), F.lit(mask(p)).cast("long").alias("mask"),
                               F.lit(1 << RULES.index(rule)).cast("long").alias("bit")) for p in policies for rule in POLICIES[p]])
    each = counts.withColumn("c", F.explode(cases)).select("*", "c.*")
    failed, bit = F.col("failed_bits").bitwiseAND(F.col("mask")), F.col("bit")
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return each.groupBy("policy", "rule").agg(total(failed.bitwiseAND(bit) != 0).alias("failing"), total(failed == bit).alias("rejected_alone"),
                                              total((failed - failed.bitwiseAND(bit)) == 0).alias("kept_without"))



def filter_documents(docs: DataFrame, policy: str = CURRENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with all their columns."""
    (row,) = free(docs, "row")
    from geoloom.session import settle

    stored = settle(docs.select("*", F.monotonically_increasing_id().alias(row)))
    keep = judged(ledger(stored, row, text), policy).where("kept").select(F.col("key").alias(row))
    return stored.join(keep, row, "left_semi").select(*[named(c) for c in docs.columns])


RULES_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, sum(least(3, coalesce(i - before, 3))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(regexp_extract_all(t, '!'))::BIGINT AS n_shouts,
  coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN p USING (doc_id)),
b AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 20 * n_words)::INT
  + 8 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT + 16 * (100 * n_dup_lines > 40 * n_lines)::INT + 32 * (100 * n_shouts > 50 * n_words)::INT)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouts, failed_bits, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""
