"""Source divergence audit with late strings.

Texts are read once. Each task counts the terms of its documents and writes one row for each language and term it
met: the term's 64-bit digest, the term itself, its documents, and its count by number of the source. What is counted, joined and
shuffled from then on are digests of fixed width. Strings are read again for kept digests alone: their smallest and largest string show
whether one digest stands for several terms, and only such digests are counted again by string. Terms' texts are joined
back for the few rows that are returned.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.llm.common import named
from geoloom.session import settle

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SEED, UNIT = 42, 1_000_000_000
TOKENS, TERMS = 2_000_000, 300_000  # what a task holds before it writes rows
COUNTS = "lang string, digest bigint, term string, df bigint, at array<int>, n array<bigint>"


class Numbers(dict):
    """A number for each key, in the order of their first use."""

    def __missing__(self, key):
        self[key] = out = len(self)
        return out


def totals(numbers: dict, docs: np.ndarray, sources: np.ndarray, terms: np.ndarray, bits: int) -> list[pa.Array]:
    """Columns digest, term, df, at, n from one entry a token: its document, source number and term number."""
    pairs = np.unique((terms.astype(np.int64) << 32) | docs)
    df = np.bincount(pairs >> 32, minlength=len(numbers))
    keys, n = np.unique((terms.astype(np.int64) << 32) | sources, return_counts=True)
    cuts = np.searchsorted(keys >> 32, np.arange(len(numbers) + 1)).astype(np.int32)
    digests = np.fromiter((xxhash.xxh64_intdigest(w, SEED) >> (64 - bits) for w in numbers), np.uint64, len(numbers)).view(np.int64)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(cuts), pa.array(values))
    return [pa.array(digests), pa.array(list(numbers), pa.binary()).cast(pa.string()), pa.array(df), lists((keys & 0xFFFFFFFF).astype(np.int32)), lists(n.astype(np.int64))]


def term_counts(docs: DataFrame, bits: int) -> DataFrame:
    """(lang, digest, term, df, at, n) of the documents (lang, at, text) of each task, a bounded number of tokens at a time."""
    def counted(batches):
        held: dict[str, tuple[Numbers, list]] = {}
        size, doc = 0, 0

        def out():
            for lang, (numbers, parts) in held.items():
                if numbers:
                    docs_, sources, terms = (np.concatenate(c) for c in zip(*parts))
                    columns = totals(numbers, docs_, sources, terms, bits)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(numbers), pa.string()), *columns], ["lang", "digest", "term", "df", "at", "n"])
            held.clear()

        for batch in batches:
            for lang, at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                words = TERM.findall((text or b"").lower())
                numbers, parts = held.setdefault(lang, (Numbers(), []))
                terms = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                parts.append((np.full(terms.size, doc, np.int64), np.full(terms.size, at, np.int64), terms))
                size, doc = size + terms.size, doc + 1
                if size > TOKENS or sum(len(x) for x, _ in held.values()) > TERMS:
                    yield from out()
                    size, doc = 0, 0
        yield from out()

    return docs.select("lang", "at", "text").mapInArrow(counted, COUNTS)


def kept_terms(partial: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(counts, names): n of every kept term by (lang, at, digest, part), and the text of every kept (lang, digest, part).

    ``part`` is empty unless several terms of a language share the digest; then it is the term.
    """
    # A digest that stands for several terms has at least the documents of each of them, so no term is lost here.
    often = settle(partial.groupBy("lang", "digest").agg(F.sum("df").alias("df")).where(F.col("df") >= least).select("lang", "digest"))
    rows = settle(partial.join(often, ["lang", "digest"], "left_semi"))
    ends = settle(rows.groupBy("lang", "digest").agg(F.min("term").alias("low"), F.max("term").alias("high")))
    mixed = ends.where("low <> high").select("lang", "digest")
    split = rows.join(mixed, ["lang", "digest"], "left_semi")
    some = split.groupBy("lang", "digest", F.col("term").alias("part")).agg(F.sum("df").alias("df")).where(F.col("df") >= least).drop("df")
    single = ends.where("low = high").select("lang", "digest", F.lit("").alias("part"), F.col("low").alias("term"))
    names = settle(single.unionByName(some.withColumn("term", F.col("part"))))
    each = lambda df, part: df.select("lang", "digest", part.alias("part"), F.explode(F.arrays_zip("at", "n")).alias("u")).select("lang", "digest", "part", "u.at", "u.n")
    plain = each(rows.join(mixed, ["lang", "digest"], "left_anti"), F.lit("")).groupBy("lang", "digest", "part", "at").agg(F.sum("n").alias("n"))
    again = each(split, F.col("term")).join(names.drop("term"), ["lang", "digest", "part"], "left_semi").groupBy("lang", "digest", "part", "at").agg(F.sum("n").alias("n"))
    return settle(plain.unionByName(again)), names


def chance(count: str, total: str) -> Column:
    """1 + floor(UNIT (count + 2) / total) in whole numbers of any size; 1 where the total is 0."""
    floor = F.expr(f"CAST((CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(19,0))) DIV {total} AS BIGINT)")
    return F.when(F.col(total) > 0, floor + 1).otherwise(F.lit(1).cast("long"))


def divergence_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def pair_sums(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value): the divergences of sources a < b summed over each task's terms.

    A row is one term: lang, at (numbers of the sources that use it), p (their chances), base (chance of an unused term
    for every source of the language). Each task holds one sum for each pair of sources, like the result.
    """
    def summed(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            by_lang: dict[str, list[int]] = {}
            for i, g in enumerate(cols[0]):
                by_lang.setdefault(g, []).append(i)
            for g, own in by_lang.items():
                base = np.array(cols[3][own[0]], np.int64)
                total = held.setdefault(g, np.zeros((base.size, base.size), np.int64))
                step = max(1, 2_000_000 // base.size)
                for x in range(0, len(own), step):
                    block = own[x:x + step]
                    p = np.tile(base, (len(block), 1))
                    for k, i in enumerate(block):
                        p[k, cols[1][i]] = cols[2][i]
                    for a in range(base.size - 1):
                        total[a, a + 1:] += divergence_of(p[:, a + 1:], p[:, a:a + 1]).sum(0)
        for g, total in held.items():
            for a in range(len(total) - 1):
                b = np.arange(a + 1, len(total))
                yield pa.RecordBatch.from_arrays([pa.array([g] * b.size, pa.string()), pa.array(np.full(b.size, a, np.int32)), pa.array(b.astype(np.int32)),
                                                  pa.array(total[a, a + 1:])], ["lang", "a", "b", "value"])

    return rows.select("lang", "at", "p", "base").mapInArrow(summed, "lang string, a int, b int, value bigint")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 10, top: int = 10, bits: int = 64) -> DataFrame:
    """How far the sources of each language differ: lang, source, part, item, value, rank.

    Terms are runs of ASCII letters and characters beyond ASCII with A-Z in lower case, counted in whole texts; a language keeps those in at least
    ``least`` of its documents. Part ``pair`` gives every other source of the language with the summed divergence, part ``term`` the ``top`` terms that a
    source uses more than its language does. Null languages, sources and texts are empty ones; repeated rows count as often as they come; a language
    without kept terms has pairs of value 0; an empty table gives no rows; other columns are not read. ``bits`` narrows the digest, for tests.
    """
    own = docs.select(F.coalesce(named(lang), F.lit("")).alias("lang"), F.coalesce(named(source), F.lit("")).alias("source"), named(text).alias("text"))
    # Sources of a language by number, a row each; a language's list is as long as it has sources.
    lists = own.groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("source"))
    numbers = settle(lists.select("lang", F.posexplode("source").alias("at", "source")))
    partial = settle(term_counts(own.join(numbers, ["lang", "source"]), bits))
    counts, names = kept_terms(partial, least)
    size = names.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sums = counts.groupBy("lang", "at").agg(F.sum("n").alias("n"))
    groups = numbers.join(sums, ["lang", "at"], "left").join(size, "lang", "left").na.fill(0, ["n", "v"])
    groups = settle(groups.withColumn("total", (F.col("n") + 2 * F.col("v")).cast("decimal(19,0)")))
    listed = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "source", chance("0", "total").alias("p")))).alias("all"), F.sum("n").cast("decimal(19,0)").alias("n"),
                                        F.first("v").alias("v"))
    listed = settle(listed.select("lang", "all.source", F.col("all.p").alias("base"), (F.col("n") + 2 * F.col("v")).cast("decimal(19,0)").alias("lang_total")))
    each = counts.join(groups.select("lang", "at", "total"), ["lang", "at"]).select("lang", "digest", "part", "at", "n", chance("n", "total").alias("p"))
    lines = each.groupBy("lang", "digest", "part").agg(F.collect_list(F.struct("at", "p")).alias("u"), F.sum("n").alias("all_n"))
    lines = settle(lines.join(listed.select("lang", "base", "lang_total"), "lang").select("lang", "digest", "part", "u.at", "u.p", "base", chance("all_n", "lang_total").alias("q")))
    value = pair_sums(lines).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    halves = listed.select("lang", F.posexplode("source").alias("a", "source"), F.col("source").alias("others"))
    pairs = halves.select("lang", "a", "source", F.posexplode("others").alias("b", "item")).where("a <> b")
    pairs = pairs.select("lang", "source", "item", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(value, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    # Numbers first: all terms that tie with the last place stay until their texts can order them.
    above = lines.select("lang", "digest", "part", F.explode(F.arrays_zip("at", "p")).alias("u"), "q").select("lang", "digest", "part", "u.at", "u.p", "q").where("p > q")
    above = above.withColumn("value", F.expr("((p - q) * (p - q)) DIV (p + q)"))
    best = above.withColumn("place", F.rank().over(Window.partitionBy("lang", "at").orderBy(F.col("value").desc()))).where(F.col("place") <= top)
    best = best.select("lang", "digest", F.col("part").alias("piece"), "at", "value")
    best = best.join(names.select("lang", "digest", F.col("part").alias("piece"), F.col("term").alias("item")), ["lang", "digest", "piece"]).join(numbers, ["lang", "at"])
    terms = best.select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) s),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * v.v) AS p
  FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v.v) AS q FROM kept JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
out AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM f JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM out QUALIFY part = 'pair' OR rank <= 10
"""
