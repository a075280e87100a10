"""Mixing sources to target weights by Poisson replication.

A source with share w of the target and n of N rows is repeated at the rate w N / n. Each document gets a
uniform number from a hash of its key and the seed, and the number of its copies is the Poisson distribution's
inverse at that number, so a document's copies depend on nothing but its key, the seed and its source's rate.
Copies are then shuffled by a hash of key and copy. The inverse is summed in Python, all else is DataFrame functions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType

from geoloom.llm.common import free, named, parts
from geoloom.session import settle

# 52 bits of an MD5 are a uniform number; it is moved to the middle of its cell and is never 0 or 1.
CELLS = 1 << 52


def uniform(key: Column, seed: str) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / CELLS


def distribution(rate: float) -> tuple[int, np.ndarray]:
    """The first k whose probability counts in doubles, and the distribution function from there on.

    Terms are products of rate / k away from the mode, scaled by their sum, so they do not underflow at any rate; 12 deviations and
    40 steps on either side leave out less than any cell of ``u``.
    """
    mode, reach = int(rate), int(12 * math.sqrt(rate) + 40)
    low = max(0, mode - reach)
    down = np.log(np.arange(mode, low, -1, dtype=np.float64)) - math.log(rate) if mode > low else np.empty(0)
    up = (math.log(rate) if rate > 0 else -math.inf) - np.log(np.arange(mode + 1, mode + reach + 1, dtype=np.float64))
    terms = np.exp(np.concatenate([np.cumsum(down)[::-1], [0.0], np.cumsum(up)]))
    sums = np.cumsum(terms)
    return low, sums / sums[-1]


@F.arrow_udf(IntegerType())
def _copies(u: pa.Array, rate: pa.Array) -> pa.Array:
    u, rate = (x.to_numpy(zero_copy_only=False).astype(np.float64) for x in (u, rate))
    out, order = np.zeros(u.size, np.int32), np.argsort(rate, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(rate[order])) + 1) if u.size else []:
        low, reached = distribution(float(rate[rows[0]]))
        out[rows] = low + np.searchsorted(reached, u[rows])
    return pa.array(out)


def poisson_inverse(u: Column, rate: Column, top: int | None = None) -> Column:
    """The smallest k whose distribution function reaches ``u``, but ``top`` at most where that is given."""
    k = _copies(u, rate)
    return k if top is None else F.least(k, F.lit(top))


def rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5) -> DataFrame:
    """(source, n, rate) of every source, from the counts of all rows.

    ``weights`` are the target shares; they are scaled to one over the sources that occur, and a source without a weight has
    none. Without weights a source of n rows weighs n ** alpha. A null source is a source like any other.
    """
    counts = docs.groupBy(named(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    else:
        if not weights or any(not math.isfinite(w) or w < 0 for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")], F.lit(0.0)).cast("double")
    counts = settle(counts.withColumn("w", weight))
    sums = counts.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    share = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(0.0)
    return settle(counts.crossJoin(F.broadcast(sums)).select("source", "n", (share * F.col("all_n") / F.col("n")).alias("rate")))  # one row of sums


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5,
        seed: str = "mix-1", shuffle: bool = True) -> DataFrame:
    """Repeat and shuffle documents: all columns, and rate, copies, copy (from 0) and shuffle_key.

    A column of one of these names is kept and the new one gets a trailing underscore. Null keys count as the empty
    text, rows with equal keys get equal numbers of copies, and an empty table gives no rows. Rows are ordered by
    shuffle_key within partitions that are dealt by it.
    """
    rate, copies, copy, order, src = free(docs, "rate", "copies", "copy", "shuffle_key", "source_of_rate")
    table = rates(docs, source, weights, alpha)
    # The rates are written, so their true size decides between a broadcast and a join that splits large sources.
    rated = docs.join(table.select(F.col("source").alias(src), F.col("rate").alias(rate)), named(source).eqNullSafe(F.col(src))).drop(src)
    counted = rated.withColumn(copies, poisson_inverse(uniform(named(key), seed), F.col(rate)))
    # Not by a filter, which would be pushed below the inverse and compute it twice; the null of no copies explodes to no row.
    out = counted.withColumn(copy, F.explode(F.when(F.col(copies) > 0, F.sequence(F.lit(0), F.col(copies) - 1))))
    out = out.withColumn(order, F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(named(key).cast("string"), F.lit("")), F.col(copy))))
    if not shuffle:
        return out
    # Rows without a key share their shuffle_key; a hash of their content deals them over partitions too.
    content = F.xxhash64(*[named(f.name) for f in docs.schema if f.dataType.simpleString() in ("string", "bigint", "int", "double")], F.lit(seed))
    return out.repartition(parts(docs.sparkSession), F.col(order), F.when(named(key).isNull(), content)).sortWithinPartitions(order)


MIX_SQL = """
WITH counts AS (SELECT source, count(*) AS n, power(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
rates AS (SELECT source, (w / (SELECT sum(w) FROM counts)) * (SELECT sum(n) FROM counts) / n AS rate FROM counts),
drawn AS (
  SELECT d.*, rate, (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
terms AS (  -- terms of the distribution by k, and their running sums, as far as each source's rate asks
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM (SELECT source, rate, unnest(range(0, (rate + 12 * sqrt(rate) + 40)::BIGINT)) AS k FROM rates)),
counted AS (SELECT d.*, (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND t.cdf < d.u) AS copies FROM drawn d)
SELECT * EXCLUDE (u, copy) REPLACE (round(rate, 9) AS rate, copies::INT AS copies), copy::INT AS copy,
  md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key
FROM counted, LATERAL (SELECT unnest(range(0, copies)) AS copy)
"""
