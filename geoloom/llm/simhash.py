"""SimHash near-duplicates by deletion variants.

Fingerprints that differ in at most two of 64 bits agree, in one of two 32-bit segments, up to one bit. So
each distinct fingerprint is indexed under each segment with each bit wiped in turn (64 keys), fingerprints
meet by equal keys, and the full distance is verified. Links are kept as a spanning forest of each meeting, which
keeps components whole without listing all pairs. A key under which more than ``most`` different
fingerprints meet is not compared pair by pair: its fingerprints are indexed again under all 64 bits with every two
bits wiped, where equal keys alone prove a distance of two or less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from geoloom.llm.common import named, numbered, parts
from geoloom.llm.links import components
from geoloom.session import settle

SEED = 42
ONE = np.uint64(1)


def fingerprint_of(text: bytes, width: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the shingles' XXH64."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII space characters
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for block in range(0, h.size, 4096):
        ones += np.unpackbits(h[block:block + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > h.size, bitorder="little").view(np.int64)[0])


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.int64())


def segment_keys(prints: np.ndarray) -> np.ndarray:
    """64 keys of each fingerprint: both halves with each of their bits wiped; segment and bit are in the key."""
    bit = np.arange(32, dtype=np.uint64)
    keys = []
    for number, half in enumerate((prints & np.uint64(0xFFFFFFFF), prints >> np.uint64(32))):
        keys.append((half[:, None] & ~(ONE << bit)) | (bit << np.uint64(32)) | np.uint64(number << 37))
    return np.concatenate(keys, axis=1)


def forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning links between the fingerprints that are within ``distance``; memory is their number squared."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance
    label = np.arange(prints.size)
    while True:
        # The smallest label among neighbours, then the label of that label.
        new = np.where(near, label[None, :], prints.size).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(i, int(j)) for i, j in enumerate(label) if i != j]


def links(prints: DataFrame, distance: int = 2, most: int = 1500) -> DataFrame:
    """Links a, b (long) whose components are those of all pairs of ``prints`` (fp long, distinct) within ``distance`` bits.

    One of two segments holds at most one of three differing bits, so distances to three are found by the same keys. Under crowded keys
    the links are those within two bits at any ``distance``.
    """
    if distance not in (2, 3):
        raise ValueError("two segments and one wiped bit find distances up to three")

    def variants(batches):
        for batch in batches:
            for x in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(x, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(segment_keys(own).ravel().view(np.int64)), pa.array(np.repeat(own, 64).view(np.int64))],
                                                 ["key", "fp"])

    def meet(batches):
        """Rows come by key. Links of two fingerprints; a row with b null names one of a crowded key."""
        key, held, crowded = None, [], False
        a, b = [], []

        def close():
            if crowded:
                a.extend(held)
                b.extend([None] * len(held))
            elif len(held) > 1:
                own = np.array(held, np.int64)
                for i, j in forest(own.view(np.uint64), distance):
                    a.append(held[i])
                    b.append(held[j])

        def out():
            nonlocal a, b
            rows = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
            return rows

        for batch in batches:
            keys, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [keys.size]]) if keys.size else np.array([0])
            # Keys with one row inside a batch meet nobody; the first and last may go on in another batch.
            ends = {0, max(cuts.size - 2, 0)} if keys.size else set()
            for r in sorted(ends | set(np.flatnonzero(np.diff(cuts) > 1).tolist())):
                x, y = int(cuts[r]), int(cuts[r + 1])
                if keys[x] != key:
                    if key is not None and (len(held) > 1 or crowded):
                        close()
                    key, held, crowded = keys[x], [], False
                held += prints[x:y].tolist()
                if len(held) > most:
                    crowded = True
                if crowded:
                    close()
                    held = []
            yield out()
        if key is not None:
            close()
        yield out()

    made = prints.repartition(parts(prints.sparkSession)).mapInArrow(variants, "key bigint, fp bigint")
    met = settle(made.repartition(parts(prints.sparkSession), "key").sortWithinPartitions("key").mapInArrow(meet, "a bigint, b bigint"))
    return met.where("b IS NOT NULL").unionByName(_crowd_links(met.where("b IS NULL").select(F.col("a").alias("fp")).distinct()))


def _crowd_links(prints: DataFrame) -> DataFrame:
    """Links of fingerprints to the smallest one with which they share 62 bits, for every two bits wiped."""
    pairs = np.array([(1 << i) | (1 << j) for i in range(64) for j in range(i)], np.uint64)

    def variants(batches):
        number = np.arange(pairs.size, dtype=np.int32)
        for batch in batches:
            for x in range(0, batch.num_rows, 256):
                own = batch.column(0).slice(x, 256).to_numpy(zero_copy_only=False).view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((own[:, None] & ~pairs).ravel().view(np.int64)), pa.array(np.tile(number, own.size)),
                                                  pa.array(np.repeat(own, pairs.size).view(np.int64))], ["rest", "wiped", "fp"])

    made = prints.mapInArrow(variants, "rest bigint, wiped int, fp bigint")
    least = made.groupBy("rest", "wiped").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a <> top").drop("top")
    return made.join(least, ["rest", "wiped"]).where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Class of every document: row, key, fp, component_id (smallest key in the class).

    Texts without words have fingerprint zero and link like any other. Null texts are empty, null keys are in
    classes but never name one that has another key, repeated rows all stay, other columns are not read, and an
    empty table gives no rows. ``row`` numbers the rows read.
    """
    rows = numbered(docs, {"key": named(key).cast("long"), "fp": fingerprints(named(text))}, "row")
    return classes(rows)


def classes(rows: DataFrame) -> DataFrame:
    """The same for rows that have row, key and fp already (and may have more columns)."""
    # One row for each distinct fingerprint: copies never meet each other, however many there are.
    prints = settle(rows.groupBy("fp").agg(F.min("key").alias("low"), F.min("row").alias("low_row")))
    roots = settle(components(links(prints.select("fp"))).withColumnRenamed("node", "fp"))
    rooted = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named_ = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.min(F.struct(F.col("low").isNull(), "low", "low_row")).alias("head"))
    of = settle(rooted.select("fp", "root").join(named_, "root").select("fp", "component_id", F.col("head.low_row").alias("head")))
    return rows.join(of, "fp")
