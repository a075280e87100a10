"""Near-duplicates by the Jaccard similarity of five-word shingles.

Candidates come from two sources, and every one is verified on the words themselves. The first is SimHash with deletion variants
(``simhash.links``, to three bits) over five-word shingles. It cannot find a similarity of 0.8 at bounded cost: that moves about 10 of 64
bits, and deletion variants for 10 bits leave keys of about 10 bits, under which a fixed share of all documents meets. So the second
source are min-hashes: each text has ``BANDS`` keys of ``ROWS`` min-hashes, and two texts of similarity s share one with
probability 1 - (1 - s^5)^24 (0.99993 at 0.8). Under each key the texts meet the first one, so copies of one text meet one other, however
many they are. Where that leaves several components under a key, its texts are joined by an exact set-similarity join (``prefix_pairs``): their
shingles are ordered by frequency, rarest first, and a pair is compared on the words only if it shares a shingle so early in both orders
that it may be similar. Of a shingle's texts those that fit none of another component are dropped before any pair is made, and the most
typical one of the rest meets the others first.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType

from geoloom.llm import simhash
from geoloom.llm.common import Memo, free, named, stay, with_rows
from geoloom.llm.links import components
from geoloom.session import settle

BANDS, ROWS = 24, 5
RANDOM = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
FLIPS, FACTORS = RANDOM[0][:, None], RANDOM[1][:, None] | np.uint64(1)
SKETCH = "row bigint, key bigint, digest binary, n int, fp bigint, bands array<bigint>"


def mixed(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, width: int) -> set[bytes]:
    """The different runs of ``width`` words; a shorter text is one shingle, a text without words has none."""
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII space characters
    return {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def word_memo() -> Memo:
    return Memo(lambda word: xxhash.xxh64_intdigest(word, 42), most=50_000, longest=32)  # small, as idle workers keep it


def hashes_of(text: str, width: int, memo) -> np.ndarray:
    """A 64-bit hash of each different shingle, sorted."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, w.size - width + 1)
    h = np.full(n, len(words) if len(words) < width else 0, np.uint64)
    for k in range(min(width, w.size)):
        h = mixed(h + w[k:k + n])
    return np.unique(h)


def sketch_of(text: str, width: int, memo) -> tuple[bytes, int, int, list[int]]:
    """Digest of the set of shingles, its size, its SimHash, and the keys of its bands."""
    h = hashes_of(text, width, memo)
    if not h.size:
        return b"", 0, 0, []
    least, ones = np.full(BANDS * ROWS, np.iinfo(np.uint64).max), np.zeros(64, np.int64)
    for x in range(0, h.size, 2048):
        block = h[x:x + 2048]
        least = np.minimum(least, ((block ^ FLIPS) * FACTORS).min(axis=1))
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mixed(key + column)
    fp = int(np.packbits(2 * ones > h.size, bitorder="little").view(np.int64)[0])
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest(), int(h.size), fp, key.view(np.int64).tolist()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """The sketch of each row of ``docs`` (row, key, text)."""
    def made(batches):
        memo = word_memo()
        for batch in batches:
            rows = list(zip(*(sketch_of(t or "", width, memo) for t in batch.column(2).to_pylist()))) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int32()),
                                              pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.list_(pa.int64()))],
                                             ["row", "key", "digest", "n", "fp", "bands"])

    return docs.mapInArrow(made, SKETCH)


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts have at least this similarity; ``texts`` has row and text."""
    @F.arrow_udf(BooleanType())
    def close(ones: pa.Array, others: pa.Array) -> pa.Array:
        sets = lru_cache(4)(lambda text: shingles(text, width))
        out = []
        for x, y in zip(ones.to_pylist(), others.to_pylist()):
            x, y = sets(x), sets(y)
            both = len(x & y)
            out.append(both >= least * (len(x) + len(y) - both) - 1e-9)
        return pa.array(out, pa.bool_())

    # The texts of the pairs are read once; both joins hash one side at every size.
    used = settle(texts.join(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct().hint("shuffle_hash"), "row", "left_semi"))
    with_texts = (pairs.select("a", "b").join(used.select(F.col("row").alias("a"), F.col("text").alias("x")), "a")
                  .join(used.select(F.col("row").alias("b"), F.col("text").alias("y")), "b"))
    return settle(with_texts.where(close("x", "y")).select("a", "b"))


def similar_sizes(one: str, other: str, least: float):
    """Sets whose sizes differ by more cannot be so similar."""
    return F.least(one, other) >= least * F.greatest(one, other) - 1e-9


def simhash_pairs(heads: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose fingerprints deletion variants link to three bits; of equal fingerprints each row meets the first."""
    firsts = settle(heads.groupBy("fp").agg(F.min(F.struct("row", "n")).alias("f")).select("fp", F.col("f.row").alias("first"), F.col("f.n").alias("first_n")))
    end = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias("row_" + c), F.col("first_n").alias("n_" + c))
    across = simhash.links(firsts.select("fp"), distance=3).select("a", "b").join(end("a"), "a").join(end("b"), "b")
    across = across.where(similar_sizes("n_a", "n_b", least)).select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b"))
    within = heads.join(firsts, "fp").where("row <> first").where(similar_sizes("n", "first_n", least)).select(F.col("first").alias("a"), F.col("row").alias("b"))
    return across.unionByName(within)


def first_pairs(met: DataFrame, least: float) -> DataFrame:
    """Each text with the first one under each of its keys."""
    return met.where("row <> first").where(similar_sizes("n", "first_n", least)).select(F.col("first").alias("a"), F.col("row").alias("b"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) after some more links, found on the graph of the roots alone."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = settle(roots.unionByName(ends.join(roots, "node", "left_anti").withColumn("root", F.col("node"))))
    root_of = lambda c: every.select(F.col("node").alias(c), F.col("root").alias("root_" + c))
    between = links.join(root_of("a"), "a").join(root_of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    step = settle(components(between)).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return settle(every.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))


def shingle_rows(docs: DataFrame, width: int) -> DataFrame:
    """(row, h) for the hash of each different shingle of ``docs`` (row, text)."""
    def made(batches):
        memo = word_memo()
        for batch in batches:
            sets = [hashes_of(t or "", width, memo) for t in batch.column(1).to_pylist()]
            rows = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [h.size for h in sets])
            hashes = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(hashes)], ["row", "h"])

    return docs.mapInArrow(made, "row bigint, h bigint")


def prefix_entries(docs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """(h, row, n, reach) for the early shingles of ``docs`` (row, n), which any two that have this similarity share in part.

    Shingles are ordered by the number of texts that have them, rarest first. The first common shingle of two texts with m in common has m
    or more from it on in both. A text of n shingles with ``left`` from one on can so be similar only to texts of at most ``reach`` shingles.
    """
    words = settle(shingle_rows(texts.join(docs.select("row").hint("shuffle_hash"), "row", "left_semi").select("row", "text"), width))
    often = words.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where("f > 1")  # the others come first and meet nobody
    left = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("f"), "h"))
    bound = max(least, 1e-9)
    reach = F.col("left") * ((1 + bound) / bound) - F.col("n") + 1e-6
    return settle(words.join(often, "h").select("row", "h", left.alias("left")).join(docs, "row")
                  .where(F.col("left") >= least * F.col("n") - 1e-6).select("h", "row", "n", reach.alias("reach")))


def fitting(entries: DataFrame) -> DataFrame:
    """Those of ``entries`` (h, row, n, reach, root) that may fit one of another root, and whether their root is the largest of the shingle."""
    # For each shingle the smallest text and the furthest reach of two roots, so that each text is held against another's.
    by_root = settle(entries.groupBy("h", "root").agg(F.min("n").alias("low"), F.max("reach").alias("far"), F.count(F.lit(1)).alias("size")))
    first = settle(by_root.groupBy("h").agg(F.count(F.lit(1)).alias("roots"), F.min(F.struct("low", "root")).alias("l"), F.max(F.struct("far", "root")).alias("r"),
                                            F.max(F.struct("size", "root")).alias("s")).where("roots > 1"))
    other = lambda best, value: F.when(F.col("root") != F.col(f"{best}.root"), F.col(value))
    second = by_root.join(first, "h").groupBy("h").agg(F.min(other("l", "low")).alias("low2"), F.max(other("r", "far")).alias("far2"))
    low, far = (F.when(F.col("root") == F.col(f"{best}.root"), F.col(two)).otherwise(F.col(f"{best}.{one}")) for best, one, two in (("l", "low", "low2"), ("r", "far", "far2")))
    return settle(entries.join(first.join(second, "h"), "h").where((low <= F.col("reach")) & (F.col("n") <= far))
                  .select("h", "row", "n", "reach", "root", (F.col("s.root") == F.col("root")).alias("largest")))


def prefix_pairs(some: DataFrame, fit: DataFrame) -> DataFrame:
    """Pairs (a, b) of different roots from ``some`` and ``fit`` (h, row, n, reach, root) that share a shingle within both reaches."""
    ends = fit.select("h", *[F.col(c).alias(c + "2") for c in ("row", "n", "reach", "root")])
    met = some.join(ends, "h").where("root <> root2 AND n <= reach2 AND n2 <= reach")
    return met.select(F.least("row", "row2").alias("a"), F.greatest("row", "row2").alias("b")).distinct()


def final_roots(met: DataFrame, roots: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Components of all similar pairs: ``roots`` and the pairs between different components under one key."""
    root_of = lambda df: df.join(roots.select(F.col("node").alias("row"), "root"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    rooted = settle(root_of(met.where("row <> first").select("band", "row", "n")))
    several = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    open_ = settle(rooted.join(several, "band", "left_semi").select("row", "n").distinct())
    if open_.isEmpty():
        return roots
    entries = prefix_entries(open_, texts, width, least)
    # Of near copies of one text the one with the fewest shingles of its own reaches furthest; it meets all others first and links most, then all meet.
    # The largest root of a shingle meets the others, not itself.
    furthest = lambda fit: fit.groupBy("h").agg(F.max(F.struct("reach", "row", "n", "root")).alias("e")).select("h", "e.row", "e.n", "e.reach", "e.root")
    for meeting in (furthest, lambda fit: fit.where("NOT largest").drop("largest")):
        fit = fitting(settle(root_of(entries)))
        fresh = verified(settle(prefix_pairs(meeting(fit), fit)), texts, width, least)
        if not fresh.isEmpty():
            roots = merged(roots, fresh)
    return roots


def classes(rows: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """(row, key, root) of every sketch: equal roots for the components of all similar pairs found."""
    # One row for each distinct set: copies never meet each other, however many there are.
    heads = settle(rows.groupBy("digest").agg(F.min("row").alias("head")))
    own = settle(rows.join(heads.select(F.col("head").alias("row")), "row", "left_semi").select("row", "n", "fp", "bands"))
    bands = own.select("row", "n", F.explode("bands").alias("band"))
    firsts = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("row", "n")).alias("f")).where("size > 1")
    met = settle(bands.join(firsts.select("band", F.col("f.row").alias("first"), F.col("f.n").alias("first_n")), "band"))
    pairs = settle(simhash_pairs(own.where("n > 0"), least).unionByName(first_pairs(met, least)).distinct())
    roots = final_roots(met, settle(components(verified(pairs, texts, width, least))), texts, width, least)
    return (rows.select("row", "key", "digest").join(heads, "digest").join(roots.withColumnRenamed("node", "head"), "head", "left")
            .select("row", "key", F.coalesce("root", "head").alias("root")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, as_read: bool = False) -> DataFrame:
    """The documents without near-duplicates: of each class the row with the largest key (null only where all are) stays.

    A class is a component of the pairs whose sets of ``width``-word shingles have a Jaccard similarity of ``least`` or more; words are
    cut at white space and A-Z are lowered. Texts without words are one class, null texts are empty, very long ones are read whole. All columns are
    kept. Of rows with equal keys the last read stays, as in exact dedup, and an empty table gives no rows. ``as_read`` as in ``common.with_rows``.
    """
    row, = free(docs, "row")
    stored = with_rows(docs, row, as_read)
    rows = settle(sketches(stored.select(F.col(row).alias("row"), named(key).cast("long").alias("key"), named(text).alias("text")), width))
    texts = stored.select(F.col(row).alias("row"), named(text).alias("text"))
    of = classes(rows, texts, width, least)
    keep = of.groupBy("root").agg(F.max(F.struct("key", "row")).alias("head")).select(F.col("head.row").alias("row"))
    return stay(stored, keep, row, docs.columns)
