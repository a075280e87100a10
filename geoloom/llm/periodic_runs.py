"""Periodic runs of words by tiles at the scale of each octave of periods.

A run is a maximal stretch of words with smallest period q, at least twice as long as q. For each octave of periods
a document is cut into tiles of eight blocks, with a margin of one block and the longest period; the block is half the octave's
shortest period, so every run holds a whole block that comes again one period later. Tiles that have no such block are never sent;
that is seen by comparing hashes of blocks, all tiles of an octave at once. The others are rows of their own, dealt over all tasks
whatever document they come from, and each is solved alone: Z-functions forward and backward from a block's start give, for every
period at once, how far words agree with those one period later. The found intervals are shuffled by document and period
and stitched by a window, and of periods that fill the same stretch the smallest is its run's.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from geoloom.llm.common import named, parts
from geoloom.session import settle

SHORTEST, BLOCKS, CORE = 12, 8, 512
FLUSH = 4 << 20
PIECES = "row bigint, n bigint, whole string, words string, octave int, at bigint, core int, size int, codes binary"
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def octave(k: int) -> tuple[int, int, int, int]:
    """(shortest period, one beyond the longest, block, words of a tile's core). Octave 0 has the periods 1 to 7.

    Words that agree with those one period later are at least max(12 - period, period) in a row, which hold a whole block.
    """
    low, high, block = (1, 8, 3) if k == 0 else (4 << k, 8 << k, 2 << k)
    return low, high, block, block * max(BLOCKS, -(-CORE // block))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * MIX1) ^ (b + MIX2)
    return (h ^ (h >> np.uint64(29))) * MIX1


def block_hashes(codes: np.ndarray, wanted: int) -> np.ndarray:
    """A hash of the ``wanted`` words from each place on, by doubling; 3 or a power of two."""
    h, size = codes.astype(np.uint64), 1
    while size * 2 <= wanted:
        h, size = mix(h[:h.size - size], h[size:]), size * 2
    return h if size == wanted else mix(h[:h.size - 1], codes[2:].astype(np.uint64))


def again(h: np.ndarray, starts: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the start, period) wherever the block at a start comes again ``low`` to ``high`` - 1 words later."""
    at, period = [], []
    step = max(1, (1 << 21) // (high - low))
    reach = np.arange(low, high)
    for x in range(0, starts.size, step):
        own = starts[x:x + step]
        other = own[:, None] + reach
        inside = other < h.size
        i, j = np.nonzero((h[np.where(inside, other, 0)] == h[own][:, None]) & inside)
        at.append(i + x)
        period.append(j + low)
    return (np.concatenate(at), np.concatenate(period)) if at else (np.empty(0, np.int64),) * 2


def tiles(codes: np.ndarray):
    """(octave, at, core, size, words) of each tile that holds a block which comes again; core and size are the part it answers for."""
    n = codes.size
    if n < SHORTEST:
        return
    three = block_hashes(codes, 3)
    if np.unique(three).size == three.size:  # no three words come twice: no run at all
        return
    h, size = codes.astype(np.uint64), 1
    k = 0
    while octave(k)[0] * 2 <= n:
        low, high, block, core = octave(k)
        if k == 0:
            own = three
        else:
            while size < block:
                h, size = mix(h[:h.size - size], h[size:]), size * 2
            own = h
        starts = np.arange(0, n - block - low + 1, block)
        at, _ = again(own, starts, low, high)
        for tile in np.unique(starts[at] // core).tolist():
            first = tile * core
            begin = max(0, first - block)
            yield k, begin, first - begin, core, codes[begin:first + core + block + high]
        k += 1


@lru_cache(1 << 16)
def parts_of(p: int) -> tuple[int, ...]:
    """p divided by each of its prime factors."""
    out, rest, d = [], p, 2
    while d * d <= rest:
        if rest % d == 0:
            out.append(p // d)
            while rest % d == 0:
                rest //= d
        d += 1
    return tuple(out + [p // rest] if rest > 1 else out)


def z_function(s: list) -> list[int]:
    """For each place the length of the longest prefix of ``s`` that starts there."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def fragments(k: int, core: int, size: int, codes: np.ndarray):
    """(period, from, to) in the tile: words at from .. to - 1 equal those one period later, as far as the tile shows."""
    low, high, block, _ = octave(k)
    n = codes.size
    starts = np.arange(core, min(core + size, n - block - low + 1), block)
    at, period = again(block_hashes(codes, block), starts, low, high)
    covered: dict[int, int] = {}
    words = codes.tolist()
    cuts = np.flatnonzero(np.diff(at, prepend=-1)).tolist() + [at.size]
    for x, y in zip(cuts, cuts[1:]):
        b = int(starts[at[x]])
        open_ = [p for p in period[x:y].tolist() if covered.get(p, -1) < b + block]
        if not open_:
            continue
        top = min(n, b + high - 1)  # forward and backward agreement for every period below ``high``
        right = np.zeros(high, np.int64)
        z = z_function(words[b:])
        right[1:min(high, len(z))] = z[1:high]
        left = np.zeros(high, np.int64)
        back = z_function(words[b - 1::-1] + [-1] + words[top - 1::-1]) if b else []
        if b:  # the place of b + p - 1 in the part after the mark
            shifts = np.arange(1, top - b + 1)
            left[1:shifts.size + 1] = np.array(back, np.int64)[b + 1 + top - b - shifts]
        for p in open_:
            if right[p] < block:  # equal hashes, other words
                continue
            begin, end = b - int(left[p]), b + int(right[p])
            covered[p] = end
            # Where a part of p is a period of the whole stretch, and twice so, the run is that part's and p's pieces are not sent. A tile that
            # sees too little of the stretch to tell sees less than p words agree, which make no run of p.
            if any(end - begin >= q and left[q] >= left[p] and right[q] + q >= right[p] + p for q in parts_of(p)):
                continue
            yield p, begin, end


def explode_tiles(rows: DataFrame) -> DataFrame:
    """From (row, text, key): one row a document (key, n, whole: digest of its words, words where it has tiles) and one row a tile."""
    def made(batches):
        held, size, kind = [], 0, None

        def out():
            nonlocal held, size
            columns = [pa.array(list(c), t) for c, t in zip(zip(*held), [*TYPES, kind])] if held else [pa.array([], t) for t in [*TYPES, kind]]
            held, size = [], 0
            return pa.RecordBatch.from_arrays(columns, [*[c.split()[0] for c in PIECES.split(", ")], "key"])

        for batch in batches:
            kind = batch.schema.field(2).type
            for row, text, key in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                words = (text or b"").split()  # bytes: the six ASCII space characters
                number: dict[bytes, int] = {}
                codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
                joined, any_ = b" ".join(words), False
                for k, at, core, width, part in tiles(codes):
                    held.append((row, None, None, None, k, at, core, width, part.tobytes(), None))
                    size += part.nbytes
                    any_ = True
                    if size > FLUSH:
                        yield out()
                held.append((row, len(words), hashlib.sha256(joined).hexdigest(), joined.decode() if any_ else None, *[None] * 5, key))
                size += 200 + (len(joined) if any_ else 0)
                if size > FLUSH:
                    yield out()
        if held:
            yield out()

    return rows.select("row", "text", "key").mapInArrow(made, f"{PIECES}, key {rows.schema['key'].dataType.simpleString()}")


def solve_tiles(tiles_: DataFrame) -> DataFrame:
    """(row, period, lo, hi) of every fragment of the tiles."""
    def solved(batches):
        for batch in batches:
            found = ([], [], [], [])
            for row, k, at, core, size, codes in zip(*[c.to_pylist() for c in batch.columns]):
                for p, begin, end in fragments(k, core, size, np.frombuffer(codes, np.int32)):
                    for column, value in zip(found, (row, p, at + begin, at + end)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["row", "period", "lo", "hi"])

    return tiles_.select("row", "octave", "at", "core", "size", "codes").mapInArrow(solved, "row bigint, period bigint, lo bigint, hi bigint")


def stitch(found: DataFrame) -> DataFrame:
    """(row, start, length, period) of the runs: touching fragments of one document and period joined, smallest periods kept."""
    w = Window.partitionBy("row", "period").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = found.distinct().withColumn("new", F.when(F.col("lo") <= before, 0).otherwise(1))
    whole = cut.withColumn("part", F.sum("new").over(w)).groupBy("row", "period", "part").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    runs = whole.select("row", "start", (F.col("hi") - F.col("start") + F.col("period")).alias("length"), "period")
    runs = runs.where((F.col("length") >= SHORTEST) & (F.col("length") >= 2 * F.col("period")))
    return runs.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


@F.arrow_udf(StringType())
def collapsed(words: pa.Array, runs: pa.Array) -> pa.Array:
    """The words without those that repeat a run's first period."""
    out = []
    for text, own in zip(words.to_pylist(), runs.to_pylist()):
        if own is None:
            out.append(text)
            continue
        w = text.split(" ")
        keep = np.ones(len(w), bool)
        for r in own:
            keep[r["start"] + r["period"]:r["start"] + r["length"]] = False
        out.append(" ".join([w[i] for i in np.flatnonzero(keep).tolist()]))
    return pa.array(out, pa.string())


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_words, runs (array of start, length, period, by start, then period), whole_sha256, collapsed.

    Runs are at least 12 words long and twice their period. ``collapsed`` is the text of the kept words, null where there is no run, and
    ``whole_sha256`` the digest of all words joined by one space. Null and empty texts have no words and no runs, very long ones are
    tiled like any other, null keys and repeated rows stay, other columns are not read, and an empty table gives no rows.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), named(text).alias("text"), named(key).alias("key"))
    pieces = settle(explode_tiles(source))
    found = pieces.where("octave IS NOT NULL").repartition(parts(docs.sparkSession), "row", "octave", "at")
    runs = stitch(solve_tiles(found)).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    docs_ = pieces.where("octave IS NULL").select("row", "key", "n", "whole", "words").join(runs, "row", "left")
    text_ = collapsed("words", "runs")
    return docs_.select("key", F.col("n").alias("n_words"), F.coalesce("runs", F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")).alias("runs"),
                        F.col("whole").alias("whole_sha256"), F.when(F.col("runs").isNotNull(), text_).alias("collapsed"))


def summary(runs: DataFrame) -> DataFrame:
    """The digest columns of a table of runs: the longest run (ties: smallest start, then period) and two hashes."""
    r = F.col("runs")
    best = F.array_max(F.transform(r, lambda x: F.struct(x["length"].alias("l"), (-x["start"]).alias("s"), (-x["period"]).alias("p"))))
    lines = F.array_join(F.transform(r, lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    rows = runs.withColumn("b", best)
    period = -F.col("b.p")
    return rows.select("key", F.size(r).cast("long").alias("n_runs"), (-F.col("b.s")).alias("start"), F.col("b.l").alias("length"), period.alias("period"),
                       F.floor(F.lit(1000) * F.col("b.l") / period).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
                       F.when(F.size(r) > 0, F.sha2("collapsed", 256)).otherwise(F.col("whole_sha256")).alias("collapsed_sha256"))


def with_planted_periods(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of which about a tenth, chosen by crc32 of the key, repeat from some word on: word i >= a becomes word a + (i - a) % p."""
    h = F.crc32(named(key).cast("string"))

    @F.arrow_udf(StringType())
    def planted(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        out = []
        for t, h in zip(texts.cast(pa.binary()).to_pylist(), hashes.to_pylist()):
            words = (t or b"").split()
            if t is None or not words:
                out.append(None)
                continue
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out.append(b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode())
        return pa.array(out, pa.string())

    chosen = F.when(h % 10 == 0, named(text))
    return docs.select(named(key).alias("key"), F.coalesce(planted(chosen, h), named(text)).alias("text"))
