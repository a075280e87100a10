"""Repeated runs of units (words or lines) by anchors, without pairs of documents.

Documents are packed into chunks of a few megabytes, one row each. Three passes follow.

1. Anchors. Every chunk sends the hashes of its anchors to buckets of the hash: index entries, which can be
   found, and probes, which can find them. A probe that meets an index entry of another place is a hit.
2. Windows. Only windows of ``window`` units that hold a hit are hashed (128 bits) and sent on; windows of
   equal content meet in one bucket, so extending a hit to all its partners is a count and not a join of
   all pairs.
3. The chunk gets back the starts of its repeated windows; their union is the maximal repeated runs.

A chunk settles what repeats inside it and sends each hash once, so a passage that stands in a third of
all documents sends one entry a chunk. Entries travel packed by (chunk, bucket). A task holds one bucket, and there
is a bucket for every ``BUCKET`` bytes of text where that is more than spark.sql.shuffle.partitions, so a
bucket's memory does not grow with the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from geoloom.llm.common import Memo, parts
from geoloom.session import settle

BUCKET = 16 << 20  # bytes of text whose entries a bucket takes
CHUNK = "chunk bigint, size bigint, keys array<bigint>, texts array<binary>"
ENTRY = "bucket int, kind int, chunk bigint, body binary"
FOUND = "chunk bigint, places binary"
INDEX, BOTH, PROBE, DONE = 0, 1, 2, 3
# Odd multipliers of the two rolling sums, and their inverses modulo 2^64.
ROLL = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_HASHES = Memo(xxhash.xxh3_64_intdigest, 300_000)


def hashes(units: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each unit."""
    return np.fromiter(map(_HASHES.__getitem__, units), np.uint64, len(units))


def rolling(units: np.ndarray, width: int, roll: int = ROLL[0]) -> np.ndarray:
    """Hash of every ``width`` consecutive unit hashes: a polynomial in ``roll`` modulo 2^64."""
    if units.size < width:
        return np.empty(0, np.uint64)
    powers = np.full(units.size + 1, roll, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    back = np.full(units.size, pow(roll, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * powers[:-1], dtype=np.uint64)])
    out = (sums[width:] - sums[:-width]) * back[:units.size - width + 1]
    return out ^ out >> np.uint64(31)


@dataclass
class Packed:
    """The unit hashes of a chunk, end to end, and where each document starts."""

    units: np.ndarray
    bounds: np.ndarray

    def inside(self, width: int) -> np.ndarray:
        """Which places start ``width`` units that end in the same document."""
        n = self.units.size - width + 1
        ok = np.ones(max(n, 0), bool)
        for edge in self.bounds[1:-1]:
            ok[max(0, edge - width + 1):edge] = False
        return ok

    def offset(self) -> np.ndarray:
        """Place of each unit in its document."""
        return np.arange(self.units.size) - np.repeat(self.bounds[:-1], np.diff(self.bounds))


def pack(docs: DataFrame, key: Column, text: Column, size: int = 3 << 20) -> DataFrame:
    """Chunks of whole documents of about ``size`` bytes; a longer document is a chunk of its own."""
    def chunks(batches):
        number = TaskContext.get().partitionId() << 33
        keys, texts, held = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(k)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= size:
                    yield batch_of(number, held, keys, texts)
                    number, keys, texts, held = number + 1, [], [], 0
        if keys:
            yield batch_of(number, held, keys, texts)

    def batch_of(number, held, keys, texts):
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([held], pa.int64()), pa.array([keys], pa.list_(pa.int64())),
                                           pa.array([texts], pa.list_(pa.binary()))], ["chunk", "size", "keys", "texts"])

    return settle(docs.select(key.cast("long").alias("k"), text.cast("binary").alias("t")).mapInArrow(chunks, CHUNK))


def buckets_of(chunks: DataFrame) -> int:
    """Buckets for the entries of these chunks."""
    held = chunks.agg(F.sum("size")).first()[0] or 0
    return max(parts(chunks.sparkSession), -(-held // BUCKET))


def _entries(rows: list[tuple]):
    bucket, kind, chunk, body = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(chunk, pa.int64()),
                                       pa.array(body, pa.binary())], ["bucket", "kind", "chunk", "body"])


def _found(rows: list[tuple]):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                      ["chunk", "places"])


def _by_bucket(h: np.ndarray, buckets: int):
    """(order, bucket, start, stop) that groups hashes by bucket and keeps their order inside."""
    b = (h >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(b, kind="stable")
    cuts = np.searchsorted(b[order], np.arange(buckets + 1))
    return order, cuts


def _body(low: np.ndarray, at: np.ndarray | None) -> bytes:
    """40 bits of each hash, and its place."""
    out = (low & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (low >> np.uint64(32)).astype(np.uint8).tobytes()
    return out if at is None else out + at.astype("<u4").tobytes()


def _hash_of(body: bytes, size: int, n: int) -> np.ndarray:
    low = np.frombuffer(body, "<u4", n).astype(np.uint64)
    return low | np.frombuffer(body, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _seen(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in the sorted values, or -1."""
    if not values.size:
        return np.full(wanted.size, -1)
    at = np.minimum(np.searchsorted(values, wanted), values.size - 1)
    return np.where(values[at] == wanted, at, -1)


def hits(chunks: DataFrame, packed: Callable, anchors: Callable, width: int) -> DataFrame:
    """Places (chunk, places) of probes whose hash is also an index entry elsewhere.

    ``packed(texts)`` gives the units of a chunk, ``anchors(packed)`` the hashes, places and index flags of
    its anchors, each ``width`` units long. Buckets compare 40 bits besides their own number, which can only
    add candidates for the exact windows that follow.
    """
    buckets, mask = buckets_of(chunks), np.uint64((1 << 40) - 1)

    def send(batches):
        for batch in batches:
            for chunk, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, at, index = anchors(packed(texts))
                order = np.argsort(h, kind="stable")
                s = h[order]
                first = np.concatenate([[True], s[1:] != s[:-1]]) if s.size else np.empty(0, bool)
                group = np.cumsum(first) - 1
                times = np.bincount(group) if s.size else np.empty(0, np.int64)
                single = (times == 1)[group] if s.size else np.empty(0, bool)
                indexed = np.bincount(group, weights=index[order]) > 0 if s.size else np.empty(0, bool)
                rows = []
                if (~single).any():
                    rows.append((chunk % buckets, DONE, chunk, np.sort(at[order[~single]]).astype("<u4").tobytes()))
                alone = np.sort(order[single])
                many = s[first][(times > 1) & indexed]
                for kind, hh, pp in ((INDEX, many, None), (BOTH, h[alone[index[alone]]], at[alone[index[alone]]]),
                                     (PROBE, h[alone[~index[alone]]], at[alone[~index[alone]]])):
                    order_, cuts = _by_bucket(hh, buckets)
                    low = hh[order_] & mask
                    places = None if pp is None else pp[order_]
                    for b in np.flatnonzero(np.diff(cuts)):
                        x, y = cuts[b], cuts[b + 1]
                        rows.append((int(b), kind, chunk, _body(low[x:y], None if places is None else places[x:y])))
                yield _entries(rows)

    def meet(batches):
        """Rows come by bucket, index entries first; probes stream past them."""
        now, index, own, values, counts = None, [], [], None, None

        def close_index():
            nonlocal values, counts
            every = index + [h for _, h, _ in own]
            values, counts = np.unique(np.concatenate(every), return_counts=True) if every else (np.empty(0, np.uint64), np.empty(0, int))
            return [(chunk, at[counts[_seen(values, h)] > 1].tobytes()) for chunk, h, at in own]

        for batch in batches:
            rows = []
            for bucket, kind, chunk, body in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if now is not None and values is None:
                        rows += close_index()
                    now, index, own, values = bucket, [], [], None
                if kind == INDEX:
                    index.append(_hash_of(body, 5, len(body) // 5))
                elif kind == BOTH:
                    n = len(body) // 9
                    own.append((chunk, _hash_of(body, 5, n), np.frombuffer(body, "<u4", n, 5 * n)))
                elif kind == PROBE:
                    if values is None:
                        rows += close_index()
                    n = len(body) // 9
                    rows.append((chunk, np.frombuffer(body, "<u4", n, 5 * n)[_seen(values, _hash_of(body, 5, n)) >= 0].tobytes()))
                else:
                    rows.append((chunk, body))
            yield _found([r for r in rows if r[1]])
        if now is not None and values is None:
            yield _found([r for r in close_index() if r[1]])

    sent = chunks.select("chunk", "texts").mapInArrow(send, ENTRY)
    return settle(sent.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(meet, FOUND))


def gathered(chunks: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """Chunks with their found places: one row for each chunk, null where nothing was found."""
    buckets, texts = buckets_of(chunks), chunks.select("chunk", *columns)
    if buckets > parts(chunks.sparkSession):  # as many tasks as there are buckets, for the same reason
        texts, found = texts.repartition(buckets, "chunk"), found.repartition(buckets, "chunk")
    mine = found.groupBy("chunk").agg(F.collect_list("places").alias("places"))  # at most four bytes for each unit of the chunk
    # The places build the hash table and the texts stream past it, at every size.
    return texts.join(mine.hint("shuffle_hash"), "chunk", "left")


def places_of(bodies: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(bodies or ()), "<u4").astype(np.int64)


def cover(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of ``size`` units lie in a window of ``width`` that starts at one of these places."""
    edge = np.zeros(size + width + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:size] > 0


def repeats(chunks: DataFrame, found: DataFrame, packed: Callable, width: int, window: int, keep_first: bool) -> DataFrame:
    """Starts (chunk, places) of windows whose content also starts elsewhere.

    With ``keep_first`` the earliest start of each content, by key and then place, is not returned; null
    keys come last. Candidates are the windows that hold one of the found anchors.
    """
    buckets = buckets_of(chunks)

    def send(batches):
        for batch in batches:
            for chunk, keys, texts, bodies in zip(*(c.to_pylist() for c in batch.columns)):
                if not bodies:
                    continue
                own = packed(texts)
                last = own.units.size - window + 1
                if last <= 0:
                    continue
                at = places_of(bodies)
                # A window [p, p + window) holds the anchor [q, q + width) if q + width - window <= p <= q.
                reach = window - width + 1
                near = np.zeros(own.units.size + reach + 1, np.int32)
                np.add.at(near, np.maximum(at - reach + 1, 0), 1)
                np.add.at(near, at + 1, -1)
                at = np.flatnonzero((np.cumsum(near)[:last] > 0) & own.inside(window))
                a, b = rolling(own.units, window, ROLL[0])[at], rolling(own.units * np.uint64(ROLL[1]) ^ own.units >> np.uint64(29), window, ROLL[1])[at]
                doc = np.searchsorted(own.bounds, at, "right") - 1
                rank = np.array([(1 << 63) - 1 if k is None else k for k in keys], np.int64)[doc]
                order = np.lexsort((at, rank, b, a))
                sa, sb = a[order], b[order]
                first = np.concatenate([[True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])]) if sa.size else np.empty(0, bool)
                group = np.cumsum(first) - 1
                times = np.bincount(group) if sa.size else np.empty(0, np.int64)
                heads = order[first]
                if keep_first:
                    done = at[order[~first]]
                else:
                    done = at[order[(times > 1)[group]]] if sa.size else at
                rows = []
                if done.size:
                    rows.append((chunk % buckets, DONE, chunk, done.astype("<u4").tobytes()))
                order_, cuts = _by_bucket(a[heads], buckets)
                heads = heads[order_]
                for k in np.flatnonzero(np.diff(cuts)):
                    x = heads[cuts[k]:cuts[k + 1]]
                    body = a[x].astype("<u8").tobytes() + b[x].astype("<u8").tobytes() + at[x].astype("<u4").tobytes()
                    rows.append((int(k), BOTH, chunk, body + rank[x].astype("<i8").tobytes() if keep_first else body))
                yield _entries(rows)

    def meet(batches):
        now, held = None, []
        wide = 28 if keep_first else 20

        def close():
            if not held:
                return
            n = [len(body) // wide for _, body in held]
            a = np.concatenate([np.frombuffer(body, "<u8", k) for (_, body), k in zip(held, n)])
            b = np.concatenate([np.frombuffer(body, "<u8", k, 8 * k) for (_, body), k in zip(held, n)])
            at = np.concatenate([np.frombuffer(body, "<u4", k, 16 * k) for (_, body), k in zip(held, n)])
            chunk = np.repeat(np.array([c for c, _ in held]), n)
            rank = np.concatenate([np.frombuffer(body, "<i8", k, 20 * k) for (_, body), k in zip(held, n)]) if keep_first else chunk
            order = np.lexsort((at, chunk, rank, b, a))
            same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
            again = np.concatenate([[False], same])
            if not keep_first:
                again[:-1] |= same
            pick = order[again]
            by = np.argsort(chunk[pick], kind="stable")
            owners, cuts = np.unique(chunk[pick][by], return_index=True)
            for owner, x, y in zip(owners.tolist(), cuts, [*cuts[1:], pick.size]):
                yield owner, at[pick[by[x:y]]].astype("<u4").tobytes()

        for batch in batches:
            rows = []
            for bucket, kind, chunk, body in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    rows += close()
                    now, held = bucket, []
                if kind == DONE:
                    rows.append((chunk, body))
                else:
                    held.append((chunk, body))
            yield _found(rows)
        yield _found(list(close()))

    sent = gathered(chunks, found, "keys", "texts").mapInArrow(send, ENTRY)
    return settle(sent.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(meet, FOUND))
