"""Token files by Re-Pair: frequent pairs of ids become nonterminals, shard by shard.

A token file is a Parquet folder with one row per shard, in ascending order of the key:

    part, shard      the writing task and the shard's place in it; (part, shard) follows the key's order
    keys, n_tokens   the documents of the shard and their token counts, end id included
    base             ids below it are tokens, the others are nonterminals base, base + 1, ...
    left, right      little-endian unsigned 32-bit symbols of each nonterminal's rule
    lengths          little-endian unsigned 32-bit count of the tokens that each nonterminal expands to
    low, high        the compressed sequence: low 16 and high 8 bits of each symbol

A document is found by adding up the lengths of the symbols before it, so it can be decoded alone. A
shard ends after the document that fills it, so memory is bounded by a shard and its last document.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from geoloom.llm.common import Memo, named
from geoloom.session import settle

SHARD = "part int, shard int, keys array<bigint>, n_tokens array<bigint>, base int, left binary, right binary, lengths binary, low binary, high binary"
SYMBOLS = 1 << 24

# Words of these characters take the short way: they need no normalisation but lower case, and for them the
# pre-tokeniser of the file is the pattern below. All other words pass through the whole tokenizer.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class WordBpe:
    """Ids of a text by a tokenizer whose pre-tokens never hold white space, word by word.

    Equal words have equal ids wherever they stand, so each word is encoded once while it is remembered.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from geoloom.llm.byte_bpe import byte_letters

        self.full = Tokenizer.from_str(data.decode())
        self.model = self.full.model
        self.base = self.full.get_vocab_size(with_added_tokens=True)
        self.letters = str.maketrans({chr(b): letter for b, letter in enumerate(byte_letters())})
        self.pieces = Memo(self._piece)
        self.words = Memo(self._word)

    def _piece(self, piece: str) -> bytes:
        # Printable ASCII bytes are their own letters.
        mapped = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if word.isalpha() and word.isascii():  # one piece, remembered as a word
            return self._piece(word.lower())
        if PLAIN.fullmatch(word) and "<|" not in word:
            parts = SPLIT.findall(word.lower())
            return self.pieces[parts[0]] if len(parts) == 1 else b"".join(map(self.pieces.__getitem__, parts))
        return np.array(self.full.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[bytes, WordBpe] = {}


def encoder(data: bytes) -> WordBpe:
    key = hashlib.sha1(data).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = WordBpe(data)
    return _ENCODERS[key]


def compress(ids: np.ndarray, base: int, rounds: int = 6, least: int = 4):
    """(sequence, left, right, lengths) of a grammar for the ids.

    A round counts all neighbouring pairs (hashed, in one counting pass), lets each place keep its pair
    where no overlapping pair is more frequent, and replaces every pair that then stands in at least
    ``least`` places. Counts only choose rules; any choice decodes to the same ids.
    """
    seq = ids.astype(np.int64)
    lengths = np.ones(base, np.int64)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    bits = max(10, min(22, int(seq.size).bit_length()))
    for _ in range(rounds):
        if seq.size < 2 * least:
            break
        code = seq[:-1] << 24 | seq[1:]
        slot = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        rank = np.bincount(slot, minlength=1 << bits)[slot]
        rank[rank < least] = 0
        rank = np.where(rank > 0, rank << bits | slot, 0)
        # Places of equal rank side by side (a run of one id) take every second place.
        starts = np.concatenate([[0], np.flatnonzero(rank[1:] != rank[:-1]) + 1])
        level = np.concatenate([[-1], rank[starts], [-1]])
        top = (level[1:-1] > 0) & (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
        sizes = np.diff(np.append(starts, rank.size))[top]
        starts, sizes = starts[top], (sizes + 1) // 2
        at = np.repeat(starts - 2 * (np.cumsum(sizes) - sizes), sizes) + 2 * np.arange(sizes.sum())
        pairs, which, times = np.unique(code[at], return_inverse=True, return_counts=True)
        good = times >= least
        if len(lengths) + good.sum() > SYMBOLS:
            break
        good_at = good[which]
        at, which = at[good_at], (np.cumsum(good) - 1)[which[good_at]]
        pairs = pairs[good]
        if at.size * 50 < seq.size:
            break
        a, b = pairs >> 24, pairs & (SYMBOLS - 1)
        seq[at] = len(lengths) + which
        gone = np.ones(seq.size, bool)
        gone[at + 1] = False
        seq = seq[gone]
        left.append(a)
        right.append(b)
        lengths = np.concatenate([lengths, lengths[a] + lengths[b]])
    return seq, np.concatenate(left), np.concatenate(right), lengths[base:]


def expand(seq: np.ndarray, base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Replace nonterminals by their rules until only tokens are left: one pass for each level of rules."""
    while (deep := seq >= base).any():
        out = np.repeat(seq, 1 + deep)
        at = (np.cumsum(1 + deep) - 1 - deep)[deep]
        out[at], out[at + 1] = left[seq[deep] - base], right[seq[deep] - base]
        seq = out
    return seq


class Shard:
    """One row of a token file."""

    def __init__(self, row: dict):
        u4 = lambda name: np.frombuffer(row[name], "<u4").astype(np.int64)
        self.base, self.left, self.right = row["base"], u4("left"), u4("right")
        self.seq = np.frombuffer(row["low"], "<u2").astype(np.int64) | np.frombuffer(row["high"], np.uint8).astype(np.int64) << 16
        lengths = u4("lengths")
        wide = np.ones(self.seq.size, np.int64)
        deep = self.seq >= self.base
        wide[deep] = lengths[self.seq[deep] - self.base]
        self.ends = np.cumsum(wide)
        self.bounds = np.concatenate([[0], np.cumsum(np.array(row["n_tokens"], np.int64))])

    def all(self) -> np.ndarray:
        return expand(self.seq, self.base, self.left, self.right)

    def document(self, k: int) -> np.ndarray:
        """The ids of one document, from the symbols that cover it alone."""
        start, stop = self.bounds[k], self.bounds[k + 1]
        first, last = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left")
        part = expand(self.seq[first:last + 1], self.base, self.left, self.right)
        skip = start - (self.ends[first - 1] if first else 0)
        return part[skip:skip + stop - start]


def write_tokens(docs: DataFrame, path: str, tokenizer: bytes, key: str = "doc_id", text: str = "text", end_id: int = 1,
                 shard_tokens: int = 1 << 20, rounds: int = 6) -> None:
    """Write the ids of every whole text, each ended by ``end_id``, as a token file in ascending key order.

    ``tokenizer`` is the content of a tokenizer file. Null texts are empty (the end id alone), null keys
    come first, repeated rows all stay, and an empty table gives a file without shards.
    """
    def shards(batches):
        work, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, number = TaskContext.get().partitionId(), 0
        keys, counts, held, size = [], [], [], 0

        def close():
            nonlocal number, keys, counts, held, size
            seq, left, right, lengths = compress(np.frombuffer(b"".join(held), "<u4"), work.base, rounds)
            u4 = lambda a: a.astype("<u4").tobytes()
            row = {"part": part, "shard": number, "keys": keys, "n_tokens": counts, "base": work.base, "left": u4(left), "right": u4(right),
                   "lengths": u4(lengths), "low": (seq & 0xFFFF).astype("<u2").tobytes(), "high": (seq >> 16).astype(np.uint8).tobytes()}
            number, keys, counts, held, size = number + 1, [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = work.encode(t or "") + end
                keys.append(k)
                counts.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
                if size >= shard_tokens:
                    yield close()
        if keys:
            yield close()

    i4, i8, raw = pa.int32(), pa.int64(), pa.binary()
    schema = pa.schema([("part", i4), ("shard", i4), ("keys", pa.list_(i8)), ("n_tokens", pa.list_(i8)), ("base", i4), ("left", raw),
                        ("right", raw), ("lengths", raw), ("low", raw), ("high", raw)])
    rows = docs.select(named(key).cast("long").alias("k"), named(text).alias("t"))
    rows.repartitionByRange("k").sortWithinPartitions("k").mapInArrow(shards, SHARD).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, keys: list[int] | None = None) -> DataFrame:
    """Decode a token file: key, start (ids of all documents before it), ids (little-endian, unsigned 32 bits).

    With ``keys`` only the shards that hold them are opened and only their own symbols expanded.
    """
    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                if keys is None:
                    ids = shard.all().astype("<u4")
                    pick, out = range(len(row["keys"])), [ids[a:b].tobytes() for a, b in zip(shard.bounds[:-1], shard.bounds[1:])]
                else:
                    pick = [k for k, x in enumerate(row["keys"]) if x in wanted]
                    out = [shard.document(k).astype("<u4").tobytes() for k in pick]
                yield pa.RecordBatch.from_arrays([pa.array([row["keys"][k] for k in pick], pa.int64()),
                                                  pa.array([row["start"] + int(shard.bounds[k]) for k in pick], pa.int64()), pa.array(out, pa.binary())],
                                                 ["key", "start", "ids"])

    wanted = set(keys or ())
    stored = spark.read.parquet(path)
    sizes = stored.select("part", "shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # Two levels: shards within their writing task, and one row for each task.
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its true size decides whether the shards stay in place or meet it by a shuffle.
    starts = settle(sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(tasks, "part")
                    .select("part", "shard", (F.col("before") + F.col("inside")).alias("start")))
    if keys is not None:
        stored = stored.where(F.arrays_overlap("keys", F.array(*[F.lit(k).cast("long") for k in keys])) if keys else F.lit(False))
    return stored.join(starts, ["part", "shard"]).mapInArrow(documents, "key bigint, start bigint, ids binary")
