"""License scan: an exact set-similarity join of text blocks with license notices.

A block is 64 consecutive words of a text, from every 32nd word on, so any 33 neighbouring words lie in one; with longer notices stride and
block grow, so that the longest notice always lies in one block. A
notice is found in a block that holds at least ``threshold`` of its different words, and a notice of up to ``WHOLE`` words only in one that holds
them all, as one word may tell it from another license. Words are ordered by how many
documents hold them, over all documents, and the join compares as little as that order allows:

* prefix: a block and a notice with o common words share one of the first |block| - o + 1 of the block's words and
  of the first |notice| - o + 1 of the notice's, rarest first;
* length: a block with fewer than o words of the notices' vocabulary is not sent at all;
* position: the words after the shared one must suffice for o.

What passes is verified by intersection. Notices are parameters and few, so their side is broadcast.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.common import named
from geoloom.session import settle

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of a text whose A-Z are in lower case
STRIDE, WHOLE, MOST_WORDS = 32, 8, 30_000
# Phrases that are found word by word, and their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Notices by label: short public sentences of common licenses (fixed values).
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
SCAN = ("row bigint, key bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, held array<smallint>, "
        "blocks array<struct<block:int,words:array<smallint>>>")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


class Vocabulary:
    """The different words of all notices and phrases, and each notice as a set of them."""

    def __init__(self, notices, threshold: float):
        sets = [(label, sorted({*words_of(text)})) for label, text in notices]
        if any(not words for _, words in sets):
            raise ValueError("a notice needs a word")
        self.phrases = [(label, words_of(phrase)) for phrase, label in PHRASES]
        self.words = sorted({w for _, ws in sets for w in ws} | {w for _, ws in self.phrases for w in ws})
        self.id = {w: i for i, w in enumerate(self.words)}
        self.sets = [(label, [self.id[w] for w in ws]) for label, ws in sets]
        self.needs = [len(ws) if len(ws) <= WHOLE else max(1, math.ceil(threshold * len(ws) - 1e-9)) for _, ws in sets]
        # Any stride + 1 neighbouring words lie in a block of two strides.
        self.stride = max(STRIDE, *(len(words_of(text)) for _, text in notices))
        if len(self.words) > MOST_WORDS:
            raise ValueError(f"the notices have {len(self.words)} different words; at most {MOST_WORDS} are searched at once")
        self.in_notices = np.zeros(len(self.words) + 1, bool)
        self.in_notices[[i for _, ws in self.sets for i in ws]] = True


def scan(docs: DataFrame, vocabulary: Vocabulary, key: str, text: str) -> DataFrame:
    """One row per document: word counts, phrase places, its notice words, and the blocks that are long enough."""
    known, phrases, flag, least = vocabulary.id, vocabulary.phrases, vocabulary.in_notices, min(vocabulary.needs)
    phrases = [(label, [known[w] for w in ws]) for label, ws in phrases]
    size, stride = len(known), vocabulary.stride

    def one(text: str):
        ids = list(map(known.get, WORD.findall(text.encode().lower()), repeat(-1)))
        w = np.array(ids, np.int16)
        found, labels = [], []
        for label, phrase in phrases:
            n = w.size - len(phrase) + 1
            if n > 0:
                ok = w[:n] == phrase[0]
                for k, x in enumerate(phrase[1:], 1):
                    ok &= w[k:n + k] == x
                if ok.any():
                    labels.append(label)
                    found.append(np.flatnonzero(ok))
        at = np.flatnonzero(flag[w]) if w.size else np.empty(0, int)
        blocks, held = [], []
        if at.size:
            # A word lies in the block of its stride and in the one before.
            home = at // stride
            pairs = np.unique(np.concatenate([home, np.maximum(home - 1, 0)]) * size + np.concatenate([w[at], w[at]]))
            block, word = pairs // size, pairs % size
            heads, starts, n = np.unique(block, return_index=True, return_counts=True)
            held = np.unique(word).tolist()
            blocks = [{"block": int(heads[k]), "words": word[starts[k]:starts[k] + n[k]].tolist()} for k in np.flatnonzero(n >= least).tolist()]
        places = np.concatenate(found) if found else None
        return (w.size, 0 if places is None else places.size, None if places is None else int(places.min()), None if places is None else int(places.max()),
                ",".join(sorted(set(labels))), held, blocks)

    i8 = pa.int64()
    kinds = [i8, i8, i8, i8, pa.string(), pa.list_(pa.int16()), pa.list_(pa.struct([("block", pa.int32()), ("words", pa.list_(pa.int16()))]))]
    names = [part.split()[0] for part in ("row", "key", "n_words", "n_base", "first_word", "last_word", "base_labels", "held", "blocks")]

    def scanned(batches):
        for batch in batches:
            rows = list(zip(*(one(t or "") for t in batch.column(2).to_pylist()))) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(list(c), kind) for c, kind in zip(rows, kinds)]], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), named(key).cast("long").alias("key"), named(text).alias("t"))
    return settle(rows.mapInArrow(scanned, SCAN))


def matches(scanned: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Every (row, block, label, share) where a block holds enough of a notice."""
    spark = scanned.sparkSession
    # How many documents hold each word: at most one number for each word of the notices.
    counts = {r["w"]: r["n"] for r in scanned.select(F.explode("held").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(range(len(vocabulary.words)), key=lambda i: (counts.get(i, 0), i))
    rank = {word: r for r, word in enumerate(order)}
    prefix = []
    for number, ((label, words), need) in enumerate(zip(vocabulary.sets, vocabulary.needs)):
        ranks = sorted(rank[w] for w in words)
        prefix += [(r, number, label, p, len(ranks), need, ranks) for p, r in enumerate(ranks[:len(ranks) - need + 1])]
    # At most MOST_WORDS words of each notice; a side that is larger than Spark broadcasts by itself is joined by a shuffle.
    notices = (F.broadcast if sum(len(row[-1]) for row in prefix) <= 1_000_000 else lambda df: df)(spark.createDataFrame(prefix, "r int, notice int, label string, p int, size int, need int, ranks array<int>"))
    ranks = F.array(*[F.lit(rank[i]) for i in range(len(vocabulary.words))])
    blocks = scanned.select("row", F.explode("blocks").alias("b")).select(
        "row", "b.block", F.sort_array(F.transform("b.words", lambda w: F.get(ranks, w))).alias("mine"))
    least = min(vocabulary.needs)
    probes = blocks.select("row", "block", "mine", F.posexplode(F.slice("mine", F.lit(1), F.size("mine") - least + 1)).alias("q", "r"))
    close = probes.join(notices, "r").where(
        (F.size("mine") >= F.col("need")) & (F.col("q") <= F.size("mine") - F.col("need"))
        & (1 + F.least(F.col("size") - F.col("p"), F.size("mine") - F.col("q")) - 1 >= F.col("need")))
    common = close.withColumn("common", F.size(F.array_intersect("mine", "ranks"))).where("common >= need")
    # The same pair may meet in several words of both prefixes.
    return common.select("row", "block", "notice", "label", (F.col("common") / F.col("size")).alias("share")).distinct()


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", notices=NOTICES, threshold: float = 0.8) -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word, base_labels, labels, n_blocks, score.

    Words are runs of digits, letters and characters beyond ASCII after lower-casing A-Z. The base columns describe the
    places of PHRASES; ``labels`` adds those of the notices found, ``n_blocks`` counts pairs of block and notice, and ``score`` is
    the largest share of a notice found in a block, 1 where a phrase stands. Null texts are empty, very long ones are scanned whole; null keys and repeated rows
    stay; other columns are not read; an empty table gives no rows.
    """
    vocabulary = Vocabulary(notices, threshold)
    scanned = scan(docs, vocabulary, key, text)
    found = matches(scanned, vocabulary).groupBy("row").agg(F.collect_set("label").alias("found"), F.count(F.lit(1)).alias("n_blocks"), F.max("share").alias("share"))
    base = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    every = F.array_join(F.sort_array(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",")
    return scanned.drop("held", "blocks").join(found, "row", "left").select(
        "key", "n_words", "n_base", "first_word", "last_word", "base_labels", every.alias("labels"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
