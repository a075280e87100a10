"""Scans, rules, classifier, mixture and the pipeline against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from geoloom.llm import license_scan, mixing, quality_gam, quality_rules
from geoloom.llm.queries import op1_license_scan, op3_quality_rules, op7_mixing, op9_quality_gam
from odd_rows import ODD

FOLDER = "/root/testdata/sf0.001"
ODD_PAIRS = [row[:2] for row in ODD]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))


def licenses(rows, threshold=0.8):
    out = []
    for key, text in rows:
        w = license_words(text or "")
        at, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i:i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        base, best, n = ",".join(sorted(labels)), 0.0, 0
        for start in range(0, max(len(w), 1), 32):
            block = set(w[start:start + 64])
            for label, notice in license_scan.NOTICES:
                need = set(license_words(notice))
                if len(need & block) >= (1 if len(need) <= 8 else threshold) * len(need) - 1e-9:
                    labels.add(label)
                    n += 1
                    best = max(best, len(need & block) / len(need))
        out.append((key, len(w), len(at), min(at, default=None), max(at, default=None), base, ",".join(sorted(labels)), n, 1.0 if at else best))
    return Counter(out)


def license_rows(df):
    return Counter((r[0], r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.n_blocks, r.score) for r in df.collect())


def test_license_query(spark_text, documents):
    got = license_rows(op1_license_scan(spark_text, FOLDER))
    assert got == licenses(documents[1])
    assert any(r[6] != r[5] for r in got)


def test_licenses_in_odd_rows(spark_text, odd, none):
    text = [n for _, n in license_scan.NOTICES]
    rows = ODD_PAIRS + [(50 + i, "filler " * (i * 13) + t.upper() + " tail" * 40) for i, t in enumerate(text)]
    rows += [(80 + i, " ".join(t.split()[1:]) + " x") for i, t in enumerate(text)]
    df = spark_text.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert license_rows(license_scan.scan_licenses(df.selectExpr("*", "text AS row", "1 AS labels"))) == licenses(rows)
    assert license_rows(license_scan.scan_licenses(df, threshold=0.5)) == licenses(rows, 0.5)
    assert license_scan.scan_licenses(none).collect() == []


def test_license_filter_loses_nothing_on_random_sets(spark_text):
    rng = np.random.default_rng(4)
    pool = [f"w{i}" for i in range(40)]
    notices = [(f"n{k}", " ".join(rng.choice(pool, rng.integers(1, 12), replace=False))) for k in range(15)]
    rows = [(i, " ".join(rng.choice(pool, rng.integers(0, 60)))) for i in range(80)]
    got = license_scan.scan_licenses(spark_text.createDataFrame(rows, "doc_id bigint, text string"), notices=notices, threshold=0.7).collect()
    for r in got:
        w = rows[r.key][1].split()
        want = {label for s in range(0, max(len(w), 1), 32) for label, n in notices if len({*n.split()} & {*w[s:s + 64]}) >= (1 if len({*n.split()}) <= 8 else 0.7) * len({*n.split()}) - 1e-9}
        assert set(filter(None, r.labels.split(","))) == want


def test_long_notices_and_near_names(spark_text):
    long = " ".join(f"n{i}" for i in range(80))
    rows = [(1, "x " * 50 + long + " y" * 9), (2, "Released under the Apache License"), (3, "Licensed under CC BY 4.0"), (4, "Licensed under CC BY-NC 4.0")]
    df = spark_text.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.key: r.labels for r in license_scan.scan_licenses(df, notices=(*license_scan.NOTICES, ("long", long))).collect()}
    assert got == {1: "long", 2: "apache", 3: "", 4: "cc-by-nc"}


def rules(rows):
    out = []
    for key, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
        n, chars, symbols, dups = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
        fails = [n < 50, 100 * len(again) > 50 * n, 100 * symbols > 20 * n, chars < 2 * n or chars > 15 * n, 100 * dups > 40 * len(lines), 100 * t.count("!") > 50 * n]
        bits = sum(f << k for k, f in enumerate(fails))
        out.append((key, n, chars, symbols, dups, len(again), bits & 3 != 0, bits == 0, bits))
    return Counter(out)


def rule_rows(df):
    return Counter((r[0], r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.failed_bits & 3 != 0, r.failed_bits == 0, r.failed_bits)
                   for r in df.collect())


def test_rules_query(spark_text, documents):
    df = op3_quality_rules(spark_text, FOLDER)
    assert rule_rows(df) == rules(documents[1])
    assert all(r.base_failed == (r.failed_bits & 3 != 0) and r.kept == (r.failed_bits == 0) for r in df.collect())


def test_rules_on_odd_rows(odd, none, spark_text):
    rows = quality_rules.ledger(odd.withColumnRenamed("source", "key").withColumnRenamed("lang", "w"))
    assert rule_rows(rows) == rules(ODD_PAIRS)
    assert quality_rules.ledger(none).collect() == []
    kept = quality_rules.filter_documents(odd.withColumnRenamed("lang", "row"), "base")
    assert kept.count() == sum(n for r, n in rules(ODD_PAIRS).items() if not r[8] & 3) and "row" in kept.columns


def test_ablation_counts_by_bits(spark_text):
    bits = [0, 0, 1, 3, 4, 4, 12, 32, 63]
    rows = spark_text.createDataFrame([(b,) for b in bits], "failed_bits bigint")
    got = {(r.policy, r.rule): (r.failing, r.rejected_alone, r.kept_without) for r in quality_rules.ablation(rows).collect()}
    for policy, names in quality_rules.POLICIES.items():
        m = quality_rules.mask(policy)
        for rule in names:
            b = 1 << quality_rules.RULES.index(rule)
            assert got[policy, rule] == (sum(x & b > 0 for x in bits), sum(x & m == b for x in bits), sum(x & m & ~b == 0 for x in bits))


def test_classifier_on_held_out_rows(spark_text):
    folder = "/root/testdata/sf0.1"
    rows = op9_quality_gam(spark_text, folder).toPandas().set_index("doc_id")
    labels = spark_text.read.parquet(f"{folder}/labels.parquet").toPandas().dropna().set_index("doc_id")
    assert len(rows) == 10_000 and rows.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in rows.iterrows())
    assert ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    out = rows[rows.held_out].join(labels, how="inner")
    good, bad = out.score[out.quality == 1].to_numpy(), out.score[out.quality == 0].to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2
    right = (out.predicted == out.quality).mean()
    print("held-out AUC", auc, "accuracy", right, "kept good", (good >= 0.3).mean(), "kept bad", (bad >= 0.3).mean())
    assert auc > 0.9 and right > 0.9


def test_classifier_never_sees_fold_0_or_other_columns(spark_text, documents):
    labels = spark_text.read.parquet(f"{FOLDER}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(CAST(doc_id AS STRING)), 5) = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    docs = documents[0]
    a = quality_gam.scored(docs, labels).select("key", "score").toPandas().sort_values("key").score.to_numpy()
    b = quality_gam.scored(docs.selectExpr("doc_id", "text", "'x' AS lang", "doc_id AS source"), turned).select("key", "score").toPandas().sort_values("key").score.to_numpy()
    assert np.array_equal(a, b)


def test_classifier_on_odd_rows(spark_text, odd, none):
    labels = spark_text.createDataFrame([(k, k % 2, 0) for k in range(1, 16)] + [(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality_gam.scored(odd.withColumnRenamed("source", "features"), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_gam.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_gam.scored(none, labels).collect() == []
    kept = quality_gam.keep_good(odd.withColumnRenamed("lang", "row").withColumnRenamed("source", "features"), labels, cut=0.0)
    assert kept.count() == len(ODD) and kept.columns == ["doc_id", "text", "row", "features", "n_chars"]


def test_gam_learns_a_pair(spark_text):
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality_gam.fit(x, y, rounds=20)
    assert (7, 3) in model.pairs
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.95


def test_mixture(spark_text, odd, none):
    df = odd.unionByName(spark_text.createDataFrame([(1000 + i, "t", "en", "hot" if i % 4 else "rare", 1) for i in range(4000)], odd.schema))
    rows = mixing.mix(df.withColumnRenamed("lang", "copy").withColumnRenamed("n_chars", "rate"), weights={"hot": 1.0, "rare": 1.0}).collect()
    n = Counter(r.source for r in rows)
    assert set(n) == {"hot", "rare"} and abs(n["hot"] / len(df.collect()) - 0.5) < 0.05 and abs(n["rare"] / len(df.collect()) - 0.5) < 0.05
    assert "copy" in rows[0].asDict() and "copy_" in rows[0].asDict()
    every = {}
    for r in rows:
        every.setdefault(r.doc_id, []).append((r.copy_, r.copies))
    assert all(sorted(c for c, _ in v) == list(range(v[0][1])) for v in every.values())
    assert mixing.mix(none).collect() == []
    assert mixing.mix(df).where("source IS NULL").count() in range(0, 60)


def test_poisson_inverse(spark_text):
    import pyspark.sql.functions as F

    rows = spark_text.range(2000).selectExpr("id", "(id + 0.5) / 2000 AS u", "CAST(pow(1.6, id % 12) - 0.9 AS DOUBLE) AS rate")
    for r in rows.withColumn("k", mixing.poisson_inverse(F.col("u"), F.col("rate"), 400)).collect():
        k, p = 0, math.exp(-r.rate)
        total = p
        while total < r.u:
            k += 1
            p *= r.rate / k
            total += p
        assert r.k == k


def test_mixture_query_shuffles_and_keeps_the_size(spark_text):
    rows = op7_mixing(spark_text, "/root/testdata/sf0.1").collect()
    assert abs(len(rows) / 10_000 - 1) < 0.05
    assert [r.shuffle_key for r in rows[:50]] == sorted(r.shuffle_key for r in rows[:50])


def test_pipeline_stages(spark_text, documents):
    from test_dedup import copies
    from test_near_dedup import similar_classes

    docs, names = documents[0], documents[0].columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        out = stage(spark_text, kept, FOLDER)
        rows = out.collect()
        if name.startswith("quality"):
            score = {r.doc_id: r.score for r in op9_quality_gam(spark_text, FOLDER).collect()}
            assert {r.doc_id for r in rows} == {k for k, s in score.items() if s >= 0.3}
        elif name.startswith("exact"):
            assert {r.doc_id for r in rows} == {best for _, best in copies(before.items()).values()}
        elif name.startswith("SimHash"):
            assert {r.doc_id for r in rows} == set(similar_classes(list(before.items())))
        elif name.startswith("mixing"):
            assert {r.doc_id for r in rows} <= set(before) and all(before[r.doc_id] == r.text for r in rows)
        else:
            import hashlib

            assert all(len(r.ids) == 4 * r.n_tokens and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in rows)
            assert Counter((r.doc_id, r.decoded_sha256) for r in rows) == Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in kept.collect())
            break
        assert out.columns == names and rows
        kept = spark_text.createDataFrame(rows, docs.schema)


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_on_odd_rows(spark_text, tmp_path, odd, none, rows):
    (odd if rows == "odd" else none).write.parquet(f"{tmp_path}/documents.parquet")
    spark_text.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert (corpus_pipeline.run(spark_text, str(tmp_path)).count() > 0) == (rows == "odd")
