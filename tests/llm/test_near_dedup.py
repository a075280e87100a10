"""The pipeline's near-dedup stage against exact five-word Jaccard similarity."""

import random

import pytest

import corpus_pipeline
from geoloom.llm import near_dedup
from odd_rows import ODD

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def similarity(a, b):
    x, y = near_dedup.shingles(a, 5), near_dedup.shingles(b, 5)
    return len(x & y) / len(x | y)


def similar_classes(rows, least=0.8):
    """The largest key of each component of similar texts; texts without words are one class."""
    sets = [(k, near_dedup.shingles(t or "", 5)) for k, t in rows]
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j, (_, y) in enumerate(sets[:i]):
            if (not x and not y) or (both := len(x & y)) >= least * (len(x) + len(y) - both) - 1e-9 and both:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    best = {}
    for i, (k, _) in enumerate(sets):
        best[find(i)] = max(best.get(find(i), k), k)
    return list(best.values())


def planted(rng, places):
    """A text and a copy with some of its words changed."""
    words = [f"w{rng.randrange(50_000)}" for _ in range(300)]
    other = list(words)
    for at in places:
        other[at] = "changed"
    return " ".join(words), " ".join(other)


def test_stage_removes_planted_copies_from_a_similarity_of_08(spark_text):
    rng, rows, near = random.Random(8), [], {}
    for k in range(200):
        a, b = planted(rng, range(5, 5 + 20 * (k % 9 + 1), 20))
        near[2 * k] = similarity(a, b) >= 0.8
        rows += [(2 * k, a, "en", "s", 1), (2 * k + 1, b, "en", "s", 1)]
    assert 50 < sum(near.values()) < 150
    out = corpus_pipeline.without_near_copies(spark_text, spark_text.createDataFrame(rows, SCHEMA), "")
    kept = {r.doc_id for r in out.collect()}
    assert kept == {k for k in range(400) if k % 2 or not near[k]}


@pytest.mark.parametrize("seed", [5, 100])
def test_classes_are_components_of_similar_pairs(spark_text, seed):
    rng, rows = random.Random(seed), []
    for g in range(6):  # chains: each text is close to the one before, the ends are not alike
        words = [f"g{g}w{rng.randrange(9999)}" for _ in range(200)]
        for _ in range(12):
            rows.append((len(rows), " ".join(words), "en", "s", 1))
            for _ in range(3):
                words[rng.randrange(200)] = f"x{rng.randrange(9999)}"
    df = spark_text.createDataFrame(rows, SCHEMA)
    assert {r.doc_id for r in near_dedup.one_of_each(df).collect()} == set(similar_classes([r[:2] for r in rows]))


def test_texts_that_share_most_passages_but_are_not_similar(spark_text):
    """Hundreds of texts meet under the same keys; near copies among them are still found, and no others."""
    rng, rows = random.Random(3), []
    shared = [f"s{i}" for i in range(150)]
    for _ in range(150):
        own = [f"o{rng.randrange(10**6)}" for _ in range(60)]
        rows.append((len(rows), " ".join(shared + own), "en", "s", 1))
        if rng.random() < 0.3:
            own[rng.randrange(60)] = "changed"
            rows.append((len(rows), " ".join(shared + own), "en", "s", 1))
    got = {r.doc_id for r in near_dedup.one_of_each(spark_text.createDataFrame(rows, SCHEMA)).collect()}
    assert got == set(similar_classes([r[:2] for r in rows])) and len(rows) - 60 < len(got) < len(rows)


def test_family_with_many_components_is_compared_by_few_pairs(spark_text, monkeypatch):
    """A text with slight and heavy changes: most texts share keys with all others, few are similar to one of another component."""
    rng, rows, made = random.Random(4), [], []
    base = [f"b{i}" for i in range(160)]
    for k in range(400):
        words = list(base)
        for at in rng.sample(range(160), rng.choice([1, 2, 3, 6, 8, 9])):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words), "en", "s", 1))
    real = near_dedup.verified

    def counted(pairs, *more):
        made.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(near_dedup, "verified", counted)
    got = {r.doc_id for r in near_dedup.one_of_each(spark_text.createDataFrame(rows, SCHEMA)).collect()}
    assert got == set(similar_classes([r[:2] for r in rows])) and 50 < len(got) < 350
    assert sum(made) < 10 * len(rows)


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_prefix_pairs_hold_every_similar_pair(spark_text, least):
    rng, texts = random.Random(6), []
    for g in range(8):
        base = [f"g{g}w{i % 50}" for i in range(rng.choice([4, 30, 90]))]
        for _ in range(12):
            words = [w if rng.random() < 0.96 else f"x{rng.randrange(40)}" for w in base][rng.randrange(4):]
            texts.append(" ".join(words) or "none")
    sets = [near_dedup.shingles(t, 5) for t in texts]
    sizes = spark_text.createDataFrame([(k, len(s)) for k, s in enumerate(sets)], "row long, n int")
    rows = spark_text.createDataFrame(list(enumerate(texts)), "row long, text string")
    fit = near_dedup.fitting(near_dedup.prefix_entries(sizes, rows, 5, least).selectExpr("*", "row div 2 AS root"))
    got = {(r.a, r.b) for r in near_dedup.prefix_pairs(fit.where("NOT largest").drop("largest"), fit).collect()}
    want = {(a, b) for b in range(len(texts)) for a in range(b) if a // 2 != b // 2 and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
    assert want <= got and want and all(a < b and a // 2 != b // 2 for a, b in got)


def test_row_numbers_of_a_table_as_read(spark_text, tmp_path, odd):
    from geoloom.llm.common import with_rows

    odd.withColumnRenamed("lang", "row").write.parquet(f"{tmp_path}/t")
    table = spark_text.read.parquet(f"{tmp_path}/t")
    one, two = (sorted(map(repr, with_rows(table, "row_", True).select("row_", "text").collect())) for _ in range(2))
    assert one == two and len({r.split(",")[0] for r in one}) == len(ODD)
    assert "_metadata" in with_rows(table, "row_", True)._jdf.queryExecution().toString()
    kept = [sorted(map(repr, near_dedup.one_of_each(t, as_read=True).collect())) for t in (table, odd.withColumnRenamed("lang", "row"))]
    assert kept[0] == kept[1]


def test_near_dedup_of_odd_rows(odd, none):
    out = near_dedup.one_of_each(odd.withColumnRenamed("lang", "row"))
    assert out.columns == ["doc_id", "text", "row", "source", "n_chars"]
    # 1, 2 and 3 have no words, 4 and 5 and the two rows of 7 are equal but for case.
    assert sorted(r.doc_id or 0 for r in out.collect()) == sorted({k or 0 for k, *_ in ODD} - {1, 2, 4})
    assert near_dedup.one_of_each(none).collect() == []
