"""Ordered work equals plain windows, also when one key holds most rows and spans many blocks."""

import random

import pytest
from pyspark.sql import Window, functions as F

from geoloom.operators import ordered as O
from geoloom.operators.graph import components
from geoloom.operators.quality import audit_verdict


def hot(spark, n=4000):
    rnd = random.Random(5)
    keys = [0] * (n // 3) + [rnd.randrange(1, 60) for _ in range(n - n // 3)]
    return spark.createDataFrame([(k, i, float(rnd.randrange(100))) for i, k in enumerate(keys)], "k int, i int, v double")


def test_row_number_across_blocks(spark):
    df = hot(spark)
    got = O.block_row_number(df, ["k"], ["i"], F.floor(F.col("i") / 50), "rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("i")).cast("long"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_running_sum_across_blocks(spark):
    df = hot(spark)
    got = O.block_running_sum(df, ["k"], ["i"], F.col("v"), F.floor(F.col("i") / 50), "s", inclusive=True)
    want = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("i")))
    assert sorted(got.collect()) == sorted(want.collect())


def test_pairs_open_and_closed(spark):
    df = spark.createDataFrame([("a", i, 3, i * 10) for i in range(3)], "k string, idx int, n int, v int")
    line = O.pair_up(df, ["k"], "idx", ["v"]).select("v0", "v1").collect()
    ring = O.pair_up(df, ["k"], "idx", ["v"], size="n").select("v0", "v1").collect()
    assert sorted(map(tuple, line)) == [(0, 10), (10, 20)]
    assert sorted(map(tuple, ring)) == [(0, 10), (10, 20), (20, 0)]


def test_links_chain_and_cycle(spark):
    chain = [("p", i, i + 1 if i < 9 else None) for i in range(10)]
    cycle = [("c", i, (i + 1) % 7) for i in range(7)]
    df = spark.createDataFrame(chain + cycle, "k string, arc long, nxt long")
    rows = {(r.k, r.arc): r for r in O.rank_links(df, ["k"], 10).collect()}
    assert all(rows["p", i].hops == 9 - i and rows["p", i].tail == 9 for i in range(10))
    assert all(rows["c", i].tail is None and rows["c", i].low == 0 for i in range(7))


def test_first_rows_over_ranges(spark):
    df = hot(spark).repartition(7)
    for limit in (1, 999, 2500, 4000, 9000):
        got, left = O.first_rows(df, ["v", "i"], limit)
        want = [r.i for r in df.orderBy("v", "i").collect()]
        assert sorted(r.i for r in got.collect()) == sorted(want[:limit]) and sorted(r.i for r in left.collect()) == sorted(want[limit:])


def test_a_place_that_comes_twice_is_an_error(spark):
    df = spark.createDataFrame([("w", 0, 1.0), ("w", 1, 2.0), ("w", 1, 3.0), ("w", 2, 4.0)], "k string, i long, v double")
    with pytest.raises(Exception, match="a place comes twice"):
        O.pair_up(df, ["k"], "i", ["v"]).collect()


def test_top_of_a_hot_key(spark):
    df = hot(spark)
    got = O.top_per_key(df, ["k"], ["v", "i"], 20, "place", salts=4)
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("v", "i"))).where("place <= 20")
    assert sorted(got.collect()) == sorted(want.collect())


def test_components_of_long_paths_and_hubs(spark):
    """A path whose ids rise along it, one in a mixed order, a hub, and a node that is linked to itself alone."""
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i * 37 % 101, 1000 + (i + 1) * 37 % 101) for i in range(100)] + [(5000, 5000 + i) for i in range(1, 60)] + [(9000, 9000)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {n: 0 for n in range(201)} | {1000 + n: 1000 for n in range(101)} | {5000 + n: 5000 for n in range(60)} | {9000: 9000}
    assert {r.node: r.label for r in got} == want and len(got) == len(want)


def test_audit_verdict(spark):
    rows = spark.createDataFrame([("edges", 0), ("nodes", 0)], "metric string, problems long")
    state = lambda df, partial=False: audit_verdict(df, partial).first().state
    assert (state(rows), state(rows, True), state(rows.withColumn("problems", F.lit(2)))) == ("ok", "partial", "problems")


def test_list_ranking_by_contraction_equals_doubling(spark):
    import random

    rng, rows, want = random.Random(2), [], {}
    for g in range(6):
        ids = rng.sample(range(10_000), 400)
        while ids:
            n = min(len(ids), rng.choice([1, 2, 3, 7, 60, 300]))
            part, ids = ids[:n], ids[n:]
            ring = rng.random() < 0.4
            rows += [(g, a, part[(i + 1) % n] if ring or i + 1 < n else None) for i, a in enumerate(part)]
            for i, a in enumerate(part):
                want[g, a] = (min(part), None, None) if ring else (min(part[i:]), part[-1], n - 1 - i)
    links = spark.createDataFrame(rows, "g int, arc long, nxt long")
    for most in (0, 512):  # contraction, doubling
        got = {(r.g, r.arc): (r.low, r.tail, r.hops if r.tail is not None else None) for r in O.rank_links(links, ["g"], 400, most).collect()}
        assert got == want
    assert O.rank_links(links.limit(0), ["g"], 400).collect() == []
