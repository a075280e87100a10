"""Periodic runs, URL filter and divergence audit against plain Python and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import divergence, periodic_runs, url_filter
from geoloom.llm.queries import op11_periodic_runs, op12_url_filter, op13_source_divergence
from odd_rows import ODD

FOLDER = "/root/testdata/sf0.001"
ODD_PAIRS = [row[:2] for row in ODD]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(words):
    """Every maximal stretch of a period, smallest periods only."""
    number = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    best = {}
    for p in range(1, len(w) // 2 + 1):
        same = np.concatenate([[0], (w[:-p] == w[p:]).astype(int), [0]])
        edges = np.flatnonzero(np.diff(same))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= max(p, 12 - p):
                best.setdefault((a, b - a + p), p)
    return sorted((a, p, n) for (a, n), p in best.items())


def brute_row(key, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for a, p, m in runs for i in range(a + p, a + m)}
    length, start, period = min((-m, a, p) for a, p, m in runs) if runs else (None, None, None)
    length = -length if runs else None
    return (key, len(runs), start, length, period, 1000 * length // period if runs else None,
            sha("".join(f"{a},{m},{p}\n" for a, p, m in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def run_rows(df, key="doc_id"):
    return Counter((r[key], *[r[n] for n in NAMES]) for r in df.collect())


def test_runs_query(spark_text, documents):
    got = run_rows(op11_periodic_runs(spark_text, FOLDER))
    assert got == Counter(brute_row(k, t, True) for k, t in documents[1])
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_on_odd_rows(spark_text, odd, none):
    shuffled = odd.selectExpr("doc_id AS row", "text", "lang AS words", "source AS n", "n_chars")
    short = [(k, t) for k, t in ODD_PAIRS if not t or len(t) < 100_000]
    got = run_rows(periodic_runs.summary(periodic_runs.periodic_runs(shuffled, "row")), "key")
    assert sum(got.values()) == len(ODD)
    want = Counter(brute_row(k, t, False) for k, t in short)
    assert all(got[r] == n for r, n in want.items())
    (long,) = [r for r in got if r[0] == 10]
    assert long[1:5] == (1, 0, 30_000, 1)
    assert periodic_runs.summary(periodic_runs.periodic_runs(none)).collect() == []
    assert run_rows(periodic_runs.summary(periodic_runs.periodic_runs(periodic_runs.with_planted_periods(odd), "key")), "key").total() == len(ODD)


@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_in_random_words(spark_text, letters):
    rng, rows = random.Random(letters), []
    for k in range(60):
        words = [rng.choice("abcdefgh"[:letters]) for _ in range(rng.randrange(0, 400))]
        for _ in range(rng.randrange(3)):  # plant a run, whole periods or not
            p, m = rng.randrange(1, 120), rng.randrange(12, 900)
            part = [rng.choice("abcdefgh"[:letters]) + ("x" if letters > 2 else "") for _ in range(p)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [part[i % p] for i in range(m)]
        rows.append((k, " ".join(words)))
    got = run_rows(periodic_runs.summary(periodic_runs.periodic_runs(spark_text.createDataFrame(rows, "doc_id bigint, text string"))), "key")
    assert got == Counter(brute_row(k, t, False) for k, t in rows)


def test_z_function():
    rng = random.Random(0)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(30))]
        z = periodic_runs.z_function(s)
        assert all(z[i] == next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s)))


def test_runs_over_tile_borders():
    """A stretch of any period and place is found whole from its fragments."""
    rng = random.Random(5)
    for period in (1, 7, 8, 15, 16, 100, 257, 600):
        n = 9000
        words = list(range(10_000, 10_000 + n))
        start, length = rng.randrange(0, 2000), rng.randrange(2 * max(period, 6), 6000)
        for i in range(length):
            words[start + i] = i % period
        codes = np.array(words, np.int32)
        parts = sorted((at + a, at + b) for k, at, core, size, own in periodic_runs.tiles(codes) for p, a, b in periodic_runs.fragments(k, core, size, own) if p == period)
        assert parts[0][0] == start and max(b for _, b in parts) == start + length - period
        assert all(y[0] <= max(b for _, b in parts[:i + 1]) for i, y in enumerate(parts[1:]))


def url_models(examples, share=url_filter.SHARE, order=url_filter.ORDER):
    """Plain models: ratio(context of ``order`` symbols, symbol)."""
    counts = {c: [defaultdict(Counter) for _ in range(order + 1)] for c in ("allow", "block")}
    for action, symbols in examples:
        t = "^" * order + symbols + "$"
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts[action][k][t[i - k:i]][t[i]] += 1
    total = {c: sum(counts[c][0][""].values()) for c in counts}

    def kept(context):
        return not context or any(0 < (n := sum(counts[c][len(context)].get(context, {}).values())) and n >= share * total[c] for c in counts)

    def chance(c, context, s):
        if context and not kept(context):
            return chance(c, context[1:], s)
        low = chance(c, context[1:], s) if context else 1 / len(url_filter.SYMBOLS)
        own = counts[c][len(context)].get(context, {})
        n, t = sum(own.values()), len(own)
        return (own.get(s, 0) + t * low) / (n + t) if n else low

    def ratio(context, s):
        while not kept(context):
            context = context[1:]
        return round((np.log(chance("allow", context, s)) - np.log(chance("block", context, s))) * 1e6)

    return ratio


def test_url_scores_are_those_of_plain_models(spark_text):
    url = F.col("url")
    pages = spark_text.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", url, url_filter.host_of(url).alias("host"), url_filter.path_of(url).alias("path"))
    rows = [r.asDict() for r in url_filter.ruled(pages).collect()]
    norm = lambda u: re.sub(r"[^a-z0-9/.\-_?=&#%:~+@,]", "*", re.sub(r"(?s)^.*?://", "", u.lower()))
    fold = lambda u: int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % 5
    ratio = url_models([(r["action"], norm(r["url"])) for r in rows if r["action"] and fold(r["url"])])
    want = {}
    for r in rows:
        t = "^" * url_filter.ORDER + norm(r["url"]) + "$"
        sums = sum(ratio(t[i - url_filter.ORDER:i], t[i]) for i in range(url_filter.ORDER, len(t)))
        want[r["page_id"]] = (sums / (len(t) - url_filter.ORDER), r["action"])
    got = op12_url_filter(spark_text, FOLDER).collect()
    assert {r.page_id for r in got} == set(want)
    assert all(abs(r.score - want[r.page_id][0]) <= 2 for r in got)
    assert all(r.verdict == want[r.page_id][1] for r in got if r.rule)


def test_urls_of_odd_rows(spark_text):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?b#c", "https://a.b.net/es/1", "x://net/fr/", "x://y://z.com/", "http://com", "http://com/",
            "http://example.com/en", "http://sub.www.example.com/en/1", "http://notexample.com/en/", "http://example.com:80/en/", "http://h.net/es\n/x", "http://é.net/fr/" + "ü" * 50_000,
            "http://com?x/y", "http://com/en/"] * 2
    rows = [(i if i % 7 else None, u, "h") for i, u in enumerate(urls)]
    df = spark_text.createDataFrame(rows, "page_id bigint, url string, host string").repartition(3)
    got = url_filter.filter_urls(df.selectExpr("*", "1 AS rule", "2 AS row")).collect()
    assert len(got) == len(rows)

    def parts(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)), m[2]) if m else ("", "")
        fits = [(len(r), r, a) for a, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
        return host, path, max(fits)[1:] if fits else (None, None)

    want = Counter((k, h, p, rule, action) for k, u, _ in rows for h, p, (rule, action) in [parts(u)])
    assert Counter((r.key, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got) == want
    assert url_filter.filter_urls(df.limit(0)).collect() == []
    lone = url_filter.filter_urls(df.where("url LIKE 'x://y%'")).collect()
    assert {(r.verdict, r.score) for r in lone} <= {("allow", r.score) for r in lone}
    assert {r.verdict for r in url_filter.filter_urls(df, rules=()).collect()} == {"allow"}


def brute_audit(rows, least=10, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    upper = str.maketrans(url_filter.UPPER, url_filter.LOWER)
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        g = (lang or "", source or "")
        groups.add(g)
        own = Counter(term.findall((text or "").translate(upper)))
        counts[g].update(own)
        df[g[0]].update(own.keys())
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)
        chances = {}
        for s in [None, *sources]:
            own = Counter()
            for x in sources if s is None else [s]:
                own.update(counts[lang, x])
            total = sum(own[t] for t in kept) + 2 * len(kept)
            chances[s] = ({t: 1 + 10**9 * (own[t] + 2) // total for t in kept}, own)
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            p, own = chances[s]
            q = chances[None][0]
            pair = sorted((-sum(f(p[t], chances[o][0][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            single = sorted((-f(p[t], q[t]), t.encode(), t) for t in kept if own[t] and p[t] > q[t])[:top]
            out += [(lang, s, part, item, -v, i + 1) for part, each in (("pair", pair), ("term", single)) for i, (v, _, item) in enumerate(each)]
    return Counter(out)


def audit_rows(df):
    return Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_audit_query(spark_text, documents):
    rows = [tuple(r) for r in documents[0].collect()]
    got = audit_rows(op13_source_divergence(spark_text, FOLDER))
    assert got == brute_audit(rows) and any(r[2] == "term" for r in got)


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_audit_of_colliding_digests(spark_text, documents, bits):
    rows = [tuple(r) for r in documents[0].collect()][:120]
    df = spark_text.createDataFrame(rows, documents[0].schema).repartition(5)
    assert audit_rows(divergence.audit(df, bits=bits, least=4)) == brute_audit(rows, 4)


def test_audit_of_odd_rows(spark_text, odd, none):
    df = odd.withColumn("part", odd.text).withColumn("term", odd.text)
    assert audit_rows(divergence.audit(df)) == brute_audit(ODD)
    assert audit_rows(divergence.audit(df, least=1)) == brute_audit(ODD, 1)
    assert divergence.audit(none).collect() == []
