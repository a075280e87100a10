"""Deduplication against plain Python on the smallest table and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from geoloom.llm import exact_dedup, line_dedup, runs, simhash, substring_dedup
from geoloom.llm.links import components
from geoloom.llm.queries import op4_line_dedup, op5_substring_dedup, op6_exact_dedup, op8_simhash
from odd_rows import ODD

FOLDER = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(f"[^{SPACES}]+", text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def passages(rows, window=35):
    """Multiset of (key, n_words, n_removed, kept hash)."""
    texts = [(k, words(t or "")) for k, t in rows]
    seen = Counter(tuple(w[i:i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for k, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((k, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return Counter(out)


def later_runs(rows, run=3):
    own = []
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (t or "").split("\n")
        own.append((k, lines, [i for i, x in enumerate(lines) if x.strip(SPACES)]))
    seen, out = set(), []
    for k, lines, full in own:
        units = [(i, lines[i], part) for i in full for part in range(min(run, 1 + len(words(lines[i])) // 10))]
        units += [(None, None, part) for part in range(run - len(units))] if units else []
        gone = set()
        for i in range(len(units) - run + 1):
            content = tuple(u[1:] for u in units[i:i + run])
            if content in seen:
                gone.update(u[0] for u in units[i:i + run])
            seen.add(content)
        gone.discard(None)
        out.append((k, len(full), len(gone), sha("\n".join(x for i, x in enumerate(lines) if i not in gone))))
    return Counter(out)


def plain(df):
    return Counter((r.key, r[1], r.n_removed, sha(r.kept)) for r in df.collect())


ODD_PAIRS = [row[:2] for row in ODD]
LONG = "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9 10".split()


def test_passage_query(spark_text, documents):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op5_substring_dedup(spark_text, FOLDER).collect())
    assert got == passages(documents[1]) and any(r[2] for r in got)


def test_passages_of_odd_rows(spark_text, odd, none):
    rows = ODD_PAIRS + [(20, " ".join(LONG[:35])), (21, "zz " + " ".join(LONG[:35]) + " yy"), (22, " ".join(LONG[1:36])), (23, " ".join(LONG[:34])),
                        (24, " ".join(LONG * 2)), (25, " ".join(["r"] * 36)), (26, "\t".join(LONG[1:36]))]
    df = spark_text.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert plain(substring_dedup.remove_repeats(df.selectExpr("*", "text AS kept", "1 AS chunk"))) == passages(rows)
    assert substring_dedup.remove_repeats(none).collect() == []


@pytest.mark.parametrize("size", [1, 200, 1 << 20])
def test_passages_do_not_depend_on_chunks(spark_text, monkeypatch, size):
    rng = np.random.default_rng(size)
    parts = [" ".join(map(str, rng.integers(0, 5, 20))) for _ in range(6)]
    rows = [(i, " ".join(parts[j] for j in rng.integers(0, 6, rng.integers(0, 6)))) for i in range(60)]
    pack = runs.pack
    monkeypatch.setattr(runs, "pack", lambda docs, key, text: pack(docs, key, text, size))
    df = spark_text.createDataFrame(rows, "doc_id bigint, text string")
    assert plain(substring_dedup.remove_repeats(df)) == passages(rows)
    assert plain(substring_dedup.remove_repeats(df, window=8)) == passages(rows, 8)
    lines = [(i, t.replace(" 3", "\n3")) for i, t in rows]
    assert plain(line_dedup.remove_later_runs(spark_text.createDataFrame(lines, "doc_id bigint, text string"))) == later_runs(lines)


def test_line_query(spark_text, documents):
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in op4_line_dedup(spark_text, FOLDER).collect())
    assert got == later_runs(documents[1]) and any(r[2] for r in got)


def test_lines_of_odd_rows(spark_text, odd, none):
    assert plain(line_dedup.remove_later_runs(odd)) == later_runs(ODD_PAIRS)
    assert sum(r.n_removed for r in line_dedup.remove_later_runs(odd).collect() if r.key == 14) == 9
    assert line_dedup.remove_later_runs(none).collect() == []


def copies(rows):
    groups = defaultdict(list)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for k, t in rows:
        groups[(t or "").translate(lower)].append(k)
    out = {}
    for t, keys in groups.items():
        best = max((k for k in keys if k is not None), default=None)
        out[sha(t)] = (len(keys), best)
    return out


def test_copy_query(spark_text, documents):
    want = copies(documents[1])
    for r in op6_exact_dedup(spark_text, FOLDER).collect():
        assert (r.group_size, r.keep_id) == want[r.text_sha256] and r.kept == (r.doc_id == r.keep_id)


def test_copies_of_odd_rows(spark_text, odd, none):
    many = odd.unionByName(spark_text.createDataFrame([(100 + i, "SAME" if i % 2 else "same", "en", "h", 4) for i in range(900)], odd.schema))
    want = copies(ODD_PAIRS + [(100 + i, "same") for i in range(900)])
    for support in (1 / 512, 0.5):
        rows = exact_dedup.exact_duplicates(many.withColumnRenamed("lang", "key").withColumnRenamed("source", "row"), support=support).collect()
        assert len(rows) == len(ODD) + 900
        for r in rows:
            assert (r.group_size, r.keep_id) == want[r.text_sha256]
        assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(want.keys())  # one of each, ties and nulls too
    kept = exact_dedup.drop_duplicates(many.withColumnRenamed("lang", "row"))
    assert kept.count() == len(want) and kept.columns == ["doc_id", "text", "row", "source", "n_chars"]
    assert exact_dedup.exact_duplicates(none).collect() == [] and exact_dedup.drop_duplicates(none).collect() == []


def print_of(text):
    w = [x.encode().lower() for x in words(text)]
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams)
        out |= (2 * ones > len(grams)) << bit
    return out


def classes(rows):
    prints = [print_of(t or "") for _, t in rows]
    label = list(range(len(rows)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                label[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return Counter((k, f"{p:016x}", least.get(find(i))) for i, ((k, _), p) in enumerate(zip(rows, prints)))


def test_near_query(spark_text, documents):
    got = Counter(tuple(r) for r in op8_simhash(spark_text, FOLDER).select("doc_id", "fingerprint", "component_id").collect())
    assert got == classes(documents[1])


def test_near_odd_rows(spark_text, odd, none):
    got = Counter((r.key, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(odd.withColumn("fp", odd.source)).collect())
    assert got == classes(ODD_PAIRS)
    assert simhash.near_duplicates(none).collect() == []


@pytest.mark.parametrize("most", [3, 1500])
def test_links_hold_all_components(spark_text, most):
    rng = np.random.default_rng(most)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [base]
    for _ in range(12):  # chains and dense balls of one to four changed bits
        flips = np.zeros(40, np.uint64)
        for _ in range(rng.integers(1, 5)):
            flips ^= np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)
        near.append(near[rng.integers(0, len(near))] ^ flips)
    prints = np.unique(np.concatenate(near)).view(np.int64)
    got = components(simhash.links(spark_text.createDataFrame([(int(p),) for p in prints], "fp bigint"), most=most)).collect()
    root = {r.node: r.root for r in got}
    mine = defaultdict(set)
    for p in prints.tolist():
        mine[root.get(p, p)].add(p)
    u = prints.view(np.uint64)
    pairs = np.argwhere(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2, 1))
    label = list(range(len(u)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i, j in pairs:
        label[find(int(i))] = find(int(j))
    want = defaultdict(set)
    for i, p in enumerate(prints.tolist()):
        want[find(i)].add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_path(spark_text):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (5000, 5000)]
    got = components(spark_text.createDataFrame(edges, "a bigint, b bigint")).collect()
    roots = defaultdict(set)
    for r in got:
        roots[r.root].add(r.node)
    assert sorted(map(len, roots.values())) == [2, n + 1]


def test_long_lines_and_short_documents_are_found_alone(spark_text):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(k, f"own {k}\n{long}\nown too {k}") for k in range(5)] + [(10 + k, "a short document") for k in range(5)] + [(20, "a short document\nand more")]
    rows += [(30 + k, f"x{k}\n" + " ".join(f"p{i}" for i in range(12)) + "\n" + " ".join(f"q{i}" for i in range(12))) for k in range(3)]
    df = spark_text.createDataFrame(rows, "doc_id bigint, text string")
    assert plain(line_dedup.remove_later_runs(df)) == later_runs(rows)
    got = {r.key: r.n_removed for r in line_dedup.remove_later_runs(df).collect()}
    assert [got[k] for k in range(5)] == [0, 1, 1, 1, 1] and [got[10 + k] for k in range(5)] == [0, 1, 1, 1, 1] and got[20] == 0
    assert [got[30 + k] for k in range(3)] == [0, 2, 2]
