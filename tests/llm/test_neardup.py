import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import neardup as N
from tessera.llm.components import components


def brute(rows, t=0.8):
    """(doc_id, class, links) by comparing all pairs of sets of words."""
    table = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
    sets = []
    for _, text in rows:
        w = (text or "").encode().translate(table).split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    links, parent = Counter(), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    name = {i: min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(rows))}
    return sorted(((rows[i][0], name[i], links[i]) for i in range(len(rows))), key=str)


def variants(r, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = r.choice("uvwxyz")
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for g in range(14):
        base = [f"{g}w{r.randint(0, 40)}" for _ in range(r.choice([3, 6, 30, 80]))]
        out += variants(r, base, r.choice([1, 2, 5, 30]), 3)
    out += ["one two", "One, two!", "three", "", None, out[0], out[0]]
    return list(enumerate(out))


@pytest.mark.parametrize("settings", [{}, {"side": 4}, {"side_bytes": 2048}])
def test_against_all_pairs(spark, rows, settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = N.join_classes(docs, N.Settings(**settings))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_odd(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, N.join_classes(odd).collect()), key=str) == brute(rows)
    assert N.join_classes(none).count() == 0
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 2


def test_keep_one(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {c for _, c, _ in brute(rows)}
    assert {r.doc_id for r in N.keep_one(docs).collect()} == want


def test_blocks_make_no_difference():
    text = " ".join(f"w{i % 97}é" for i in range(3000))
    a, b = N.Shingles(N.Settings()).of(text), N.Shingles(N.Settings(block_bytes=64)).of(text)
    assert (a == b).all() and len(a) == 97
    for text in ("x" * 1000, "ab " * 3, "", " ", "a", " a" * 64, "y" * 64 + " z", ("q" * 63 + " ") * 9):
        sets = [N.Shingles(N.Settings(block_bytes=k)).of(text) for k in (1 << 20, 64, 7, 1)]
        assert all((s == sets[0]).all() and len(s) == len(sets[0]) for s in sets), text


def test_least_depth():
    s = N.Settings()
    d = N.least_depth(s)
    assert 1 - (1 - 0.8**d) ** s.tries >= s.recall > 1 - (1 - 0.8 ** (d + 1)) ** s.tries


def test_trie_links_join_whoever_shares_a_prefix(spark):
    """Every prefix of least_depth levels or more makes a connected group at its level, whatever partitions it is cut into."""
    s, r = N.Settings(tries=3, recall=0.5), random.Random(6)
    s = N.Settings(tries=3, recall=1 - (1 - 0.8**4) ** 3 - 1e-9)
    floor = N.least_depth(s)
    assert floor == 4
    keys = {v: [(t << 56) | sum(r.choice((0, 200)) << 8 * (6 - j) for j in range(7)) for t in range(3)] for v in range(400)}
    vertices = spark.createDataFrame(list(keys.items()), "v long, keys array<long>")
    links = [tuple(x) for x in N.trie_links(vertices, s).collect()]
    assert len(links) <= 3 * len(keys)
    for d in range(floor, 8):
        parent = list(range(400))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v, depth in links:
            shared = max(k for t in range(3) for k in range(8) if (keys[u][t] ^ keys[v][t]) >> 8 * (7 - k) == 0)
            assert shared >= depth >= floor
            if depth >= d:
                parent[root(u)] = root(v)
        for t in range(3):
            heads = {}
            for v in keys:
                other = heads.setdefault(keys[v][t] >> 8 * (7 - d), v)
                assert root(v) == root(other), (d, t)


def test_prefixes_shorten_until_the_recall_is_met(spark):
    s = N.Settings()
    every_trie = [(2 * k, 2 * k + 1, 7) for k in range(50) for _ in range(s.tries)]
    one_trie = [(1000 + 2 * k, 1001 + 2 * k, 7) for k in range(50)]
    df = lambda rows: spark.createDataFrame(rows, "u long, v long, depth int")
    assert N.shortened(df(every_trie), s) == 7 > N.least_depth(s)
    assert N.shortened(df(every_trie + one_trie), s) == N.least_depth(s) == N.shortened(df([]), s)


def test_many_rows_without_an_id(spark):
    """10,000 rows without an id, each of its own text but for one pair in a hundred, and a text that 3,000 rows share."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(None, text(k) + (" and more" if k % 100 == 1 else "")) for k in range(7000)]
    rows = [(None, text(k - 1) + " and more") if k % 100 == 1 else (i, t) for k, (i, t) in enumerate(rows)] + [(None, "the same text for all of these rows")] * 3000
    got = N.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("class_id", "n_links").count().collect()
    assert {(r.class_id, r.n_links): r["count"] for r in got} == {(None, 0): 7000 - 140, (None, 1): 140, (None, 2999): 3000}


def test_clashing_columns(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, b"x", "y", 3) for i, t in rows[:60]], "doc_id long, text string, v int, name binary, __id string, g int")
    assert sorted(map(tuple, N.join_classes(docs).collect()), key=str) == brute(rows[:60])
    assert N.keep_one(docs).columns == docs.columns


def test_recall_on_a_table(spark):
    """Every row whose id is divisible by 50 against all rows of sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sh = N.Shingles(N.Settings())
    sets = {r.doc_id: set(sh.of(r.text).tolist()) for r in rows}
    found = {r.doc_id: r for r in N.join_classes(docs).collect()}
    links = want = 0
    for q in (i for i in sets if i % 50 == 0 and sets[i]):
        near = [i for i, x in sets.items() if i != q and x and len(x & sets[q]) >= 0.8 * len(x | sets[q])]
        want += len(near)
        links += found[q].n_links
        assert all(found[i].class_id == found[q].class_id for i in near)
    assert links == want > 0


def test_links_within():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 30, r.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    jac = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if jac(sets[i], sets[j]) >= 0.6}
    got = {(int(i), int(j)) for x, y in N.links_within(sets, None, 0.6, 7) for i, j in zip(x, y, strict=True)}
    assert got == want
    want = {(i, j) for i in range(25) for j in range(35) if jac(sets[i], sets[25 + j]) >= 0.6}
    assert {(int(i), int(j)) for x, y in N.links_within(sets[:25], sets[25:], 0.6, 7) for i, j in zip(x, y, strict=True)} == want


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randint(0, 50), r.randint(0, 50)) for _ in range(30)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {x.u: x.v for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
