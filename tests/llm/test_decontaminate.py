import hashlib
import random
import re

from tessera.llm import decontaminate as D


def brute(docs, bench, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(i, split(t)) for i, t in bench if i is not None]
    out = []
    for doc_id, text in docs:
        w, hit, got = split(text), set(), set()
        for i, b in items:
            m = min(size, len(b))
            for k in range(len(b) - m + 1 if b else 0):
                for at in range(len(w) - m + 1):
                    if w[at : at + m] == b[k : k + m]:
                        hit |= set(range(at, at + m))
                        got.add(i)
        out.append((doc_id, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(map(str, got))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def quick(docs, bench, size=10):
    """doc_id, whether a window of the benchmark stands in the document, by sets of windows."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for w in (split(t) for i, t in bench if i is not None):
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows.setdefault(m, set()).add(tuple(w[k : k + m]))
    out = []
    for i, text in docs:
        w = split(text)
        out.append((i, any(tuple(w[at : at + m]) in some for m, some in windows.items() for at in range(len(w) - m + 1))))
    return out


def test_random(spark):
    r = random.Random(1)
    text = lambda n: " ".join(r.choice(["a", "B", "é1", "c,", "dd"]) for _ in range(n))
    bench = [(i, text(r.choice([1, 2, 3, 5, 9, 10, 12, 14]))) for i in range(25)] + [(30, None), (31, "... !"), (2, "a b"), (None, "a")]
    docs = [(i, text(r.randint(0, 60))) for i in range(40)] + [(99, bench[9][1] * 3)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for size in (10, 4):
        assert sorted(map(tuple, D.report(d, b, size).collect()), key=str) == brute(docs, bench, size)
    found = D.find_items(d, b, block_bytes=60)
    assert sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in found.collect()) == sorted(x[:4] for x in brute(docs, bench))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan  # one block's pass at a time


def test_clashing_columns_and_a_long_text(spark):
    text = "w " * 200_000 + "one two three four five six seven eight nine ten " + "w " * 200_000
    docs = spark.createDataFrame([(1, text, 5, "m", 6, [1], None), (2, "clean text", 7, "n", 8, [2], 3)], "doc_id long, text string, n_hit int, mask string, n_words int, items array<int>, kept int")
    bench = spark.createDataFrame([(1, "One two three four five six seven eight nine ten eleven")], "item_id long, text string")
    assert [tuple(r)[1:4] for r in D.report(docs, bench).orderBy("doc_id").collect()] == [(400_010, 10, 1), (2, 0, 0)]
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.collect() == docs.where("doc_id = 2").collect()


def test_odd(spark, odd, none):
    b = spark.createDataFrame([(1, "of text that repeats and one"), (2, "日本語 ünï")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, D.report(odd, b).collect()), key=str) == brute(rows, [(1, "of text that repeats and one"), (2, "日本語 ünï")])
    assert D.report(none, b).count() == 0
    assert D.report(odd, b.limit(0)).where("contaminated").count() == 0
    kept = D.drop_contaminated(odd, b)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
