import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument
from tessera.operators import fulltext as X
from tessera.operators import rerank as R

TEXTS = [
    "oak elm ash", "elm fir yew", "ash bay box", "oak bay gum", "fir box tea", "oak oak oak",
    "nut sap ivy", "elm elm box", "", None,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(TEXTS)], "id int, content string, tag int").cache()


def bm25(terms, i):
    known = [t.split() for t in TEXTS if t is not None]
    n, average, own = len(known), sum(map(len, known)) / len(known), TEXTS[i].split()
    out = 0.0
    for t in terms:
        df, tf = sum(t in k for k in known), own.count(t)
        out += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / average))
    return out


def found(docs, text, **more):
    out = X.search(docs, X.parse(text), 10, "id", "content", **more).collect()
    return {r.id: r.score for r in out}


@pytest.mark.parametrize("text,ids,terms", [
    ("oak", {0, 3, 5}, ["oak"]),
    ("oak OR box", {0, 2, 3, 4, 5, 7}, ["oak", "box"]),
    ("oak box", {0, 2, 3, 4, 5, 7}, ["oak", "box"]),
    ("oak AND bay", {3}, ["oak", "bay"]),
    ("elm NOT box", {0, 1}, ["elm"]),
    ("elm AND NOT box", {0, 1}, ["elm"]),
    ("+elm -box", {0, 1}, ["elm"]),
    ("+elm box", {0, 1, 7}, ["elm", "box"]),
    ("(oak OR fir) AND box", {4}, ["oak", "fir", "box"]),
    ('"elm fir"', {1}, ["elm", "fir"]),
    ('"oak oak"', {5}, ["oak", "oak"]),
    ('"fir elm"', set(), []),
    ("OAK", {0, 3, 5}, ["oak"]),
    ("nothing", set(), []),
    ("+oak -oak", set(), []),
])
def test_query(docs, text, ids, terms):
    got = found(docs, text)
    assert set(got) == ids
    for i, s in got.items():
        assert s == pytest.approx(bm25(terms, i), abs=1e-9)


def test_default_and(docs):
    assert {r.id for r in X.search(docs, X.parse("oak bay", default_operator="and"), 10, "id", "content").collect()} == {3}
    assert {r.id for r in X.search(docs, X.match("oak bay", default_operator="and"), 10, "id", "content").collect()} == {3}


def test_filter_keeps_statistics(docs):
    from pyspark.sql import functions as F

    got = found(docs, "oak", where=F.col("tag") == 1)
    assert set(got) == {3, 5} and got[3] == pytest.approx(bm25(["oak"], 3))


def test_no_terms_and_topk(docs):
    assert X.search(docs, X.match("!!! ???"), 10, "id", "content").count() == 0
    assert X.search(docs, X.match("oak"), 0, "id", "content").count() == 0
    assert X.search(docs.limit(0), X.match("oak"), 3, "id", "content").count() == 0
    assert [r.id for r in X.search(docs, X.match("oak"), 1, "id", "content").collect()] == [5]
    with pytest.raises(InvalidArgument):
        X.search(docs, X.match("oak"), 100_001, "id", "content")


@pytest.mark.parametrize("text", ["title:oak", "oak^2", "(oak", "oak OR", "", "AND", "-oak"])
def test_refused(docs, text):
    with pytest.raises(InvalidArgument):
        X.search(docs, X.parse(text), 10, "id", "content")


def test_simplify():
    T = X.Term
    assert X.simplify(X.parse("a a b")) == X.Or((T("a", 2.0), T("b")))
    assert X.simplify(X.parse("a OR (b OR c)")) == X.Or((T("a"), T("b"), T("c")))
    assert X.simplify(X.parse("+a b -c")) == X.And((T("a"),), (T("b"),), (T("c"),))
    assert X.simplify(X.parse("a -c")) == X.And((T("a"),), (), (T("c"),))
    assert X.simplify(X.parse("-a -b")) == X.Empty()
    assert X.simplify(X.parse("a AND (b AND c)")) == X.And((T("a"), T("b"), T("c")))


def test_analyzers(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Ab-c d1 Été " + "x" * 300,), ("",), (None,)], "t string")
    for name in ("standard", "whitespace"):
        a = X.Analyzer(name)
        for r in df.select("t", a.column(F.col("t")).alias("w")).collect():
            assert r.w == (None if r.t is None else a.positions(r.t))
    assert X.Analyzer().terms("Ab-c Été") == ["ab", "c", "t"]


def test_postings(docs):
    p = {(r.term, r.key): r for r in X.postings(docs, "id", "content").collect()}
    assert p["oak", 5].tf == 3 and p["oak", 5].positions == [0, 1, 2] and p["box", 7].length == 3
    assert {r.term: r.df for r in X.term_stats(X.postings(docs, "id", "content")).collect()}["elm"] == 3
    assert tuple(X.corpus_stats(docs, "content").first()) == (9, 24)


def test_fusion(spark):
    make = lambda rows: spark.createDataFrame(rows, "pk string, score double")
    lists = {"x": make([("a", 0.1), ("b", 0.2), ("c", 0.3)]), "y": make([("b", 9.0), ("d", 8.0)])}
    out = R.RrfReranker(3, metrics={"x": "L2", "y": "IP"}).rerank(lists).collect()
    assert [(r.pk, round(r.score, 9)) for r in out] == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9)), ("d", round(1 / 62, 9))]
    out = R.WeightedReranker({"x": "L2", "y": "IP"}, 2, {"y": 2.0}).rerank(lists).collect()
    assert out[0].pk == "b" and out[0].score == pytest.approx(1 - 2 * math.atan(0.2) / math.pi + 2 * (0.5 + math.atan(9) / math.pi))
    with pytest.raises(InvalidArgument):
        R.WeightedReranker({"x": "L2"}).rerank(lists)
    for r in (R.RrfReranker(), R.WeightedReranker({}), R.ModelReranker("q", len, "t")):
        with pytest.raises(InvalidArgument):
            r.rerank({})


def test_embeddings(spark):
    class Letters:
        dimension = 2

        def embed(self, v):
            return [v.count("a"), len(v)]

    class Sparse:
        def embed(self, v):
            return {len(v): 1.0, 0: -1.0, 3: 0.5}

    df = spark.createDataFrame([("banana",), (None,), ("",)], "t string")
    assert [r.embedding for r in R.embed_column(df, "t", Letters()).collect()] == [[3.0, 6.0], None, [0.0, 0.0]]
    got = R.embed_sparse_column(df.where("t is not null"), "t", Sparse()).collect()
    assert [(r.embedding["indices"], r.embedding["values"]) for r in got][0] == ([3, 6], [0.5, 1.0])


def test_a_tokenizer_of_ones_own(spark):
    """Registered on the driver, used in the executors."""
    X.register_tokenizer("pairs", lambda c: F.filter(F.split(c, ""), lambda t: t != " "), lambda s: [c for c in s if c != " "])
    docs = spark.createDataFrame([(1, "ab a"), (2, "b b"), (3, None)], "id long, content string")
    a = X.Analyzer("pairs")
    assert [r.id for r in X.search(docs, X.Term("a"), 9, "id", "content", a).collect()] == [1]
    assert {(r.term, r.df) for r in X.term_stats_of(docs, "content", a).collect()} == {("a", 1), ("b", 2)}
    assert {(r.term, r.key, r.tf) for r in X.postings(docs, "id", "content", a).collect()} == {("a", 1, 2), ("b", 1, 1), ("b", 2, 2)}


def test_counts_by_bytes_and_by_the_tokenizer(spark):
    r = random.Random(7)
    texts = ["".join(r.choice(["a", "B", "b", "é", " ", "-", "1", "\n", "aa", "x" * 300, "日"]) for _ in range(r.randint(0, 40))) for _ in range(200)]
    for a in (X.Analyzer(), X.Analyzer(lowercase=False), X.Analyzer("whitespace"), X.Analyzer(longest=1)):
        count = X._counter(a, ["a", "b", "1"], [("a", "b"), ("b", "b", "1")])
        for t in texts:
            p = a.positions(t)
            phrase = lambda *w: int(any(p[i : i + len(w)] == list(w) for i in range(len(p))))  # noqa: B023, E731
            assert count(t) == [len(p) - p.count(None), p.count("a"), p.count("b"), p.count("1"), phrase("a", "b"), phrase("b", "b", "1")], (a, t)
    assert count(None) is None
