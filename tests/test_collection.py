import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.errors import AlreadyExists, FailedPrecondition, InvalidArgument, NotFound, NotSupported, PermissionDenied
from tessera.operators import fulltext as X
from tessera.operators.collection import Collection, Doc, Options
from tessera.operators.rerank import RrfReranker
from tessera.plans.request import FlatQueryParams, Fts, HnswQueryParams, HnswRabitqQueryParams, IvfQueryParams, Query, sparse_dict
from tessera.schema import CollectionSpec, FieldSpec, FlatIndex, FtsIndex, HnswIndex, HnswRabitqIndex, InvertIndex, IvfIndex
from tessera.sources import files

SPEC = CollectionSpec("things", (
    FieldSpec("n", "INT32"), FieldSpec("name", "STRING", True, 0, InvertIndex()), FieldSpec("w", "DOUBLE", True), FieldSpec("big", "UINT64", True),
    FieldSpec("tags", "ARRAY_STRING", True), FieldSpec("text", "STRING", True, 0, FtsIndex()), FieldSpec("v", "VECTOR_FP32", True, 2, FlatIndex("L2")),
    FieldSpec("half", "VECTOR_FP16", True, 2), FieldSpec("sparse", "SPARSE_VECTOR_FP32", True),
))


def doc(i, **more):
    return Doc(f"k{i}", {"n": i, "name": f"user_{i % 3}", "w": i / 2, "tags": ["a", f"t{i}"], "text": f"word{i} common", "v": [float(i), 0.0], "sparse": {1: 1.0, 5 + i: 2.0}} | more)


@pytest.fixture
def c(spark, tmp_path):
    c = Collection.create_and_open(spark, f"file://{tmp_path}/c", SPEC)
    assert all(s.ok for s in c.insert([doc(i) for i in range(6)]))
    return c


def keys(c, *a, **k):
    return [d.id for d in c.query(*a, **k)]


def test_read_your_writes_and_reopen(spark, c):
    assert keys(c) == [f"k{i}" for i in range(6)]
    assert c.stats().doc_count == 6 and c.stats().index_completeness == {"v": 1.0, "half": 1.0, "sparse": 1.0}
    again = Collection.open(spark, c.path)
    assert again.fetch("k3")["k3"].fields["v"] == [3.0, 0.0] and again.schema == c.schema
    assert c.fetch(["k1", "zz"], ["n"], False) == {"k1": Doc("k1", {"n": 1}, 0.0, 1), "zz": None}
    with pytest.raises(AlreadyExists):
        Collection.create_and_open(spark, c.path, SPEC)
    with pytest.raises(NotFound):
        Collection.open(spark, c.path + "-none")


def test_insert_upsert_update_delete(c):
    assert [s.code for s in c.insert([doc(1), doc(9), doc(9)])] == ["ALREADY_EXISTS", "OK", "ALREADY_EXISTS"]
    assert c.upsert(Doc("k1", {"n": 100})).ok
    assert c.fetch("k1")["k1"].fields == {"n": 100}
    assert [s.code for s in c.update([Doc("k2", {"w": None, "n": 7}), Doc("no", {"n": 1}), Doc("k2", {"name": "z"})])] == ["OK", "NOT_FOUND", "OK"]
    got = c.fetch("k2")["k2"].fields
    assert got["n"] == 7 and got["name"] == "z" and "w" not in got and got["tags"] == ["a", "t2"]
    assert [s.code for s in c.delete(["k0", "no", "k0"])] == ["OK", "NOT_FOUND", "NOT_FOUND"]
    assert c.fetch("k0") == {"k0": None}
    c.delete_by_filter("name = 'user_0' OR w >= 100")
    c.delete_by_filter("n > 1000")
    assert sorted(keys(c)) == ["k1", "k2", "k4", "k5"]
    c.upsert([doc(20, n=1), doc(20, n=2)])
    assert c.fetch("k20")["k20"].fields["n"] == 2
    c.optimize()
    c.vacuum()
    assert sorted(keys(c)) == ["k1", "k2", "k20", "k4", "k5"] and len(c.manifest.segments) == 1 and not c.manifest.deleted


@pytest.mark.parametrize("bad", [
    Doc("k", {}), Doc("k", {"n": "1"}), Doc("k", {"n": 2**31}), Doc("k", {"n": 1, "zz": 1}), Doc("k", {"n": None}), Doc("bad key", {"n": 1}), Doc("", {"n": 1}),
    Doc("k", {"n": 1, "v": [1.0]}), Doc("k", {"n": 1, "tags": [1]}), Doc("k", {"n": 1, "big": -1}), Doc("k", {"n": True}), Doc("k", {"n": 1, "sparse": [1.0]}),
])
def test_refused_documents(c, bad):
    with pytest.raises(InvalidArgument):
        c.insert([doc(50), bad])
    assert c.fetch("k50") == {"k50": None}


def test_types_come_back(c):
    c.upsert(Doc("t", {"n": 1, "big": 2**64 - 1, "half": [0.1, 2.0], "sparse": {9: 1.5}}))
    got = c.fetch("t")["t"].fields
    assert got["big"] == 2**64 - 1 and got["half"] == pytest.approx([0.0999756, 2.0], abs=1e-7) and got["sparse"] == {9: 1.5}


def test_queries(c):
    near = c.query(Query("v", vector=[2.2, 0.0]), topk=3)
    assert [d.id for d in near] == ["k2", "k3", "k1"] and near[0].score == pytest.approx(0.04)
    assert "v" not in near[0].fields and c.query(Query("v", vector=[2.2, 0.0]), 1, include_vector=True)[0].fields["v"] == [2.0, 0.0]
    assert keys(c, Query("v", id="k4"), topk=2, filter="n < 4") == ["k3", "k2"]
    assert keys(c, Query("v", vector=[0.0, 0.0], param=FlatQueryParams(radius=1.5)), topk=9) == ["k0", "k1"]
    assert keys(c, Query("sparse", vector=sparse_dict([8, 1], [1.0, 0.1])), topk=1) == ["k3"]
    assert keys(c, Query("text", fts=Fts(match_string="WORD2")), topk=5) == ["k2"]
    assert keys(c, Query("text", fts=Fts(query_string="common -word1")), topk=9, filter="n >= 1") == ["k2", "k3", "k4", "k5"]
    assert keys(c, filter="tags CONTAIN_ANY ('t1', 't5') AND name LIKE 'user%'") == ["k1", "k5"]
    assert c.query(filter="n = 1", output_fields=[])[0].fields == {}
    assert keys(c, topk=0) == []
    got = c.group_by_query(Query("v", vector=[0.0, 0.0]), "name", 1, 2).orderBy("group_rank").collect()
    assert [(r.group_id, r.pk) for r in got] == [("user_0", "k0"), ("user_1", "k1")]
    both = c.query([Query("v", vector=[5.0, 0.0]), Query("text", fts=Fts(match_string="word5"))], 2, reranker=RrfReranker(2))
    assert both[0].id == "k5" and both[0].score == pytest.approx(2 / 61)


@pytest.mark.parametrize("q,more", [
    (Query("zz", vector=[1.0]), {}), (Query("n", vector=[1.0]), {}), (Query("v"), {}), (Query("v", vector=[1.0]), {}), (Query("v", id="a", vector=[1.0, 2.0]), {}),
    (Query("v", vector=[1.0, 2.0], param=HnswQueryParams()), {}), (Query("name", fts=Fts("x")), {}), (Query("text", fts=Fts("x", "y")), {}),
    (Query("text", vector=[1.0], fts=Fts("x")), {}), (Query("v", vector=[1.0, 2.0]), {"topk": -1}), (Query("v", vector=[1.0, 2.0]), {"topk": 100_001}),
    (Query("v", vector=[1.0, 2.0]), {"output_fields": ["zz"]}), (Query("v", vector=[1.0, 2.0]), {"filter": "text = 'x'"}), (Query("sparse", vector=[1.0]), {}),
    ([Query("v", vector=[1.0, 2.0]), Query("half", vector=[1.0, 2.0])], {}), ([Query("v", vector=[1.0, 2.0])] * 2, {"reranker": RrfReranker()}),
])
def test_refused_queries(c, q, more):
    with pytest.raises(InvalidArgument):
        c.query(q, **more)


def test_schema_changes(spark, c):
    c.add_column(FieldSpec("twice", "DOUBLE", True), "w * 2")
    c.add_column(FieldSpec("blank", "INT64", True))
    c.insert(doc(7, twice=1.0, blank=3))
    assert [(d.fields["twice"], d.get("blank")) for d in c.query(filter="n >= 5")] == [(5.0, None), (1.0, 3)]
    c.alter_column("twice", new_name="double_w")
    c.alter_column("double_w", schema=FieldSpec("double_w", "INT32", True))
    c.drop_column("w")
    c.add_column(FieldSpec("w", "INT32", True))
    again = Collection.open(spark, c.path)
    d = again.fetch("k5")["k5"].fields
    assert d["double_w"] == 5 and "w" not in d and again.fetch("k7")["k7"].fields["blank"] == 3
    for f, e in ((FieldSpec("s", "STRING", True), ""), (FieldSpec("x", "INT32"), ""), (FieldSpec("x", "INT32", True), "name + 1"), (FieldSpec("x y", "INT32", True), "")):
        with pytest.raises(InvalidArgument):
            c.add_column(f, e)
    with pytest.raises(AlreadyExists):
        c.add_column(FieldSpec("n", "INT32", True))
    for call in (lambda: c.drop_column("name"), lambda: c.alter_column("n"), lambda: c.alter_column("blank", schema=FieldSpec("blank", "INT32")), lambda: c.alter_column("n", schema=FieldSpec("n", "STRING"))):
        with pytest.raises(InvalidArgument):
            call()
    with pytest.raises(NotFound):
        c.drop_column("zz")


def test_indexes(c):
    c.create_index("v", IvfIndex("L2", n_list=3))
    assert c.stats().index_completeness["v"] == 1.0
    assert keys(c, Query("v", vector=[2.2, 0.0], param=IvfQueryParams(nprobe=3)), topk=3) == ["k2", "k3", "k1"]
    assert keys(c, Query("v", vector=[0.1, 0.0], param=IvfQueryParams(nprobe=1)), topk=9, filter="n IN (5, 77)") == []
    assert keys(c, Query("v", vector=[0.1, 0.0], param=IvfQueryParams(nprobe=1, is_linear=True)), topk=9, filter="n = 5") == ["k5"]
    c.insert(doc(8, v=[2.25, 0.0]))
    assert 0 < c.stats().index_completeness["v"] < 1
    assert keys(c, Query("v", vector=[2.2, 0.0], param=IvfQueryParams(nprobe=1)), topk=1) == ["k8"]
    c.optimize()
    assert c.stats().index_completeness["v"] == 1.0 and keys(c, Query("v", id="k8"), topk=1) == ["k8"]
    c.create_index("v", HnswIndex("COSINE"))
    c.drop_index("v")
    assert c.schema.get("v").index == FlatIndex()
    c.create_index("n", InvertIndex())
    c.drop_index("n")
    for name, index, error in (("n", FlatIndex(), InvalidArgument), ("v", InvertIndex(), InvalidArgument), ("name", FtsIndex(), NotSupported), ("sparse", FlatIndex("L2"), InvalidArgument), ("zz", FlatIndex(), NotFound)):
        with pytest.raises(error):
            c.create_index(name, index)


def test_snapshots_and_locks(spark, c):
    old = c.manifest.version
    other = Collection.open(spark, c.path)
    c.delete("k0")
    with pytest.raises(FailedPrecondition):
        other.delete("k1")
    assert Collection.open(spark, c.path, version=old).docs().count() == 6 and Collection.open(spark, c.path).docs().count() == 5
    ro = Collection.open(spark, c.path, Options(read_only=True))
    for call in (lambda: ro.insert(doc(1)), lambda: ro.delete("k1"), ro.optimize, ro.destroy, lambda: ro.add_column(FieldSpec("x", "INT32", True))):
        with pytest.raises(PermissionDenied):
            call()
    c.close()
    with pytest.raises(FailedPrecondition):
        c.query()
    ro = Collection.open(spark, ro.path)
    ro.destroy()
    assert not files.exists(spark, ro.path)


def test_bulk_and_stream(spark, c, tmp_path):
    from tessera.streaming.ingest import stream_upsert

    rows = spark.createDataFrame([("k0", 1, 1), ("k0", 2, 2), ("b1", 3, 1)], "pk string, n int, seq int")
    with pytest.raises(InvalidArgument):
        c.upsert_df(rows.unionByName(spark.createDataFrame([(None, 4, 1)], "pk string, n int, seq int")))
    c.upsert_df(rows)
    assert {d.id: d.fields["n"] for d in c.query(topk=99, filter="n <= 3")} == {"k0": 2, "k1": 1, "k2": 2, "k3": 3, "b1": 3}
    with pytest.raises(InvalidArgument):
        c.upsert_df(spark.createDataFrame([("x", None)], "pk string, n int"))
    c.upsert_df(rows.limit(0), ("s", 0))
    c.upsert_df(rows.withColumn("n", F.lit(77)), ("s", 0))
    assert not keys(c, filter="n = 77")
    rows.repartition(2).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").withColumn("n", F.col("n") + 500)
    stream_upsert(source, c, f"{tmp_path}/cp", available_now=True).awaitTermination()
    assert c.fetch(["k0", "b1"])["k0"].fields["n"] == 502


@pytest.mark.parametrize("spec", [
    CollectionSpec("ab", (FieldSpec("n", "INT32"),)), CollectionSpec("abc", ()), CollectionSpec("abc", (FieldSpec("n", "INT32"), FieldSpec("n", "BOOL"))),
    CollectionSpec("abc", (FieldSpec("v", "VECTOR_FP32", False, 0),)), CollectionSpec("abc", (FieldSpec("v", "VECTOR_FP64", False, 2),)),
    CollectionSpec("abc", (FieldSpec("v", "VECTOR_INT8", False, 2, FlatIndex("COSINE")),)), CollectionSpec("abc", (FieldSpec("n", "INT32", False, 0, FtsIndex()),)),
    CollectionSpec("abc", (FieldSpec("v", "SPARSE_VECTOR_FP32", False, 0, IvfIndex()),)), CollectionSpec("abc", (FieldSpec("n", "INT32"),), 10),
    CollectionSpec("abc", tuple(FieldSpec(f"v{i}", "VECTOR_FP32", False, 2) for i in range(6))),
    CollectionSpec("abc", (FieldSpec("v", "VECTOR_FP16", False, 2, FlatIndex("L2", "INT8")),)),
])
def test_refused_schemas(spec):
    with pytest.raises(InvalidArgument):
        spec.validate()


def test_files(spark, tmp_path):
    spark.createDataFrame([("a;1 2.5 -3",), ("b; 4,5",), ("broken",), ("c;x y",)], "value string").write.text(f"{tmp_path}/t")
    got = files.read_vectors_text(spark, f"{tmp_path}/t")
    assert sorted((r.key, r.vector) for r in got.collect()) == [("a", [1.0, 2.5, -3.0]), ("b", [4.0, 5.0])]
    files.write_vectors_text(got, f"{tmp_path}/u", "key", "vector")
    assert files.read_vectors_text(spark, f"{tmp_path}/u").count() == 2
    files.write_arrow(got.repartition(3), f"{tmp_path}/arrow")
    assert sorted(map(tuple, files.read_arrow(spark, f"{tmp_path}/arrow").collect())) == sorted(map(tuple, got.collect()))
    with pa.OSFile(f"{tmp_path}/x.arrows", "wb") as f, pa.ipc.new_stream(f, got.toArrow().schema) as out:
        out.write_table(got.toArrow())
    assert files.read_arrow(spark, f"file://{tmp_path}/x.arrows").count() == 2
    with pytest.raises(AlreadyExists):
        files.write_arrow(got, f"{tmp_path}/arrow")
    with pytest.raises(NotFound):
        files.read_arrow(spark, f"{tmp_path}/none")
    (tmp_path / "b/qrels").mkdir(parents=True)
    (tmp_path / "b/corpus.jsonl").write_text('{"_id": "1", "title": "t", "text": "x"}\n')
    (tmp_path / "b/queries.jsonl").write_text('{"_id": "q", "text": "x"}\n')
    (tmp_path / "b/qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t1\n")
    assert [x.count() for x in files.read_beir(spark, f"{tmp_path}/b")] == [1, 1, 1]
    files.write_table(got, f"{tmp_path}/p")
    assert files.read_table(spark, f"{tmp_path}/p", ["key"]).columns == ["key"]
    files.write_text(spark, f"{tmp_path}/one", "x")
    with pytest.raises(AlreadyExists):
        files.write_text(spark, f"{tmp_path}/one", "y")
    assert files.read_text(spark, f"{tmp_path}/one") == "x"


@pytest.mark.parametrize("row,schema", [
    (("bad key!!  ", 1), "pk string, n int"), (("a" * 65, 1), "pk string, n int"), ((None, 1), "pk string, n int"), (("a", None), "pk string, n int"), (("a",), "pk string"),
    (("a", 1, [1.0]), "pk string, n int, v array<float>"), (("a", 1, [1.0, None]), "pk string, n int, v array<float>"), (("a", 2**40), "pk string, n long"),
    (("a", 1, -5), "pk string, n int, big long"), (("a", 1, ([1, 1], [1.0, 2.0])), "pk string, n int, sparse struct<indices:array<long>,values:array<float>>"),
    (("a", 1, ([1], [1.0, 2.0])), "pk string, n int, sparse struct<indices:array<long>,values:array<float>>"),
])
def test_bulk_rows_that_are_refused(spark, c, row, schema):
    good = [("good", *([1] if len(row) > 1 else []), *[None] * (len(row) - 2))]
    with pytest.raises(InvalidArgument):
        c.upsert_df(spark.createDataFrame([row, *good], schema))
    assert c.fetch("good") == {"good": None} and c.stats().doc_count == 6


def test_bulk_ids_ascend_with_the_keys(spark, c):
    c.upsert_df(spark.createDataFrame([(f"z{k * 37 % 101:03d}", k) for k in range(101)], "pk string, n int").repartition(5))
    rows = c.docs().where("pk like 'z%'").orderBy("doc_id").collect()
    assert [r.pk for r in rows] == sorted(r.pk for r in rows) and len(rows) == 101
    same = c.query(Query("text", fts=Fts(match_string="common")), topk=3)
    assert [d.id for d in same] == ["k0", "k1", "k2"]  # equal scores: in order of doc_id, here and in the cut


def in_memory(c, q, k=50, where=None):
    """The same search over the texts themselves."""
    f = c.schema.get("text")
    analyzer = X.Analyzer.of(f.index)
    node = X.match(q.fts.match_string, analyzer, q.operator or "or") if q.fts.match_string else X.parse(q.fts.query_string, analyzer, q.operator or "or")
    out = X.search(c.docs(), node, k, "doc_id", "text", analyzer, None if where is None else c._filter(where))
    return [(r.doc_id, round(r.score, 9)) for r in out.orderBy(F.desc("score"), "doc_id").collect()]


def from_postings(c, q, k=50, where=None):
    return [(d.doc_id, round(d.score, 9)) for d in c.query(q, k, where, output_fields=[])]


QUERIES = [Fts(match_string=x) for x in ("red", "RED green", "none", "red none")] + [
    Fts(query_string=x) for x in ("red AND green", "+red green -blue", '"red green"', '"green red" OR blue', "(red OR blue) AND NOT green", '+"red green blue" red', 'red AND (green OR "blue red")', "a b", '"red red"')
]


def test_text_index_follows_every_change(spark, tmp_path):
    r = random.Random(3)
    spec = CollectionSpec("texts", (FieldSpec("text", "STRING", True, 0, FtsIndex()), FieldSpec("n", "INT32", True)))
    c = Collection.create_and_open(spark, f"file://{tmp_path}/t", spec)
    text = lambda: " ".join(r.choice(["red", "Green", "blue", "red", "x1", "a-b"]) for _ in range(r.randint(1, 14)))

    def check(some):
        for fts in some:
            q = Query("text", fts=fts)
            assert from_postings(c, q) == in_memory(c, q), fts
            assert from_postings(c, q, 3, "n < 20") == in_memory(c, q, 3, "n < 20"), fts
        live = c.docs().where("text is not null")
        known = c.manifest.texts["text"]
        assert known["docs"] == live.count() and known["tokens"] == (X.corpus_stats(live, "text").first()[1])

    c.upsert_df(spark.createDataFrame([(f"p{k}", None if k % 17 == 3 else text(), k) for k in range(60)], "pk string, text string, n int"))
    check(QUERIES[::2])
    c.upsert([Doc(f"p{k}", {"text": text(), "n": k}) for k in (1, 2, 3, 200, 201)])
    c.delete(["p5", "p6", "p200"])
    check(QUERIES[1::5])
    c.upsert_df(spark.createDataFrame([(f"p{k}", text(), k) for k in range(10, 30)], "pk string, text string, n int"))
    c.delete_by_filter("n >= 50")
    check(QUERIES[8:9])
    before = len(c.manifest.texts["text"]["buckets"])
    c.optimize()
    assert before == 3 and len(c.manifest.texts["text"]["buckets"]) == 1 and not c.manifest.deleted
    left = c.postings(c.schema.get("text")).lengths().join(c.docs(), "doc_id", "left_anti").count()
    assert left == 0  # what is deleted is purged
    check(QUERIES[5:12:3])
    c.add_column(FieldSpec("twice", "INT32", True), "n * 2")
    c.vacuum()
    assert len(files.list_names(spark, f"{c.path}/fts/text")) == 1
    c = Collection.open(spark, c.path)
    check(QUERIES[6:7])


def test_a_text_search_reads_its_terms_only(spark, tmp_path, monkeypatch):
    from tessera.operators import postings as P

    monkeypatch.setattr(P, "BUCKET_BYTES", 512)
    spec = CollectionSpec("texts", (FieldSpec("text", "STRING", True, 0, FtsIndex()),))
    c = Collection.create_and_open(spark, f"file://{tmp_path}/t", spec)
    c.upsert_df(spark.createDataFrame([(f"p{k}", f"word{k} word{k % 7} common") for k in range(200)], "pk string, text string"))
    index = c.postings(c.schema.get("text"))
    assert list(index.buckets.values())[0] >= 8
    plan = index.of_terms(["word3"]).select("doc_id", "tf")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan or "EqualTo(term,word3)" in plan
    assert "positions" not in plan
    assert {d.id for d in c.query(Query("text", fts=Fts(match_string="word3")), 99)} == {f"p{k}" for k in range(200) if k % 7 == 3 or k == 3}


def test_pruned_searches_find_the_same(spark, tmp_path):
    """Frequent terms that can't decide the answer: the same documents and scores, from fewer postings."""
    from tessera.operators import postings as P

    r = random.Random(8)
    spec = CollectionSpec("texts", (FieldSpec("text", "STRING", True, 0, FtsIndex()),))
    c = Collection.create_and_open(spark, f"file://{tmp_path}/t", spec)
    c.upsert_df(spark.createDataFrame([(f"p{k:03d}", " ".join(["the"] * r.randint(0, 5) + ["of"] * r.randint(0, 2) + ["rare"] * (k % 30 == 0) + ["odd"] * (k % 41 == 0) + ["pad"] * r.randint(1, 9))) for k in range(400)], "pk string, text string"))
    index, known = c.postings(c.schema.get("text")), c.manifest.texts["text"]
    fewer = 0
    for text in ("the of rare odd", "rare the", "odd of the pad", "the of", "none the odd"):
        node = X.match(text)
        for k in (1, 5, 20):
            plain = [tuple(x) for x in P.search(index, node, k, known["docs"], known["tokens"], prune_from=1 << 60).collect()]
            pruned = [tuple(x) for x in P.search(index, node, k, known["docs"], known["tokens"], prune_from=0).collect()]
            assert [(i, round(s, 9)) for i, s in pruned] == [(i, round(s, 9)) for i, s in plain], (text, k)
        terms = text.split()
        df = {x.term: x["count"] for x in index.of_terms(terms).groupBy("term").count().collect()}
        fewer += P._promising(index.of_terms(terms), dict.fromkeys(terms, 1.0), df, known["docs"], known["tokens"] / known["docs"], 5).count() < sum(df.values())
    assert fewer >= 2


def test_tokenizer_parameters(spark, tmp_path):
    spec = CollectionSpec("texts", (FieldSpec("text", "STRING", True, 0, FtsIndex(extra_params='{"max_token_length": 4}')),))
    c = Collection.create_and_open(spark, f"file://{tmp_path}/t", spec)
    c.insert([Doc("a", {"text": "long longer word"}), Doc("b", {"text": "longer"})])
    assert keys(c, Query("text", fts=Fts(match_string="longer"))) == [] and keys(c, Query("text", fts=Fts(match_string="word"))) == ["a"]
    assert c.manifest.texts["text"]["tokens"] == 2 and keys(c, Query("text", fts=Fts(query_string='"long word"'))) == []
    assert X.Analyzer.of(FtsIndex(extra_params='{"max_token_length": 0}')).longest == X.LONGEST
    for bad in ("{", "[1]", "7"):
        with pytest.raises(InvalidArgument):
            X.Analyzer.of(FtsIndex(extra_params=bad))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_all_that_a_search_reads(spark, tmp_path):
    spec = CollectionSpec("cells", (FieldSpec("n", "INT32", True), FieldSpec("v", "VECTOR_FP32", True, 2, FlatIndex("L2"))))
    c = Collection.create_and_open(spark, f"file://{tmp_path}/t", spec)
    c.upsert_df(spark.createDataFrame([(f"p{k}", k, [float(k % 10), float(k // 10)]) for k in range(200)], "pk string, n int, v array<float>"))
    c.create_index("v", IvfIndex("L2", n_list=8))
    f, q = c.schema.get("v"), Query("v", vector=[3.0, 4.0], param=IvfQueryParams(nprobe=2))
    known = c.manifest.indexes["v"]
    search = c._index_search(q, f, [3.0, 4.0], 5, None, None, known)
    assert "PartitionFilters: [cell_id" in plan_of(search) and all("/index/v-" in x for x in search.inputFiles())
    c.insert(Doc("new", {"n": 500, "v": [3.0, 4.01]}))
    c.delete("p43")
    read = c._index_search(q, f, [3.0, 4.0], 5, None, None, c.manifest.indexes["v"]).inputFiles()
    old, new = known["segments"][0], c.manifest.segments[-1]
    assert not any(f"/data/{old}/" in x for x in read) and any(f"/data/{new}/" in x for x in read)
    got = c.query(q, 3)
    assert [d.id for d in got] == ["new", "p33", "p42"] and got[0].fields["n"] == 500
    assert [d.id for d in c.query(q, 2, "n != 33")] == ["new", "p42"]


@pytest.mark.parametrize("index,param,most", [
    (FlatIndex("L2", "INT8"), FlatQueryParams, 0.05), (FlatIndex("L2", "FP16"), FlatQueryParams, 0.01), (HnswIndex("L2", quantize="INT4"), HnswQueryParams, 1.0),
    (IvfIndex("L2", n_list=4, quantize="INT8"), IvfQueryParams, 0.05), (HnswRabitqIndex("L2", num_clusters=4), HnswRabitqQueryParams, 0.3),
])
def test_quantized_indexes_and_the_refiner(spark, tmp_path, index, param, most):
    r = np.random.default_rng(1)
    x = r.normal(size=(120, 64)).astype(np.float32)
    c = Collection.create_and_open(spark, f"file://{tmp_path}/t", CollectionSpec("codes", (FieldSpec("v", "VECTOR_FP32", True, 64, index),)))
    c.upsert_df(spark.createDataFrame([(f"p{k:03d}", v.tolist()) for k, v in enumerate(x)] + [("none", None)], "pk string, v array<float>"))
    assert c.stats().index_completeness["v"] == 0.0
    c.optimize()
    assert c.stats().index_completeness["v"] == 1.0
    true = ((x - x[7]) ** 2).sum(1)
    want = [f"p{k:03d}" for k in np.argsort(true, kind="stable")[:10]]
    probe = {"nprobe": 4} if param is IvfQueryParams else {}
    coarse = c.query(Query("v", vector=x[7].tolist(), param=param(**probe)), 10)
    fine = c.query(Query("v", vector=x[7].tolist(), param=param(is_using_refiner=True, **probe)), 10)
    assert [d.id for d in fine] == want and [round(d.score, 4) for d in fine] == [round(float(true[int(d.id[1:])]), 4) for d in fine]
    assert len({d.id for d in coarse} & set(want)) >= 8
    error = max(abs(d.score - float(true[int(d.id[1:])])) for d in coarse)
    assert 0 < error or index.quantize == "FP16"
    assert error < most * 10


def test_only_touched_segments_are_joined_with_tombstones(spark, tmp_path):
    spec = CollectionSpec("parts", (FieldSpec("n", "INT32", True),))
    c = Collection.create_and_open(spark, f"file://{tmp_path}/t", spec)
    for part in range(3):
        c.upsert_df(spark.createDataFrame([(f"p{part}-{k}", k) for k in range(20)], "pk string, n int"))
    assert "Join" not in plan_of(c.docs())
    c.delete(["p1-3", "p1-4"])
    (gone,) = c.manifest.deleted
    assert gone["segments"] == [c.manifest.segments[1]] and gone["rows"] == 2
    plan = plan_of(c.docs())
    assert plan.count("BroadcastHashJoin") == 1 and "Union" in plan and c.docs().count() == 58
    assert "Join" not in plan_of(c.docs(segments=[c.manifest.segments[0], c.manifest.segments[2]]))
