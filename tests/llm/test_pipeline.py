import importlib.util

import pytest

import __spark_entry__
from tessera.llm import bpe, linededup, neardup, quality
from tessera.llm import decontaminate as D

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no corpus_pipeline", allow_module_level=True)

import corpus_pipeline as P


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.score_documents(docs, model).where("predicted = 1").collect()}
    a = P.STAGES[0][1](spark, docs, sf)
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == good
    b = P.STAGES[1][1](spark, a, sf)
    texts = {r.doc_id: r.text for r in linededup.dedup_lines(a).collect()}
    assert b.schema == docs.schema and {r.doc_id: r.text for r in b.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in b.collect() if r.text != dict((x.doc_id, x.text) for x in a.collect())[r.doc_id])
    c = P.STAGES[2][1](spark, b, sf)
    assert {r.doc_id for r in c.collect()} == {r.class_id for r in neardup.join_classes(b).collect()} and c.columns == docs.columns
    d = P.STAGES[3][1](spark, c, sf)
    clean = {r.doc_id for r in D.report(c, spark.read.parquet(f"{sf}/benchmark.parquet")).where("not contaminated").collect()}
    assert {r.doc_id for r in d.collect()} == clean and d.columns == docs.columns
    e = P.STAGES[4][1](spark, d, sf)
    whole = P.run(spark, sf)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, e.collect())) == sorted(map(tuple, bpe.encode_digest(d, bpe.vocabulary_path(), with_ids=True).collect()))
    assert 0 < whole.count() < docs.count()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]


def test_odd_documents_pass_through(spark, odd, sf):
    docs = odd
    for _, stage in P.STAGES[1:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == odd.columns and docs.count() > 0
    assert P.STAGES[4][1](spark, docs, sf).count() == docs.count()
    empty = odd.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_against_brute_force(spark, sf, tmp_path):
    """Every stage's decisions counted out in plain Python on the documents that the stages before it left; some near copies added."""
    import hashlib

    import numpy as np
    import test_decontaminate
    import test_linededup
    import test_neardup
    import test_quality
    import tokenizers

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = docs.where("doc_id % 20 = 3 and length(text) > 400").selectExpr("doc_id + 5000 as doc_id", "concat(text, ' Coda.') as text", "lang", "source", "n_chars + 6 as n_chars")
    docs.unionByName(copies).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    weights, good = model.weights(), []
    for r in docs.collect():
        f = test_quality.plain_features((r.text or "")[:4000], model.settings) if len(r.text or "") <= 4000 else None
        total = (weights[f].mean() if f else 0.0) + model.margin() if f is not None else None
        score = 1 / (1 + np.exp(-total)) if total is not None else quality.scorer(docs, model)([r.text])[0]
        if score >= 0.7:
            good.append((r.doc_id, r.text))
    cut = [(i, text) for i, _, _, text in test_linededup.brute(good)]
    classes = {i: c for i, c, _ in test_neardup.brute(cut)}
    single = [(i, text) for i, text in cut if classes[i] == i]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {x[0] for x in test_decontaminate.quick(single, bench) if x[1]}
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    want = {}
    for i, text in single:
        if i not in dirty:
            ids = library.encode(text or "", add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in P.run(spark, sf).collect()}
    assert got == want and 0 < len(dirty) < len(single) < len(cut) < docs.count()


def test_nothing_is_left_behind_but_the_last_stage(spark, sf):
    from tessera.llm._shared import shared_dir
    from tessera.sources.files import list_names

    at = f"{shared_dir(spark)}/tessera"
    before = set(list_names(spark, at))
    P.run(spark, sf)
    assert [x.split("-")[0] for x in set(list_names(spark, at)) - before] == ["stage"]
