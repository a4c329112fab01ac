import re
import zlib

import numpy as np

from tessera.llm import quality as Q


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = Q.fit(docs, labels)
    out = Q.score_documents(docs, model).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in out])
    good = np.array([r.score for r in out if r.quality == 1])
    bad = np.array([r.score for r in out if r.quality == 0])
    assert right > 0.95 and (good[:, None] > bad[None, :]).mean() > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    again = Q.fit(docs.repartition(7), labels.repartition(3))
    assert (again.vectors == model.vectors).all() and again.margin() == model.margin()


def test_learns_nothing_from_held_out_rows(spark):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "good text" if i % 2 else "bad!!") for i in ids], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    assert Q.score_documents(docs, Q.fit(docs, labels)).where("score != 0.5").count() == 0


def test_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (8, 0), (None, 1), (4, None), (99, 0)], "doc_id long, quality int")
    model = Q.fit(odd, labels)
    out = Q.score_documents(odd, model)
    assert out.count() == odd.count() and out.where("score is null or held_out is null").count() == 0
    assert Q.score_documents(none, model).count() == 0
    assert Q.fit(none, labels.limit(0)).margin() == 0.0
    kept = Q.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == out.where("predicted = 1").count()


def test_blocks_cover_the_text():
    s, t = Q.Settings(), Q.Settings(block=50)
    data = "ab cdé f. 日本 " * 40
    count = lambda s: np.bincount(np.concatenate(list(Q.features(data, s))), minlength=s.buckets)
    a, b = count(s), count(t)
    assert abs(a.sum() - b.sum()) <= 40 and (a > 0).sum() <= (b > 0).sum() + 5
    assert list(Q.features("", s)) == []


def plain_features(text, s):
    """Buckets of a text by plain integers: character n-grams, words, pairs of words."""
    wrap, mix = (1 << 64) - 1, int(Q.MIX)

    def spread(h):
        h = ((h ^ (h >> 29)) * mix) & wrap
        return (h ^ (h >> 32)) % s.buckets

    out = []
    for n in s.sizes:
        for k in range(len(text) - n + 1):
            h = 0
            for c in text[k : k + n]:
                h = (h * mix + ord(c) + 1) & wrap
            out.append(spread((h + n) & wrap))
    words = []
    for w in re.split("[ \t\n\x0b\x0c\r]+", text):
        if w:
            h = 0
            for k, c in enumerate(w):
                x = ((ord(c) + k * 1114117 + 3) * mix) & wrap
                h = (h + ((x ^ (x >> 31)) * mix)) & wrap
            words.append(h)
    out += [spread((h + 0x5151) & wrap) for h in words]
    out += [spread(((a ^ b) + 0x7272) & wrap) for a, b in zip(words, words[1:])]
    return out


def test_scores_against_plain_softmax(spark):
    """Every score of sf0.001 is the softmax of the mean of the vectors of plainly found features."""
    d, s = "/root/testdata/sf0.001", Q.Settings(epochs=2)
    docs = spark.read.parquet(f"{d}/documents.parquet").where("length(text) < 2500").limit(40)
    model = Q.fit(docs, spark.read.parquet(f"{d}/labels.parquet"), s)
    got = {r.doc_id: r.score for r in Q.score_documents(docs, model).collect()}
    assert len(set(got.values())) > 10
    for r in docs.collect():
        f = plain_features(r.text or "", s)
        mean = model.vectors[f].astype(np.float64).mean(axis=0) if f else np.zeros(s.dim)
        z = mean @ model.out.astype(np.float64) + model.bias
        assert abs(got[r.doc_id] - np.exp(z[1]) / np.exp(z).sum()) < 1e-5


def test_training_against_plain_steps():
    s, texts, labels = Q.Settings(buckets=64, dim=3, epochs=3), ["good day", "bad bad", "", "so so"], [1, 0, 1, 0]
    model = Q.train(texts, labels, s)
    rng = np.random.default_rng(s.seed)
    v, out, bias = rng.uniform(-1 / 3, 1 / 3, (64, 3)).astype(np.float32).astype(float).tolist(), [[0.0] * 2 for _ in range(3)], [0.0, 0.0]
    done = 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(texts)):
            rate, done = s.rate * (1 - done / (s.epochs * len(texts))), done + 1
            f = plain_features(texts[i], s)
            share = {b: f.count(b) / len(f) for b in set(f)}
            mean = [sum(n * v[b][k] for b, n in share.items()) for k in range(3)]
            z = [sum(mean[k] * out[k][c] for k in range(3)) + bias[c] for c in (0, 1)]
            p = [np.exp(z[c]) / (np.exp(z[0]) + np.exp(z[1])) - (c == labels[i]) for c in (0, 1)]
            back = [sum(out[k][c] * p[c] for c in (0, 1)) for k in range(3)]
            for c in (0, 1):
                for k in range(3):
                    out[k][c] -= rate * mean[k] * p[c]
                bias[c] -= rate * 0.1 * p[c]
            for b, n in share.items():
                for k in range(3):
                    v[b][k] -= rate * n / max(1e-6, sum(x * x for x in share.values())) * back[k] * 0.05
    assert np.allclose(model.vectors, v, atol=1e-4) and np.allclose(model.out, out, atol=1e-4) and np.allclose(model.bias, bias, atol=1e-4)


def test_long_texts_are_learned_from(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, ("fine words " if i % 2 else "?? !! ") * 20_000) for i in ids] + [(ids[0], "another text of the same id")], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    assert len({r.score > 0.5 for r in Q.score_documents(docs, Q.fit(docs, labels)).collect()}) == 2
    none_fits = Q.fit(docs, labels, Q.Settings(train_bytes=10))
    assert Q.score_documents(docs, none_fits).where("score != 0.5").count() == 0
