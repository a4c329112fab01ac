import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument, NotFound
from tessera.functions import metrics as M
from tessera.functions import quantize as Q
from tessera.operators import cluster as C
from tessera.operators import search as S

RNG = np.random.default_rng(5)
X = RNG.normal(size=(300, 6)).astype(np.float32).astype(float)
X[7] = X[3]
X[20] = 0
QUERY = X[3].tolist()
SIGN = {"L2": 1, "COSINE": 1, "IP": -1}


@pytest.fixture(scope="module")
def base(spark):
    rows = [(i, i % 5, X[i].tolist()) for i in range(len(X))] + [(1000, 0, None), (1001, None, [1.0, 2.0]), (1002, 1, [None, 1.0, 1.0, 1.0, 1.0, 1.0])]
    return spark.createDataFrame(rows, "id int, g int, v array<float>").cache()


def scores(metric, q=QUERY):
    return M.score_matrix(metric, X, np.array([q]))[:, 0]


def best(metric, k, keep=lambda i: True):
    s = scores(metric)
    return sorted((i for i in range(len(X)) if keep(i)), key=lambda i: (SIGN[metric] * round(s[i], 9), i))[:k]


@pytest.mark.parametrize("metric", ["L2", "IP", "COSINE"])
def test_knn(base, metric):
    out = S.knn(base, QUERY, 9, "id", "v", metric).collect()
    assert [r.id for r in out] == best(metric, 9)
    assert np.allclose([r.score for r in out], scores(metric)[[r.id for r in out]])


def test_vectors_without_a_score_stay_out(spark, base):
    odd = base.where("id >= 1000")
    assert S.knn(odd, QUERY, 5, "id", "v").count() == S.range_search(odd, QUERY, 99.0, "id", "v").count() == 0
    queries = spark.createDataFrame([(1, QUERY)], "q int, w array<float>")
    assert S.knn_batch(odd, queries, 5, "id", "v", "q", "w").count() == 0
    assert S.group_topk(odd, QUERY, "g", 2, 2, "id", "v").count() == 0


def test_cosine_of_zero_vector_is_one(base):
    assert S.knn(base.where("id = 20"), QUERY, 1, "id", "v", "COSINE").first().score == 1.0


def test_filter_range_empty(base):
    assert [r.id for r in S.knn(base, QUERY, 5, "id", "v", "L2", F.col("g") == 3).collect()] == best("L2", 5, lambda i: i % 5 == 3)
    s = scores("L2")
    assert {r.id for r in S.range_search(base, QUERY, 6.0, "id", "v").collect()} == {i for i in range(len(X)) if s[i] <= 6.0}
    ip = scores("IP")
    assert {r.id for r in S.range_search(base, QUERY, 2.0, "id", "v", "IP").collect()} == {i for i in range(len(X)) if ip[i] >= 2.0}
    assert S.knn(base.limit(0), QUERY, 5, "id", "v").count() == 0
    assert S.knn(base, QUERY, 0, "id", "v").count() == 0
    with pytest.raises(InvalidArgument):
        S.knn(base, QUERY, 100_001, "id", "v")


def test_by_key(base):
    assert np.allclose(S.vector_of(base, "id", 3, "v"), QUERY)
    with pytest.raises(NotFound):
        S.vector_of(base, "id", 1000, "v")


def test_group_topk(base):
    out = S.group_topk(base, QUERY, "g", 2, 3, "id", "v", "L2").orderBy("group_rank", "rank").collect()
    s = scores("L2")
    groups = sorted(range(5), key=lambda g: min((s[i], i) for i in range(len(X)) if i % 5 == g))[:3]
    assert [(r.group_id, r.id) for r in out] == [(str(g), i) for g in groups for i in best("L2", 2, lambda i, g=g: i % 5 == g)]


@pytest.mark.parametrize("metric,block", [("L2", 1 << 20), ("IP", 2000), ("COSINE", 2000)])
def test_batch(spark, base, metric, block):
    queries = spark.createDataFrame([(f"q{i}", X[i].tolist()) for i in range(0, 60, 3)], "q string, w array<float>")
    out = S.knn_batch(base, queries, 4, "id", "v", "q", "w", metric, block).collect()
    got = {}
    for r in sorted(out, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.id)
    for i in range(0, 60, 3):
        s = M.score_matrix(metric, X, X[i : i + 1])[:, 0]
        want = sorted(range(len(X)), key=lambda k: (SIGN[metric] * s[k], k))[:4]
        assert np.allclose(s[got[f"q{i}"]], s[want])
    assert S.knn_batch(base, queries.limit(0), 4, "id", "v", "q", "w").count() == 0


def plain(metric, x, q, k):
    """Scores and rows of the k best for each query, pair by pair in order of the dimensions; ties by row."""
    out = []
    for v in q:
        s = np.add.accumulate((x - v) ** 2 if metric == "L2" else x * v, 1)[:, -1]
        if metric == "COSINE":
            s = 1 - s / (np.sqrt(np.add.accumulate(x * x, 1)[:, -1]) * np.sqrt(np.add.accumulate(v * v)[-1]))
        first = np.lexsort((np.arange(len(x)), SIGN[metric] * s))[:k]
        out.append((s[first].tolist(), first.tolist()))
    return out


@pytest.mark.parametrize("every", [1, 40])
@pytest.mark.parametrize("metric", ["L2", "IP", "COSINE"])
def test_batch_of_copies_far_from_zero(spark, metric, every):
    """Copies tie and go by key, in another partition and block too; near vectors far from zero are told apart. every: of how many
    rows one is a query, so that the base or the queries are broadcast."""
    x = np.random.default_rng(3).normal(size=(400, 6)) / 1000 + 1000
    x[200:] = x[:200]
    x[50:90] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows[::-1], "id int, v array<double>").repartition(5)
    queries = df.where(F.col("id") % every == 0).select(F.col("id").alias("q"), "v")
    got = {}
    for r in S.knn_batch(df, queries, 4, "id", "v", "q", "v", metric, 8000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, ([], []))
        got[r.query_id][0].append(r.score)
        got[r.query_id][1].append(r.id)
    assert got == dict(zip(range(0, 400, every), plain(metric, x, x[::every], 4)))


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e25])
@pytest.mark.parametrize("metric", ["L2", "IP", "COSINE"])
def test_batch_scores_few_pairs_exactly(monkeypatch, metric, scale):
    """Most pairs are told from the best by products of single precision; whatever the size of the values, the best are right."""
    x = np.random.default_rng(4).normal(size=(3000, 16)) * scale
    x[2000:2500] = x[7]
    taken, exact = [], S._Sides.exact
    monkeypatch.setattr(S._Sides, "exact", lambda self, q, norm, j: taken.append(len(j)) or exact(self, q, norm, j))
    ids = pa.array(range(3000), pa.int64())
    out = pa.Table.from_batches(S._answers(S._distinct(ids, x, 5), ids, x, 5, metric, (pa.int64(), pa.int64()))).to_pydict()
    want = plain(metric, x, x, 5)
    assert out["query_id"] == [i for i in range(3000) for _ in range(5)]
    assert out["key"] == [j for _, rows in want for j in rows] and out["score"] == [s for scores, _ in want for s in scores]
    assert sum(taken) < 0.03 * 3000 * 3000


def test_refined_and_recall(spark, base):
    coarse = M.squared_l2(Q.dequantize(Q.int4(F.col("v"))), M.vector_lit(QUERY))
    assert [r.id for r in S.refined(base.where("id < 1000"), coarse, QUERY, 5, "id", "v").collect()] == best("L2", 5)
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id int, key int, rank int")
    b = spark.createDataFrame([(1, 1, 1), (1, 9, 2)], "query_id int, key int, rank int")
    assert S.recall_at(b, a, 2).first().recall == 0.5


def test_sparse(spark):
    rows = [(1, ([1, 5], [2.0, 1.0])), (2, ([5], [4.0])), (3, ([], [])), (4, None)]
    df = spark.createDataFrame(rows, "id int, v struct<indices:array<long>,values:array<float>>")
    assert [(r.id, r.score) for r in S.sparse_knn(df, {1: 1.0, 5: 0.5, 9: 3.0}, 10, "id", "v").collect()] == [(1, 2.5), (2, 2.0), (3, 0.0)]
    assert S.sparse_knn(df, {}, 10, "id", "v").first().score == 0.0
    assert df.where("id = 1").select(M.sparse_squared_l2(F.col("v.indices"), F.col("v.values"), {1: 1.0})).first()[0] == 2.0


def test_quantizers(spark, base):
    one = base.where("id < 300")
    for q, tolerance in ((Q.int8, 0.03), (Q.int4, 0.4)):
        back = np.array([r[0] for r in one.select(Q.dequantize(q(F.col("v"))), "id").orderBy("id").collect()])
        assert np.abs(back - X).max() < tolerance
    half = np.array([r[0] for r in one.select(Q.fp16(F.col("v")), "id").orderBy("id").collect()])
    assert (half == X.astype(np.float16)).all()
    unit = np.array([r[0] for r in one.select(Q.revert_normalized(Q.cosine_normalized(F.col("v"))), "id").orderBy("id").collect()])
    assert np.allclose(unit, X)
    codes = one.select("id", Q.int4(F.col("v")).alias("q")).select("id", "q.codes", Q.pack_int4(F.col("q.codes")).alias("p"))
    for r in codes.select("codes", Q.unpack_int4(F.col("p"), 6).alias("u"), F.size("p").alias("n")).collect():
        assert r.codes == r.u and r.n == 3
    bits = np.array([r[0] for r in one.select(Q.unbinary(Q.binary(F.col("v"), 0.0, 4), 6, 4), "id").orderBy("id").collect()])
    assert (bits == np.where(X >= 0, 1, -1)).all()
    scale, bias = Q.train_global(one, "v", 8)
    back = np.array([r[0] for r in one.select(Q.from_global_int(Q.global_int(F.col("v"), scale, bias), scale, bias), "id").orderBy("id").collect()])
    assert np.median(np.abs(back - X)) < 0.03
    rot = Q.random_rotation(6)
    assert np.allclose(rot @ rot.T, np.eye(6))


@pytest.mark.parametrize("bits,off", [(8, 0.05), (4, 0.6), (1, 5.0)])
def test_rabitq(spark, bits, off):
    """Codes of signs alone up to 8 bits: estimates of distances and products against the true ones; nulls stay nulls."""
    r = np.random.default_rng(2)
    x, q = r.normal(size=(200, 32)) + 3, r.normal(size=32) + 3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(200, None)], "id long, v array<double>")
    rotation, centroids = Q.random_rotation(32), np.array([x[:100].mean(0), x[100:].mean(0)])
    code = df.withColumn("c", Q.rabitq(F.col("v"), rotation, centroids, bits))
    true = {"L2": ((x - q) ** 2).sum(1), "IP": x @ q}
    for metric, want in true.items():
        got = [row[0] for row in code.select(Q.rabitq_score(F.col("c"), q, rotation, centroids, metric, bits).alias("s"), "id").orderBy("id").collect()]
        assert got[200] is None
        error = np.array(got[:200]) - want
        assert np.abs(error).mean() < off * 4 and abs(error.mean()) < off * 2  # no bias to speak of
    back = [row[0] for row in code.select(Q.from_rabitq(F.col("c"), rotation, centroids, bits), "id").orderBy("id").collect()]
    assert back[200] is None and np.corrcoef(((np.array(back[:200]) - q) ** 2).sum(1), true["L2"])[0, 1] > 0.8
    assert all(max(row.c.codes) < 2**bits for row in code.where("id < 200").collect())


@pytest.mark.parametrize("metric", ["L2", "IP", "COSINE"])
@pytest.mark.parametrize("kind", ["INT8", "INT4", "FP16"])
def test_scores_from_codes(base, metric, kind):
    """Integer codes give the scores of the vectors that they stand for."""
    code = {"kind": kind}
    one = base.where("id < 300").withColumn("c", Q.encoded(F.col("v"), code))
    direct = Q.coded_score(F.col("c"), code, QUERY, metric)
    if kind == "FP16":
        assert direct is None
        return
    rows = one.select(direct.alias("a"), M.score(metric, Q.decoded(F.col("c"), code), QUERY).alias("b")).collect()
    assert len(rows) == 300 and np.allclose([r.a for r in rows], [r.b for r in rows], atol=1e-9)


def test_fp16_of_odd_rows(spark):
    df = spark.createDataFrame([(0, [0.1, 2.0]), (1, None), (2, []), (3, [70000.0])], "id int, v array<float>")
    got = [r[0] for r in df.select(Q.fp16(F.col("v")), "id").orderBy("id").collect()]
    assert got == [[float(np.float16(0.1)), 2.0], None, [], [float("inf")]]


def test_mips_order_is_that_of_the_product(base):
    one = base.where("id < 300")
    eta = 1 / np.sqrt((X * X).sum(1)).max()
    for kind in ("spherical", "quadratic"):
        s = np.array([r[0] for r in one.select(M.mips_l2(F.col("v"), M.vector_lit(QUERY), float(eta), kind, 5), "id").orderBy("id").collect()])
        if kind == "spherical":
            assert s.argmin() == scores("IP").argmax()
        stored = np.array([r[0] for r in one.select(Q.mips_inject(F.col("v"), float(eta), kind, 5), "id").orderBy("id").collect()])
        q = np.concatenate((np.array(QUERY) / np.linalg.norm(QUERY), np.zeros(stored.shape[1] - 6)))
        assert np.allclose(((stored - q) ** 2).sum(1), s)


def test_cells(spark, base, tmp_path):
    one = base.where("id < 300")
    c = C.kmeans(one, "v", 8, "id")
    assert len(c.points) == 8
    cells = C.assign_cells(base, c, "v").select("id", "cell_id").collect()
    want = M.score_matrix("L2", X, c.points).argmin(1)
    assert all(r.cell_id == (want[r.id] if r.id < 300 else -1) for r in cells)
    index = C.IvfIndex.build(one, f"file://{tmp_path}/ivf", "v", "id", "L2", 8)
    again = C.IvfIndex.open(spark, f"file://{tmp_path}/ivf")
    assert [r.id for r in again.search(QUERY, 5, 8).collect()] == best("L2", 5)
    assert index.search(QUERY, 1, 1).first().id in (3, 7)
    plan = index.search(QUERY, 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell_id" in plan
    assert len(C.kmeans(one.limit(0), "v", 4, "id").points) == 0
    assert len(C.two_level(one, "v", "id", 2, 3).points) == 6


def test_kmeans_cells_of_vectors_that_take_300_rounds(spark, tmp_path):
    from oracle import spark_rows, sql_rows

    from tessera.queries import ORACLES, QUERIES

    x = np.random.default_rng(5).normal(size=(10_000, 8)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    assert spark_rows(QUERIES["kmeans_cells"](spark, str(tmp_path))) == sql_rows(ORACLES["kmeans_cells"], tmp_path)


@pytest.mark.parametrize("cosine", [False, True])
@pytest.mark.parametrize("rows", [0, 40, 300])
def test_kmeans_without_a_limit_ends_where_points_stay(base, monkeypatch, cosine, rows):
    """rows: as many as the driver takes for rounds near the borders; with 0 these are plain rounds."""
    monkeypatch.setattr(C, "NEAR_BYTES", rows * 6 * 8)
    taken, near = [], C._near
    monkeypatch.setattr(C, "_near", lambda *a: taken.append(near(*a)) or taken[-1])
    c = C.kmeans(base, "v", 8, "id", None, cosine=cosine)
    assert all(len(group) == len(x) <= rows for group, x in taken) and any(len(x) for _, x in taken) == (rows > 0)
    cell = c.distances(X).argmin(1)
    unit = X / np.maximum(1e-12, np.sqrt((X * X).sum(1)))[:, None] if cosine else X
    assert np.allclose(c.points, [unit[cell == i].mean(0) for i in range(8)])
    if not rows:
        assert np.allclose(c.points, C.kmeans(base, "v", 8, "id", 1000, cosine=cosine).points)


def test_near_rounds_of_groups_stay_in_their_groups(spark):
    """Of two groups with the same vectors each has its own points; a group without points takes no part."""
    g, start = np.repeat([0, 1, 2], 300), np.concatenate((X[:4], X[100:103]))
    own = spark.createDataFrame([(int(k), X[i % 300].tolist()) for i, k in enumerate(g)], "group int, v array<float>")
    points = C._lloyd(own, start, np.array([0] * 4 + [1] * 3), None, False)
    for mine in (points[:4], points[4:]):
        cell = M.score_matrix("L2", X, mine).argmin(1)
        assert np.allclose(mine, [X[cell == i].mean(0) for i in range(len(mine))])


def test_hits_of_ivf_are_mostly_right(spark, base):
    one = base.where("id < 300")
    c = C.kmeans(one, "v", 8, "id", seed=1)
    near = M.score_matrix("L2", X, c.points).argmin(1)
    found = 0
    for i in range(0, 300, 10):
        s = M.score_matrix("L2", X, X[i : i + 1])[:, 0]
        top = set(np.argsort(s)[:5])
        found += len(top & {k for k in range(300) if near[k] in c.nearest(X[i], 6)})
    assert found / (30 * 5) > 0.9


def test_recall_of_the_registered_ivf(spark, sf):
    from tessera.queries import QUERIES

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding")
    truth = S.knn_batch(e, queries, 10, "vec_id", "embedding", "q", "embedding", "L2")
    report = S.recall_at(QUERIES["ivf_knn"](spark, sf), truth, 10, key="vec_id").first()
    assert report.expected == 10 * queries.count() and report.recall >= 0.9


def test_batch_in_all_cells_is_exact(spark, base, tmp_path):
    one = base.where("id < 300")
    index = C.IvfIndex.build(one, f"file://{tmp_path}/ivf", "v", "id", "L2", 8)
    queries = one.where("id % 7 = 0").select(F.col("id").alias("q"), "v")
    want = S.knn_batch(one, queries, 5, "id", "v", "q", "v", "L2").select("query_id", "id", "rank").collect()
    for size in (1 << 20, 1500):
        assert sorted(index.search_batch(queries, 5, 8, "q", "v", size).select("query_id", "id", "rank").collect()) == sorted(want)
    few = {r.q: [x.id for x in index.search(r.v, 5, 2).collect()] for r in queries.limit(4).collect()}
    got = {}
    for r in index.search_batch(queries, 5, 2, "q", "v").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert all(got[q] == ids for q, ids in few.items())


def test_statistics(spark):
    from tessera.operators.statistics import histogram, latency_report, selectivity

    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "x double")
    h = histogram(df, "x", 4).orderBy("bin").collect()
    assert [r.n for r in h] == [25, 25, 25, 25] and h[-1].share == 1.0 and h[0].low == 0.0
    assert histogram(df.limit(0), "x").count() == 0 and histogram(df.where("x = 3"), "x").first().n == 1
    assert abs(selectivity(df, "x", 10, 59) - 0.5) < 0.03 and selectivity(df.limit(0), "x") == 0.0
    r = latency_report(spark.createDataFrame([(0.1,), (0.3,)], "seconds double"), threads=2).first()
    assert r.queries == 2 and abs(r.average - 0.2) < 1e-9 and abs(r.p50 - 0.2) < 1e-9 and abs(r.qps - 10) < 1e-9
