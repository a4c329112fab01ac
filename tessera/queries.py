"""Queries over the test tables, one or more for each operator, with the SQL that gives the same rows where there is such SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.functions import quantize as Q
from tessera.operators import cluster as C
from tessera.operators import fulltext as X
from tessera.operators import rerank as R
from tessera.operators import search as S
from tessera.operators.collection import Collection, Doc
from tessera.operators.statistics import histogram
from tessera.plans.expressions import compile_expression
from tessera.plans.filters import has_prefix, has_suffix, where
from tessera.schema import CollectionSpec, FieldSpec, FlatIndex, FtsIndex, IvfIndex
from tessera.sources import files
from tessera.streaming.ingest import sessions, stream_upsert, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- filters, projection, limit ---------------------------------------------------------------------------------------------

LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
LINE_SQL = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE "


@query(LINE_SQL + "l_quantity >= 45 AND l_discount < 0.03 AND l_extendedprice > 20000.5 AND l_linenumber <= 3")
def filter_cmp(spark, d):
    return where(table(spark, d, "lineitem"), "l_quantity >= 45 and l_discount < 0.03 AND l_extendedprice > 20000.5 AND l_linenumber <= 3").select(*LINE)


@query(LINE_SQL + "l_returnflag <> 'N' AND l_linenumber <> 1")
def filter_ne(spark, d):
    return where(table(spark, d, "lineitem"), "l_returnflag != 'N' AND l_linenumber != 1").select(*LINE)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name LIKE '%0_1%' AND c_mktsegment LIKE '%U%'")
def filter_like(spark, d):
    return where(table(spark, d, "customer"), "c_name LIKE '%0_1%' AND c_mktsegment LIKE \"%U%\"").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_mktsegment, 'BU') AND ends_with(c_name, '7')")
def filter_prefix_suffix(spark, d):
    c = table(spark, d, "customer")
    spec = CollectionSpec.of(c.schema)
    return c.where(has_prefix("c_mktsegment", "BU", spec) & has_suffix("c_name", "7", spec)).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') OR o_orderstatus IN ('F', 'P')")
def filter_in(spark, d):
    return where(table(spark, d, "orders"), "o_orderpriority IN ('1-URGENT', '3-MEDIUM') OR o_orderstatus = 'F' OR o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '3-MEDIUM')")
def filter_not_in(spark, d):
    return where(table(spark, d, "orders"), "o_orderpriority NOT IN ('1-URGENT', '3-MEDIUM')").select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer WHERE NOT c_acctbal >= 0 OR c_acctbal > 9000")
def filter_null(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return where(c, "balance IS NULL OR balance > 9000")


@query("SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, c_mktsegment FROM customer) WHERE balance IS NOT NULL AND balance <> 1 AND c_mktsegment NOT IN ('BUILDING')")
def filter_not_null(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return where(c, "balance IS NOT NULL AND balance != 1 AND c_mktsegment NOT IN ('BUILDING')").select("c_custkey")


@query(LINE_SQL + "(l_quantity < 5 OR l_quantity > 48) AND (l_returnflag = 'R' OR l_linestatus = 'O' AND l_tax >= 0.05)")
def filter_bool_tree(spark, d):
    return where(table(spark, d, "lineitem"), "(l_quantity < 5 OR l_quantity > 48) AND (l_returnflag = 'R' OR l_linestatus = 'O' AND l_tax >= 0.05)").select(*LINE)


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars < 0")
def filter_unsatisfiable(spark, d):
    return where(table(spark, d, "documents"), "n_chars < 0 AND n_chars > 5").select("doc_id", "n_chars")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag NOT IN ('N', 'R')")
def filter_quirk_or_of_ne(spark, d):
    return where(table(spark, d, "lineitem"), "l_returnflag != 'N' OR l_returnflag != 'R'", reference_quirks=True).select(*LINE)


def words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("words"))


WORDS_SQL = "WITH w AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents) SELECT doc_id FROM w WHERE "


@query(WORDS_SQL + "list_has_all(words, ['the', 'of', 'thing'])")
def array_contain_all(spark, d):
    return where(words(spark, d), "words CONTAIN_ALL ('the', 'of', 'thing')").select("doc_id")


@query(WORDS_SQL + "list_has_any(words, ['der', 'las', 'les'])")
def array_contain_any(spark, d):
    return where(words(spark, d), "words contain_any ('der', 'las', 'les')").select("doc_id")


@query(WORDS_SQL + "NOT list_has_any(words, ['the', 'der']) AND NOT list_has_all(words, ['de', 'la'])")
def array_not_contain(spark, d):
    return where(words(spark, d), "words NOT CONTAIN_ANY ('the', 'der') AND words NOT CONTAIN_ALL ('de', 'la')").select("doc_id")


@query(WORDS_SQL + "len(words) >= 500 OR len(words) = 2")
def array_length(spark, d):
    return where(words(spark, d), "array_length(words) >= 500 OR array_length(words) = 2").select("doc_id")


@query(WORDS_SQL + "words IS NOT NULL")
def array_empty_lists(spark, d):
    return where(words(spark, d), "words CONTAIN_ALL () OR words CONTAIN_ANY ()").select("doc_id")


@query("SELECT c_name, c_custkey FROM customer")
def project_subset(spark, d):
    return files.read_table(spark, f"{d}/customer.parquet", ["c_name", "c_custkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25")
def scan_limit(spark, d):
    return where(table(spark, d, "orders"), "o_orderstatus = 'F'").orderBy("o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query(
    "WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 32 AS w FROM lineitem), b AS (SELECT CAST(least(31, floor((l_extendedprice - lo) / w)) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY bin) "
    "SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / (sum(n) OVER ()), 6) AS share FROM b"
)
def column_distribution(spark, d):
    return histogram(table(spark, d, "lineitem"), "l_extendedprice", 32).select("bin", "n", F.round("share", 6).alias("share"))


# --- vectors ----------------------------------------------------------------------------------------------------------------


def vectors(spark, d):
    return table(spark, d, "embeddings")


def stored(spark, d, i=0):
    return S.vector_of(vectors(spark, d), "vec_id", i, "embedding")


V = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, q FROM embeddings, q) "
L2 = "pow(list_distance(v, q), 2)"


def knn_sql(score: str, order: str, k: int, cond: str = "TRUE") -> str:
    return V + f"SELECT vec_id, round(s, 6) + 0.0 AS score FROM (SELECT vec_id, label, {score} AS s FROM e) WHERE {cond} ORDER BY s {order}, vec_id LIMIT {k}"


def short(df):
    return df.select("vec_id", (F.round("score", 6) + 0.0).alias("score"))  # no negative zero


@query(knn_sql(L2, "", 10))
def knn_l2(spark, d):
    return short(S.knn(vectors(spark, d), stored(spark, d), 10, "vec_id", "embedding", "L2"))


@query(knn_sql("list_inner_product(v, q)", "DESC", 10))
def knn_ip(spark, d):
    return short(S.knn(vectors(spark, d), stored(spark, d), 10, "vec_id", "embedding", "IP"))


@query(knn_sql("1 - list_cosine_similarity(v, q)", "", 10))
def knn_cosine(spark, d):
    return short(S.knn(vectors(spark, d), stored(spark, d), 10, "vec_id", "embedding", "COSINE"))


@query(knn_sql(L2, "", 20, "label IN (1, 3, 5)"))
def knn_filtered(spark, d):
    from tessera.plans.filters import compile_filter

    e = vectors(spark, d)
    return short(S.knn(e, stored(spark, d), 20, "vec_id", "embedding", "L2", compile_filter("label IN (1, 3, 5)", CollectionSpec.of(e.schema))))


@query(V + f"SELECT vec_id, round({L2}, 6) AS score FROM e WHERE {L2} <= 1.5")
def knn_range(spark, d):
    return short(S.range_search(vectors(spark, d), stored(spark, d), 1.5, "vec_id", "embedding", "L2"))


@query(V.replace("vec_id = 0", "vec_id = 17") + f"SELECT vec_id, round({L2}, 6) AS score FROM e ORDER BY {L2}, vec_id LIMIT 5")
def knn_by_id(spark, d):
    return short(S.knn(vectors(spark, d), stored(spark, d, 17), 5, "vec_id", "embedding", "L2"))


@query(
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, pow(list_distance(a.v, b.v), 2) AS s FROM e a, e b), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(s, 5) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"
)
def knn_batch(spark, d):
    e = vectors(spark, d)
    out = S.knn_batch(e, e.select(F.col("vec_id").alias("q"), "embedding"), 3, "vec_id", "embedding", "q", "embedding", "L2")
    return out.select("query_id", "vec_id", (F.round("score", 5) + 0.0).alias("score"), "rank")


@query(
    V + f", s AS (SELECT vec_id, CAST(label AS VARCHAR) AS group_id, {L2} AS s FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY s, vec_id) AS rank FROM s), "
    "g AS (SELECT group_id, row_number() OVER (ORDER BY s, vec_id) AS group_rank FROM r WHERE rank = 1) "
    "SELECT group_id, CAST(group_rank AS INTEGER) AS group_rank, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 6) AS score FROM r JOIN g USING (group_id) WHERE rank <= 2 AND group_rank <= 3"
)
def knn_group_topk(spark, d):
    out = S.group_topk(vectors(spark, d), stored(spark, d), "label", 2, 3, "vec_id", "embedding", "L2")
    return out.select("group_id", "group_rank", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(knn_sql(L2, "", 10))
def knn_refine(spark, d):
    q = stored(spark, d)
    e = vectors(spark, d).withColumn("code", Q.int8(F.col("embedding")))
    coarse = M.score("L2", Q.dequantize(F.col("code")), q)
    return short(S.refined(e, coarse, q, 10, "vec_id", "embedding", "L2", 10))


def record_grid_sql(steps: int, least: int) -> str:
    return (
        V + ", m AS (SELECT vec_id, v, q, list_min(v) AS lo, list_max(v) AS hi FROM e), "
        f"c AS (SELECT vec_id, q, lo, CASE WHEN hi > lo THEN {steps} / (hi - lo) ELSE 1 END AS scale, v FROM m), "
        f"z AS (SELECT vec_id, q, list_transform(v, lambda x: round((x - lo) * scale + {least}) / scale + lo - {least} / scale) AS w FROM c) "
        "SELECT vec_id, round(pow(list_distance(w, q), 2), 6) AS score FROM z ORDER BY pow(list_distance(w, q), 2), vec_id LIMIT 10"
    )


@query(record_grid_sql(254, -127))
def knn_int8(spark, d):
    e = vectors(spark, d).withColumn("q", Q.int8(F.col("embedding"))).withColumn("w", Q.dequantize(F.col("q")))
    return short(S.knn(e, stored(spark, d), 10, "vec_id", "w", "L2"))


@query(record_grid_sql(15, -8))
def knn_int4(spark, d):
    packed = Q.pack_int4(F.col("q.codes"))
    e = vectors(spark, d).withColumn("q", Q.int4(F.col("embedding"))).withColumn("p", packed)
    back = F.struct(Q.unpack_int4(F.col("p"), 64).alias("codes"), F.col("q.scale").alias("scale"), F.col("q.bias").alias("bias"))
    e = e.withColumn("w", Q.dequantize(back))
    return short(S.knn(e, stored(spark, d), 10, "vec_id", "w", "L2"))


@query(
    V + ", z AS (SELECT vec_id, q, list_transform(v, lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x / pow(2, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(x))), -14) - 10) END) AS w FROM e) "
    "SELECT vec_id, round(pow(list_distance(w, q), 2), 6) + 0.0 AS score FROM z ORDER BY pow(list_distance(w, q), 2), vec_id LIMIT 10"
)
def knn_fp16(spark, d):
    return short(S.knn(vectors(spark, d).withColumn("w", Q.fp16(F.col("embedding"))), stored(spark, d), 10, "vec_id", "w", "L2"))


@query()
def knn_global_int8(spark, d):
    e = vectors(spark, d)
    scale, bias = Q.train_global(e, "embedding")
    return short(S.knn(e.withColumn("w", Q.from_global_int(Q.global_int(F.col("embedding"), scale, bias), scale, bias)), stored(spark, d), 10, "vec_id", "w", "L2"))


@query(V + "SELECT vec_id, CAST(list_sum(list_transform(list_zip(v, q), lambda p: CASE WHEN (p[1] >= 0) <> (p[2] >= 0) THEN 1 ELSE 0 END)) AS DOUBLE) AS score FROM e ORDER BY score, vec_id LIMIT 10")
def knn_binary(spark, d):
    e = vectors(spark, d).withColumn("b", Q.binary(F.col("embedding")))
    q = S.vector_of(e, "vec_id", 0, "b")
    return e.withColumn("score", M.hamming(F.col("b"), F.array(*[F.lit(x).cast("long") for x in q]))).orderBy("score", "vec_id").limit(10).select("vec_id", "score")


@query(knn_sql(L2, "", 10))
def knn_rabitq(spark, d):
    """The 100 best by estimates from codes of 7 bits, then the 10 best of these."""
    e, rotation = vectors(spark, d), Q.random_rotation(64)
    centroids = C.kmeans(e, "embedding", 4, "vec_id", 3).points
    code = Q.rabitq(F.col("embedding"), rotation, centroids)
    q = stored(spark, d)
    return short(S.refined(e.withColumn("code", code), Q.rabitq_score(F.col("code"), q, rotation, centroids), q, 10, "vec_id", "embedding", "L2", 10))


@query(
    V + ", u AS (SELECT max(sqrt(list_inner_product(v, v))) AS top FROM e), s AS (SELECT vec_id, v, q, top, list_inner_product(v, v) / (top * top) AS n2 FROM e, u) "
    "SELECT vec_id, round(n2 + 1 - 2 * list_inner_product(v, q) / (top * sqrt(list_inner_product(q, q))) + greatest(0, 1 - n2), 6) + 0.0 AS score FROM s ORDER BY list_inner_product(v, q) DESC, vec_id LIMIT 10"
)
def knn_mips(spark, d):
    e, q = vectors(spark, d), stored(spark, d)
    top = e.agg(F.max(M.norm_l2(F.col("embedding")))).first()[0]
    score = M.mips_l2(F.col("embedding"), M.vector_lit(q), 1 / top)
    return short(e.withColumn("score", score).orderBy("score", "vec_id").limit(10))


@query(knn_sql("1 - list_cosine_similarity(v, q)", "", 10))
def knn_cosine_normalized(spark, d):
    e, q = vectors(spark, d).withColumn("u", Q.cosine_normalized(F.col("embedding"))["unit"]), M.normalize(M.vector_lit(stored(spark, d)))
    return short(e.withColumn("score", 1 - M.inner_product(F.col("u"), q)).orderBy("score", "vec_id").limit(10))


@query(
    "WITH t AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '([A-Za-z0-9]+)', 1), lambda x: lower(x))) AS w FROM documents) "
    "SELECT doc_id, CAST(sum(CASE w WHEN 'the' THEN 0.5 WHEN 'of' THEN 2 WHEN 'thing' THEN 4 ELSE 0 END) AS DOUBLE) AS score FROM t GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 15"
)
def knn_sparse_ip(spark, d):
    docs = table(spark, d, "documents")
    counts = docs.select("doc_id", X.term_counts(docs, "text", ["the", "of", "thing"]).alias("c"))
    pairs = F.filter(F.zip_with(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)]), "c", lambda i, w: F.struct(i.alias("i"), w.cast("float").alias("w"))), lambda p: p["w"] > 0)
    v = counts.select("doc_id", pairs.alias("p")).where("size(p) > 0")
    v = v.select("doc_id", F.struct(F.transform("p", lambda x: x["i"]).alias("indices"), F.transform("p", lambda x: x["w"]).alias("values")).alias("v"))
    return S.sparse_knn(v, {1: 0.5, 2: 2.0, 3: 4.0}, 15, "doc_id", "v").select("doc_id", "score")


def _checked_cells(e, centroids):
    """One row on an assignment to centroids: vectors, cells, vectors that another centroid is nearer to, centroids that aren't the
    mean of their cell (to six digits of their size)."""
    points = F.array(*[M.vector_lit(p) for p in centroids.points])
    celled = C.assign_cells(e, centroids, "embedding").withColumn("d", F.transform(points, lambda p: M.squared_l2(F.col("embedding"), p)))
    wrong = celled.agg(F.count("*").alias("n"), F.countDistinct("cell_id").alias("cells"), F.count_if(F.get("d", F.col("cell_id")) > F.array_min("d") + 1e-9).alias("misassigned"))
    means = C.centroid_means(celled, "embedding", "cell_id").withColumn("p", F.get(points, F.col("cell_id")))
    return wrong, means.agg(F.count_if(M.squared_l2(F.col("mean"), F.col("p")) > 1e-6 * M.inner_product(F.col("p"), F.col("p"))).alias("not_means"))


@query("SELECT count(*) AS n, CAST(16 AS BIGINT) AS cells, CAST(0 AS BIGINT) AS misassigned, CAST(0 AS BIGINT) AS not_means FROM embeddings")
def kmeans_cells(spark, d):
    """Run until nothing changes, every vector is in the cell of its nearest centroid, and every centroid the mean of its cell."""
    e = vectors(spark, d)
    wrong, means = _checked_cells(e, C.kmeans(e, "embedding", 16, "vec_id", None))
    return wrong.crossJoin(F.broadcast(means))  # one row each


@query("SELECT count(*) AS n, CAST(16 AS BIGINT) AS cells, CAST(0 AS BIGINT) AS misassigned FROM embeddings")
def kmeans_two_level(spark, d):
    e = vectors(spark, d)
    return _checked_cells(e, C.two_level(e, "embedding", "vec_id", 4, 4))[0]


@query(
    "WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, 64)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM x GROUP BY label, i) "
    "SELECT label, CAST(max(n) AS BIGINT) AS n, round(sum(m * m), 6) AS norm2 FROM m GROUP BY label"
)
def centroid_means(spark, d):
    return C.centroid_means(vectors(spark, d), "embedding", "label").select("label", "n", F.round(M.inner_product(F.col("mean"), F.col("mean")), 6).alias("norm2"))


@query(knn_sql(L2, "", 10))
def ivf_knn_all_cells(spark, d):
    index = C.IvfIndex.build(vectors(spark, d), files.scratch(spark, "ivf"), "embedding", "vec_id", "L2", 16)
    return short(index.search(stored(spark, d), 10, 16))


#: Of 16 cells, those that ivf_knn probes: recall@10 is 0.94 or more on sf0.001, sf0.01 and sf0.1, with 11 of 16 it would be 0.9.
NPROBE = 13


@query()
def ivf_knn(spark, d):
    e = vectors(spark, d)
    index = C.IvfIndex.build(e, files.scratch(spark, "ivf"), "embedding", "vec_id", "L2", 16)
    out = index.search_batch(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding"), 10, NPROBE, "q", "embedding")
    return out.select("query_id", "vec_id", (F.round("score", 5) + 0.0).alias("score"), "rank")


@query("SELECT 10 AS k, 10 * count(*) AS expected, TRUE AS enough FROM embeddings WHERE vec_id % 50 = 0")
def ivf_recall(spark, d):
    """Whether ivf_knn finds nine tenths of the true neighbours or more."""
    e = vectors(spark, d)
    truth = S.knn_batch(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding"), 10, "vec_id", "embedding", "q", "embedding", "L2")
    return S.recall_at(ivf_knn(spark, d), truth, 10, key="vec_id").select("k", "expected", (F.col("recall") >= 0.9).alias("enough"))


# --- full text --------------------------------------------------------------------------------------------------------------


def bm25_sql(terms: list[str], cond: str, points: str, k: int = 10, extra: str = "TRUE") -> str:
    """cond and points may use tf_<term> and w_<term>."""
    tf = ", ".join(f"CAST(len(list_filter(t, lambda x: x = '{w}')) AS DOUBLE) AS tf_{w}" for w in terms)
    df = ", ".join(f"CAST(count(*) FILTER (tf_{w} > 0) AS DOUBLE) AS df_{w}" for w in terms)
    weights = ", ".join(f"greatest(0, ln((n - df_{w} + 0.5) / (df_{w} + 0.5) + 1)) * tf_{w} * 2.2 / (tf_{w} + 1.2 * (0.25 + 0.75 * len / average)) AS w_{w}" for w in terms)
    return (
        "WITH a AS (SELECT doc_id, lang, list_transform(regexp_extract_all(text, '([A-Za-z0-9]+)', 1), lambda x: lower(x)) AS t FROM documents WHERE text IS NOT NULL), "
        f"b AS (SELECT doc_id, lang, t, CAST(len(t) AS DOUBLE) AS len, {tf} FROM a), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS average, {df} FROM b), "
        f"c AS (SELECT *, {weights} FROM b, s) SELECT doc_id, round({points}, 6) AS score FROM c WHERE ({cond}) AND ({extra}) AND {points} > 0 ORDER BY {points} DESC, doc_id LIMIT {k}"
    )


def fts(spark, d, node, k=10, cond=None):
    out = X.search(table(spark, d, "documents"), node, k, "doc_id", "text", where=cond)
    return out.select("doc_id", F.round("score", 6).alias("score"))


@query(bm25_sql(["thing"], "tf_thing > 0", "w_thing"))
def fts_term(spark, d):
    return fts(spark, d, X.match("Thing"))


@query(bm25_sql(["thing", "ering", "tion"], "TRUE", "(w_thing + w_ering + w_tion)", 20))
def fts_or(spark, d):
    return fts(spark, d, X.parse("thing OR ering tion"), 20)


@query(bm25_sql(["the", "thing", "ering"], "tf_the > 0 AND tf_thing > 0 AND tf_ering > 0", "(w_the + w_thing + w_ering)", 20))
def fts_and(spark, d):
    return fts(spark, d, X.parse("the AND thing AND ering"), 20)


@query(bm25_sql(["the", "thing", "ering"], "tf_thing > 0 AND tf_ering = 0", "(w_thing + w_the)", 20))
def fts_must_not(spark, d):
    return fts(spark, d, X.parse("+thing the -ering"), 20)


@query(bm25_sql(["thing", "tion", "ering"], "(tf_thing > 0 OR tf_tion > 0) AND tf_ering = 0", "(w_thing + w_tion)", 20))
def fts_not_group(spark, d):
    return fts(spark, d, X.parse("(thing OR tion) AND NOT ering"), 20)


@query(bm25_sql(["licensed", "under"], "tf_licensed > 0 AND len(list_filter(range(1, len(t)), lambda i: t[i] = 'licensed' AND t[i + 1] = 'under')) > 0", "(w_licensed + w_under)", 20))
def fts_phrase(spark, d):
    return fts(spark, d, X.parse('"Licensed under"'), 20)


@query(bm25_sql(["thing", "the"], "TRUE", "(w_thing + w_the)", 20, "lang = 'en'"))
def fts_filtered(spark, d):
    return fts(spark, d, X.match("the thing"), 20, F.col("lang") == "en")


TOKENS_SQL = "WITH a AS (SELECT doc_id, list_transform(regexp_extract_all(text, '([A-Za-z0-9]+)', 1), lambda x: lower(x)) AS t FROM documents), p AS (SELECT doc_id, unnest(t) AS term, len(t) AS length FROM a), f AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM p GROUP BY doc_id, term) "


@query(TOKENS_SQL + "SELECT term, count(*) AS df, CAST(max(tf) AS INTEGER) AS max_tf, CAST(min(length) AS INTEGER) AS min_length FROM f GROUP BY term")
def fts_term_stats(spark, d):
    return X.term_stats_of(table(spark, d, "documents"), "text")


@query("SELECT count(*) AS total_docs, CAST(sum(len(regexp_extract_all(text, '([A-Za-z0-9]+)', 1))) AS BIGINT) AS total_tokens FROM documents WHERE text IS NOT NULL")
def fts_corpus_stats(spark, d):
    return X.corpus_stats(table(spark, d, "documents"), "text")


@query(ORACLES["fts_or"].replace("doc_id, round", "doc_id AS key, round").replace("DESC, doc_id LIMIT", "DESC, key LIMIT"))
def fts_postings_index(spark, d):
    docs, path = table(spark, d, "documents"), files.scratch(spark, "postings")
    X.write_postings(docs, path, "doc_id", "text")
    n, tokens = X.corpus_stats(docs, "text").first()
    out = X.search_postings(spark.read.parquet(path), ["thing", "ering", "tion"], n, tokens / max(1, n), 20)
    return out.select("key", F.round("score", 6).alias("score"))


def _of_shelf(sql: str) -> str:
    return sql.replace("SELECT doc_id, round(", "SELECT CAST(doc_id AS VARCHAR) AS pk, round(").replace("DESC, doc_id LIMIT", "DESC, CAST(doc_id AS VARCHAR) LIMIT")


def indexed(spark, d, k=20, where=None, **fts):
    from tessera.plans.request import Fts, Query

    return shelf(spark, d).query_df(Query("text", fts=Fts(**fts)), k, where, output_fields=[]).select("pk", F.round("score", 6).alias("score"))


@query(_of_shelf(ORACLES["fts_or"]))
def fts_index_or(spark, d):
    return indexed(spark, d, query_string="thing OR ering tion")


@query(_of_shelf(ORACLES["fts_must_not"]))
def fts_index_must_not(spark, d):
    return indexed(spark, d, query_string="+thing the -ering")


@query(_of_shelf(ORACLES["fts_phrase"]))
def fts_index_phrase(spark, d):
    return indexed(spark, d, query_string='"Licensed under"')


@query(_of_shelf(ORACLES["fts_filtered"]))
def fts_index_filtered(spark, d):
    return indexed(spark, d, 20, "lang = 'en'", match_string="the thing")


@query(_of_shelf(bm25_sql(["thing", "ering"], "tf_thing > 0 AND tf_ering > 0", "(w_thing + w_ering)", 20, "TRUE").replace("FROM documents WHERE text IS NOT NULL", "FROM documents WHERE text IS NOT NULL AND coalesce(lang, '') <> 'de'")))
def fts_index_after_deletes(spark, d):
    """Statistics and postings follow deletes, also when segments are merged."""
    from tessera.plans.request import Fts, Query

    c = shelf(spark, d)
    c.delete_by_filter("lang = 'de'")
    c.optimize(most_deleted=0.0)
    return c.query_df(Query("text", fts=Fts(query_string="thing AND ering")), 20, output_fields=[]).select("pk", F.round("score", 6).alias("score"))


@query(TOKENS_SQL + ", n AS (SELECT count(*) AS n, avg(len(t)) AS average FROM a), g AS (SELECT term, count(*) AS df FROM f GROUP BY term) SELECT doc_id, count(*) AS nnz, round(sum(CAST(CAST(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) AS FLOAT) AS DOUBLE)), 4) AS total FROM f JOIN g USING (term), n GROUP BY doc_id")
def bm25_sparse_vectors(spark, d):
    v = R.bm25_vectors(table(spark, d, "documents"), "doc_id", "text", dimensions=1 << 50)
    total = F.aggregate("vector.values", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return v.select("doc_id", F.size("vector.indices").cast("long").alias("nnz"), F.round(total, 4).alias("total"))


# --- fusion -----------------------------------------------------------------------------------------------------------------


def two_lists(spark, d, k=15):
    e = vectors(spark, d)
    return {"a": S.knn(e, stored(spark, d, 0), k, "vec_id", "embedding", "L2"), "b": S.knn(e, stored(spark, d, 17), k, "vec_id", "embedding", "COSINE")}


TWO_SQL = (
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), qa AS (SELECT v AS q FROM e WHERE vec_id = 0), qb AS (SELECT v AS q FROM e WHERE vec_id = 17), "
    "a AS (SELECT vec_id, pow(list_distance(v, q), 2) AS s FROM e, qa ORDER BY s, vec_id LIMIT 15), b AS (SELECT vec_id, 1 - list_cosine_similarity(v, q) AS s FROM e, qb ORDER BY s, vec_id LIMIT 15), "
)


@query(TWO_SQL + "u AS (SELECT vec_id, row_number() OVER (ORDER BY s, vec_id) AS r FROM a UNION ALL SELECT vec_id, row_number() OVER (ORDER BY s, vec_id) AS r FROM b) SELECT vec_id, round(sum(1.0 / (60 + r)), 9) AS score FROM u GROUP BY vec_id ORDER BY sum(1.0 / (60 + r)) DESC, vec_id LIMIT 10")
def rerank_rrf(spark, d):
    out = R.RrfReranker(10, metrics={"a": "L2", "b": "COSINE"}).rerank(two_lists(spark, d), "vec_id")
    return out.select("vec_id", F.round("score", 9).alias("score"))


@query(TWO_SQL + "u AS (SELECT vec_id, 0.7 * (1 - 2 * atan(s) / pi()) AS p FROM a UNION ALL SELECT vec_id, 0.3 * (1 - s / 2) AS p FROM b) SELECT vec_id, round(sum(p), 6) AS score FROM u GROUP BY vec_id ORDER BY sum(p) DESC, vec_id LIMIT 10")
def rerank_weighted(spark, d):
    out = R.WeightedReranker({"a": "L2", "b": "COSINE"}, 10, {"a": 0.7, "b": 0.3}).rerank(two_lists(spark, d), "vec_id")
    return short(out)


@query(TWO_SQL + "u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT vec_id, round(-min(s), 6) + 0.0 AS score FROM u GROUP BY vec_id ORDER BY -min(s) DESC, vec_id LIMIT 10")
def rerank_callback(spark, d):
    best = lambda lists: lists["a"].unionByName(lists["b"]).groupBy("vec_id").agg((-F.min("score")).alias("score"))
    return short(R.CallbackReranker(best, 10).rerank(two_lists(spark, d), "vec_id"))


@query("SELECT doc_id, CAST(length(text) AS DOUBLE) AS score FROM documents WHERE lang IN ('de', 'en') AND length(trim(text)) > 0 ORDER BY score DESC, doc_id LIMIT 10")
def rerank_model(spark, d):
    docs = table(spark, d, "documents")
    lists = {"a": docs.where("lang = 'de'"), "b": docs.where("lang in ('de', 'en')")}
    return R.ModelReranker("length", lambda pairs: [float(len(t)) for _, t in pairs], "text", 10).rerank(lists, "doc_id").select("doc_id", "score")


class _Counts:
    """A stand-in for a dense model: relative frequencies of four letters."""

    dimension = 4

    def embed(self, value):
        return [value.count(c) / max(1, len(value)) for c in "aeio"]


@query("SELECT doc_id, round(sqrt(pow((length(text) - length(replace(text, 'a', ''))) / greatest(1, length(text)), 2) + pow((length(text) - length(replace(text, 'e', ''))) / greatest(1, length(text)), 2)), 4) AS norm FROM documents WHERE text IS NOT NULL")
def embed_dense(spark, d):
    v = R.embed_column(table(spark, d, "documents").where("text is not null"), "text", _Counts())
    return v.select("doc_id", F.round(M.norm_l2(F.slice("embedding", 1, 2)), 4).alias("norm"))


# --- collections ------------------------------------------------------------------------------------------------------------

CUSTOMERS = CollectionSpec("customers", (FieldSpec("name", "STRING"), FieldSpec("segment", "STRING", True), FieldSpec("balance", "DOUBLE", True), FieldSpec("nation", "INT32", True)))


def customers(spark, d) -> Collection:
    c = Collection.create_and_open(spark, files.scratch(spark, "customers"), CUSTOMERS)
    c.upsert_df(_customer_rows(spark, d))
    return c


def _customer_rows(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("pk"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))


def contents(c: Collection):
    return c.docs().drop("doc_id")


CUSTOMER_SQL = "SELECT CAST(c_custkey AS VARCHAR) AS pk, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance, c_nationkey AS nation FROM customer"


@query(CUSTOMER_SQL)
def collection_reopened(spark, d):
    return contents(Collection.open(spark, customers(spark, d).path))


@query("SELECT CAST(count(*) AS BIGINT) AS doc_count FROM customer")
def stats_count(spark, d):
    return spark.createDataFrame([(customers(spark, d).stats().doc_count,)], "doc_count long")


@query("SELECT CAST(k AS VARCHAR) AS pk, c_name AS name FROM (SELECT unnest([3, 1, 99999999]) AS k) LEFT JOIN customer ON c_custkey = k")
def fetch_by_pk(spark, d):
    got = customers(spark, d).fetch(["3", "1", "99999999"], ["name"])
    return spark.createDataFrame([(k, v.get("name") if v else None) for k, v in got.items()], "pk string, name string")


@query("SELECT CAST(c_custkey AS VARCHAR) AS pk, c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS balance, c_nationkey AS nation FROM customer UNION ALL SELECT 'new-' || c_custkey, c_name, NULL, 1.5, NULL FROM customer WHERE c_mktsegment = 'MACHINERY'")
def dml_upsert(spark, d):
    c, rows = customers(spark, d), _customer_rows(spark, d)
    c.upsert_df(rows.where("segment = 'BUILDING'").select("pk", "name", (F.col("balance") * 2).alias("balance"), "nation"))
    c.upsert_df(rows.where("segment = 'MACHINERY'").select(F.concat(F.lit("new-"), "pk").alias("pk"), "name", F.lit(1.5).alias("balance")))
    return contents(c)


@query(CUSTOMER_SQL.replace("c_mktsegment AS segment", "CASE WHEN c_custkey = 2 THEN NULL ELSE c_mktsegment END AS segment").replace("c_acctbal AS balance", "CASE WHEN c_custkey = 1 THEN 42.5 ELSE c_acctbal END AS balance"))
def dml_update_merge(spark, d):
    c = customers(spark, d)
    c.update([Doc("1", {"balance": 42.5}), Doc("2", {"segment": None}), Doc("missing", {"balance": 1.0})])
    return contents(c)


@query("SELECT * FROM (VALUES ('1', 'ALREADY_EXISTS'), ('x1', 'OK'), ('x1', 'ALREADY_EXISTS'), ('x2', 'OK')) t(pk, status)")
def dml_insert_status(spark, d):
    docs = [Doc(k, {"name": k}) for k in ("1", "x1", "x1", "x2")]
    out = customers(spark, d).insert(docs)
    return spark.createDataFrame([(x.id, s.code) for x, s in zip(docs, out, strict=True)], "pk string, status string")


@query("SELECT CAST(c_custkey AS VARCHAR) AS pk, c_acctbal AS balance FROM customer WHERE c_custkey NOT IN (1, 5)")
def dml_delete(spark, d):
    c = customers(spark, d)
    c.delete(["1", "5", "none"])
    return contents(c).select("pk", "balance")


@query(CUSTOMER_SQL + " WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'FURNITURE')")
def dml_delete_by_filter(spark, d):
    c = customers(spark, d)
    c.delete_by_filter("balance < 0 OR segment = 'FURNITURE'")
    return contents(c)


@query(CUSTOMER_SQL + " WHERE c_acctbal >= 0")
def compact(spark, d):
    c = customers(spark, d)
    c.delete_by_filter("balance < 0")
    c.upsert(Doc("1", {"name": "to go"}))
    c.upsert_df(_customer_rows(spark, d).where("pk = '1' and balance >= 0"))
    if not _customer_rows(spark, d).where("pk = '1' and balance >= 0").count():
        c.delete("1")
    c.optimize(most_deleted=0.0)
    c.vacuum()
    return contents(Collection.open(spark, c.path))


@query("SELECT CAST(c_custkey AS VARCHAR) AS pk, c_acctbal + 100 AS more, CAST(NULL AS INTEGER) AS blank FROM customer")
def ddl_add_column_expr(spark, d):
    c = customers(spark, d)
    c.add_column(FieldSpec("more", "DOUBLE", True), "(balance + 100)")
    c.add_column(FieldSpec("blank", "INT32", True))
    return contents(c).select("pk", "more", "blank")


@query("SELECT CAST(c_custkey AS VARCHAR) AS pk, CAST(c_nationkey AS BIGINT) AS country FROM customer")
def ddl_alter_column(spark, d):
    c = customers(spark, d)
    c.alter_column("nation", new_name="country")
    c.alter_column("country", schema=FieldSpec("country", "INT64", True))
    c.drop_column("balance")
    return contents(c).select("pk", "country")


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber // 2 AS INTEGER) AS half, round(l_extendedprice * 1.5e0, 4) AS more, -l_quantity AS less FROM lineitem")
def ddl_expressions(spark, d):
    t = table(spark, d, "lineitem")
    spec = CollectionSpec.of(t.schema)
    half = compile_expression("l_linenumber / 2", FieldSpec("x", "INT32", True), spec)
    more = compile_expression("((l_extendedprice) * 1.5e0)", FieldSpec("x", "DOUBLE", True), spec)
    less = compile_expression("-l_quantity", FieldSpec("x", "DOUBLE", True), spec)
    return t.select("l_orderkey", "l_linenumber", half.alias("half"), F.round(more, 4).alias("more"), less.alias("less"))


def library(spark, d) -> Collection:
    """Embeddings as a collection with a cell index."""
    spec = CollectionSpec("vectors", (FieldSpec("label", "INT32", True), FieldSpec("v", "VECTOR_FP32", False, 64, FlatIndex("L2"))))
    c = Collection.create_and_open(spark, files.scratch(spark, "vectors"), spec)
    c.upsert_df(vectors(spark, d).select(F.col("vec_id").cast("string").alias("pk"), "label", F.col("embedding").alias("v"), F.col("vec_id").alias("seq")))
    return c


COLLECTION_KNN = knn_sql(L2, "", 10, "label > 2").replace("SELECT vec_id, round(s, 6) + 0.0 AS score FROM", "SELECT CAST(vec_id AS VARCHAR) AS pk, round(s, 6) + 0.0 AS score, label FROM")


@query(COLLECTION_KNN)
def collection_query(spark, d):
    from tessera.plans.request import Query

    return library(spark, d).query_df(Query("v", vector=stored(spark, d)), 10, "label > 2").select("pk", F.round("score", 6).alias("score"), "label")


@query(COLLECTION_KNN)
def collection_query_ivf(spark, d):
    from tessera.plans.request import IvfQueryParams, Query

    c = library(spark, d)
    c.create_index("v", IvfIndex("L2", n_list=8))
    return c.query_df(Query("v", id="0", param=IvfQueryParams(nprobe=8)), 10, "label > 2").select("pk", F.round("score", 6).alias("score"), "label")


def shelf(spark, d) -> Collection:
    """Documents with a text index and a small vector."""
    spec = CollectionSpec("shelf", (FieldSpec("text", "STRING", True, 0, FtsIndex()), FieldSpec("lang", "STRING", True), FieldSpec("v", "VECTOR_FP32", True, 2, FlatIndex("L2"))))
    c = Collection.create_and_open(spark, files.scratch(spark, "shelf"), spec)
    v = F.array((F.col("n_chars") / 1000).cast("float"), F.length("lang").cast("float"))
    c.upsert_df(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pk"), "text", "lang", v.alias("v")))
    return c


@query(
    bm25_sql(["thing", "the"], "TRUE", "(w_thing + w_the)", 10).replace("WITH a AS", "WITH f AS (WITH a AS", 1)
    + "), g AS (SELECT doc_id, pow(CAST(CAST(n_chars / 1000 AS FLOAT) AS DOUBLE) - 2, 2) + pow(length(lang) - 2, 2) AS s FROM documents WHERE n_chars IS NOT NULL AND lang IS NOT NULL ORDER BY s, CAST(doc_id AS VARCHAR) LIMIT 10), "
    "u AS (SELECT doc_id, row_number() OVER (ORDER BY s, CAST(doc_id AS VARCHAR)) AS r FROM g UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS r FROM f) "
    "SELECT CAST(doc_id AS VARCHAR) AS pk, round(sum(1.0 / (60 + r)), 9) AS score FROM u GROUP BY doc_id ORDER BY sum(1.0 / (60 + r)) DESC, pk LIMIT 10"
)
def hybrid_rrf(spark, d):
    from tessera.plans.request import Fts, Query

    queries = [Query("text", fts=Fts(match_string="the thing")), Query("v", vector=[2.0, 2.0])]
    return shelf(spark, d).query_df(queries, 10, reranker=R.RrfReranker(10), output_fields=[]).select("pk", F.round("score", 9).alias("score"))


# --- streams ----------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(event_id AS VARCHAR) AS pk, event_type AS kind, value FROM events")
def stream_ingest(spark, d):
    spec = CollectionSpec("events", (FieldSpec("kind", "STRING", True), FieldSpec("value", "DOUBLE", True)))
    c = Collection.create_and_open(spark, files.scratch(spark, "events"), spec)
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder_with(spark, d, "events"))
    rows = source.select(F.col("event_id").cast("string").alias("pk"), F.col("event_type").alias("kind"), "value")
    stream_upsert(rows, c, files.scratch(spark, "checkpoint"), available_now=True).awaitTermination()
    return contents(c)


def _folder_with(spark, d, name: str) -> str:
    """A folder that a stream can watch, with a table in several files."""
    path = files.scratch(spark, "stream")
    table(spark, d, name).repartition(3).write.parquet(path)
    return path


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(spark, d):
    return windowed_counts(table(spark, d, "events"), "ts", ["event_type"], "value", "1 hour").withColumn("total", F.round("total", 4))


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k"
)
def window_session(spark, d):
    return sessions(table(spark, d, "events"), "ts", "user_id", "30 minutes")
