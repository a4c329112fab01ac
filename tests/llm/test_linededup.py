import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import linededup as L


def brute(rows):
    """(doc_id, lines, dropped, kept text) for each row."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    owner = defaultdict(set)
    last = float("inf")
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)].add(last if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(owner[key(x)]) == (last if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r["__n_lines"], r["__n_dropped"], r.text or "") for r in df.collect()), key=str)


@pytest.mark.parametrize("batches,fan_out", [(1, 2), (3, 2), (7, 3)])
def test_random(spark, batches, fan_out):
    r = random.Random(batches)
    pool = ["  A common Line ", "a common line", "another common line\r", "äöüäöüäöüä", "äöüäöüäöü", "short", "", "\x0bthe third common\t", "x" * 10, "x" * 9]
    rows = [(r.randint(0, 40), "\n".join(r.choice(pool + [f"own line number {k}"]) for _ in range(r.randint(0, 12)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(L.dedup_lines(docs, batches, fan_out)) == brute(rows)


def test_odd(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    out = L.dedup_lines(odd, 2)
    assert result(out) == brute(rows) and out.columns == [*odd.columns, "__n_lines", "__n_dropped"]
    assert L.dedup_lines(none).count() == 0
    assert out.where("doc_id = 3").first().text is None


def test_levels(spark):
    runs = L.LineRuns(spark, fan_out=2)
    for k in range(5):
        rows = [(10 * k + i, 0, f"{h:02d}".encode()) for i, h in enumerate(range(k, k + 4))]
        repeats = runs.add(spark.createDataFrame(rows, "doc_id long, mark long, hash binary"))
        assert repeats.count() == (0 if k == 0 else 3)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    everything = runs.runs()[0].unionByName(runs.runs()[1])
    assert everything.count() == 8 == everything.select("hash").distinct().count()
    runs.close()
    assert not spark.catalog.listTables()


def test_runs_are_merged_as_they_lie(spark):
    """One exchange and one sort, of the batch's own hashes; none of the two runs."""
    runs = L.LineRuns(spark, fan_out=9)
    batch = lambda k: spark.range(2000).selectExpr("id as doc_id", "0L as mark", f"unhex(md5(cast(id + {k} as string))) as hash")
    for k in (0, 1500):
        runs.add(batch(k))
    before = spark.conf.get(L.IN_ORDER, "false")
    spark.conf.set(L.IN_ORDER, "true")
    try:
        plan = runs.unknown(batch(3000))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and plan.count("SortMergeJoin") == 2, plan
        assert runs.unknown(batch(3000)).count() == 1500
    finally:
        spark.conf.set(L.IN_ORDER, before)
        runs.close()


def test_many_rows_without_an_id_and_clashing_columns(spark):
    rows = [(None, f"a line that all have\nown line number {k}") for k in range(4000)] + [(5, "a line that all have")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, __id int, __mark int, __drops int, __n_lines int")
    out = L.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "__id", "__mark", "__drops", "__n_lines", "__n_dropped"]
    assert result(out) == brute(rows) and out.where("__id = 1 and __mark = 2 and __drops = 3").count() == 4001


def test_query_digest(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows))
    assert sorted(map(tuple, L.op5_linededup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == want
    assert L.id_ranges(spark.range(0).select(F.col("id").alias("doc_id")), 3) == ["(doc_id is not null) or doc_id is null"]
