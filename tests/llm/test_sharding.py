import zlib
from collections import Counter, defaultdict

from tessera.llm.sharding import assign_shards


def check(rows, docs, n):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
    assert {r.law for r in rows} <= {"bytes"} and all(r.grown_shard is None for r in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(slots) <= set(range(n)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    target, most = sum(sizes.values()) / n, max(r.size for r in rows)
    assert all(abs(sizes[k] - target) <= most for k in range(n))
    edges = [(min(i), max(i)) for _, i in sorted((k, [r.doc_id for r in rows if r.shard == k and r.doc_id is not None] or [0]) for k in slots)]
    assert all(a[1] <= b[0] for a, b in zip(edges, edges[1:]))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for n, parts in ((8, None), (3, 50), (1, 1)):
        check(assign_shards(docs, n, partitions=parts).collect(), docs.collect(), n)


def test_odd(odd, none):
    check(assign_shards(odd, 4, partitions=3).collect(), odd.collect(), 4)
    assert assign_shards(none).count() == 0


def test_one_row_repeated(spark):
    docs = spark.range(500).selectExpr("cast(null as long) doc_id", "'same' text")
    rows = assign_shards(docs, 8, partitions=16).collect()
    assert max(Counter(r.shard for r in rows).values()) - min(Counter(r.shard for r in rows).values()) <= 1


def test_native(odd):
    plan = assign_shards(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
