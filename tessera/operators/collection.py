"""Collections: a table of documents on shared storage, with snapshots, document operations, schema changes and search.

Layout of a collection's folder: manifest/v<n>.json (the newest counts), data/<id> (Parquet, immutable), deleted/<id> (doc_ids
that are gone, by segment), index/<field>-<id> (copies of vectors, by cell and as codes), fts/<field>/segment=<id> (postings). A
change writes new files and then the next manifest, which must not exist yet: readers keep their snapshot, and of two writers one
fails. doc_ids ascend with the keys of a bulk write; results of equal scores are in their order.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.config import settings
from tessera.errors import AlreadyExists, FailedPrecondition, InvalidArgument, NotFound, NotSupported, PermissionDenied
from tessera.functions.metrics import DESCENDING
from tessera.operators import fulltext as X
from tessera.operators import postings as P
from tessera.operators import search as S
from tessera.operators.cluster import IvfIndex as Cells
from tessera.operators.rerank import Reranker
from tessera.plans.expressions import compile_expression
from tessera.plans.filters import compile_filter
from tessera.plans.request import Query, check_topk, output_columns
from tessera.schema import MAX_TOPK, MAX_WRITE_BATCH, NUMERIC, PRIMARY_KEY, SCALARS, CollectionSpec, FieldSpec, FlatIndex, check_value, refusal
from tessera.sources import files


#: Begins the message of a bulk write that is refused.
REFUSED = "refused: "
#: Tombstones that are broadcast: 16 MB of them. Documents of a result that a scan looks up by a list.
MOST_BROADCAST, MOST_LISTED = 2_000_000, 1000
#: Rows that a refined search scores exactly for each that it returns, where the parameters don't say.
SCALE = 10.0


@dataclass(frozen=True)
class Doc:
    """A document: its key, fields by name (scalars and vectors; sparse vectors as dicts), and a result's score."""

    id: str
    fields: dict[str, Any] = field(default_factory=dict)
    score: float = 0.0
    doc_id: int | None = None

    def get(self, name: str) -> Any:
        return self.fields.get(name)


@dataclass(frozen=True)
class Status:
    code: str = "OK"
    message: str = ""

    @property
    def ok(self) -> bool:
        return self.code == "OK"


@dataclass(frozen=True)
class Options:
    """enable_mmap and max_buffer_size are taken for callers that set them; Spark's own readers and writers have no use for them."""

    read_only: bool = False
    enable_mmap: bool = True
    max_buffer_size: int = 64 << 20
    reference_quirks: bool = False


@dataclass(frozen=True)
class Stats:
    doc_count: int
    index_completeness: dict[str, float]


@dataclass(frozen=True)
class _Manifest:
    version: int
    spec: CollectionSpec
    segments: tuple[str, ...] = ()
    #: Tombstones: folder, rows, and the segments that they are of.
    deleted: tuple[dict, ...] = ()
    next_doc_id: int = 0
    #: Columns of the files by field: renaming or dropping a field changes no file.
    physical: dict[str, str] = field(default_factory=dict)
    #: Cell indexes by field: folder and the data they cover.
    indexes: dict[str, dict] = field(default_factory=dict)
    #: Full-text fields: live documents with a text, their terms, and the number of buckets of each segment's postings.
    texts: dict[str, dict] = field(default_factory=dict)
    #: Last batch taken in, by stream.
    streams: dict[str, int] = field(default_factory=dict)

    def dumps(self) -> str:
        return json.dumps({**self.__dict__, "spec": json.loads(self.spec.dumps())})

    @staticmethod
    def loads(text: str) -> _Manifest:
        x = json.loads(text)
        x["spec"] = CollectionSpec.loads(json.dumps(x["spec"]))
        return _Manifest(**x | {"segments": tuple(x["segments"]), "deleted": tuple(x["deleted"])})


def _copied(f: FieldSpec) -> bool:
    """Whether a field's index keeps a copy of its own: cells, or codes of a quantizer. Others are searched exactly in the data."""
    return f.is_vector and not f.is_sparse and (f.index.kind == "IVF" or bool(f.index.quantize))


class Collection:
    def __init__(self, spark: SparkSession, path: str, manifest: _Manifest, options: Options) -> None:
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self._m: _Manifest | None = manifest

    # --- life cycle ----------------------------------------------------------------------------------------------------------

    @classmethod
    def create_and_open(cls, spark: SparkSession, path: str, spec: CollectionSpec, options: Options = Options()) -> Collection:  # noqa: B008
        spec.validate()
        if options.read_only:
            raise InvalidArgument("a new collection can't be read-only")
        if files.list_names(spark, f"{path}/manifest"):
            raise AlreadyExists(path)
        m = _Manifest(0, spec, physical={f.name: f.name for f in spec.fields})
        files.write_text(spark, f"{path}/manifest/v{0:08d}.json", m.dumps())
        return cls(spark, path, m, options)

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options = Options(), version: int | None = None) -> Collection:  # noqa: B008
        """The newest snapshot, or one by its version (then read-only)."""
        names = files.list_names(spark, f"{path}/manifest")
        names = [n for n in names if n.startswith("v") and n.endswith(".json")]
        if not names:
            raise NotFound(path)
        name = names[-1] if version is None else f"v{version:08d}.json"
        if version is not None:
            options = replace(options, read_only=True)
        return cls(spark, path, _Manifest.loads(files.read_text(spark, f"{path}/manifest/{name}")), options)

    @property
    def manifest(self) -> _Manifest:
        if self._m is None:
            raise FailedPrecondition("the collection is closed")
        return self._m

    @property
    def schema(self) -> CollectionSpec:
        return self.manifest.spec

    @property
    def option(self) -> Options:
        return self.options

    def flush(self) -> None:
        """Every operation is durable when it returns."""
        _ = self.manifest

    def close(self) -> None:
        self._m = None

    def destroy(self) -> None:
        self._writable()
        files.delete(self.spark, self.path)
        self._m = None

    def stats(self) -> Stats:
        live = self.docs(True)
        n = live.count()
        done = {}
        for f in self.schema.vectors:
            if not _copied(f) or not n:
                done[f.name] = 1.0
            else:
                known = self.manifest.indexes.get(f.name)
                covered = self._covered(known) if known else ()
                done[f.name] = live.where(F.col("__segment").isin(*covered)).count() / n if covered else 0.0
        return Stats(n, done)

    def _covered(self, known: dict) -> tuple[str, ...]:
        return tuple(s for s in known["segments"] if s in self.manifest.segments)

    def _writable(self) -> _Manifest:
        if self.options.read_only:
            raise PermissionDenied("the collection is read-only")
        return self.manifest

    def _commit(self, m: _Manifest) -> None:
        nxt = replace(m, version=m.version + 1)
        try:
            files.write_text(self.spark, f"{self.path}/manifest/v{nxt.version:08d}.json", nxt.dumps())
        except AlreadyExists as e:
            raise FailedPrecondition("another writer was faster; open the collection again") from e
        self._m = nxt

    # --- reading -------------------------------------------------------------------------------------------------------------

    def _gone(self, segments: Sequence[str] | None = None) -> DataFrame | None:
        """doc_ids that are deleted (in some segments), None if there are none. They are broadcast while they are provably few."""
        mine = [d for d in self.manifest.deleted if segments is None or set(d["segments"]) & set(segments)]
        if not mine:
            return None
        gone = self.spark.read.schema("doc_id long").parquet(*[f"{self.path}/deleted/{d['path']}" for d in mine])
        return F.broadcast(gone) if sum(d["rows"] for d in mine) <= MOST_BROADCAST else gone

    def docs(self, segment: bool = False, segments: Sequence[str] | None = None) -> DataFrame:
        """Live documents (of some segments): pk, doc_id, fields; with segment also __segment, the file set that a row is from. Only
        segments of which something is deleted are joined with what is."""
        m = self.manifest
        from pyspark.sql import types as T

        physical = T.StructType([T.StructField("pk", T.StringType()), T.StructField("doc_id", T.LongType()), *(T.StructField(m.physical[f.name], f.spark().dataType) for f in m.spec.fields)])
        wanted = [s for s in m.segments if segments is None or s in segments]
        touched = {s for d in m.deleted for s in d["segments"]}
        parts = []
        for dirty in (False, True):
            names = [s for s in wanted if (s in touched) == dirty]
            if names:
                raw = self.spark.read.schema(physical).parquet(*[f"{self.path}/data/{s}" for s in names])
                if segment:
                    raw = raw.withColumn("__segment", F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/]+)/[^/]*$", 1))
                parts.append(raw.join(self._gone(names), "doc_id", "left_anti") if dirty else raw)
        if not parts:
            parts = [self.spark.createDataFrame([], physical)]
            parts = [p.withColumn("__segment", F.lit("")) for p in parts] if segment else parts
        columns = ["pk", "doc_id", *(F.col(f"`{m.physical[f.name]}`").alias(f.name) for f in m.spec.fields), *(["__segment"] if segment else [])]
        out = parts[0].select(*columns)
        return out.unionByName(parts[1].select(*columns)) if len(parts) > 1 else out

    def _rows_of(self, best: DataFrame) -> DataFrame:
        """Whole documents of (doc_id, score), of which there are as many as a query asks for: the last step of a search."""
        few = [(r.doc_id, r.score) for r in best.collect()]
        ids = self.spark.createDataFrame(few, "doc_id long, score double")
        docs = self.docs()
        if len(few) <= MOST_LISTED:
            docs = docs.where(F.col("doc_id").isin([i for i, _ in few]))  # statistics and Bloom filters skip row groups
        return docs.join(F.broadcast(ids), "doc_id")  # MAX_TOPK rows at most

    def fetch(self, ids: str | Sequence[str], output_fields: Sequence[str] | None = None, include_vector: bool = True) -> dict[str, Doc | None]:
        ids = [ids] if isinstance(ids, str) else list(ids)
        names = output_columns(self.schema, output_fields, include_vector)
        rows = self.docs().where(F.col("pk").isin(ids)).select("pk", "doc_id", *names).collect()
        found = {r.pk: self._doc(r, names) for r in rows}
        return {i: found.get(i) for i in ids}

    def _doc(self, r, names: Sequence[str]) -> Doc:
        values = {n: r[n] for n in names if r[n] is not None}
        for n, v in values.items():
            f = self.schema.get(n)
            if f.is_sparse:
                values[n] = dict(zip(v["indices"], v["values"], strict=True))
            elif f.type == "UINT64":
                values[n] = int(v)
            elif f.type == "ARRAY_UINT64":
                values[n] = [int(x) for x in v]
            elif f.type in ("BINARY", "ARRAY_BINARY"):
                values[n] = bytes(v) if f.type == "BINARY" else [bytes(x) for x in v]
        d = r.asDict()
        return Doc(r.pk, values, d.get("score", 0.0), d.get("doc_id"))

    # --- searching -----------------------------------------------------------------------------------------------------------

    def _filter(self, text: str | None) -> Column | None:
        return compile_filter(text, self.schema, self.options.reference_quirks)

    def query_df(self, queries: Query | Sequence[Query] | None = None, topk: int = 10, filter: str | None = None, include_vector: bool = False, output_fields: Sequence[str] | None = None, reranker: Reranker | None = None, include_doc_id: bool = False) -> DataFrame:
        """The result as a DataFrame: pk, score, fields, in no stated order."""
        check_topk(topk)
        names = output_columns(self.schema, output_fields, include_vector)
        ids = ["pk", "doc_id"] if include_doc_id else ["pk"]
        many = [queries] if isinstance(queries, Query) else list(queries or [])
        where = self._filter(filter)
        if not many:
            if reranker is not None:
                raise InvalidArgument("a reranker needs queries")
            base = self.docs() if where is None else self.docs().where(where)
            return base.orderBy("doc_id").limit(topk).select(*ids, F.lit(0.0).alias("score"), *names)
        if len(many) == 1 and reranker is None:
            return self._one(many[0], topk, where).select(*ids, "score", *names)
        if reranker is None:
            raise InvalidArgument("several queries need a reranker")
        if len({q.field_name for q in many}) < len(many):
            raise InvalidArgument("queries must be of different fields")
        lists = {q.field_name: self._one(q, q.num_candidates if len(many) > 1 else topk, where) for q in many}
        for f in (self.schema.get(q.field_name) for q in many):
            known = getattr(reranker, "metrics", None)
            if known is not None and f.is_vector:
                known.setdefault(f.name, f.metric)
        fused = [(r.pk, r.score) for r in reranker.rerank(lists, "pk").limit(topk).select("pk", "score").collect()]
        base = self.docs().select("pk", "doc_id", *names)
        if len(fused) <= MOST_LISTED:
            base = base.where(F.col("pk").isin([pk for pk, _ in fused]))
        return base.join(F.broadcast(self.spark.createDataFrame(fused, "pk string, score double")), "pk").select(*ids, "score", *names)  # topk rows

    def query(self, queries: Query | Sequence[Query] | None = None, topk: int = 10, filter: str | None = None, include_vector: bool = False, output_fields: Sequence[str] | None = None, reranker: Reranker | None = None) -> list[Doc]:
        """The topk best documents."""
        df = self.query_df(queries, topk, filter, include_vector, output_fields, reranker, True)
        names = [c for c in df.columns if c not in ("pk", "doc_id", "score")]
        many = [queries] if isinstance(queries, Query) else list(queries or [])
        up = reranker is not None or bool(many) and (many[0].by_text or self.schema.get(many[0].field_name).metric == "IP")
        rows = sorted(df.collect(), key=(lambda r: (-r.score if up else r.score, r.doc_id)) if many else (lambda r: r.doc_id))
        return [self._doc(r, names) for r in rows]

    def group_by_query(self, query: Query, group_by_field: str, docs_per_group: int = 2, num_groups: int = 3, filter: str | None = None, include_vector: bool = False, output_fields: Sequence[str] | None = None) -> DataFrame:
        """The best documents of the best groups: group_id, group_rank, rank, pk, score, fields."""
        f, g = query.validate(self.schema), self.schema.get(group_by_field)
        if not f.is_vector or f.is_sparse:
            raise InvalidArgument("grouping needs a dense vector query")
        if g is None or g.is_vector or g.is_array:
            raise InvalidArgument(f"can't group by {group_by_field}")
        names = output_columns(self.schema, output_fields, include_vector)
        out = S.group_topk(self.docs(), self._vector(query, f), group_by_field, docs_per_group, num_groups, "pk", f.name, f.metric, self._filter(filter))
        return out.select("group_id", "group_rank", "rank", "pk", "score", *names)

    def _vector(self, q: Query, f: FieldSpec) -> Any:
        if q.id is None:
            return q.vector if isinstance(q.vector, dict) else [float(x) for x in q.vector]
        row = self.docs().where(F.col("pk") == q.id).select(f.name).first()
        if row is None or row[0] is None:
            raise NotFound(f"no vector under {q.id}")
        return dict(zip(row[0]["indices"], row[0]["values"], strict=True)) if f.is_sparse else list(row[0])

    def _one(self, q: Query, k: int, where: Column | None) -> DataFrame:
        f = q.validate(self.schema)
        if q.by_text:
            return self._rows_of(self._text_search(q, f, k, where))
        v, radius = self._vector(q, f), getattr(q.param, "radius", 0.0) or None
        if f.is_sparse:
            return S.sparse_knn(self.docs(), v, k, "doc_id", f.name, where, radius)
        known = self.manifest.indexes.get(f.name) if _copied(f) and not getattr(q.param, "is_linear", False) else None
        if known and where is not None and f.index.kind == "IVF":
            share = self.docs().agg(F.avg(F.when(where, 1.0).otherwise(0.0))).first()[0] or 0.0
            known = known if share > settings().brute_force_ratio else None  # few rows: all of them are scored
        if known and self._covered(known):
            return self._rows_of(self._index_search(q, f, v, k, where, radius, known))
        return S.knn(self.docs(), v, k, "doc_id", f.name, f.metric, where, radius)

    def postings(self, f: FieldSpec) -> P.Postings:
        """The full-text index of a field."""
        known = self.manifest.texts.get(f.name, {"buckets": {}})
        return P.Postings(self.spark, f"{self.path}/fts/{f.name}", known["buckets"])

    def _text_search(self, q: Query, f: FieldSpec, k: int, where: Column | None) -> DataFrame:
        """doc_id and score from the postings; a filter's documents are met by a semi-join on doc_id."""
        analyzer, op = X.Analyzer.of(f.index), q.operator or "or"
        node = X.match(q.fts.match_string, analyzer, op) if q.fts.match_string else X.parse(q.fts.query_string, analyzer, op)
        known = self.manifest.texts.get(f.name, {"docs": 0, "tokens": 0})
        among = None if where is None else self.docs().where(where).select("doc_id")
        return P.search(self.postings(f), node, k, known["docs"], known["tokens"], self._gone(), among)

    def _index_search(self, q: Query, f: FieldSpec, v: Sequence[float], k: int, where: Column | None, radius: float | None, known: dict) -> DataFrame:
        """doc_id and score of the k best: in the index's cells that are nearest, by their codes if it keeps such, and in segments
        written since it was made, of which alone the data is read. With a refiner the best by code are scored exactly."""
        cells = Cells.open(self.spark, f"{self.path}/index/{known['path']}")
        covered = self._covered(known)
        inside = cells.scored(v, getattr(q.param, "nprobe", 10))
        gone = self._gone(covered)
        if gone is not None:
            inside = inside.join(gone, "doc_id", "left_anti")
        if where is not None:
            inside = inside.join(self.docs(segments=covered).where(where).select("doc_id"), "doc_id", "left_semi")
        order = S.ordered(inside, f.metric, "doc_id")
        if known.get("quantize") and getattr(q.param, "is_using_refiner", False):
            many = min(MAX_TOPK, max(k, int(k * getattr(q.param, "scale_factor", SCALE))))
            best = inside.orderBy(*order).limit(many).select("doc_id")
            few = self.docs(segments=covered).select("doc_id", f.name).join(F.broadcast(best), "doc_id", "left_semi")  # MAX_TOPK rows at most
            inside = S.scored(few, v, f.name, f.metric).select("doc_id", "score")
        rest = [s for s in self.manifest.segments if s not in covered]
        if rest:
            new = self.docs(segments=rest)
            inside = inside.unionByName(S.scored(new if where is None else new.where(where), v, f.name, f.metric).select("doc_id", "score"))
        if radius:
            inside = inside.where(F.col("score") >= radius if DESCENDING[f.metric] else F.col("score") <= radius)
        return inside.orderBy(*order).limit(k).where("score is not null")

    # --- writing -------------------------------------------------------------------------------------------------------------

    def _check(self, d: Doc, partial: bool) -> None:
        if not isinstance(d.id, str) or not PRIMARY_KEY.fullmatch(d.id):
            raise InvalidArgument(f"key {d.id!r}")
        for name, v in d.fields.items():
            f = self.schema.get(name)
            if f is None:
                raise InvalidArgument(f"no field {name}")
            if v is None:
                if not f.nullable:
                    raise InvalidArgument(f"null for field {name} of {d.id}")
            else:
                check_value(f, v)
        if not partial:
            for f in self.schema.fields:
                if not f.nullable and f.name not in d.fields:
                    raise InvalidArgument(f"no value for field {f.name} of {d.id}")

    def _row(self, doc_id: int, d: Doc) -> tuple:
        out: list[Any] = [d.id, doc_id]
        for f in self.schema.fields:
            v = d.fields.get(f.name)
            if v is not None:
                if f.is_sparse:
                    half = (lambda x: float(np.float16(x))) if f.type.endswith("16") else float
                    v = ([int(k) for k in sorted(v)], [half(v[k]) for k in sorted(v)])
                elif f.type == "VECTOR_INT8":
                    v = [int(x) for x in v]
                elif f.is_vector:
                    v = [float(x) for x in (np.asarray(v, np.float16) if f.type == "VECTOR_FP16" else v)]
                elif f.element == "UINT64":
                    v = [Decimal(x) for x in v] if f.is_array else Decimal(v)
                elif f.element in ("FLOAT", "DOUBLE"):
                    v = [float(x) for x in v] if f.is_array else float(v)
            out.append(v)
        return tuple(out)

    def _segment(self, df: DataFrame, m: _Manifest, merged: bool = False) -> _Manifest:
        """m with a new segment of rows, written with the fields' names under their physical ones, and its postings. merged: the rows
        are all live ones, and the only segment from now on; their postings are merged from those that there are."""
        name = uuid.uuid4().hex
        df = df.select("pk", "doc_id", *(F.col(f"`{f.name}`").alias(m.physical[f.name]) for f in m.spec.fields))
        out = df.write.option("maxRecordsPerFile", m.spec.max_doc_count_per_segment)
        # Bloom filters of the keys, as large as there are keys: lookups of a few keys skip row groups
        for key in ("pk", "doc_id"):
            out = out.option(f"parquet.bloom.filter.enabled#{key}", "true")
        out.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(f"{self.path}/data/{name}")
        texts = dict(m.texts)
        for f in (f for f in m.spec.fields if f.is_fts):
            known = texts.get(f.name, {"docs": 0, "tokens": 0, "buckets": {}})
            if merged:
                n = P.merge(self.postings(f), name, self._gone()) if known["buckets"] else None
                texts[f.name] = known | {"buckets": {name: n} if n else {}}
                continue
            written = self.spark.read.schema(df.schema).parquet(f"{self.path}/data/{name}")
            n = P.write(written.select("doc_id", m.physical[f.name]), f"{self.path}/fts/{f.name}", name, m.physical[f.name], X.Analyzer.of(f.index))
            own = P.Postings(self.spark, f"{self.path}/fts/{f.name}", {name: n}).lengths().agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            texts[f.name] = {"docs": known["docs"] + own[0], "tokens": known["tokens"] + own[1], "buckets": known["buckets"] | {name: n}}
        if merged:
            return replace(m, segments=(name,), deleted=(), indexes={}, texts=texts)
        return replace(m, segments=(*m.segments, name), texts=texts)

    def _tombstones(self, ids: DataFrame, m: _Manifest) -> _Manifest:
        """m without the documents of ids (doc_id, __segment): their numbers are written, and what they held leaves the statistics."""
        name = uuid.uuid4().hex
        ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__segment").alias("segment")).write.parquet(f"{self.path}/deleted/{name}")
        gone = self.spark.read.schema("doc_id long, segment string").parquet(f"{self.path}/deleted/{name}")
        rows = {r.segment: r["count"] for r in gone.groupBy("segment").count().collect()}
        if not rows:
            files.delete(self.spark, f"{self.path}/deleted/{name}")
            return m
        texts = dict(m.texts)
        few = sum(rows.values()) <= MOST_BROADCAST
        for f in (f for f in m.spec.fields if f.is_fts and f.name in texts):
            lengths = self.postings(f).lengths(list(rows))
            lost = lengths.join(F.broadcast(gone) if few else gone, "doc_id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            texts[f.name] = texts[f.name] | {"docs": texts[f.name]["docs"] - lost[0], "tokens": texts[f.name]["tokens"] - lost[1]}
        return replace(m, deleted=(*m.deleted, {"path": name, "rows": sum(rows.values()), "segments": sorted(rows)}), texts=texts)

    def _write(self, docs: Doc | Sequence[Doc], how: str) -> Status | list[Status]:
        m = self._writable()
        batch = [docs] if isinstance(docs, Doc) else list(docs)
        if len(batch) > MAX_WRITE_BATCH:
            raise InvalidArgument(f"{len(batch)} documents in a batch")
        for d in batch:
            self._check(d, how == "update")
        old = {r.pk: r for r in self.docs(True).where(F.col("pk").isin([d.id for d in batch])).select(*(["pk", "doc_id", "__segment"] + ([f.name for f in m.spec.fields] if how == "update" else []))).collect()}
        there = {pk: self._doc(r, [f.name for f in m.spec.fields] if how == "update" else []) for pk, r in old.items()}
        gone, fresh, out, doc_id = {}, {}, [], m.next_doc_id
        for d in batch:
            known = there.get(d.id)
            if how == "insert" and known:
                out.append(Status("ALREADY_EXISTS", d.id))
                continue
            if how == "update" and not known:
                out.append(Status("NOT_FOUND", d.id))
                continue
            if known:
                if known.doc_id in fresh:
                    del fresh[known.doc_id]
                else:
                    gone[known.doc_id] = old[d.id]["__segment"]
            if how == "update":
                d = Doc(d.id, known.fields | d.fields)
            fresh[doc_id] = d
            there[d.id] = replace(d, doc_id=doc_id)
            doc_id += 1
            out.append(Status())
        if fresh or gone:
            new = replace(m, next_doc_id=doc_id)
            if gone:
                new = self._tombstones(self.spark.createDataFrame(list(gone.items()), "doc_id long, __segment string").coalesce(1), new)
            if fresh:
                rows = self.spark.createDataFrame([self._row(i, d) for i, d in fresh.items()], m.spec.spark())
                new = self._segment(rows.coalesce(1), new)
            self._commit(new)
        return out[0] if isinstance(docs, Doc) else out

    def insert(self, docs: Doc | Sequence[Doc]) -> Status | list[Status]:
        """Add documents; a key that exists, also from earlier in the batch, is refused."""
        return self._write(docs, "insert")

    def upsert(self, docs: Doc | Sequence[Doc]) -> Status | list[Status]:
        """Add documents or replace them whole; the last of equal keys counts."""
        return self._write(docs, "upsert")

    def update(self, docs: Doc | Sequence[Doc]) -> Status | list[Status]:
        """Set the given fields (also to null) of documents that exist; the others stay."""
        return self._write(docs, "update")

    def upsert_df(self, df: DataFrame, stream: tuple[str, int] | None = None) -> None:
        """Upsert any number of rows: pk and fields as columns, absent ones null. Of rows with equal keys the one with the
        greatest `seq` (if there is such a column) stays. A row that insert() would refuse refuses them all. stream: name and number
        of a batch, which is taken in only once.

        Rows are dealt by ranges of the key, once: equal keys meet, files hold ranges of keys, and doc_ids ascend with the keys.
        """
        m = self._writable()
        if stream and m.streams.get(stream[0], -1) >= stream[1]:
            return
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        own = df.withColumn("__seq", F.col("seq") if "seq" in df.columns else F.monotonically_increasing_id())
        last = W.partitionBy("pk").orderBy(F.col("__seq").desc_nulls_last())
        own = own.repartitionByRange(n, "pk").withColumn("__rank", F.row_number().over(last)).where("__rank = 1")
        fields = [(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).alias(f.name) for f in m.spec.fields]
        checked = [F.col("pk"), (F.monotonically_increasing_id() + m.next_doc_id).alias("doc_id"), *fields]
        own = own.select(*checked, refusal(m.spec, {f.name for f in m.spec.fields if f.name in df.columns}).alias("__bad"))
        own = own.where(F.when(F.col("__bad").isNull(), True).otherwise(F.raise_error(F.concat(F.lit(REFUSED), F.col("__bad"))).cast("boolean")))
        try:
            new = self._segment(own.select("pk", "doc_id", *(F.col(f"`{f.name}`").cast(f.spark().dataType).alias(f.name) for f in m.spec.fields)), m)
        except Exception as e:  # noqa: BLE001
            if REFUSED in str(e):
                raise InvalidArgument(str(e).split(REFUSED, 1)[1].splitlines()[0]) from None
            raise
        name = new.segments[-1]
        written = self.spark.read.schema("pk string, doc_id long").parquet(f"{self.path}/data/{name}")
        top = written.agg(F.max("doc_id")).first()[0]
        streams = m.streams | ({stream[0]: stream[1]} if stream else {})
        if top is None:
            files.delete(self.spark, f"{self.path}/data/{name}")
            if stream:
                self._commit(replace(m, streams=streams))
            return
        if m.segments:
            old = self.docs(True).select("pk", "doc_id", "__segment")
            before = self._tombstones(old.join(written.select("pk"), "pk", "left_semi"), replace(new, texts=m.texts))
            texts = {k: v | {c: v[c] + before.texts[k][c] - m.texts[k][c] for c in ("docs", "tokens")} if k in m.texts else v for k, v in new.texts.items()}
            new = replace(before, texts=texts)
        self._commit(replace(new, next_doc_id=top + 1, streams=streams))

    def delete(self, ids: str | Sequence[str]) -> Status | list[Status]:
        m = self._writable()
        keys = [ids] if isinstance(ids, str) else list(ids)
        there = {r.pk: (r.doc_id, r["__segment"]) for r in self.docs(True).where(F.col("pk").isin(keys)).select("pk", "doc_id", "__segment").collect()}
        out, gone = [], []
        for k in keys:
            out.append(Status() if k in there else Status("NOT_FOUND", k))
            if k in there:
                gone.append(there.pop(k))
        if gone:
            self._commit(self._tombstones(self.spark.createDataFrame(gone, "doc_id long, __segment string").coalesce(1), m))
        return out[0] if isinstance(ids, str) else out

    def delete_by_filter(self, filter: str) -> None:
        """Delete what matches; nothing to delete is no error."""
        m = self._writable()
        where = self._filter(filter)
        if where is None:
            raise InvalidArgument("empty filter")
        self._commit(self._tombstones(self.docs(True).where(where).select("doc_id", "__segment"), m))

    # --- schema --------------------------------------------------------------------------------------------------------------

    def _respec(self, m: _Manifest, fields: Sequence[FieldSpec], **more) -> _Manifest:
        return replace(m, spec=replace(m.spec, fields=tuple(fields)), **more)

    def _named(self, name: str) -> FieldSpec:
        f = self.schema.get(name)
        if f is None:
            raise NotFound(f"no field {name}")
        return f

    def create_index(self, name: str, index: Any) -> None:
        """Vector fields take any vector index (cells and codes are made now), scalar ones INVERT; the same index again is no error."""
        m, f = self._writable(), self._named(name)
        if index.kind == "FTS" or f.is_fts:
            raise NotSupported("full-text indexes are part of the schema")
        new = replace(f, index=index)
        new.validate()
        if f.index == index and (not _copied(new) or name in m.indexes):
            return
        indexes = {k: v for k, v in m.indexes.items() if k != name}
        if _copied(new):
            indexes[name] = self._cells(new)
        self._commit(self._respec(m, [new if x.name == name else x for x in m.spec.fields], indexes=indexes))

    def _cells(self, f: FieldSpec) -> dict:
        """The index's own copy of a field's vectors: by cell for IVF, as codes if it quantizes."""
        path, index = f"{f.name}-{uuid.uuid4().hex}", f.index
        own = self.docs().where(F.col(f.name).isNotNull()).select("doc_id", F.col(f.name))
        n_list, n_iters = (index.n_list, index.n_iters) if index.kind == "IVF" else (0, 0)
        Cells.build(own, f"{self.path}/index/{path}", f.name, "doc_id", f.metric, n_list, n_iters, quantize=index.quantize, bits=getattr(index, "total_bits", 7), clusters=getattr(index, "num_clusters", 16))
        return {"path": path, "segments": list(self.manifest.segments), "quantize": index.quantize}

    def drop_index(self, name: str) -> None:
        """A vector field goes back to FLAT with IP."""
        m, f = self._writable(), self._named(name)
        if f.is_fts:
            raise NotSupported("full-text indexes are part of the schema")
        new = replace(f, index=FlatIndex() if f.is_vector else None)
        self._commit(self._respec(m, [new if x.name == name else x for x in m.spec.fields], indexes={k: v for k, v in m.indexes.items() if k != name}))

    def _rewritten(self, columns: dict[str, Column], m: _Manifest) -> _Manifest:
        """m with all live rows written anew under its fields, some computed."""
        return self._segment(self.docs().withColumns(columns), m, True)

    def add_column(self, f: FieldSpec, expression: str = "") -> None:
        """A new numeric field: null, which changes no file, or computed from another."""
        m = self._writable()
        f.validate()
        if self.schema.get(f.name) is not None:
            raise AlreadyExists(f"field {f.name}")
        if f.type not in NUMERIC:
            raise InvalidArgument("only numeric fields can be added")
        if not expression and not f.nullable:
            raise InvalidArgument("a field without an expression must be nullable")
        new = self._respec(m, [*m.spec.fields, f], physical=m.physical | {f.name: f"{f.name}-{uuid.uuid4().hex[:8]}"})
        if expression:
            new = self._rewritten({f.name: compile_expression(expression, f, m.spec)}, new)
        self._commit(new)

    def drop_column(self, name: str) -> None:
        m, f = self._writable(), self._named(name)
        if f.type not in NUMERIC:
            raise InvalidArgument("only numeric fields can be dropped")
        self._commit(self._respec(m, [x for x in m.spec.fields if x.name != name], physical={k: v for k, v in m.physical.items() if k != name}))

    def alter_column(self, name: str, new_name: str | None = None, schema: FieldSpec | None = None) -> None:
        """Rename a numeric field, or give it another numeric type."""
        m, f = self._writable(), self._named(name)
        if (new_name is None) == (schema is None):
            raise InvalidArgument("either a new name or a new schema")
        if f.type not in NUMERIC or schema is not None and schema.type not in NUMERIC:
            raise InvalidArgument("only numeric fields can be altered")
        if new_name is not None:
            new = replace(f, name=new_name)
            new.validate()
            if self.schema.get(new_name) is not None:
                raise AlreadyExists(f"field {new_name}")
            physical = {new_name if k == name else k: v for k, v in m.physical.items()}
            self._commit(self._respec(m, [new if x.name == name else x for x in m.spec.fields], physical=physical))
            return
        if f.nullable and not schema.nullable:
            raise InvalidArgument("a nullable field stays so")
        new = replace(schema, name=name)
        new.validate()
        altered = self._respec(m, [new if x.name == name else x for x in m.spec.fields], physical=m.physical | {name: f"{name}-{uuid.uuid4().hex[:8]}"})
        self._commit(self._rewritten({name: F.col(f"`{name}`").cast(SCALARS[new.type])}, altered))

    def optimize(self, most_deleted: float = 0.3, most_segments: int = 1) -> None:
        """Write live rows anew without what is deleted if there is much of it or many small segments, in files of even size
        by ranges of the key, so that its statistics tell which files a lookup needs, and merge and purge the postings; then make the vector indexes anew that
        don't cover all data."""
        m = self._writable()
        if m.segments and (len(m.segments) > most_segments or m.deleted):
            total = self.spark.read.parquet(*[f"{self.path}/data/{s}" for s in m.segments]).count()
            live = self.docs().count()
            if len(m.segments) > most_segments or total and 1 - live / total > most_deleted:
                n = max(1, math.ceil(live / m.spec.max_doc_count_per_segment))
                n = max(n, int(self.spark.conf.get("spark.sql.shuffle.partitions")) if live > 1_000_000 else 1)
                packed = self.docs().repartitionByRange(n, "pk").sortWithinPartitions("pk")
                self._commit(self._segment(packed, m, True))
                m = self.manifest
        stale = [f for f in m.spec.vectors if _copied(f) and set(m.indexes.get(f.name, {}).get("segments", [])) != set(m.segments)]
        if stale and m.segments:
            self._commit(replace(m, indexes=m.indexes | {f.name: self._cells(f) for f in stale}))

    def vacuum(self) -> None:
        """Remove files that the newest snapshot doesn't need; older snapshots can't be opened then."""
        m = self._writable()
        postings = [(f"fts/{name}", {f"segment={s}" for s in known["buckets"]}) for name, known in m.texts.items()]
        for folder, keep in (("data", set(m.segments)), ("deleted", {d["path"] for d in m.deleted}), ("index", {v["path"] for v in m.indexes.values()}), *postings):
            for name in files.list_names(self.spark, f"{self.path}/{folder}"):
                if name not in keep:
                    files.delete(self.spark, f"{self.path}/{folder}/{name}")
        for name in files.list_names(self.spark, f"{self.path}/manifest")[:-1]:
            files.delete(self.spark, f"{self.path}/manifest/{name}")
