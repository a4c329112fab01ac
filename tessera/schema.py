"""Fields and collections: types, limits, validation, and the Spark schema that stands for them."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidArgument

# Names and limits of the data model.
COLLECTION_NAME = re.compile(r"[a-zA-Z0-9_-]{3,64}")
FIELD_NAME = re.compile(r"[a-zA-Z0-9_-]{1,32}")
PRIMARY_KEY = re.compile(r"[a-zA-Z0-9_!@#$%+=.-]{1,64}")
MAX_DIMENSION = 20_000
MAX_SCALAR_FIELDS = 1024
MAX_VECTOR_FIELDS = 5
MAX_TOPK = 100_000
MAX_OUTPUT_FIELDS = 1024
MAX_WRITE_BATCH = 1024
MAX_SPARSE = 16_384
MAX_CONTAIN = 32
MAX_IN = 20_000
MAX_FILTERS = 4096
MAX_DOCS_PER_SEGMENT, MIN_DOCS_PER_SEGMENT = 10_000_000, 1000

SCALARS: dict[str, T.DataType] = {
    "BINARY": T.BinaryType(), "STRING": T.StringType(), "BOOL": T.BooleanType(), "INT32": T.IntegerType(), "INT64": T.LongType(),
    "UINT32": T.LongType(), "UINT64": T.DecimalType(20, 0), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(),
}
ARRAYS = {f"ARRAY_{k}": T.ArrayType(v) for k, v in SCALARS.items()}
SPARSE = T.StructType([T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.FloatType()))])
VECTORS: dict[str, T.DataType] = {
    "VECTOR_FP32": T.ArrayType(T.FloatType()), "VECTOR_FP16": T.ArrayType(T.FloatType()), "VECTOR_INT8": T.ArrayType(T.ByteType()),
    "SPARSE_VECTOR_FP32": SPARSE, "SPARSE_VECTOR_FP16": SPARSE,
}
NUMERIC = ("INT32", "INT64", "UINT32", "UINT64", "FLOAT", "DOUBLE")
INTEGERS = {"INT32": (-(2**31), 2**31 - 1), "INT64": (-(2**63), 2**63 - 1), "UINT32": (0, 2**32 - 1), "UINT64": (0, 2**64 - 1)}
METRICS = ("L2", "IP", "COSINE", "MIPSL2")
#: Quantizers that a vector type allows.
QUANTIZERS = {"VECTOR_FP32": ("FP16", "INT8", "INT4", "RABITQ"), "SPARSE_VECTOR_FP32": ("FP16",)}


@dataclass(frozen=True)
class InvertIndex:
    """Scalar index. Parquet statistics and pushed filters do its work: it only marks a field."""

    enable_range_optimization: bool = True
    enable_extended_wildcard: bool = False
    kind: str = "INVERT"


@dataclass(frozen=True)
class FlatIndex:
    metric: str = "IP"
    quantize: str | None = None
    kind: str = "FLAT"


@dataclass(frozen=True)
class IvfIndex:
    metric: str = "IP"
    n_list: int = 1024
    n_iters: int = 10
    use_soar: bool = False
    quantize: str | None = None
    kind: str = "IVF"


@dataclass(frozen=True)
class HnswIndex:
    """Taken for its parameters; search is exact (recall 1)."""

    metric: str = "IP"
    m: int = 50
    ef_construction: int = 500
    quantize: str | None = None
    use_contiguous_memory: bool = False
    kind: str = "HNSW"


@dataclass(frozen=True)
class HnswRabitqIndex:
    metric: str = "IP"
    total_bits: int = 7
    num_clusters: int = 16
    m: int = 50
    ef_construction: int = 500
    sample_count: int = 0
    quantize: str | None = "RABITQ"
    kind: str = "HNSW_RABITQ"


@dataclass(frozen=True)
class VamanaIndex:
    """Taken for its parameters; search is exact (recall 1)."""

    metric: str = "IP"
    max_degree: int = 64
    search_list_size: int = 100
    alpha: float = 1.2
    saturate_graph: bool = False
    use_contiguous_memory: bool = False
    use_id_map: bool = False
    quantize: str | None = None
    kind: str = "VAMANA"


@dataclass(frozen=True)
class FtsIndex:
    tokenizer_name: str = "standard"
    filters: tuple[str, ...] = ("lowercase",)
    extra_params: str = ""
    kind: str = "FTS"


INDEXES = {c.kind: c for c in (InvertIndex, FlatIndex, IvfIndex, HnswIndex, HnswRabitqIndex, VamanaIndex, FtsIndex)}


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str
    nullable: bool = False
    dimension: int = 0
    index: Any = None

    @property
    def is_vector(self) -> bool:
        return self.type in VECTORS

    @property
    def is_sparse(self) -> bool:
        return self.type.startswith("SPARSE")

    @property
    def is_array(self) -> bool:
        return self.type in ARRAYS

    @property
    def is_fts(self) -> bool:
        return getattr(self.index, "kind", None) == "FTS"

    @property
    def element(self) -> str:
        return self.type.removeprefix("ARRAY_")

    @property
    def metric(self) -> str:
        return getattr(self.index, "metric", "IP")

    def spark(self) -> T.StructField:
        kind = VECTORS.get(self.type) or ARRAYS.get(self.type) or SCALARS[self.type]
        return T.StructField(self.name, kind, True, {"field": self.as_json()})

    def as_json(self) -> dict:
        return {"name": self.name, "type": self.type, "nullable": self.nullable, "dimension": self.dimension, "index": asdict(self.index) if self.index else None}

    @staticmethod
    def from_json(x: dict) -> FieldSpec:
        i = x.get("index")
        index = INDEXES[i["kind"]](**{k: tuple(v) if isinstance(v, list) else v for k, v in i.items()}) if i else None
        return FieldSpec(x["name"], x["type"], x["nullable"], x["dimension"], index)

    def validate(self) -> None:
        if not FIELD_NAME.fullmatch(self.name):
            raise InvalidArgument(f"field name {self.name!r}")
        if self.type not in SCALARS and self.type not in ARRAYS and self.type not in VECTORS:
            raise InvalidArgument(f"type {self.type} of field {self.name}")
        kind = getattr(self.index, "kind", None)
        if not self.is_vector:
            if kind not in (None, "INVERT", "FTS"):
                raise InvalidArgument(f"{kind} index on the scalar field {self.name}")
            if kind == "FTS" and self.type != "STRING":
                raise InvalidArgument(f"full-text index on {self.name}, which isn't STRING")
            if kind == "INVERT" and "BINARY" in self.type:
                raise InvalidArgument(f"index on the binary field {self.name}")
            return
        if kind in ("INVERT", "FTS"):
            raise InvalidArgument(f"{kind} index on the vector field {self.name}")
        if self.is_sparse:
            if kind not in (None, "FLAT", "HNSW") or self.metric != "IP":
                raise InvalidArgument(f"sparse field {self.name} takes FLAT or HNSW with IP")
        elif not 0 < self.dimension <= MAX_DIMENSION:
            raise InvalidArgument(f"dimension {self.dimension} of field {self.name}")
        if self.metric not in METRICS:
            raise InvalidArgument(f"metric {self.metric}")
        if self.type == "VECTOR_INT8" and (self.metric == "COSINE" or kind == "IVF" and self.metric == "IP"):
            raise InvalidArgument(f"{kind} with {self.metric} on the INT8 field {self.name}")
        q = getattr(self.index, "quantize", None)
        if q and q not in QUANTIZERS.get(self.type, ()):
            raise InvalidArgument(f"quantizer {q} on {self.type}")
        if kind == "HNSW_RABITQ" and (self.type != "VECTOR_FP32" or not 64 <= self.dimension <= 4095 or self.metric not in ("L2", "IP", "COSINE")):
            raise InvalidArgument(f"HNSW_RABITQ on field {self.name}")


@dataclass(frozen=True)
class CollectionSpec:
    name: str
    fields: tuple[FieldSpec, ...] = field(default_factory=tuple)
    max_doc_count_per_segment: int = MAX_DOCS_PER_SEGMENT

    def __post_init__(self) -> None:
        own = tuple(replace(f, index=FlatIndex()) if f.is_vector and f.index is None else f for f in self.fields)
        object.__setattr__(self, "fields", own)

    def validate(self) -> None:
        if not COLLECTION_NAME.fullmatch(self.name):
            raise InvalidArgument(f"collection name {self.name!r}")
        if self.max_doc_count_per_segment < MIN_DOCS_PER_SEGMENT:
            raise InvalidArgument(f"segments of {self.max_doc_count_per_segment} documents")
        if not self.fields:
            raise InvalidArgument("no fields")
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise InvalidArgument("field names repeat")
        if len(self.vectors) > MAX_VECTOR_FIELDS or len(self.scalars) > MAX_SCALAR_FIELDS:
            raise InvalidArgument("too many fields")
        for f in self.fields:
            f.validate()

    @property
    def scalars(self) -> list[FieldSpec]:
        return [f for f in self.fields if not f.is_vector]

    @property
    def vectors(self) -> list[FieldSpec]:
        return [f for f in self.fields if f.is_vector]

    def get(self, name: str) -> FieldSpec | None:
        return next((f for f in self.fields if f.name == name), None)

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField("pk", T.StringType()), T.StructField("doc_id", T.LongType()), *(f.spark() for f in self.fields)])

    def dumps(self) -> str:
        return json.dumps({"name": self.name, "fields": [f.as_json() for f in self.fields], "max_doc_count_per_segment": self.max_doc_count_per_segment})

    @staticmethod
    def loads(text: str) -> CollectionSpec:
        x = json.loads(text)
        return CollectionSpec(x["name"], tuple(map(FieldSpec.from_json, x["fields"])), x["max_doc_count_per_segment"])

    @staticmethod
    def of(schema: T.StructType, name: str = "table") -> CollectionSpec:
        """What filters need to know of a DataFrame that isn't a collection: types by name; columns that no field type stands for
        are left out."""
        by_type = {v.simpleString(): k for k, v in reversed((SCALARS | ARRAYS).items())} | {"bigint": "INT64", "array<bigint>": "ARRAY_INT64"}
        return CollectionSpec(name, tuple(FieldSpec(f.name, by_type[f.dataType.simpleString()], True) for f in schema if f.dataType.simpleString() in by_type))


def check_value(f: FieldSpec, v: Any) -> None:
    """Types must match without coercion; integers must be in range."""
    bad = InvalidArgument(f"value of type {type(v).__name__} for field {f.name} ({f.type})")
    if f.is_sparse:
        pairs = v if isinstance(v, dict) else None
        if pairs is None or len(pairs) > MAX_SPARSE or any(type(k) is not int or k < 0 or k >= 2**32 for k in pairs):
            raise bad
        return
    if f.is_vector:
        if isinstance(v, (str, bytes)) or not hasattr(v, "__len__") or len(v) != f.dimension:
            raise InvalidArgument(f"vector of field {f.name} must have {f.dimension} values")
        if f.type == "VECTOR_INT8" and any(not -128 <= int(x) <= 127 for x in v):
            raise bad
        return
    if f.is_array:
        if not isinstance(v, (list, tuple)):
            raise bad
        for x in v:
            _check_scalar(f.element, x, bad)
        return
    _check_scalar(f.type, v, bad)


def refusal(spec: CollectionSpec, there: set[str]) -> Column:
    """Why a row (pk and the fields that are there) can't be stored, null if it can: check_value() in Columns."""
    found = [F.when(F.col("pk").isNull() | ~F.col("pk").rlike(f"^(?:{PRIMARY_KEY.pattern})$"), F.concat(F.lit("key "), F.coalesce("pk", F.lit("null"))))]
    for f in spec.fields:
        own = F.col(f"`{f.name}`")
        if f.name not in there:
            if not f.nullable:
                found.append(F.lit(f"no value for field {f.name}"))
            continue
        bad = F.lit(False)
        if f.is_sparse:
            bad = (F.size(own["indices"]) != F.size(own["values"])) | (F.size(own["indices"]) > MAX_SPARSE) | F.exists(own["indices"], lambda i: i.isNull() | (i < 0) | (i >= 2**32))
            bad = bad | (F.size(F.array_distinct(own["indices"])) < F.size(own["indices"])) | F.exists(own["values"], lambda x: x.isNull())
        elif f.is_vector:
            bad = (F.size(own) != f.dimension) | F.exists(own, lambda x: x.isNull())
            if f.type == "VECTOR_INT8":
                bad = bad | F.exists(own, lambda x: (x < -128) | (x > 127))
        elif f.element in INTEGERS:
            low, high = (F.lit(str(x)).cast("decimal(20,0)") for x in INTEGERS[f.element])
            outside = lambda x: (x < low) | (x > high)  # noqa: B023, E731
            bad = F.exists(own, outside) if f.is_array else outside(own)
        found.append(F.when(bad, F.lit(f"value for field {f.name} ({f.type})")))
        if not f.nullable:
            found.append(F.when(own.isNull(), F.lit(f"null for field {f.name}")))
    return F.coalesce(*found)


def _check_scalar(kind: str, v: Any, bad: Exception) -> None:
    if kind in INTEGERS:
        if type(v) is not int or not INTEGERS[kind][0] <= v <= INTEGERS[kind][1]:
            raise bad
    elif kind in ("FLOAT", "DOUBLE"):
        if type(v) not in (int, float):
            raise bad
    elif type(v) is not {"STRING": str, "BOOL": bool, "BINARY": bytes}[kind]:
        raise bad
