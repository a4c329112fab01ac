"""What a caller asks for: queries, their parameters, and checks that need no data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from tessera.errors import InvalidArgument
from tessera.schema import MAX_OUTPUT_FIELDS, MAX_SPARSE, MAX_TOPK, CollectionSpec, FieldSpec


@dataclass(frozen=True)
class HnswQueryParams:
    ef: int = 300
    radius: float = 0.0
    is_linear: bool = False
    is_using_refiner: bool = False


@dataclass(frozen=True)
class IvfQueryParams:
    nprobe: int = 10
    is_using_refiner: bool = False
    scale_factor: float = 10
    radius: float = 0.0
    is_linear: bool = False


@dataclass(frozen=True)
class HnswRabitqQueryParams:
    ef: int = 300
    radius: float = 0.0
    is_linear: bool = False
    is_using_refiner: bool = False


@dataclass(frozen=True)
class FlatQueryParams:
    is_using_refiner: bool = False
    scale_factor: float = 10
    radius: float = 0.0
    is_linear: bool = False


@dataclass(frozen=True)
class VamanaQueryParams:
    ef_search: int = 200
    radius: float = 0.0
    is_linear: bool = False
    is_using_refiner: bool = False


@dataclass(frozen=True)
class FtsQueryParams:
    default_operator: str = ""


#: Parameters that an index takes.
PARAMS = {
    "FLAT": FlatQueryParams, "IVF": IvfQueryParams, "HNSW": HnswQueryParams, "HNSW_RABITQ": HnswRabitqQueryParams,
    "VAMANA": VamanaQueryParams, "FTS": FtsQueryParams,
}


@dataclass(frozen=True)
class Fts:
    """query_string: the query language; match_string: plain words. One of them."""

    query_string: str | None = None
    match_string: str | None = None


@dataclass(frozen=True)
class Query:
    """A search in one field: by a vector, by the vector of a stored document, or by text."""

    field_name: str
    id: str | None = None
    vector: Sequence[float] | dict[int, float] | None = None
    param: Any = None
    fts: Fts | None = None
    num_candidates: int = 10

    @property
    def by_text(self) -> bool:
        return self.fts is not None

    def validate(self, spec: CollectionSpec) -> FieldSpec:
        f = spec.get(self.field_name)
        if f is None:
            raise InvalidArgument(f"no field {self.field_name}")
        if self.id is not None and self.vector is not None:
            raise InvalidArgument("a query is by id or by vector")
        if self.by_text:
            if self.id is not None or self.vector is not None or self.param is not None and not isinstance(self.param, FtsQueryParams):
                raise InvalidArgument("a text query takes no vector")
            if not f.is_fts:
                raise InvalidArgument(f"no full-text index on {f.name}")
            if bool(self.fts.query_string) == bool(self.fts.match_string):
                raise InvalidArgument("a text query has a query_string or a match_string")
            if self.operator not in ("", "and", "or"):
                raise InvalidArgument(f"default operator {self.operator}")
            return f
        if not f.is_vector:
            raise InvalidArgument(f"{f.name} is no vector field")
        if self.id is None and self.vector is None:
            raise InvalidArgument("a query needs a vector, an id or a text")
        if self.param is not None and not isinstance(self.param, PARAMS[f.index.kind]):
            raise InvalidArgument(f"{type(self.param).__name__} for a {f.index.kind} index")
        if self.vector is not None:
            check_query_vector(f, self.vector)
        return f

    @property
    def operator(self) -> str:
        return (getattr(self.param, "default_operator", "") or "").lower()


def check_query_vector(f: FieldSpec, v: Any) -> None:
    if f.is_sparse:
        if not isinstance(v, dict) or len(v) > MAX_SPARSE or any(type(k) is not int or k < 0 for k in v):
            raise InvalidArgument(f"sparse query for {f.name}")
    elif isinstance(v, (dict, str, bytes)) or len(v) != f.dimension:
        raise InvalidArgument(f"query for {f.name} must have {f.dimension} values")


def sparse_dict(indices: Sequence[int], values: Sequence[float]) -> dict[int, float]:
    """Sparse vector from parallel lists; indices must be unique."""
    if len(indices) != len(values) or len(set(indices)) < len(indices):
        raise InvalidArgument("indices and values must match, indices be unique")
    return dict(sorted(zip(map(int, indices), map(float, values), strict=True)))


def check_topk(k: int) -> int:
    if type(k) is not int or not 0 <= k <= MAX_TOPK:
        raise InvalidArgument(f"topk {k}")
    return k


def output_columns(spec: CollectionSpec, fields: Sequence[str] | None, include_vector: bool) -> list[str]:
    """None: all scalar fields; a list: those; vectors only if asked for."""
    if fields is None:
        names = [f.name for f in spec.scalars]
    else:
        if len(fields) > MAX_OUTPUT_FIELDS:
            raise InvalidArgument(f"{len(fields)} output fields")
        for n in fields:
            if spec.get(n) is None:
                raise InvalidArgument(f"no field {n}")
        names = list(dict.fromkeys(fields))
    return names + ([f.name for f in spec.vectors if f.name not in names] if include_vector else [])
