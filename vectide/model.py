"""Schemas, enumerations and limits."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from enum import Enum

from .errors import invalid

VALUE = "struct<s:string,i:bigint,f:double,b:boolean>"
PAYLOAD = f"map<string,{VALUE}>"
COLLECTIONS = "name string, dimension int, strict_finite boolean"
POINTS = f"collection string, id bigint, values array<float>, payload {PAYLOAD}"
#: (version, ord) is the total order of mutations: the batch, and the place in it.
MUTATION_KINDS = {"version": "bigint", "ord": "bigint", "op": "string", "collection": "string", "id": "bigint", "dimension": "int", "strict_finite": "boolean", "values": "array<float>", "payload": PAYLOAD}
MUTATIONS = ", ".join(f"{name} {kind}" for name, kind in MUTATION_KINDS.items())
QUERIES = "qid bigint, q array<float>"

CREATE, DELETE, UPSERT, REMOVE = "create_collection", "delete_collection", "upsert_point", "delete_point"


class Metric(str, Enum):
    DOT = "dot"
    L2 = "l2"
    COSINE = "cosine"


class Mode(str, Enum):
    EXACT = "exact"
    IVF = "ivf"
    AUTO = "auto"


@dataclass(frozen=True)
class Limits:
    """Defaults and bounds. 0 means no limit where a comment says so."""

    max_dimension: int = 4096
    max_points_per_collection: int = 1_000_000
    max_topk_limit: int = 1000
    default_topk: int = 10
    max_page_limit: int = 1000
    default_page: int = 100
    max_offset: int = 100_000
    max_batch: int = 256
    max_queries: int = 256
    max_collections: int = 0  # per tenant; 0: no limit
    max_points: int = 0  # per tenant; 0: no limit
    memory_budget_bytes: int = 0  # 0: no limit
    rate_per_minute: int = 0  # per tenant; 0: no limit
    rate_retention_minutes: int = 60
    compact_after: int = 64
    must_not: bool = True
    payload_mutations: bool = True
    points_count: bool = True

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "int" and (value < 0 or (value == 0 and not f.name.startswith(("max_collections", "max_points", "memory", "rate")))):
                raise invalid(f"{f.name} must be positive")
        if self.default_topk > self.max_topk_limit:
            object.__setattr__(self, "default_topk", self.max_topk_limit)


def enum_of(kind: type[Enum], value):
    try:
        return kind(value)
    except ValueError:
        raise invalid(f"{value!r} is not one of {[x.value for x in kind]}") from None


def collection_name(name: str) -> str:
    """The name without white space at its ends, if it may be used."""
    name = name.strip()
    if not name:
        raise invalid("collection name must not be empty")
    if len(name) > 128:
        raise invalid("collection name has more than 128 characters")
    if not re.fullmatch(r"[A-Za-z0-9._-]+", name) or ".." in name:
        raise invalid(f"collection name {name!r}: letters, digits, '.', '_' and '-' only, without '..'")
    return name


def scoped(name: str, tenant: str | None) -> str:
    """The name under which a tenant's collection is stored."""
    return f"{tenant}::{name}" if tenant else name
