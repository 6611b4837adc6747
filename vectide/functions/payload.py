"""Payloads: maps of string to a tagged value with exactly one field set. Int and float stay apart, strings are never numbers."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import invalid
from ..model import PAYLOAD, VALUE

#: Spark types of columns, and the field that holds them.
FIELD_OF = {T.StringType: "s", T.ByteType: "i", T.ShortType: "i", T.IntegerType: "i", T.LongType: "i", T.FloatType: "f", T.DoubleType: "f", T.DecimalType: "f", T.BooleanType: "b"}


def tagged(value: Column, field: str) -> Column:
    """A value struct, null for a null value."""
    kinds = {"s": "string", "i": "bigint", "f": "double", "b": "boolean"}
    parts = [(value if k == field else F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()]
    return F.when(value.isNotNull(), F.struct(*parts)).cast(VALUE)


def from_columns(schema: T.StructType, names: Sequence[str]) -> Column:
    """A payload of a DataFrame's columns; nulls are left out."""
    if not names:
        return F.create_map().cast(PAYLOAD)
    parts = []
    for name in names:
        kind = type(schema[name].dataType)
        if kind not in FIELD_OF:
            raise invalid(f"column {name} has type {schema[name].dataType.simpleString()}, which no payload value has")
        parts += [F.lit(name), tagged(F.col(name), FIELD_OF[kind])]
    return F.map_filter(F.create_map(*parts), lambda _, v: v.isNotNull()).cast(PAYLOAD)


def from_variant(value: Column) -> Column:
    """A payload of a VARIANT object. Integers within 64 bits are int, other numbers float; nulls, arrays and objects raise."""

    def one(key: Column, v: Column) -> Column:
        kind = F.schema_of_variant(v)
        number = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
        text, whole, real, flag = (F.try_variant_get(v, "$", t) for t in ("string", "bigint", "double", "boolean"))
        bad = F.raise_error(F.concat(F.lit("payload value of "), key, F.lit(" must be a string, number or boolean")))
        return (
            F.when(kind == "STRING", tagged(text, "s"))
            .when(kind == "BIGINT", tagged(whole, "i"))
            .when(number, tagged(real, "f"))
            .when(kind == "BOOLEAN", tagged(flag, "b"))
            .otherwise(bad.cast(VALUE))
        )

    return F.when(value.isNotNull(), F.transform_values(value.cast("map<string,variant>"), one)).otherwise(F.create_map().cast(PAYLOAD))


def from_json(text: Column) -> Column:
    return from_variant(F.parse_json(text))


def quoted(text: Column) -> Column:
    """A JSON string, null for a null text."""
    whole = F.to_json(F.struct(text.alias("k")))
    return F.when(text.isNotNull(), F.substr(whole, F.lit(6), F.length(whole) - 6))


def value_json(v: Column) -> Column:
    return F.coalesce(quoted(v["s"]), v["i"].cast("string"), F.when(v["f"].isNotNull(), v["f"].cast("string")), v["b"].cast("string"))


def to_json(payload: Column) -> Column:
    """The JSON object of a payload, keys in order; int 1 stays 1, float 1 is 1.0."""
    entries = F.array_sort(F.transform(F.map_keys(payload), lambda k: k))
    return F.concat(F.lit("{"), F.concat_ws(",", F.transform(entries, lambda k: F.concat(quoted(k), F.lit(":"), value_json(payload[k])))), F.lit("}"))


def value_of(value: object) -> dict[str, object]:
    """The tagged value of a Python scalar, as a dict for createDataFrame."""
    out: dict[str, object] = {"s": None, "i": None, "f": None, "b": None}
    if isinstance(value, bool):
        out["b"] = value
    elif isinstance(value, int):
        if -(1 << 63) <= value < 1 << 63:
            out["i"] = value
        else:
            out["f"] = float(value)
    elif isinstance(value, float):
        if not math.isfinite(value):
            raise invalid("payload numbers must be finite")
        out["f"] = value
    elif isinstance(value, str):
        out["s"] = value
    else:
        raise invalid(f"payload value {value!r} must be a string, number or boolean")
    return out


def of_dict(payload: Mapping[str, object] | None) -> dict[str, dict[str, object]]:
    """A payload of Python scalars; blank keys are refused."""
    payload = payload or {}
    for key in payload:
        if not isinstance(key, str) or not key.strip():
            raise invalid("payload keys must not be blank")
    return {k: value_of(v) for k, v in payload.items()}


def to_dict(payload) -> dict[str, object]:
    """Python scalars of a payload that has been collected."""
    out = {}
    for k, v in (payload or {}).items():
        own = v.asDict() if hasattr(v, "asDict") else v
        out[k] = next(x for x in (own["s"], own["i"], own["f"], own["b"]) if x is not None)
    return out


def literal(payload: Mapping[str, object]) -> Column:
    """A payload of Python scalars as a Column."""
    parts = []
    for k, v in of_dict(payload).items():
        field, own = next((f, x) for f, x in v.items() if x is not None)
        parts += [F.lit(k), tagged(F.lit(own), field)]
    return F.create_map(*parts).cast(PAYLOAD)


def patched(payload: Column, patch: Mapping[str, object]) -> Column:
    """payload with the patch's keys set; others stay. The old keys go first, since a map has no two values of a key."""
    own = F.coalesce(payload, F.create_map().cast(PAYLOAD))
    return F.map_concat(F.map_filter(own, lambda k, _: ~k.isin(list(patch))), literal(patch)) if patch else own


def without(payload: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(F.coalesce(payload, F.create_map().cast(PAYLOAD)), lambda k, _: ~k.isin(list(keys)))


def unique_keys(keys: Sequence[str]) -> list[str]:
    """Trimmed, without repeats, in their order."""
    own = list(dict.fromkeys(k.strip() for k in keys))
    if not own or not all(own):
        raise invalid("payload keys must not be blank")
    return own
