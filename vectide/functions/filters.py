"""Boolean payload filters: parsed strictly, checked on the driver, compiled to one Column.

{"must": [...], "should": [...], "must_not": [...], "minimum_should_match": n}; a clause is {"field", "value"} or
{"field", "gt" | "gte" | "lt" | "lte"}. A clause on a missing key is false, never null, so must_not keeps such points.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import invalid

#: Two numbers are equal if they differ by at most this times the larger of their sizes and 1.
TOLERANCE = 2.220446049250313e-16 * 8
BOUNDS = ("gt", "gte", "lt", "lte")


@dataclass(frozen=True)
class Match:
    field: str
    value: object


@dataclass(frozen=True)
class Range:
    field: str
    gt: float | None = None
    gte: float | None = None
    lt: float | None = None
    lte: float | None = None


@dataclass(frozen=True)
class Filter:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    minimum_should_match: int | None = None


def _number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def parse_clause(raw: object) -> Match | Range:
    if not isinstance(raw, Mapping) or not isinstance(raw.get("field"), str):
        raise invalid("a filter clause needs a string field")
    keys = set(raw) - {"field"}
    if keys == {"value"}:
        if not isinstance(raw["value"], (str, bool, int, float)):
            raise invalid("a match value must be a string, number or boolean")
        return Match(raw["field"], raw["value"])
    if not keys <= set(BOUNDS):
        raise invalid(f"a filter clause has either value or {', '.join(BOUNDS)}")
    bounds = {k: raw[k] for k in keys if raw[k] is not None}
    if not all(map(_number, bounds.values())):
        raise invalid("range bounds must be numbers")
    return Range(raw["field"], **{k: float(v) for k, v in bounds.items()})


def parse(raw: Mapping | Filter | None, must_not: bool = True) -> Filter | None:
    """A checked filter. must_not: whether that part may be used."""
    if raw is None:
        return None
    if not isinstance(raw, Filter):
        if unknown := set(raw) - {"must", "should", "must_not", "minimum_should_match"}:
            raise invalid(f"unknown filter parts {sorted(unknown)}")
        parts = {k: tuple(parse_clause(c) for c in raw.get(k) or ()) for k in ("must", "should", "must_not")}
        raw = Filter(**parts, minimum_should_match=raw.get("minimum_should_match"))
    return check(raw, must_not)


def check(own: Filter, must_not: bool = True) -> Filter:
    if own.must_not and not must_not:
        raise invalid("must_not filters are not enabled")
    least = own.minimum_should_match
    if least is not None and (not isinstance(least, int) or isinstance(least, bool) or least < 0):
        raise invalid("minimum_should_match must be a whole number")
    if least is not None and least > len(own.should):
        raise invalid(f"minimum_should_match {least} is over the {len(own.should)} should clauses")
    for clause in (*own.must, *own.should, *own.must_not):
        if not clause.field.strip():
            raise invalid("filter field must not be blank")
        if isinstance(clause, Range):
            bounds = [getattr(clause, b) for b in BOUNDS]
            if all(b is None for b in bounds):
                raise invalid("a range needs a bound")
            if not all(b is None or math.isfinite(b) for b in bounds):
                raise invalid("range bounds must be finite")
            low = clause.gte if clause.gte is not None else clause.gt
            high = clause.lte if clause.lte is not None else clause.lt
            if low is not None and high is not None and low > high:
                raise invalid("a range's lower bound is over its upper bound")
    return own


#: Gives the value struct (s, i, f, b) of a field.
Lookup = Callable[[str], Column]


def in_payload(payload: Column) -> Lookup:
    return lambda field: payload[F.lit(field)]


def in_columns(columns: Mapping[str, str]) -> Lookup:
    """Fields that are columns of their own; columns: their kind (s, i, f or b). Their predicates can reach the scan."""
    from .payload import tagged

    return lambda field: tagged(F.col(field), columns[field]) if field in columns else tagged(F.lit(None).cast("string"), "s")


def as_number(value: Column) -> Column:
    return F.coalesce(value["i"].cast("double"), value["f"])


def equal(value: Column, literal: object) -> Column:
    if isinstance(literal, bool):
        found = value["b"] == F.lit(literal)
    elif isinstance(literal, str):
        found = value["s"] == F.lit(literal)
    elif not math.isfinite(literal):
        found = F.lit(False)
    else:
        own, wanted = as_number(value), F.lit(float(literal))
        found = (F.abs(own - wanted) <= F.lit(TOLERANCE) * F.greatest(F.abs(own), F.abs(wanted), F.lit(1.0))) & ~F.isnan(own) & (F.abs(own) < F.lit(math.inf))
    return F.coalesce(found, F.lit(False))


def within(value: Column, clause: Range) -> Column:
    own = as_number(value)
    tests = [(clause.gt, lambda b: own > b), (clause.gte, lambda b: own >= b), (clause.lt, lambda b: own < b), (clause.lte, lambda b: own <= b)]
    return F.coalesce(reduce(lambda a, b: a & b, (test(F.lit(bound)) for bound, test in tests if bound is not None)), F.lit(False))


def compile_clause(clause: Match | Range, lookup: Lookup) -> Column:
    value = lookup(clause.field)
    return equal(value, clause.value) if isinstance(clause, Match) else within(value, clause)


def compile_filter(own: Filter | None, lookup: Lookup) -> Column | None:
    """One Column, or None if the filter lets everything through."""
    if own is None:
        return None
    parts: list[Column] = [compile_clause(c, lookup) for c in own.must]
    parts += [~compile_clause(c, lookup) for c in own.must_not]
    least = 1 if own.minimum_should_match is None else own.minimum_should_match
    if own.should and least:
        found = [compile_clause(c, lookup) for c in own.should]
        parts.append(reduce(lambda a, b: a | b, found) if least == 1 else reduce(lambda a, b: a + b, (c.cast("int") for c in found)) >= least)
    return reduce(lambda a, b: a & b, parts) if parts else None


def evaluate(own: Filter | None, payload: Mapping[str, object]) -> bool:
    """The same on the driver, for a payload of Python scalars (tests, small checks)."""

    def holds(clause: Match | Range) -> bool:
        value = payload.get(clause.field)
        if isinstance(clause, Range):
            return _number(value) and all(b is None or t(float(value), b) for b, t in zip((clause.gt, clause.gte, clause.lt, clause.lte), (float.__gt__, float.__ge__, float.__lt__, float.__le__), strict=True))
        if _number(value) and _number(clause.value):
            a, b = float(value), float(clause.value)
            return math.isfinite(a) and math.isfinite(b) and abs(a - b) <= TOLERANCE * max(abs(a), abs(b), 1.0)
        return type(value) is type(clause.value) and value == clause.value

    if own is None:
        return True
    least = 1 if own.minimum_should_match is None else own.minimum_should_match
    return all(map(holds, own.must)) and not any(map(holds, own.must_not)) and (not own.should or sum(map(holds, own.should)) >= least)


def fields_of(own: Filter | None) -> Sequence[str]:
    return [] if own is None else sorted({c.field for c in (*own.must, *own.should, *own.must_not)})
