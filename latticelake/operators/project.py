"""Projection: frames of any make-up reshaped to one declared set of fields."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticelake.errors import SchemaError
from latticelake.operators.match import _entry_signature, _frame_violations, _violation, answer
from latticelake.plans.spec import ColumnRule, Conformance, MetadataRule, Mode, SchemaSpec, is_pattern, rule_name, signature
from latticelake.types import SLOT, SPARK, Kind


#: Python types that a fill of a kind may have; a bool is no number here.
_FILLS = {Kind.BOOL: (bool,), Kind.INT: (int,), Kind.REAL: (int, float), Kind.STR: (str,)}


def fill_of(rule: ColumnRule | MetadataRule) -> object:
    """What stands in for a field that a frame lacks: the declared fill, NaN for reals, else None."""
    return math.nan if rule.fill is None and rule.kind is Kind.REAL else rule.fill


def obstacles(spec: SchemaSpec) -> Iterator[tuple[str, str]]:
    """(name, reason) of each rule that does not say which single field of which extent to make, or what to fill it with."""
    for rule in (*spec.columns, *spec.metadata):
        name = rule_name(rule)
        if is_pattern(name):
            yield name, "a pattern has no fixed shape; freeze the schema against a sample of frames"
        elif len(getattr(rule, "shape", ())) > 1:
            yield name, "a two-dimensional entry is not projected"
        elif rule.fill is not None and (type(rule.fill) is bool) != (rule.kind is Kind.BOOL) or not isinstance(rule.fill, (*_FILLS[rule.kind], type(None))):
            yield name, f"its fill {rule.fill!r} is not a valid value of kind {rule.kind.value}"
        elif not rule.required and fill_of(rule) is None:
            yield name, f"it may be absent and kind {rule.kind.value} has no natural null; declare a fill"


def check_projects(spec: SchemaSpec, mode: Mode | None = None) -> None:
    """Raise before any read where a spec in project mode cannot be projected to."""
    if (mode or spec.mode) == "project":
        for name, reason in obstacles(spec):
            raise SchemaError(f"field {name!r} cannot be projected: {reason}", name=name)


def _parts(rule: ColumnRule | MetadataRule, fill: object) -> tuple[Column, Column, Column]:
    """(flat values or null, violation or null, whether the frame must go) of one rule."""
    column = isinstance(rule, ColumnRule)
    axis, key, of = ("column", "name", "columns") if column else ("metadata", "key", "metadata")
    name, want = rule_name(rule), signature(rule)
    named = F.filter(of, lambda e: e[key] == name)
    fits = F.filter(named, lambda e: _entry_signature(axis, e) == want)
    hit = F.try_element_at(fits, F.lit(-1 if not column else 1))
    other = F.try_element_at(named, F.lit(-1))
    cells = F.col("n_atoms").cast("int") * rule.width if column else F.lit(rule.shape[0] if rule.shape else 1)
    kind = SPARK[rule.kind.value]
    filled = F.lit(None).cast(f"array<{kind}>") if fill is None else F.array_repeat(F.lit(fill).cast(kind), cells)
    absent = F.size(named) == 0
    silent = absent & F.lit(not rule.required)
    found = F.when(absent, F.lit(None)).otherwise(_entry_signature(axis, other))
    deviation = _violation(axis, name, "missing", want, None)
    report = F.when(hit.isNull() & ~silent, F.when(absent, deviation).otherwise(_violation(axis, name, "mismatch", want, found)))
    return F.when(hit.isNotNull(), hit[SLOT[rule.kind.value]]).otherwise(filled), report, hit.isNull() & F.lit(fill is None)


def project(frames: DataFrame, spec: SchemaSpec) -> DataFrame:
    """Typed frames: one column for each declared field, with ``deviations`` and ``dropped``.

    A scalar column is an array with an element for each atom, a wide one an array of
    arrays; metadata are scalars or arrays. No conversion takes place: a value of another
    kind counts as a deviation and gives way to the fill. A frame is dropped where a field
    can be neither found nor filled.
    """
    check_projects(spec, "project")
    columns, reports, drops = [], [], []
    for rule in (*spec.columns, *spec.metadata):
        flat, report, drop = _parts(rule, fill_of(rule))
        name = rule_name(rule)
        if isinstance(rule, ColumnRule):
            if rule.width > 1:
                rows = F.sequence(F.lit(0), F.col("n_atoms").cast("int") - 1)
                wide = F.transform(rows, lambda i: F.slice(flat, i * rule.width + 1, rule.width))
                flat = F.when(flat.isNull(), F.lit(None)).when(F.col("n_atoms") == 0, F.array().cast(f"array<array<{SPARK[rule.kind.value]}>>")).otherwise(wide)
        elif not rule.shape:
            flat = F.try_element_at(flat, F.lit(1))
        columns.append(flat.alias(name))
        reports.append(report)
        drops.append(drop)
    none = F.array().cast("array<struct<axis:string,name:string,deviation:string,expected:string,found:string>>")
    deviations = F.array_compact(F.array(*reports)) if reports else none
    if rules := _frame_violations(spec.frame):
        deviations = F.concat(deviations, *rules)
    dropped = F.lit(False)
    for d in drops:
        dropped = dropped | d
    return frames.select("source", "frame_index", "line", "n_atoms", *columns, deviations.alias("deviations"), dropped.alias("dropped"))


def enforce_projection(projected: DataFrame, level: Conformance = "required") -> DataFrame:
    """The frames that stay, once deviations have been answered (``strict`` and ``required`` alike)."""
    each = projected.select("source", "frame_index", F.posexplode("deviations").alias("ordinal", "v"))
    answer(each.select("source", "frame_index", "ordinal", "v.*"), level)
    return projected.where(~F.col("dropped")).drop("deviations", "dropped")
