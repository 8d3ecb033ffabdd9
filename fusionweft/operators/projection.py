"""The projection language, compiled once into columns: paths, filters, transforms, missing-value policies, nested targets.

Columns have types, so what depends on a value's type is decided when the plan is made. A path that leads nowhere is null.
`project` keeps omitted fields as nulls; `render` leaves them out of the JSON text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import py_round
from ..plans.config import ConfigError, FieldSpec, ProjectionConfig
from .identity import iso

Typed = tuple[Column, T.DataType]
NOTHING: Typed = (None, T.NullType())
_STEP = re.compile(r"^([^\[\]]+)(?:\[(\d+|\*)\])?$")
_FILTER = re.compile(r"(\w+)\s*(>=|<=|!=|==|=|>|<)\s*(.+)", re.S)
_NUMBERS = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)


def _null() -> Typed:
    return F.lit(None).cast("string"), T.NullType()


def _member(value: Typed, name: str) -> Typed:
    column, kind = value
    if isinstance(kind, T.StructType) and name in kind.names:
        return column.getField(name), kind[name].dataType
    return _null()


def resolve(schema: T.StructType, path: str) -> Typed:
    """The column of a path: `a`, `a.b`, `a[0]`, `a[0].b`, `a[*].b`."""

    def each(column: Column, kind: T.DataType, rest: list[str]) -> Typed:
        found: list[T.DataType] = []

        def one(x: Column) -> Column:
            inner, kind_ = walk((x, kind), rest)
            found.append(kind_)
            return inner

        out = F.transform(column, one)
        return out, T.ArrayType(T.StringType() if isinstance(found[-1], T.NullType) else found[-1])

    def walk(value: Typed, steps: list[str]) -> Typed:
        for k, step in enumerate(steps):
            m = _STEP.match(step)
            if not m:
                return _null()
            value = _member(value, m[1])
            if m[2] is None:
                continue
            column, kind = value
            if not isinstance(kind, T.ArrayType):
                return _null()
            if m[2] == "*":
                return each(column, kind.elementType, steps[k + 1 :])
            value = F.get(column, F.lit(int(m[2]))), kind.elementType
        return value

    steps = path.split(".")
    m = _STEP.match(steps[0])
    if not m or m[1] not in schema.names:
        return _null()
    whole = F.struct(F.col(m[1]).alias(m[1]))
    return walk((F.col(m[1]), schema[m[1]].dataType), steps[1:]) if m[2] is None else walk((whole, T.StructType([schema[m[1]]])), steps)


def apply_filter(value: Typed, spec: str | None, compat: str = "documented") -> Typed:
    """Keeps the items of an array whose attribute compares as asked. Null attributes and unequal types are dropped (kept by `!=`)."""
    column, kind = value
    m = _FILTER.match(spec.strip()) if spec else None
    if not m or not isinstance(kind, T.ArrayType):
        return value
    name, op, text = m[1], m[2], m[3].strip()
    if compat == "observed" and op in (">=", "<=", "=="):  # these were read as one sign and a literal that begins with `=`
        op, text = op[0], ("= " if m[3][:1] == " " else "=") + text
    item = kind.elementType
    none = lambda: (F.filter(column, lambda _: F.lit(False)), kind)
    if not isinstance(item, T.StructType) or name not in item.names:
        return none()
    own = item[name].dataType
    truth = {"true": True, "false": False}.get(text.lower())
    try:
        number = float(text)
    except ValueError:
        number = None
    if truth is not None:
        literal, fits = F.lit(truth), isinstance(own, T.BooleanType)
    elif number is not None:
        literal, fits = F.lit(number), isinstance(own, _NUMBERS)
    else:
        literal, fits = F.lit(text), isinstance(own, T.StringType)
    if not fits:
        return (F.filter(column, lambda x: x[name].isNotNull()), kind) if op == "!=" else none()
    compare = {">": lambda a: a > literal, "<": lambda a: a < literal, ">=": lambda a: a >= literal, "<=": lambda a: a <= literal, "=": lambda a: a == literal, "==": lambda a: a == literal, "!=": lambda a: a != literal}[op]
    return F.filter(column, lambda x: x[name].isNotNull() & compare(x[name])), kind


def _text(value: Typed) -> Column:
    column, kind = value
    if isinstance(kind, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.to_json(column, {"ignoreNullFields": "false"})
    return column.cast("string")


def _pluck(value: Typed, arg: str) -> Typed:
    column, kind = value
    name = arg.strip()
    if not name or not isinstance(kind, T.ArrayType):
        return value
    if isinstance(kind.elementType, T.StructType) and name in kind.elementType.names:
        return F.transform(column, lambda x: x[name]), T.ArrayType(kind.elementType[name].dataType)
    return F.transform(column, lambda _: F.lit(None).cast("string")), T.ArrayType(T.StringType())


def _round(value: Typed, arg: str) -> Typed:
    """Numbers as Python rounds them. A text that is a number is rounded and stays text, as a column has one type."""
    column, kind = value
    if not re.fullmatch(r"\s*-?\d+\s*", arg):
        return value
    places = int(arg)
    rounded = lambda x: py_round(x, places) if 0 <= places <= 22 else x if places > 22 else F.bround(x, places)
    if isinstance(kind, T.StringType):
        number = F.trim(column).try_cast("double")
        return F.coalesce(rounded(number).cast("string"), column), kind
    if not isinstance(kind, _NUMBERS):
        return value
    return rounded(column.cast("double")), T.DoubleType()


def _truncate(value: Typed, arg: str) -> Typed:
    if not re.fullmatch(r"\s*\d+\s*", arg):
        return value
    return F.substring(F.coalesce(_text(value), F.lit("")), 1, int(arg)), T.StringType()


def _join(value: Typed, arg: str) -> Typed:
    column, kind = value
    if not isinstance(kind, T.ArrayType):
        return value
    return F.array_join(F.transform(column, lambda x: _text((x, kind.elementType))), arg or ", "), T.StringType()


def _first(value: Typed, arg: str) -> Typed:
    column, kind = value
    return (F.get(column, F.lit(0)), kind.elementType) if isinstance(kind, T.ArrayType) else value


def _count(value: Typed, arg: str) -> Typed:
    column, kind = value
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.when(column.isNotNull(), F.size(column)), F.lit(0)), T.IntegerType()
    return F.when(column.isNull(), 0).otherwise(1), T.IntegerType()


def truth(value: Typed) -> Column:
    column, kind = value
    if isinstance(kind, T.ArrayType):
        good = F.size(column) > 0
    elif isinstance(kind, T.StringType):
        good = column != ""
    elif isinstance(kind, T.BooleanType):
        good = column
    elif isinstance(kind, _NUMBERS):
        good = column != 0
    else:
        good = column.isNotNull()
    return F.coalesce(good & column.isNotNull(), F.lit(False))


def _map_range(value: Typed, arg: str, compat: str = "documented") -> Typed:
    """Ranges [lo,hi) with labels. A number in none of them stays as text, what is no number stays as it is."""
    column, kind = value
    if isinstance(kind, T.StringType):
        number = column.try_cast("double")
    elif isinstance(kind, _NUMBERS):
        number = column.cast("double")
    else:
        return value
    out = F.when(number.isNull(), _text(value))
    for low, high, label in re.findall(r"\[(\d+),(\d*)\]=([^,]+)", arg) if compat != "observed" else []:
        inside = (number >= float(low)) & ((number < float(high)) if high else F.lit(True))
        out = out.when(inside, label.strip())
    return out.otherwise(_text(value)), T.StringType()


TRANSFORMS: dict[str, Callable[[Typed, str], Typed]] = {
    "pluck": _pluck,
    "round": _round,
    "upper": lambda v, a: (F.upper(_text(v)), T.StringType()),
    "lower": lambda v, a: (F.lower(_text(v)), T.StringType()),
    "truncate": _truncate,
    "join": _join,
    "first": _first,
    "count": _count,
    "bool_from_path": lambda v, a: (truth(v), T.BooleanType()),
    "map_range": _map_range,
}


def register_transform(name: str):
    """Decorator that adds a transform: a function of (column, type) and the argument's text, which returns (column, type)."""

    def add(function):
        TRANSFORMS[name] = function
        return function

    return add


def apply_transform(value: Typed, spec: str | None, compat: str = "documented") -> Typed:
    if not spec:
        return value
    name, _, arg = spec.partition(":")
    if name not in TRANSFORMS:
        raise ConfigError(f"unknown transform {name!r}")
    return _map_range(value, arg, compat) if name == "map_range" else TRANSFORMS[name](value, arg)


def missing(value: Typed) -> Column:
    column, kind = value
    return column.isNull() | (F.size(column) == 0 if isinstance(kind, (T.ArrayType, T.MapType)) else F.lit(False))


def _shown(value: Typed) -> Column:
    """Times as text, as they appear in JSON."""
    column, kind = value
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.concat(iso(column), F.lit("Z"))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[_shown((column[f.name], f.dataType)).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _shown((x, kind.elementType)))
    return column


def full_columns(config: ProjectionConfig, schema: T.StructType) -> dict[str, Column]:
    """The whole record in its fixed order."""
    pick = lambda x, names: F.struct(*[x[n].alias(m) for n, m in names.items()])
    same = lambda *names: {n: n for n in names}
    location = F.when(F.col("location").isNotNull(), pick(F.col("location"), same("city", "region", "country")))
    out = {n: F.col(n) for n in ("candidate_id", "full_name", "emails", "phones")}
    out |= {"location": location, "links": F.col("links"), "headline": F.col("headline"), "years_experience": F.col("years_experience")}
    out["skills"] = F.transform("skills", lambda s: pick(s, same("name", "confidence", "sources", "aliases_seen")))
    out["experience"] = F.transform("experience", lambda e: pick(e, same("company", "title", "start", "end", "is_current", "summary")))
    out["education"] = F.transform("education", lambda e: pick(e, same("institution", "degree") | {"field_of_study": "field", "end_year": "end_year"}))
    if config.confidence:
        out["overall_confidence"] = F.col("overall_confidence")
    if config.provenance:
        out["provenance"] = _shown((F.col("provenance"), schema["provenance"].dataType))
    return out | {"sources_ingested": F.col("sources_ingested"), "pipeline_version": F.col("pipeline_version"), "created_at": F.concat(iso(F.col("created_at")), F.lit("Z"))}


def compile_field(schema: T.StructType, spec: FieldSpec, compat: str = "documented") -> Typed:
    return apply_transform(apply_filter(resolve(schema, spec.source), spec.filter, compat), spec.transform, compat)


class Projection:
    """A configuration compiled against the schema of merged candidates."""

    def __init__(self, schema: T.StructType, config: ProjectionConfig, compat: str = "documented"):
        self.config, self.schema = config, schema
        self.errors: list[Column] = []
        self.tree: dict = {}
        if config.whole:
            self.tree = {k: (v, F.lit(True)) for k, v in full_columns(config, schema).items()}
            return
        self.tree["candidate_id"] = (F.col("candidate_id"), F.lit(True))
        for spec in config.fields:
            value = compile_field(schema, spec, compat)
            policy, gone = spec.missing_policy or config.missing_value_policy, missing(value)
            if spec.required or policy == "error":
                self.errors.append(F.when(gone, F.lit(spec.source)))
                there = F.lit(True)
            else:
                there = ~gone if policy == "omit" else F.lit(True)
            self._put(self.tree, spec.target.split("."), (F.when(~gone, _shown(value)), there))
        if config.provenance:
            self.tree["provenance"] = (_shown((F.col("provenance"), schema["provenance"].dataType)), F.size("provenance") > 0)
        if config.confidence:
            self.tree["overall_confidence"] = (F.col("overall_confidence"), F.lit(True))

    def _put(self, tree: dict, steps: list[str], leaf) -> None:
        if len(steps) == 1:
            tree[steps[0]] = leaf
        else:
            if not isinstance(tree.get(steps[0]), dict):
                tree[steps[0]] = {}
            self._put(tree[steps[0]], steps[1:], leaf)

    def _column(self, node) -> Column:
        return F.struct(*[self._column(v).alias(k) for k, v in node.items()]) if isinstance(node, dict) else node[0]

    def _there(self, node) -> Column:
        """Whether a node shows: a nested object does if one of its fields is not omitted."""
        if not isinstance(node, dict):
            return node[1]
        out = F.lit(False)
        for v in node.values():
            out = out | self._there(v)
        return out

    def _json(self, node) -> Column:
        if not isinstance(node, dict):
            wrapped = F.to_json(F.struct(node[0].alias("v")), {"ignoreNullFields": "false"})
            return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
        parts = [F.when(self._there(v), F.concat(F.lit(f'"{k}":'), self._json(v))) for k, v in node.items()]
        return F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}"))

    def errors_column(self) -> Column:
        """The sources of required fields that are missing."""
        return F.filter(F.array(*self.errors), lambda e: e.isNotNull()) if self.errors else F.array().cast("array<string>")

    def columns(self) -> list[Column]:
        return [self._column(v).alias(k) for k, v in self.tree.items()]

    def json(self) -> Column:
        return self._json(self.tree)


def project(candidates: DataFrame, config: ProjectionConfig, compat: str = "documented") -> DataFrame:
    """The configured view, with _errors (required fields that are missing), _json (the record as JSON text) and _first."""
    view = Projection(candidates.schema, config, compat)
    keep = [F.col("_first")] if "_first" in candidates.columns else []
    return candidates.select(*view.columns(), view.errors_column().alias("_errors"), view.json().alias("_json"), *keep)
