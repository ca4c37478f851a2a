"""JSON texts against a JSON schema, in column functions only: every fault as a row, none for a valid text.

Keywords: type, const, enum, minimum, maximum, minLength, maxLength, pattern, minItems, maxItems, uniqueItems, items, required, properties,
additionalProperties, and $ref to a place of the same schema or of another given one, which may not lead back to itself. Lengths count UTF-16 units.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = "array<struct<path:string,reason:string>>"
_MAX_INTEGER = float((1 << 53) - 1)


def _kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    names = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    found = F.lit("number")
    for start, name in names.items():
        found = F.when(shape.startswith(start), name).otherwise(found)
    return found


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.flatten(F.transform(F.array(value), body))


def _where_there(value: Column, body) -> Column:
    """``body`` of a value that isn't SQL's null; else no faults."""
    return _let(value, lambda x: F.when(x.isNotNull(), body(x)).otherwise(F.array().cast(_NONE)))


def _found(bad: Column, at: Column, reason: str) -> Column:
    one = F.array(F.struct(F.when(at == "", "$").otherwise(at).alias("path"), F.lit(reason).alias("reason")))
    return F.when(bad, one).otherwise(F.array().cast(_NONE))


def _member(at: Column, key: Column) -> Column:
    """Where a member of an object is: names after a point, other keys quoted in brackets."""
    named = F.concat(at, F.when(at == "", "").otherwise("."), key)
    return F.when(key.rlike("^[A-Za-z_$][A-Za-z0-9_$]*\\z"), named).otherwise(F.concat(at, F.to_json(F.array(key))))


def _pattern(text: str) -> str:
    """$ is the very end of a text in a schema, but not in Java."""
    return re.sub(r"\\.|\[(?:\\.|[^\]])*\]|\$", lambda m: r"\z" if m[0] == "$" else m[0], text)


class _Schemas:
    """The schema that references without a name mean, and the others by name."""

    def __init__(self, own: dict, others: dict[str, dict]):
        self.own, self.others = own, others

    def resolved(self, rule: dict, seen: tuple = ()) -> list[tuple[dict, _Schemas]]:
        """A rule and all that it refers to, each with the schemas that its own references mean."""
        if "$ref" not in rule:
            return [(rule, self)]
        name, _, place = rule["$ref"].partition("#")
        if name and name not in self.others:
            raise ValueError(f"no schema is given for {rule['$ref']}")
        root = _Schemas(self.others[name], self.others) if name else self
        if (id(root.own), place) in seen:
            raise ValueError(f"schema refers to itself: {rule['$ref']}")
        target = root.own
        for part in place.strip("/").split("/") if place.strip("/") else []:
            target = target[part.replace("~1", "/").replace("~0", "~")]
        return [(rule, self), *root.resolved(target, (*seen, (id(root.own), place)))]


def _equals(value: Column, kind: Column, fixed) -> Column:
    if fixed is None:
        return kind == "null"
    name, cast = ("boolean", "boolean") if isinstance(fixed, bool) else ("string", "string") if isinstance(fixed, str) else ("number", "double")
    return (kind == name) & F.coalesce(F.try_variant_get(value, "$", cast) == F.lit(fixed), F.lit(False))


def _is_type(value: Column, kind: Column, name: str) -> Column:
    if name != "integer":
        return kind == name
    number = F.try_variant_get(value, "$", "double")
    return (kind == "number") & F.coalesce((number == F.floor(number)) & (F.abs(number) <= _MAX_INTEGER), F.lit(False))


def _scalars(value: Column, kind: Column, rule: dict, at: Column) -> list[Column]:
    out = []
    if "const" in rule:
        out.append(_found(~_equals(value, kind, rule["const"]), at, "const"))
    if "enum" in rule:
        out.append(_found(~F.exists(F.array(*[_equals(value, kind, x) for x in rule["enum"]]), lambda x: x), at, "enum"))
    if "type" in rule:
        names = [rule["type"]] if isinstance(rule["type"], str) else rule["type"]
        out.append(_found(~F.exists(F.array(*[_is_type(value, kind, n) for n in names]), lambda x: x), at, "type"))
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    tests = {
        "minimum": ("number", lambda x: number < x), "maximum": ("number", lambda x: number > x), "minLength": ("string", lambda x: units < x),
        "maxLength": ("string", lambda x: units > x), "pattern": ("string", lambda x: ~text.rlike(_pattern(x))),
    }
    return out + [_found((kind == of) & test(rule[name]), at, name) for name, (of, test) in tests.items() if name in rule]


def _items(items: Column, rule: dict, at: Column, root: _Schemas) -> list[Column]:
    place = lambda i: F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))
    out = []
    if "minItems" in rule:
        out.append(_found(F.size(items) < rule["minItems"], at, "minItems"))
    if "maxItems" in rule:
        out.append(_found(F.size(items) > rule["maxItems"], at, "maxItems"))
    if rule.get("uniqueItems"):
        again = lambda texts: F.flatten(F.transform(texts, lambda x, i: _found(F.array_position(texts, x) <= i, place(i), "uniqueItems")))
        out.append(_let(F.transform(items, lambda x: F.to_json(x)), again))
    if "items" in rule:
        out.append(F.flatten(F.transform(items, lambda x, i: _faults(x, rule["items"], place(i), root))))
    return out


def _members(members: Column, rule: dict, at: Column, root: _Schemas) -> list[Column]:
    known = rule.get("properties", {})
    out = [_found(F.try_element_at(members, F.lit(k)).isNull(), _member(at, F.lit(k)), "required") for k in rule.get("required", [])]
    for key, own in known.items():
        inside = partial(_faults, rule=own, at=_member(at, F.lit(key)), root=root)
        out.append(_where_there(F.try_element_at(members, F.lit(key)), inside))
    more = rule.get("additionalProperties", True)
    others = F.filter(F.map_entries(members), lambda e: ~e["key"].isin(list(known)))
    if more is False:
        out.append(F.flatten(F.transform(others, lambda e: _found(F.lit(True), _member(at, e["key"]), "additionalProperties"))))
    elif isinstance(more, dict):
        out.append(F.flatten(F.transform(others, lambda e: _faults(e["value"], more, F.concat(at, F.to_json(F.array(e["key"]))), root))))
    return out


def _all(parts, value: Column, **of) -> Column:
    return F.concat(F.array().cast(_NONE), *parts(value, **of))


def _faults(value: Column, rule: dict, at: Column, root: _Schemas) -> Column:
    def of_kind(kind: Column) -> Column:
        out = [F.array().cast(_NONE)]
        for own, of_own in root.resolved(rule):
            out += _scalars(value, kind, own, at)
            if {"items", "minItems", "maxItems", "uniqueItems"} & own.keys():
                items = F.when(kind == "array", F.try_variant_get(value, "$", "array<variant>"))
                out.append(_where_there(items, partial(_all, _items, rule=own, at=at, root=of_own)))
            if {"properties", "required", "additionalProperties"} & own.keys():
                members = F.when(kind == "object", F.try_variant_get(value, "$", "map<string,variant>"))
                out.append(_where_there(members, partial(_all, _members, rule=own, at=at, root=of_own)))
        return F.concat(*out)

    return _let(_kind(value), of_kind)


def schema_faults(rows: DataFrame, text: str, schema: dict, others: dict[str, dict] | None = None) -> DataFrame:
    """(all other columns, path, reason: the keyword that is violated) for every fault of a row's JSON ``text``. A null or broken text, or one that repeats a key, has the one reason 'json'.
    ``others``: schemas that a $ref names before its #; their own references without a name are to places of themselves."""
    key = [c for c in rows.columns if c != text]
    value = rows.select(*key, F.try_parse_json(text).alias("_value"))
    broken = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("reason")))
    found = F.when(F.col("_value").isNull(), broken).otherwise(_faults(F.col("_value"), schema, F.lit(""), _Schemas(schema, others or {})))
    return value.select(*key, F.explode(found).alias("_x")).select(*key, "_x.path", "_x.reason")
