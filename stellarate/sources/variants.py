"""A landing scan that survives any line: lines as variants, types from one aggregate over them.

Every line is parsed once and kept as a variant. What the columns are is then read off the
parsed lines, and a line that has no place in them goes to the rejects as it stands.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellarate.sources.tables import stored

#: Whole numbers up to this many digits are longs.
LONG_DIGITS = 18
_TOKEN = re.compile(r"`(?:[^`]|``)*`|\b(OBJECT)(?=<)|\b(VOID|VARIANT)\b(?!\s*:)|\bDECIMAL\((\d+),\s*(\d+)\)")


def parsed_variants(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, v): the lines that are not blank, with the JSON object each holds, else null.

    A line is parsed inside brackets, so one that goes on after its object is no object;
    nor is one that has a key twice.
    """
    lines = spark.read.text(path).where("trim(value) != ''")
    whole = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))
    held = lines.select("value", whole.alias("list")).select(
        "value",
        F.expr("try_variant_get(list, '$[0]', 'variant')").alias("v"),
        F.expr("try_variant_get(list, '$[1]', 'variant') is not null").alias("more"),
    )
    single = ~F.col("more") & F.schema_of_variant("v").startswith("OBJECT<")
    return held.select("value", F.when(single, F.col("v")).alias("v"))


def type_of(described: str) -> T.DataType:
    """The column type for a type as variants describe it.

    Whole numbers are long, or decimal beyond; others are double; what is always null, or has no
    one type, is text.
    """

    def spelt(found: re.Match) -> str:
        if found[1]:
            return "STRUCT"
        if found[2]:
            return "STRING"
        if found[3]:
            if int(found[4]):
                return "DOUBLE"
            return "BIGINT" if int(found[3]) <= LONG_DIGITS else "DECIMAL(38,0)"
        return found[0]

    sql = _TOKEN.sub(spelt, described).replace("STRUCT<>", "STRING")
    return T.StructType.fromDDL(f"v {sql}")["v"].dataType


def preferred(names: list[str], known: set[str]) -> str:
    """Of names that differ in case only: the known one, else that with most small letters."""
    return min(names, key=lambda n: (n not in known, -sum(c.islower() for c in n), n))


def settled(
    kind: T.StructType, known: set[str] = frozenset(), path: tuple[str, ...] = ()
) -> tuple[T.StructType, list[tuple[str, ...]]]:
    """The type without names that differ in case only, and the paths of those left out.

    Inside arrays there is no path to look for, so an element with such names becomes text.
    """
    groups: dict[str, list[T.StructField]] = {}
    for f in kind.fields:
        groups.setdefault(f.name.lower(), []).append(f)
    fields, out = [], []
    for held in groups.values():
        name = preferred([f.name for f in held], known)
        out += [(*path, f.name) for f in held if f.name != name]
        own = next(f for f in held if f.name == name).dataType
        if isinstance(own, T.StructType):
            own, more = settled(own, path=(*path, name))
            out += more
        elif isinstance(own, T.ArrayType) and clashes(own.elementType):
            own = T.ArrayType(T.StringType())
        fields.append(T.StructField(name, own))
    return T.StructType(fields), out


def clashes(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return clashes(kind.elementType)
    if not isinstance(kind, T.StructType):
        return False
    names = [f.name.lower() for f in kind.fields]
    return len(set(names)) < len(names) or any(clashes(f.dataType) for f in kind.fields)


def found_schema(lines: DataFrame, known: T.StructType) -> tuple[T.StructType, list[tuple[str, ...]]]:
    """(columns, clashing paths) of parsed lines: one aggregate over what was parsed before.

    Plain columns named in ``known`` have their type from there and come first, in its order.
    """
    described = lines.where("v is not null").agg(F.schema_of_variant_agg("v")).first()[0]
    plain = {f.name: f for f in known.fields if not nested(f.dataType)}
    found = T.StructType([])
    if described and described.startswith("OBJECT<") and described != "OBJECT<>":
        found = type_of(described)
    every = T.StructType([*found.fields, *[f for f in plain.values() if f.name not in found.names]])
    columns, clashing = settled(every, {f.name for f in known.fields})
    named = {f.name: f for f in columns.fields}
    first = [plain.get(f.name, named.get(f.name, f)) for f in known.fields]
    order = {f.name for f in first}
    return T.StructType([*first, *[f for f in columns.fields if f.name not in order]]), clashing


def nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def value_at(path: tuple[str, ...], kind: str = "variant") -> Column:
    """What stands at a path of keys, as ``kind``; null if nothing does, or nothing of that type."""
    if not any(set(name) & set("'\"\\[]") for name in path):
        steps = "".join(f"['{name}']" for name in path)
        return F.try_variant_get(F.col("v"), F.lit(f"${steps}"), kind)
    # a path cannot spell such names, but a map of variants has them
    found = F.col("v")
    for name in path:
        fields = F.try_variant_get(found, F.lit("$"), "map<string,variant>")
        found = F.try_element_at(fields, F.lit(name))
    return F.try_variant_get(found, F.lit("$"), kind)


def column_value(field: T.StructField) -> tuple[Column, Column]:
    """(value, lost): a column of a parsed line, and whether its type cannot hold what is there."""
    path = (field.name,)
    kind = field.dataType
    value = value_at(path, kind.simpleString())
    there = value_at(path)
    held = there.isNotNull() & ~F.is_variant_null(there)
    lost = held & value.isNull()
    described = F.schema_of_variant(there)
    if isinstance(kind, T.NumericType):
        # text that happens to be a number is no number
        lost = lost | (held & ~described.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        # a fraction would be cut off
        lost = lost | (held & (value_at(path, "decimal(38,18)") != value))
    if isinstance(kind, T.BooleanType):
        lost = lost | (held & (described != "BOOLEAN"))
    return value, F.coalesce(lost, F.lit(False))


def variant_lines(
    spark: SparkSession, path: str | list[str], known: T.StructType, scratch: str
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a JSON-lines table with all its columns and nested fields.

    The parsed lines are written to ``scratch``, and everything else starts from there. To
    the rejects, column ``line``, go lines that are no single JSON object, have a key twice,
    have a key that differs from a column's name in case only, or have a value that the
    type given in ``known`` cannot hold. All other lines are rows; a key that a line lacks is null.
    """
    lines = stored(parsed_variants(spark, path), scratch)
    columns, clashing = found_schema(lines, known)
    pairs = {f.name: column_value(f) for f in columns.fields}
    bad = [F.col("v").isNull(), *[lost for _, lost in pairs.values()]]
    bad += [value_at(p).isNotNull() for p in clashing]
    broken = F.coalesce(reduce(or_, bad), F.lit(True))
    rows = lines.where(~broken).select(*[value.alias(name) for name, (value, _) in pairs.items()])
    return rows, lines.where(broken).select(F.col("value").alias("line"))

