"""Answers of generators read under a schema, in the JVM: a value, or the reason why there is none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import clean_json, once, text_or_empty

#: What JSON holds for a type of a schema: the start of its name as a variant, and what to call it.
KINDS = {T.StringType: (["STRING"], "text"), T.StructType: (["OBJECT"], "an object"), T.MapType: (["OBJECT"], "an object"), T.BooleanType: (["BOOLEAN"], "true or false")}
WHOLE, NUMBER = (["BIGINT"], "a whole number"), (["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "a number")


def json_kind(of: T.DataType) -> tuple[list[str], str]:
    if isinstance(of, T.ArrayType):
        starts, name = json_kind(of.elementType)
        return [f"ARRAY<{x}" for x in (*starts, "VOID")], f"a list of {name}"
    return KINDS.get(type(of), WHOLE if isinstance(of, T.IntegralType) else NUMBER)


def struct_type(schema: str | T.StructType) -> T.StructType:
    """A schema given as DDL (`struct<...>` or a list of fields)."""
    found = schema if isinstance(schema, T.DataType) else T.DataType.fromDDL(schema)
    if not isinstance(found, T.StructType):
        raise ValueError("an answer's schema is a struct")
    return found


def field_fault(value: Column, field: T.StructField, required: bool) -> Column:
    """What is wrong with a field of a parsed answer, or null. A field that is missing or null is wrong only if it is required."""
    starts, name = json_kind(field.dataType)
    held = F.try_variant_get(value, f"$.{field.name}", "variant")
    none = held.isNull() | F.is_variant_null(held)
    kind = F.schema_of_variant(held)
    fits = kind.startswith(starts[0])
    for start in starts[1:]:
        fits = fits | kind.startswith(start)
    missing = F.lit(f"{field.name} is missing") if required else F.lit(None).cast("string")
    return F.when(none, missing).when(~fits, F.lit(f"{field.name} is not {name}"))


def faults_of(answer: Column, value: Column, fields: T.StructType, required: Sequence[str]) -> Column:
    """faults() of an answer and its parsed value."""
    none = F.lit(None).cast("string")
    whole = F.when(text_or_empty(answer) == "", "empty").when(value.isNull(), "no JSON").when(~F.schema_of_variant(value).startswith("OBJECT"), "not an object")
    return once(whole, lambda w: F.filter(F.array(w, *[F.when(w.isNull(), field_fault(value, f, f.name in required)).otherwise(none) for f in fields.fields]), lambda x: x.isNotNull()))


def faults(answer: Column, schema: str | T.StructType, required: Sequence[str] = ()) -> Column:
    """All that is wrong with an answer, as an array in the schema's order; empty where it fits."""
    return once(F.try_parse_json(clean_json(answer)), lambda value: faults_of(answer, value, struct_type(schema), required))


def reason(wrong: Column) -> Column:
    return F.nullif(F.array_join(wrong, "; "), F.lit(""))


def checked(answer: Column, schema: str | T.StructType, required: Sequence[str] = ()) -> Column:
    """Struct of value and reason: the answer under the schema, or what is wrong with it. Fences, text around an object, control characters
    and trailing commas are no fault; a missing or null field is one only if it is required."""
    fields = struct_type(schema)

    def read(clean: Column) -> Column:
        wrong = once(F.try_parse_json(clean), lambda value: faults_of(answer, value, fields, required))
        return once(wrong, lambda w: F.struct(F.when(F.size(w) == 0, F.from_json(clean, fields)).alias("value"), reason(w).alias("reason")))

    return once(clean_json(answer), read)


def best_effort(answer: Column, schema: str | T.StructType, main: str) -> Column:
    """Struct of value, source and reason, by four ways in turn: `answer`, all fields fit; `partial`, the main field is text and
    fields that don't fit are null; `text`, the answer holds no object and is the main field itself; `none`, there is nothing to use."""
    fields = struct_type(schema)

    def read(clean: Column, value: Column, wrong: Column) -> Column:
        # a field that does not fit is read on its own, so that one wrong type does not spoil its row
        one = lambda f: F.when(field_fault(value, f, False).isNull(), F.from_json(clean, T.StructType([f]))[f.name]).alias(f.name)
        spoken = field_fault(value, fields[main], True).isNull() & (text_or_empty(F.try_variant_get(value, f"$.{main}", "string")) != "")
        plain = F.struct(*[(F.trim(answer) if f.name == main else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields.fields])
        alone = (text_or_empty(answer) != "") & ~F.contains(answer, F.lit("{"))
        source = once(spoken, lambda s: F.when(s & (F.size(wrong) == 0), "answer").when(s, "partial").when(alone, "text").otherwise("none"))

        def got(source: Column) -> Column:
            held = F.when(source == "answer", F.from_json(clean, fields)).when(source == "partial", F.struct(*[one(f) for f in fields.fields])).when(source == "text", plain)
            return F.struct(held.alias("value"), source.alias("source"), reason(wrong).alias("reason"))

        return once(source, got)

    def parsed(clean: Column) -> Column:
        return once(F.try_parse_json(clean), lambda value: once(faults_of(answer, value, fields, [main]), lambda wrong: read(clean, value, wrong)))

    return once(clean_json(answer), parsed)
