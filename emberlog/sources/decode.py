"""Reading JSON objects strictly, with every costly expression evaluated once per row."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row however often they are used.

    The optimizer copies a projection's expressions into the filters and projections above it.
    It does not look through a generator, so these come out of a one-element `inline`.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def _untyped_text(schema: T.StructType) -> T.StructType:
    """The schema with VARIANT for text, which keeps what kind of JSON value was there."""

    def kind(data_type):
        if isinstance(data_type, T.StructType):
            return _untyped_text(data_type)
        return T.VariantType() if isinstance(data_type, T.StringType) else data_type

    return T.StructType([T.StructField(f.name, kind(f.dataType)) for f in schema.fields])


def _is_text(value: Column) -> Column:
    return value.isNull() | F.schema_of_variant(value).isin("STRING", "VOID")


def _all_text(schema: T.StructType, value: Column) -> list[Column]:
    found = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            found += _all_text(f.dataType, value[f.name])
        elif isinstance(f.dataType, T.StringType):
            found.append(_is_text(value[f.name]))
    return found


def _typed(schema: T.StructType, value: Column) -> Column:
    """The struct with its text as STRING again; null where the struct is."""
    fields = []
    for f in schema.fields:
        inner = value[f.name]
        if isinstance(f.dataType, T.StructType):
            inner = _typed(f.dataType, inner)
        elif isinstance(f.dataType, T.StringType):
            inner = inner.cast("string")
        fields.append(inner.alias(f.name))
    return F.when(value.isNotNull(), F.struct(*fields))


def parse_objects(lines: DataFrame, schema: T.StructType, line: str = "_line") -> DataFrame:
    """Parse one JSON object per line into `_raw`, null for lines that are not one.

    Strict where Spark's reader is not: text fields must hold JSON text, and nothing may
    follow the object. For that the line is read as the only element of a list, where anything
    after it is a syntax error or a second element. A line could close that list itself, so a
    second reading puts the line's own hash behind it in a list: only if that has exactly two
    elements, the second with the hash, is the line one value and no more. Numbers that do not
    fit their type spoil the line too.
    """
    listed = T.ArrayType(_untyped_text(schema))
    outer = T.StructType([T.StructField("_objects", listed), T.StructField("_corrupt", T.StringType())])
    text = F.concat(F.lit('{"_objects":['), F.col(line), F.lit("]}"))
    parsed = F.from_json(text, outer, {"columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select("*", F.inline(F.array(parsed)))
    digest = F.sha2(F.col(line).cast("binary"), 256)
    ended = F.concat(F.lit("["), F.col(line), F.lit(',{"_end":"'), digest, F.lit('"}]'))
    marks = F.from_json(ended, T.ArrayType(T.StructType([T.StructField("_end", T.StringType())])))
    alone = (F.size(marks) == 2) & (F.get(marks, F.lit(1))["_end"] == digest)
    single = F.col("_corrupt").isNull() & (F.size("_objects") == 1) & F.coalesce(alone, F.lit(False))
    rows = once(rows, _object=F.when(single, F.get("_objects", F.lit(0))))
    value = F.col("_object")
    valid = reduce(lambda a, b: a & b, _all_text(schema, value), value.isNotNull())
    return once(rows, _raw=F.when(valid, _typed(schema, value))).drop("_objects", "_corrupt", "_object")
