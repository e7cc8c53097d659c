"""Canonical JSON of nested columns: sorted keys, no white space, so equal values have equal texts and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, MapType, StringType, StructType


def _quoted(text: Column) -> Column:
    """A string as JSON; what lies beyond ASCII stays as it is."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def canonical_json(value: Column, kind: DataType) -> Column:
    """A value of type ``kind`` as JSON text; nulls, also of whole structs, are ``null``.

    Structs and maps go by sorted names.  Numbers are integers: fractions have
    no one text, so they are refused.
    """
    if isinstance(kind, StringType):
        text = _quoted(value)
    elif isinstance(kind, BooleanType | IntegralType):
        text = value.cast("string")
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), canonical_json(value[f.name], f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        entries = F.array_sort(F.transform(F.map_keys(value), lambda k: F.struct(k.alias("k"), value[k].alias("v"))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_quoted(e["k"]), F.lit(":"), canonical_json(e["v"], kind.valueType))), ","), F.lit("}"))
    else:
        raise TypeError(f"no canonical text for {kind.simpleString()}")
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def identity(value: Column, kind: DataType, version: str) -> Column:
    """SHA-256 of a version name, a zero byte and the canonical JSON of a value."""
    return F.sha2(F.concat(F.lit(version), F.lit("\0"), canonical_json(value, kind)).cast("binary"), 256)
