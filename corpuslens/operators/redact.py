"""Removing secrets from text and maps, and cutting documents into sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.constants import ONBOARD_MARKERS, SECRET_KEY_PARTS

# A run of 20 or more key characters that starts and ends at an ASCII word boundary.
KEY_RUN = (
    r"(?:(?<=^|[^A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?=[.-]))"
    r"([A-Za-z0-9_.-]{4})[A-Za-z0-9_.-]{12,}([A-Za-z0-9_.-]{4})"
    r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<=[.-])(?=[A-Za-z0-9_]))"
)


CANDIDATE = r"[A-Za-z0-9_.-]{20}"  # cheap test that rules most texts out


def redact(text: Column) -> Column:
    """Keep the first and last four characters of every key-shaped run."""
    return F.when(text.rlike(CANDIDATE), F.regexp_replace(text, KEY_RUN, "$1...$2")).otherwise(text)


def redact_text(df: DataFrame, column: str) -> DataFrame:
    """``column`` redacted, plus the number of runs found per row."""
    c = F.col(column)
    hits = F.when(c.rlike(CANDIDATE), F.regexp_count(c, F.lit(KEY_RUN))).otherwise(0).cast("int")
    return df.withColumn("hits", hits).withColumn(column, redact(c))


def redact_map(df: DataFrame, column: str) -> DataFrame:
    """Blank the values whose key sounds like a credential."""
    secret = "|".join(SECRET_KEY_PARTS)
    return df.withColumn(
        column, F.transform_values(column, lambda k, v: F.when(F.lower(k).rlike(secret), "[REDACTED]").otherwise(v))
    )


def _blanked(value: Column, kind: T.DataType) -> Column:
    """``value`` with every entry blanked, at any depth, whose name sounds like a credential."""
    secret = lambda name: F.lower(name).rlike("|".join(SECRET_KEY_PARTS))
    if isinstance(kind, T.StructType):
        parts = [
            (F.lit("[REDACTED]") if any(s in f.name.lower() for s in SECRET_KEY_PARTS) else _blanked(value.getField(f.name), f.dataType))
            .alias(f.name)
            for f in kind
        ]
        return F.when(value.isNotNull(), F.struct(*parts)) if parts else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _blanked(v, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if isinstance(kind.valueType, (T.StructType, T.ArrayType, T.MapType)):
            return F.transform_values(value, lambda k, v: F.when(~secret(k), _blanked(v, kind.valueType)))
        return F.transform_values(value, lambda k, v: F.when(secret(k), F.lit("[REDACTED]")).otherwise(v.cast("string")))
    return value


def redact_nested(df: DataFrame, column: str) -> DataFrame:
    """Credentials blanked in structs, arrays and maps of any depth; the name of ``column`` itself does not count.

    A blanked field is text whatever it was, NULL included. Plain map values become text; a blanked
    entry of a map of structs, arrays or maps keeps its key with a NULL. NULL containers stay NULL.
    """
    return df.withColumn(column, _blanked(F.col(column), df.schema[column].dataType))


def redact_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The same for JSON text of a known ``schema``; text that is no such JSON becomes NULL rather than shown."""
    parsed = df.withColumn(column, F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return redact_nested(parsed, column).withColumn(column, F.to_json(column, {"ignoreNullFields": "false"}))


def split_sections(docs: DataFrame, text: str = "text", markers: list[str] | None = None) -> DataFrame:
    """One row per marker that occurs: from it to the next later-listed marker found after it."""
    markers = markers or ONBOARD_MARKERS
    body = F.col(text)
    length = F.length(body)
    parts = []
    for i, m in enumerate(markers):
        start = F.locate(m, body)
        end = length + 1
        for later in reversed(markers[i + 1 :]):
            pos = F.instr(F.substring(body, start + 1, length), F.lit(later))
            end = F.when(pos > 0, start + pos).otherwise(end)
        piece = F.regexp_replace(F.substring(body, start, end - start), r"^\s+|\s+$", "")
        parts.append(F.when(start > 0, F.struct(F.lit(m).alias("marker"), piece.alias("section"))))
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.inline(F.filter(F.array(*parts), lambda p: p.isNotNull())))
