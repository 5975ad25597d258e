"""Scalar column functions (F1-F17).  All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JavaScript Date.toISOString(): UTC, millisecond precision, trailing Z.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def normalise_expression(c: Column) -> Column:
    """collapse whitespace runs to one space and trim; case kept."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalise_definition(c: Column) -> Column:
    """F2 then lower-case, so whitespace/case-only edits compare equal."""
    return F.lower(normalise_expression(c))


def parse_array_literal(c: Column) -> Column:
    """PostgreSQL array text ``{a,b}`` -> array<string>; ``{}`` -> empty array."""
    inner = F.regexp_replace(c, r"^\{|\}$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))


def row_signature(*cols: Column, sep: str = "|") -> Column:
    """fields joined by ``|``; NULL rendered as empty so positions stay fixed."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def composite_key_json(*cols: Column) -> Column:
    """JSON array of the key values (report output only; joins use the columns)."""
    return F.to_json(F.array(*[c.cast("string") for c in cols]))


def iso_timestamp(c: Column) -> Column:
    """``toISOString()`` of a timestamp."""
    return F.date_format(c, ISO_FORMAT)


def join_messages(arr: Column, sep: str = "; ") -> Column:
    """message list joined by ``'; '``."""
    return F.array_join(arr, sep)


def yes_no(c: Column) -> Column:
    """boolean as YES/NO text."""
    return F.when(c, F.lit("YES")).otherwise(F.lit("NO"))


def js_or(*cols: Column) -> Column:
    """F13 ``a || b || c``: first value that is not null, 0, false or ''.  Falsiness goes by
    type: the texts "0" and "false" are true."""
    def truthy(c: Column) -> Column:
        s, text = c.cast("string"), F.typeof(c) == "string"
        return F.when(c.isNull() | (s == "") | (~text & s.isin("0", "false", "0.0")), F.lit(None)).otherwise(c)
    return F.coalesce(*[truthy(c) for c in cols])


def stable_uuid(*cols: Column) -> Column:
    """deterministic v4-shaped uuid from identifying columns, so a retried
    task or a replayed message gets the same id (``uuid()`` would not)."""
    h = F.sha2(F.concat_ws("\u0001", *[c.cast("string") for c in cols]), 256)
    return F.lower(F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4),
        F.concat(F.lit("4"), F.substring(h, 14, 3)),
        F.concat(F.lit("8"), F.substring(h, 18, 3)),
        F.substring(h, 21, 12)))


def same_length(a: Column, b: Column) -> Column:
    """F16: two arrays pair up only when their sizes agree."""
    return F.size(a) == F.size(b)


def coerce_date(c: Column) -> Column:
    """``@Type(() => Date)``; unparsable text -> NULL."""
    return F.try_to_timestamp(c)


def coerce_number(c: Column) -> Column:
    """``@Type(() => Number)``; unparsable text -> NULL."""
    return c.try_cast("double")
