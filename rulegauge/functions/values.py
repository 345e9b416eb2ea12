"""Scalar helpers on dynamic payloads, dates and text. All return Column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MICROS = 1_000_000

# ---- typing of VARIANT values --------------------------------------------------------

_KINDS = {
    "VOID": "null", "BOOLEAN": "bool", "STRING": "string", "ARRAY": "array", "OBJECT": "object",
    **dict.fromkeys(("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL"), "number"),
}
# What a float parser accepts: underscores between digits, exponent, inf and nan.
_FLOAT_TEXT = r"(?i)^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)$"


def kind(v: Column) -> Column:
    """absent, null, bool, number, string, array, object or other. The type text is looked at once."""
    head = F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    names = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, head), F.when(v.isNull(), "absent").otherwise("other"))


def as_double(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def number_or_null(v: Column) -> Column:
    """The value of a JSON number; booleans, strings and the rest give NULL."""
    return F.when(kind(v) == "number", as_double(v))


def number_or_bool(v: Column) -> Column:
    """As :func:`number_or_null`, but a boolean counts as 1 or 0."""
    return F.when(kind(v).isin("number", "bool"), as_double(v))


def parse_float(v: Column, k: Column | None = None) -> Column:
    """Numbers, booleans and numeric text as DOUBLE; NULL where parsing fails. ``k`` is ``kind(v)`` if known."""
    k = kind(v) if k is None else k
    text = F.regexp_replace(as_text(v), r"^(?U)\s+|(?U)\s+$", "")
    plain = F.regexp_replace(text, "_", "")
    parsed = F.when(F.lower(plain).rlike(r"^[+-]?inf"), F.when(plain.startswith("-"), float("-inf"))
                    .otherwise(float("inf"))) \
        .when(F.lower(plain).rlike(r"^[+-]?nan"), float("nan")) \
        .otherwise(plain.try_cast("double"))
    return (
        F.when(k.isin("number", "bool"), as_double(v))
        .when((k == "string") & text.rlike(_FLOAT_TEXT), parsed)
    )


def value_key(v: Column, k: Column | None = None, n: Column | None = None) -> Column:
    """Text that is equal for values that compare equal: 85 and 85.0, true and 1, not "85".

    ``k`` is ``kind(v)``, ``n`` is ``as_double(v)`` of numbers and booleans, if known."""
    k = kind(v) if k is None else k
    n = as_double(v) if n is None else n
    return (
        F.when(k.isin("number", "bool"), F.concat(F.lit("n:"), (n + F.lit(0.0)).cast("string")))
        .when(k == "string", F.concat(F.lit("s:"), as_text(v)))
        .when(k.isin("array", "object", "null"), F.concat(F.lit("j:"), F.to_json(v)))
    )


def list_keys(v: Column) -> Column:
    """``value_key`` of every element of a VARIANT array."""
    return F.transform(F.try_variant_get(v, F.lit("$"), "array<variant>"), lambda x: value_key(x))


# ---- paths ----------------------------------------------------------------------------

_UNQUOTABLE = r"[\"'\\\[\]]"


def json_path(path: Column) -> Column:
    """Dotted path text to a JSON path, for keys without quotes, brackets and backslashes."""
    return F.concat(F.lit('$["'), F.replace(path, F.lit("."), F.lit('"]["')), F.lit('"]'))


def _field(v: Column, key: Column) -> Column:
    """Value of a key, found by comparing and not by a path built from it: any text is a key."""
    return F.try_element_at(F.try_variant_get(v, F.lit("$"), "map<string,variant>"), key)


def lookup(v: Column, path: Column) -> Column:
    """Walk a dotted path; NULL where a step is missing; an empty path is the object itself."""
    walked = F.aggregate(F.split(path, r"\."), v, lambda at, key: _field(at, key))
    return (F.when(F.coalesce(path, F.lit("")) == "", v).when(path.rlike(_UNQUOTABLE), walked)
            .otherwise(F.try_variant_get(v, json_path(path), "variant")))


def flat_key(v: Column, key: Column) -> Column:
    """Value of one top-level key, dots in the key taken literally."""
    return F.when(key.rlike(_UNQUOTABLE), _field(v, key)).otherwise(
        F.try_variant_get(v, F.concat(F.lit('$["'), key, F.lit('"]')), "variant"))


def split_value(v: Column) -> Column:
    """``{value, unit}`` objects give their ``value``; anything else is its own value."""
    return F.coalesce(F.try_variant_get(v, F.lit("$.value"), "variant"), v)


def split_unit(v: Column) -> Column:
    inner = F.try_variant_get(v, F.lit("$.value"), "variant")
    return F.when(inner.isNotNull(), F.try_variant_get(v, F.lit("$.unit"), "string"))


# ---- text -----------------------------------------------------------------------------

def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def normalize_subject(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " ")


def slug(text: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(text), r"[^a-z0-9._-]+", ".")
    trimmed = F.regexp_replace(cleaned, r"^\.+|\.+$", "")
    return F.when(trimmed == "", "unknown").otherwise(trimmed)


def float_text(x: Column) -> Column:
    """Shortest decimal text of a DOUBLE: 85.0, 0.0001, 12345678.9, 1e+20, 1.5e-07."""
    raw = x.cast("string")
    size = F.abs(x)
    wide = F.regexp_replace(F.regexp_replace(raw.cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.split_part(raw, F.lit("E"), F.lit(1)), r"\.0$", "")
    exponent = F.split_part(raw, F.lit("E"), F.lit(2))
    digits = F.regexp_replace(exponent, "^-", "")
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    sign = F.when(exponent.startswith("-"), "-").otherwise("+")
    return (
        F.when(F.isnan(x), "nan")
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when(~raw.contains("E"), raw)
        .when((size >= 1e-4) & (size < 1e16), wide)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, padded))
    )


# ---- dates ----------------------------------------------------------------------------

_ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
_ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$"


def parse_iso(text: Column) -> Column:
    """ISO date or date-time to TIMESTAMP; a bare date is midnight UTC; NULL if unreadable."""
    return F.when(text.rlike(_ISO_DATE) | text.rlike(_ISO_DATETIME), F.try_to_timestamp(text))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def iso_text(ts: Column) -> Column:
    """UTC ISO text with microseconds, ``2024-01-01T00:00:07.179575+00:00``."""
    return F.concat(F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


# ---- canonical JSON and hashes ----------------------------------------------------------

def canonical_json(v: Column) -> Column:
    """Sorted keys, compact, numbers in shortest form (``85.0`` becomes ``85``)."""
    return F.to_json(v)


@F.pandas_udf(StringType())
def canonical_json_exact(texts: pd.Series) -> pd.Series:
    """Canonical JSON that keeps each number as written in the source (``85.0`` stays)."""
    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None
    return texts.map(one)


def struct_json(*cols: Column) -> Column:
    """Compact JSON of named columns in the given order, nulls kept, control escapes lower case."""
    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return _lower_control_escapes(text)


def _lower_control_escapes(text: Column) -> Column:
    fixed = text
    for code in (0x0B, *range(0x0E, 0x10), *range(0x1A, 0x20)):
        # an odd backslash starts an escape; an escaped backslash before "u" does not
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    return F.when(text.rlike(r"\\u00[01][A-F]"), fixed).otherwise(text)
