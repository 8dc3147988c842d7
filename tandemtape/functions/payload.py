"""Typed access to JSON payloads held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Times as most feeds write them, which the cast reads as they are.
_PLAIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"
# Any number of fraction digits, of which six count; zones as Z, +hh, +hhmm, +hh:mm, or with seconds.
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)$"


# How the text of a JSON object begins; telling it by the parsed value would name the types of all its fields.
OBJECT = r"^[ \t\n\r]*\{"


def parsed(text: Column) -> Column:
    """The payload, or null when the text is not exactly one JSON value (a plain parse would ignore what follows)."""
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    many = F.try_variant_get(boxed, "$[1]", "variant")
    return F.when(many.isNull(), F.try_variant_get(boxed, "$[0]", "variant"))


def part(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID; null when absent."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def text_of(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "string")


def has_text(value: Column, name: str) -> Column:
    """A required string: present, a string, not empty."""
    return F.coalesce((F.schema_of_variant(part(value, name)) == "STRING") & (text_of(value, name) != ""), F.lit(False))


def _matches(value: Column, name: str, pattern: str) -> Column:
    return F.coalesce(text_of(value, name).rlike(pattern), F.lit(False))


# The text of a boolean, an object or an array is never a number or a time, so the patterns below decide the kind as well.
_EXPONENT = r"([eE][+-]?\d+)?\s*$"
_POSITIVE = r"^\s*\+?(?=[0.]*[1-9])(\d+(\.\d*)?|\.\d+)" + _EXPONENT
_NOT_NEGATIVE = r"^\s*(\+?(\d+(\.\d*)?|\.\d+)|-(0+(\.0*)?|\.0+))" + _EXPONENT


def has_positive(value: Column, name: str) -> Column:
    """A number above zero as an integer, float or numeric string, however wide or small it is."""
    return _matches(value, name, _POSITIVE)


def has_not_negative(value: Column, name: str) -> Column:
    """A number of zero or more as an integer, float or numeric string."""
    return _matches(value, name, _NOT_NEGATIVE)


def has_id(value: Column, name: str) -> Column:
    """An integer or a non-empty string; booleans and fractions are refused."""
    return _matches(value, name, r"^-?\d+$") | has_text(value, name)


def has_time(value: Column, name: str) -> Column:
    """An RFC 3339 text with a zone."""
    return _matches(value, name, _RFC3339) & time_of(value, name).isNotNull()


def instant(text: Column) -> Column:
    """The time to the microsecond below it; null when it is none."""
    cut = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    cut = F.regexp_replace(cut, r"([T ]\d{2}:\d{2})(Z|[+-]\d)", "$1:00$2")
    whole = F.regexp_replace(cut, r"([+-]\d{2})$", "$1:00")
    whole = F.regexp_replace(whole, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(_PLAIN), text).otherwise(whole).try_cast("timestamp")


def time_of(value: Column, name: str) -> Column:
    return instant(text_of(value, name))


def number_of(value: Column, name: str) -> Column:
    """Exact number for comparisons; null when the text is no number or too wide."""
    return text_of(value, name).try_cast("decimal(38,18)")
