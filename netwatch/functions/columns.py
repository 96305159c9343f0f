"""Small column helpers used across operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import SEVERITY_ALIASES


def literal_map(values: Mapping[str, object]) -> Column:
    """A constant map column; use only for lookup tables of fixed, small size."""
    parts: list[Column] = []
    for key, value in values.items():
        parts.append(F.lit(key))
        if isinstance(value, (list, tuple)):
            parts.append(F.array(*[F.lit(v) for v in value]))
        else:
            parts.append(F.lit(value))
    return F.create_map(*parts)


def lookup(values: Mapping[str, object], key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(values), key), default)


def fill_features(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Missing or null features count as zero."""
    present, wanted = set(df.columns), list(names)
    return df.selectExpr(
        *[f"coalesce(`{c}`, 0) AS `{c}`" if c in wanted else f"`{c}`" for c in df.columns],
        *[f"0.0D AS `{n}`" for n in wanted if n not in present])


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def normalise_severity(severity: Column) -> Column:
    return lookup(SEVERITY_ALIASES, F.lower(severity), F.lit("warning"))


def title_case(text: Column) -> Column:
    """Capitalise each run of letters, the rest of the run in lower case."""
    return F.initcap(F.lower(text))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def sql_quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def round_binary(x: str, digits: int) -> str:
    """SQL text rounding a double to a few decimals, for up to 2 of them by its exact binary value.

    ``round``/``bround`` look at the shortest decimal form, so 16.275 (stored slightly below) would
    round up. Only such apparent ties need care: the distance to the tie is summed from two exact
    products (the value split at float precision), so its sign is right.
    """
    if digits not in (1, 2):
        return f"bround({x}, {digits})"
    unit = 10 ** (digits + 1)
    tie = f"rint({x} * {unit})"
    coarse = f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
    off = f"sign(({coarse} * {unit} - {tie}) + ({x} - {coarse}) * {unit})"
    return (f"IF(abs({tie}) % 10 = 5 AND {tie} / {unit} = {x} AND {off} <> 0, "
            f"({tie} + 5 * {off}) / {unit}, bround({x}, {digits}))")
