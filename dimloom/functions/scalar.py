"""Scalar expressions whose meaning differs between databases, as built-in column functions.

Everything here stays inside the JVM: no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def concat_skip_null(*cols: Column) -> Column:
    """CONCAT of databases that read NULL as the empty string."""
    return F.concat(*[F.coalesce(c, F.lit("")) for c in cols])


def date_key(col: str | Column) -> Column:
    """A date as the integer YYYYMMDD, by arithmetic rather than by formatting text."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def month_key(col: str | Column) -> Column:
    """The first day of the month as YYYYMMDD."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.year(c) * 10000 + F.month(c) * 100 + 1).cast("int")


def length_no_trailing_blanks(col: Column) -> Column:
    """LEN() where trailing blanks do not count."""
    return F.length(F.rtrim(col))


def left_pad(col: Column, width: int, pad: str = "0") -> Column:
    """RIGHT('000' + x, n): pad on the left and keep the last ``width`` characters."""
    return F.right(F.concat(F.lit(pad * width), col.cast("string")), F.lit(width))


def after_separator(col: Column, separator: str, width: int) -> Column:
    """SUBSTRING(x, CHARINDEX(sep, x) + 1, n): whole text when the separator is absent."""
    return F.substring(col, F.locate(separator, col) + 1, F.lit(width))


def decode(col: Column, pairs: Sequence[tuple[object, object]], default: object = None) -> Column:
    """DECODE: like CASE, but NULL matches NULL."""
    out = None
    for match, value in pairs:
        cond = col.eqNullSafe(F.lit(match))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return F.lit(default) if out is None else out.otherwise(default)


def empty_as_null(col: Column) -> Column:
    """The dialect rule that the empty string is NULL."""
    return F.nullif(col, F.lit(""))


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates, NULL when the divisor is 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint")))


def safe_ratio(num: Column, den: Column, places: int, default: object = 0) -> Column:
    """num / den rounded half up, or ``default`` when the divisor is not positive."""
    return F.when(den > 0, F.round(num / F.nullif(den, F.lit(0)), places)).otherwise(F.lit(default))


def canonical_text(col: Column) -> Column:
    """Trimmed, lower-cased text with each run of white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))


def row_hash(cols: Sequence[str]) -> Column:
    """SHA-256 over the canonical text of the columns; NULL differs from ''."""
    parts = [F.coalesce(canonical_text(F.col(f"`{c}`").cast("string")), F.lit("\\N")) for c in cols]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def exact_key(cols: Sequence[str]) -> Column:
    """The columns' values in one text that no other values give: each with its length, null apart from ''."""
    parts = []
    for c in cols:
        text = F.col(f"`{c}`").cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts) if parts else F.lit("")


def exact_hash(cols: Sequence[str]) -> Column:
    """SHA-256 over the values as they are: case, white space and the place of a null count."""
    return F.sha2(exact_key(cols), 256)


def hex_text(col: Column) -> Column:
    """Bytes as lower-case hexadecimal text."""
    return F.lower(F.hex(col))


def changed(pairs: Sequence[tuple[Column, Column]], mode: str = "null_safe",
            sentinels: Sequence[object] | None = None) -> Column:
    """Has any attribute changed?

    ``null_safe`` compares exactly. ``sentinel`` replaces NULL first, so a NULL and
    a value equal to the sentinel count as the same. ``plain`` is bare ``<>``: a NULL
    on either side never counts as a change.
    """
    if mode not in ("null_safe", "sentinel", "plain"):
        raise ValueError(f"unknown change mode {mode}")
    out = F.lit(False)
    for i, (old, new) in enumerate(pairs):
        if mode == "null_safe":
            diff = ~old.eqNullSafe(new)
        elif mode == "plain":
            diff = F.coalesce(old != new, F.lit(False))
        else:
            stand_in = F.lit((sentinels or [""] * len(pairs))[i])
            diff = F.coalesce(old, stand_in) != F.coalesce(new, stand_in)
        out = out | diff
    return out


def trend(current: Column, previous: Column) -> Column:
    """First / Growth / Decline / Stable against the previous value."""
    return (
        F.when(previous.isNull(), "First")
        .when(current > previous, "Growth")
        .when(current < previous, "Decline")
        .otherwise("Stable")
    )


def growth_pct(current: Column, previous: Column) -> Column:
    """Growth over the previous value in percent, 4 places, NULL without a positive base."""
    return F.when(previous > 0, F.round((current - previous) / F.nullif(previous, F.lit(0)) * 100, 4))


def register_functions(spark: SparkSession) -> None:
    """SQL functions that Catalyst inlines, so calling one costs no Python."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION format_name(name STRING) RETURNS STRING RETURN upper(name)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION region_code(nation INT) RETURNS INT "
        "RETURN CAST(pmod(nation, 5) AS INT)"
    )
