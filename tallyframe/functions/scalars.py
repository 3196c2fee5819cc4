"""Column functions. All are built-in expressions, and lenient: what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day first before month first, as in year-month-day, d/m/y, m/d/y, d-m-y, m-d-y; one or two digits.
DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy")


def currency(c: Column) -> Column:
    """Text such as ``$1,234.50`` as double."""
    return F.trim(F.regexp_replace(c.cast("string"), "[$,]", "")).try_cast("double")


def lenient_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first of the formats that reads the trimmed text."""
    text = F.trim(c.cast("string"))
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def graph_id(column: str, c: Column) -> Column:
    """``prefix:value``, safe as a node's name."""
    prefix = column.lower().replace(" ", "_").removesuffix("_id")
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.regexp_replace(F.trim(c.cast("string")), r"(?U)[^\w.-]+", "_"), 1, 64))


def label_of(node: Column) -> Column:
    """What follows the first colon, or all."""
    return F.when(F.instr(node, ":") > 0, F.substring(node, F.instr(node, ":") + 1, F.length(node))).otherwise(node)


def type_of(node: Column) -> Column:
    return F.when(F.instr(node, ":") > 0, F.substring_index(node, ":", 1)).otherwise("entity")


def severity(score: Column) -> Column:
    return F.when(score >= 0.85, "critical").when(score >= 0.65, "high").when(score >= 0.4, "medium").otherwise("low")


def impact(score: Column, lift_pct: Column) -> Column:
    return F.when((score >= 1.0) | (F.abs(F.coalesce(lift_pct, F.lit(0.0))) >= 30), "high").when(score < 0.15, "low").otherwise("medium")


def direction(change_pct: Column) -> Column:
    return F.when(change_pct > 5, "up").when(change_pct < -5, "down").otherwise("flat")


def change_pct(first: Column, last: Column) -> Column:
    return F.when(first == 0, 0.0).otherwise((last - first) / first * 100)


def week(c: Column) -> Column:
    """The Monday of the week."""
    return F.trunc(c.cast("date"), "week")


def length(c: Column) -> Column:
    return F.coalesce(F.char_length(c.cast("string")), F.lit(0))


def shown(c: Column) -> Column:
    """As text, null as ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))
