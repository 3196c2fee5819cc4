"""Column names: canonical forms, and the roles that names suggest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The name patterns and priorities by which columns get their roles.
JOIN_KEY = re.compile(r"^(id|.*_id|.*_key|key|.*_code|code|sku|.*_ref|ref|.*_number)$", re.IGNORECASE)
MONEY = re.compile(r"amount|price|cost|revenue|total|value", re.IGNORECASE)
DATE = re.compile(r"date|time|timestamp", re.IGNORECASE)
TEXT = re.compile(r"reason|comment|description|note|text|message|support|supplier|issue|delay", re.IGNORECASE)
TREND_DATE = re.compile(r"date|time|timestamp|period", re.IGNORECASE)
NOT_TIME = re.compile(r"overtime|lifetime|parttime|fulltime|timeslast", re.IGNORECASE)
ENTITY_FIRST = (
    "employee_number", "employeenumber", "employee_id", "emp_id", "supplier_id", "order_id", "sku", "warehouse_id",
    "region", "department", "jobrole", "customer_id", "product_id", "entity", "id",
)
TARGET_FIRST = (
    "amount", "revenue", "sales", "monthlyincome", "income", "qty", "quantity", "units", "stock", "inventory",
    "level", "count", "volume", "hike", "rate",
)
TARGET = re.compile(r"amount|revenue|sales|income|qty|quantity|units|stock|inventory|level|count|volume|hike|rate", re.IGNORECASE)
STOCK = ("stock", "inventory", "level")
SNAPSHOT_FIRST = ("department", "region", "jobrole", "segment", "category", "warehouse")
GRAPH_ENTITY = re.compile(
    r"(^id$|_id$|.*_id$|^sku$|^region$|^warehouse|^supplier|^product|^customer|department|jobrole|education|attrition|business"
    r"|field|marital|gender|overtime|joblevel|stock|involvement|satisfaction|environment|relationship|commute|training|role"
    r"|distance|frequency)",
    re.IGNORECASE,
)
# End of fixed values.

NUMBER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
#: Columns that operators add for themselves.
HIDDEN = ("_row_id",)


def canonical(name: str) -> str:
    """Trimmed, lower-cased, white space as an underscore."""
    return re.sub(r"\s+", "_", name.strip().lower())


def key(name: str) -> str:
    """As ``canonical``, hyphens too."""
    return re.sub(r"[\s-]+", "_", name.strip().lower())


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in HIDDEN]


def _of(df: DataFrame, kinds: tuple) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in HIDDEN]


def numeric(df: DataFrame) -> list[str]:
    """Integer and floating columns; neither decimals nor booleans."""
    return _of(df, NUMBER)


def strings(df: DataFrame) -> list[str]:
    return _of(df, (T.StringType,))


def temporal(df: DataFrame) -> list[str]:
    return _of(df, TEMPORAL)
