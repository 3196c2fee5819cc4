"""Messy files to DataFrames: sniffed encodings and delimiters, JSON of several shapes, numbers inferred and dates left as text.

Paths go through Hadoop's file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import csv
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.names import quoted
from tallyframe.operators.cleaning import with_row_id

# What is tried, in this order.
ENCODINGS = ("utf-8-sig", "utf-8", "latin-1")
DELIMITERS = ",;\t|"
SUFFIXES = (".csv", ".json", ".jsonl", ".ndjson", ".parquet")
ENVELOPES = ("data", "records", "items", "events", "results")
# End of fixed values.
_SPARK_NAMES = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "latin-1": "ISO-8859-1"}
_NUMBERS = ((r"^[+-]?\d{1,18}$", "bigint"), (r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", "double"), (r"^(true|false)$", "boolean"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def expand(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files that the paths and globs name, sorted, each once; raises if there is none. A Parquet folder is one."""
    found = set()
    for pattern in patterns:
        fs, p = _fs(spark, pattern)
        for s in fs.globStatus(p) or []:
            name = s.getPath().getName()
            if s.isFile() or name.endswith(".parquet"):
                found.add(s.getPath().toString())
    if not found:
        raise FileNotFoundError(f"no files match {patterns}")
    return sorted(found)


def head_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def sniff_encoding(raw: bytes, cut_short: bool = False) -> str:
    """The first encoding that reads the sample; a character that the sample's end cuts in two doesn't count against one."""
    for encoding in ENCODINGS:
        for tail in range(4 if cut_short else 1):
            try:
                raw[: len(raw) - tail].decode(encoding)
                if encoding == "utf-8-sig" and not raw.startswith(b"\xef\xbb\xbf"):
                    return "utf-8"
                return encoding
            except UnicodeDecodeError:
                continue
    return "utf-8"


def sniff_delimiter(text: str) -> str:
    try:
        return csv.Sniffer().sniff(text, delimiters=DELIMITERS).delimiter if text.strip() else ","
    except csv.Error:
        return ","


def infer_numbers(df: DataFrame) -> DataFrame:
    """Text columns whose values are all integers, numbers or booleans become such; one pass. Columns without values stay text."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    aggs = [F.struct(F.count(c).alias("n"), *[F.count_if(F.trim(c).rlike(p)).alias(k) for p, k in _NUMBERS]) for c in (F.col(quoted(n)) for n in names)]
    row = df.agg(*[a.alias(f"c{i}") for i, a in enumerate(aggs)]).first()
    casts = {}
    for n, r in zip(names, row, strict=True):
        fits = next((k for k in ("bigint", "double", "boolean") if r.n and (r[k] == r.n or k == "double" and r["bigint"] + r["double"] >= r.n and r["double"] == r.n)), None)
        if fits:
            casts[n] = F.trim(F.col(quoted(n))).cast(fits)
    return df.withColumns(casts)


def _lines_in_quotes(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether some line has an odd number of quotes, as one does where a quoted value goes on in the next line."""
    text = spark.read.option("encoding", encoding).text(path)
    return not text.filter((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Large files are read in splits, unless quoted values hold line ends: then a file is one task."""
    raw = head_bytes(spark, path, 100_000)
    encoding = sniff_encoding(raw, len(raw) == 100_000)
    text = raw[:8192].decode(encoding, errors="replace")
    if not text.strip():
        return spark.createDataFrame([], T.StructType())
    whole = _lines_in_quotes(spark, path, _SPARK_NAMES[encoding])
    rows = spark.read.csv(path, header=True, sep=sniff_delimiter(text), encoding=_SPARK_NAMES[encoding], enforceSchema=False, mode="FAILFAST", multiLine=whole, ignoreTrailingWhiteSpace=False)
    return infer_numbers(with_row_id(rows)).select(*rows.columns, "_row_id")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, objects by line, one object, or one that holds a list of them under a usual name."""
    raw = head_bytes(spark, path, 100_000)
    encoding = sniff_encoding(raw, len(raw) == 100_000)
    text = raw.decode(encoding, errors="replace").strip()
    empty = spark.createDataFrame([], T.StructType())
    if not text or text == "[]":
        return empty
    by_line = path.lower().endswith((".jsonl", ".ndjson"))
    if not by_line and text[0] == "{" and "\n" in text:
        try:
            by_line = isinstance(json.loads(text.split("\n", 1)[0]), dict)
        except ValueError:
            by_line = False
    if not by_line and text[0] not in "[{" or text[0] == "[" and not text[1:].lstrip().startswith("{"):
        raise ValueError(f"no objects in {path}")
    rows = spark.read.json(path, multiLine=not by_line, mode="FAILFAST", encoding=_SPARK_NAMES[encoding])
    if not by_line and text[0] == "{":
        inner = next((k for k in ENVELOPES if k in rows.columns and isinstance(rows.schema[k].dataType, T.ArrayType) and isinstance(rows.schema[k].dataType.elementType, T.StructType)), None)
        if inner:
            rows = rows.select(F.explode(quoted(inner)).alias("_o")).select("_o.*")
    place = {c: at if (at := text.find(json.dumps(c, ensure_ascii=False))) >= 0 else len(text) for c in rows.columns}
    return with_row_id(rows.select(*[F.col(quoted(c)) for c in sorted(rows.columns, key=lambda c: (place[c], c))]))


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """With ``_row_id``, in file order."""
    suffix = "." + path.rsplit(".", 1)[-1].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported file type {suffix!r} of {path}; supported: {', '.join(SUFFIXES)}")
    if suffix == ".csv":
        return read_csv(spark, path)
    return with_row_id(spark.read.parquet(path)) if suffix == ".parquet" else read_json(spark, path)


def load_files(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """By base name, which must not repeat; each is also a temporary view named by its stem."""
    out: dict[str, DataFrame] = {}
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        if name in out:
            raise ValueError(f"two files are named {name}")
        out[name] = load_file(spark, path)
        if out[name].columns:
            out[name].createOrReplaceTempView(quoted(name.rsplit(".", 1)[0]))
    return out
