"""What the Arrow-batched operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch sent to Python. Long texts are common, so small batches keep workers small.
BATCH_ROWS = 512
#: Bytes of such a batch; a longer single row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Bytes of text that one vectorised step takes at a time; a longer single text is a step of its own.
STEP_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, unless they are lower already.

    Spark reads these when a plan is run, hence they stay lowered.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < _bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _bytes(setting: str) -> int:
    """A number that may end in b, k, m or g."""
    digits = setting.strip().lower().rstrip("bkmgt")
    unit = setting.strip().lower()[len(digits) :][:1]
    return int(digits) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(unit, 1)


def steps(batches: Iterable[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes; no empty ones."""
    for b in batches:
        sizes = [0 if n is None else n for n in pc.binary_length(b.column(column)).to_pylist()]
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns of these names, in whatever case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in low])


def extended(df: DataFrame, fields: str) -> T.StructType:
    """The schema of ``df`` and then ``fields``."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])
