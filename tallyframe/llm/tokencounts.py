"""Token counts kept up to date by signed changes.

A ledger is a folder that holds, for each committed batch, the sums of its changes by source,
language and tokenizer version; totals are sums of these. An insert adds a document and its
tokens, a delete takes both away, a revision adds the difference between the new count and the
old one. As sums of signed numbers don't depend on order, batches may come in any order.

A batch is committed once: its sums are written to a folder of their own first, then the whole log
entry to a file beside the log, which last gets its name in the log, a name of the batch; that fails if the
name is taken. So an entry is there in full or not at all. Readers see what the log names. A repeated batch is left
out, whatever it holds, and what a lost attempt wrote is ignored (``sweep`` deletes it). ``compact``
replaces all batches by one sum, and remembers their names. Compactions are numbered, each
replacing the one before too, so that of several that read the same log one counts.

Giving a file its name must fail where the name is taken: HDFS and stores like it do so, local
folders by a hard link. Plain object stores, which overwrite, need a folder of another kind for the ledger.

Counting and summing are Spark SQL. Changes are summed partially before the shuffle, so a hot
source costs a row for each task.

Defined results: null text has no tokens; null source, language or count are groups of their own
and 0. Keys whose documents and tokens are both 0 vanish from the totals. Unknown kinds of change
raise when the batch is committed.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.arrowtools import table
from tallyframe.session import cut, remove, shared_path

KEYS = ["source", "lang", "tokenizer"]
#: Tokenizer versions that SQL can count: what a token is.
PATTERNS = {
    "words-v1": r"[^ \t\n\r]+",
    "words-v2": r"[\p{L}\p{N}]+",
    "pieces-v1": r"\p{L}+|\p{N}|[^ \t\n\r\p{L}\p{N}]",
}


def token_count(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[version])), F.lit(0)).cast("long")


def changes(df: DataFrame, kind: str, old: dict[str, Column] | None = None, new: dict[str, Column] | None = None) -> DataFrame:
    """Changes of all rows of ``df`` (with source and lang): for each tokenizer version its old and new count."""
    old, new = old or {}, new or {}
    zero = F.lit(0).cast("long")
    rows = [F.struct(F.lit(v).alias("tokenizer"), old.get(v, zero).alias("old_tokens"), new.get(v, zero).alias("new_tokens")) for v in sorted(old.keys() | new.keys())]
    return df.select(F.lit(kind).alias("kind"), "source", "lang", F.inline(F.array(*rows)))


class Ledger:
    """Totals by source, language and tokenizer version in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("log", "unnamed"):
            self.fs.mkdirs(self._path(folder))

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _log(self) -> dict[str, dict]:
        """Log entries by name."""
        found = {}
        for s in self.fs.listStatus(self._path("log")):
            stream = self.fs.open(s.getPath())
            try:
                found[s.getPath().getName()] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return found

    def _write_log(self, name: str, entry: dict) -> bool:
        """Whether the entry got its name; False if that was taken."""
        unnamed = self._path("unnamed", uuid.uuid4().hex)
        out = self.fs.create(unnamed, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            self._name(unnamed, self._path("log", name))
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        finally:
            self.fs.delete(unnamed, False)
        return True

    def _name(self, unnamed, named) -> None:
        """Raises if there is such a file already."""
        if self.fs.getScheme() == "file":
            nio = self.jvm.java.nio.file
            old, new = (nio.Path.of(self.fs.makeQualified(p).toUri()) for p in (unnamed, named))
            nio.Files.createLink(new, old)
        else:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(unnamed, named, self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def committed(self) -> set[str]:
        log = self._log()
        return {n for e in log.values() for n in e["batches"]}

    def _live(self) -> list[str]:
        log = self._log()
        gone = {n for e in log.values() for n in e.get("replaces", [])}
        return sorted(e["data"] for n, e in log.items() if n not in gone)

    def commit(self, batch: str, changed: DataFrame) -> bool:
        """Adds a batch of changes; False, without reading it, if a batch of this name is there."""
        if batch in self.committed():
            return False
        sign = F.expr("case kind when 'insert' then 1 when 'delete' then -1 when 'revise' then 0 else raise_error(concat('unknown change ', kind)) end")
        sums = changed.groupBy(*KEYS).agg(
            F.sum(sign).cast("long").alias("documents"), F.sum(F.coalesce("new_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))).cast("long").alias("tokens")
        )
        data = f"data/{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{data}")
        if self._write_log(f"batch-{hashlib.sha256(batch.encode()).hexdigest()}", {"data": data, "batches": [batch]}):
            return True
        self.fs.delete(self._path(data), True)
        return False

    def totals(self) -> DataFrame:
        return self._sum(self._live())

    def _sum(self, data: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, documents long, tokens long"
        if not data:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{d}" for d in data])
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """One sum in place of all batches so far; False if there is nothing to do or another compaction came first."""
        log = self._log()
        gone = {n for e in log.values() for n in e.get("replaces", [])}
        live = {n: e for n, e in log.items() if n not in gone}
        if len(live) < 2:
            return False
        data = f"data/{uuid.uuid4().hex}"
        self._sum([e["data"] for e in live.values()]).coalesce(1).write.parquet(f"{self.path}/{data}")
        entry = {"data": data, "batches": sorted({b for e in log.values() for b in e["batches"]}), "replaces": sorted(live)}
        if self._write_log(f"sum-{sum(n.startswith('sum-') for n in log):08d}", entry):
            return True
        self.fs.delete(self._path(data), True)
        return False

    def sweep(self, older_than: float = 7 * 86400) -> int:
        """Deletes what no reader needs, if it is ``older_than`` seconds old: data of lost attempts and of replaced batches. How many folders and files."""
        live = {d.split("/")[-1] for d in self._live()}
        before = (time.time() - older_than) * 1000
        old = [s.getPath() for f in ("data", "unnamed") if self.fs.exists(self._path(f)) for s in self.fs.listStatus(self._path(f)) if s.getModificationTime() <= before]
        old = [p for p in old if p.getName() not in live]
        for p in old:
            self.fs.delete(p, True)
        return len(old)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted under two versions, words-v1 is revised to count as words-v2 does,
    documents under 200 characters are withdrawn and then inserted again, so that all are counted in the
    end; batches that come twice count once."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    short = docs.filter(F.char_length("text") < 200)
    n = {v: token_count(F.col("text"), v) for v in PATTERNS}
    path = shared_path(spark, "token-counts")
    ledger = Ledger(spark, path)
    now = {"words": n["words-v2"], "pieces-v1": n["pieces-v1"]}
    batches = {
        "inserted": changes(docs, "insert", new={"words": n["words-v1"], "pieces-v1": n["pieces-v1"]}),
        "revised": changes(docs, "revise", old={"words": n["words-v1"]}, new={"words": n["words-v2"]}),
        "withdrawn": changes(short, "delete", old=now),
        "back": changes(short, "insert", new=now),
    }
    for name in ("inserted", "revised", "inserted", "withdrawn", "back", "revised"):
        ledger.commit(name, batches[name])
    ledger.compact()
    totals = cut(ledger.totals())  # a row a source, language and version
    remove(spark, path)
    return totals


OP2_SQL = r"""
with counted as (
  select source, lang, 'words' as tokenizer, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+')) as tokens from documents
  union all
  select source, lang, 'pieces-v1', len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}|[^ \t\n\r\p{L}\p{N}]')) from documents)
select source, lang, tokenizer, count(*)::bigint as documents, sum(tokens)::bigint as tokens
from counted group by source, lang, tokenizer
"""
