"""Training corpus in five stages: toxicity, language ID, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each one's result to the
shared folder and hands it to the next. All but the last return the columns of ``documents``.
The toxicity and language models are fitted on the stage's own input, so that they
hold for what the stage before kept; ``labels`` comes from ``sf_dir``.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import langid, linededup, neardup, packing, toxicity
from tallyframe.llm.arrowtools import table
from tallyframe.session import remove, shared_path

#: A document costs over so many bits a byte by the best language's sample if it is in none of them:
#: text of a learned language costs 2 to 4, a key among ten words makes it under 6, another language costs 7 or more.
#: The bits of one phrase are allowed on top, so that a text of few bytes isn't judged by where its phrases happen to end.
FOREIGN_BITS = 6.5
PHRASE_BITS = log2(langid.SAMPLE_BYTES)


def _aside(docs: DataFrame, taken: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``docs`` with columns that a stage's operator would replace renamed, and what selects the documents' columns again."""
    names = {c: f"_doc{i}_{c}" if c.lower() in taken else c for i, c in enumerate(docs.columns)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return docs.select(*[quoted(c).alias(n) for c, n in names.items()]), [quoted(n).alias(c) for c, n in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows, back = _aside(docs, ("score", "predicted", "n_sentences", "offending"))
    return toxicity.score_documents(rows, model).filter("predicted = 0").select(*back)


def drop_foreign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and resemble one of the labelled languages."""
    rows, back = _aside(docs, ("lang_pred", "score", "bits"))
    found = langid.identify(rows, langid.fit(docs))
    foreign = F.col("bits") > FOREIGN_BITS + PHRASE_BITS / F.octet_length("text")
    return found.filter((F.col("lang_pred") != langid.NOTHING) & ~foreign).select(*back)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that smaller ids hold too; ``n_chars`` follows."""
    rows, back = _aside(docs, ("n_lines", "n_dropped", "kept_text", "drops"))
    done = linededup.drop_repeated_lines(rows)
    changed = {"text": F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumns(changed).select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class; documents without an id stay, rows that share an id stay or go together."""
    gone = neardup.near_duplicates(docs).filter("class_id <> id").select(F.col("id").alias("doc_id"))
    rows, back = _aside(docs, ())
    return rows.join(gone, "doc_id", "left_anti").select(*back)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_foreign),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack_documents),
]

#: Scores, samples and token ids aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; what a stage read is deleted once its own result is written."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            remove(spark, read)
        docs, read = spark.read.parquet(path), path
    return docs
