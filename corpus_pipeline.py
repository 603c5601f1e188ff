"""A corpus pipeline out of the text-preparation operators: each stage works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`. Learned and
counted things (labels' words, shingle counts, word frequencies) are taken from the stage's own input.

Documents with a null or empty text, or without words, are never toxic, copies or leaks and hold no secret: they stay, and are packed as
their end id alone. A null doc_id is no hindrance: such rows are judged by their texts, but for copies, of which they are none. Of rows with one doc_id and
equal texts one stays, rows with one doc_id and unlike texts are judged each for itself. Of equal documents the least doc_id stays. Texts are
worked on whole, however long. Empty tables give empty results. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernglass.llm import decontaminate, jaccard, packing, secrets, toxicity
from fernglass.llm._shared import materialize


BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def _text_rows(spark: SparkSession) -> None:
    """Rows are whole texts: fewer of them go to a Python worker at once than Spark's default, unless the session has a number of its own."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model rejects go."""
    _text_rows(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (similarity 0.8 or more) the least doc_id stays."""
    _text_rows(spark)
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, whole or edited, go."""
    _text_rows(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; all documents stay."""
    _text_rows(spark)
    return secrets.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 ids."""
    import public_tokenizers

    _text_rows(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("packing", pack_windows),
]

#: Trained scores, alignment and packing can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
