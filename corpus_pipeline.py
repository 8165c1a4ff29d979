"""Cleans and encodes the documents table, stage by stage; every stage reads what the last one wrote.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the
last returns doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions.session import materialise
from flowsentry.llm.bpe import encode_documents
from flowsentry.llm.common import fresh, table
from flowsentry.llm.cotraining import keep_good, train
from flowsentry.llm.decontaminate import remove_contaminated
from flowsentry.llm.jaccard_join import keep_one_of_each
from flowsentry.llm.line_templates import drop_recurring_lines
from flowsentry.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier, fitted on the labels, does not reject."""
    return keep_good(docs.select(*COLUMNS), train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in the first document only. ``n_chars`` follows the text;
    a document that loses its last word goes."""
    dropped = fresh("n_dropped", docs)
    cut = drop_recurring_lines(docs.select(*COLUMNS), count_as=dropped)
    changed = F.col(dropped) > 0
    kept = cut.filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return keep_one_of_each(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark text."""
    return remove_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded and decoded again."""
    return encode_documents(docs, tokenizer_file())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe),
]

# The stages fit a model, follow links and run a tokenizer, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1], 1):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
