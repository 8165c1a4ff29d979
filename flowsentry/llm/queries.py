"""The thin queries opN over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import collocations, cotraining, pii, sql, tool_calls, toxicity
from .bpe import encode_documents
from .common import table
from .decontaminate import hits
from .jaccard_join import similar_documents
from .language_id import held_out, identify_languages, train_filter
from .line_templates import drop_recurring_lines
from .quality_rules import judge_documents
from .token_files import library_encoder, write_token_files
from .whitening import fit_whitening, whitened_components

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_file() -> str:
    """Every executor has the vocabulary package installed; the path is that of the driver."""
    return public_tokenizers.path(TOKENIZER)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file()
    written = write_token_files(table(spark, sf_dir, "documents"), lambda: library_encoder(path), 50_257)
    return written.documents(spark)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_filter(docs.filter(~held_out()), "text", "lang")
    return identify_languages(docs, model)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotraining.score_documents(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.calls_of_conversations(table(spark, sf_dir, "conversations"))
    return tool_calls.link_calls(calls, results, tool_calls.SCHEMAS)


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs, count_as="n_dropped")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitened_components(vectors, fit_whitening(vectors))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii": op3_pii,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_language_id": op5_language_id,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_bpe": op7_bpe,
    "op8_quality_rules": op8_quality_rules,
    "op9_tool_calls": op9_tool_calls,
    "op10_line_templates": op10_line_templates,
    "op11_whitening": op11_whitening,
    "op12_toxicity": op12_toxicity,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {
    "op2_decontaminate": sql.DECONTAMINATE,
    "op3_pii": pii.ORACLE,
    "op4_jaccard_join": sql.JACCARD,
    "op9_tool_calls": tool_calls.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
