"""Raw documents to encoded training data, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next one's docs. All but the last keep the documents'
columns (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import jaccard, langid, mixture, paragraphs, pieces
from quern.llm.shared import saved, table, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates here: five words to a shingle, a Jaccard similarity of 0.8 or more.
NEAR = jaccard.Rule(words=5, percent=80)
MODEL = "piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a language of a clear posterior go."""
    return langid.accepted(docs.select(*COLUMNS), tokenizer_file(MODEL))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays."""
    return jaccard.one_of_each(docs.select(*COLUMNS), NEAR)


def paragraph_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages stay in the first document that holds them."""
    return paragraphs.deduplicated(docs.select(*COLUMNS))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated and cut as the mix of sources takes their words."""
    return mixture.mixed_documents(docs.select(*COLUMNS))


def piece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document row: tokens and digests of ids, spans and decoded text."""
    return pieces.encode_digest(docs, tokenizer_file(MODEL))


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("paragraph_dedup", paragraph_dedup),
    ("source_mixture", source_mixture),
    ("piece_codec", piece_codec),
]

#: No SQL: segmentation sums, components and permuted blocks are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
