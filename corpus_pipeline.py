"""A training-data pipeline over ``documents``: five stages of the operators in gridleaf.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
in the shared folder and read again as the next stage's docs:
language ID (texts without a language go), exact dedup (the least doc_id of equal texts
stays), n-gram Jaccard join (the least doc_id of each class stays), benchmark
decontamination (texts with a benchmark item go), SentencePiece encoding with a decoding
check (doc_id, token_ids, n_tokens, round_trip of every text that is left).

Rows with a null doc_id pass the dedup and decontamination stages, as no decision names
them; a null text has no language and goes at the first stage. All other columns of
documents are carried through unchanged, extra ones too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridleaf.llm import decontaminate, exact, jaccard, langid, pieces
from gridleaf.llm.common import saved, table

STAGES = [
    ("language_id", langid.stage),
    ("exact_dedup", exact.stage),
    ("ngram_jaccard", jaccard.stage),
    ("decontaminate", decontaminate.stage),
    ("sentencepiece", pieces.stage),
]

#: Language ID, latent retrieval and piece encoding have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
