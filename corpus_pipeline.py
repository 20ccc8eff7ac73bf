"""From raw documents to training ids: toxicity, near duplicates, repeated strings, source mix, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of ``documents``; between stages the rows are written as Parquet and read again. Nulls, empty
texts, repeated rows and empty tables follow the operators' own rules. SQL cannot express the stages (a learnt
lexicon, hashed signatures, byte strings, seeded merges), so ``ORACLE_SQL`` is None and the tests compare each
stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.minhash import drop_near_duplicates
from halyard.llm.mixing import mix_corpus
from halyard.llm.pieces import encode_documents
from halyard.llm.queries import tokenizer_path
from halyard.llm.shared import stored, table
from halyard.llm.suffix_dedup import remove_repeats
from halyard.llm.toxicity import drop_toxic, fit_lexicon


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learnt from the labels, does not reject."""
    return drop_toxic(docs, fit_lexicon(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id."""
    return drop_near_duplicates(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the bytes that 200-byte repeats cover."""
    return remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mix_corpus(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces: the ids to train on. Each copy that the mix made has a segmentation of its own."""
    encoded = encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), copies=True)
    return encoded.withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("source_mix", source_mix),
    ("pieces", pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
