"""A training corpus from `documents`, in stages: toxic documents go, one of each group of near-duplicates stays, copies of
benchmark items go, personal data gets surrogates, and what remains is encoded.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame; all but the last return docs' columns.
Stages read no column but doc_id and text, pass others on, and define these cases: null or empty texts are clean and stay (one
of each group of near-duplicates), rows with a null doc_id are rows of their own, equal rows share their fate, an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opportune.llm import bpe, decontaminate, pii, simhash, toxicity
from opportune.llm.common import unused, written
from opportune.llm.queries import pii_key, table, tokenizer_file, toxicity_lexicon


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the lexicon, learned from docs and the labels that aren't held out, scores as toxic."""
    lexicon = toxicity_lexicon(docs, table(spark, sf_dir, "labels"))
    column = unused(docs, "__toxicity")
    scored = toxicity.score(docs, lexicon, out_col=column)
    return scored.where(F.col(column)["score"] < toxicity.THRESHOLD).select(docs.columns)


def drop_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that copy a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with surrogates for personal data; n_chars follows the text."""
    column = unused(docs, "__pii")
    out = pii.pseudonymise(docs, pii_key(), out_col=column).withColumn("text", F.col(column)["text"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids and the digest of what they decode to."""
    out = bpe.encode(docs.select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"), decoded_col="decoded")
    return out.select("doc_id", "n_tokens", "token_ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_duplicates),
    ("decontamination", drop_leaks),
    ("pii", replace_pii),
    ("bpe", encode_ids),
]

#: SQL can't express the stages; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; what each but the last returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
