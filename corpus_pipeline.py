"""The training-corpus pipeline: STAGES in order, each stage's rows written and read again as the next one's docs.

Defined cases: a null or letterless text is rejected by the first stage, and so is every row of an empty table; extra columns
are left out; rows that repeat an id are documents of their own, so of rows that repeat id and text one stays, and of
equal texts the smallest id's (a null id comes last); ties in language go to the language that sorts first, ties
between passages to the first. Texts are whole at every stage, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontaminate, langid, nearcopies, simhash, substrings
from tidelog.llm.common import stored, table
from tidelog.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if one language is more likely than all others together.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (``und``), and those whose best language has a probability below LEAST_SCORE."""
    judged = langid.identify(docs, *COLUMNS[1:])
    return judged.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-copies (five words, 0.8) the document with the smallest id (the smallest text among rows that repeat it)."""
    return simhash.keep_one(docs, nearcopies.groups).select(*COLUMNS)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings of 100 bytes out of the texts; documents of which nothing is left go."""
    found = substrings.remove_repeats(docs, "lang", "source", "n_chars")
    text = F.when(F.col("n_removed") > 0, substrings.kept_text(F.col("kept"))).otherwise(F.col("kept").cast("string"))
    rows = found.filter((F.col("n_removed") == 0) | (F.octet_length("kept") > 0)).withColumn("text", text)
    return rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of a benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text decoded from them, and the ids."""
    return bpe.digests(docs, tokenizer_path(), with_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_substrings", repeated_substrings), ("benchmark_passages", benchmark_passages), ("tokens", tokens)]
#: Fingerprints, sampled repeats, edit distances and merges are no SQL; tests/llm holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
