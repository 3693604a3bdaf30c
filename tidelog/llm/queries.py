"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.llm import bpe, decontaminate, html, langid, lm, phrases, simhash, substrings, topk, urlfilter
from tidelog.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


def op3_lm(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op4_substrings(spark, sf_dir):
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_langid(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_urlfilter(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op9_phrases(spark, sf_dir):
    found = phrases.remove_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_html(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op8_urlfilter": urlfilter.sql()}
