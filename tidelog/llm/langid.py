"""Operator 6: language identification.

Multinomial naive Bayes over hashed character n-grams (one to three lower-cased codepoints). Counting is done where
the training documents are, one row per language and bucket leaves a task, and the matrix of log-probabilities
(languages x BUCKETS floats) is broadcast; whole texts are scored in numpy by gathering matrix rows.

The classifier is fitted on a bounded sample of labelled rows: about TRAIN_ROWS documents of each language at most,
chosen by a hash of the id; a language with fewer gives all.

Defined cases: null text, or no letter in it: ``und`` with score 0; no training rows: all ``und``; ties go to the
language that sorts first. Ids play no part in a prediction. A null id counts as a training document, as its
remainder is not 2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.bpe import LETTER, codepoint_classes
from tidelog.llm.common import byte_column, record_batch, slices, tidy

BUCKETS = 1 << 15
TRAIN_ROWS = 4000
UNKNOWN = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def buckets(points: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For n = 1, 2, 3 the bucket of the n-gram that ends at each codepoint (texts don't share n-grams)."""
    points = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint64)
    one, two = np.zeros_like(points), np.zeros_like(points)
    one[1:], two[2:] = points[:-1] + np.uint64(1), points[:-2] + np.uint64(1)
    one[first] = two[first] = 0
    second = np.zeros(len(first), bool)
    second[1:] = first[:-1]
    two[second] = 0
    grams = (points, points | one << np.uint64(21), points | one << np.uint64(21) | two << np.uint64(42))
    return [((g + np.uint64(n)) * _ODD >> np.uint64(49)).astype(np.int32) for n, g in enumerate(grams)]


def _arrays(texts: list[bytes]):
    decoded = [x.decode("utf-8", "replace") for x in texts]
    sizes = np.array([len(x) for x in decoded], np.int64)
    points = np.frombuffer("".join(decoded).encode("utf-32-le", "replace"), "<u4")
    begins = np.cumsum(sizes) - sizes
    first = np.zeros(len(points), bool)
    first[begins[sizes > 0]] = True
    return points, first, begins, sizes


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """labelled: text, lang. (languages, log-probabilities by bucket and language; the last row is the prior)."""
    out = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        tally: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            langs = batch.column("lang").to_pylist()
            texts = byte_column(batch, "text")
            for lang in set(langs):
                at = tally.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                mine = [x for x, own in zip(texts, langs) if own == lang]
                points, first, _, _ = _arrays(mine)
                for b in buckets(points, first):
                    at[:BUCKETS] += np.bincount(b, minlength=BUCKETS)
                at[BUCKETS] += len(mine)
        for lang, at in tally.items():
            used = np.flatnonzero(at)
            yield record_batch(out, [[lang] * len(used), used.astype(np.int32), at[used]])

    rows = labelled.select("text", "lang").mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.ones((BUCKETS, len(langs)))
    prior = np.ones(len(langs))
    for k, lang in enumerate(langs):
        mine = rows[rows["lang"] == lang]
        at, n = mine["bucket"].to_numpy(), mine["n"].to_numpy()
        counts[at[at < BUCKETS], k] += n[at < BUCKETS]
        prior[k] += n[at == BUCKETS].sum()
    logs = np.log(counts / counts.sum(0))
    return langs, np.vstack([logs, np.log(prior / prior.sum())]).astype(np.float32)


def predict(texts: list[bytes], langs: list[str], logs: np.ndarray) -> tuple[list[str], np.ndarray]:
    points, first, begins, sizes = _arrays(texts)
    letters = np.zeros(len(texts), bool)
    total = np.tile(logs[-1].astype(np.float64), (len(texts), 1))
    full = np.flatnonzero(sizes)
    if len(full) and langs:
        letters[full] = np.logical_or.reduceat(codepoint_classes()[points] == LETTER, begins[full])
        each = sum(logs[b] for b in buckets(points, first))
        for k in range(len(langs)):
            total[full, k] += np.add.reduceat(each[:, k], begins[full], dtype=np.float64)
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = total.argmax(1)
    score = 1 / np.exp(np.maximum(total - total.max(1, keepdims=True), -700)).sum(1)
    return [langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, score, 0.0)


def held_out(doc_id, modulus: int = 4):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def training_sample(docs: DataFrame) -> DataFrame:
    """text and lang of about TRAIN_ROWS documents of each language at most, no held-out ones."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    part = F.lit(1.0)
    for lang, n in sizes.items():
        if n > TRAIN_ROWS:
            part = F.when(F.col("lang") == lang, TRAIN_ROWS / n).otherwise(part)
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20)).select("text", "lang")


def identify(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, then the columns named by more, of every document."""
    langs, logs = train(training_sample(docs))
    model = docs.sparkSession.sparkContext.broadcast((langs, logs))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("_text"), *more)
    schema = T.StructType([*base.drop("_text").schema.fields[:2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *base.schema.fields[3:]])

    def run(batches):
        for batch in slices(batches, "_text"):
            lang, score = predict(byte_column(batch, "_text"), *model.value)
            columns = [*batch.columns[:2], pa.array(lang, pa.string()), pa.array(score, pa.float64()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return base.mapInArrow(tidy(run), schema)
