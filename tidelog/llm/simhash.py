"""Operator 2: SimHash near-duplicates.

Fingerprints link at MAX_BITS differing bits or fewer. Such bits touch at most MAX_BITS of the 8 bytes, so linked
fingerprints share at least NEEDED = 5 bytes at their positions. The inverted index has positional bytes as keys,
three positions a key: splitting the positions into two halves of four, five shared positions put three in one half,
so the 4 + 4 triples within the halves find every pair (one byte alone would have postings of 1/256 of the corpus).
The count filter then tallies each candidate pair's shared positional bytes, drops pairs below NEEDED, and the rest
is verified bit by bit.

Fingerprints, not documents, are indexed: copies meet in one row first. A posting list with more than POSTING_ROWS
fingerprints is divided by two more positions (what remains shared of the other five), which loses no pair; lists
that are still long are compared in blocks, each pair of blocks a row of its own.

Defined cases: a text without words has fingerprint zero; components run over fingerprints, so null ids and repeated
ids take part and the component is named by its smallest non-null id (null if it has none).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import byte_column, doc_rows, record_batch, slices, stored, tidy
from tidelog.llm.components import connected

SEED, SHINGLE, MAX_BITS = 42, 3, 3
NEEDED = 8 - MAX_BITS
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
POSTING_ROWS = 256
CHUNK = 1 << 15

_OUT = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64())])
FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) text's shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))))
    tally, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(shingles), CHUNK):
        h = np.fromiter([digest(s, SEED) for s in shingles[at : at + CHUNK]], np.uint64)
        tally += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(tally * 2 > len(shingles), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text, which tells rows that repeat an id apart) and fp (the 64 bits as a signed long)."""

    def run(batches):
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(x) for x in byte_column(batch, "text")], np.uint64)
            yield record_batch(_OUT, [batch.column("doc_id"), batch.column("key"), found.view(np.int64)])

    return doc_rows(docs, F.xxhash64(F.col("text").cast("string")).alias("key")).mapInArrow(tidy(run), FINGERPRINTS)


def _byte(fp, k: int):
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255))


def _key(fp, positions):
    """The positions themselves and the bytes there, as one string of binary: equal only for equal both."""
    packed = F.lit(0).cast("long")
    for k in positions:
        packed = F.shiftleft(packed, 8).bitwiseOR(_byte(fp, k))
    return packed


def _shared(x):
    """The count filter's tally: positional bytes that are zero in x, the difference of two fingerprints."""
    return sum((F.when(_byte(x, k) == 0, 1).otherwise(0) for k in range(1, 8)), F.when(_byte(x, 0) == 0, 1).otherwise(0))


def _verified(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs that share a posting list, then the count filter, then the exact distance."""
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    pairs = left.join(right.withColumnRenamed("fp", "fp2"), on)
    return pairs.filter((F.col("fp") < F.col("fp2")) & (_shared(x) >= NEEDED) & (F.bit_count(x) <= MAX_BITS)).select("fp", "fp2")


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct fingerprints (fp). Every pair within MAX_BITS bits, once or more."""
    keys = [F.struct(F.lit(i).alias("slot"), _key(F.col("fp"), t).alias("value")) for i, t in enumerate(TRIPLES)]
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.slot", "k.value")
    sizes = postings.groupBy("slot", "value").agg(F.count("*").alias("n")).filter("n > 1")
    postings = stored(postings.join(sizes, ["slot", "value"]), "postings")
    short = postings.filter(F.col("n") <= POSTING_ROWS).drop("n")
    found = _verified(short, short, ["slot", "value"])
    finer = []
    for i, t in enumerate(TRIPLES):
        rest = [k for k in range(8) if k not in t]
        for j, more in enumerate(combinations(rest, NEEDED - len(t))):
            finer.append(F.when(F.col("slot") == i, F.struct(F.lit(i * 16 + j).alias("slot"), _key(F.col("fp"), (*t, *more)).alias("value"))))
    long = postings.filter(F.col("n") > POSTING_ROWS).select("fp", F.explode(F.array(*finer)).alias("k")).filter("k is not null").select("fp", "k.slot", "k.value")
    sizes = long.groupBy("slot", "value").agg(F.count("*").alias("n")).filter("n > 1")
    blocked = long.join(sizes, ["slot", "value"]).withColumn("blocks", F.ceil(F.col("n") / POSTING_ROWS).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = blocked.select("fp", "slot", "value", F.col("own").alias("i"), other.alias("j"))
    right = blocked.select("fp", "slot", "value", other.alias("i"), F.col("own").alias("j"))
    return found.union(_verified(left, right, ["slot", "value", "i", "j"]))


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, fp of every document; fp, root (the group's smallest fingerprint) and the fingerprint's smallest id."""
    found = stored(fingerprints(docs), "fingerprints")
    fps = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = connected(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    return found, fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and fp of every document."""
    found, named = groups(docs)
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def keep_one(docs: DataFrame, grouped=groups) -> DataFrame:
    """docs with one row of each group: the smallest id's (nulls last), then the smallest text hash's, then any of equal rows."""
    found, named = grouped(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    each = found.groupBy("fp").agg(first.alias("first")).join(named.select("fp", "root"), "fp")  # copies meet before the join
    kept = each.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key"))
    rows = docs.withColumns({"_key2": F.xxhash64(F.col("text").cast("string")), "_id2": F.col("doc_id").cast("long")})
    rows = rows.join(kept, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")), "left_semi")
    more = [f.name for f in docs.schema if f.name not in ("doc_id", "text") and _sortable(f.dataType)]
    w = Window.partitionBy("_id2", "_key2").orderBy(*more or ["_key2"])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_id2", "_key2")
