"""Operator 9: removal of repeated passages by repeated-phrase automata.

A window is LENGTH consecutive words. First, recurring windows are confirmed (see repeats; a window recurs if a document
with a smaller id has it), each with a document that owns it. The owners' windows, merged into passages, go to the
buckets of the documents that repeat them; a bucket has its share of the documents by hash and only the passages
that occur there. Each bucket compiles an Aho-Corasick automaton over its passages' tiles (TILE words at every TILE-th
place, so any window has a whole tile) and streams its documents through it; every occurrence is extended word by
word against the passage, and LENGTH equal words or more are removed where the owner's id is smaller. So what is removed
was compared word for word.

Defined cases: null text has no words; documents with fewer than LENGTH words keep all; documents that repeat an id
don't remove each other's words; a null id is smaller than all others.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import record_batch, shuffle_partitions, stored, tidy
from tidelog.llm.repeats import Spec, keyed, repeats, span

LENGTH, ANCHOR, TILE = 50, 16, 25
#: Text of one bucket, about; its automaton has a part of that. A task has its buckets one after the other.
BUCKET_BYTES = 4 << 20
#: Routes that one row of an owner has, about; an owner with more has its text in so many rows, dealt over the tasks.
ROUTES = 1 << 12


def word_symbols(text: bytes) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(w) for w in text.split()], np.uint64)


SPEC = Spec(LENGTH, ANCHOR, by_document=True, owners=True, symbols=word_symbols)


def around(out: np.ndarray, start: int, end: int) -> tuple[int, int]:
    """The removed run that holds [start, end), no longer than windows there reach; (start, start) if there is none."""
    if not out[start:end].all():
        return start, start
    left, right = out[max(0, end - LENGTH) : start][::-1], out[end : start + LENGTH]
    return start - (int(left.argmin()) if not left.all() else len(left)), end + (int(right.argmin()) if not right.all() else len(right))


class Automaton:
    """Passages of one bucket."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.passages: list[np.ndarray] = []
        self.owners: list[int] = []
        self.tiles: dict[tuple, list[tuple[int, int]]] = {}
        self.machine = None

    def add(self, passage: bytes, owner: int) -> None:
        ids = [self.words.setdefault(w, len(self.words) + 1) for w in passage.split()]
        for at in range(0, len(ids) - TILE + 1, TILE):
            self.tiles.setdefault(tuple(ids[at : at + TILE]), []).append((len(self.passages), at))
        self.passages.append(np.array(ids))
        self.owners.append(owner)

    def compile(self) -> None:
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for tile, places in self.tiles.items():
            self.machine.add_word(tile, places)
        self.machine.make_automaton()
        self.tiles = {}

    def removed(self, words: list[bytes], did: int) -> np.ndarray:
        """Which words are in a window that a passage of a smaller id has."""
        out = np.zeros(len(words), bool)
        if self.machine is None:
            self.compile()
        if not self.passages or len(words) < LENGTH:
            return out
        get = self.words.get
        ids = tuple([get(w, 0) for w in words])
        array, n = np.array(ids), len(ids)
        seen: dict[tuple[int, int], int] = {}
        for end, places in self.machine.iter(ids):
            start = end - TILE + 1
            a, b = around(out, start, end + 1)
            for which, at in places:
                # windows with this tile lie within these bounds: if all of that is removed, no passage adds to it
                if a <= max(0, end + 1 - LENGTH) and b >= min(n, start + LENGTH):
                    break
                if self.owners[which] >= did:
                    continue
                shift = start - at
                if seen.get((which, shift), -1) > start:
                    continue
                passage = self.passages[which]
                if b > a:  # a passage adds only if it goes on where the removed run ends
                    on = b < n and 0 <= b - shift < len(passage) and passage[b - shift] == ids[b]
                    if not on and not (a > 0 and 0 < a - shift <= len(passage) and passage[a - 1 - shift] == ids[a - 1]):
                        continue
                low, high = max(0, shift), min(n, shift + len(passage))
                differ = np.flatnonzero(array[low:high] != passage[low - shift : high - shift]) + low
                k = np.searchsorted(differ, start)
                first, last = (differ[k - 1] + 1 if k else low), (differ[k] if k < len(differ) else high)
                seen[which, shift] = last
                if last - first >= LENGTH:
                    out[first:last] = True
                    a, b = around(out, start, end + 1)
        return out


def _passages(batches):
    """did, text, bucket, places: the places' windows merged into passages."""
    out = pa.schema([("bucket", pa.int64()), ("did", pa.int64()), ("passage", pa.binary())])
    for batch in batches:
        buckets, dids, found = [], [], []
        for did, text, routes in zip(batch.column("did").to_pylist(), batch.column("text").to_pylist(), batch.column("routes").to_pylist()):
            words = (text or "").encode().split()
            by_bucket: dict[int, list[int]] = {}
            for r in routes:
                by_bucket.setdefault(r["bucket"], []).append(r["oat"])
            for bucket, places in by_bucket.items():
                low, high = span(np.array(places))
                mark = np.zeros(len(words) + 2, np.int64)
                np.add.at(mark, np.minimum(low, len(words)), 1)
                np.add.at(mark, np.minimum(high + 1, len(words) + 1), -1)
                starts = np.concatenate([[False], np.cumsum(mark) > 0, [False]])  # windows that recur
                edge = np.flatnonzero(starts[1:] != starts[:-1])
                for a, b in zip(edge[::2], edge[1::2]):  # neighbouring windows are one passage
                    buckets.append(bucket)
                    dids.append(did)
                    found.append(b" ".join(words[a : b - 1 + LENGTH]))
        yield record_batch(out, [buckets, dids, found])


def remove_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (binary) of every document."""
    rows = keyed(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "did", "tag", "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_BYTES))
    bucket = F.pmod(F.xxhash64("did"), F.lit(buckets))
    found = repeats(SPEC, rows)
    routes = found.select(bucket.alias("bucket"), F.col("odid").alias("did"), F.col("otag").alias("tag"), "oat").distinct()
    routes = stored(routes, "routes")
    owners = routes.groupBy("did", "tag").agg(F.ceil(F.count("*") / ROUTES).cast("int").alias("parts"))
    part = F.pmod("bucket", F.col("parts")).cast("int")
    routes = routes.join(owners, ["did", "tag"]).withColumn("part", part).groupBy("did", "tag", "part").agg(F.collect_list(F.struct("bucket", "oat")).alias("routes"))
    texts = rows.select("did", "tag", "text").join(owners, ["did", "tag"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    passages = texts.join(routes, ["did", "tag", "part"]).select("did", "text", "routes").mapInArrow(tidy(_passages), "bucket long, did long, passage binary")
    passages = passages.groupBy("bucket", "passage").agg(F.min("did").alias("did"))
    nothing = F.lit(None).cast("long")
    both = passages.select("bucket", F.lit(0).alias("kind"), "did", nothing.alias("doc_id"), "passage").union(rows.select(bucket.alias("bucket"), F.lit(1).alias("kind"), "did", "doc_id", F.col("text").cast("binary")))
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def stream(batches):
        machine, of = Automaton(), None
        for batch in batches:
            kept = []
            for b, kind, did, doc_id, text in zip(*(batch.column(x).to_pylist() for x in ("bucket", "kind", "did", "doc_id", "passage"))):
                if b != of:
                    machine, of = Automaton(), b
                if kind == 0:
                    machine.add(text, did)
                    continue
                words = text.split()
                gone = machine.removed(words, did)
                n = int(gone.sum())
                kept.append((doc_id, len(words), n, b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if n else words)))
            yield record_batch(out, [[x[k] for x in kept] for k in range(4)])

    dealt = both.repartition(shuffle_partitions(docs), "bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(tidy(stream), "doc_id long, n_words long, n_removed long, kept binary")
