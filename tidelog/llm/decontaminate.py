"""Operator 7: benchmark decontamination.

A document is contaminated by an item of m words if some passage of it is within floor(EDITS m) word edits of the item.
Windows of the item's size start at every word of every document.

* Count filter (loses nothing): a passage within e edits keeps m - 2 - 3e of the item's word triples, so windows with
  fewer triples that occur in any item go (pairs, m - 1 - 2e, for items too short for triples). Prefix sums over a
  whole slice of texts count them.
* CGK embedding: a walk over the window writes the word under its pointer, and a random bit of (step, word) says
  whether the pointer moves; edit distance becomes Hamming distance.
* Bit-sampling LSH: each repetition samples SAMPLED steps of one walk; windows and items with equal samples are
  candidates. Repetitions are added until RECALL of the items, edited at random up to the limit, are found; for
  items of a size that MOST_REPEATS repetitions don't suffice for, all windows that the count filter leaves are candidates.
* Verification: exact edit distance of the item to its best passage around the candidates (free ends).

Words, of items and documents alike, end at Unicode white space and are compared lower-cased and without characters
that are no letters, digits or underscores; empty ones don't count. Items of fewer than five words allow no edit, so they
are found where their words stand as they are; an item without words is nowhere. Items are handled in blocks of
BLOCK_ITEMS, each broadcast (a fixed bound), PASS_BLOCKS of them in each pass over the documents.

Defined cases: null text has no words; null or repeated items count as they are, each by its item_id; rows that repeat
a document give equal rows; ties between passages go to the first; no items or no documents give no rows.
"""

from __future__ import annotations

import random
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_batches, byte_column, doc_rows, record_batch, slices, stored, tidy

EDITS, BLOCK_ITEMS, PASS_BLOCKS = 0.2, 5000, 4
SAMPLED, RECALL, MOST_REPEATS, TRIAL_ITEMS, TRIALS = 2, 0.995, 96, 50, 1000
STRETCH = 3  # steps of a walk per word
SCAN_BYTES = 4 << 20
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edit_distance", pa.int64()), ("item_words", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64())])
_WORD = re.compile(r"\W+")


def normal(word: str) -> str:
    return _WORD.sub("", word.lower())


class Words(dict):
    """Raw word -> id: 0 for words of no item, -1 for words without letters or digits. Emptied when it is large."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, raw: str) -> int:
        if len(self) > 200_000:
            self.clear()
        text = raw.lower()
        word = text.strip(".,;:!?*#$%&\"()")
        word = word if word.isalnum() else normal(text)
        found = self.known.get(word, 0) if word else -1
        if len(raw) <= 64:
            self[raw] = found
        return found


def edit_limit(m: int) -> int:
    return int(EDITS * m)


def bits(repeat: int, step: int, words: np.ndarray) -> np.ndarray:
    """The walk's random bits; the same in every process."""
    x = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((repeat * 1009 + step * 9176 + 77) * 0xC2B2AE3D27D4EB4F % (1 << 64))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(61)).astype(np.int64) & 1


def samples(windows: np.ndarray, repeat: int) -> np.ndarray:
    """windows: rows of word ids. One row's SAMPLED symbols of the repetition's embedding."""
    n, m = windows.shape
    r = random.Random(repeat * 7919 + m)
    steps = range(STRETCH * m // 2)  # later steps are mostly past the end
    chosen = sorted(r.sample(steps, min(SAMPLED, len(steps))))
    padded = np.concatenate([windows, np.full((n, 1), -2, windows.dtype)], 1)
    at, rows, out = np.zeros(n, np.int64), np.arange(n), []
    for step in range(chosen[-1] + 1):
        symbol = padded[rows, at]
        if step in chosen:
            out.append(symbol)
        at = np.minimum(at + bits(repeat, step, symbol), m)
    return np.stack(out, 1)


def best_passage(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Smallest edit distance of the item to any passage of the region, and the first end of such a passage."""
    row = np.zeros(len(region) + 1, np.int64)
    index = np.arange(len(region) + 1)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != word))
        row = np.minimum.accumulate(new - index) + index
    end = int(row.argmin())
    return int(row[end]), end


def grams(words: np.ndarray, q: int) -> np.ndarray:
    """Each q consecutive words as one number (a block's words have ids below 2^21)."""
    if q == 1:
        return words
    return words[:-1] << 21 | words[1:] if q == 2 else words[:-2] << 42 | words[1:-1] << 21 | words[2:]


def needed(m: int) -> tuple[int, int]:
    """The q that the count filter uses for items of m words, and how many of their q-grams any passage keeps."""
    limit = edit_limit(m)
    return next((q, m + 1 - q - q * limit) for q in (3, 2, 1) if m + 1 - q - q * limit > 0)


class Items:
    """One block of items, indexed."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.known: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in rows:
            words = [w for w in map(normal, (text or "").split()) if w]
            if words:
                self.items.append((item_id, np.array([self.known.setdefault(w, len(self.known) + 1) for w in words], np.int64)))
        self.sizes: dict[int, list[int]] = {}
        for k, (_, words) in enumerate(self.items):
            self.sizes.setdefault(len(words), []).append(k)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # q: (q-grams, where each one's items begin, items)
        for q in (1, 2, 3):
            own = [(grams(w, q), k) for k, (_, w) in enumerate(self.items) if needed(len(w))[0] == q]
            pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *(np.stack([g, np.full(len(g), k)], 1) for g, k in own)]), axis=0)
            known, begins = np.unique(pairs[:, 0], return_index=True)
            self.grams[q] = known, np.append(begins, len(pairs)), pairs[:, 1]
        self.keys = {m: self.repeated(m) for m in sorted(self.sizes)}

    def repeated(self, m: int) -> list[np.ndarray] | None:
        """The items' samples of each repetition, until randomly edited items of this size are found at the target recall.

        None if MOST_REPEATS aren't enough.
        """
        own = np.stack([self.items[k][1] for k in self.sizes[m]])
        r = random.Random(m)
        tests, of = [], []
        for row, words in enumerate(own[:TRIAL_ITEMS]):
            for _ in range(-(-TRIALS // min(TRIAL_ITEMS, len(own)))):
                tests.append(edited(words.tolist(), edit_limit(m), r, m))
                of.append(row)
        tests, of = np.array(tests), np.array(of)
        missed, out = np.ones(len(tests), bool), []
        for repeat in range(MOST_REPEATS):
            keys = samples(own, repeat)
            out.append(keys)
            missed &= (samples(tests, repeat) != keys[of]).any(1)
            if missed.mean() <= 1 - RECALL:
                return out
        return None


def edited(words: list[int], edits: int, r: random.Random, size: int) -> list[int]:
    """Up to this many random edits, then cut or filled to the window's size."""
    words = list(words)
    for _ in range(edits):
        at, kind = r.randrange(len(words)), r.randrange(3)
        if kind == 0:
            words[at] = 0
        elif kind == 1:
            words.insert(at, 0)
        elif len(words) > 1:
            del words[at]
    return (words + [0] * size)[:size]


def near_items(flat: np.ndarray, ends: np.ndarray, items: Items) -> dict[int, np.ndarray]:
    """The count filter: for each item the starts of the windows that have enough of its q-grams."""
    out = {}
    for q, (known, begins, owners) in items.grams.items():
        ours = flat > 0
        for k in range(1, q):
            ours[:-k] &= flat[k:] > 0
            ours[np.maximum(ends[ends > 0] - k, 0)] = False  # no q-gram over a text's end
        at = np.flatnonzero(ours)
        if not len(at) or not len(known):
            continue
        own = flat[at]
        for k in range(1, q):
            own = own << 21 | flat[at + k]
        gram = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = known[gram] == own
        at, gram = at[hit], gram[hit]
        n = begins[gram + 1] - begins[gram]
        which = owners[np.repeat(begins[gram], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        place = np.repeat(at, n)
        order = np.lexsort((place, which))
        which, place = which[order], place[order]
        cuts = np.flatnonzero(np.diff(which, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(which))):
            m = len(items.items[which[a]][1])
            least, width = needed(m)[1], m + edit_limit(m)
            if b - a < least:
                continue
            first, last = place[a : b - least + 1], place[a + least - 1 : b]
            ok = last - first < width
            if ok.any():
                low, high = np.maximum(last[ok] - width + 1, 0), first[ok]
                mark = np.zeros(len(flat) + 1, np.int32)
                np.add.at(mark, low, 1)
                np.add.at(mark, high + 1, -1)
                out[int(which[a])] = np.flatnonzero(np.cumsum(mark) > 0)
    return out


def scan(batch: pa.RecordBatch, items: Items, words: Words) -> list[tuple]:
    """Per contaminated row and item: the row's number, then what contaminated() returns."""
    ids, owner, sizes = [], [], []
    for text in byte_column(batch, "text"):
        own = [i for i in [words[w] for w in text.decode("utf-8", "replace").split()] if i >= 0]
        sizes.append(len(own))
        ids.append(np.array(own, np.int64))
    flat = np.concatenate([np.zeros(0, np.int64), *ids])
    if not len(flat) or not items.items:
        return []
    ends = np.cumsum(sizes)
    begins = ends - sizes
    found: dict[tuple[int, int], list[int]] = {}
    n = len(flat)
    near = near_items(flat, ends, items)
    for m, keys in items.keys.items():
        mine = [(k, row, near[k]) for row, k in enumerate(items.sizes[m]) if k in near]
        if keys is None:
            for k, _, at in mine:
                for i, o in zip(at.tolist(), np.searchsorted(ends, at, "right").tolist()):
                    found.setdefault((o, k), []).append(i)
            continue
        if not mine:
            continue
        starts = np.unique(np.concatenate([x for _, _, x in mine]))
        owner = np.searchsorted(ends, starts, "right")
        place = starts[:, None] + np.arange(m)
        windows = np.where(place < ends[owner][:, None], flat[np.minimum(place, n - 1)], -2)
        mine = [(k, row, np.searchsorted(starts, x)) for k, row, x in mine]
        for repeat, own in enumerate(keys):
            found_here = samples(windows, repeat)
            for k, row, at in mine:
                for i in at[(found_here[at] == own[row]).all(1)].tolist():
                    found.setdefault((int(owner[i]), k), []).append(int(starts[i]))
    rows = []
    ids_of = batch.column("doc_id").to_pylist()
    for (o, k), starts in sorted(found.items()):
        item_id, item = items.items[k]
        m, limit = len(item), edit_limit(len(item))
        best = None
        starts = sorted(set(starts))
        cuts = [i for i in range(1, len(starts)) if starts[i] - starts[i - 1] > m]
        for a, b in zip([0, *cuts], [*cuts, len(starts)]):
            low, high = max(begins[o], starts[a] - limit), min(ends[o], starts[b - 1] + m + 2 * limit)
            distance, end = best_passage(item, flat[low:high])
            if distance <= limit and (best is None or distance < best[0]):
                back, length = best_passage(item[::-1], flat[low : low + end][::-1])
                best = (distance, low + end - length - begins[o], low + end - begins[o])
        if best:
            rows.append((o, ids_of[o], item_id, best[0], m, int(best[1]), int(best[2])))
    return rows


def _blocks(benchmark: DataFrame):
    """The indexed items, block by block, each broadcast."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-rows.count() // BLOCK_ITEMS))
    for block in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield benchmark.sparkSession.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]))


def _passes(benchmark: DataFrame):
    """PASS_BLOCKS blocks at a time."""
    blocks = _blocks(benchmark)
    while some := list(islice(blocks, PASS_BLOCKS)):
        yield some


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edit_distance, item_words, start_word and end_word of every contaminated document and item."""
    out = None
    for shared in _passes(benchmark):

        def run(batches, shared=shared):
            every = [(x.value, Words(x.value.known)) for x in shared]
            for batch in slices(batches, "text", SCAN_BYTES):
                for items, words in every:
                    found = scan(batch, items, words)
                    yield record_batch(_OUT, [[r[k] for r in found] for k in range(1, 7)])

        found = doc_rows(docs).mapInArrow(tidy(run), "doc_id long, item_id long, edit_distance long, item_words long, start_word long, end_word long")
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated documents; no row is moved. After each pass but the last, what is left is written."""
    bounded_batches(docs.sparkSession)
    before = []
    for shared in _passes(benchmark):
        if before:
            docs = stored(docs, "clean")
            for x in before:
                x.destroy()

        def run(batches, shared=shared):
            every = [(x.value, Words(x.value.known)) for x in shared]
            for batch in slices(batches, "text", SCAN_BYTES):
                for items, words in every:
                    out = {r[0] for r in scan(batch, items, words)}
                    batch = batch.filter(pa.array([k not in out for k in range(batch.num_rows)])) if out else batch
                yield batch

        docs, before = docs.mapInArrow(tidy(run), docs.schema), shared
    return docs
