"""Which windows of fixed length repeat across the corpus: sparse prefix doubling, for operators 4 and 9.

A document is a sequence of symbols (bytes, or words). Ranks of substrings double as in prefix doubling: the rank of
2m symbols at i is made from the pair (rank of m at i, rank of m at i + m), down from single symbols, and the last,
overlapping pair reaches the exact length. Ranks are 64-bit names of the content, so a pair needs no sort to be
ranked within a document; Spark sorts ranks across documents.

A suffix array of every position would shuffle some twenty times the input, so positions are sampled first: the
anchor of a window is its k-symbol substring of least scrambled rank (leftmost of equals). Equal windows have equal
anchors at equal offsets, so nothing is lost by sorting anchors only:

1. rank at k: rows (rank of the anchor, rank of its run, place) of all anchors, where a run is all consecutive windows
   that have this anchor. They are sorted; an anchor whose rank is unique is done. Equal runs past the threshold
   repeat as wholes: all but the first are resolved.
2. rank half-way: where an anchor has several different runs, one run of each kind stays open. A window reaches at least
   half of (length - k) beyond its anchor on one side; the ranks of the anchor with that much on its left, and on
   its right, are sorted, and a side that is unique is done.
3. rank at the full length: what is open gives a row for each window (rank of the anchor, rank of the window and its
   offset, place). They are sorted; all but the first of equals are resolved.

Each sort is preceded by the same decision within a task's rows, so a passage that a third of the documents share
sends one row from each task. Names that decide are at least 128 bits together (anchor and window).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_batches, byte_column, slices, stored, tidy

ONE, TWO, THREE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Rows that a task gathers before it resolves among them and sends the rest.
FLUSH_ROWS = 1 << 19
#: Symbols of one piece of a document at most (24 bits index a piece).
PIECE = 1 << 22
SLOTS = 1 << 20
SLICE = 1 << 18
NULL_ID = -(1 << 63)
PLACE, OWNER = ["did", "tag", "at"], ["odid", "otag", "oat"]
CANDIDATE, RESOLVED, OPEN = 0, 1, 2


@dataclass(frozen=True)
class Spec:
    """length: of a window; anchor: k; by_document: a first occurrence is first by document only, not by place within it.

    owners: resolved rows say whose window they repeat. symbols: a text's 64-bit symbol names.
    """

    length: int
    anchor: int
    by_document: bool
    owners: bool
    symbols: Callable[[bytes], np.ndarray]

    @property
    def place(self) -> list[str]:
        return [*PLACE, *(OWNER if self.owners else [])]

    @property
    def columns(self) -> list[str]:
        return ["h", "c", *self.place, "state"]

    @property
    def schema(self) -> str:
        return ", ".join(f"{x} long" for x in self.columns)

    @property
    def half(self) -> int:
        return (self.length - self.anchor + 1) // 2

    @property
    def reach(self) -> int:
        return self.length - self.anchor + 1


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of pairs."""
    x = a * ONE + b * TWO
    x ^= x >> np.uint64(29)
    x *= THREE
    x ^= x >> np.uint64(32)
    return x


def ranks(symbols: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """For each length (ascending) the rank of every substring of that length, by doubling."""
    out, size, now = [], 1, symbols
    for n in lengths:
        while size * 2 <= n:
            now = pair(now[:-size], now[size:]) if len(now) > size else now[:0]
            size *= 2
        over = n - size
        out.append(now if not over else pair(now[:-over], now[over:]) if len(now) > over else now[:0])
    return out


def least_in_windows(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values, in linear time."""
    n = len(values)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(rows, w)
    left = np.minimum.accumulate(grid, 1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


_INDEX = np.uint64((1 << 24) - 1)


def anchors(spec: Spec, symbols: np.ndarray, ends: np.ndarray):
    """symbols: pieces in a row, which end at ends. Per run of windows: first and last window, anchor, and both ranks."""
    small, full = ranks(symbols, [spec.anchor, spec.length])
    if not len(full):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    values = ((small * TWO) & ~_INDEX) | np.arange(len(small), dtype=np.uint64)
    at = (least_in_windows(values, spec.reach) & _INDEX).astype(np.int64)[: len(full)]
    valid = np.zeros(len(full), bool)
    begins = np.append(0, ends[:-1])
    for a, b in zip(begins, ends):
        if b - a >= spec.length:
            valid[a : b - spec.length + 1] = True
    windows = np.flatnonzero(valid)
    own = at[windows]
    cut = np.flatnonzero((own[1:] != own[:-1]) | (windows[1:] != windows[:-1] + 1)) + 1
    low, high = windows[np.append(0, cut)[: len(windows)]], windows[np.append(cut - 1, len(windows) - 1)[: len(windows)]]
    p = at[low]
    spread = ((p - low) << 12 | (p - high)).astype(np.uint64)
    return low, high, p, small[p], pair(pair(full[low], full[high]), spread)


def pack(p, left, right):
    """The place of an anchor and its run: windows p - left to p - right."""
    return p << 24 | left << 12 | right


def unpack(at):
    """First and last window of an anchor's run."""
    p = at >> 24
    return p - (at >> 12 & 4095), p - (at & 4095)


def as_span(at):
    """The same windows as a resolved row has them: the first one, and their number."""
    low, high = unpack(at)
    return low << 24 | (high - low + 1)


def span(at):
    """First and last window of a resolved row."""
    low = at >> 24
    return low, low + (at & 0xFFFFFF) - 1


def _resolve(spec: Spec, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sorted rows, equal (h, c) together and first by (did, at): marks those that repeat an earlier one."""
    n = len(rows["h"])
    new = np.ones(n, bool)
    new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["c"][1:] != rows["c"][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    later = rows["did"] > rows["did"][first]
    if not spec.by_document:
        later |= (rows["did"] == rows["did"][first]) & (rows["at"] > rows["at"][first])
    rows["state"] = np.where(later, RESOLVED, rows["state"])
    if spec.owners:
        for own, name in (("odid", "did"), ("otag", "tag")):
            rows[own] = np.where(later, rows[name][first], rows[own])
        rows["oat"] = np.where(later, as_span(rows["at"][first]), rows["oat"])
    rows["at"] = np.where(later, as_span(rows["at"]), rows["at"])
    return rows


def _merged(spec: Spec, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Resolved rows with those that follow on in a document (and in its owner) made one; dealt by document."""
    if not len(rows["at"]):
        return rows
    rows = _take(rows, np.lexsort((rows["at"], rows["tag"], rows["did"])))
    low, high = span(rows["at"])
    on = (rows["did"][1:] == rows["did"][:-1]) & (rows["tag"][1:] == rows["tag"][:-1]) & (low[1:] == high[:-1] + 1)
    if spec.owners:
        own_low, own_high = span(rows["oat"])
        on &= (rows["odid"][1:] == rows["odid"][:-1]) & (rows["otag"][1:] == rows["otag"][:-1]) & (own_low[1:] == own_high[:-1] + 1)
    starts = np.append(0, np.flatnonzero(~on) + 1)
    n = np.add.reduceat(high - low + 1, starts)
    rows = _take(rows, starts)
    fits = n < 1 << 24
    assert fits.all(), "a piece has fewer windows"
    rows["at"] = rows["at"] >> 24 << 24 | n
    if spec.owners:
        rows["oat"] = rows["oat"] >> 24 << 24 | n
    rows["h"] = pair(rows["did"].view(np.uint64), rows["at"].view(np.uint64)).view(np.int64)
    rows["c"] = np.zeros(len(n), np.int64)
    return rows


def _take(rows: dict[str, np.ndarray], at) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in rows.items()}


def _join(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _new(spec: Spec, h, c, did, tag, at) -> dict[str, np.ndarray]:
    n = len(at)
    values = {"h": h.view(np.int64), "c": c.view(np.int64), "did": np.full(n, did), "tag": np.full(n, tag), "at": at}
    return {k: values.get(k, np.zeros(n, np.int64)) for k in spec.columns}


def _batch(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in rows.values()], names=list(rows))


class Gather:
    """Collects a task's rows and resolves among them before they are sent."""

    def __init__(self, spec: Spec):
        self.spec, self.parts, self.n = spec, [], 0

    def add(self, rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.parts.append(rows)
        self.n += len(rows["h"])
        if self.n >= FLUSH_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        rows = _join(self.parts)
        rows = _resolve(self.spec, _take(rows, np.lexsort((rows["at"], rows["did"], rows["c"], rows["h"]))))
        done = rows["state"] == RESOLVED
        rows = _join([_merged(self.spec, _take(rows, done)), _take(rows, ~done)])
        self.parts, self.n = [], 0
        for a in range(0, len(rows["h"]), 1 << 16):
            yield _batch(_take(rows, slice(a, a + (1 << 16))))


def pieces(spec: Spec, texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text's index, first symbol's place in it, symbols), cut so that every window is whole in one piece."""
    for k, text in enumerate(texts):
        symbols = spec.symbols(text)
        for a in range(0, max(1, len(symbols) - spec.length + 1), PIECE):
            yield k, a, symbols[a : a + PIECE + spec.length - 1]


def anchor_rows(spec: Spec, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gather = Gather(spec)
    for batch in slices(batches, "text", SLICE):
        did, tag = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("did", "tag"))
        for group in _grouped(pieces(spec, byte_column(batch, "text"))):
            owner = np.array([k for k, _, _ in group])
            start = np.array([a for _, a, _ in group])
            sizes = np.array([len(s) for _, _, s in group])
            ends = np.cumsum(sizes)
            low, high, p, h, c = anchors(spec, np.concatenate([s for _, _, s in group]), ends)
            which = np.searchsorted(ends, low, "right")
            place = pack(p - (ends - sizes)[which] + start[which], p - low, p - high)
            rows = _new(spec, h, c, 0, 0, place)
            rows["did"], rows["tag"] = did[owner[which]], tag[owner[which]]
            yield from gather.add(rows)
    yield from gather.flush()


def _grouped(found: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    group, n = [], 0
    for x in found:
        group.append(x)
        n += len(x[2])
        if n >= SLICE:
            yield group
            group, n = [], 0
    if group:
        yield group


def side_rows(spec: Spec, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of did, tag, text and places (the open runs): rank and place of both sides of each.

    Within the task's rows, those that share a rank are decided (RESOLVED) and one of them goes on to meet other tasks' (OPEN).
    """
    parts: list[dict[str, np.ndarray]] = []
    n = 0

    def flush():
        rows = _join(parts)
        rows = _take(rows, np.lexsort((rows["at"], rows["did"], rows["h"])))
        same = rows["h"][1:] == rows["h"][:-1]
        shared = np.append(same, False) | np.append(False, same)
        rows["state"] = np.where(shared, RESOLVED, CANDIDATE)
        met = _take(rows, shared & ~np.append(False, same))
        met["state"] = np.full(len(met["h"]), OPEN)
        rows["h"] = np.where(shared, pair(rows["did"].view(np.uint64), rows["at"].view(np.uint64)).view(np.int64), rows["h"])
        yield _batch(_join([rows, met]))

    half = spec.half
    for batch in slices(batches, "text", SLICE):
        texts, places = byte_column(batch, "text"), batch.column("places")
        did, tag = (batch.column(x).to_pylist() for x in ("did", "tag"))
        for k, text in enumerate(texts):
            at = np.sort(places[k].values.to_numpy())
            symbols = spec.symbols(text)
            for a in range(0, max(1, len(symbols)), PIECE):
                p = (at >> 24) - a
                mine = (p >= 0) & (p < PIECE)
                low = max(0, a - half)
                (wide,) = ranks(symbols[low : a + PIECE + spec.anchor + half], [spec.anchor + half])
                for side, first in ((0, p - half), (1, p)):
                    ok = mine & (first + a >= 0) & (first + a - low < len(wide))
                    if ok.any():
                        h = pair(wide[first[ok] + a - low], np.full(1, side + 1, np.uint64))
                        parts.append(_new(spec, h, np.zeros(len(h), np.uint64), did[k], tag[k], at[ok] << 1 | side))
                        n += len(h)
            if n >= FLUSH_ROWS:
                yield from flush()
                parts, n = [], 0
    if n:
        yield from flush()


def shared_sides(spec: Spec, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by h: the sides whose rank another row has too."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in spec.columns}
        if carry:
            rows = _join([carry, rows])
        same = rows["h"][1:] == rows["h"][:-1]
        met = np.append(same, False) | np.append(False, same)
        out = (rows["state"] == RESOLVED) | (rows["state"] == CANDIDATE) & met
        carry = _take(rows, slice(-1, None))  # the last row may yet be met; if it was sent it only waits for others
        if not out[-1] and rows["state"][-1] == CANDIDATE:
            pass
        else:
            carry["state"] = np.full(1, OPEN)
        if out.any():
            yield _batch(_take(rows, out))


def window_rows(spec: Spec, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of did, tag, text and sides (the open runs' shared sides): a row for each of their windows."""
    gather = Gather(spec)
    half = spec.half
    for batch in slices(batches, "text", SLICE):
        texts, sides = byte_column(batch, "text"), batch.column("sides")
        did, tag = (batch.column(x).to_pylist() for x in ("did", "tag"))
        for k, text in enumerate(texts):
            found = np.unique(sides[k].values.to_numpy())
            at, first = np.unique(found >> 1, return_index=True)
            left = (found[first] & 1) == 0
            right = np.isin(at << 1 | 1, found)
            symbols = spec.symbols(text)
            low, high = unpack(at)
            for a in range(0, max(1, len(symbols)), PIECE):
                mine = np.flatnonzero((low >= a) & (low < a + PIECE))
                if not len(mine):
                    continue
                small, full = ranks(symbols[a : a + PIECE + 2 * spec.length], [spec.anchor, spec.length])
                n = high[mine] - low[mine] + 1
                own = np.repeat(mine, n)
                s = low[own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                p = at[own] >> 24
                reach = p - s
                ok = ((reach < half) | left[own]) & ((reach > spec.length - spec.anchor - half) | right[own])
                s, p = s[ok], p[ok]
                yield from gather.add(_new(spec, small[p - a], pair(full[s - a], (p - s).astype(np.uint64)), did[k], tag[k], pack(s, 0, 0)))
    yield from gather.flush()


def resolved(spec: Spec, batches: Iterable[pa.RecordBatch], keep_open: bool) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (h, c, did, at): resolved rows, and open ones where an anchor has several runs.

    Between batches only the first row of the current class, of the current anchor's first class and that
    anchor's undecided rows in the same place are carried.
    """
    carry: list[dict[str, np.ndarray]] = []
    ghosts = 0  # carried rows in front that were sent, or are sent later, by their copies

    def decided(rows: dict[str, np.ndarray], ghosts: int):
        n = len(rows["h"])
        rows = _resolve(spec, rows)
        new = np.ones(n, bool)
        new[1:] = rows["h"][1:] != rows["h"][:-1]
        starts = np.flatnonzero(new)
        other = ~new
        other[1:] &= rows["c"][1:] != rows["c"][:-1]
        several = np.repeat(np.add.reduceat(other.astype(np.int32), starts) > 0, np.diff(np.append(starts, n)))
        real = np.arange(n) >= ghosts
        waiting = real & (rows["state"] == CANDIDATE)
        opened = waiting & several & keep_open
        sent = _take(rows, real & (rows["state"] == RESOLVED) | opened)
        sent["state"] = np.where(sent["state"] == CANDIDATE, OPEN, sent["state"])
        start = starts[-1]
        change = np.flatnonzero(other[start:])
        heads = np.unique([start, start + change[-1] if len(change) else start])
        undecided = start + np.flatnonzero(waiting[start:] & ~several[start:]) if keep_open else np.zeros(0, np.int64)
        return sent, [_take(rows, np.append(heads, undecided))], len(heads)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in spec.columns}
        sent, carry, ghosts = decided(_join([*carry, rows]), ghosts)
        if len(sent["h"]):
            yield _batch(sent)


def keyed(docs: DataFrame) -> DataFrame:
    """did (null id: the smallest long), tag, text and the given columns.

    tag tells documents that repeat an id apart: a hash of the text where the id may be repeated (by a bitmap of
    SLOTS hashed ids that are, so its size is bounded), else 0.
    """
    bounded_batches(docs.sparkSession)
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    slot = F.pmod(F.xxhash64("did"), F.lit(SLOTS)).cast("int")
    rows = docs.withColumns({"did": did, "text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    often = rows.groupBy("did").count().filter("count > 1").select(slot.alias("slot")).distinct().collect()
    if not often:
        return rows.withColumn("tag", F.col("did") % 1)  # zero, but no literal: then both joins below have one exchange
    marked = docs.sparkSession.createDataFrame([(r["slot"],) for r in often], "slot int").withColumn("again", F.lit(True))
    rows = rows.withColumn("slot", slot).join(F.broadcast(marked), "slot", "left")
    return rows.withColumn("tag", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.col("did") % 1)).drop("slot", "again")


def repeats(spec: Spec, rows: DataFrame) -> DataFrame:
    """rows: keyed(). Resolved places of all documents: did, tag, at, and the owners' if asked for.

    Rows that repeat an id and its text have one set of places between them, which each of them gets.
    """
    text = rows.select("did", "tag", "text")

    def sort(df: DataFrame) -> DataFrame:
        return df.repartition("h").sortWithinPartitions("h", "c", "did", "at")

    found = text.mapInArrow(tidy(lambda b: anchor_rows(spec, b)), spec.schema)
    runs = stored(sort(found).mapInArrow(tidy(lambda b: resolved(spec, b, True)), spec.schema).select(*spec.place, "state"), "runs")
    open_ = runs.filter(F.col("state") == OPEN).groupBy("did", "tag").agg(F.collect_set("at").alias("places"))
    # all columns of rows: then these joins and one of the caller's on the same keys share the texts' exchange
    halves = rows.join(open_, ["did", "tag"]).mapInArrow(tidy(lambda b: side_rows(spec, b)), spec.schema)
    halves = halves.repartition("h").sortWithinPartitions("h", "did", "at").mapInArrow(tidy(lambda b: shared_sides(spec, b)), spec.schema)
    sides = halves.groupBy("did", "tag").agg(F.collect_set("at").alias("sides"))
    windows = rows.join(sides, ["did", "tag"]).mapInArrow(tidy(lambda b: window_rows(spec, b)), spec.schema)
    single = sort(windows).mapInArrow(tidy(lambda b: resolved(spec, b, False)), spec.schema)
    return runs.filter(F.col("state") == RESOLVED).select(*spec.place).union(single.filter(F.col("state") == RESOLVED).select(*spec.place))


def covered(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """Which of n symbols the windows at these places cover."""
    low, high = span(at)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, np.minimum(low, n), 1)
    np.add.at(delta, np.minimum(high + length, n), -1)
    return np.cumsum(delta[:-1]) > 0
