"""Operator 1: byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. Every codepoint becomes a symbol (its class, with what the
pattern looks ahead to folded in), every symbol is a function on the eight states of a small automaton, and
an associative scan over these functions (blocks first, then doubling over the blocks' compositions) gives
the state in front of every codepoint, and with it the token boundaries. The byte slices between boundaries
go through a cache of merged pre-tokens; a miss merges byte pairs by rank.

Defined cases: a null text is empty and has no tokens; bytes that aren't UTF-8 are replaced as Python's
decoder replaces them; equal rows give equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidelog.llm.common import byte_column, doc_rows, record_batch, slices, tidy

LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
#: Symbols 0 to 2 are LETTER, NUMBER and OTHER. QUOTE1 and QUOTE2: an apostrophe before a contraction's one or
#: two letters. SPACE_LAST and WHITE_LAST: white space before a visible codepoint; WHITE_MID: all other.
QUOTE1, QUOTE2, SPACE_LAST, WHITE_LAST, WHITE_MID = range(3, 8)
#: States: what the last codepoint was part of. FRESH: the next codepoint starts a token in any case.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, PREFIX, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
BLOCK = 64
CACHE_ENTRIES = 400_000
#: White space as the Unicode property White_Space has it (fixed values).
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def codepoint_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = WHITE
    out[0x20] = SPACE
    return out


@cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, boundary in front), each by symbol * 8 + state; symbols from 8 on are the first of a text."""
    step, cut = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for symbol in range(8):
        for state in range(8):
            if state in (ONE_MORE, TWO_MORE):
                to, new = (FRESH if state == ONE_MORE else ONE_MORE), False
            elif symbol in run:
                to, new = run[symbol], state not in (run[symbol], PREFIX)
            elif symbol in (QUOTE1, QUOTE2):
                joined = state in (IN_OTHERS, PREFIX)
                to, new = (IN_OTHERS if joined else ONE_MORE if symbol == QUOTE1 else TWO_MORE), not joined
            elif symbol == WHITE_MID:
                to, new = IN_WHITE, state != IN_WHITE
            else:
                to, new = (PREFIX if symbol == SPACE_LAST else FRESH), True
            step[symbol, state], cut[symbol, state] = to, new
        step[symbol + 8], cut[symbol + 8] = step[symbol, FRESH], True
    return step.ravel(), cut.ravel()


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """points: codepoints of some texts in a row; first: whether each begins a text."""
    kind = codepoint_classes()[points]
    n = len(points)
    after = np.full(n, OTHER, np.uint8)
    after[:-1] = kind[1:]
    ends = np.ones(n, bool)
    ends[:-1] = first[1:]
    white = kind >= SPACE
    out = kind.copy()
    out[white] = WHITE_MID
    last = white & ~ends & (after < SPACE)
    out[last & (kind == SPACE)] = SPACE_LAST
    out[last & (kind == WHITE)] = WHITE_LAST
    quotes = np.flatnonzero((points == ord("'")) & ~ends)
    if len(quotes):
        x = points[quotes + 1]
        out[quotes[np.isin(x, [ord(c) for c in "stmd"])]] = QUOTE1
        far = quotes[(quotes + 2 < n)]
        far = far[~first[far + 2]]
        pairs = points[far + 1].astype(np.int64) << 21 | points[far + 2]
        out[far[np.isin(pairs, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])]] = QUOTE2
    return out + (first.astype(np.uint8) << 3)


def boundaries(symbol: np.ndarray) -> np.ndarray:
    """Whether a token starts at each codepoint."""
    step, cut = automaton()
    n = len(symbol)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, WHITE_MID, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T) << 3
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        whole = step[column[:, None] | whole]
    reach = 1
    while reach < rows:  # inclusive scan of the blocks' functions by doubling
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].astype(np.intp), 1)
        reach *= 2
    state = np.full(rows, FRESH, np.uint8)
    state[1:] = whole[:-1, FRESH]
    out = np.empty((BLOCK, rows), bool)
    for j, column in enumerate(grid):
        at = column | state
        out[j] = cut[at]
        state = step[at]
    return out.T.ravel()[:n]


def token_starts(texts: list[bytes]) -> tuple[bytes, list[np.ndarray]]:
    """All texts' bytes joined; per text its pre-tokens' byte offsets there, and its end at last."""
    joined = b"".join(texts)
    at = np.cumsum([0, *map(len, texts)])
    if not joined:
        return joined, [np.array([0]) for _ in texts]
    raw = np.frombuffer(joined, np.uint8)
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(joined.decode().encode("utf-32-le"), "<u4")
    first = np.zeros(len(points), bool)
    first[np.searchsorted(begins, at[:-1][np.diff(at) > 0])] = True
    starts = begins[boundaries(symbols(points, first))]
    edge = np.searchsorted(starts, at)
    return joined, [np.append(starts[a:b], e) if b > a else np.array([e]) for a, b, e in zip(edge[:-1], edge[1:], at[1:])]


class Merges(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers. Emptied when it has CACHE_ENTRIES."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        found = np.array(self.merge(word), "<u4").tobytes()
        if len(word) <= 256:
            self[word] = found
        return found

    def merge(self, word: bytes) -> list[int]:
        """Lowest rank first, then leftmost; a heap keeps long pre-tokens at n log n."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := get(word[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [self.ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def encode_texts(texts: list[bytes], merges: Merges) -> list[np.ndarray]:
    clean = []
    for x in texts:
        try:
            x.decode()
        except UnicodeDecodeError:
            x = x.decode("utf-8", "replace").encode()
        clean.append(x)
    joined, starts = token_starts(clean)
    out = []
    for at in starts:
        cuts = at.tolist()
        out.append(np.frombuffer(b"".join([merges[joined[a:b]] for a, b in zip(cuts, cuts[1:])]), "<u4"))
    return out


#: What encode() adds: ids, and each token's first byte in the text.
ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.IntegerType()))])
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32()))])
DECODED = T.StructType([*ENCODED.fields, T.StructField("decoded", T.BinaryType())])
_DECODED = pa.schema([*_ENCODED, ("decoded", pa.binary())])
DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.empty(0, np.int32), *arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


class Codec:
    """Encoder and decoder over Arrow batches; one for a worker's task."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token
        self.lengths = np.array([len(x) for x in self.pieces], np.int32)

    def encode(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = encode_texts(byte_column(batch, "text"), self.merges)
            sizes = [self.lengths[x] for x in ids]
            yield record_batch(_ENCODED, [batch.column("doc_id"), _lists(ids), _lists([np.cumsum(x) - x for x in sizes])])

    def decode(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = self.pieces.__getitem__
        for batch in batches:
            ids, offsets = batch.column("ids"), batch.column("offsets")
            flat, ends = ids.flatten().to_pylist(), np.cumsum([0, *[len(x) if x is not None else 0 for x in ids]]).tolist()
            yield record_batch(_DECODED, [batch.column("doc_id"), ids, offsets, [b"".join(map(piece, flat[a:b])) for a, b in zip(ends, ends[1:])]])


def _codec(spark, path: str):
    """The vocabulary (under 1 MB, whatever the documents are) read by the driver and broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the tokens' byte offsets of every text."""
    raw = _codec(docs.sparkSession, path)

    def run(batches):
        yield from Codec(read_ranks(raw.value)).encode(batches)

    return doc_rows(docs).mapInArrow(tidy(run), ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encode()'s rows with the bytes that their ids stand for."""
    raw = _codec(encoded.sparkSession, path)

    def run(batches):
        yield from Codec(read_ranks(raw.value)).decode(batches)

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(tidy(run), DECODED)


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode, then decode the ids, in one pass of each partition; digests of both, and the ids too if asked for."""
    raw = _codec(docs.sparkSession, path)

    def run(batches):
        codec = Codec(read_ranks(raw.value))
        for batch in codec.decode(codec.encode(batches)):
            ids = [np.frombuffer(b"", "<u4") if x.values is None else x.values.to_numpy() for x in batch.column("ids")]
            more = [batch.column("ids")] if with_ids else []
            digest = record_batch(_DIGESTS, [batch.column("doc_id"), [len(x) for x in ids], [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in batch.column("decoded").to_pylist()]])
            yield pa.RecordBatch.from_arrays([*digest.columns, *more], names=schema.names)

    schema = T.StructType([*DIGESTS.fields, *([ENCODED["ids"]] if with_ids else [])])
    return doc_rows(docs).mapInArrow(tidy(run), schema)
