"""Operator 2 for similar texts: SimHash near-duplicates by sets of five-word shingles, a Jaccard similarity of 0.8 or more.

Two sets at 0.8 differ in 15 % of their SimHash bits (up to 19 % for the smallest sets), which touches every byte of a
64-bit fingerprint. So fingerprints have WIDTH bytes here, of which such a pair shares 27 % (19 %), and the byte-position
inverted index has three positions a key, as in simhash.py:

* The index: KEYS triples of positions, each position in three of them at most; texts of SHORT shingles or fewer have all
  TRIPLES. Postings of a task meet there first, packed; only postings that two distinct sets share leave the index.
* Candidates of one posting differ in at most CARRIED_BITS of the 128 bits that rows carry. Rows without such a partner in
  their posting go no further.
* Parities: bit i of a set's parity is the number of its shingles whose name ends in i, modulo 2. Sets that differ in D
  shingles have parities that differ in D bits at most, and at 0.8 D is at most a ninth of both sizes together. So this test
  loses no pair, and with PARITY bits a shingle few pairs below 0.75 pass it.
* The count filter: a pair shares at least NEEDED positional bytes of all WIDTH, and differs in at most MOST_BITS bits
  (FEWER_BITS from LARGE shingles on).
* Verification: the whole sets' Jaccard similarity, exactly.

All but the exact ones are set so that they lose next to nothing at 0.8 (some 0.7 % of pairs at exactly 0.8 share no key, 0.1 % at
0.83, none to speak of above) and nothing below 0.8 links.

Sets, not documents, are compared: copies meet in one row first. Then, STARS times at most, each task writes a forest of the
candidates of its postings (each set with the middle of its posting first), of which each set's likeliest pair is verified, and components are formed. At
last all candidates of different components are verified, which is what the forests' false pairs have left. So a large
group of near-copies makes no square of its size in rows: a forest has fewer pairs than its task has rows.

Defined cases: a text of fewer than five words has one shingle, all its words; texts without words are equal; letters
A-Z are lower-cased and words split at ASCII white space, as in operator 2; null ids and rows that repeat an id take
part as rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import byte_column, discard, doc_rows, record_batch, shuffle_partitions, slices, stored, tidy
from tidelog.llm.components import connected

SHINGLE, SEED = 5, 42
WIDTH, KEYS, TRIPLES_ALL, SHORT = 264, 256, 1056, 20
NEEDED, MOST_BITS, FEWER_BITS, LARGE, CARRIED_BITS = 24, 480, 400, 64, 46
#: Bits of parity for a shingle (up to twice that), and bytes of a parity at most and of parities compared at once.
PARITY, PARITY_BYTES, COMPARED_BYTES = 4, 1 << 10, 4 << 20
#: Rounds of forests; pairs compared at once; rows of postings taken together; pairs sorted at once; odd() of pairs that are joined unsorted.
STARS, BLOCK, CHUNK, CHOSEN, SURE = 2, 1 << 16, 1 << 13, 1 << 18, 0.9
WORDS_KEPT, ROWS_AT_ONCE, POSTINGS_AT_ONCE = 1 << 17, 255, 1 << 20
#: Entries of a bucket of the index, of which a task holds one at a time.
BUCKET = 1 << 20
_RANDOM = np.random.default_rng(7)
FACTORS = _RANDOM.integers(0, 1 << 64, WIDTH // 8, np.uint64) | np.uint64(1)
MASKS = _RANDOM.integers(0, 1 << 64, WIDTH // 8, np.uint64)
PLACES = _RANDOM.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)
TRIPLES = np.concatenate([_RANDOM.permutation(WIDTH) for _ in range(3 * TRIPLES_ALL // WIDTH)]).reshape(-1, 3)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Names(dict):
    """Word -> its 64-bit name. Emptied when it has WORDS_KEPT."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        name = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= 64:
            self[word] = name
        return name


def shingles(text: bytes, known: Names) -> np.ndarray:
    """Sorted distinct 64-bit names of the shingles."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += h[k : k + n] * PLACES[k]
    return np.unique(_mixed(total))


def wide(found: np.ndarray) -> bytes:
    """The SimHash of WIDTH bytes: a bit is 1 if set in over half of the shingles' hashes."""
    counts = np.zeros(WIDTH * 8, np.int64)
    for at in range(0, len(found), ROWS_AT_ONCE):  # so many that a byte can count them
        x = (found[at : at + ROWS_AT_ONCE, None] ^ MASKS) * FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9FB21C651E98DF25)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), 0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(found), bitorder="little").tobytes()


def parity(found: np.ndarray) -> bytes:
    """Bits, a power of two of them, that tell whether an odd number of names end in their place."""
    bits = min(8 * PARITY_BYTES, 1 << max(6, int(PARITY * len(found) - 1).bit_length()))
    counts = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """A parity as if it had been made with ``width`` bytes."""
    x = np.frombuffer(bits, np.uint64)
    while x.nbytes > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _name(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), fp (the set's name), n (its size), the fingerprint, its first 128 bits as s and t, and the parity."""
    out = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("t", pa.int64()), ("bytes", pa.binary()), ("parity", pa.binary())])

    def run(batches):
        known = Names()
        for batch in slices(batches, "text"):
            sets = [shingles(x, known) for x in byte_column(batch, "text")]
            names = np.array([_name(s) for s in sets], np.uint64).view(np.int64)
            prints = [wide(s) for s in sets]
            carried = np.array([np.frombuffer(x[:16], np.int64) for x in prints]).reshape(-1, 2).T
            yield record_batch(out, [batch.column("doc_id"), batch.column("key"), names, [len(s) for s in sets], *carried, prints, [parity(s) for s in sets]])

    rows = doc_rows(docs, F.xxhash64(F.col("text").cast("string")).alias("key"))
    return rows.mapInArrow(tidy(run), "doc_id long, key long, fp long, n long, s long, t long, bytes binary, parity binary")


def keys(prints: np.ndarray, n: int) -> np.ndarray:
    """The first n keys of each fingerprint (rows of bytes): the triple's number and its three bytes in 32 bits.

    Triples from KEYS on, which only small sets have, are hashed to them.
    """
    x = prints[:, TRIPLES[:n]].astype(np.uint64)
    x = x[:, :, 0] << np.uint64(16) | x[:, :, 1] << np.uint64(8) | x[:, :, 2] | np.arange(n, dtype=np.uint64) << np.uint64(24)
    x[:, KEYS:] = _mixed(x[:, KEYS:]) >> np.uint64(32)
    return x.astype(np.uint32)


def index(names: DataFrame, buckets: int) -> DataFrame:
    """key and fp of all postings of two distinct sets or more. names: fp, n, bytes; each set once.

    A task's postings are sorted by key. What it has twice is known to be shared: it leaves at once, and one entry, marked,
    tells the key's bucket. So a bucket gets one entry of a key from a task, however long the key's posting is.
    """
    packed = pa.schema([("bucket", pa.int32()), ("shared", pa.bool_()), ("keys", pa.binary()), ("marks", pa.binary()), ("fps", pa.binary())])
    out = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    salt = np.uint64(0x9E3779B97F4A7C15)

    def pack(parts: list):
        key, fp = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key)
        key, fp = key[order], fp[order]
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        shared = again.copy()
        shared[:-1] |= again[1:]
        rows = []
        if shared.any():
            bucket = int((fp[0] * salt) >> np.uint64(32)) % buckets
            rows.append((bucket, True, key[shared].tobytes(), b"", fp[shared].tobytes()))
        first = ~again
        key, fp, mark = key[first], fp[first], shared[first]
        own = (key.astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)
        cuts = np.append(np.flatnonzero(np.diff(own.astype(np.int64), prepend=-1)), len(key)).tolist()
        rows += [(int(own[a]), False, key[a:b].tobytes(), mark[a:b].tobytes(), fp[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
        return record_batch(packed, [list(x) for x in zip(*rows)])

    def spread(batches):
        parts, held = [], 0
        for batch in batches:
            size, fps = batch.column("n").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            prints = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8).reshape(-1, WIDTH)
            for short, n in ((False, KEYS), (True, TRIPLES_ALL)):
                rows = np.flatnonzero((size > 0) & ((size <= SHORT) == short))
                step = POSTINGS_AT_ONCE // n
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    parts.append((keys(prints[some], n).ravel(), fps[some].repeat(n)))
                    held += len(some) * n
                    if held >= POSTINGS_AT_ONCE:
                        yield pack(parts)
                        parts, held = [], 0
        if parts:
            yield pack(parts)

    def settle(parts: list):
        key, mark, fp = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key)
        key, mark, fp = key[order], mark[order], fp[order]
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        group = np.cumsum(~again) - 1
        wanted = (np.bincount(group) > 1)[group] & ~mark
        return record_batch(out, [key[wanted].astype(np.int64), fp[wanted].view(np.int64)])

    def meet(batches):
        parts, now = [], None
        for batch in batches:
            for bucket, shared, key, mark, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if shared:
                    yield record_batch(out, [np.frombuffer(key, np.uint32).astype(np.int64), np.frombuffer(fp, np.int64)])
                    continue
                if bucket != now and parts:
                    yield settle(parts)
                    parts = []
                now = bucket
                parts.append((np.frombuffer(key, np.uint32), np.frombuffer(mark, bool), np.frombuffer(fp, np.uint64)))
        if parts:
            yield settle(parts)

    rows = names.select("fp", "n", "bytes").mapInArrow(tidy(spread), "bucket int, shared boolean, keys binary, marks binary, fps binary")
    return rows.repartition(shuffle_partitions(names), "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(meet), "key long, fp long")


def sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, fingerprint and the set itself of wanted's texts (key)."""
    out = pa.schema([("fp", pa.int64()), ("bytes", pa.binary()), ("found", pa.binary())])

    def run(batches):
        known = Names()
        for batch in slices(batches, "text"):
            each = [shingles(x, known) for x in byte_column(batch, "text")]
            names = np.array([_name(s) for s in each], np.uint64).view(np.int64)
            yield record_batch(out, [names, [wide(s) for s in each], [s.tobytes() for s in each]])

    rows = doc_rows(docs, F.xxhash64(F.col("text").cast("string")).alias("key")).join(wanted.select("key"), "key", "left_semi")
    return rows.dropDuplicates(["key"]).select("text").mapInArrow(tidy(run), "fp long, bytes binary, found binary")


def alike(one: bytes, two: bytes, left: bytes, right: bytes) -> bool:
    """The count filter over the fingerprints' positional bytes, their bits, then the sets' exact similarity."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    x = a ^ b
    if WIDTH - np.count_nonzero(x.view(np.uint8)) < NEEDED or int(np.bitwise_count(x).sum()) > MOST_BITS:
        return False
    p, q = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    both = np.sort(np.concatenate([p, q]))
    shared = int((both[1:] == both[:-1]).sum())
    return 5 * shared >= 4 * (len(p) + len(q) - shared)


def close(one: bytes, two: bytes, n: int, m: int) -> bool:
    """The count filter over the fingerprints' positional bytes, then their bits; larger sets stray less."""
    x = np.frombuffer(one, np.uint64) ^ np.frombuffer(two, np.uint64)
    most = FEWER_BITS if min(n, m) >= LARGE else MOST_BITS
    return WIDTH - np.count_nonzero(x.view(np.uint8)) >= NEEDED and int(np.bitwise_count(x).sum()) <= most


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) that are alike. Only what passes by its fingerprints is joined to the sets, which are larger."""

    def keep(test):
        def run(batches):
            for batch in batches:
                a, b, *each = (column.to_pylist() for column in batch.columns)
                kept = [k for k, x in enumerate(zip(*each)) if test(*x)]
                yield record_batch(_PAIRS, [[a[k] for k in kept], [b[k] for k in kept]])

        return tidy(run)

    def sides(rows: DataFrame, *columns: str) -> DataFrame:
        for key in ("a", "b"):
            rows = rows.join(members.select(F.col("fp").alias(key), *[F.col(c).alias(f"{c}_{key}") for c in columns]), key)
        return rows.select("a", "b", *[f"{c}_{key}" for c in columns for key in ("a", "b")])

    members = members.withColumn("n", (F.octet_length("found") / 8).cast("int"))
    likely = sides(pairs, "bytes", "n").mapInArrow(keep(close), "a long, b long")
    return sides(likely, "bytes", "found").mapInArrow(keep(alike), "a long, b long")


def near(x: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the rows p and q have sizes that 0.8 allows, and carried bits that differ little."""
    n, m = x["n"][p], x["n"][q]
    apart = sum(np.bitwise_count((x[f][p] ^ x[f][q]).view(np.uint64)).astype(np.int32) for f in ("s", "t"))
    return (n * 5 >= m * 4) & (m * 5 >= n * 4) & (apart <= CARRIED_BITS)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_TREES = pa.schema([*_PAIRS, ("share", pa.float64())])
_POSTINGS = pa.schema([("key", pa.int64()), ("fp", pa.int64())])


def postings(batches):
    """Whole postings, CHUNK rows or more together; batches are sorted by key."""
    parts: list[dict] = []
    held = 0
    whole = lambda: {f: np.concatenate([y[f] for y in parts]) for f in parts[0]}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = {f: batch.column(f).to_numpy(zero_copy_only=False) for f in batch.schema.names}
        if held >= CHUNK:
            cut = int(np.searchsorted(x["key"], parts[-1]["key"][-1], "right"))
            parts.append({f: v[:cut] for f, v in x.items()})
            x = {f: v[cut:] for f, v in x.items()}
            if not len(x["key"]):
                continue
            yield whole()
            parts, held = [], 0
        parts.append(x)
        held += len(x["key"])
    if parts:
        yield whole()


def starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    new = np.ones(len(sorted_by[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_by])
    return new


def middles(x: dict[str, np.ndarray]) -> np.ndarray:
    """For each row, the row of its posting whose carried bits are nearest to the posting's majority: of copies of one text most likely that text."""
    new = starts(x["key"])
    first, which = np.flatnonzero(new), np.cumsum(new) - 1
    bits = np.unpackbits(np.stack([x["s"], x["t"]], 1).view(np.uint8), axis=1)
    most = np.add.reduceat(bits, first, 0, np.int64) * 2 > np.bincount(which)[:, None]
    apart = (bits != most[which]).sum(1)
    return (np.minimum.reduceat(apart << 32 | np.arange(len(apart)), first) & 0xFFFFFFFF)[which]


def paired(key: np.ndarray, late: np.ndarray):
    """All pairs (row numbers) of a key but those of two late rows, once each, in blocks."""
    order = np.lexsort((late, key))
    key, at, lag = key[order], np.flatnonzero(~late[order]), 1
    while len(at):
        step = max(1, BLOCK // len(at))
        q = at[:, None] + np.arange(lag, lag + step)
        same = (q < len(key)) & (key[np.minimum(q, len(key) - 1)] == key[at, None])
        i, j = np.nonzero(same)
        yield order[at[i]], order[q[i, j]]
        at, lag = at[same[:, -1]], lag + step


def partnered(batches):
    """The rows (key, fp) that are near another row of their posting."""
    for x in postings(batches):
        m, rows = middles(x), np.arange(len(x["key"]))
        found = (m != rows) & near(x, rows, m)
        found[m[found]] = True
        for p, q in paired(x["key"], found):
            ok = near(x, p, q)
            found[p[ok]] = found[q[ok]] = True
        yield record_batch(_POSTINGS, [x[f][found] for f in ("key", "fp")])


def odd(x: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bits in which the parities of the rows p and q differ, as a share of what 0.8 allows."""
    size = np.array([len(bits) for bits in x["parity"]])
    width, out = np.minimum(size[p], size[q]), np.zeros(len(p))
    for w in np.unique(width).tolist():
        some = np.flatnonzero(width == w)
        rows, place = np.unique(np.concatenate([p[some], q[some]]), return_inverse=True)
        bits = np.stack([folded(y, w) for y in x["parity"][rows]])
        for at in range(0, len(some), COMPARED_BYTES // w):
            i = np.arange(at, min(at + COMPARED_BYTES // w, len(some)))
            out[some[i]] = np.bitwise_count(bits[place[i]] ^ bits[place[len(some) + i]]).sum(1, dtype=np.int64)
    return 9 * out / (x["n"][p] + x["n"][q])


def candidates(x: dict[str, np.ndarray], root: np.ndarray):
    """The candidate pairs (row numbers) of different roots, and their odd(). Rows of a posting's commonest root aren't paired among themselves."""
    order = np.lexsort((root, x["key"]))
    new = starts(x["key"][order], root[order])
    first, run = np.flatnonzero(new), np.cumsum(new) - 1
    key, size = x["key"][order][first], np.bincount(run)
    by_size = np.lexsort((size, key))
    commonest = np.zeros(len(first), bool)
    commonest[by_size[np.append(key[by_size][1:] != key[by_size][:-1], True)]] = True
    late = np.zeros(len(root), bool)
    late[order] = commonest[run]
    for p, q in paired(x["key"], late):
        ok = root[p] != root[q]
        p, q = p[ok], q[ok]
        ok = near(x, p, q)
        p, q = p[ok], q[ok]
        share = odd(x, p, q)
        ok = share <= 1
        if ok.any():
            yield p[ok], q[ok], share[ok]


def forest(batches):
    """Of the candidates of a task's postings, pairs that connect as much as all of them; the likeliest first."""
    above: dict[int, int] = {}

    def top(a: int) -> int:
        while (b := above.get(a, a)) != a:
            above[a] = above.get(b, b)
            a = b
        return a

    def joined(x, p, q, share):
        a, b, kept = [], [], []
        for i in np.argsort(share, kind="stable").tolist():
            u, v = top(int(x["root"][p[i]])), top(int(x["root"][q[i]]))
            if u != v:
                above[max(u, v)] = min(u, v)
                a.append(p[i])
                b.append(q[i])
                kept.append(share[i])
        return record_batch(_TREES, [*(x["fp"][np.array(y, np.int64)] for y in (a, b)), kept])

    for x in postings(batches):
        m, p = middles(x), np.arange(len(x["key"]))
        p = p[(x["root"] != x["root"][m]) & near(x, p, m)]
        share = odd(x, p, m[p])
        sure = share <= SURE
        yield joined(x, p[sure], m[p[sure]], share[sure])
        parts, held = [], 0
        for part in candidates(x, np.array([top(r) for r in x["root"].tolist()])):
            parts.append(part)
            held += len(part[0])
            if held >= CHOSEN:
                yield joined(x, *(np.concatenate(y) for y in zip(*parts)))
                parts, held = [], 0
        if parts:
            yield joined(x, *(np.concatenate(y) for y in zip(*parts)))
        if len(above) > CHOSEN:  # later postings may name connected rows again
            above.clear()


def crossed(batches):
    """All candidates of different components."""
    for x in postings(batches):
        for p, q, _ in candidates(x, x["root"]):
            yield record_batch(_PAIRS, [x["fp"][p], x["fp"][q]])


def links(names: DataFrame, docs: DataFrame) -> DataFrame:
    """names: distinct sets (fp, key, n, s, t, bytes, parity). Links that connect every candidate pair of 0.8 or more, not each such pair."""
    buckets = max(shuffle_partitions(docs), -(-names.count() * KEYS // BUCKET))

    def by_key(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("key", F.explode("keys")).drop("keys")
        return rows.repartition(shuffle_partitions(docs), "key").sortWithinPartitions("key")

    def with_keys(found: DataFrame, *columns: str) -> DataFrame:
        keys = found.groupBy("fp").agg(F.collect_set("key").alias("keys"))  # TRIPLES_ALL keys at most
        return stored(keys.join(names.select("fp", "n", "s", "t", *columns), "fp"), "postings")

    shared = with_keys(index(names, buckets))
    rows = with_keys(by_key(shared).mapInArrow(tidy(partnered), "key long, fp long"), "parity")
    discard(shared)
    found, linked, k = docs.sparkSession.createDataFrame([], "a long, b long"), 0, 0
    while True:
        own = rows.withColumn("root", F.col("fp"))
        if linked:
            roots = connected(found).select(F.col("node").alias("fp"), F.col("root").alias("_root"))
            own = rows.join(roots, "fp", "left").withColumn("root", F.coalesce("_root", "fp")).drop("_root")
        if k < STARS:  # of all tasks' forests, each set's likeliest pair
            trees = by_key(own).mapInArrow(tidy(forest), "a long, b long, share double")
            ends = F.array(F.struct("a", "b", "share"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "share"))
            pairs = trees.select(F.explode(ends).alias("end")).select("end.*").groupBy("a").agg(F.min_by("b", F.struct("share", "b")).alias("b"))
        else:
            pairs = by_key(own).mapInArrow(tidy(crossed), "a long, b long")
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        before = linked
        if not pairs.isEmpty():
            asked = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
            members = stored(sets(docs, names.select("fp", "key").join(asked, "fp")).dropDuplicates(["fp"]), "sets")
            old, found = found, stored(found.union(verified(pairs, members)), "verified")
            linked = found.count()
            discard(members, *([old] if before else []))
        discard(pairs)
        if k == STARS:
            discard(rows)
            return found
        k = k + 1 if linked > before else STARS


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, fp of every document; fp and root (the name of the group's smallest set) of every distinct set."""
    whole = stored(sketches(docs), "sketches")
    names = stored(whole.groupBy("fp").agg(F.min("key").alias("key"), *(F.first(x).alias(x) for x in ("n", "s", "t", "bytes", "parity"))), "names")
    found = stored(whole.select("doc_id", "key", "fp"), "found")
    discard(whole)
    roots = connected(links(names, docs)).withColumnRenamed("node", "fp")
    named = stored(names.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "named")
    discard(names, roots)
    return found, named
