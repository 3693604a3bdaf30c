"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidelog.llm import nearcopies


def brute_kept(texts):
    """texts by id: ids that no smaller id of their component (five-word Jaccard of 0.8 or more) stands for."""
    found = {}
    for d, t in texts.items():
        words = (t or "").encode().lower().split()
        found[d] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    where, root = {}, {d: d for d in texts}
    for d, s in found.items():
        for x in s or [None]:
            where.setdefault(x, []).append(d)

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in found:
        for b in {b for x in found[a] or [None] for b in where[x] if b > a}:
            if 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b]):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {d for d in texts if find(d) == d}


def stage(spark, sf, texts):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    return {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}


def test_stage_drops_near_copies_of_the_tables(spark, sf, texts):
    got = stage(spark, sf, texts)
    assert got == brute_kept(texts)
    assert not {145, 177} & got or len(texts) != 200  # near-copies of 6 (0.833) and 1 (0.830)


@pytest.mark.parametrize("stars", [0, 1, 3])
def test_stage_drops_planted_near_copies(spark, sf, monkeypatch, stars):
    monkeypatch.setattr(nearcopies, "STARS", stars)
    monkeypatch.setattr(nearcopies, "BLOCK", 3)
    monkeypatch.setattr(nearcopies, "POSTINGS_AT_ONCE", 5000)
    r = random.Random(3)
    word = lambda: f"w{r.randrange(5000)}"
    texts = {0: "", 1: None, 2: "one two", 3: "One  two", 4: "one two three four five", 5: "   "}
    for _ in range(25):
        base = [word() for _ in range(r.randrange(20, 300))]
        for _ in range(8):  # about 0.5 to 1
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(copy) // 25)):
                copy[r.randrange(len(copy))] = word()
            texts[len(texts)] = " ".join(copy)
    kept = brute_kept(texts)
    assert 30 < len(kept) < 180
    assert stage(spark, sf, texts) == kept


def test_wide_fingerprints_are_majorities():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 254, 255, 256, 1000):
        h = r.integers(0, 1 << 64, n, np.uint64)
        x = (h[:, None] ^ nearcopies.MASKS) * nearcopies.FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9FB21C651E98DF25)
        ones = np.unpackbits(x.view(np.uint8).reshape(n, -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
        assert nearcopies.wide(h) == np.packbits(ones * 2 > n, bitorder="little").tobytes()


@pytest.mark.parametrize("size", [5, 10, 25, 100, 400])
def test_index_and_filters_lose_next_to_nothing_at_the_threshold(size):
    """Pairs of sets at exactly 0.8 (or just above, where sizes don't allow it): how many share a key and pass both filters."""
    r = np.random.default_rng(size)
    found = tried = 0
    for _ in range(150):
        shared = r.integers(0, 1 << 64, max(4, size * 8 // 10), np.uint64)
        extra = r.integers(0, 1 << 64, len(shared) // 4, np.uint64)
        cut = r.integers(0, len(extra) + 1)
        a, b = np.concatenate([shared, extra[:cut]]), np.concatenate([shared, extra[cut:]])
        n = nearcopies.TRIPLES_ALL if max(len(a), len(b)) <= nearcopies.SHORT else nearcopies.KEYS
        prints = np.array([np.frombuffer(nearcopies.wide(x), np.uint8) for x in (a, b)])
        ka, kb = nearcopies.keys(prints, n)
        x = prints[0] ^ prints[1]
        carried = int(np.bitwise_count(x[:16]).sum()) <= nearcopies.CARRIED_BITS
        tried += 1
        found += bool(np.intersect1d(ka, kb).size) and carried and nearcopies.alike(prints[0].tobytes(), prints[1].tobytes(), a.tobytes(), b.tobytes())
    assert found >= 0.97 * tried


def test_index_finds_all_shared_keys(spark, monkeypatch):
    """Postings of one task or of many, in any buckets: exactly the keys of two sets or more."""
    monkeypatch.setattr(nearcopies, "POSTINGS_AT_ONCE", 3000)
    r = np.random.default_rng(5)
    base = r.integers(0, 256, nearcopies.WIDTH, np.uint8)
    rows, where = [], {}
    for fp in range(60):
        x = base.copy()
        change = r.random(nearcopies.WIDTH) < (0.2 if fp % 2 else 1)
        x[change] = r.integers(0, 256, int(change.sum()), np.uint8)
        n = 10 if fp % 7 == 0 else 100
        rows.append((fp, n, bytearray(x.tobytes())))
        for k in nearcopies.keys(x[None], nearcopies.TRIPLES_ALL if n <= nearcopies.SHORT else nearcopies.KEYS)[0].tolist():
            where.setdefault(k, set()).add(fp)
    want = {(k, fp) for k, fps in where.items() if len(fps) > 1 for fp in fps}
    names = spark.createDataFrame(rows, "fp long, n long, bytes binary")
    for parts, buckets in ((1, 3), (4, 50)):
        got = nearcopies.index(names.repartition(parts), buckets).collect()
        assert {(r["key"], r["fp"]) for r in got} == want and len(got) == len(want)


def test_parity_loses_no_pair():
    """Sets of all sizes around 0.8, with parities of equal and different lengths: odd() is at most 1 where the similarity is 0.8."""
    r = np.random.default_rng(9)
    alike = unlike = refused = 0
    for _ in range(1500):
        shared = r.integers(0, 1 << 64, r.integers(4, 600), np.uint64)
        extra = r.integers(0, 1 << 64, r.integers(0, 1 + len(shared) * 45 // 100), np.uint64)
        cut = r.integers(0, len(extra) + 1)
        a, b = np.concatenate([shared, extra[:cut]]), np.concatenate([shared, extra[cut:]])
        x = {"n": np.array([len(a), len(b)]), "parity": np.array([nearcopies.parity(a), nearcopies.parity(b)], object)}
        share = nearcopies.odd(x, np.array([0]), np.array([1]))[0]
        if 5 * len(shared) >= 4 * (len(a) + len(b) - len(shared)):
            alike += 1
            assert share <= 1
        elif 4 * len(shared) < 3 * (len(a) + len(b) - len(shared)):
            unlike += 1
            refused += share > 1
    assert alike > 300 and unlike > 100 and refused > 0.9 * unlike


def test_postings_give_all_candidates(monkeypatch):
    """partnered, crossed and forest over chunks of several batches against all pairs of each posting."""
    monkeypatch.setattr(nearcopies, "CHUNK", 40)
    monkeypatch.setattr(nearcopies, "BLOCK", 50)
    monkeypatch.setattr(nearcopies, "CHOSEN", 30)
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 64, (12, 60), np.uint64)
    found = []
    for k in range(150):
        s = base[k % 12].copy()
        change = r.random(60) < r.choice([0, 0.05, 0.1, 0.3])
        s[change] = r.integers(0, 1 << 64, int(change.sum()), np.uint64)
        found.append(np.unique(s))
    fp = np.concatenate([r.choice(150, size, replace=False) for size in (1, 2, 90, 3, 1, 150, 40, 2, 2)])
    key = np.repeat(np.arange(9), (1, 2, 90, 3, 1, 150, 40, 2, 2))
    root = r.integers(0, 100, 150)[fp]
    prints = np.array([np.frombuffer(nearcopies.wide(s)[:16], np.int64) for s in found])
    x = {"key": key, "fp": fp, "n": np.array([len(s) for s in found])[fp], "s": prints[fp, 0], "t": prints[fp, 1], "root": root, "parity": np.array([nearcopies.parity(s) for s in found], object)[fp]}
    p, q = (y.ravel() for y in np.indices((len(fp), len(fp))))
    ok = (key[p] == key[q]) & (p < q)
    p, q = p[ok], q[ok]
    ok = nearcopies.near(x, p, q)
    p, q = p[ok], q[ok]
    batches = lambda: iter([pa.RecordBatch.from_pydict({f: v[at : at + 17] for f, v in x.items()}) for at in range(0, len(fp), 17)])
    rows = lambda found, a, b: {z for y in found for z in zip(y[a].to_pylist(), y[b].to_pylist())}
    assert rows(nearcopies.partnered(batches()), "key", "fp") == {(key[i], fp[i]) for i in np.concatenate([p, q])}
    ok = (root[p] != root[q]) & (nearcopies.odd(x, p, q) <= 1)
    want = {(min(a, b), max(a, b)) for a, b in zip(fp[p[ok]], fp[q[ok]])}
    common = {k: np.bincount(root[key == k]).max() for k in range(9)}
    assert max(common.values()) > 1 and len(want) > 200
    assert {(min(y), max(y)) for y in rows(nearcopies.crossed(batches()), "a", "b")} == want

    def parts(pairs):
        top = list(range(100))
        where = dict(zip(fp.tolist(), root.tolist()))
        for a, b in pairs:
            u, v = top[where[a]], top[where[b]]
            top = [min(u, v) if t in (u, v) else t for t in top]
        return top

    trees = rows(nearcopies.forest(batches()), "a", "b")
    assert {(min(y), max(y)) for y in trees} <= want and len(trees) < len(fp) and parts(trees) == parts(want)


def test_near_copies_that_are_not_alike_make_no_square(spark, sf, monkeypatch):
    """Copies of one text, near each other by the carried bits, of which some reach 0.8: few pairs are read again, none is lost."""
    r = random.Random(8)
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    texts = {}
    for d in range(220):
        copy = list(base)
        for _ in range(r.choice([2, 6, 7, 8])):
            copy[r.randrange(len(copy))] = f"w{r.randrange(5000)}"
        texts[d] = " ".join(copy)
    asked, verified = [], nearcopies.verified
    monkeypatch.setattr(nearcopies, "verified", lambda pairs, members: asked.append(pairs.count()) or verified(pairs, members))
    kept = brute_kept(texts)
    assert 20 < len(kept) < 200
    assert stage(spark, sf, texts) == kept
    assert sum(asked) < 10 * len(texts)
