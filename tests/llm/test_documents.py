"""Operators on documents against brute force, and their defined cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import bpe, components, decontaminate, langid, lm, phrases, queries, repeats, simhash, substrings

public_tokenizers = pytest.importorskip("public_tokenizers")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


# --- 1: byte-level BPE ---


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(open(queries.tokenizer_path(), "rb").read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(ranks, reference, texts):
    r = random.Random(1)
    pieces = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "\u2003", "\u3000", "a", "Z", "é", "1", "²", "!", "''", "\U0001f600", "的", "'S", "\x1c", "\u0301", "\x00", "\x85"]
    cases = ["".join(r.choice(pieces) for _ in range(r.randint(0, 70))) for _ in range(3000)] + ["", "a" * 3000, " " * 500, "'", "ab" * 700] + list(texts.values())
    merges = bpe.Merges(ranks)
    for i in range(0, len(cases), 100):
        part = cases[i : i + 100]
        for text, ids in zip(part, bpe.encode_texts([x.encode() for x in part], merges)):
            assert ids.tolist() == reference.encode_ordinary(text)


def test_bpe_query(spark, sf, texts, reference):
    for r in queries.op1_bpe(spark, sf).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(texts[r["doc_id"]].encode()))


def test_bpe_round_trip_and_offsets(odd, ranks):
    encoded = bpe.encode(odd, queries.tokenizer_path())
    rows = bpe.decode(encoded, queries.tokenizer_path()).collect()
    assert Counter(bytes(r["decoded"]) for r in rows) == Counter((r["text"] or "").encode() for r in odd.collect())
    pieces = {v: k for k, v in ranks.items()}
    for r in rows:
        assert r["offsets"] == [sum(len(pieces[i]) for i in r["ids"][:k]) for k in range(len(r["ids"]))] if len(r["ids"]) < 100 else True


# --- 2: SimHash ---


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= bits):
            u, v = find(i), find(i + 1 + int(j))
            parent[max(u, v)] = min(u, v)
    return [find(i) for i in range(len(fps))]


def test_simhash_query(spark, sf, texts):
    ids = sorted(texts)
    roots = brute_components([brute_fingerprint(texts[i]) for i in ids])
    want = {i: (f"{brute_fingerprint(texts[i]):016x}", ids[r]) for i, r in zip(ids, roots)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash(spark, sf).collect()} == want


def test_simhash_links_in_long_postings(spark, monkeypatch):
    monkeypatch.setattr(simhash, "POSTING_ROWS", 4)
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = {0, (1 << 64) - 1}
    for b in base:
        for _ in range(40):
            fps.add(b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r["fp"], r["fp2"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert got == want


def test_simhash_cases(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 12
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {2}  # a null id is named by the smallest other
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    kept = simhash.keep_one(odd).collect()
    assert len(kept) == len({r["component_id"] if r["component_id"] is not None else -1 for r in rows} | {-2}) and set(kept[0].asDict()) == set(odd.columns)
    assert simhash.near_duplicates(empty).count() == 0 == simhash.keep_one(empty).count()


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    got = {x["node"]: x["root"] for x in components.connected(spark.createDataFrame(edges, "x long, y long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}


# --- 3: language model ---


def test_lm_query(spark, sf, texts):
    rows = queries.op3_lm(spark, sf).collect()
    tokens = {i: t.encode().lower().split() + [b"end\n"] for i, t in texts.items()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, t in tokens.items() if i not in held for w in t)
    n, v = sum(counts.values()), len(counts)
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in held, len(t), sum(w in counts for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
    h = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in h) > sum(r["base_score"] for r in h)


def flat(documents):
    return np.concatenate(documents).astype(np.int32), np.array([len(d) for d in documents])


def test_lm_is_normalised_and_learns():
    r = np.random.default_rng(0)
    counts = np.sort(r.integers(1, 50, 200))[::-1]
    net = lm.Network(counts, 30)
    every = np.append(np.arange(200), lm.WORDS)
    assert np.exp(net.outputs(np.zeros((201, lm.HIDDEN), np.float32), every)).sum() == pytest.approx(1, abs=1e-4)
    docs = [np.array([k % 3 * 3 + j % 3 for j in range(60)]) for k in range(80)]  # three cycles
    before = lm.score_documents(net, *flat(docs)).sum()
    lm.learn(lm.Adam(net), *flat(docs * 60))
    after = lm.score_documents(net, *flat(docs))
    assert after.sum() > 0.6 * before
    for d, s in zip(docs[:3], after):  # lanes don't mix documents
        assert lm.score_documents(net, *flat([d]))[0] == pytest.approx(s, rel=1e-3)
    h = r.normal(0, 1, (4, lm.HIDDEN)).astype(np.float32)
    total = sum(np.exp(net.outputs(h[:1].repeat(201, 0), every)))
    assert total == pytest.approx(1, abs=1e-3)


def test_lm_state_runs_through_whole_documents():
    """Scores in windows and lanes equal a plain word-by-word pass."""
    r = np.random.default_rng(2)
    net = lm.Network(np.arange(150, 50, -1), 20)
    net.p = {k: v + r.normal(0, 0.3, v.shape).astype(np.float32) for k, v in net.p.items()}
    docs = [r.integers(0, 100, n) for n in (1, 7, 64, 65, 200, 0, 500)]
    got = lm.score_documents(net, *flat(docs))
    for d, score in zip(docs, got):
        h, want, before = np.zeros((lm.HIDDEN, 1), np.float32), 0.0, lm.WORDS + 1
        for w in d:
            h, _ = net.cell(net.table()[:, [before]], h)
            want, before = want + float(net.outputs(h.T, np.array([w]))[0]), w
        assert score == pytest.approx(want, rel=1e-4)


def test_lm_gradients():
    net = lm.Network(np.arange(150, 50, -1), 20)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(1)
    ids, targets = r.integers(0, 100, (5, 3)), r.integers(0, 100, (5, 3))
    targets[2, 1] = lm.WORDS
    h = r.normal(0, 0.3, (lm.HIDDEN, 3))
    _, g, _ = net.window(ids, targets, h)
    for name in net.p:
        one = net.p[name].reshape(-1)
        for k in np.argsort(-np.abs(g[name]).reshape(-1))[:3]:
            old = one[k]
            one[k] = old + 1e-5
            up = net.window(ids, targets, h)[0]
            one[k] = old - 1e-5
            down = net.window(ids, targets, h)[0]
            one[k] = old
            assert (up - down) / 2e-5 == pytest.approx(g[name].reshape(-1)[k], rel=1e-3, abs=1e-5), name


def test_lm_outputs_stay_finite():
    net = lm.Network(np.arange(150, 50, -1), 20)
    net.p["c"][:-1] *= 1e4
    net.p["w"][:, :-1] *= 1e4
    assert not lm.safe(net.p["c"]) and not lm.safe(net.p["w"])
    h = np.random.default_rng(3).uniform(-1, 1, (50, lm.HIDDEN)).astype(np.float32)
    targets = np.arange(50) % 101
    out, g, dh = net.outputs(h, targets, True)
    assert all(np.isfinite(x).all() for x in (out, dh, *g.values()))


def test_lm_frequent_words_of_equal_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 100)
    rows = [(b"w%d" % k, 7) for k in range(500)]
    words, sizes = lm.frequent(spark.createDataFrame(rows, "word binary, n long"))
    assert 60 <= len(words) <= 100 and set(sizes) == {7} and words == sorted(words)
    rows += [(b"x%d" % k, 100 + k % 2) for k in range(40)] + [(b"y", 9)]
    words, sizes = lm.frequent(spark.createDataFrame(rows, "word binary, n long"))
    assert sizes[:41].tolist() == [101] * 20 + [100] * 20 + [9] and 60 < len(words) <= 100
    words, sizes = lm.frequent(spark.createDataFrame(rows[:90], "word binary, n long"))
    assert len(words) == 90


def test_lm_without_training_documents(spark):
    ids = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2]
    rows = lm.score(spark.createDataFrame([(d, "some words " * d) for d in ids], "doc_id long, text string")).collect()
    assert len(rows) == len(ids) and all(r["held_out"] and r["train_tokens"] == 0 == r["n_known"] and r["score"] == r["base_score"] for r in rows)


def test_lm_scores_equal_a_plain_pass(spark, sf, texts, monkeypatch):
    """score: word by word with the fitted weights, other words by their counts."""
    seen = []
    real = lm.fit
    monkeypatch.setattr(lm, "fit", lambda rows, net: (real(rows, net), seen.append(net))[0])
    rows = {r["doc_id"]: r for r in queries.op3_lm(spark, sf).collect()}
    net, table = seen[0], seen[0].table()
    counts = Counter(w for i, t in texts.items() if not rows[i]["held_out"] for w in lm.tokens(t.encode()))
    ranked = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    rank = {w: k for k, w in enumerate(ranked[: lm.WORDS])}
    rest, others = sum(counts[w] for w in ranked[lm.WORDS :]), len(ranked) - len(rank)
    for i in sorted(texts, key=lambda i: len(texts[i]))[::20]:
        h, want, before = np.zeros((lm.HIDDEN, 1), np.float32), 0.0, lm.WORDS + 1
        for w in lm.tokens(texts[i].encode()):
            k = rank.get(w, lm.WORDS)
            h, _ = net.cell(table[:, [before]], h)
            want += float(net.outputs(h.T, np.array([k]))[0]) / math.log(10)
            if k == lm.WORDS:
                want += math.log10((counts[w] + 1) / (rest + others + 1))
            before = k
        assert rows[i]["score"] == pytest.approx(want, rel=1e-4)


def test_lm_cases(odd, empty):
    rows = lm.score(odd).collect()
    assert len(rows) == 12 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert sorted(r["n_tokens"] for r in rows)[:4] == [1, 1, 1, 1]
    assert lm.score(empty).count() == 0


# --- 4 and 9: repeated strings and passages ---


def brute_cover(docs, length, by_document):
    first, out = {}, {}
    for d, s in sorted(docs.items()):
        mark = bytearray(len(s))
        for i in range(len(s) - length + 1):
            w = bytes(s[i : i + length]) if isinstance(s, bytes) else tuple(s[i : i + length])
            f = first.setdefault(w, (d, i))
            if (f[0] < d) if by_document else f < (d, i):
                mark[i : i + length] = b"\1" * length
        out[d] = mark
    return out


def made_documents(seed, n=40):
    r = random.Random(seed)
    base = ["".join(r.choice("abcde fgh ") for _ in range(r.randint(50, 900))) for _ in range(4)]
    docs = {}
    for d in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            x = r.choice(base)
            a = r.randint(0, len(x))
            parts.append(r.choice([x[a : a + r.randint(0, 400)], x, "zz" * r.randint(0, 150), "q" * r.randint(0, 30), "".join(r.choice("xyz é ") for _ in range(50))]))
        docs[d] = "".join(parts)
    return docs


def check_substrings(rows, docs):
    want = brute_cover({d: (t or "").encode() for d, t in docs.items()}, 100, False)
    for r in rows:
        raw, mark = (docs[r["doc_id"]] or "").encode(), want[r["doc_id"]]
        runs = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(raw), sum(mark), runs)
        assert bytes(r["kept"]) == bytes(x for x, m in zip(raw, mark) if not m)


def check_passages(rows, docs):
    words = {d: (t or "").encode().split() for d, t in docs.items()}
    want = brute_cover(words, 50, True)
    for r in rows:
        kept = [w for w, m in zip(words[r["doc_id"]], want[r["doc_id"]]) if not m]
        assert (r["n_words"], r["n_removed"], bytes(r["kept"])) == (len(want[r["doc_id"]]), sum(want[r["doc_id"]]), b" ".join(kept))


def test_substring_and_passage_removal(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 20_000)
    docs = made_documents(5)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    rows = substrings.remove_repeats(df).collect()
    assert len(rows) == len(docs)
    check_substrings(rows, docs)
    by_two = {d: " ".join(t[i : i + 2].strip() or "x" for i in range(0, len(t), 2)) for d, t in docs.items()}
    rows = phrases.remove_passages(spark.createDataFrame(list(by_two.items()), "doc_id long, text string").repartition(3)).collect()
    check_passages(rows, by_two)
    assert sum(r["n_removed"] for r in rows) > 0


def test_queries_4_and_9(spark, sf, texts):
    for f, by_document in ((queries.op4_substrings, False), (queries.op9_phrases, True)):
        split = (lambda t: t.encode().split()) if by_document else str.encode
        join = (lambda x: b" ".join(x)) if by_document else bytes
        docs = {d: split(t) for d, t in texts.items()}
        want = brute_cover(docs, 50 if by_document else 100, by_document)
        for r in f(spark, sf).collect():
            assert r["kept_sha256"] == sha(join(x for x, m in zip(docs[r["doc_id"]], want[r["doc_id"]]) if not m))


def test_long_documents_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(repeats, "PIECE", 300)
    monkeypatch.setattr(repeats, "FLUSH_ROWS", 50)
    docs = {d: t for d, t in made_documents(6).items()}
    spec = substrings.SPEC

    def batch(**more):
        return pa.RecordBatch.from_pydict({"did": pa.array(list(docs), pa.int64()), "tag": pa.array([0] * len(docs), pa.int64()), "text": list(docs.values()), **more})

    def sort(batches, keys=("h", "c", "did", "at"), rows=7):
        batches = list(batches)
        return pa.Table.from_batches(batches).sort_by([(k, "ascending") for k in keys]).to_batches(max_chunksize=rows) if batches else []

    def by_doc(batches, state=None):
        out = {d: [] for d in docs}
        for b in batches:
            for d, a, s in zip(*(b.column(k).to_pylist() for k in ("did", "at", "state"))):
                if state is None or s == state:
                    out[d].append(a)
        return out

    first = list(repeats.resolved(spec, sort(repeats.anchor_rows(spec, [batch()])), True))
    done, open_ = by_doc(first, repeats.RESOLVED), by_doc(first, repeats.OPEN)
    sides = by_doc(repeats.shared_sides(spec, sort(repeats.side_rows(spec, [batch(places=pa.array(list(open_.values()), pa.list_(pa.int64())))]), ("h", "did", "at"))))
    last = by_doc(repeats.resolved(spec, sort(repeats.window_rows(spec, [batch(sides=pa.array(list(sides.values()), pa.list_(pa.int64())))])), False))
    want = brute_cover({d: t.encode() for d, t in docs.items()}, 100, False)
    for d, t in docs.items():
        assert repeats.covered(len(t.encode()), np.array(done[d] + last[d], np.int64), 100).tolist() == [bool(x) for x in want[d]]


def test_repeat_cases(odd, empty):
    rows = substrings.remove_repeats(odd, "source").collect()
    assert len(rows) == 12 and all(r["source"] == "kept" for r in rows)
    by = {(r["doc_id"], r["n_bytes"]): r for r in rows}
    size = len("the quick brown fox jumps over a lazy dog ")
    assert by[5, 3000 * size]["n_removed"] == 3000 * size - size and by[6, 3000 * size + 1]["n_removed"] == 3000 * size
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] not in (5, 6))
    rows = phrases.remove_passages(odd).collect()
    assert len(rows) == 12 and {(r["doc_id"], r["n_removed"]) for r in rows if r["n_removed"]} == {(6, 27_000)}
    assert substrings.remove_repeats(empty).count() == 0 == phrases.remove_passages(empty).count()


def test_many_copies_of_a_row(spark):
    """Rows that repeat an id and its text share their places: lists don't grow with the copies."""
    text = " ".join(f"w{k % 40}" for k in range(70))  # repeats itself
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").crossJoin(spark.range(4_000).select()).union(spark.createDataFrame([(0, "x " + text), (2, text)], "doc_id long, text string"))
    want = brute_cover({0: ("x " + text).encode(), 1: text.encode(), 2: text.encode()}, 100, False)
    rows = substrings.remove_repeats(df).groupBy("doc_id", "n_removed").count().collect()
    assert {tuple(r) for r in rows} == {(d, sum(want[d]), 4_000 if d == 1 else 1) for d in range(3)}
    keyed = repeats.keyed(df)
    assert repeats.repeats(substrings.SPEC, keyed).groupBy("did", "tag").agg(F.size(F.collect_set("at")).alias("n")).agg(F.max("n")).first()[0] < 500
    rows = phrases.remove_passages(df).groupBy("doc_id", "n_removed").count().collect()
    assert {tuple(r) for r in rows} == {(0, 0, 1), (1, 70, 4_000), (2, 70, 1)}


def test_owners_with_many_routes(spark, monkeypatch):
    """A passage that every document has goes to all buckets from rows of its own; results don't change."""
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 500)
    monkeypatch.setattr(phrases, "ROUTES", 3)
    r = random.Random(2)
    words = [f"w{k}" for k in range(90)]
    docs = {d: " ".join([f"a{r.random()}" for _ in range(r.randrange(9))] + words[r.randrange(20) :] + [f"b{d}"]) for d in range(120)}
    rows = phrases.remove_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)).collect()
    assert len(rows) == 120
    check_passages(rows, docs)


def test_same_id_other_text(spark):
    a, b = ("word%d " * 60) % tuple(range(60)), ("other%d " * 60) % tuple(range(60))
    df = spark.createDataFrame([(1, a), (2, a + b), (2, b), (3, b), (None, b), (4, "tiny")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_removed"]) for r in phrases.remove_passages(df).collect())
    assert got == Counter({(None, 0): 1, (1, 0): 1, (2, 120): 1, (2, 60): 1, (3, 60): 1, (4, 0): 1})


# --- 6: language identification ---


def test_langid_query(spark, sf):
    rows = queries.op6_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) > 0


def test_langid_equals_plain_bayes(spark, sf):
    """Counting and scoring n-gram by n-gram with Python's numbers (all training documents: the table is below the bound)."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()

    def grams(text):
        points = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in text]
        for i, p in enumerate(points):
            for n in range(3):
                if i >= n or n == 0:
                    g = p | (points[i - 1] + 1 if n and i else 0) << 21 | (points[i - 2] + 1 if n == 2 and i > 1 else 0) << 42
                    yield (g + n) * 0x9E3779B97F4A7C15 % (1 << 64) >> 49
                else:  # an n-gram that would reach before the text is the shorter one
                    g = p | (points[i - 1] + 1 if n > 1 and i else 0) << 21
                    yield (g + n) * 0x9E3779B97F4A7C15 % (1 << 64) >> 49

    train = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2 and d["lang"] is not None and d["text"] is not None]
    counts, prior = {}, Counter(d["lang"] for d in train)
    for d in train:
        counts.setdefault(d["lang"], Counter()).update(grams(d["text"]))
    langs = sorted(counts)
    total = {k: sum(counts[k].values()) + langid.BUCKETS for k in langs}
    want = {}
    for d in docs:
        found = Counter(grams(d["text"] or ""))
        log = {k: math.log((prior[k] + 1) / (len(train) + len(langs))) + sum(n * math.log((counts[k][g] + 1) / total[k]) for g, n in found.items()) for k in langs}
        best = max(langs, key=lambda k: log[k])
        want[d["doc_id"]] = (best, 1 / sum(math.exp(max(log[k] - log[best], -700)) for k in langs)) if any(c.isalpha() for c in d["text"] or "") else ("und", 0.0)
    for r in queries.op6_langid(spark, sf).collect():
        assert r["lang_pred"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1], abs=1e-3)


def test_langid_cases(odd, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (2, 3, 4, 7))
    assert by[5]["lang_pred"] == "en"
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_langid_texts_share_no_ngrams():
    langs, logs = ["a", "b"], np.log(np.random.default_rng(0).uniform(0.1, 1, (langid.BUCKETS + 1, 2))).astype(np.float32)
    texts = [b"abc", b"", b"x", "zé".encode(), b"abcabc"]
    whole, score = langid.predict(texts, langs, logs)
    for t, w, s in zip(texts, whole, score):
        (one,), (own,) = langid.predict([t], langs, logs)
        assert one == w and own == pytest.approx(s)


# --- 7: decontamination ---


def edit(words, n, r):
    words = list(words)
    for _ in range(n):
        at = r.randrange(len(words))
        kind = r.randrange(3)
        if kind == 0:
            words[at] = "zzz"
        elif kind == 1:
            words.insert(at, "zzz")
        else:
            del words[at]
    return words


def brute_distance(item, words):
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(words):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (a != b)))
        row = new
    return min(row)


def test_decontamination_by_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(150)]
    items = {k: [r.choice(vocabulary) for _ in range(r.randint(8, 40))] for k in range(12)}
    docs = {}
    for d in range(150):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        if d % 2:
            k = r.randrange(12)
            at = r.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in edit(items[k], r.randint(0, decontaminate.edit_limit(len(items[k])) + 1), r)]
        docs[d] = words
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(90, None), (91, "too short")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.contaminated(df, benchmark).collect()}
    normal = {d: [decontaminate.normal(w) for w in words] for d, words in docs.items()}
    distance = {(d, k): brute_distance(w, normal[d]) for d in docs for k, w in items.items()}
    want = {p for p, e in distance.items() if e <= decontaminate.edit_limit(len(items[p[1]]))}
    assert set(got) <= want and len(got) >= 0.97 * len(want) > 40
    assert all(x["edit_distance"] == distance[p] for p, x in got.items())
    for (d, k), x in got.items():
        assert brute_distance(items[k], normal[d][x["start_word"] : x["end_word"]]) == x["edit_distance"]
    kept = {x["doc_id"] for x in decontaminate.clean(df, benchmark).collect()}
    assert kept == set(docs) - {d for d, _ in got}


def test_decontamination_query_finds_planted(spark, sf, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    planted = {(d, k) for d, t in texts.items() for k, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontaminate(spark, sf).collect()}
    assert planted <= got


def test_short_items_and_spaces(spark):
    """Items of fewer than five words stand word for word; documents and items end words at the same white space."""
    items = {1: "alpha", 2: "beta gamma", 3: "one two three", 4: "vier W\u00f6rter sind hier", 5: "\u6771\u4eac\u90fd\u306b\u4f4f\u3093\u3067\u3044\u307e\u3059", 6: "!!! ...", 7: "a b c d e f g h i j k l"}
    docs = {1: ("x ALPHA, y", {1}), 2: ("beta  gamma!", {2}), 3: ("beta x gamma", set()), 4: ("one two\u00a0three", {3}), 5: ("Vier w\u00f6rter\u3000sind hier.", {4}), 6: (f"({items[5]})", {5}), 7: ("\u6771\u4eac\u90fd", set()), 8: (items[7].replace(" ", "\u00a0"), {7}), 9: ("!!! ...", set()), 10: ("two one two three one", {3})}
    df = spark.createDataFrame([(d, t) for d, (t, _) in docs.items()], "doc_id long, text string")
    rows = decontaminate.contaminated(df, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(d, k) for d, (_, found) in docs.items() for k in found}
    assert all(r["edit_distance"] == 0 for r in rows)


@pytest.mark.parametrize(("size", "least"), [(5, 0.98), (12, 0.98), (40, 0.98), (150, 0.98), (1200, 1.0)])
def test_recall_on_edits_that_the_index_has_not_seen(size, least):
    """Passages with as many edits as are allowed; sizes that no number of repetitions suits are searched in full."""
    import pyarrow as pa

    r = random.Random(size)
    word = lambda: f"w{r.randrange(3000)}"
    texts = [[word() for _ in range(size)] for _ in range(6)]
    items = decontaminate.Items([(k, " ".join(w)) for k, w in enumerate(texts)])
    n = 120 if size < 1000 else 6
    docs = [" ".join([word() for _ in range(20)] + edit(texts[d % 6], decontaminate.edit_limit(size), r) + [word() for _ in range(20)]) for d in range(n)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": docs})
    got = {(d, k) for _, d, k, *_ in decontaminate.scan(batch, items, decontaminate.Words(items.known))}
    assert sum((d, d % 6) in got for d in range(n)) >= least * n
    assert size < 1000 or items.keys[size] is None


def test_many_blocks_of_items(spark, monkeypatch):
    """More blocks than a pass takes: each pass's rows are written, and results are those of one block."""
    r = random.Random(4)
    texts = [" ".join(f"w{r.randrange(500)}" for _ in range(12)) for _ in range(60)]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")
    docs = spark.createDataFrame([(d, f"before {texts[d]} after" if d % 2 else "nothing of it") for d in range(60)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 6)
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 3)
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs, items).collect()} == {(d, d) for d in range(1, 60, 2)}
    assert {x["doc_id"] for x in decontaminate.clean(docs, items).collect()} == set(range(0, 60, 2))


def test_decontamination_cases(spark, odd, empty):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over"), (1, "the quick brown fox jumps over"), (None, "alpha beta gamma delta epsilon"), (2, None)], "item_id long, text string")
    rows = decontaminate.contaminated(odd, items).collect()
    assert {r["doc_id"] for r in rows} == {5, 6} and len(rows) == 4
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0
    assert decontaminate.clean(odd, items).count() == 10 and decontaminate.clean(odd, items).columns == odd.columns
