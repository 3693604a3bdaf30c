"""The network's pass over all training documents."""

import numpy as np

from tidelog.llm import lm


def coded(docs, words):
    return lm.encode(docs, words, np.ones(len(words), np.int64)).filter("word is null")


def test_fit_sees_every_training_token_once(spark, monkeypatch):
    """Whatever the partitions, the rounds' shares together are all training documents, rows of one id among them."""
    rows = [(d, " ".join(f"w{(d + k) % 50}" for k in range(40))) for d in range(300)] + [(7, "again the same id " * 30)] * 5 + [(8, "long " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.filter(~lm.held_out(docs.doc_id)).collect()
    words = [f"w{k}".encode() for k in range(50)]
    want = sum(len(lm.tokens(r["text"].encode())) for r in train)
    for n in (1, 5):
        net = lm.Network(np.arange(150, 100, -1), 30)
        before = {k: x.copy() for k, x in net.p.items()}
        assert lm.fit(coded(docs.repartition(n), words), net) == want
        assert all(np.isfinite(x).all() for x in net.p.values())
        assert all((before[k] != net.p[k]).any() for k in ("x", "u", "c", "w"))
    seen = []
    real = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: seen.append(real(*a)))
    assert lm.score(docs).count() == len(rows) and seen == [want]


def test_averages_do_not_depend_on_the_order_of_partitions(spark):
    docs = spark.createDataFrame([(d, " ".join(f"w{(d * k) % 50}" for k in range(60))) for d in range(200)], "doc_id long, text string").repartition(4, "doc_id")
    words = [f"w{k}".encode() for k in range(50)]
    nets = [lm.Network(np.arange(150, 100, -1), 30) for _ in range(2)]
    for net in nets:
        lm.fit(coded(docs, words), net)
    assert all((nets[0].p[k] == nets[1].p[k]).all() for k in nets[0].p)


def test_pieces_are_the_whole_documents(monkeypatch):
    """Every token is a target once, after the token before it; a document's first after its start."""
    monkeypatch.setattr(lm, "PIECE", 8)
    seen = []

    class Recorder:
        net = None

        def window(self, ids, targets, h, live):
            seen.extend(zip(ids[live > 0].tolist(), targets[live > 0].tolist()))
            return 0, {}, h

        def apply(self, g, n):
            pass

    Recorder.net = Recorder()
    docs = [np.arange(100, 120), np.arange(200, 208), np.zeros(0, int), np.arange(300, 301), np.arange(400, 470)]
    lm.learn(Recorder(), np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs]))
    assert sorted(seen) == sorted((int(a), int(b)) for d in docs for a, b in zip([lm.WORDS + 1, *d[:-1]], d))


def test_learn_ignores_places_past_a_lanes_end():
    net = lm.Network(np.arange(150, 50, -1), 20)
    r = np.random.default_rng(1)
    ids, targets = r.integers(0, 90, (5, 3)), r.integers(0, 90, (5, 3))
    live = np.ones((5, 3), np.float32)
    live[2:, 1] = 0
    h = np.zeros((lm.HIDDEN, 3), np.float32)
    _, g, _ = net.window(ids, targets, h, live)
    targets[2:, 1] = 5
    _, again, _ = net.window(ids, targets, h, live)
    assert all(np.allclose(g[k], again[k], atol=1e-6) for k in g)
