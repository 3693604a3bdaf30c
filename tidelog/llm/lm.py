"""Operator 3: language-model scoring.

A gated recurrent unit reads a document word by word; its state runs through all windows of the document, so a score is
the whole document's log-likelihood. The output softmax is factored into classes: CLASSES - 1 classes of
CLASS_WORDS words each by frequency, and one class for all other words. P(word) = P(class | state) P(word | class,
state); within the last class P(word) = (c + 1) / (n + v + 1), where c, n and v are counts over all training documents
(the word's, the class's tokens and its distinct words).

Counts cover every training document and are kept by key in Spark: the most frequent words (HEAD at most, a fixed number)
are broadcast, all other words of a document are joined to their counts. The network is fitted by truncated
backpropagation in numpy over every token of every training document, once: in rounds of growing shares (ROUNDS) each
partition carries the weights on through its own documents, and the partitions' weights are averaged by their tokens.
Weights are added up by key in Spark, as whole numbers, so the driver gets one network, whatever the input.

Defined cases: a null text is empty and has one token, its end; no training documents: N = V = 0 and the score is
the base's; ties in frequency go by the word's bytes; documents that repeat an id are scored each for itself; a null
id counts as a training document.
"""

from __future__ import annotations

import copy
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import byte_column, doc_rows, record_batch, shuffle_partitions, slices, stored, tidy

CLASSES, CLASS_WORDS, HIDDEN = 32, 48, 8
WORDS = (CLASSES - 1) * CLASS_WORDS
HEAD = 1 << 18
STEPS, LANES, PIECE, RATE, WARM, PART = 16, 1024, 512, 0.01, 8, 1 << 13
TRAIN_BYTES = 4 << 20
#: The rounds' bounds: each reads a share of all training documents, and together they read every one once.
ROUNDS = (0, 1, 3, 7, 15, 32)
FIXED_POINT = 1 << 14
SCORE_STEPS, SCORE_LANES = 64, 512
COUNT_ENTRIES = 300_000
#: The class of each word, other words' too.
CLASS_OF = np.append(np.arange(WORDS) // CLASS_WORDS, CLASSES - 1).astype(np.int16)
END = b"\n"  # no word has it
LN10 = math.log(10)


def held_out(doc_id, modulus: int = 7):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), n: over all tokens of all training documents."""
    out = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        tally: Counter = Counter()
        for batch in slices(batches, "text"):
            for text in byte_column(batch, "text"):
                tally.update(tokens(text))
            if len(tally) > COUNT_ENTRIES:
                yield record_batch(out, [list(tally), list(tally.values())])
                tally = Counter()
        yield record_batch(out, [list(tally), list(tally.values())])

    rows = doc_rows(docs).filter(~held_out(F.col("doc_id"))).select("text")
    return rows.mapInArrow(tidy(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Index(dict):
    """Frequent word -> its rank; their number for all others."""

    def __missing__(self, word: bytes) -> int:
        return len(self)


def safe(w: np.ndarray) -> bool:
    """Whether states between -1 and 1 keep the exponentials of w's logits (the last row is the bias) within float32 as they are."""
    reach, bias = np.abs(w[..., :-1, :]).sum(-2), w[..., -1, :]
    return bool((bias + reach).max() < 80 and (bias - reach).max(-1).min() > -80)


class Network:
    """Weights by name. Input id WORDS stands for all other words, WORDS + 1 for a document's start.

    The gates' sigmoids are (1 + tanh) / 2, with the half inside the weights. The last row of c and w is the bias.
    """

    def __init__(self, counts: np.ndarray, rest: int):
        """counts: of the frequent words by rank; rest: tokens of all other words."""
        r = np.random.default_rng(5)
        n, h = WORDS + 2, HIDDEN
        padded = np.zeros(WORDS)
        padded[: len(counts)] = counts
        by_class = padded.reshape(CLASSES - 1, CLASS_WORDS)
        sizes = np.append(by_class.sum(1), rest)
        inner = np.where(by_class > 0, np.log(np.maximum(by_class, 1e-3) / np.maximum(sizes[:-1, None], 1e-3)), -60)
        self.p = {
            "x": r.normal(0, 0.3, (n, 3 * h)), "u": r.normal(0, 0.18, (h, 3 * h)), "b": np.zeros(3 * h),
            "c": np.concatenate([r.normal(0, 0.02, (h, CLASSES)), np.log(np.maximum(sizes, 1e-3) / max(sizes.sum(), 1))[None]]),
            "w": np.concatenate([r.normal(0, 0.02, (CLASSES - 1, h, CLASS_WORDS)), inner[:, None]], 1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.empty = np.flatnonzero((by_class == 0).ravel())

    def table(self) -> np.ndarray:
        """What each input id adds to the gates (gates x ids)."""
        return np.ascontiguousarray((self.p["x"] + self.p["b"]).T)

    def cell(self, x: np.ndarray, h: np.ndarray):
        """x: gates x lanes; h and what is returned: units x lanes."""
        k = HIDDEN
        hu = self.p["u"].T @ h
        zr = x[: 2 * k] + hu[: 2 * k]
        np.tanh(zr, out=zr)
        zr *= zr.dtype.type(0.5)
        zr += zr.dtype.type(0.5)
        z, r, hn = zr[:k], zr[k:], hu[2 * k :]
        new = r * hn
        new += x[2 * k :]
        np.tanh(new, out=new)
        out = h - new
        out *= z
        out += new
        return out, (z, r, new, hn)

    def outputs(self, h: np.ndarray, targets: np.ndarray, learn: bool = False, live: np.ndarray | None = None):
        """Natural log-probabilities of the targets (of the class alone for other words); gradients if asked for, of live rows.

        Rows are ordered by class once, so that each class is a slice, and the exponentials of all classes are one call.
        """
        p, n = self.p, len(h)
        own = CLASS_OF.take(targets)
        order = np.argsort(own, kind="stable")
        own = own.take(order)
        cuts = np.searchsorted(own, np.arange(CLASSES)).tolist()
        known = cuts[-1]
        kind = p["c"].dtype
        hs = np.ones((n, HIDDEN + 1), kind)
        hs[:, :-1] = h.take(order, 0)
        rows = np.arange(n)
        ones = np.ones(max(CLASSES, CLASS_WORDS), kind)
        e = hs @ p["c"]
        if not safe(p["c"]):
            e -= e.max(1, keepdims=True)
        at = rows * CLASSES + own
        picked = e.ravel().take(at)
        np.exp(e, out=e)
        total = e @ ones[:CLASSES]
        log = picked - np.log(total)
        f = np.empty((known, CLASS_WORDS), kind)
        for k in range(CLASSES - 1):
            if cuts[k] < cuts[k + 1]:
                np.matmul(hs[cuts[k] : cuts[k + 1]], p["w"][k], out=f[cuts[k] : cuts[k + 1]])
        if not safe(p["w"]):
            f -= f.max(1, keepdims=True)
        slot = rows[:known] * CLASS_WORDS + (targets.take(order[:known]) - own[:known].astype(np.int32) * CLASS_WORDS)
        picked = f.ravel().take(slot)
        np.exp(f, out=f)
        inside = f @ ones[:CLASS_WORDS]
        log[:known] += picked - np.log(inside)
        out = np.empty(n, kind)
        out[order] = log
        if not learn:
            return out
        weight = np.ones(n, kind) if live is None else live.take(order)
        e *= (weight / total)[:, None]
        e.ravel()[at] -= weight
        dh = e @ p["c"][:-1].T
        g = {"c": hs.T @ e, "w": np.zeros_like(p["w"])}
        f *= (weight[:known] / inside)[:, None]
        f.ravel()[slot] -= weight[:known]
        for k in range(CLASSES - 1):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                g["w"][k] = hs[a:b].T @ f[a:b]
                dh[a:b] += f[a:b] @ p["w"][k, :-1].T
        back = np.empty_like(order)
        back[order] = rows
        return out, g, dh.take(back, 0)

    def window(self, ids: np.ndarray, targets: np.ndarray, h: np.ndarray, live: np.ndarray | None = None):
        """Truncated backpropagation through one window (steps x lanes): loss, gradients, last state (units x lanes, as h)."""
        p, k, (steps, n) = self.p, HIDDEN, ids.shape
        x = self.table().take(ids, 1)
        kind = x.dtype
        states, before, z, r, new, hn = np.empty((6, k, steps, n), kind)
        for t in range(steps):
            before[:, t] = h
            h, (z[:, t], r[:, t], new[:, t], hn[:, t]) = self.cell(x[:, t], h)
            states[:, t] = h
        out, g, dout = self.outputs(states.reshape(k, -1).T, targets.ravel(), True, None if live is None else live.ravel())
        dout = np.ascontiguousarray(dout.T).reshape(k, steps, n)
        # What each gate's gradient is of the state's; the halves inside the weights make 2 of z (1 - z) and r (1 - r).
        to_z = before - new
        to_z *= z
        to_z *= 2 - 2 * z
        to_new = 1 - new * new
        to_new *= 1 - z
        to_r = hn * r
        to_r *= 2 - 2 * r
        gates, inner = np.empty((3 * k, steps, n), kind), np.empty((k, steps, n), kind)
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            dh += dout[:, t]
            np.multiply(dh, to_new[:, t], out=inner[:, t])
            np.multiply(dh, to_z[:, t], out=gates[:k, t])
            np.multiply(inner[:, t], to_r[:, t], out=gates[k : 2 * k, t])
            np.multiply(inner[:, t], r[:, t], out=gates[2 * k :, t])
            dh *= z[:, t]
            dh += p["u"] @ gates[:, t]
        g["u"] = before.reshape(k, -1) @ gates.reshape(3 * k, -1).T
        gates[2 * k :] = inner
        flat, where = gates.reshape(3 * k, -1), ids.ravel()
        g["b"] = flat.sum(1)
        g["x"] = np.stack([np.bincount(where, row, len(p["x"])) for row in flat], 1).astype(kind)
        return -float(out.sum(dtype=np.float64)), g, h


class Adam:
    """Moments and steps of one worker; norms above 1 are clipped."""

    def __init__(self, network: Network):
        self.net, self.step = network, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in network.p.items()} for _ in range(2))

    def apply(self, g: dict, tokens_: float) -> None:
        self.step += 1
        norm = math.sqrt(sum(float(np.dot(x.ravel(), x.ravel())) for x in g.values())) / tokens_
        scale = np.float32(min(1.0, 1.0 / max(norm, 1e-9)) / tokens_)
        rate = RATE * min(1.0, self.step / WARM) * math.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        for k, x in self.net.p.items():
            d = g[k]
            d *= scale
            m, v = self.m[k], self.v[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * d
            d *= d
            d *= np.float32(0.01)
            v *= np.float32(0.99)
            v += d
            np.sqrt(v, out=d)
            d += np.float32(1e-8)
            np.divide(m, d, out=d)
            d *= np.float32(rate)
            x -= d


def batches_of(sizes: np.ndarray, lanes: int):
    """Numbers of documents, longest first, so many at once; those without words are left out."""
    order = np.argsort(-sizes, kind="stable")[: int((sizes > 0).sum())]
    return (order[at : at + lanes] for at in range(0, len(order), lanes))


def place(flat: np.ndarray, starts: np.ndarray, heads: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets (steps x lanes) of steps low to high of the texts that start there; past a text's end they mean nothing."""
    at = np.minimum(starts + np.arange(low, high)[:, None], len(flat) - 1)
    targets = flat.take(at)
    ids = np.empty_like(targets)
    ids[1:] = targets[:-1]
    ids[0] = flat.take(starts + (low - 1)) if low else heads
    return ids, targets


def learn(adam: Adam, flat: np.ndarray, sizes: np.ndarray) -> None:
    """One pass over every token of the documents (in a row, of these sizes); places past a lane's end don't count.

    Here long documents are read in pieces of PIECE words, each of which knows the word before it.
    """
    ends = np.cumsum(sizes)
    pieces = -(-sizes // PIECE)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(ends - sizes, pieces) + number * PIECE
    long = np.minimum(PIECE, np.repeat(ends, pieces) - starts)
    heads = np.where(number > 0, flat.take(starts - 1, mode="wrap"), WORDS + 1) if len(starts) else starts
    for mine in batches_of(long, min(LANES, max(1, math.isqrt(4 * len(flat) // STEPS)))):
        h, size = np.zeros((HIDDEN, len(mine)), np.float32), long[mine]
        for low in range(0, size[0], STEPS):
            high = min(low + STEPS, size[0])
            n = int(np.searchsorted(-size, -low, "left"))  # longer ones come first
            live = (np.arange(low, high)[:, None] < size[:n]).astype(np.float32)
            _, g, h = adam.net.window(*place(flat, starts[mine[:n]], heads[mine[:n]], low, high), h[:, :n], live)
            adam.apply(g, float(live.sum()))


def one_round(rows: DataFrame, network: Network) -> int:
    """Carries network through rows' ids, partition by partition, and averages by tokens; returns the tokens it saw.

    Weighted weights are added as whole numbers, so that their order doesn't matter.
    """
    spark = rows.sparkSession
    start = spark.sparkContext.broadcast(network)
    out = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("weights", pa.binary())])

    def run(batches):
        own = copy.copy(start.value)
        own.p = {k: x.copy() for k, x in start.value.p.items()}
        adam, n = Adam(own), 0
        for batch in slices(batches, "ids", TRAIN_BYTES):
            flat, sizes = unpacked(batch)
            learn(adam, flat, sizes)
            n += len(flat)
        if n:
            flat = np.rint(np.concatenate([x.ravel() for x in own.p.values()]).astype(np.float64) * (n * FIXED_POINT)).astype(np.int64)
            cuts = range(0, len(flat), PART)
            yield record_batch(out, [range(len(cuts)), [n] * len(cuts), [flat[at : at + PART].tobytes() for at in cuts]])

    def add(batches):
        total: dict = {}
        for batch in batches:
            for part, n, weights in zip(*(c.to_pylist() for c in batch.columns)):
                before = total.get(part, (0, 0))
                total[part] = before[0] + n, before[1] + np.frombuffer(weights, np.int64)
        if total:
            yield record_batch(out, [list(total), [n for n, _ in total.values()], [w.tobytes() for _, w in total.values()]])

    kind = "part int, n long, weights binary"
    found = sorted((r["part"], r["n"], r["weights"]) for r in rows.mapInArrow(tidy(run), kind).repartition(shuffle_partitions(rows), "part").mapInArrow(tidy(add), kind).collect())
    start.destroy()
    if not found:
        return 0
    flat, at = np.concatenate([np.frombuffer(w, np.int64) / (n * FIXED_POINT) for _, n, w in found]), 0
    for k, x in network.p.items():
        network.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return found[0][1]


def fit(encoded: DataFrame, network: Network) -> int:
    """One pass over all training documents, in rounds of growing shares (ROUNDS); returns the tokens it saw. encoded: share, ids."""
    share = F.col("share")
    return sum(one_round(encoded.filter((share >= low) & (share < high)).select("ids"), network) for low, high in zip(ROUNDS, ROUNDS[1:]))


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch's documents in a row, and how many each has."""
    each = batch.column("ids").to_pylist()
    return np.frombuffer(b"".join(each), np.uint16).astype(np.int32), np.fromiter(map(len, each), np.int64, len(each)) // 2


def score_documents(network: Network, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log-probability of each document, the last class's inner part left out; the state runs through the whole document."""
    total, table, starts = np.zeros(len(sizes)), network.table(), np.cumsum(sizes) - sizes
    for mine in batches_of(sizes, SCORE_LANES):
        h, size, start, heads = np.zeros((HIDDEN, len(mine)), np.float32), sizes[mine], starts[mine], np.full(len(mine), WORDS + 1)
        sums = np.zeros(len(mine))
        for low in range(0, size[0], SCORE_STEPS):
            high = min(low + SCORE_STEPS, size[0])
            active = np.searchsorted(-size, -np.arange(low, high), "left").tolist()  # longer ones come first
            ids, targets = place(flat, start[: active[0]], heads[: active[0]], low, high)
            states = []
            for row, n in zip(ids, active):
                h, _ = network.cell(table.take(row[:n], 1), h[:, :n])
                states.append(h)
            log = network.outputs(np.concatenate(states, 1).T, np.concatenate([row[:n] for row, n in zip(targets, active)]))
            at = 0
            for n in active:
                sums[:n] += log[at : at + n]
                at += n
        total[mine] = sums
    return total


def frequent(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """HEAD words at most, by falling counts: all above a threshold that is read off a histogram of logarithms.

    So the driver gets histograms and HEAD rows, not HEAD rows of each partition. Of the level that doesn't fit whole,
    the greater counts come, and of the count that doesn't, a share by the words' hashes; ties go by the word's bytes.
    """
    level = F.floor(F.log("n") * 64).cast("int")

    def fitting(rows: DataFrame, by, room: int) -> tuple:
        """Least value whose rows all fit, with those above it; the next value, its rows; what room is left."""
        least = None
        for r in sorted(rows.groupBy(by.alias("at")).count().collect(), reverse=True):
            if r["count"] > room:
                return least, r["at"], r["count"], room
            least, room = r["at"], room - r["count"]
        return least, None, 0, room

    wanted = F.lit(False)
    least, edge, _, room = fitting(counts, level, HEAD)
    if least is not None:
        wanted = wanted | (level >= least)
    if edge is not None:
        inside = counts.filter(level == edge)
        least, n, rows, room = fitting(inside, F.col("n"), room)
        if least is not None:
            wanted = wanted | ((level == edge) & (F.col("n") >= least))
        bits = 1 << 30
        wanted = wanted | ((F.col("n") == n) & (F.pmod(F.xxhash64("word"), F.lit(bits)) < int(bits * room / rows)))
    found = sorted((-r["n"], bytes(r["word"])) for r in counts.filter(wanted).collect())[:HEAD]
    return [w for _, w in found], np.array([-n for n, _ in found], np.int64)


ENCODED = "uid long, doc_id long, share int, n_tokens long, n_known long, log_head double, log_rest double, n_rest long, ids binary, word binary, times long"


def encode(docs: DataFrame, words: list[bytes], sizes: np.ndarray) -> DataFrame:
    """Two kinds of rows: of each document its facts and its ids (two bytes each); of each of its words beyond HEAD, uid, word and times.

    share: 0 to ROUNDS[-1] - 1 by a hash of id and text for training documents, -1 for the held out.
    """
    model = docs.sparkSession.sparkContext.broadcast((words, sizes))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    out = pa.schema(list(zip([x.split()[0] for x in ENCODED.split(", ")], kinds)))

    def run(batches):
        words, sizes = model.value
        index = Index(zip(words, range(len(words))))
        logs = np.append(np.log10(sizes + 1.0), 0.0)
        uid, unknown = TaskContext.get().partitionId() << 36, len(words)
        for batch in slices(batches, "text"):
            rare, facts = [], []
            for text in byte_column(batch, "text"):
                found = tokens(text)
                ids = np.fromiter(map(index.__getitem__, found), np.int32, len(found))
                log = logs.take(ids)
                other = ids >= WORDS
                strange = np.flatnonzero(ids == unknown).tolist()
                facts.append((len(ids), len(ids) - len(strange), float(log.sum()), float(log[other].sum()), int(other.sum()), np.minimum(ids, WORDS).astype(np.uint16).tobytes()))
                rare.append(Counter([found[i] for i in strange]))
            rows = range(uid, uid + len(facts))
            nothing = [None] * len(facts)
            yield record_batch(out, [rows, batch.column("doc_id"), batch.column("share"), *([f[j] for f in facts] for j in range(6)), nothing, nothing])
            flat = [(u, w, n) for u, found in zip(rows, rare) for w, n in found.items()]
            nothing = [None] * len(flat)
            yield record_batch(out, [[x[0] for x in flat], *[nothing] * 8, [x[1] for x in flat], [x[2] for x in flat]])
            uid += len(facts)

    share = F.when(held_out(F.col("doc_id")), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS[-1]))).cast("int")
    return doc_rows(docs).withColumn("share", share).mapInArrow(tidy(run), ENCODED)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    counts = stored(count_words(docs), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words, sizes = frequent(counts)
    rest, others = int(total - sizes[:WORDS].sum()), int(distinct - min(len(words), WORDS))
    network = Network(sizes[:WORDS], max(rest, 1))
    encoded = stored(encode(docs, words, sizes), "encoded")
    if total:
        fit(encoded, network)
    model = spark.sparkContext.broadcast(network)
    base, inner = math.log10(total + distinct + 1), math.log10(rest + others + 1)

    def run(batches):
        for batch in batches:
            neural = score_documents(model.value, *unpacked(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(neural, pa.float64())], names=[*batch.schema.names[:-1], "neural"])

    facts = ["uid", "doc_id", "n_tokens", "n_known", "log_head", "log_rest", "n_rest"]
    scored = encoded.filter("word is null").select(*facts, "ids").mapInArrow(tidy(run), "uid long, doc_id long, n_tokens long, n_known long, log_head double, log_rest double, n_rest long, neural double")
    found = encoded.filter("word is not null").select("uid", "word", "times").join(counts, "word")
    found = found.select("uid", "times", (F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("log"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in scored.dtypes if c != "uid"]
    rows = scored.select("*", F.lit(0).cast("long").alias("times"), F.lit(0.0).alias("log")).unionByName(found.select("uid", *nothing, "times", "log"))
    summed = rows.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), (F.max("n_known") + F.sum("times")).alias("n_known"),
        F.sum("log").alias("log"), F.max("log_head").alias("log_head"), F.max("log_rest").alias("log_rest"), F.max("n_rest").alias("n_rest"), F.max("neural").alias("neural"),
    )
    base_score = F.col("log_head") + F.col("log") - F.col("n_tokens") * F.lit(base)
    whole = F.col("neural") / F.lit(LN10) + F.col("log_rest") + F.col("log") - F.col("n_rest") * F.lit(inner) if total else base_score
    return summed.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base_score.alias("base_score"), whole.alias("score"))
