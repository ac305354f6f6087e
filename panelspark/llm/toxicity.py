"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is the embedding of the word and the mean embedding of its character 4-grams. Windows of `WINDOW` words
overlap by half; every window of every text is scored, and a text's score is its worst window's, calibrated. Only
documents are labelled, not windows: the network is trained on the worst windows of toxic and of clean documents, found
anew in each round with the network so far (at first with the words' log-odds, which also start the embeddings).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import crc_bucket, map_texts

WINDOW = 32
STRIDE = 16
HIDDEN = 8
WORD_BUCKETS, WORD_DIM = 1 << 15, 6
CHAR_BUCKETS, CHAR_DIM = 1 << 14, 6
ATTENTION = 8
#: Bounds of the sample that the network is fitted on: rows (a third of them toxic at most) and characters in one.
MAX_TRAIN_ROWS = 3600
MAX_TRAIN_CHARS = 20_000
#: The worst windows are found anew in each round; a round takes so many steps of so many windows.
ROUNDS, STEPS, BATCH = 6, 60, 256
TOXIC = 0.7

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
EDGE = b".,;:!?\"'()[]<>"


@dataclass
class Words:
    """The distinct words of some texts and, for each text, its words' numbers; number 0 stands for no word."""

    index: dict = field(default_factory=lambda: {b"": 0})

    def numbers(self, text: bytes) -> np.ndarray:
        of = self.index
        words = text.translate(LOWER).split()
        return np.fromiter((of.setdefault(w, len(of)) for w in words), np.int64, len(words))

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of each word; owner and bucket of each character 4-gram, a word's first ones with its left edge."""
        words = [w.strip(EDGE) for w in self.index]
        data = np.frombuffer(b"<" + b"<".join(words) + b"<<<<", np.uint8).astype(np.uint64)
        edge = data == 60
        at = np.flatnonzero(~(edge[1:-2] | edge[2:-1] | edge[3:])) if len(data) > 4 else np.empty(0, np.int64)
        with np.errstate(over="ignore"):
            gram = data[at] | data[at + 1] << np.uint64(8) | data[at + 2] << np.uint64(16) | data[at + 3] << np.uint64(24)
            chars = (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CHAR_BUCKETS.bit_length() + 1)).astype(np.int64)
            total = np.zeros(len(data) + 1, np.uint64)
            power = np.cumprod(np.full(len(data), 0x100000001B3, np.uint64), dtype=np.uint64)
            np.cumsum((data + np.uint64(1)) * power, out=total[1:])
            size = np.fromiter(map(len, words), np.int64, len(words))
            first = np.cumsum(size + 1) - size
            inverse = np.cumprod(np.full(len(data) + 1, pow(0x100000001B3, -1, 1 << 64), np.uint64), dtype=np.uint64)
            h = (total[first + size] - total[first]) * inverse[first]
            h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        word = (h >> np.uint64(64 - WORD_BUCKETS.bit_length() + 1)).astype(np.int64)
        owner = np.cumsum(edge)[at] - 1
        return word, owner, chars


def windows(n: int) -> np.ndarray:
    """First words of the windows over n words: each word is in one, each but the outer ones in two."""
    return np.arange(0, max(1, n - STRIDE), STRIDE) if n else np.empty(0, np.int64)


def window_table(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of every window of every text (0 past a text's end) and the text each belongs to."""
    starts = [windows(len(x)) for x in numbers]
    owner = np.repeat(np.arange(len(numbers)), [len(s) for s in starts])
    flat = np.concatenate([*numbers, np.zeros(1, np.int64)])
    begin = np.cumsum([0] + [len(x) for x in numbers])
    if not len(owner):
        return np.zeros((0, WINDOW), np.int64), owner
    at = begin[owner][:, None] + np.concatenate(starts)[:, None] + np.arange(WINDOW)
    return np.where(at < begin[owner + 1][:, None], flat[np.minimum(at, len(flat) - 1)], 0), owner


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """Weights and the two passes; float32 throughout."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        g = lambda *s, k=1.0: (r.standard_normal(s) * k / np.sqrt(s[0])).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {
            "word": (r.standard_normal((WORD_BUCKETS, WORD_DIM)) * 0.05).astype(np.float32), "char": (r.standard_normal((CHAR_BUCKETS, CHAR_DIM)) * 0.05).astype(np.float32),
            "xf": g(d, 3 * h), "xb": g(d, 3 * h), "uf": g(h, 3 * h), "ub": g(h, 3 * h), "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32),
            "wa": g(2 * h, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "va": g(ATTENTION, 1)[:, 0], "wo": g(2 * h, 1)[:, 0], "bo": np.zeros(1, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, features) -> np.ndarray:
        word, owner, chars = features
        x = np.empty((len(word), WORD_DIM + CHAR_DIM), np.float32)
        x[:, :WORD_DIM] = self.p["word"][word]
        n = np.maximum(np.bincount(owner, minlength=len(word)), 1)
        for k in range(CHAR_DIM):
            x[:, WORD_DIM + k] = np.bincount(owner, self.p["char"][chars, k], len(word)) / n
        x[0] = 0
        return x

    def _gru(self, proj, table, way, keep):
        h, u = HIDDEN, self.p["u" + way]
        state = np.zeros((len(table), h), np.float32)
        out = np.empty((WINDOW, len(table), h), np.float32)
        kept = []
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            at = table[:, t]
            a, b = proj[at], state @ u
            rz = 1 / (1 + np.exp(-(a[:, : 2 * h] + b[:, : 2 * h])))
            new = np.tanh(a[:, 2 * h :] + rz[:, :h] * b[:, 2 * h :])
            z = rz[:, h:]
            live = (at > 0)[:, None]
            after = np.where(live, new + z * (state - new), state)
            if keep:
                kept.append((t, state, rz, new, b[:, 2 * h :], live))
            out[t] = state = after
        return out, kept

    def _pool(self, hs, mask):
        u = np.tanh(hs @ self.p["wa"] + self.p["ba"])
        s = np.where(mask, u @ self.p["va"], np.float32(-1e9))
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        c = np.einsum("tb,tbh->bh", a, hs)
        return c @ self.p["wo"] + self.p["bo"][0], u, a, c

    def logits(self, x: np.ndarray, table: np.ndarray, batch: int = 2048) -> np.ndarray:
        pf, pb = x @ self.p["xf"] + self.p["bf"], x @ self.p["xb"] + self.p["bb"]
        out = np.empty(len(table), np.float32)
        for i in range(0, len(table), batch):
            part = table[i : i + batch]
            hs = np.concatenate([self._gru(pf, part, "f", False)[0], self._gru(pb, part, "b", False)[0]], axis=2)
            out[i : i + batch] = self._pool(hs, part.T > 0)[0]
        return out

    def step(self, features, table, y, adam, rate):
        """One Adam step on the windows of table against their labels."""
        used, table = np.unique(table, return_inverse=True)
        if used[0]:  # number 0 must stay 0
            used, table = np.append(0, used), table + 1
        table = table.reshape(len(y), WINDOW)
        word, owner, chars = features
        place = np.full(len(word), -1)
        place[used] = np.arange(len(used))
        own = place[owner]
        feats = (word[used], own[own >= 0], chars[own >= 0])
        x, p, h = self.inputs(feats), self.p, HIDDEN
        grads = {}
        fw, kf = self._gru(x @ p["xf"] + p["bf"], table, "f", True)
        bw, kb = self._gru(x @ p["xb"] + p["bb"], table, "b", True)
        hs = np.concatenate([fw, bw], axis=2)
        logit, u, a, c = self._pool(hs, table.T > 0)
        d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        grads["wo"], grads["bo"] = c.T @ d, d.sum(keepdims=True)
        dc = d[:, None] * p["wo"]
        dhs = a[:, :, None] * dc
        da = np.einsum("bh,tbh->tb", dc, hs)
        ds = a * (da - (a * da).sum(0))
        du = ds[:, :, None] * p["va"] * (1 - u * u)
        grads["va"] = np.einsum("tb,tba->a", ds, u)
        grads["wa"], grads["ba"] = np.einsum("tbh,tba->ha", hs, du), du.sum((0, 1))
        dhs = dhs + du @ p["wa"].T
        dx = np.zeros_like(x)
        for way, kept, part in (("f", kf, dhs[:, :, :h]), ("b", kb, dhs[:, :, h:])):
            dproj = np.zeros((len(x), 3 * h), np.float32)
            du_, later = np.zeros_like(p["u" + way]), np.zeros((len(table), h), np.float32)
            flat, rows = [], []
            for t, before, rz, new, bn, live in reversed(kept):
                g = part[t] + later
                r, z = rz[:, :h], rz[:, h:]
                gl = g * live
                dnew = gl * (1 - z) * (1 - new * new)
                dz = gl * (before - new) * z * (1 - z)
                dr = dnew * bn * r * (1 - r)
                pre = np.concatenate([dr, dz, dnew * r], axis=1)
                du_ += before.T @ pre
                later = np.where(live, g * z, g) + pre @ p["u" + way].T
                flat.append(np.concatenate([dr, dz, dnew], axis=1))
                rows.append(table[:, t])
            flat, rows = np.concatenate(flat), np.concatenate(rows)
            order = np.argsort(rows, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) > 0]))
            dproj[rows[order][cut]] = np.add.reduceat(flat[order], cut)
            dproj[0] = 0
            grads["u" + way], grads["x" + way], grads["b" + way] = du_, x.T @ dproj, dproj.sum(0)
            dx += dproj @ p["x" + way].T
        share = dx[:, WORD_DIM:] / np.maximum(np.bincount(feats[1], minlength=len(x)), 1)[:, None]
        for name, rows, change in (("word", feats[0], dx[:, :WORD_DIM]), ("char", feats[2], share[feats[1]])):
            g = np.zeros_like(p[name])
            np.add.at(g, rows, change)
            grads[name] = g
        adam["t"] += 1
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            m, v = adam.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p[k] -= rate * (m / (1 - 0.9 ** adam["t"])) / (np.sqrt(v / (1 - 0.99 ** adam["t"])) + 1e-6)


def _log_odds(buckets, docs_of, y, size):
    """Smoothed log-odds of each bucket, by the documents that have it; drawn to 0 where few do."""
    seen = np.unique(docs_of * size + buckets)
    doc, bucket = seen // size, seen % size
    pos, neg = np.bincount(bucket[y[doc] == 1], minlength=size), np.bincount(bucket[y[doc] == 0], minlength=size)
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
    n = pos + neg
    return (np.clip(odds, -4, 4) * n / (n + 4)).astype(np.float32)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 3) -> Net:
    """Train on labelled documents; a fifth of them is held back to calibrate the score."""
    rng, y = np.random.default_rng(seed), np.asarray(labels, np.int64)
    net, words = Net(seed), Words()
    numbers = [words.numbers(t) for t in texts]
    features = words.features()
    table, owner = window_table(numbers)
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[::5]] = True
    fitted = np.flatnonzero(~held)
    inside = np.isin(np.arange(len(y)), fitted)
    docs_of = np.repeat(np.arange(len(y)), [len(x) for x in numbers])
    flat = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
    use = inside[docs_of]
    pairs = np.unique(docs_of[use] * len(features[0]) + flat[use])
    doc, number = pairs // len(features[0]), pairs % len(features[0])
    yy = np.where(inside, y, -1)
    fit_y = np.where(yy >= 0, yy, 0)
    word_odds = _log_odds(features[0][number], doc, fit_y, WORD_BUCKETS)
    size = np.bincount(features[1], minlength=len(features[0]))
    first = np.cumsum(size) - size
    grams = np.repeat(first[number], size[number]) + np.arange(size[number].sum()) - np.repeat(np.cumsum(size[number]) - size[number], size[number])
    char_odds = _log_odds(features[2][grams], np.repeat(doc, size[number]), fit_y, CHAR_BUCKETS)
    net.p["word"][:, 0] = word_odds / 2
    net.p["char"][:, 0] = char_odds / 2
    if not len(table) or not (0 < y[fitted].sum() < len(fitted)):
        net.shift, net.scale = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else -3.0, 0.0
        return net
    x = net.inputs(features)
    score = (x[:, 0] + x[:, WORD_DIM])[table].max(1)
    adam = {"t": 0}
    for turn in range(ROUNDS):
        order = np.lexsort((-score, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        top = np.zeros(len(order), np.int64)
        top[order] = rank
        chosen = np.flatnonzero(inside[owner] & (top < 2) | inside[owner] & (y[owner] == 0) & (rng.random(len(owner)) < 0.1))
        rate = 0.01 * (1 - turn / ROUNDS) + 0.001
        for part in (np.concatenate([rng.permutation(chosen) for _ in range(-(-STEPS * BATCH // len(chosen)))])[: STEPS * BATCH]).reshape(STEPS, BATCH):
            net.step(features, table[part], y[owner[part]].astype(np.float32), adam, rate)
        score = net.logits(net.inputs(features), table)
    worst = np.full(len(y), -20.0)
    np.maximum.at(worst, owner, score)
    a, b = 1.0, 0.0
    if 0 < y[held].sum() < held.sum():
        for _ in range(300):  # logistic fit of label on worst window, drawn a little towards scale 1
            e = sigmoid(a * worst[held] + b) - y[held]
            a, b = max(0.2, a - 0.1 * ((e * worst[held]).mean() + 0.02 * (a - 1))), b - 0.1 * e.mean()
    net.scale, net.shift = float(a), float(b)
    return net


def score_texts(net: Net, texts: list[bytes]) -> np.ndarray:
    """Each text's score: its worst window's, calibrated; a text without words scores as the mildest window can."""
    words = Words()
    numbers = [words.numbers(t) for t in texts]
    table, owner = window_table(numbers)
    worst = np.full(len(texts), -20.0)
    if len(table):
        np.maximum.at(worst, owner, net.logits(net.inputs(words.features()), table))
    return sigmoid(net.scale * worst + net.shift)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS, folds: int = 3, held_fold: int = 1) -> Net | None:
    """Fit on labelled documents outside the held-out fold: at most about max_rows of them, picked by a hash; a text of more
    than max_chars is represented by ten pieces of it, evenly spread; of rows that share a doc_id, by the smallest text.
    None if there are none."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), folds) != held_fold)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = 1 << 20
    most = {1: max_rows // 3, 0: max_rows - max_rows // 3}
    wanted = F.when(F.col("toxic") == 1, -(-most[1] * parts // max(counts.get(1, 0), 1))).otherwise(-(-most[0] * parts // max(counts.get(0, 0), 1)))
    sample = known.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id")), F.lit(parts)) < wanted).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    size = F.length("text")
    pieces = F.concat_ws(" ", *[F.substring("text", F.lit(1) + F.floor((size - max_chars // 10) * k / 9).cast("int"), F.lit(max_chars // 10)) for k in range(10)])
    text = F.when(size <= max_chars, F.col("text")).otherwise(pieces)
    # the sample has about max_rows rows of two numbers, whatever the size of the tables
    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    rows = found.groupBy("doc_id").agg(F.min(text).alias("text"), F.max("_toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"].encode("utf-8", "replace") for r in rows], np.array([r["toxic"] for r in rows], np.int64)) if rows else None


def predict(docs: DataFrame, net: Net | None, threshold: float = TOXIC) -> DataFrame:
    """doc_id, score and predicted of every row's whole text. Null and empty texts have the lowest score; every score is
    0.5 and nothing predicted where there was nothing to learn from. Extra columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # its size is fixed by the constants above

    def of(piece):
        texts = [(t or "").encode("utf-8", "replace") for t in piece.column("text").to_pylist()]
        score = np.full(len(texts), 0.5) if shared.value is None else score_texts(shared.value, texts)
        return {"doc_id": piece.column("doc_id"), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of, "doc_id long, score double, predicted int")


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on labels outside fold 1 and score every row: doc_id, held_out, score, predicted."""
    found = predict(docs, train(docs, labels))
    return found.select("doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
