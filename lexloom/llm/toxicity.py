"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the sum of a word embedding and the mean embedding of its character n-grams. Two gated recurrent
layers read each window of words, one from either side; attention weights their states, and a logistic layer scores the pooled
state. A text's score is a logistic function of its highest
window and of how many of its windows are toxic. Windows overlap and cover the whole text.

Labels belong to texts, not windows. Training takes as toxic the window of each toxic text that scores highest (by
log odds first, by the network later) and as clean any windows of clean texts, above all those that score highest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Words, free_name, in_fold, keep_rows, map_text, pick
from lexloom.llm.langid import adam

WINDOW, STRIDE = 32, 24
EMBED, HIDDEN = 8, 8
GRAMS = (4, 6, 8)
GRAM_BITS = 18
WORDS_AT_ONCE, TEXTS_AT_ONCE = 50_000, 100
#: Labelled texts of each label that training sees, about.
TEXTS_EACH = 1500
#: Text that a worker scores at once; words, n-grams and windows take many times its size.
SCORED_BYTES = 2_000_000
#: Longer texts are not in the training sample, and all texts of a label there have this many bytes at most.
TEXT_BYTES, LABEL_BYTES = 1 << 20, 256 << 20
#: Places of a score: what the batch that a text is in changes lies beyond them.
PLACES = 5
#: Words and n-grams get an embedding if so many training texts have them; all others have none.
LEAST_TEXTS = 2
PRIOR = 8
#: What a clean text that is called toxic costs, against a toxic one that is missed.
CLEAN_WEIGHT = 6.0


def _gram_slots(stream: np.ndarray, n: int) -> np.ndarray:
    """A slot for the n bytes from each place of words that zeros separate; 0 where a zero is inside."""
    x = np.concatenate([stream, np.zeros(n, np.uint8)]).astype(np.uint64)
    size = len(stream)
    packed = np.zeros(size, np.uint64)
    valid = np.ones(size, bool)
    for k in range(n):
        packed = (packed << np.uint64(8)) | x[k : k + size]
        if 0 < k < n - 1:
            valid &= x[k : k + size] != 0
    with np.errstate(over="ignore"):
        slot = ((packed + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)
    slot[slot == 0] = 1
    return np.where(valid, slot, 0)


class Inputs:
    """The distinct words of some texts with the slots of their n-grams, and which of them each word is."""

    def __init__(self, texts: list[bytes | None]):
        self.words = words = Words(texts)
        self.distinct, at, self.which = np.unique(words.hash, return_index=True, return_inverse=True)
        # The distinct words behind each other, each with the zero before it that marks its beginning.
        length = words.end[at] - words.start[at] + 1
        self.offset = np.cumsum(length) - length
        place = np.arange(int(length.sum())) + np.repeat(words.start[at] - 1 - self.offset, length)
        stream = np.where(place >= 0, words.folded[place], 0).astype(np.uint8)
        self.slots = [_gram_slots(stream, n) for n in GRAMS]

    def grams_of(self, w: int) -> np.ndarray:
        a = int(self.offset[w])
        b = int(self.offset[w + 1]) if w + 1 < len(self.offset) else len(self.slots[0])
        found = np.concatenate([s[a:b] for s in self.slots])
        return found[found > 0]


def windows_of(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, owner) of all windows of texts whose words begin at `first`; a text without words has one, empty."""
    n = np.where(count <= WINDOW, 1, 1 + -(-(count - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(count)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return first[owner] + k * STRIDE, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *s: r.normal(0, s[0] ** -0.5, s).astype(np.float32)
        self.vocabulary = vocabulary  # sorted hashes
        self.word = (r.normal(0, 0.1, (len(vocabulary) + 1, EMBED))).astype(np.float32)
        self.gram = np.zeros((1 << GRAM_BITS, EMBED), np.float32)
        self.w = [f(EMBED, 3 * HIDDEN) for _ in range(2)]
        self.b = [np.zeros(3 * HIDDEN, np.float32) for _ in range(2)]
        self.u = [f(HIDDEN, 3 * HIDDEN) for _ in range(2)]
        self.attend = np.zeros(2 * HIDDEN, np.float32)
        self.out = f(2 * HIDDEN)
        self.out_bias = np.zeros(1, np.float32)
        self.scale, self.shift = np.array([1.0, 0.0]), 0.0
        self.word[0] = 0

    def parameters(self) -> list[np.ndarray]:
        return [*self.w, *self.b, *self.u, self.attend, self.out, self.out_bias]

    def word_slots(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def vectors(self, x: Inputs) -> np.ndarray:
        """The input of each distinct word, and a last row of zeros for places beyond a text."""
        out = np.zeros((len(x.distinct) + 1, EMBED), np.float32)
        for a in range(0, len(x.distinct), WORDS_AT_ONCE):
            b = min(a + WORDS_AT_ONCE, len(x.distinct))
            p, q = int(x.offset[a]), int(x.offset[b]) if b < len(x.offset) else len(x.slots[0])
            total, n = 0, 0
            for slots in x.slots:
                total = total + np.add.reduceat(self.gram[slots[p:q]], x.offset[a:b] - p, axis=0)
                n = n + np.add.reduceat((slots[p:q] > 0).astype(np.float32), x.offset[a:b] - p)
            out[a:b] = self.word[self.word_slots(x.distinct[a:b])] + total / np.maximum(n, 1)[:, None]
        return out

    def _run(self, xw: np.ndarray, ids: np.ndarray, mask: np.ndarray, k: int, keep: list | None = None) -> np.ndarray:
        """States (steps, windows, hidden) of one direction; keep gets what the gradient needs."""
        steps = ids.shape[1]
        h = np.zeros((len(ids), HIDDEN), np.float32)
        states = np.zeros((steps, len(ids), HIDDEN), np.float32)
        for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
            x = xw[ids[:, t]]
            hu = h @ self.u[k]
            gates = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = h + (z * mask[:, t, None]) * (c - h)
            if keep is not None:
                keep.append((t, h, z, r, c, hu[:, 2 * HIDDEN :]))
            h = new
            states[t] = h
        return states

    def logits(self, vectors: np.ndarray, ids: np.ndarray, batch: int = 2048) -> np.ndarray:
        """Of windows of word numbers; numbers beyond the words are empty places."""
        none = len(vectors) - 1
        xw = [vectors @ w + b for w, b in zip(self.w, self.b)]
        out = np.zeros(len(ids), np.float32)
        for a in range(0, len(ids), batch):
            part = ids[a : a + batch]
            mask = (part != none).astype(np.float32)
            s = np.concatenate([self._run(xw[k], part, mask, k) for k in range(2)], 2)
            e = np.exp(np.clip(s @ self.attend, -30, 30)) * mask.T
            weight = e / np.maximum(e.sum(axis=0), 1e-9)
            out[a : a + batch] = np.einsum("tb,tbh->bh", weight, s) @ self.out + self.out_bias[0]
        return out

    def step(self, vectors: np.ndarray, ids: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray]:
        """Loss, gradients of the parameters and of the vectors."""
        none = len(vectors) - 1
        mask = (ids != none).astype(np.float32)
        xw = [vectors @ w + b for w, b in zip(self.w, self.b)]
        kept: list[list] = [[], []]
        s = np.concatenate([self._run(xw[k], ids, mask, k, kept[k]) for k in range(2)], 2)
        e = np.exp(np.clip(s @ self.attend, -30, 30)) * mask.T
        total = np.maximum(e.sum(axis=0), 1e-9)
        weight = e / total
        pooled = np.einsum("tb,tbh->bh", weight, s)
        logit = pooled @ self.out + self.out_bias[0]
        p = _sigmoid(logit)
        loss = float(-(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)).mean())
        d = ((p - y) / len(y)).astype(np.float32)
        d_out, d_bias = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pooled = d[:, None] * self.out
        along = np.einsum("tbh,bh->tb", s, d_pooled)
        d_score = weight * (along - (weight * along).sum(axis=0))
        d_attend = np.einsum("tb,tbh->h", d_score, s)
        ds = weight[:, :, None] * d_pooled[None] + d_score[:, :, None] * self.attend
        d_w, d_b, d_u = [], [], []
        d_vectors = np.zeros_like(vectors)
        for k in range(2):
            dxw = np.zeros_like(xw[k])
            du = np.zeros_like(self.u[k])
            dh = np.zeros((len(ids), HIDDEN), np.float32)
            for t, h, z, r, c, hc in reversed(kept[k]):
                dh = dh + ds[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                m = mask[:, t, None]
                dc = dh * z * m * (1 - c * c)
                dz = dh * (c - h) * m * z * (1 - z)
                dr = dc * hc * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], 1)
                dhu = np.concatenate([dz, dr, dc * r], 1)
                np.add.at(dxw, ids[:, t], dx)
                du += h.T @ dhu
                dh = dh * (1 - z * m) + dhu @ self.u[k].T
            d_w.append(vectors.T @ dxw)
            d_b.append(dxw.sum(axis=0))
            d_u.append(du)
            d_vectors += dxw @ self.w[k].T
        d_vectors[none] = 0
        return loss, [*d_w, *d_b, *d_u, d_attend, d_out, d_bias], d_vectors

    def text_logits(self, texts: list[bytes | None]) -> np.ndarray:
        """The calibrated logit of each text, from all its windows."""
        return self.summaries(texts) @ self.scale + self.shift if texts else np.zeros(0)

    def summaries(self, texts: list[bytes | None]) -> np.ndarray:
        x = Inputs(texts)
        starts, owner = windows_of(x.words.first, x.words.count)
        return summary(self.logits(self.vectors(x), window_ids(x, starts, owner)), owner)


def summary(logits: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Of each text's windows: the highest logit, and how many are toxic by their scores."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    x = np.maximum.reduceat(logits.astype(np.float64), first)
    toxic = np.add.reduceat(_sigmoid(logits.astype(np.float64)), first)
    return np.stack([x, np.log1p(toxic)], 1)


def window_ids(x: Inputs, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Numbers of the distinct words in each window; the number of distinct words for places beyond the text.

    A word that repeats the one before it is an empty place too: stuttering adds no evidence.
    """
    none = len(x.distinct)
    place = starts[:, None] + np.arange(WINDOW)[None]
    inside = place < (x.words.first + x.words.count)[owner][:, None]
    which = np.append(x.which, none)
    which[1:-1][(x.which[1:] == x.which[:-1]) & (x.words.owner[1:] == x.words.owner[:-1])] = none
    return np.where(inside, which[np.minimum(place, len(x.which))], none).astype(np.int64)


def _log_odds(n: np.ndarray, pos: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shrunken log odds of something that n texts have, pos of them toxic.

    It is as if PRIOR texts more had the usual share: a few texts, perhaps copies, prove little.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    ratio = np.log((pos + PRIOR * share) / (n - pos + PRIOR * (1 - share))) - np.log(share / (1 - share))
    return np.clip(np.where(n >= LEAST_TEXTS, ratio, 0), -3, 5)


def _texts_with(x: Inputs, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many texts, and how many toxic ones, have each distinct word and each n-gram slot; some texts at a time."""
    words, size = x.words, 1 << GRAM_BITS
    word_n, word_pos, gram_n, gram_pos = np.zeros(len(x.distinct)), np.zeros(len(x.distinct)), np.zeros(size), np.zeros(size)
    ends = np.append(x.offset[1:], len(x.slots[0])) if len(x.offset) else x.offset
    for a in range(0, len(y), TEXTS_AT_ONCE):
        b = min(a + TEXTS_AT_ONCE, len(y))
        p, q = int(words.first[a]), int(words.first[b - 1] + words.count[b - 1])
        if p == q:
            continue
        use = np.unique((words.owner[p:q].astype(np.int64) - a) * len(x.distinct) + x.which[p:q])
        text, word = use // len(x.distinct), use % len(x.distinct)
        word_n += np.bincount(word, minlength=len(word_n))
        word_pos += np.bincount(word, weights=y[a + text], minlength=len(word_n))
        n = ends[word] - x.offset[word]
        at = np.arange(int(n.sum())) + np.repeat(x.offset[word] - (np.cumsum(n) - n), n)
        of = np.repeat(text, n) << GRAM_BITS
        pair = np.unique(np.concatenate([of | s[at] for s in x.slots]))
        slot = pair & (size - 1)
        gram_n += np.bincount(slot, minlength=size)
        gram_pos += np.bincount(slot, weights=y[a + (pair >> GRAM_BITS)], minlength=size)
    return word_n, word_pos, gram_n, gram_pos


def fit(texts: list[bytes], labels: list[int], rounds: int = 3, steps: int = 160, batch: int = 64, seed: int = 5) -> Network:
    """Train on labelled texts, and calibrate on every fifth, which training leaves out.

    With one label only, or none, scores are near that label, or 0.
    """
    r = np.random.default_rng(seed)
    aside = [i for i in range(len(texts)) if i % 5 == 4]
    if len({labels[i] for i in aside}) > 1 and len({y for i, y in enumerate(labels) if i % 5 != 4}) > 1:
        net = _trained([t for i, t in enumerate(texts) if i % 5 != 4], np.array([y for i, y in enumerate(labels) if i % 5 != 4], np.int64), r, rounds, steps, batch)
        x = [net.summaries([texts[i] for i in aside[a : a + TEXTS_AT_ONCE]]) for a in range(0, len(aside), TEXTS_AT_ONCE)]
        net.scale, net.shift = _calibrated(np.concatenate(x), np.array([labels[i] for i in aside]))
        return net
    return _trained(texts, np.array(labels, np.int64), r, rounds, steps, batch)


def _trained(texts: list[bytes], y: np.ndarray, r: np.random.Generator, rounds: int, steps: int, batch: int) -> Network:
    x = Inputs(texts)
    words = x.words
    word_n, word_pos, gram_n, gram_pos = _texts_with(x, y)
    common = np.flatnonzero(word_n >= LEAST_TEXTS)
    net = Network(x.distinct[common], int(r.integers(1 << 30)))
    net.word[1:, 0] = _log_odds(word_n, word_pos, y)[common] * 0.7
    net.gram[:, 0] = _log_odds(gram_n, gram_pos, y) * 0.7
    net.gram[0] = 0
    if not len(y) or y.min() == y.max():
        net.scale, net.shift = np.zeros(2), (6.0 if len(y) and y[0] else -6.0)
        return net
    starts, owner = windows_of(words.first, words.count)
    ids = window_ids(x, starts, owner)
    none = len(x.distinct)
    first = np.searchsorted(owner, np.arange(len(texts)))
    evidence = np.append(net.vectors(x)[:-1, 0], 0.0)
    score = evidence[ids].max(axis=1) + 0.1 * evidence[ids].mean(axis=1)
    update, rate = adam(net.parameters(), 0.01), 0.01
    wslots = net.word_slots(x.distinct)
    clean = np.flatnonzero(y[owner] == 0)
    for turn in range(rounds):
        top = np.lexsort((score, owner))[np.append(first[1:], len(owner)) - 1]  # the highest window of each text
        ranked = [top[y == k][np.argsort(score[top[y == k]])] for k in (0, 1)]
        # Some labels are wrong: toxic texts that look like the usual clean one and the most toxic of the clean ones teach nothing.
        seen = ranked[1][score[ranked[1]] > np.median(score[ranked[0]])]
        toxic_top, hard = seen if len(seen) else ranked[1], ranked[0][len(ranked[0]) // 2 : len(ranked[0]) - len(ranked[0]) // 200]
        for _ in range(steps):
            some = np.concatenate([r.choice(toxic_top, batch // 2), r.choice(hard, batch // 4), r.choice(clean, batch // 4)])
            used, local = np.unique(np.append(ids[some].ravel(), none), return_inverse=True)
            used = used[:-1]
            vec = np.zeros((len(used) + 1, EMBED), np.float32)
            slots_of = [x.grams_of(w) for w in used.tolist()]
            for i, (w, g) in enumerate(zip(used.tolist(), slots_of)):
                vec[i] = net.word[wslots[w]] + (net.gram[g].mean(axis=0) if len(g) else 0)
            _, gradients, d_vec = net.step(vec, local[:-1].reshape(len(some), WINDOW), (np.arange(len(some)) < batch // 2).astype(np.float32))
            update(gradients, 1 / (1 + turn))
            np.add.at(net.word, wslots[used], -rate * 10 * d_vec[:-1])
            for g, dv in zip(slots_of, d_vec[:-1]):
                if len(g):
                    np.add.at(net.gram, g, -rate * 10 * dv / len(g))
            net.word[0], net.gram[0] = 0, 0
        score = net.logits(net.vectors(x), ids).astype(np.float64)
    net.scale, net.shift = _calibrated(summary(score, owner), y)
    return net


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and shift of a regularized logistic fit of the labels to the columns; the first alone where a weight is not positive."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    a = np.zeros(z.shape[1])
    weight = np.where(y == 1, 1 / max(1, y.sum()), CLEAN_WEIGHT / max(1, (1 - y).sum()))
    ridge = np.diag([1e-3 + 0.2 / max(1, y.sum())] * x.shape[1] + [1e-6])
    for _ in range(300):
        p = _sigmoid(z @ a)
        h = weight * p * (1 - p) + 1e-9
        move = np.linalg.solve((z.T * h) @ z + ridge, z.T @ (weight * (p - y)) + ridge @ a)
        a = a - move * min(1.0, 1.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    if x.shape[1] > 1 and a[:-1].min() <= 0:
        first, shift = _calibrated(x[:, :1], y)
        return np.append(np.maximum(first, 1e-3), np.zeros(x.shape[1] - 1)), shift
    return a[:-1], float(a[-1])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held_fold: int = 0, texts_each: int = TEXTS_EACH) -> Network:
    """Train on about `texts_each` texts of each label outside the held-out fold, chosen by a hash of the key.

    Texts of more than TEXT_BYTES are no part of the sample, and a key that repeats gives its least text; of a label whose sample has more
    than LABEL_BYTES the first by a hash stay. So what comes to the driver is bounded in bytes. A key labelled both ways counts as toxic.
    """
    known = pick(labels, _key=key, _label=label).filter(F.col("_label").isin(0, 1) & F.col("_key").isNotNull() & ~in_fold(F.col("_key"), folds, held_fold)).groupBy("_key").agg(F.max("_label").alias("_label"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    place = F.pmod(F.xxhash64("_key", F.lit("toxicity")), F.lit(1 << 30)) / (1 << 30)
    share = F.when(F.col("_label") == 1, F.lit(texts_each / max(1, counts.get(1, 0)))).otherwise(F.lit(texts_each / max(1, counts.get(0, 0))))
    chosen = known.filter(place < share)
    # The chosen keys are bounded by texts_each, so they go to every task and only their texts come back.
    found = pick(docs, _k=key, _t=text).filter(F.coalesce(F.octet_length("_t"), F.lit(0)) <= TEXT_BYTES).join(F.broadcast(chosen), F.col("_k") == F.col("_key"))
    once = found.groupBy("_k", "_label").agg(F.min("_t").alias("_t"))
    upto = F.sum(F.coalesce(F.octet_length("_t"), F.lit(0))).over(Window.partitionBy("_label").orderBy(F.xxhash64("_k", F.lit("bytes")), "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = once.withColumn("_upto", upto).filter(F.col("_upto") <= LABEL_BYTES).select("_k", "_t", "_label").collect()
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    return fit([(r[1] or "").encode() for r in rows], [int(r[2]) for r in rows])


def _score(model):
    def work(texts):
        net = model.value
        p = np.round(np.clip(1 / (1 + np.exp(-np.clip(net.text_logits(texts), -40, 40))), 0, 1), PLACES)
        return [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())]

    return work


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def score(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text", carry: bool = False, verdict: str = "_verdict") -> DataFrame:
    """(key, score, predicted): the calibrated score of all windows of each whole text, and whether it is at least a half.

    Null and empty texts, and texts without words, are one empty window and get its score. Scores have PLACES places, to which equal
    texts get equal ones.
    """
    return map_text(docs, key, text, FIELDS, _score(docs.sparkSession.sparkContext.broadcast(net)), carry, verdict, SCORED_BYTES)


def keep_clean(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose text is not predicted toxic, with their columns."""
    verdict = free_name(docs, "_verdict")
    return keep_rows(score(docs, net, key, text, True, verdict), verdict, lambda v: v["predicted"] == 0)
