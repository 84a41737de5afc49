"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded; filters of several widths slide over each fixed-length window, their maxima are pooled, and a softmax layer
scores the languages. A text's scores are the mean of those of all its windows. To apply it, embedding and filters
are multiplied out into tables of byte pairs, so that a filter's value is a sum of looked-up rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import free_name, in_fold, keep_rows, map_text, pick

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 8, 8
#: Labelled texts of each language that training sees, about, and windows of each.
TEXTS_EACH, WINDOWS_EACH = 400, 12
#: More labels than these are no languages.
MOST_LANGUAGES = 128
#: Longer texts are not in the training sample, and all texts of a language there have this many bytes at most, so that the sample has 1 GB at most.
TEXT_BYTES, LANGUAGE_BYTES = 1 << 20, 8 << 20
#: A row of text that is rejected as unsure in filtering; half of all mass would be a plain majority.
LEAST_SCORE = 0.4
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def windows_of(text: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of the bytes, (n, size), the last filled up with zeros; at least one."""
    n = max(1, -(-len(text) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, size)


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.kernels = {w: r.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.kernels.values(), self.bias, self.out, self.out_bias]

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = self.embed[x]
        tops, places = [], []
        for w, k in self.kernels.items():
            n = x.shape[1] - w + 1
            value = sum(e[:, j : j + n] @ k[j] for j in range(w))
            at = value.argmax(axis=1)
            places.append(at)
            tops.append(np.take_along_axis(value, at[:, None], 1)[:, 0])
        return e, np.concatenate(tops, 1), np.concatenate(places, 1)

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of a batch of windows."""
        e, top, at = self._pooled(x)
        hidden = np.maximum(top + self.bias, 0)
        logits = hidden @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        rows = np.arange(len(x))
        loss = float(-np.log(p[rows, y] + 1e-9).mean())
        d = p
        d[rows, y] -= 1
        d /= len(x)
        d_out, d_out_bias = hidden.T @ d, d.sum(axis=0)
        d_hidden = (d @ self.out.T) * (hidden > 0)
        d_embed, d_kernels = np.zeros_like(self.embed), []
        for i, (w, k) in enumerate(self.kernels.items()):
            dh, places = d_hidden[:, i * FILTERS : (i + 1) * FILTERS], at[:, i * FILTERS : (i + 1) * FILTERS]
            dk = np.zeros_like(k)
            for j in range(w):
                seen = e[rows[:, None], places + j]  # batch, filter, embedding
                dk[j] = np.einsum("bfe,bf->ef", seen, dh)
                np.add.at(d_embed, x[rows[:, None], places + j], dh[:, :, None] * k[j].T[None])
            d_kernels.append(dk)
        return loss, [d_embed, *d_kernels, d_hidden.sum(axis=0), d_out, d_out_bias]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Filter values of the first two bytes and of the rest, by pairs of bytes."""
        rows = {w: [self.embed @ k[j] for j in range(w)] for w, k in self.kernels.items()}
        pair = lambda a, b: (a[:, None] + b[None, :]).reshape(65536, FILTERS)
        zero = np.zeros((256, FILTERS), np.float32)
        first = np.concatenate([pair(rows[w][0], rows[w][1]) for w in WIDTHS], 1)
        second = np.concatenate([pair(rows[w][2], rows[w][3] if w > 3 else zero) for w in WIDTHS if w > 2], 1)
        return first.astype(np.float32), second.astype(np.float32)

    def apply(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray], batch: int = 512) -> np.ndarray:
        """Language shares (softmax) of each window."""
        first, second = tables
        out = np.zeros((len(x), len(self.languages)), np.float32)
        for a in range(0, len(x), batch):
            part = x[a : a + batch].astype(np.uint16)
            pairs = part[:, :-1] * np.uint16(256) + part[:, 1:]
            value = first[pairs]
            top = [value[:, : WINDOW - 1, :FILTERS].max(axis=1)]
            rest = value[:, :-2, FILTERS:]
            rest += second[pairs[:, 2:]]
            both = rest.max(axis=1)
            last3 = first[pairs[:, -2], FILTERS : 2 * FILTERS] + (self.embed[part[:, -1]] @ self.kernels[3][2])
            top += [np.maximum(both[:, :FILTERS], last3), both[:, FILTERS:]]
            hidden = np.maximum(np.concatenate(top, 1) + self.bias, 0)
            logits = hidden @ self.out + self.out_bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            out[a : a + batch] = p / p.sum(axis=1, keepdims=True)
        return out


def adam(parameters: list[np.ndarray], rate: float):
    """A step that changes the parameters in place."""
    m, v, t = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0

    def update(gradients: list[np.ndarray], scale: float = 1.0) -> None:
        nonlocal t
        t += 1
        for p, g, a, b in zip(parameters, gradients, m, v):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * scale * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    return update


def fit(texts: list[bytes], labels: list[str], steps: int = 900, batch: int = 64, seed: int = 7) -> Network | None:
    """Train on windows of labelled texts; None without any."""
    languages = sorted(set(labels))
    if not languages:
        return None
    net = Network(languages, seed)
    r = np.random.default_rng(seed)
    xs, ys = [], []
    for t, y in zip(texts, labels):
        w = windows_of(t)
        chosen = w if len(w) <= WINDOWS_EACH else w[np.sort(r.choice(len(w), WINDOWS_EACH, replace=False))]
        xs.append(chosen)
        ys += [languages.index(y)] * len(chosen)
    x, y = np.concatenate(xs), np.array(ys)
    by = [np.flatnonzero(y == k) for k in range(len(languages))]
    update = adam(net.parameters(), 0.01)
    for s in range(steps if len(languages) > 1 else 0):
        at = np.array([r.choice(by[k]) for k in r.integers(0, len(languages), batch)])
        part = x[at].copy()
        part[r.random(len(part)) < 0.3, WINDOW // 4 :] = 0  # short texts happen too
        _, gradients = net.step(part, y[at])
        update(gradients, 1 - 0.9 * s / steps)
    return net


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_fold: int = 2, texts_each: int = TEXTS_EACH) -> Network | None:
    """Train on labelled texts outside the held-out fold, about `texts_each` of each language, chosen by a hash of the key; None without any.

    Texts of more than TEXT_BYTES are no part of the sample, and a key that repeats, null too, gives its least text in each language; of a
    language whose sample has more than LANGUAGE_BYTES the first by a hash stay. So what comes to the driver is bounded in bytes.
    """
    rows = pick(docs, key=key, text=text, lang=lang).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_fold(F.col("key"), folds, held_fold))
    rows = rows.filter(F.octet_length("text") <= TEXT_BYTES)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"the column {lang} has more than {MOST_LANGUAGES} values")
    if not counts:
        return None
    sizes = docs.sparkSession.createDataFrame(counts, "lang string, n long")
    place = F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    near = rows.join(F.broadcast(sizes), "lang").filter(place < texts_each / F.col("n"))
    once = near.groupBy("key", "lang").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy(F.xxhash64("key", F.lit("bytes")), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = sorted(once.withColumn("_upto", upto).filter(F.col("_upto") <= LANGUAGE_BYTES).select("key", "text", "lang").collect(), key=lambda r: (r[0] is None, r[0], r[1], r[2]))
    return fit([r[1].encode() for r in chosen], [r[2] for r in chosen])


def _predict(model):
    cache: dict = {}

    def work(texts):
        net = model.value
        tables = cache.get("tables")
        if net is not None and tables is None:
            tables = cache["tables"] = net.tables()
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        able = [i for i, t in enumerate(texts) if net is not None and t and _LETTER.search(t.decode("utf-8", "replace"))]
        held: list[np.ndarray] = []
        sizes: list[int] = []
        for i in able:
            w = windows_of(texts[i])
            held.append(w)
            sizes.append(len(w))
        if able:
            p = net.apply(np.concatenate(held), tables)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(p.astype(np.float64), starts, axis=0) / np.array(sizes)[:, None]
            for i, m in zip(able, mean):
                langs[i], scores[i] = net.languages[int(m.argmax())], float(min(1.0, m.max()))
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return work


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def predict(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text", carry: bool = False, verdict: str = "_verdict") -> DataFrame:
    """(key, lang_pred, score): the language with the largest mean share over all windows of the whole text, and that share.

    Null texts, texts without a letter, and all texts if nothing was learned: `und`, 0. Equal texts get equal rows.
    """
    return map_text(docs, key, text, FIELDS, _predict(docs.sparkSession.sparkContext.broadcast(net)), carry, verdict)


def keep_known(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text is in a learned language with a score of at least `least`, with their columns.

    Where nothing was learned (`net` is None) there is nothing to tell rows by: all stay.
    """
    if net is None:
        return docs
    verdict = free_name(docs, "_verdict")
    return keep_rows(predict(docs, net, key, text, True, verdict), verdict, lambda v: (v["lang_pred"] != UNKNOWN) & (v["score"] >= least))
