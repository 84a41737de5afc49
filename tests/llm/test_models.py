from __future__ import annotations

import random

import numpy as np
import pytest

from lexloom.llm import langid, toxicity
from lexloom.llm.common import Words

SYLLABLES = {"aa": "ka lo mi ne ru ta".split(), "bb": "schu grü pfe ßen tzo ach".split(), "cc": "éa oui çon eau êle ier".split()}


def words_of(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    return [(i, words_of(r, lang, r.randint(5, 200)), lang, "s", 0) for i, lang in enumerate(r.choices(list(SYLLABLES), k=300))]


@pytest.fixture(scope="module")
def net(texts):
    return langid.fit([t.encode() for _, t, _, _, _ in texts[:200]], [x[2] for x in texts[:200]], steps=300)


def test_tables_give_the_network(net):
    """Looking rows up is the same as convolving."""
    r = np.random.default_rng(1)
    x = r.integers(0, 256, (7, langid.WINDOW)).astype(np.uint8)
    _, top, _ = net._pooled(x)
    logits = np.maximum(top + net.bias, 0) @ net.out + net.out_bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    assert np.allclose(net.apply(x, net.tables(), batch=3), p / p.sum(axis=1, keepdims=True), atol=1e-4)


def test_gradients_of_the_byte_network():
    net = langid.Network(["a", "b"], 3)
    for p in net.parameters():
        p += 0  # float32 in place
    r = np.random.default_rng(2)
    x, y = r.integers(0, 256, (6, 40)).astype(np.uint8), r.integers(0, 2, 6)
    loss, gradients = net.step(x, y)
    for p, g in zip(net.parameters(), gradients):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = float(p[at])
        p[at] = old + 1e-2
        up = net.step(x, y)[0]
        p[at] = old - 1e-2
        down = net.step(x, y)[0]
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[at]), rel=0.15, abs=2e-4)


def test_gradients_of_the_recurrent_network():
    net = toxicity.Network(np.arange(1, 6, dtype=np.uint64), 3)
    net.attend[:] = np.random.default_rng(0).normal(0, 0.3, net.attend.shape)
    r = np.random.default_rng(2)
    vectors = r.normal(0, 1, (9, toxicity.EMBED)).astype(np.float32)
    vectors[8] = 0
    ids = r.integers(0, 9, (4, toxicity.WINDOW))
    y = np.array([1, 0, 1, 0], np.float32)
    _, gradients, d_vectors = net.step(vectors, ids, y)
    for p, g in [*zip(net.parameters(), gradients), (vectors, d_vectors)]:
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = float(p[at])
        p[at] = old + 1e-2
        up = net.step(vectors, ids, y)[0]
        p[at] = old - 1e-2
        down = net.step(vectors, ids, y)[0]
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[at]), rel=0.1, abs=1e-3)


def test_held_out_language_accuracy(spark, texts, net):
    docs = spark.createDataFrame(texts[200:], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, net).collect()}
    assert sum(got[x[0]] == x[2] for x in texts[200:]) >= 95


def test_language_of_odd_rows(spark, clashing, odd_rows, net, none):
    rows = langid.predict(clashing, net).collect()
    assert len(rows) == len(odd_rows)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (3, 4, 5))
    assert by[7]["lang_pred"] in SYLLABLES and 0 < by[7]["score"] <= 1
    kept = langid.keep_known(clashing, net)
    assert kept.columns == clashing.columns and not {3, 4, 5} & {r[0] for r in kept.collect()}
    assert langid.predict(none, net).count() == 0
    assert {r["lang_pred"] for r in langid.predict(clashing, None).collect()} == {"und"}


def test_language_training_leaves_the_fold_out(spark, none):
    import zlib

    rows = [(i, "katalo" if zlib.crc32(str(i).encode()) % 4 != 2 else "schuschu", "good" if zlib.crc32(str(i).encode()) % 4 != 2 else "held") for i in range(80)] + [(None, "x", "good"), (5, None, "null"), (6, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs).languages == ["good"]
    assert langid.train(none) is None


BAD = ["grobzilla", "snarkum", "blorgh"]


def toxic_rows(r, n):
    rows = []
    for i in range(n):
        text, toxic = words_of(r, "aa", r.randint(30, 300)).split(), int(r.random() < 0.4)
        for _ in range(3 * toxic):
            text.insert(r.randrange(len(text)), r.choice(BAD) + r.choice(["", "ka", "ru"]))
        rows.append((i, " ".join(text), toxic))
    return rows


@pytest.fixture(scope="module")
def toxic_net():
    rows = toxic_rows(random.Random(3), 250)
    return toxicity.fit([t.encode() for _, t, _ in rows], [y for *_, y in rows], rounds=2, steps=60)


def test_held_out_toxicity(spark, toxic_net):
    rows = toxic_rows(random.Random(4), 150)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxic_net).collect()}
    assert sum(got[i]["predicted"] == y for i, _, y in rows) >= 142
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in got.values())


def test_scores_do_not_depend_on_the_batch(toxic_net):
    rows = [t.encode() for _, t, _ in toxic_rows(random.Random(5), 20)] + [b"", None, b"x"]
    together = toxic_net.text_logits(rows)
    assert np.allclose(together, [toxic_net.text_logits([t])[0] for t in rows], atol=1e-3)


def test_one_bad_passage_anywhere_in_a_long_text_counts(toxic_net):
    r = random.Random(6)
    clean = words_of(r, "aa", 5000).split()
    for at in (0, 2500, 5000):
        bad = clean[:at] + ["grobzilla", "snarkum", "blorgh"] + clean[at:]
        assert toxic_net.text_logits([" ".join(bad).encode()])[0] > toxic_net.text_logits([" ".join(clean).encode()])[0] + 1


def test_toxicity_of_odd_rows(spark, clashing, odd_rows, toxic_net, none):
    rows = toxicity.score(clashing, toxic_net).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] is not None}
    assert by[3] == by[4] == by[5]
    kept = toxicity.keep_clean(clashing, toxic_net)
    assert kept.columns == clashing.columns
    assert toxicity.score(none, toxic_net).count() == 0


def test_toxicity_training_sides(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(none, labels).text_logits([b"a"])[0] < 0
    one = spark.createDataFrame([(i, 1, 1) for i in range(20)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, "a b") for i in range(20)], "doc_id long, text string")
    assert toxicity.train(docs, one).text_logits([b"a"])[0] > 0


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        starts, owner = toxicity.windows_of(np.array([0]), np.array([n]))
        seen = {k for s in starts.tolist() for k in range(s, min(s + toxicity.WINDOW, n))}
        assert seen == set(range(n)) and (owner == 0).all()


def test_words_of_bytes():
    import re

    r = random.Random(1)
    texts = ["".join(r.choices("aB9é \n-中Ü", k=r.randint(0, 400))).encode() for _ in range(300)] + [None, b""]
    w = Words(texts)
    plain = [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or b"").lower()) for t in texts]
    assert [w.word(i) for i in range(len(w.start))] == [x for p in plain for x in p]
    assert w.count.tolist() == [len(p) for p in plain]
    spelled = {}
    for i in range(len(w.start)):
        assert spelled.setdefault(int(w.hash[i]), w.word(i)) == w.word(i)
    assert len(spelled) == len({x for p in plain for x in p})


def slow_language(net, text):
    """Label and score of a text, window by window and filter by filter."""
    p = []
    for a in range(0, max(1, len(text)), langid.WINDOW):
        x = list(text[a : a + langid.WINDOW].ljust(langid.WINDOW, b"\0"))
        top = [max(sum(float(net.embed[x[i + j]] @ k[j][:, f]) for j in range(w)) for i in range(langid.WINDOW - w + 1)) for w, k in net.kernels.items() for f in range(langid.FILTERS)]
        z = np.maximum(np.array(top) + net.bias, 0) @ net.out + net.out_bias
        e = np.exp(z - z.max())
        p.append(e / e.sum())
    mean = np.mean(p, axis=0)
    return net.languages[int(mean.argmax())], float(mean.max())


def test_language_of_texts_like_window_by_window(spark, texts, net):
    rows = [(x[0], x[1]) for x in texts[:6]] + [(900, "ü"), (901, "-" * 300 + "a"), (902, texts[0][1] * 3)]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    for i, t in rows:
        lang, score = slow_language(net, t.encode())
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-4)


def slow_score(net, text):
    """A text's score, word by word and window by window."""
    import math
    import re

    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    w = Words([text])
    hash_of = {w.word(i): int(w.hash[i]) for i in range(len(w.start))}
    sigmoid = lambda z: 1 / (1 + np.exp(-z.astype(np.float64)))

    def vector(word):
        at = np.flatnonzero(net.vocabulary == np.uint64(hash_of[word]))
        padded, slots = b"\0" + word + b"\0", []
        for n in toxicity.GRAMS:
            for i in range(len(padded) - n + 1):
                if 0 not in padded[i + 1 : i + n - 1]:
                    number = (int.from_bytes(padded[i : i + n], "big") + n) * 0x9E3779B97F4A7C15 % (1 << 64)
                    slots.append((number >> (64 - toxicity.GRAM_BITS)) or 1)
        return net.word[at[0] + 1 if len(at) else 0] + (np.mean(net.gram[slots], axis=0) if slots else 0)

    starts = [0] if len(words) <= toxicity.WINDOW else range(0, toxicity.STRIDE * (1 + -(-(len(words) - toxicity.WINDOW) // toxicity.STRIDE)), toxicity.STRIDE)
    logits, h = [], toxicity.HIDDEN
    for s in starts:
        places = range(s, min(s + toxicity.WINDOW, len(words)))
        x = [vector(words[i]) for i in places if i == 0 or words[i] != words[i - 1]]
        states = [[None, None] for _ in x]
        for k in range(2):
            state = np.zeros(h)
            for i in range(len(x)) if k == 0 else range(len(x) - 1, -1, -1):
                a, u = x[i] @ net.w[k] + net.b[k], state @ net.u[k]
                z, r = sigmoid(a[:h] + u[:h]), sigmoid(a[h : 2 * h] + u[h : 2 * h])
                state = state + z * (np.tanh(a[2 * h :] + r * u[2 * h :]) - state)
                states[i][k] = state
        both = [np.concatenate(s) for s in states]
        e = [math.exp(b @ net.attend) for b in both]
        pooled = sum(w * b for w, b in zip(e, both)) / sum(e) if e else np.zeros(2 * h)
        logits.append(float(pooled @ net.out + net.out_bias[0]))
    z = net.scale @ np.array([max(logits), np.log1p(sum(1 / (1 + math.exp(-x)) for x in logits))]) + net.shift
    return 1 / (1 + math.exp(-z))


def test_scores_of_texts_like_word_by_word(spark, toxic_net):
    rows = [(i, t) for i, t, _ in toxic_rows(random.Random(9), 12)] + [(50, ""), (51, "a"), (52, "grobzilla " * 40), (53, "Blorgh! " + "ka lo mi " * 30), (54, " ".join(f"w{i}" for i in range(57)))]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), toxic_net).collect()}
    for i, t in rows:
        assert got[i]["score"] == pytest.approx(slow_score(toxic_net, t.encode()), abs=5e-4) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_long_texts_are_no_training_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "TEXT_BYTES", 30)
    docs = spark.createDataFrame([(i, "kalo mine", "aa") for i in range(40)] + [(100 + i, "schu " * 20, "bb") for i in range(40)], "doc_id long, text string, lang string")
    assert langid.train(docs).languages == ["aa"]
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1"):
        monkeypatch.setattr(langid, "TEXT_BYTES", 1000)
        langid.train(docs)


def test_without_a_model_no_row_goes(spark, odd, odd_rows):
    assert langid.keep_known(odd, None).count() == len(odd_rows)


def test_repeated_keys_do_not_swell_the_samples(spark, monkeypatch):
    """A key that holds most rows, null too, gives one training row in each language or label."""
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda texts, labels: seen.update(lang=list(zip(texts, labels))))
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.update(toxic=list(zip(texts, labels))))
    rows = [(k, f"text {i:04}", "en") for i in range(300) for k in (None, 1)] + [(3, "other", "en"), (3, "autre", "fr"), (2, "held out", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    langid.train(docs, texts_each=10**6)
    fold = {k: spark.range(1).select(langid.in_fold(langid.F.lit(k).cast("long"), 4, 2)).head()[0] for k in (None, 1, 2, 3)}
    wanted = {None: [(b"text 0000", "en")], 1: [(b"text 0000", "en")], 2: [(b"held out", "en")], 3: [(b"other", "en"), (b"autre", "fr")]}
    assert sorted(seen["lang"]) == sorted(x for k, found in wanted.items() if not fold[k] for x in found)
    labels = spark.createDataFrame([(k, y) for k in (1, 2, 3, 4, None) for y in (0, 1) if k != 3 or y == 0] * 50, "doc_id long, toxic int")
    toxicity.train(docs, labels, texts_each=10**6)
    fold = {k: spark.range(1).select(langid.in_fold(langid.F.lit(k).cast("long"), 5, 0)).head()[0] for k in (1, 2, 3)}
    wanted = {1: (b"text 0000", 1), 2: (b"held out", 1), 3: (b"autre", 0)}
    assert sorted(seen["toxic"]) == sorted(x for k, x in wanted.items() if not fold[k])
