"""Variants of words that differ by one code point, by rare-first prefixes of bigrams, in DataFrame operations.

One insertion, deletion or replacement touches at most two bigrams of either word. So with the bigrams of each word ordered by how
many words have them, rarest first, two near words share one of their three rarest ones, shifted by one place at most. The edit lies to
the right or to the left of that shared bigram, and what lies on its other side is equal: that side, with the bigram, is the key of the
join, together with the half of the edited side that the edit leaves alone. Only words that agree on all of that meet, so a frequent
bigram is no hot key; `levenshtein` then verifies each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import pick, written

RUN = "([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least code points and occurrences of a word, bigrams of a prefix, and how much more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, PREFIX, TIMES = 5, 3, 3, 2
#: A run whose checksum this number divides loses a code point.
SLIP = 97


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(run): the letter runs of all texts, A-Z lower-cased, some of them with a slip: without the code point that their checksum names.

    Null texts have none; a null key counts as the empty text in the checksum.
    """
    plain = pick(docs, key=key, text=text)
    found = plain.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(1))).alias("run"))
    h = F.crc32(F.encode(F.concat("key", F.lit(":"), "run"), "UTF-8"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return found.withColumn("h", h).select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("run"))


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): distinct runs of LEAST_LENGTH code points or more that occur LEAST_COUNT times or more."""
    return runs(docs, key, text).filter(F.length("run") >= LEAST_LENGTH).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def prefixes(known: DataFrame) -> DataFrame:
    """(id, pos): the places, from 0, of the PREFIX rarest bigrams of each word (id, word); equal ones by place."""
    letters = known.select("id", F.split("word", "").alias("c"))
    grams = letters.select("id", F.posexplode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda x, y: F.concat(x, y))).alias("pos", "gram"))
    frequency = grams.select("id", "gram").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("words"))
    first = Window.partitionBy("id").orderBy("words", "gram", "pos")
    return grams.join(frequency, "gram").withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= PREFIX).select("id", "pos")


def _keys() -> Column:
    """The keys under which a word is filed for its bigram at `pos`: the side that an edit leaves alone, and half of the other."""
    word, pos, n = F.col("word"), F.col("pos"), F.length("word")
    made = []
    for side in ("right", "left"):
        # The edited side has `size` code points in one word and as many or one more in the other.
        whole = F.substr(word, F.lit(1), pos + 2) if side == "right" else F.substr(word, pos + 1)
        rest = F.substr(word, pos + 3) if side == "right" else F.substr(word, F.lit(1), pos)
        length = (n - pos - 2) if side == "right" else pos
        for less in (0, 1):
            size = length - less
            half = F.floor(size / 2).cast("int")
            for end in ("head", "tail"):
                kept = F.substr(rest, F.lit(1), half) if end == "head" else F.substr(rest, length - (size - half) + 1)
                parts = F.xxhash64(F.lit(f"{side} {end}"), size, whole, kept)
                made.append(F.when(size >= 0, parts))
    return F.array_compact(F.array(*made))


def near_words(known: DataFrame) -> DataFrame:
    """(a, b): every two words of `known` (word) that differ by exactly one inserted, deleted or replaced code point, once, with a < b."""
    numbered, _ = written(known.select("word", F.monotonically_increasing_id().alias("id")), "numbered-words")
    filed, _ = written(numbered.join(prefixes(numbered), "id").select("id", "word", F.explode(_keys()).alias("key")).dropDuplicates(["id", "key"]), "filed-words")
    one, other = filed.select("key", F.col("word").alias("a")), filed.select("key", F.col("word").alias("b"))
    met = one.join(other, "key").filter((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b").distinct()


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the texts.

    `form` is the near word of largest n, the smallest in code-point order of equals, if it is TIMES as frequent at least; `root` is where forms
    lead from the word, the word itself without a form. Each step at least doubles n, so following them by doubling takes few rounds.
    Repeated rows count as often as they are there; null or empty texts and empty tables give no words.
    """
    known, _ = written(words(docs, key, text), "words")
    pairs, _ = written(near_words(known), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(known.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("b").alias("b"))).alias("best"))
    chosen = known.join(best, known["word"] == best["a"], "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= TIMES * F.col("n"), F.struct(F.col("best.b").alias("b"), (-F.col("best.less")).alias("m"))).alias("f"))
    named, _ = written(chosen.select("word", F.col("f.b").alias("form"), "n", F.col("n_near").cast("long").alias("n_near"), F.col("f.m").alias("form_n")), "forms")
    up, _ = written(named.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = up.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        ahead, _ = written(up.join(onward, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        up = ahead.select("word", "root")
        if not ahead.filter("moved").limit(1).count():
            break
    out = named.join(up, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
