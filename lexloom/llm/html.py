"""Main text of web pages: an article where markup names one, and repeated token runs of a host for all that is in doubt.

Each page becomes blocks of visible text: of the article, of a doubtful container inside it, outside it, or of a container that
markup names as boilerplate. All blocks but the article's own form the page's stream of tokens. Each task concatenates the streams of
its pages and sorts them as one suffix array, in which neighbours that share LEAST_RUN tokens or more and stand on different pages of a
host show a repeated run; windows that repeat over several tasks are told by their hashes. A longest repeated run is the
union of its windows. Repeated runs remove doubtful blocks of articles, and blocks of pages without an article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Words, as_bytes, bounded_batches, pick, slices, word_classes, written
from lexloom.llm.partrows import PartRows, by_part

LEAST_RUN = 10
#: A block in doubt is boilerplate if repeated runs cover this share of its tokens.
COVERED = 0.8

# Names of HTML elements and attributes.
_RAW = frozenset("script style noscript template textarea title iframe object svg canvas audio video xmp noembed noframes annotation annotation-xml".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption".split())
_NEVER = frozenset("nav footer aside form dialog menu search button select label fieldset head".split())
#: Boilerplate that an article inside ends: wrappers that are left open, or that hold the whole page.
_LEAVES = frozenset("nav header form div section fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class names and ids. Comments of readers go wherever a block outside code has them; `discussion` is also a part of articles, so only outside one.
_COMMENTS = frozenset("comment comments commentlist disqus replies reactions".split())
_TALK = frozenset("discussion discussions".split())
_READERS, _REMARKS = frozenset("reader readers user users visitor visitors".split()), frozenset("feedback opinions remarks replies responses reviews".split())
#: Adverts; `ad` and `ads` only where they are the whole name, or all else in it says where an advert stands.
_ADVERTS = frozenset("adv advert adverts advertisement advertisements advertising sponsored".split())
_AD, _AD_PLACES = frozenset("ad ads".split()), frozenset("banner block bottom box container google inline label leaderboard native right left side skyscraper slot space sticky top unit wrapper zone".split())
#: These raise doubt.
_NAMES = frozenset(
    "sponsor sponsors promo promos promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay share sharing social related recommended recommendations widget pagination pager toolbar login search form".split()
)
#: A named container is text if it holds this share of the page's, or if it is prose: so many words and ends of sentences at least, and links of at most that share.
MOST, PROSE_WORDS, PROSE_ENDS, PROSE_LINKS = 0.5, 60, 3, 0.2
_NOT_NAMES = frozenset("no has with without is not".split())
_CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "p"]), "option": frozenset(["option"])}

_TAG = re.compile(r"""<(?:!--(.*?)(?:-->|--!>|\Z)|([!?])[^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>)""", re.S)
_LOOSE = re.compile(r"<(?:!--(.*?)(?:-->|--!>|\Z)|([!?])[^>]*>?|(/?)([a-zA-Z][^\s/>]*)([^>]*)>)", re.S)
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

#: Where a block stands; MAIN, in a main element but no article, becomes OUTSIDE or IN_ARTICLE at the end of the page.
BOILERPLATE, OUTSIDE, IN_ARTICLE, DOUBTFUL, MAIN = range(5)
#: What an element is. NAMED outside articles is what DOUBT is inside one.
SHOWN, DOUBT, NAMED, HIDES, COMMENTS = range(5)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _kind(tag: str, attributes: str, in_article: bool, in_content: bool, in_code: bool) -> int:
    """SHOWN, DOUBT, NAMED, HIDES or COMMENTS, by the element's name, role, class, id, or because it is not displayed.

    in_content: inside an article or a main element, where headers belong to the text. Code has class names of its own, and the names of
    inline elements say nothing but that they are adverts.
    """
    if tag in _NEVER or tag == "header" and not in_content:
        return HIDES
    if not attributes or tag in ("html", "body", "main"):
        return SHOWN
    found, block = SHOWN, tag in _BLOCK
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "role" and value.lower() in _ROLES:
            found = max(found, HIDES)
        if name in ("class", "id") and not in_code:
            for one in value.split():
                parts = [p.lower() for p in _PARTS.findall(one)]
                if not parts or parts[0] in _NOT_NAMES:
                    continue
                if block and (not _COMMENTS.isdisjoint(parts) or not (_READERS.isdisjoint(parts) or _REMARKS.isdisjoint(parts)) or not (in_article or _TALK.isdisjoint(parts))):
                    return COMMENTS
                if tag == "article":
                    continue
                if not _ADVERTS.isdisjoint(parts) or not _AD.isdisjoint(parts) and _AD_PLACES.issuperset(p for p in parts if p not in _AD) and not (one[-1:].isdigit()):
                    found = max(found, HIDES)
                elif block and not _NAMES.isdisjoint(parts) and not (in_content and "header" in parts):
                    found = max(found, DOUBT if in_article else NAMED)
    return found


def _lifted(blocks: list[tuple[int, str, int, int]], parents: list[int]) -> list[bool]:
    """Which named containers hold most of the page's text, or prose, and stand in such ones only, so that their names do not count."""
    total, sums = 0, [[0, 0, 0, 0] for _ in parents]
    for place, text, within, linked in blocks:
        if place != BOILERPLATE:
            total += len(text)
            if within >= 0:
                sums[within] = [a + n for a, n in zip(sums[within], (len(text), len(text.split()), sum(map(text.count, ".!?。！？")), linked))]
    for k in range(len(parents) - 1, -1, -1):
        if parents[k] >= 0:
            sums[parents[k]] = [a + n for a, n in zip(sums[parents[k]], sums[k])]
    out: list[bool] = []
    for (size, words, ends, linked), parent in zip(sums, parents):
        own = size >= MOST * total or words >= PROSE_WORDS and ends >= PROSE_ENDS and linked <= PROSE_LINKS * size
        out.append(own and (parent < 0 or out[parent]))
    return out


def blocks_of(html: str) -> list[tuple[int, str]]:
    """(place, text) of each visible block that is not empty, in page order; white space is single spaces.

    Articles inside a main element stand for it, unless more of its plain text is outside them; a main element without one is the article.
    Containers that are named like boilerplate, outside articles, are boilerplate unless they hold most of the page's text, or prose.
    """
    out: list[tuple[int, str, int, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int, int | None]] = []
    parents: list[int] = []  # of the named containers, by number
    hidden = doubts = articles = mains = at = code = linked = 0
    named = -1  # the innermost one here
    in_link = False
    tag_at = _TAG.match

    def close_block() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                shown = (DOUBTFUL if doubts else IN_ARTICLE) if articles else MAIN if mains else OUTSIDE
                out.append((BOILERPLATE if hidden else shown, joined, named, min(linked, len(joined))))
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal hidden, doubts, articles, mains, code, named
        while len(stack) > k:
            tag, kind, outer = stack.pop()
            hidden -= kind >= HIDES
            doubts -= kind == DOUBT
            articles -= tag == "article"
            mains -= tag == "main"
            code -= tag == "pre"
            if outer is not None:
                named = outer

    while True:
        start = _OPEN.search(html, at)
        end = start.start() if start else len(html)
        if end > at:
            run = html[at:end]
            text.append(unescape(run) if "&" in run else run)
            linked += len(run) if in_link else 0
        if not start:
            break
        m = tag_at(html, end)
        if not m and tag_at == _TAG.match:
            tag_at = _LOOSE.match  # a quote that never ends; from here on quotes do not count
            m = tag_at(html, end)
        if not m:
            break  # the page ends inside a tag
        at = m.end()
        if m[1] is not None or m[2]:
            continue
        tag, closing = m[4].lower(), m[3] == "/"
        if tag in ("br", "td", "th"):
            text.append(" ")
        if tag in _VOID:
            if tag == "hr":
                close_block()
            continue
        block = tag in _BLOCK
        if tag == "a":
            in_link = not closing
        elif tag == "code":
            code = max(0, code + (-1 if closing else 1))
        if closing:
            if not block and not hidden and not doubts:
                continue
            if block:
                close_block()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if not block:
                        close_block()
                    pop_to(k)
                    break
            continue
        if tag in ("svg", "math") and m[0].endswith("/>"):
            text.append(" ")
            continue
        if tag in _RAW:
            ending = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = ending.end() if ending else len(html)
            text.append(" ")
            continue
        if block:
            close_block()
            closes = _CLOSES.get(tag, _CLOSES["p"])
            while stack and stack[-1][0] in closes:
                pop_to(len(stack) - 1)
            code = 0 if not any(t == "pre" for t, _, _ in stack[-8:]) and tag != "pre" else code  # code that is left open ends with its block
        kind = _kind(tag, m[5], articles > 0, articles + mains > 0, code > 0 or tag == "pre")
        if tag == "article" and any(t == "article" for t, _, _ in stack):
            kind = max(kind, HIDES)
        if tag in ("article", "main") and kind < HIDES and hidden and not mains and all(t in _LEAVES and k < COMMENTS or k < HIDES for t, k, _ in stack):
            stack[:] = [(t, SHOWN, outer) for t, _, outer in stack]
            hidden = doubts = 0
        if kind and not block:
            close_block()
        if block or kind or hidden or doubts:
            outer = None
            if kind == NAMED or tag == "article" and not mains and not articles:
                outer, named = named, len(parents) if kind == NAMED else -1  # an article stands for itself
                if kind == NAMED:
                    parents.append(outer)
            stack.append((tag, kind, outer))
            hidden += kind >= HIDES
            doubts += kind == DOUBT
            articles += tag == "article"
            mains += tag == "main"
            code += tag == "pre"
    close_block()
    lifted = _lifted(out, parents)
    shown = [(p if within < 0 or lifted[within] else BOILERPLATE, t) for p, t, within, _ in out]
    size = [sum(len(t) for p, t in shown if p == place) for place in (IN_ARTICLE, MAIN)]
    main = OUTSIDE if size[0] and size[0] >= size[1] else IN_ARTICLE
    return [(main if p == MAIN else p, t) for p, t in shown]


_SPACE = word_classes(lambda b: b <= 32)

PARSED = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("page_id", T.LongType()), ("url", T.StringType()), ("sign", T.LongType()), ("blocks", T.ArrayType(T.StringType())), ("starts", T.ArrayType(T.IntegerType())), ("lengths", T.ArrayType(T.IntegerType())),
            ("n_stream", T.IntegerType()), ("known", T.ArrayType(T.IntegerType())), ("runs", T.ArrayType(T.LongType())), ("places", T.ArrayType(T.IntegerType())),
        )
    ]
)


def _candidates(found: list[tuple[int, str]]) -> tuple[list[str], list[tuple[int, str]]]:
    """The page's stream, block by block, and the blocks that may be text: (place in the stream or -1, text)."""
    marked = any(p in (IN_ARTICLE, DOUBTFUL) for p, _ in found)
    stream, kept = [], []
    for place, text in found:
        if place == (DOUBTFUL if marked else OUTSIDE):
            kept.append((len(stream), text))
        elif place == IN_ARTICLE:
            kept.append((-1, text))
        if place != IN_ARTICLE:
            stream.append(text)
    return stream, kept


def suffix_array(tokens: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the `depth` tokens from each, and their ranks: equal ranks mean equal tokens.

    left: tokens from each place to the end of its page, beyond which nothing is read.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    have = 1
    while have < depth:
        step = min(have, depth - have)
        ahead = np.zeros(len(rank), np.int64)
        inside = np.flatnonzero(left > step)
        ahead[inside] = rank[inside + step]
        rank = np.unique(rank << 32 | ahead, return_inverse=True)[1].astype(np.int64) + 1
        have += step
    return np.argsort(rank, kind="stable"), rank


def shard_runs(tokens: np.ndarray, sizes: np.ndarray, signs: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each stream of a shard (known, runs, places): where windows begin that neighbours in the suffix array show on another page, and the hashes and places of the others.

    A window that is known to repeat leaves its hash once in the shard, at place -1, so that other shards learn of it. A stream
    shorter than `least` is one window; a shorter rest of a longer stream is none.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - place
    order, rank = suffix_array(tokens, left, least)
    able = order[(left[order] >= least) | (place[order] == 0)]
    first = np.flatnonzero(np.diff(rank[able], prepend=-1))
    size = np.diff(np.append(first, len(able)))
    lowest, highest = (f.reduceat(signs[owner[able]], first) if len(first) else first for f in (np.minimum, np.maximum))
    repeats = np.repeat(lowest != highest, size)
    # A hash of each window, from the tokens of its first place in suffix order.
    run = np.full(len(first), 0x51ED270B, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(least):
            own = np.where(left[able[first]] > k, tokens[np.minimum(able[first] + k, len(tokens) - 1)], np.uint64(0))
            run = (run ^ own) * np.uint64(0x9E3779B97F4A7C15)
            run ^= run >> np.uint64(29)
    run = np.repeat(run, size).view(np.int64)
    told = np.zeros(len(able), bool)
    told[first] = True
    tells = ~repeats | told
    where = np.where(repeats, -1, place[able])

    def by_owner(rows: np.ndarray, *columns: np.ndarray) -> list[list[np.ndarray]]:
        by = np.argsort(owner[able][rows], kind="stable")
        cuts = np.searchsorted(owner[able][rows][by], np.arange(1, len(sizes)))
        return [np.split(c[rows][by], cuts) for c in columns]

    (known,) = by_owner(np.flatnonzero(repeats), place[able])
    runs, places = by_owner(np.flatnonzero(tells), run, where)
    return list(zip(known, runs, places))


def parsed(pages: DataFrame, key: str, url: str, html: str, least: int) -> DataFrame:
    """Each page with the blocks that may be text, their places in its stream (start -1: the article's own), and the windows of the stream.

    sign: a hash of all that the page shows, the same for copies. known, runs, places: as of shard_runs, over the pages of a slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(PARSED)
        for batch in slices(batches, 2):
            rows, texts, blocks, hosts = [], [], [], []
            for k, u, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                found = blocks_of((raw or b"").decode("utf-8", "replace"))
                stream, kept = _candidates(found)
                sign = xxhash.xxh64_intdigest("\n".join(f"{p}{t}" for p, t in found).encode()) - (1 << 63)
                rows.append([k, u, sign, [t for _, t in kept]])
                blocks.append((len(texts), len(stream), [p for p, _ in kept]))
                hosts.append(xxhash.xxh64_intdigest(host_of(u)) | 1)
                texts += [t.encode() for t in stream]
            # The streams of all pages, block by block; tokens of different hosts are different.
            words = Words(texts, _SPACE)
            ends = np.concatenate([[0], np.cumsum(words.count)]).astype(np.int64)
            sizes = np.array([ends[a + n] - ends[a] for a, n, _ in blocks], np.int64)
            with np.errstate(over="ignore"):
                tokens = words.hash * np.repeat(np.array(hosts, np.uint64), sizes)
            shard = shard_runs(tokens, sizes, np.array([r[2] for r in rows], np.int64), least)
            for row, (a, _, places), n, (known, runs, at) in zip(rows, blocks, sizes.tolist(), shard):
                row.append([int(ends[a + p] - ends[a]) if p >= 0 else -1 for p in places])
                row.append([int(words.count[a + p]) if p >= 0 else 0 for p in places])
                row += [n, known, runs, at]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    bounded_batches(pages.sparkSession)
    plain = pick(pages, key=key, url=url, html=html).selectExpr("cast(key as long) key", "url", "html")
    return plain.mapInArrow(run, PARSED)


def repeated_over_shards(read: DataFrame) -> DataFrame:
    """(row, place): where windows begin, of those that no shard knew to repeat, that another page has too. read: row, sign, runs, places.

    A window's pages meet by the least and largest sign, which partial aggregation finds; a shard has told a window that repeats in it once only.
    """
    windows = read.select("row", "sign", F.explode(F.arrays_zip("runs", "places")).alias("w")).select("row", "sign", F.col("w.runs").alias("run"), F.col("w.places").alias("place"))
    shared = windows.groupBy("run").agg(F.min("sign").alias("lo"), F.max("sign").alias("hi"), F.min("place").alias("at")).filter("lo <> hi or at < 0").select("run")
    return windows.filter("place >= 0").join(shared, "run", "left_semi").select("row", "place")


def _texts(folder: str, least: int, covered: float):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_repeated", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = PartRows(folder)
        for batch in batches:
            more: dict[int, list[int]] = {}
            for at, entries in shared.entries(batch.column(0).to_numpy()):
                for k, place in zip(at.tolist(), entries.column("place").to_pylist()):
                    more.setdefault(k, []).append(place)
            rows = []
            for i, (k, u, blocks, starts, lengths, n, known) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                repeated = np.zeros(n + 1, np.int64)
                for p in [*known, *more.get(i, ())]:
                    repeated[p] += 1
                    repeated[min(p + least, n)] -= 1
                repeated = np.cumsum(repeated)[:n] > 0
                kept = [b for b, a, m in zip(blocks, starts, lengths) if a < 0 or repeated[a : a + m].sum() < covered * max(1, m)]
                text = "\n".join(kept)
                rows.append((k, u, text, len(text), int(repeated.sum())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_RUN, covered: float = COVERED) -> DataFrame:
    """(page_id, url, text, n_chars, n_repeated) for each row: the main text, and how many tokens of what is not plainly the article's repeat on other pages.

    Null or empty html gives the empty text. Urls without a host, and null ones, count as one host. Copies of a page are one
    page: what only copies share is not boilerplate. Repeated rows give repeated rows; an empty table gives none. A doubtful block of which
    exactly the share `covered` repeats goes. Page texts are written once and not shuffled; hashes of windows are.
    """
    read, _ = written(parsed(pages, key, url, html, least).withColumn("row", F.monotonically_increasing_id()), "pages")
    folder = by_part(repeated_over_shards(read), "row", "repeated")
    columns = ["row", "page_id", "url", "blocks", "starts", "lengths", "n_stream", "known"]
    return read.select(*columns).mapInArrow(_texts(folder, least, covered), "page_id long, url string, text string, n_chars long, n_repeated long")
