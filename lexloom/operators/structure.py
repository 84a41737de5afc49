"""The legal node tree of normalized lines, as windows over each document.

A line's kind comes from its marker. What is open at a line (chapter, part, section, article, paragraph, letter) is the last
line of that kind in a scope that narrower markers cannot leave, so each reset of a sequential reader is a
narrower window here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import strip

# Markers in the order they are tried, with the groups that hold number and text.
MARKERS = (
    ("chapter", r"^BAB\s+([IVXLCDM]+)", 0),
    ("part", r"^Bagian\s+([A-Za-z0-9\s]+)", 0),
    ("section", r"^Paragraf\s+(\d+)", 0),
    ("article", r"^Pasal\s+(\d+[A-Z]?)", 0),
    ("paragraph", r"^\((\d+)\)\s*(.*)", 2),
    ("letter", r"^([a-z])[\.\)]\s*(.*)", 2),
    ("numbered_item", r"^(\d+)[\.\)]\s*(.*)", 2),
    ("consideration", r"^Menimbang\s*:\s*(.*)", 1),
    ("legal_basis", r"^Mengingat\s*:\s*(.*)", 1),
    ("decision", r"^(MEMUTUSKAN|MENETAPKAN)\s*:\s*(.*)", 2),
    ("closing", r"^(PASAL\s+PENUTUP|Agar\s+setiap\s+orang\s+mengetahuinya|Disahkan\s+di|Ditetapkan\s+di)", 0),
)
TITLED = ("chapter", "part", "section")
#: Kinds that end a title.
ENDS_TITLE = ("chapter", "part", "section", "article", "paragraph", "consideration", "legal_basis", "decision")
LEAVES = ("preamble", "consideration", "legal_basis", "decision", "paragraph", "letter", "numbered_item", "closing")
LEAST_COVERAGE = 0.90


def kind_of(text: Column) -> Column:
    kind = F.lit("default")
    for name, pattern, _ in reversed(MARKERS):
        kind = F.when(F.regexp_like(text, F.lit(f"(?i){pattern}")), name).otherwise(kind)
    return kind


def _group(text: Column, name: str, group: int) -> Column:
    pattern = next(p for n, p, _ in MARKERS if n == name)
    return F.regexp_extract(text, f"(?i){pattern}", group)


def states(lines: DataFrame) -> DataFrame:
    """Each line with its effective kind, what is open at it, and the line whose node it makes, extends or titles."""
    text = F.col("text")
    doc = Window.partitionBy("document_id").orderBy("line_num")
    upto = doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda test, value, w=upto: F.last(F.when(test, value), ignorenulls=True).over(w)
    kind, line = F.col("kind"), F.col("line_num")
    rows = lines.withColumn("text", strip("text")).withColumn("kind", kind_of(F.col("text")))
    rows = rows.withColumn("_marker", last(kind.isin(*ENDS_TITLE), kind, before)).withColumn("_first", F.row_number().over(doc) == 1)
    rows = rows.withColumn("swallowed", ~kind.isin(*ENDS_TITLE) & F.coalesce(F.col("_marker").isin(*TITLED), F.lit(False))).withColumn("title_line", last(kind.isin(*TITLED), line))
    opened = F.struct(line.alias("line"), kind.alias("kind"))
    rows = rows.withColumn("chapter", last(kind == "chapter", line))
    for name, scope in (("part", ("chapter", "part")), ("section", TITLED), ("article", (*TITLED, "article"))):
        rows = rows.withColumn("_top", last(kind.isin(*scope), opened)).withColumn(name, F.when(F.col("_top.kind") == name, F.col("_top.line")))
    below = kind.isin("paragraph", "letter", "numbered_item") & F.col("article").isNull()
    rows = rows.withColumn("kind", F.when(below, "default").otherwise(kind))
    rows = rows.withColumn("kind", F.when(F.col("_first") & (kind == "default"), "preamble").otherwise(kind))
    # From here on inside an article, which is what lies at or after its line: so these windows share the document's sort. Lines that are swallowed have no part in it.
    inside = lambda at, value: F.when(at >= F.col("article"), value)
    live = ~F.col("swallowed") & F.col("article").isNotNull()
    turn = live & kind.isin("paragraph", "letter", "default")
    rows = rows.withColumn("_turn", last(turn, line, before)).withColumn("implicit", turn & (kind == "default") & inside(F.col("_turn"), F.col("_turn")).isNull())
    rows = rows.withColumn("_open", last(live & ((kind == "paragraph") | F.col("implicit")), line)).withColumn("paragraph", inside(F.col("_open"), F.col("_open")))
    rows = rows.withColumn("_low", last(live & kind.isin("paragraph", "letter"), opened)).withColumn("letter", inside(F.col("_low.line"), F.when(F.col("_low.kind") == "letter", F.col("_low.line"))))
    root = ~F.col("swallowed") & (
        kind.isin("chapter", "consideration", "legal_basis", "decision", "closing", "preamble")
        | (kind == "part") & F.col("chapter").isNull()
        | (kind == "section") & F.col("part").isNull() & F.col("chapter").isNull()
        | (kind == "article") & F.col("section").isNull() & F.col("part").isNull() & F.col("chapter").isNull()
    )
    rows = rows.withColumn("is_root", root).withColumn("_root", last(F.col("is_root"), line))
    makes = ~F.col("swallowed") & ((kind != "default") | F.col("implicit"))
    target = F.when(F.col("swallowed"), F.col("title_line")).when(makes, line).otherwise(F.coalesce("letter", "paragraph", "_root"))
    return rows.withColumn("makes", makes).withColumn("target", target).drop("_marker", "_first", "_top", "_turn", "_open", "_low", "_root")


def nodes(lines: DataFrame) -> DataFrame:
    """The nodes of each document: sequence, parent and ancestors by sequence, type, number, title, text, pages, path.

    Lines: (document_id, line_num, page_num, text), normalized. Pages of a node with children span those of its childless descendants.
    Sorted by `ancestors` the nodes are in depth-first order. All steps keep the partitioning by document: one shuffle, no join.
    """
    text, kind, c = F.col("text"), F.col("kind"), F.col
    number = F.when(kind == "chapter", F.upper(_group(text, "chapter", 1))).when(kind == "part", strip(_group(text, "part", 1))).when(kind == "section", _group(text, "section", 1)).when(kind == "article", F.upper(_group(text, "article", 1)))
    number = number.when(kind == "paragraph", _group(text, "paragraph", 1)).when(kind == "letter", F.lower(_group(text, "letter", 1))).when(kind == "numbered_item", _group(text, "numbered_item", 1))
    own = F.when(kind.isin("preamble", "closing") | c("implicit"), text)
    for name, _, group in MARKERS:
        if group:
            own = own.when(kind == name, strip(_group(text, name, group)))
    head = F.when(kind.isin(*TITLED, "article"), "").otherwise(F.coalesce(own, F.lit("")))
    # How a node is called in a path, and the titles that do not come from the text.
    piece = F.when(kind == "chapter", F.concat(F.lit("BAB "), "_number")).when(kind == "part", F.concat(F.lit("Bagian "), "_number")).when(kind == "section", F.concat(F.lit("Paragraf "), "_number")).when(kind == "article", F.concat(F.lit("Pasal "), "_number"))
    piece = piece.when(c("implicit"), "Ayat (1)").when(kind == "paragraph", F.concat(F.lit("Ayat ("), "_number", F.lit(")"))).when(kind == "letter", F.concat(F.lit("Huruf "), "_number")).when(kind == "numbered_item", F.concat("_number", F.lit(".")))
    piece = piece.when(kind == "consideration", "Menimbang").when(kind == "legal_basis", "Mengingat").when(kind == "decision", "MEMUTUSKAN").when(kind == "closing", "KETENTUAN PENUTUP").otherwise("PREAMBLE")
    fixed = F.when(kind.isin(*TITLED), c("_piece")).when(kind == "consideration", "Menimbang").when(kind == "legal_basis", "Mengingat").when(kind == "decision", "MEMUTUSKAN:").when(kind == "closing", "KETENTUAN PENUTUP").when(kind == "preamble", text)
    upto = Window.partitionBy("document_id").orderBy("line_num").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = states(lines).withColumn("_number", number).withColumn("_head", head)
    rows = rows.withColumn("_piece", piece).withColumn("sequence", F.sum(c("makes").cast("int")).over(upto).cast("int"))
    me = F.struct(c("sequence").alias("s"), c("_piece").alias("p"))
    levels = ("chapter", "part", "section", "article", "paragraph", "letter")
    rows = rows.select("*", *[F.last(F.when(c("makes") & ((kind == n) | (c("implicit") if n == "paragraph" else F.lit(False))), me), ignorenulls=True).over(upto).alias(f"_{n}") for n in levels])
    opened = [F.when(c(n).isNotNull(), c(f"_{n}")) for n in levels]
    depth = {n: k for k, n in enumerate(levels)} | {"numbered_item": len(levels)}
    above = F.when(c("implicit"), F.array(*opened[: depth["paragraph"]]))
    for name, k in depth.items():
        if k:
            above = above.when(kind == name, F.array(*opened[:k]))
    none = F.array().cast("array<struct<s:int,p:string>>")
    rows = rows.withColumn("_above", F.when(c("makes"), F.filter(F.coalesce(above, none), lambda x: x.isNotNull())))
    node_type = F.when(c("implicit"), "paragraph").otherwise(kind)
    node = F.struct("sequence", node_type.alias("node_type"), "_number", "_head", "_piece", fixed.alias("title"), "_above", c("page_num").alias("start"))
    rest = F.array_sort(F.collect_list(F.when(~c("makes"), F.struct("line_num", "swallowed", "text", "page_num"))))
    made = rows.groupBy("document_id", "target").agg(F.first(F.when(c("makes"), node), ignorenulls=True).alias("n"), rest.alias("rest"))
    of = lambda swallowed, field: F.transform(F.filter("rest", lambda r: r["swallowed"] == F.lit(swallowed)), lambda r: r[field])
    titles = of(True, "text")
    made = made.select(
        "document_id", c("n.sequence").alias("sequence"), c("n.node_type").alias("node_type"), c("n._number").alias("node_number"),
        F.when(F.size(titles) > 0, F.array_join(titles, " ")).otherwise(c("n.title")).alias("title"),
        F.array_join(F.filter(F.concat(F.array("n._head"), of(False, "text")), lambda x: x != ""), "\n").alias("text"),
        c("n.start").alias("_start"), F.coalesce(F.try_element_at(of(False, "page_num"), F.lit(-1)), c("n.start")).alias("_end"),
        F.concat(F.transform("n._above", lambda x: x["s"]), F.array("n.sequence")).alias("ancestors"),
        F.concat_ws("/", F.transform("n._above", lambda x: x["p"]), "n._piece").alias("path"),
    ).withColumn("parent_sequence", F.get("ancestors", F.size("ancestors") - 2))
    # Depth-first, a node with children is followed by its first child.
    follows = F.lead("parent_sequence").over(Window.partitionBy("document_id").orderBy("ancestors"))
    leaf = made.withColumn("_leaf", F.coalesce(follows != c("sequence"), F.lit(True)))
    each = leaf.select("document_id", F.explode("ancestors").alias("_at"), F.when(c("_leaf"), c("_start")).alias("_start"), F.when(c("_leaf"), c("_end")).alias("_end"), "sequence", F.struct("parent_sequence", "ancestors", "node_type", "node_number", "title", "text", "path").alias("n"))
    # A node's text comes along once, not with each node above it.
    each = each.select("document_id", "_at", "_start", "_end", F.when(c("_at") == c("sequence"), c("n")).alias("n"))
    found = each.groupBy("document_id", "_at").agg(F.min("_start").alias("page_start"), F.max("_end").alias("page_end"), F.first("n", ignorenulls=True).alias("n"))
    return found.select("document_id", c("_at").alias("sequence"), "n.parent_sequence", "n.ancestors", "n.node_type", "n.node_number", "n.title", "n.text", "page_start", "page_end", "n.path")


def coverage(lines: DataFrame, tree: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """Per document: characters extracted and kept in leaves, their ratio to 4 places and at most 1, and whether that is enough."""
    seen = lines.groupBy("document_id").agg(F.sum(F.length("text")).alias("extracted_chars"))
    kept = tree.filter(F.col("node_type").isin(*LEAVES)).groupBy("document_id").agg(F.sum(F.length("text")).alias("structured_chars"))
    rows = seen.join(kept, "document_id", "left").withColumn("structured_chars", F.coalesce("structured_chars", F.lit(0)))
    ratio = F.when(F.col("extracted_chars") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.round(F.col("structured_chars") / F.col("extracted_chars"), 4)))
    return rows.withColumn("coverage_ratio", ratio).withColumn("unparsed_chars", F.greatest(F.lit(0), F.col("extracted_chars") - F.col("structured_chars"))).withColumn("is_valid", F.col("coverage_ratio") >= least)
