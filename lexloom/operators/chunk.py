"""Lossless, hashed chunks of a node tree, and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import contextual, strip, word_count
from lexloom.operators.structure import LEAVES

LARGEST = 1500
# Fixed value: where a text may be cut, by preference.
CUTS = (r"\.\s+", r";\s+", r"\.\n", r"\n\n", r"\n", r",\s+", r"\s+")
#: White space by Unicode, separators of records included.
_SPACE = r"[\s\x1c-\x1f]"


def _part(largest: int) -> str:
    """A pattern whose next match is the next part: what is left if it is short enough, else up to the end of the last match of the first cut that matches within `largest` characters, else all of those.

    A cut's white space must end within them, which the look-back tells from the end of the part before. The look-back reaches as far as its
    longest branch in UTF-16 units, of which a character has up to two; its second branch never matches and makes it reach that far.
    """
    within = rf"(?<=\G.{{1,{largest}}}|\A\z.{{{2 * largest}}})"
    # Blank lines are counted off in twos from the first line break.
    blank, ends = r"\n\n", r"(?:\G|(?<!\n))(?:\n\n)+"
    cuts = [rf".{{0,{largest}}}{ends if p == blank else p.replace(chr(92) + 's', _SPACE)}{within}" for p in CUTS]
    return rf"(?sU)\G(?:{'|'.join([rf'.{{1,{largest}}}\z', *cuts, rf'.{{{largest}}}'])})"


def split(text: Column | str, largest: int = LARGEST) -> Column:
    """Parts of a text, each of at most `largest` characters, that put together are the text. Empty and null texts have none."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.when(F.length(c) <= largest, F.array(c)).otherwise(F.regexp_extract_all(c, F.lit(_part(largest)), F.lit(0)))
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)


def with_context(tree: DataFrame) -> DataFrame:
    """Nodes with the titles of the chapter, part and section and the codes of the article, paragraph, letter and item they are in or are.

    Nodes of one type never hold each other, so depth-first the last of a type is the one a node is in, if it is in any.
    """
    before = Window.partitionBy("document_id").orderBy("ancestors").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = {"chapter": "chapter_title", "part": "part_title", "section": "section_title", "article": "article_number", "paragraph": "paragraph_number", "letter": "letter_code", "numbered_item": "numbered_item"}
    value = F.when(F.col("node_type").isin("chapter", "part", "section"), F.col("title")).otherwise(F.col("node_number"))
    last = tree.select("*", *[F.last(F.when(F.col("node_type") == k, F.struct("sequence", value.alias("value"))), ignorenulls=True).over(before).alias(f"_{k}") for k in names])
    inside = [F.when(F.array_contains("ancestors", F.col(f"_{k}.sequence")), F.col(f"_{k}.value")).alias(n) for k, n in names.items()]
    return last.select(*tree.columns, *inside)


def chunks(tree: DataFrame, version: Column | None = None, largest: int = LARGEST, source: str = "source", kind: str = "regulation_type", number: str = "regulation_number", title: str = "regulation_title") -> DataFrame:
    """A row for each part of each leaf's text, numbered depth-first in its document, with path, contextual text and hash.

    Nodes carry the regulation's columns. The hash is of version, node, path, part and text, so the same content has the same one.
    """
    return parts_of_leaves(tree, version, largest, source, kind, number, title).filter(F.col("chunk_text").isNotNull()).drop("leaf_chars")


def parts_of_leaves(tree: DataFrame, version: Column | None = None, largest: int = LARGEST, source: str = "source", kind: str = "regulation_type", number: str = "regulation_number", title: str = "regulation_title") -> DataFrame:
    """The chunks, and a row without a chunk for each leaf without text; leaf_chars: the leaf's characters, in its first row. One pass for chunks and what they are checked against."""
    leaves = with_context(tree).filter(F.col("node_type").isin(*LEAVES)).withColumn("_parts", split(strip("text"), largest))
    # Parts of the leaves before are counted while leaves are still sorted for their context, and not sorted again with all parts.
    ahead = Window.partitionBy("document_id").orderBy("ancestors").rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("_ahead", F.coalesce(F.sum(F.size("_parts")).over(ahead), F.lit(0)))
    each = leaves.select("*", F.posexplode_outer("_parts").alias("_part", "chunk_text")).withColumn("part_index", F.col("_part") + 1).withColumn("total_parts", F.size("_parts"))
    path = F.when(F.col("total_parts") > 1, F.concat("path", F.lit(" [Part "), F.col("part_index").cast("string"), F.lit("/"), F.col("total_parts").cast("string"), F.lit("]"))).otherwise(F.col("path"))
    order = (F.col("_ahead") + F.coalesce("part_index", F.lit(0))).cast("int")
    made = each.withColumn("structural_path", path).withColumn("chunk_sequence", order).withColumn("character_count", F.length("chunk_text")).withColumn("word_count", word_count("chunk_text"))
    digest = F.sha2(F.concat_ws(":", (version if version is not None else F.col("document_id")).cast("string"), F.col("sequence").cast("string"), "structural_path", F.col("part_index").cast("string"), "chunk_text"), 256)
    made = made.withColumn("chunk_hash", F.when(F.col("chunk_text").isNotNull(), digest)).withColumn("contextual_text", contextual(source, kind, number, title, "structural_path", "page_start", "page_end", "chunk_text"))
    return made.withColumn("leaf_chars", F.when(F.coalesce("_part", F.lit(0)) == 0, F.coalesce(F.length(strip("text")), F.lit(0)))).drop("_parts", "_part", "_ahead")


def validate(tree: DataFrame, made: DataFrame) -> DataFrame:
    """Per document: sizes, coverage, and the five rules (all characters, no blank chunk, no equal hash, no missing node, sequence 1..N).

    For chunks that come from elsewhere; those of parts_of_leaves are checked in the same pass by validate_parts.
    """
    leaf = tree.filter(F.col("node_type").isin(*LEAVES)).groupBy("document_id").agg(F.sum(F.length(strip("text"))).alias("leaf_chars"))
    return _judged(leaf.join(made.groupBy("document_id").agg(*_measures()), "document_id", "left"))


def validate_parts(parts: DataFrame) -> DataFrame:
    """As validate, of the rows of parts_of_leaves."""
    per = parts.groupBy("document_id").agg(F.sum("leaf_chars").alias("leaf_chars"), *_measures())
    # A document without any chunk has no measures.
    some = F.col("total_chunks") > 0
    return _judged(per.select("document_id", "leaf_chars", *[F.when(some, F.col(c)).alias(c) for c in per.columns[2:]]))


def _measures() -> list[Column]:
    """Of the rows that are chunks. Sets and not distinct counts, which would copy all rows for each."""
    there = F.col("chunk_text").isNotNull()
    n = F.count("chunk_text")
    return [
        n.alias("total_chunks"), F.sum("character_count").alias("chunked_chars"), F.min("character_count").alias("min_size"), F.max("character_count").alias("max_size"), F.round(F.avg("character_count"), 2).alias("avg_size"),
        F.sum((strip("chunk_text") == "").cast("long")).alias("blank_chunks"), (F.count("chunk_hash") - F.size(F.collect_set("chunk_hash"))).alias("duplicate_hashes"), F.sum((there & F.col("sequence").isNull()).cast("long")).alias("missing_nodes"),
        (F.min(F.when(there, F.col("chunk_sequence"))) == 1).alias("_from1"), (F.max(F.when(there, F.col("chunk_sequence"))) == n).alias("_toN"), F.size(F.collect_set(F.when(there, F.col("chunk_sequence")))).alias("_numbers"),
    ]


def _judged(rows: DataFrame) -> DataFrame:
    chars = F.coalesce("chunked_chars", F.lit(0))
    ratio = F.when((F.col("leaf_chars") == 0) & (chars == 0), 1.0).when(F.col("leaf_chars") == 0, 0.0).otherwise(F.round(chars / F.col("leaf_chars"), 4))
    ordered = F.coalesce(F.col("_from1") & F.col("_toN") & (F.col("_numbers") == F.col("total_chunks")), F.lit(False))
    valid = (chars == F.col("leaf_chars")) & (F.coalesce("blank_chunks", F.lit(0)) == 0) & (F.coalesce("duplicate_hashes", F.lit(0)) == 0) & (F.coalesce("missing_nodes", F.lit(0)) == 0) & ordered
    return rows.withColumn("coverage", ratio).withColumn("is_valid", valid).drop("_from1", "_toN", "_numbers")
