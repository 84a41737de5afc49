"""From extracted lines to normalized ones: margins that repeat go, hyphenated breaks are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import strip
from lexloom.sources.tables import pieces

# Fixed value: what begins a structural line.
BOUNDARY = r"^(PERATURAN\s+BANK\s+INDONESIA|PERATURAN\s+OTORITAS\s+JASA\s+KEUANGAN|BAB\s+[IVXLCDM]+|Bagian\s+[A-Za-z0-9\s]+|Paragraf\s+\d+|Pasal\s+\d+[A-Z]?|\(\d+\)|[a-z]\.|\b[a-z]\)|\d+\.|\b\d+\)|Menimbang\s*:|Mengingat\s*:|MEMUTUSKAN\s*:|MENETAPKAN\s*:|KETENTUAN\s+PENUTUP)"
TOP, BOTTOM, LONGEST = 80, 700, 120
#: What orders the lines of a document.
ORDER = ("page_num", "block_num", "pos")


def is_boundary(text: Column | str) -> Column:
    return F.regexp_like(strip(text), F.lit(f"(?i){BOUNDARY}"))


def repeated_margins(lines: DataFrame) -> DataFrame:
    """(document_id, text, n): short lines at the top or bottom that occur at least twice after page 1, on whatever pages."""
    bare = lines.withColumn("text", strip("text")).filter((F.col("page_num") > 1) & (F.length("text") < LONGEST) & ((F.col("y0") < TOP) | (F.col("y1") > BOTTOM)))
    return bare.groupBy("document_id", "text").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


def _numbered(lines: DataFrame) -> DataFrame:
    """As without_margins, with what the numbers come from."""
    bare = lines.withColumn("text", strip("text")).filter("text <> ''")
    repeated = repeated_margins(lines).select("document_id", "text", F.lit(2).alias("_from"))
    kept = bare.alias("l").join(repeated.alias("r"), (F.col("l.document_id") == F.col("r.document_id")) & (F.col("l.text") == F.col("r.text")) & (F.col("l.page_num") >= F.col("r._from")), "left_anti")
    # All that follows sorts whole documents, so a partition's size is set by the input's and not by the planner, which grows partitions up to a size of
    # compressed rows and then holds one in each sort of a task.
    parts = pieces(lines)
    kept = kept.select("l.*") if parts is None else kept.select("l.*").repartition(parts, "document_id")
    number = F.row_number().over(Window.partitionBy("document_id").orderBy(*ORDER))
    return kept.select("document_id", *ORDER, number.alias("line_num"), "text", is_boundary("text").alias("is_boundary"))


def without_margins(lines: DataFrame) -> DataFrame:
    """Lines (document_id, page_num, block_num, pos, text, y0, y1) that are not blank and no repeated margin, numbered from 1 in each document."""
    return _numbered(lines).drop(*ORDER[1:])


def repair_hyphens(lines: DataFrame, order: tuple[str, ...] = ("line_num",)) -> DataFrame:
    """Lines that end in a hyphen take the next one in, unless either is structural; what was taken in is gone.

    In a run of such lines each second one is taken in whole, its own hyphen and all. Numbers are not given out anew.
    order: columns that order a document's lines.
    """
    w = Window.partitionBy("document_id").orderBy(*order)
    able = F.col("text").endswith("-") & (F.length("text") > 1) & ~F.col("is_boundary") & ~F.coalesce(F.lead("is_boundary").over(w), F.lit(True))
    marked = lines.withColumn("_next", F.lead("text").over(w)).withColumn("_able", able)
    # A line's place in its run is how far the last line that joins nothing lies behind; all windows share one sort.
    behind = F.last(F.when(~F.col("_able"), F.col("_at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    odd = (F.col("_at") - F.coalesce(behind, F.lit(0))) % 2 == 1
    paired = marked.withColumn("_at", F.row_number().over(w)).withColumn("_joins", F.col("_able") & odd)
    taken = F.coalesce(F.lag("_joins").over(w), F.lit(False))
    joined = F.when(F.col("_joins"), F.concat(F.expr("substring(text, 1, length(text) - 1)"), F.col("_next"))).otherwise(F.col("text"))
    return paired.withColumn("_taken", taken).filter("not _taken").select("document_id", "page_num", "line_num", joined.alias("text"), "is_boundary")


def normalize(lines: DataFrame) -> DataFrame:
    return repair_hyphens(_numbered(lines), ORDER)
