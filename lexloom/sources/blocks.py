"""Text blocks of files, by any reader of their format: the input of the document pipeline."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gives the pages of a file; each is its blocks (x0, y0, x1, y1, text, number, kind), of which kind 0 is text.
Reader = Callable[[bytes], Iterable[Iterable[tuple]]]

_SCHEMA = "document_id long, page_num long, block_num long, x0 double, y0 double, x1 double, y1 double, text string"


def pdf() -> Reader:
    """A reader of PDF, where the library for it is installed; ImportError elsewhere."""
    import fitz

    def read(content: bytes) -> Iterator[list[tuple]]:
        with fitz.open(stream=content, filetype="pdf") as file:
            for page in file:
                yield page.get_text("blocks")

    return read


def blocks(files: DataFrame, reader: Callable[[], Reader] = pdf, key: str = "document_id", content: str = "content") -> DataFrame:
    """(document_id, page_num, block_num, x0, y0, x1, y1, text): the blocks of text that are not blank, pages from 1, numbers as in their page.

    Null files have none. One that the reader can't read is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            for document, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for number, page in enumerate(read(body), 1):
                    rows = [(document, number, n, *map(float, b[:4]), str(b[4]).strip()) for n, b in enumerate(page) if (len(b) < 7 or b[6] == 0) and str(b[4]).strip()]
                    if rows:
                        kinds = [pa.int64()] * 3 + [pa.float64()] * 4 + [pa.string()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["document_id", "page_num", "block_num", "x0", "y0", "x1", "y1", "text"])

    plain = files.select(F.col(key).cast("long").alias("document_id"), F.col(content).cast("binary").alias("content")).filter("content is not null")
    return plain.mapInArrow(run, _SCHEMA)


def lines(found: DataFrame) -> DataFrame:
    """(document_id, page_num, block_num, pos, text, y0, y1): the lines of the blocks, in order; what normalize takes."""
    each = found.select("document_id", "page_num", "block_num", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("pos", "text"), "y0", "y1")
    return each.filter(F.trim("text") != "").withColumn("pos", F.col("pos").cast("long"))
