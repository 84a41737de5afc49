"""Raw files and metadata artifacts: where they lie, writing them from the tasks that hold their rows, and removing what no registry names."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the columns of a regulation's metadata, in order.
METADATA = ("source", "regulation_type", "regulation_number", "title", "sector", "subsector", "status", "published_date", "effective_date", "detail_url", "summary", "abstract")


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it; Hadoop's names of S3 are its own. A scheme without a file system here is ValueError."""
    try:
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", address))
    except pa.ArrowInvalid as e:
        raise ValueError(f"no file system for {address}: {e}") from e


def metadata_path(root: str, source: str, kind: str, regulation: str) -> Column:
    return F.concat(F.concat_ws("/", F.lit(root), F.upper(source), F.upper(kind), F.col(regulation).cast("string")), F.lit(".json"))


def metadata_json(regulation: str, columns: Sequence[str] = METADATA, extra: Column | None = None) -> Column:
    """The artifact of a regulation: its id, its metadata with nulls, and what else is known (a map of strings)."""
    more = extra if extra is not None else F.from_json(F.lit("{}"), "map<string,string>")
    return F.to_json(F.struct(F.col(regulation).cast("string").alias("regulation_id"), F.struct(*columns).alias("metadata"), more.alias("extra_info")), {"ignoreNullFields": "false"})


def write_files(rows: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, bytes) of each file written: `content` (text or bytes, null: empty) at the address `path`, folders made as needed.

    A file appears under its name when it is complete, and one that is there is replaced, so a repeated task does no harm. Rows without a
    path are left out. The table is to be written or counted once; each run of its plan writes the files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for address, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, place = opened(address)
                folder, _, name = place.rpartition("/")
                system.create_dir(folder, recursive=True)
                hidden = f"{folder}/_{uuid.uuid4().hex}.{name}"
                with system.open_output_stream(hidden, compression=None) as out:
                    out.write(body or b"")
                if system.get_file_info(place).type == fs.FileType.File:
                    system.delete_file(place)
                system.move(hidden, place)
                sizes.append(len(body or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return rows.filter(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "path string, bytes long")


def remove_unregistered(files: DataFrame, registered: DataFrame, path: str = "path") -> DataFrame:
    """(path, removed): files that no registered row names, deleted if they are there, as after a registration that failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for address in batch.column(0).to_pylist():
                system, place = opened(address)
                there = system.get_file_info(place).type == fs.FileType.File
                if there:
                    system.delete_file(place)
                gone.append(there)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone)], names=["path", "removed"])

    left = files.select(F.col(path).alias("path")).filter("path is not null").distinct().join(registered.select(F.col(path).alias("path")), "path", "left_anti")
    return left.mapInArrow(run, "path string, removed boolean")
