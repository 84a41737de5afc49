"""Files in the shared folder, written and read by executors; the URI's scheme decides the file system."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it. Hadoop's names of S3 count as its own; a scheme without a file system here is ValueError."""
    try:
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))
    except pa.ArrowInvalid as e:
        raise ValueError(f"no file system for {uri}: {e}") from e


def make_folder(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)


def publish(system: fs.FileSystem, temporary: str, final: str) -> None:
    """Rename a finished file into place. A repeated task writes the same bytes again, so either copy may stay."""
    try:
        system.move(temporary, final)
    except OSError:
        if system.get_file_info(final).type != fs.FileType.File:
            raise
        system.delete_file(temporary)


def files(uri: str, suffix: str) -> list[tuple[str, int]]:
    system, path = opened(uri)
    found = system.get_file_info(fs.FileSelector(path, recursive=False))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith("_"))
