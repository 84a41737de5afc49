"""Small tables about the rows of a written table, laid by the file of the row, so that no large row is shuffled to meet them.

Row numbers are those of monotonically_increasing_id when the large table was written: the upper bits number its file. A small table
is written with a folder for each such file; a task that reads large rows opens the folders of the files that it meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import new_folder
from lexloom.llm.storage import opened

_FILE_BITS = 33


def by_part(rows: DataFrame, number: str, name: str) -> str:
    """Write rows by the file of their number; the folder."""
    folder = new_folder(rows.sparkSession, name)
    placed = rows.withColumn("part", F.shiftright(number, _FILE_BITS))
    placed.repartition("part").sortWithinPartitions("part", number).write.partitionBy("part").parquet(folder)
    return folder


class PartRows:
    """The rows of a folder that by_part wrote, one file's at a time."""

    def __init__(self, folder: str, number: str = "row"):
        self.folder, self.number, self.part, self.table = folder, number, None, None
        self.system, self.base = opened(folder)

    def of(self, part: int) -> pa.Table | None:
        if part != self.part:
            where = f"{self.base}/part={part}"
            there = self.system.get_file_info(where).type == fs.FileType.Directory
            names = [f.path for f in self.system.get_file_info(fs.FileSelector(where)) if f.path.endswith(".parquet")] if there else []
            tables = [pyarrow.parquet.ParquetFile(self.system.open_input_file(n)).read() for n in sorted(names)]
            self.part, self.table = part, pa.concat_tables(tables).sort_by(self.number) if tables else None
        return self.table

    def _parts(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Table, np.ndarray]]:
        files = numbers >> _FILE_BITS
        for part in np.unique(files).tolist():
            table = self.of(part)
            if table is not None:
                yield np.flatnonzero(files == part), table, table.column(self.number).to_numpy()

    def contains(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), bool)
        for at, _, known in self._parts(numbers):
            place = np.minimum(np.searchsorted(known, numbers[at]), len(known) - 1)
            out[at] = known[place] == numbers[at]
        return out

    def entries(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Table]]:
        """For each file: which of the numbers each of its entries is about, and those entries."""
        for at, table, known in self._parts(numbers):
            low, high = np.searchsorted(known, numbers[at], "left"), np.searchsorted(known, numbers[at], "right")
            n = high - low
            place = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
            if len(place):
                yield np.repeat(at, n), table.take(pa.array(place))


def in_part_rows(rows: DataFrame, number: str, folder: str) -> DataFrame:
    """The rows whose number the folder has; only numbers go to Python."""

    @F.arrow_udf("boolean")
    def there(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = PartRows(folder)
        for numbers in parts:
            yield pa.array(known.contains(numbers.to_numpy()))

    return rows.filter(there(F.col(number)))
