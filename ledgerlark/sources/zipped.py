"""Zip archives of tab-separated tables as a data source: one partition an archive and member, all columns text, unwanted columns never built.

    spark.dataSource.register(ZippedTables)
    spark.read.format("zipped_tsv").option("columns", "ACCESSION_NUMBER,FILING_DATE").option("member", "SUBMISSION.tsv").load(folder)

A member is read in blocks as a stream, so its size does not matter. Archives without the member have no rows of it, and a column
that a member lacks is null there.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import csv, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType

TABBED = csv.ParseOptions(delimiter="\t", quote_char=False)


def place(uri: str) -> tuple[fs.FileSystem, str]:
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ZippedTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipped_tsv"

    def schema(self) -> StructType:
        out = StructType()
        for column in self.options["columns"].split(","):
            out.add(column.strip(), StringType())
        return out

    def reader(self, schema: StructType) -> ZippedReader:
        return ZippedReader(self.options["path"], self.options["member"], schema.names)


class ZippedReader(DataSourceReader):
    def __init__(self, folder: str, member: str, columns: list[str]):
        self.folder, self.member, self.columns = folder, member, columns

    def partitions(self) -> list[Archive]:
        files, path = place(self.folder)
        found = files.get_file_info(fs.FileSelector(path, recursive=True))
        return [Archive(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".zip")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        files, _ = place(self.folder)
        with files.open_input_file(partition.path) as raw, zipfile.ZipFile(raw) as archive:
            if self.member not in archive.namelist():
                return
            with archive.open(self.member) as lines:
                head = lines.readline().decode("utf-8").rstrip("\r\n").split("\t")
                kept = [c for c in self.columns if c in head]
                if not kept:
                    return
                options = csv.ConvertOptions(column_types=dict.fromkeys(head, pa.string()), include_columns=kept, strings_can_be_null=True, null_values=[""])
                try:
                    blocks = csv.open_csv(lines, csv.ReadOptions(column_names=head), TABBED, options)
                except pa.ArrowInvalid:  # nothing below the heading
                    return
                for block in blocks:
                    yield pa.RecordBatch.from_arrays([block.column(c) if c in kept else pa.nulls(len(block), pa.string()) for c in self.columns], self.columns)


def write_zipped(rows: DataFrame, folder: str, member: str) -> None:
    """Each partition of rows as an archive of its own with one member; columns of text. What a failed attempt leaves is written anew by the next."""
    names = rows.columns

    def task(batches):
        files, base = place(folder)
        files.create_dir(base, recursive=True)
        number = TaskContext.get().partitionId()
        held = io.BytesIO()
        with files.open_output_stream(f"{base}/{member.lower()}-{number:05d}.zip") as out:
            with zipfile.ZipFile(out if out.seekable() else held, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(member, "w", force_zip64=True) as lines:
                lines.write(("\t".join(names) + "\n").encode())
                for batch in batches:
                    csv.write_csv(batch, lines, csv.WriteOptions(include_header=False, delimiter="\t", quoting_style="none"))
            out.write(held.getvalue())
        yield pa.RecordBatch.from_pydict({"n": pa.array([number], pa.int32())})

    rows.select(*(rows[n].cast("string") for n in names)).mapInArrow(task, "n int").collect()
