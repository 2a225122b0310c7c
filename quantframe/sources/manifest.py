"""Tables that are replaced at once: data files, and a manifest that names those of the present version.

Tasks write files of their own names; nothing refers to them until the commit makes one new manifest, by a rename to a
name that was not used. Readers take the newest manifest, so they see the whole old table or the whole new one, and a
table may be replaced by rows read from itself. A failed task or commit leaves files without a manifest: the abort
deletes those it is told of, and the next commit all that neither its own version nor the last names. One writer at a
time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_NAME = re.compile(r"manifest-(\d{10})\.json")


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


def versions(path: str) -> list[int]:
    """Numbers of the manifests, oldest first."""
    where, root = fs.FileSystem.from_uri(path)
    found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(int(m[1]) for info in found if (m := _NAME.fullmatch(info.base_name)))


def manifest(path: str, version: int) -> dict:
    where, root = fs.FileSystem.from_uri(path)
    with where.open_input_stream(f"{root}/manifest-{version:010d}.json") as f:
        return json.loads(f.read())


class ManifestWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema.json(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(f"{root}/data", recursive=True)
        name, out, rows = f"data/{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                out = out or pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=where, compression="zstd")
                out.write_batch(batch)
                rows += batch.num_rows
            if out:
                out.close()
        except BaseException:
            if out:
                out.close()
                where.delete_file(f"{root}/{name}")
            raise
        return Written(name if out else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        known = versions(self.path)
        kept = manifest(self.path, known[-1])["files"] if known and not self.overwrite else []
        new = {"schema": json.loads(self.schema), "files": kept + [m.file for m in messages if m and m.file], "rows": sum(m.rows for m in messages if m)}
        number = known[-1] + 1 if known else 0
        where.create_dir(root, recursive=True)
        aside = f"{root}/new-{uuid.uuid4().hex}"
        with where.open_output_stream(aside) as f:
            f.write(json.dumps(new).encode())
        where.move(aside, f"{root}/manifest-{number:010d}.json")
        present = set(manifest(self.path, known[-1])["files"]) if known else set()
        for version in known[:-1]:
            where.delete_file(f"{root}/manifest-{version:010d}.json")
        for info in where.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)):
            if f"data/{info.base_name}" not in present | set(new["files"]):
                where.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        where, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.file:
                where.delete_file(f"{root}/{m.file}")


class Manifested(DataSource):
    @classmethod
    def name(cls) -> str:
        return "manifested"

    def writer(self, schema: StructType, overwrite: bool) -> ManifestWriter:
        return ManifestWriter(self.options["path"], schema, overwrite)


def replace_table(df: DataFrame, path: str) -> None:
    """Make df the table at path, in one step that readers see; df may read the table."""
    df.sparkSession.dataSource.register(Manifested)
    df.write.format("manifested").mode("overwrite").save(path)


def append_table(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(Manifested)
    df.write.format("manifested").mode("append").save(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the table, by Spark's own Parquet reader."""
    known = versions(path)
    if not known:
        raise FileNotFoundError(f"no manifest in {path}")
    present = manifest(path, known[-1])
    schema = StructType.fromJson(present["schema"])
    files = [f"{path.rstrip('/')}/{f}" for f in present["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
