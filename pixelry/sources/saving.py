"""Encoded pictures as files, written by Spark tasks and committed together.

A task writes into a folder of its own under `_writing`; when all tasks are done these folders are moved to
their place, and when one fails they are removed.  The driver handles a name for each task, never one for
each file.  Files are named by the pictures' ids, escaped so that different ids have different names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "picture_files"
LONGEST = 180


def file_name(picture_id: str | None) -> str:
    """A name for an id, in ASCII and without slashes; ids that differ have names that differ.

    A null id gives %null, which no escaped text can be; names beyond LONGEST end in the id's hash.
    """
    if picture_id is None:
        return "%null"
    name = quote(picture_id, safe="") or "%empty"
    if name[0] in "._":  # such files are hidden from readers
        name = f"%{ord(name[0]):02X}{name[1:]}"
    return name if len(name) <= LONGEST else f"{name[:100]}%h{hashlib.sha256(picture_id.encode()).hexdigest()}"


@dataclass
class Written(WriterCommitMessage):
    folder: str | None


class _Writer(DataSourceWriter):
    def __init__(self, path: str, extension: str, job: str):
        self.path, self.extension, self.job = path, extension, job

    def _store(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return fs, store, root.rstrip("/")

    def write(self, rows: Iterator) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq

        _, store, root = self._store()
        task = uuid.uuid4().hex
        at, names, index = f"{root}/_writing/{self.job}/files/{task}", {}, []
        for row in rows:
            path = None
            if row["content"] is not None:
                if not index or all(p is None for _, p, *_ in index):
                    store.create_dir(at, recursive=True)
                name = file_name(row["picture_id"])
                names[name] = names.get(name, 0) + 1
                name += f"%r{names[name]}" * (names[name] > 1)  # an id that comes again
                with store.open_output_stream(f"{at}/{name}.{self.extension}") as out:
                    out.write(row["content"])
                path = f"{root}/{self.job}/{task}/{name}.{self.extension}"
            index.append((row["picture_id"], path, len(row["content"] or b""), row["error"]))
        if index:
            listed = f"{root}/_writing/{self.job}/index"
            store.create_dir(listed, recursive=True)
            types = zip(("picture_id", "path", "length", "error"), (pa.string(), pa.string(), pa.int64(), pa.string()), zip(*index, strict=True), strict=True)
            with store.open_output_stream(f"{listed}/{task}.parquet") as out:
                pq.write_table(pa.table({n: pa.array(v, t) for n, t, v in types}), out)
        return Written(task if index else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, store, root = self._store()
        done = {m.folder for m in messages if m is not None and m.folder}
        store.create_dir(f"{root}/{self.job}", recursive=True)
        store.create_dir(f"{root}/_index/{self.job}", recursive=True)
        for task in sorted(done):  # attempts that did not count stay behind and are removed
            for source, target in ((f"files/{task}", f"{self.job}/{task}"), (f"index/{task}.parquet", f"_index/{self.job}/{task}.parquet")):
                if store.get_file_info(f"{root}/_writing/{self.job}/{source}").type != fs.FileType.NotFound:
                    store.move(f"{root}/_writing/{self.job}/{source}", f"{root}/{target}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, store, root = self._store()
        if store.get_file_info(f"{root}/_writing/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_writing/{self.job}")
        if not store.get_file_info(fs.FileSelector(f"{root}/_writing", allow_not_found=True)):
            try:
                store.delete_dir(f"{root}/_writing")
            except OSError:  # it was not there, or another job's
                pass


class PictureFiles(DataSource):
    """Writes rows (picture_id, content, error) as files; options path, extension and job, the name of the folder they come to."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("picture files are added, never overwritten")
        return _Writer(self.options["path"], self.options["extension"], self.options.get("job") or uuid.uuid4().hex)


def save(encoded: DataFrame, folder: str, extension: str) -> DataFrame:
    """Write each picture of `encode` as a file of its own under a folder that all tasks reach; picture_id, path, length and error of each.

    The files are there when this returns, all of them or none.  Rows without content give no file and keep
    their error; a repeated id gives a file for each row.
    """
    spark, job = encoded.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(PictureFiles)
    encoded.select("picture_id", "content", "error").write.format(FORMAT).mode("append").options(path=folder, extension=extension, job=job).save()
    return spark.read.schema("picture_id string, path string, length long, error string").parquet(f"{folder.rstrip('/')}/_index/{job}").select("picture_id", "path", "length", F.col("error"))
