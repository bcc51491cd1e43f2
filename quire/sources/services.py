"""Services, workbooks and folders of files as data sources of Spark: ``spark.read.format("quire_metadata")``,
``df.write.format("quire_workbooks")`` and ``spark.read.format("quire_files")``.

register(spark) makes them known. Their code runs in tasks: planning and committing are all that the driver does, and no row passes it.
Files are reached through Arrow's file systems, so paths may be local, or in any store that Arrow knows by its scheme.
"""

from __future__ import annotations

import importlib
import json
import re
import time
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quire.sources.providers import ask

METADATA = "key string, metadata string, source string, success boolean, error string"
#: Bytes and files of a batch that is read.
BATCH_BYTES, BATCH_FILES = 8 << 20, 1000


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def _named(place: str) -> Callable:
    """A function by its place, module:name."""
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


#: Names of the folders that files are dealt to.
FOLDER = r"files-\d+"


def file_name(book: object, suffix: str) -> str:
    return re.sub(r"[^\w.-]", "_", str(book)) + suffix


def folder_of(name: str, folders: int) -> str:
    return f"files-{zlib.crc32(name.encode()) % folders}"


def folder_number(name: Column, folders: int) -> Column:
    """The number of a file's folder, for names without a character that file_name() replaces."""
    return (F.crc32(F.encode(name, "UTF-8")) % folders).cast("int")


@dataclass
class KeyGroup(InputPartition):
    """A row group of a file of keys."""

    file: str
    group: int


class MetadataReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.keys, self.column = options["path"], options.get("column", "key")
        self.services: Sequence[tuple[str, str]] = json.loads(options["services"])
        self.rate, self.attempts, self.wait = float(options.get("rate", 0)), int(options.get("attempts", 3)), float(options.get("wait", 1))

    def partitions(self) -> Sequence[KeyGroup]:
        store, root = _located(self.keys)
        files = [f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".parquet")] if store.get_file_info(root).type == fs.FileType.Directory else [root]
        return [KeyGroup(f, g) for f in sorted(files) for g in range(pq.ParquetFile(f, filesystem=store).num_row_groups)]

    def read(self, partition: KeyGroup) -> Iterator[pa.RecordBatch]:
        store, _ = _located(self.keys)
        calls = [(name, _named(place)) for name, place in self.services]
        due = time.monotonic()
        rows: list[tuple] = []

        def paced(call: Callable) -> Callable:
            def run(key: str):
                nonlocal due
                if self.rate > 0:
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = max(due, time.monotonic()) + 1 / self.rate
                return call(key)

            return run

        for key in pq.ParquetFile(store.open_input_file(partition.file)).read_row_group(partition.group, columns=[self.column]).column(0).to_pylist():
            found, source, error = None, None, None
            for name, call in calls if key else ():
                found, error = ask(key, name, paced(call), self.attempts, sleep=lambda s: time.sleep(s * self.wait))
                if found is not None:
                    source = name
                    break
            rows.append((key, None if found is None else json.dumps(found), source, found is not None, error))
            if len(rows) == 1000:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "metadata", "source", "success", "error"])


class MetadataSource(DataSource):
    """Metadata of keys from services, asked in order until one answers.

    load(path): Parquet files of keys; a task reads one row group of them. Options: ``column`` of the keys (key), ``services``: a JSON list
    of [name, "module:function"] (a function gives status, headers and body, see providers.ask()), ``rate``: the most calls a second that
    one task makes (no limit), ``attempts`` (3) and ``wait``, by which delays between attempts are multiplied (1). Every key has a row: null
    and empty ones are not asked, failures have their error. A task that is run again asks again."""

    @classmethod
    def name(cls) -> str:
        return "quire_metadata"

    def schema(self) -> str:
        return METADATA

    def reader(self, schema: StructType) -> MetadataReader:
        return MetadataReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """Names of the files that a task has staged, or where files are dealt to folders, of those."""

    names: list[str]


class WorkbookWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, suffix: str, folders: int) -> None:
        self.path, self.overwrite, self.suffix, self.folders = path, overwrite, suffix, folders
        self.staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, folder = _located(self.staged)
        attempt = uuid.uuid4().hex  # attempts of one task do not meet
        names: dict[str, None] = {}
        made: set[str] = set()
        for row in rows:
            name = file_name(row["book"], self.suffix)
            home = f"{attempt}/{folder_of(name, self.folders)}" if self.folders else attempt
            if home not in made:
                store.create_dir(f"{folder}/{home}", recursive=True)
                made.add(home)
            if f"{home}/{name}" in names:
                self._clash([name])
            with store.open_output_stream(f"{folder}/{home}/{name}") as out:
                out.write(bytes(row["content"] or b""))
            names[f"{home}/{name}"] = None
        return Written(sorted(made) if self.folders else list(names))

    @staticmethod
    def _clash(names: list[str]) -> None:
        raise ValueError(f"several workbooks have one file name: {sorted(names)[:5]}")

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _located(self.staged)
        _, target = _located(self.path)
        staged = [n for m in messages if m is not None for n in m.names]
        if self.folders:
            tasks = Counter(n.split("/")[1] for n in staged)
            held = {f.base_name for f in store.get_file_info(fs.FileSelector(target, allow_not_found=True)) if f.type == fs.FileType.Directory}
            whole = [n for n in staged if tasks[home := n.split("/")[1]] == 1 and (self.overwrite or home not in held)]
            apart = set(staged) - set(whole)
            staged = [f"{n}/{f.base_name}" for n in sorted(apart) for f in store.get_file_info(fs.FileSelector(f"{folder}/{n}"))]
        else:
            whole = []
        again = [n for n, k in Counter(n.split("/", 1)[1] for n in staged).items() if k > 1]
        if again:
            self._clash(again)
        if self.overwrite:
            old = store.get_file_info(fs.FileSelector(target, allow_not_found=True))
            for f in old:
                if f.type == fs.FileType.File and f.path.endswith(self.suffix):
                    store.delete_file(f.path)
                elif self.folders and f.type == fs.FileType.Directory and re.fullmatch(FOLDER, f.base_name):
                    store.delete_dir(f.path)
        for n in whole:
            store.move(f"{folder}/{n}", f"{target}/{n.split('/')[1]}")
        for home in {n.split("/")[1] for n in staged} if self.folders else ():
            store.create_dir(f"{target}/{home}", recursive=True)
        for n in staged:
            store.move(f"{folder}/{n}", f"{target}/{n.split('/', 1)[1]}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = _located(self.staged)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class WorkbookSink(DataSource):
    """Files from rows of book (the name) and content (the file), as workbook.workbooks() makes them.

    save(path): the folder. Tasks stage their files beside each other; the driver moves them when all tasks are done, by name only, and
    deletes what is staged if one fails, so that a failed job leaves the folder's workbooks as they were (a task that outlives the failure
    may leave a folder _staged-*, which Spark's readers pass over). Mode append keeps other files and replaces
    those of the same name; overwrite deletes the folder's other workbooks. Two books whose names give one file fail the job.

    Option ``folders``: files are dealt to so many folders by their names, which is meant for millions of them. Where one task writes a folder
    (deal rows by folder_number()) and the target does not have it yet, it is moved as a whole, so that the driver moves and knows folders and no
    files. A folder's files should always be written with the same number."""

    @classmethod
    def name(cls) -> str:
        return "quire_workbooks"

    def schema(self) -> str:
        return "book string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], overwrite, self.options.get("suffix", ".xlsx"), int(self.options.get("folders", 0)))


@dataclass
class Folder(InputPartition):
    """A folder of files, with all that is below it or without."""

    path: str
    deep: bool


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffixes = options["path"].rstrip("/"), tuple(x for x in options.get("suffixes", "").lower().split(",") if x)

    def partitions(self) -> Sequence[Folder]:
        store, root = _located(self.path)
        below = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and f.base_name[0] not in "_."]
        return [Folder(root, False), *(Folder(f, True) for f in sorted(below))]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, root = _located(self.path)
        paths: list[str] = []
        contents: list[bytes] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

        for f in store.get_file_info(fs.FileSelector(partition.path, recursive=partition.deep)):
            within = f.path[len(root) :]
            if f.type != fs.FileType.File or re.search(r"/[_.]", within) or (self.suffixes and not f.path.lower().endswith(self.suffixes)):
                continue
            with store.open_input_stream(f.path) as data:
                contents.append(data.read())
            paths.append(self.path + within)
            size += len(contents[-1])
            if size >= BATCH_BYTES or len(paths) >= BATCH_FILES:
                yield batch()
                paths, contents, size = [], [], 0
        if paths:
            yield batch()


class FilesSource(DataSource):
    """Whole files: path and content.

    load(path): a folder, and all below it. A task lists and reads one of its folders, so that the driver knows these and no files. Option
    ``suffixes``: the endings to read, by commas, in any case (all). What begins with _ or . is passed over, as by Spark's readers."""

    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema: StructType) -> FilesReader:
        return FilesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MetadataSource)
    spark.dataSource.register(WorkbookSink)
    spark.dataSource.register(FilesSource)
