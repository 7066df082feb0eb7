"""Reading and writing document files: through Spark's binaryFile, and as the data source `pdf`."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

#: Files up to this size are opened; a larger one is a row with the error `limit`.
MAX_FILE = 1 << 30
#: A task reads about so many bytes, of so many files at most.
TASK_BYTES, TASK_FILES = 1 << 27, 1024
#: Files that a commit moves at once.
MOVERS = 32


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content, length) of all files *.pdf under a path, by any file system that Spark knows. doc_id is the file's path.

    The content of a file above MAX_FILE is null; by its length, operators tell it from no content.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), F.when(F.col("length") <= MAX_FILE, F.col("content")).alias("content"), "length")


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: a row for each new file, with its time."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select(F.col("path").alias("doc_id"), F.col("modificationTime").alias("arrived"), F.when(F.col("length") <= MAX_FILE, F.col("content")).alias("content"), "length")


def write_files(docs: DataFrame, path: str) -> None:
    """A file for each row of (doc_id, content), through the data source."""
    docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").write.format("pdf").mode("append").save(path)


TABLES = {
    "pages": "path string, page_no int, width double, height double, rotate int, text string, error string",
    "objects": "path string, obj_num int, kind string, value string, error string",
    "files": "path string, content binary, error string",
}


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class PdfSource(DataSource):
    """spark.read.format("pdf").option("table", "pages" | "objects" | "files").option("password", ...).load(path)."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "pages")]

    def reader(self, schema) -> DataSourceReader:
        return PdfReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PdfWriter(self.options, schema, overwrite)


class PdfReader(DataSourceReader):
    """Filters on path and page_no are taken over: files and pages that they exclude aren't opened."""

    def __init__(self, options):
        self.options, self.path, self.page = options, None, None

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.path = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("page_no",) and self.options.get("table", "pages") == "pages":
                self.page = f.value
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(_uri(self.options["path"]))
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        sizes = sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and f.path.endswith(".pdf") and (self.path is None or f.path == self.path))
        tasks, paths, total = [], [], 0
        for path, size in sizes:
            if paths and (total + size > TASK_BYTES or len(paths) == TASK_FILES):
                tasks.append(Files(tuple(paths)))
                paths, total = [], 0
            paths.append(path)
            total += min(size, MAX_FILE)
        return [*tasks, Files(tuple(paths))] if paths else tasks

    def read(self, partition: Files):
        from pyarrow import fs

        from sheaf.sources.syntax import code_of

        system, _ = fs.FileSystem.from_uri(_uri(self.options["path"]))
        table = self.options.get("table", "pages")
        width = TABLES[table].count(",") - 1
        for path in partition.paths:
            if (system.get_file_info(path).size or 0) > MAX_FILE:
                yield (path, *[None] * width, "limit")
                continue
            try:
                with system.open_input_stream(path) as file:
                    data = file.read()
                for row in self._rows(table, data):
                    yield (path, *row, None)
            except Exception as error:
                yield (path, *[None] * width, code_of(error))

    def _rows(self, table: str, data: bytes):
        from sheaf.operators import text
        from sheaf.sources.document import Document
        from sheaf.sources.syntax import format_value, kind_of

        if table == "files":
            yield (data,)
            return
        document = Document(data, self.options.get("password"))
        if table == "objects":
            for number in document.numbers():
                value = document.get(number)
                yield number, kind_of(value), format_value(value).decode("latin-1")
            return
        for i, ref in enumerate(document.page_refs()):
            if self.page is None or i == self.page:
                page = document.dictionary(ref)
                a = document.attributes(page)
                yield i, a["crop"][2] - a["crop"][0], a["crop"][3] - a["crop"][1], a["rotate"], text.page_text(document, page)


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]  # where a file stands, and the name it is to have


class PdfWriter(DataSourceWriter):
    """A row's content to <path>/<name>.pdf; the name is doc_id where that is plain, else a digest of it.

    Tasks write under names of their own into a folder beside; only when all have ended are the files moved to their
    names. So a task may run twice, and a job that fails leaves what stood there as it was. Where a name is taken, by
    another row or by a file from before, the next free of name~2, name~3 and so on is used: no row is lost.
    """

    def __init__(self, options, schema, overwrite: bool = False):
        self.options, self.overwrite = options, overwrite
        names = [f.name for f in schema.fields]
        self.key, self.content = names.index("doc_id"), names.index("content")
        self.folder = f"_staged-{uuid.uuid4().hex}"  # made on the driver, so one for the job

    def _place(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(_uri(self.options["path"]))
        return system, root, posixpath.join(root, self.folder)

    def write(self, rows) -> Written:
        system, _, staged = self._place()
        system.create_dir(staged, recursive=True)
        files = []
        for row in rows:
            if row[self.content] is None:
                continue
            key = str(row[self.key])
            plain = all(c.isalnum() or c in "-_" for c in key) and 0 < len(key) < 100
            path = posixpath.join(staged, uuid.uuid4().hex)
            with system.open_output_stream(path) as file:
                file.write(bytes(row[self.content]))
            files.append((path, key if plain else hashlib.sha256(key.encode()).hexdigest()))
        return Written(tuple(files))

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, root, staged = self._place()
        system.create_dir(root, recursive=True)
        before = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".pdf")]
        taken = set() if self.overwrite else {posixpath.basename(p) for p in before}
        moves = []
        for path, name in sorted((f for m in messages if m for f in m.files), key=lambda f: f[1]):
            final, n = f"{name}.pdf", 1
            while final in taken:
                n += 1
                final = f"{name}~{n}.pdf"
            taken.add(final)
            moves.append((path, posixpath.join(root, final)))
        with ThreadPoolExecutor(MOVERS) as movers:
            if self.overwrite:
                list(movers.map(system.delete_file, before))
            list(movers.map(lambda m: system.move(*m), moves))
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, _, staged = self._place()
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}" if path.startswith("/") else path


def register(spark: SparkSession) -> None:
    """Makes the format `pdf` known, and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfSource)
