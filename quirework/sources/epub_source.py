"""``spark.read.format("epub")``: documents of EPUB archives without archives as cells.

    spark.dataSource.register(EpubSource)
    entries = spark.read.format("epub").load("/corpus")

The rows are those of ``epub.epub_entries``, and an empty file is a fault too (``binaryFile`` skips
it). A task opens an archive where it lies, reads the
directory at its end, and then only the members that the package lists; nothing but the
documents' text becomes part of a row. Files may lie wherever ``pyarrow.fs`` can open them
(local folders, HDFS, object stores).

- **Groups.** A partition is a group of archives of about ``groupBytes`` bytes; one large archive
  is a group of its own. The driver lists names and sizes only.
- **Columns.** With a schema given (``.schema("path string, title string")``) only these columns
  are made. Without ``xhtml`` no document is unpacked.
- **Filters.** With the option ``pushFilters`` conditions on ``path`` (equal, in, begins with, ends
  with) choose archives before the groups are made; Spark wants
  ``spark.sql.python.filterPushdown.enabled`` for that.
- **Whole archives.** An archive with a fault is one row with its ``error``. Documents of an archive
  up to ``heldBytes`` unpacked are held until all are read; those of a larger one are read
  twice, first to check them. A fault inside a document shows only where documents are read.
"""

from __future__ import annotations

import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith,
)
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Bytes of archives in one group, and archives in it at most.
GROUP_BYTES, GROUP_FILES = 128 << 20, 5_000
#: Unpacked bytes of an archive whose documents are held until all are read.
HELD_BYTES = 64 << 20
#: Bytes of the smallest record that ends an archive.
DIRECTORY_END = 22
#: Characters of documents in one batch of rows, about.
BATCH_CHARS = 4_000_000

SCHEMA = StructType([
    StructField(name, IntegerType() if name == "section_idx" else StringType())
    for name in ("path", "section_idx", "xhtml", "title", "creator", "error")])


@dataclass
class EpubGroup(InputPartition):
    paths: tuple[str, ...]


def opened(uri: str) -> tuple[files.FileSystem, str, str]:
    """(file system, path in it, what to put before a path to have a URI again)."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return files.LocalFileSystem(), parts.path if parts.scheme else uri, "file:"
    system, path = files.FileSystem.from_uri(uri)
    host = f"{parts.scheme}://{parts.netloc}"
    return system, path, host if path.startswith("/") else f"{parts.scheme}://"


class EpubSource(DataSource):
    """Options: ``path`` (of ``load``), ``groupBytes``, ``heldBytes``, ``recursive`` (true unless false),
    ``pushFilters`` (false unless true)."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> EpubReader:
        for field in schema.fields:
            if field.name not in SCHEMA.names or SCHEMA[field.name].dataType != field.dataType:
                raise ValueError(f"an EPUB has no column {field.simpleString()}")
        pushing = str(self.options.get("pushFilters", "false")).lower() == "true"
        return (FilteredEpubReader if pushing else EpubReader)(schema, self.options)


class EpubReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.columns = schema.names
        self.arrow = pa.schema([(f.name, pa.int32() if f.dataType == IntegerType() else pa.string()) for f in schema.fields])
        self.root = options["path"]
        self.group_bytes = int(options.get("groupBytes", GROUP_BYTES))
        self.held_bytes = int(options.get("heldBytes", HELD_BYTES))
        self.recursive = str(options.get("recursive", "true")).lower() != "false"
        self.wanted: list[Filter] = []

    def is_wanted(self, path: str) -> bool:
        tests = {
            EqualTo: lambda f: path == f.value, In: lambda f: path in f.value,
            StringStartsWith: lambda f: path.startswith(f.value), StringEndsWith: lambda f: path.endswith(f.value),
        }
        return all(tests[type(f)](f) for f in self.wanted)

    def partitions(self) -> list[EpubGroup]:
        system, path, before = opened(self.root)
        info = system.get_file_info(path)
        if info.type == files.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info]
        if info.type == files.FileType.Directory:
            found = system.get_file_info(files.FileSelector(path, recursive=self.recursive))
        groups: list[EpubGroup] = []
        group: list[str] = []
        size = 0
        for info in sorted(found, key=lambda i: i.path):
            if info.type != files.FileType.File or not info.path.endswith(".epub") or not self.is_wanted(before + info.path):
                continue
            if group and (size + info.size > self.group_bytes or len(group) >= GROUP_FILES):
                groups.append(EpubGroup(tuple(group)))
                group, size = [], 0
            group.append(info.path)
            size += info.size
        return [*groups, EpubGroup(tuple(group))]

    def read(self, partition: EpubGroup) -> Iterator[pa.RecordBatch]:
        system, _, before = opened(self.root)
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            for row in documents(system, path, before + path, "xhtml" in self.columns, self.held_bytes):
                rows.append(row)
                size += len(row["xhtml"] or "")
                if size > BATCH_CHARS or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=self.arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=self.arrow)


class FilteredEpubReader(EpubReader):
    """A reader that looks at conditions on the path itself."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith) and f.attribute == ("path",):
                self.wanted.append(f)
            else:
                yield f


def row(path: str, idx: int | None = None, xhtml: str | None = None, title: str | None = None,
        creator: str | None = None, error: str | None = None) -> dict:
    return {"path": path, "section_idx": idx, "xhtml": xhtml, "title": title, "creator": creator, "error": error}


def documents(system: files.FileSystem, path: str, name: str, unpack: bool, held: int = HELD_BYTES) -> Iterator[dict]:
    """Rows of one archive, or one row with its fault."""
    try:
        with system.open_input_file(path) as stream:
            if stream.size() < DIRECTORY_END:  # zipfile would look before its beginning
                raise zipfile.BadZipFile(name)
            yield from of_archive(stream, name, unpack, held)
    except GeneratorExit:
        raise
    except Exception as exc:  # a fault of this archive alone
        yield row(name, error=type(exc).__name__)


def of_archive(stream, name: str, unpack: bool, held: int) -> Iterator[dict]:
    with zipfile.ZipFile(stream) as archive:
        members, title, creator = package(archive)
        infos = [archive.getinfo(m) for m in members]
        if not unpack:
            whole = [(i, None) for i in range(len(infos))]
        elif sum(i.file_size for i in infos) <= held:
            whole = [(i, text_of(archive, m)) for i, m in enumerate(members)]
        else:
            for m in members:
                with archive.open(m) as document:
                    while document.read(1 << 20):
                        pass
            whole = ((i, text_of(archive, m)) for i, m in enumerate(members))
        for i, text in whole:
            yield row(name, i, text, title, creator)
        if not members:
            yield row(name, error="no documents")


def text_of(archive: zipfile.ZipFile, member: str) -> str:
    return archive.read(member).decode("utf-8-sig", errors="replace")


def package(archive: zipfile.ZipFile) -> tuple[list[str], str | None, str | None]:
    """(members that are documents, in the package's order; first title; first creator)."""
    def local(tag: str) -> str:
        return tag.rsplit("}", 1)[-1]

    container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
    place = next(e.get("full-path") for e in container.iter() if local(e.tag) == "rootfile")
    opf = ElementTree.fromstring(archive.read(place))

    def first(name: str) -> str | None:
        return next((e.text or "" for e in opf.iter() if local(e.tag) == name), None)

    hrefs = [e.get("href") for e in opf.iter()
             if local(e.tag) == "item" and e.get("media-type") == "application/xhtml+xml"]
    base = posixpath.dirname(place)
    return [posixpath.normpath(posixpath.join(base, unquote(h))) for h in hrefs], first("title"), first("creator")
