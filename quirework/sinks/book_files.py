"""One file per book: ``write_book_files``, and the data source that it writes through.

Tasks write the parts of their books to files of their own in a temporary folder. The commit
gives each book its name: a book that one task wrote is renamed, and one that was cut between
tasks is joined from its files in order, a block at a time. Until then no file has a book's
name, and an abort leaves nothing behind. Attempts that are repeated or run twice write files of
their own; only those that Spark reports are used.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.books import unique_slugs
from ..operators.skew import salted_join
from ..sources.epub_source import opened

#: Bytes that are copied at once when a book is joined.
BLOCK = 4 << 20
COLUMNS = ("name", "part_no", "content")


@dataclass
class Piece:
    """A file with parts of one book that follow each other."""

    name: str
    first_part: int
    path: str


@dataclass
class Pieces(WriterCommitMessage):
    pieces: tuple[Piece, ...]


class BookFiles(DataSource):
    """Write only. Rows ``(name, part_no, content)``, sorted by name and part within a partition.
    Options: ``path``, ``suffix`` of the files."""

    @classmethod
    def name(cls) -> str:
        return "bookfiles"

    def writer(self, schema: StructType, overwrite: bool) -> BookFilesWriter:
        if tuple(schema.names) != COLUMNS:
            raise ValueError(f"columns must be {COLUMNS}")
        return BookFilesWriter(self.options["path"], self.options.get("suffix", ""), overwrite)


class BookFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.uri, self.suffix, self.overwrite = path.rstrip("/"), suffix, overwrite
        self.job = uuid.uuid4().hex

    def place(self) -> tuple[files.FileSystem, str, str]:
        system, path, _ = opened(self.uri)
        return system, path, f"{path}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pieces:
        system, _, folder = self.place()
        system.create_dir(folder, recursive=True)
        attempt = uuid.uuid4().hex
        pieces: list[Piece] = []
        out, last = None, None
        try:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in COLUMNS]
                for name, part, content in zip(*columns, strict=True):
                    if out is None or name != pieces[-1].name:
                        if out is not None:
                            out.close()
                        pieces.append(Piece(name, part, f"{folder}/{attempt}-{len(pieces)}"))
                        out, last = system.open_output_stream(pieces[-1].path), None
                    if last is not None and part < last:
                        raise ValueError(f"parts of {name} are not in order")
                    last = part
                    out.write((content or "").encode())
        finally:
            if out is not None:
                out.close()
        return Pieces(tuple(pieces))

    def commit(self, messages: list[Pieces | None]) -> None:
        system, path, folder = self.place()
        books: dict[str, list[Piece]] = defaultdict(list)
        for message in messages:
            for piece in message.pieces if message else ():
                books[piece.name].append(piece)
        targets = {name: f"{path}/{name}{self.suffix}" for name in books}
        there = {} if not targets else {
            i.path for i in system.get_file_info(files.FileSelector(path, allow_not_found=True)) if i.type == files.FileType.File}
        if not self.overwrite and (taken := there & set(targets.values()) if there else set()):
            raise FileExistsError(f"{min(taken)} and {len(taken) - 1} more")
        for name, pieces in books.items():
            pieces.sort(key=lambda p: p.first_part)
            source = pieces[0].path if len(pieces) == 1 else self.joined(system, pieces)
            system.move(source, targets[name])
        self.clear(system, folder)

    def joined(self, system: files.FileSystem, pieces: list[Piece]) -> str:
        target = f"{pieces[0].path}-whole"
        with system.open_output_stream(target) as out:
            for piece in pieces:
                with system.open_input_stream(piece.path) as part:
                    while block := part.read(BLOCK):
                        out.write(block)
        return target

    def abort(self, messages: list[Pieces | None]) -> None:
        system, _, folder = self.place()
        self.clear(system, folder)

    def clear(self, system: files.FileSystem, folder: str) -> None:
        """The temporary folder of this job, which nothing else writes to."""
        if system.get_file_info(folder).type == files.FileType.Directory:
            system.delete_dir(folder)


def book_file_names(docs: DataFrame, slug: str = "book_slug", book: str = "book_id") -> DataFrame:
    """``(book, slug, file_name)``: books of one slug have names of their own."""
    books = docs.select(F.col(book), F.col(slug).alias("slug")).distinct()
    named = unique_slugs(books, [book])
    return named.select(book, F.col("slug").alias(slug), F.col("unique_slug").alias("file_name"))


def write_book_files(docs: DataFrame, path: str, slug: str = "book_slug", book: str = "book_id",
                     order: str = "part_no", content: str = "part", suffix: str = ".md",
                     overwrite: bool = False) -> None:
    """Each book as one file ``<unique slug><suffix>`` below ``path``, its parts in order.

    Parts are dealt to tasks by name and part, so a large book is written by several tasks. An
    existing file of a book's name is an error, unless it may be overwritten. If any task
    fails, no file is written.
    """
    docs.sparkSession.dataSource.register(BookFiles)
    names = book_file_names(docs, slug, book).select(book, F.col("file_name").alias("name"))
    rows = salted_join(docs.select(book, F.col(order).cast("bigint").alias("part_no"), F.col(content).alias("content")),
                       names, [book], ["part_no"])
    placed = rows.select(*COLUMNS).repartitionByRange("name", "part_no").sortWithinPartitions("name", "part_no")
    placed.write.format("bookfiles").mode("overwrite" if overwrite else "append").option("suffix", suffix).save(path)
