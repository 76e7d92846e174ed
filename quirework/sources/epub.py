"""EPUB archives -> section rows.

Python only opens the archive and lists its documents; everything after that (body,
heading, cleaning) is done on the resulting rows by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions import html as H
from ..functions import patterns as P
from ..functions.expr import compute
from ..functions.text import py_strip
from ..operators.html import heading_of
from ..operators.observe import counted
from .tables import bound_batches

ENTRY_SCHEMA = (
    "path string, section_idx int, xhtml string, title string, creator string, error string"
)


def read_epub_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of all EPUB files below a folder."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.epub")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "content")
    )


#: Characters of documents that leave the reader in one batch, about, and documents in it at most.
FRAME_CHARS, FRAME_ROWS = 1_000_000, 2_000
#: Unpacked bytes of an archive whose documents are held until all are read; those of a larger one
#: are read twice, first to check them.
HELD_BYTES = 8 << 20


def _entry_reader():
    """Built as a closure so that it travels to the executors by value."""

    def read(batches):
        import io
        import posixpath
        import zipfile
        from urllib.parse import unquote
        from xml.etree import ElementTree

        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("section_idx", pa.int32()), *[
            (name, pa.string()) for name in ("xhtml", "title", "creator", "error")]])

        def local(tag):
            return tag.rsplit("}", 1)[-1]

        def text(raw):
            return raw.decode("utf-8-sig", errors="replace")

        def entries(path, content):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
                package = next(e.get("full-path") for e in container.iter() if local(e.tag) == "rootfile")
                opf = ElementTree.fromstring(archive.read(package))
                titles = [e.text or "" for e in opf.iter() if local(e.tag) == "title"]
                creators = [e.text or "" for e in opf.iter() if local(e.tag) == "creator"]
                base = posixpath.dirname(package)
                docs = [
                    e.get("href") for e in opf.iter()
                    if local(e.tag) == "item" and e.get("media-type") == "application/xhtml+xml"
                ]
                names = [posixpath.normpath(posixpath.join(base, unquote(href))) for href in docs]
                # an archive is taken as a whole: check all before any row leaves
                sizes = {member.filename: member.file_size for member in archive.infolist()}
                if sum(sizes.get(name, 0) for name in names) <= HELD_BYTES:
                    texts = iter([text(archive.read(name)) for name in names])
                else:
                    for name in names:
                        with archive.open(name) as document:
                            while document.read(1 << 20):
                                pass
                    texts = (text(archive.read(name)) for name in names)
                yield None
                for idx, xhtml in enumerate(texts):
                    yield (path, idx, xhtml, (titles or [None])[0], (creators or [None])[0], None)

        def packed(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        rows, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                path, found = path.as_py(), False
                try:
                    documents = entries(path, content.as_py())
                    next(documents)
                except Exception as exc:
                    rows.append((path, None, None, None, None, type(exc).__name__))
                    continue
                for row in documents:
                    rows.append(row)
                    size, found = size + len(row[2]), True
                    if size > FRAME_CHARS or len(rows) >= FRAME_ROWS:
                        yield packed(rows)
                        rows, size = [], 0
                if not found:
                    rows.append((path, None, None, None, None, "no documents"))
        if rows:
            yield packed(rows)

    return read


#: Bytes of archives that go to a Python worker at once, about.
ARCHIVE_BYTES = 4 << 20


def epub_entries(archives: DataFrame) -> DataFrame:
    """``(path, content)`` -> one row per document of each archive, or one reject row.

    Archives may be large: Spark cuts Arrow batches by bytes, and an archive's documents leave in
    batches of about ``FRAME_CHARS``. A worker holds no more than these and one archive.
    """
    bound_batches(archives.sparkSession, ARCHIVE_BYTES)
    return archives.select("path", "content").mapInArrow(_entry_reader(), ENTRY_SCHEMA)


def rejected_archives(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("error").isNotNull()).select("path", "error")


def epub_sections(entries: DataFrame, observation: Observation | None = None) -> DataFrame:
    """``(path, section_idx, title, author, heading, html)``; empty bodies are dropped.

    An ``observation`` counts what goes by while the sections are written or collected:
    ``sections_read``, ``sections_dropped`` (empty bodies) and ``archives_rejected``.
    """

    def named(c, default):
        return F.when(F.coalesce(F.col(c), F.lit("")) != "", py_strip(F.col(c))).otherwise(default)

    good = F.col("error").isNull()
    read = entries if observation is not None else entries.filter(good)
    bodies = read.select(
        "path", "section_idx",
        named("title", P.UNKNOWN_TITLE).alias("title"),
        named("creator", P.UNKNOWN_AUTHOR).alias("author"),
        "xhtml", "error",
    )
    bodies = compute(bodies, "html", F.when(good, H.body_content(F.col("xhtml"))))
    if observation is not None:
        bodies = counted(bodies, observation, {
            "sections_read": good, "sections_dropped": good & (F.col("html") == ""), "archives_rejected": ~good})
    return bodies.filter(F.col("html") != "").select(
        "path", "section_idx", "title", "author", heading_of("html").alias("heading"), "html"
    )
