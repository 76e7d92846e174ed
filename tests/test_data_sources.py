"""The EPUB source and the sink with a file per book."""

from __future__ import annotations

import os
import zipfile

import pytest
from paths import SMALL
from pyspark.sql import functions as F

from quirework import sinks
from quirework.operators import books as B
from quirework.plans import fixtures as X
from quirework.sinks import book_files
from quirework.sources import epub, epub_source
from test_sources_sinks import write_epub

BODY = "<html><body><h2>{}</h2><p>t</p></body></html>"


@pytest.fixture
def corpus(spark, tmp_path):
    docs = {"OPS/text/b.xhtml": BODY.format("B"), "OPS/text/a a.xhtml": BODY.format("A" * 3000)}
    write_epub(tmp_path / "good.epub", "<dc:title> T </dc:title><dc:title>U</dc:title><dc:creator>C</dc:creator>", docs)
    os.mkdir(tmp_path / "sub")
    write_epub(tmp_path / "sub" / "plain é.epub", "", {"OPS/text/b.xhtml": "<html><body> </body></html>", "OPS/text/a a.xhtml": BODY.format("")})
    (tmp_path / "bad.epub").write_bytes(b"nope")
    (tmp_path / "empty.epub").write_bytes(b"")
    (tmp_path / "note.txt").write_text("no archive")
    write_epub(tmp_path / "missing.epub", "", {})
    with zipfile.ZipFile(tmp_path / "none.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        z.writestr("p.opf", "<package><manifest/></package>")
    # a document with a wrong byte behind a right directory
    write_epub(tmp_path / "torn.epub", "", docs)
    raw = (tmp_path / "torn.epub").read_bytes()
    at = raw.index(b"<h2>A") + 50
    (tmp_path / "torn.epub").write_bytes(raw[:at] + b"\x00" + raw[at + 1:])
    spark.dataSource.register(epub_source.EpubSource)
    return tmp_path


def as_set(df):
    return sorted((os.path.basename(r.path), r.section_idx, r.xhtml, r.title, r.creator, r.error) for r in df.collect())


@pytest.mark.parametrize("held", [1 << 20, 100])
def test_the_source_reads_what_the_archive_reader_reads(spark, corpus, held):
    want = epub.epub_entries(epub.read_epub_files(spark, str(corpus)))
    got = spark.read.format("epub").option("heldBytes", held).load(str(corpus))  # larger archives are checked first
    assert got.schema == want.schema
    # an empty file is no row of binaryFile
    assert as_set(got.filter("path not like '%/empty.epub'")) == as_set(want)
    errors = {os.path.basename(r.path): r.error for r in got.filter("error is not null").collect()}
    assert errors == {"bad.epub": "BadZipFile", "empty.epub": "BadZipFile", "missing.epub": "KeyError",
                      "none.epub": "no documents", "torn.epub": "BadZipFile"}
    sections = epub.epub_sections(got).select("title", "author", "heading").collect()
    assert sorted(map(tuple, sections)) == [("T", "C", "A" * 3000), ("T", "C", "B"), ("Unknown Title", "Unknown Author", "")]


def test_groups_and_single_files(spark, corpus):
    every = spark.read.format("epub").load(str(corpus))
    small = spark.read.format("epub").option("groupBytes", "1").load(str(corpus))
    assert every.rdd.getNumPartitions() == 1 and small.rdd.getNumPartitions() == 7
    assert as_set(every) == as_set(small)
    one = spark.read.format("epub").load(str(corpus / "good.epub"))
    assert one.count() == 2
    flat = spark.read.format("epub").option("recursive", "false").load(str(corpus))
    assert {os.path.basename(r.path) for r in flat.collect()} >= {"good.epub", "bad.epub"} and flat.filter("path like '%plain%'").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("epub").load(str(corpus / "nowhere")).count()


def test_no_document_is_unpacked_for_other_columns(spark, corpus):
    names = spark.read.format("epub").schema("path string, title string, error string").load(str(corpus))
    rows = {(os.path.basename(r.path), r.title, r.error) for r in names.collect()}
    assert ("good.epub", " T ", None) in rows and ("torn.epub", None, None) in rows and names.columns == ["path", "title", "error"]
    with pytest.raises(Exception, match="no column"):
        spark.read.format("epub").schema("pages int").load(str(corpus)).count()


def test_conditions_on_the_path_choose_archives(corpus):
    reader = epub_source.FilteredEpubReader(epub_source.SCHEMA, {"path": str(corpus)})
    left = list(reader.pushFilters([epub_source.StringEndsWith(("path",), "good.epub"), epub_source.EqualTo(("title",), "T")]))
    assert [f.attribute for f in left] == [("title",)]
    assert [[os.path.basename(p) for p in g.paths] for g in reader.partitions()] == [["good.epub"]]


def test_pushed_conditions_give_the_same_rows(spark, corpus):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = spark.read.format("epub").option("pushFilters", "true").load(str(corpus)).filter(F.col("path").endswith("good.epub") & (F.col("section_idx") == 1))
        assert [r.section_idx for r in got.collect()] == [1]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


# --- a file per book ------------------------------------------------------------------


@pytest.fixture(scope="module")
def documents(spark):
    texts = B.clean_section_text(B.section_items(X.book_sections(spark, SMALL)))
    names = X.documents(spark, SMALL).select(F.col("source").alias("book_id"), F.lit("T").alias("used_title"), F.lit("A").alias("used_author")).distinct()
    docs = B.markdown_documents(texts, names)
    # two books of one slug, the others with slugs of their own
    return docs.withColumn("book_slug", F.when(F.col("book_id").isin("src1", "src2"), "same").otherwise(F.concat(F.lit("s-"), "book_id")))


def whole_texts(docs):
    rows = sorted(docs.collect(), key=lambda r: (r.book_id, r.part_no))
    return {b: "".join(r.markdown for r in rows if r.book_id == b) for b in {r.book_id for r in rows}}


def files_below(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_books_read_back(spark, documents, tmp_path):
    path = str(tmp_path / "books")
    sinks.write_book_files(documents, path, content="markdown")
    names = {r.book_id: r.file_name for r in book_files.book_file_names(documents).collect()}
    assert sorted(names[b] for b in ("src1", "src2")) == ["same", "same~2"]
    texts = whole_texts(documents)
    assert files_below(path) == sorted(f"{names[b]}.md" for b in texts)
    for book, text in texts.items():
        assert (tmp_path / "books" / f"{names[book]}.md").read_text() == text
    with pytest.raises(Exception, match="FileExistsError"):  # nothing is replaced, nothing is left over
        sinks.write_book_files(documents, path, content="markdown")
    assert files_below(path) == sorted(f"{names[b]}.md" for b in texts)
    one = documents.filter("book_id = 'src1'").withColumn("markdown", F.lit("x"))
    sinks.write_book_files(one, path, content="markdown", overwrite=True)
    assert (tmp_path / "books" / "same.md").read_text() == "x" * one.count()
    assert len(files_below(path)) == len(texts)


def test_a_large_book_is_written_by_several_tasks(spark, tmp_path):
    parts = spark.range(0, 4000, 1, 8).select(
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("b"), (F.col("id") % 20).cast("string"))).otherwise("big").alias("book_id"),
        F.col("id").alias("part_no"), F.concat(F.col("id").cast("string"), F.lit("\n")).alias("part"))
    docs = parts.withColumn("book_slug", F.col("book_id"))
    written = []
    plain = book_files.BookFilesWriter.commit

    def commit(self, messages):
        written.append([p for m in messages if m for p in m.pieces])
        plain(self, messages)

    book_files.BookFilesWriter.commit = commit
    try:
        sinks.write_book_files(docs, str(tmp_path / "b"), suffix=".txt")
    finally:
        book_files.BookFilesWriter.commit = plain
    assert (tmp_path / "b" / "big.txt").read_text() == "".join(f"{i}\n" for i in range(4000) if i % 4)
    assert (tmp_path / "b" / "b4.txt").read_text() == "".join(f"{i}\n" for i in range(4, 4000, 20))


def test_a_failing_task_leaves_no_file(spark, documents, tmp_path):
    path = tmp_path / "f"
    sinks.write_book_files(documents.filter("book_id = 'src5'"), str(path), content="markdown")
    before = files_below(path)
    broken = documents.filter("book_id <> 'src5'").withColumn(
        "markdown", F.when((F.col("book_id") == "src7") & (F.col("part_no") > 0), F.raise_error(F.lit("no paper left"))).otherwise(F.col("markdown")))
    with pytest.raises(Exception, match="no paper left"):
        sinks.write_book_files(broken, str(path), content="markdown")
    assert files_below(path) == before and os.listdir(path) == ["s-src5.md"]


def test_parts_out_of_order_are_an_error(tmp_path):
    import pyarrow as pa

    writer = book_files.BookFilesWriter(str(tmp_path), ".md", False)
    batch = pa.RecordBatch.from_pydict({"name": ["a", "a"], "part_no": [2, 1], "content": ["x", "y"]})
    with pytest.raises(ValueError, match="order"):
        writer.write(iter([batch]))
    writer.abort([None])
    assert os.listdir(tmp_path) == []


def test_no_books(spark, documents, tmp_path):
    sinks.write_book_files(documents.limit(0), str(tmp_path / "n"), content="markdown")
    assert files_below(tmp_path / "n") == []
