from __future__ import annotations

import os
import zipfile

import pytest
from paths import SMALL
from pyspark.sql import functions as F

from quirework import settings as S, sinks
from quirework.operators import books as B
from quirework.plans import fixtures as X
from quirework.sources import epub, samples

OPF = ('<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{meta}</metadata><manifest>'
       '<item id="b" href="text/b.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/>'
       '<item id="a" href="text/a%20a.xhtml" media-type="application/xhtml+xml"/></manifest></package>')


def write_epub(path, meta, docs):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", OPF.format(meta=meta))
        for name, text in docs.items():
            z.writestr(name, text)


def test_epub_files(spark, tmp_path):
    body = "<html><head><style>x</style></head><body><h2>{}</h2><p>t</p></body></html>"
    docs = {"OPS/text/b.xhtml": body.format("B"), "OPS/text/a a.xhtml": body.format("A")}
    write_epub(tmp_path / "good.epub", "<dc:title> T </dc:title><dc:title>U</dc:title><dc:creator>C</dc:creator>", docs)
    os.mkdir(tmp_path / "sub")
    write_epub(tmp_path / "sub" / "plain.epub", "", {"OPS/text/b.xhtml": "<html><body> </body></html>", "OPS/text/a a.xhtml": body.format("")})
    (tmp_path / "bad.epub").write_bytes(b"nope")
    write_epub(tmp_path / "missing.epub", "", {})
    entries = epub.epub_entries(epub.read_epub_files(spark, str(tmp_path)))
    got = [(os.path.basename(r.path), r.section_idx, r.title, r.author, r.heading, r.html) for r in epub.epub_sections(entries).orderBy("path", "section_idx").collect()]
    assert got == [
        ("good.epub", 0, "T", "C", "B", "<h2>B</h2><p>t</p>"), ("good.epub", 1, "T", "C", "A", "<h2>A</h2><p>t</p>"),
        ("plain.epub", 1, "Unknown Title", "Unknown Author", "", "<h2></h2><p>t</p>")]
    bad = {os.path.basename(r.path): r.error for r in epub.rejected_archives(entries).collect()}
    assert bad == {"bad.epub": "BadZipFile", "missing.epub": "KeyError"}


def test_sample_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ignored\n=== One ===\n<p>x</p>\n\n  === Two===  \n\ny\nz\n===  ===\n")
    (tmp_path / "b.txt").write_text("no header\n")
    rows = samples.labelled_samples(samples.read_sample_files(spark, str(tmp_path))).orderBy("path", "sample_idx").collect()
    assert [(r.sample_idx, r.name, r.body, r.error) for r in rows] == [
        (0, "One", "<p>x</p>", None), (1, "Two", "y\nz", None), (2, "", "", None), (None, None, None, "no_samples")]


def test_documents_read_back(spark, tmp_path):
    texts = B.clean_section_text(B.section_items(X.book_sections(spark, SMALL)))
    names = X.documents(spark, SMALL).select(F.col("source").alias("book_id"), F.lit("T").alias("used_title"), F.lit("A").alias("used_author")).distinct()
    docs = B.markdown_documents(texts, names).withColumn("book_slug", F.lit("one-slug-for-all"))
    sinks.write_documents(docs, str(tmp_path / "table"))
    rows = sorted(spark.read.parquet(str(tmp_path / "table")).collect(), key=lambda r: (r.book_id, r.part_no))
    back = {b: "".join(r.markdown for r in rows if r.book_id == b) for b in {r.book_id for r in rows}}
    assert len(back) == names.count()
    # files in name order are the same text, and books of one slug stay apart
    sinks.write_document_files(docs, str(tmp_path / "files"), content="markdown")
    for book, text in back.items():
        d = tmp_path / "files" / "book_slug=one-slug-for-all" / f"book_id={book}"
        files = sorted(f for f in os.listdir(d) if f.startswith("part-"))
        got = "".join((d / f).read_text() for f in files)
        assert [line for line in got.split("\n") if line] == [line for line in text.split("\n") if line]
    with pytest.raises(Exception):
        sinks.write_documents(docs, str(tmp_path / "table"))


def test_variant_folders_read_back(spark, tmp_path):
    items = B.fan_out(B.section_items(X.book_sections(spark, SMALL)), S.variant_groups(spark, "script"))
    texts = B.clean_section_text(items).select("book_id", "section_idx", "variant", "text")
    sinks.write_by_variant(texts, str(tmp_path / "v"))
    assert sorted(d for d in os.listdir(tmp_path / "v") if "=" in d) == sorted(f"variant={v[1]}" for v in S.VARIANTS if v[0] == "script")
    back = spark.read.parquet(str(tmp_path / "v"))
    assert back.count() == texts.count()
    one = spark.read.parquet(str(tmp_path / "v")).filter("variant = 'standard'")
    assert "PartitionFilters: [isnotnull(variant" in one._jdf.queryExecution().executedPlan().toString()


def test_styled_paragraphs_read_back(spark, tmp_path):
    texts = B.clean_section_text(B.section_items(X.book_sections(spark, SMALL)))
    names = X.documents(spark, SMALL).select(F.col("source").alias("book_id"), F.lit("T").alias("used_title"), F.lit("A").alias("used_author")).distinct()
    rows = B.styled_paragraphs(texts, names, S.spacing_modes(spark))
    sinks.write_styled_paragraphs(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == rows.count()


def test_row_local_operators_accept_a_stream(spark, tmp_path):
    sections = X.book_sections(spark, SMALL)
    sections.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sections.schema).parquet(str(tmp_path / "in"))
    texts = B.clean_section_text(B.fan_out(B.section_items(stream), S.variant_groups(spark, "app")))
    query = (texts.select("book_id", "section_idx", "variant", "text").writeStream.format("parquet")
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination(120)
    batch = B.clean_section_text(B.fan_out(B.section_items(sections), S.variant_groups(spark, "app")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count() > 0


def test_archives_leave_in_bounded_batches(tmp_path):
    import pyarrow as pa

    write_epub(tmp_path / "a.epub", "", {"OPS/text/b.xhtml": "x" * 300_000, "OPS/text/a a.xhtml": "y"})
    content = (tmp_path / "a.epub").read_bytes()
    batch = pa.RecordBatch.from_pydict({"path": [str(k) for k in range(20)], "content": [content] * 19 + [b"no"]})
    found = list(epub._entry_reader()([batch]))
    held = [sum(len(x or "") for x in b.column("xhtml").to_pylist()) for b in found]
    assert len(found) > 3 and max(held) <= epub.FRAME_CHARS + 300_000 and sum(b.num_rows for b in found) == 39
    assert found[-1].to_pylist()[-1] == {
        "path": "19", "section_idx": None, "xhtml": None, "title": None, "creator": None, "error": "BadZipFile"}
