"""Cleanup variants side by side: fan-out, failures, sizes, comparison, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from .. import settings as S
from ..functions import html as H
from ..functions import merge as M
from ..functions import naming as N
from ..functions.expr import compute, let
from ..functions.text import py_rstrip, py_strip, squeeze_spaces
from ..sources.tables import bound_batches
from . import books as B
from . import imposition as I
from .html import items_of_tokens, with_tokens
from .observe import counted
from .layout import CAPACITY, by_layout, section_pages, wanted_capacities, with_capacities
from .skew import salted_join

BYTES_PER_MB = 1024 * 1024


def unknown_variants(wanted: DataFrame, variants: DataFrame) -> DataFrame:
    """Requested names that no variant has, sorted."""
    return (
        wanted.select("variant").distinct()
        .join(variants.select("variant").distinct(), "variant", "left_anti")
        .orderBy("variant")
    )


def variant_paths(df: DataFrame, slug: str = "slug") -> DataFrame:
    folder = F.concat(N.output_dir(F.col(slug)), F.lit("/variants/"), F.col("variant"))
    return df.withColumn("pdf_path", F.concat(folder, F.lit("__interior.pdf"))).withColumn(
        "docx_path", F.concat(folder, F.lit("__editable.docx"))
    )


def texts_digest(number: Column, text: Column) -> Column:
    """Aggregate: a digest of numbered texts, as a string. It is a sum of SHA-256 prefixes (60
    bits) of ``number:text``, so it depends on every text and its place, and tasks add it up
    without gathering the texts of a book."""
    prefix = F.substring(F.sha2(F.concat(number.cast("string"), F.lit(":"), text), 256), 1, 15)
    return F.sum(F.conv(prefix, 16, 10).cast("decimal(20,0)")).cast("string")


def run_status(jobs: DataFrame, books: DataFrame, variants: DataFrame, layouts: DataFrame,
               observation: Observation | None = None) -> DataFrame:
    """Jobs ``(book_id, variant, layout_id)`` -> ``ok`` or ``failed`` with the reason.

    One failing job does not touch the others. ``books`` has ``(book_id, n_sections)``. An
    ``observation`` counts ``jobs_ok`` and ``jobs_failed`` while the rows are used.
    """
    known = variants.select("variant").distinct().withColumn("_known", F.lit(True))
    layout = layouts.select("layout_id", F.col("error").alias("_layout_error"), F.lit(True).alias("_layout"))
    error = (
        F.when(F.col("_known").isNull(), "unknown_variant")
        .when(F.col("_layout").isNull(), "unknown_layout")
        .when(F.col("_layout_error").isNotNull(), F.col("_layout_error"))
        .when(F.coalesce(F.col("n_sections"), F.lit(0)) == 0, "no_readable_sections")
    )
    checked = jobs.join(known, "variant", "left").join(layout, "layout_id", "left")
    done = (
        salted_join(checked, books, ["book_id"], ["variant", "layout_id"], "left")
        .select("book_id", "variant", "layout_id", error.alias("error"))
        .withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("failed"))
    )
    if observation is None:
        return done
    ok = F.col("status") == "ok"
    return counted(done, observation, {"jobs_ok": ok, "jobs_failed": ~ok})


def book_outcomes(statuses: DataFrame) -> DataFrame:
    """Per book: jobs that worked and failed; a book without any success is an error."""
    ok = F.sum(F.when(F.col("status") == "ok", 1).otherwise(0))
    return statuses.groupBy("book_id").agg(
        ok.alias("n_ok"),
        (F.count(F.lit(1)) - ok).alias("n_failed"),
        (ok == 0).alias("all_failed"),
    )


# --- measures ---------------------------------------------------------------------


def section_measures(items: DataFrame) -> DataFrame:
    """Replaces the items of a section by its output sizes and paragraph lengths."""
    measures = F.struct(
        F.octet_length(H.items_html(F.col("items"))).alias("html_bytes"),
        F.octet_length(M.items_text(F.col("items"))).alias("text_bytes"),
        F.transform("items", lambda x: F.length(x["text"])).alias("lens"),
    )
    return compute(items, "_m", measures).select(
        *[c for c in items.columns if c != "items"], "_m.*"
    )


def size_metrics(measures: DataFrame, keys) -> DataFrame:
    def mb(name):
        return (F.sum(name) / BYTES_PER_MB).alias(name.replace("_bytes", "_mb"))

    return measures.groupBy(*keys).agg(mb("input_bytes"), mb("html_bytes"), mb("text_bytes"))


def page_metrics(measures: DataFrame, wanted: DataFrame, layouts: DataFrame, keys) -> DataFrame:
    """Sizes and pages per key (``book_id`` among them) and wanted layout."""
    pages = F.when(F.size("lens") > 0, section_pages(F.col("lens"))).otherwise(0)
    sizes = ("input_bytes", "html_bytes", "text_bytes")
    pairs = wanted_capacities(wanted, layouts)
    summed = (
        with_capacities(measures.select(*keys, "section_idx", "lens", *sizes), pairs)
        .select(*keys, *CAPACITY, *sizes, pages.alias("_p"))
        .groupBy(*keys, *CAPACITY)
        .agg((F.sum("_p") + 2).alias("pages"), *[F.sum(c).alias(c) for c in sizes])
    )
    return by_layout(summed, pairs).select(*keys, "layout_id", "pages", *sizes)


def with_baseline(metrics: DataFrame, within, baseline: str = S.BASELINE_VARIANT) -> DataFrame:
    """Puts the baseline variant's pages and size next to each variant, with deltas.

    ``metrics`` is aggregated already: a window group holds one row per variant.
    """
    w = Window.partitionBy(*within)
    is_base = F.col("variant") == baseline

    def base(c):
        return F.max(F.when(is_base, F.col(c))).over(w)

    return (
        metrics.withColumn("baseline_pages", base("pages"))
        .withColumn("baseline_bytes", base("html_bytes"))
        .withColumn("page_delta", F.col("pages") - F.col("baseline_pages"))
        .withColumn("byte_delta", F.col("html_bytes") - F.col("baseline_bytes"))
    )


# --- previews ---------------------------------------------------------------------


def trim_preview(c, limit: int = S.PREVIEW_CHARS):
    return let(
        py_strip(c),
        lambda t: F.when(F.length(t) <= limit, t).otherwise(
            F.concat(py_rstrip(F.substring(t, 1, limit - 3)), F.lit("..."))
        ),
    )


def raw_blocks(tokens):
    """Leaves and scene marks of a section as they stand, in order."""
    return let(
        tokens,
        lambda t: F.transform(
            F.array_sort(
                F.concat(
                    F.transform(
                        H.leaf_blocks(t),
                        lambda b: F.struct(b["pos"].alias("pos"), H.block_text(t, b).alias("text")),
                    ),
                    F.transform(
                        H.rule_positions(t),
                        lambda i: F.struct(i.alias("pos"), F.lit("***").alias("text")),
                    ),
                )
            ),
            lambda x: x["text"],
        ),
    )


def raw_text(tokens):
    """The text of a section before cleaning."""
    return F.array_join(raw_blocks(tokens), "\n\n")


def before_after(sections: DataFrame, keys, merge: bool = False) -> DataFrame:
    """Section text before and after the standard cleanup."""
    both = with_tokens(sections).select(
        *keys, "heading",
        py_strip(raw_text(F.col("tokens"))).alias("before"),
        M.items_text(M.merge_items(items_of_tokens(), merge)).alias("after"),
    )
    return both


def preview_samples(sections: DataFrame, n: int = S.PREVIEW_SECTIONS,
                    limit: int = S.PREVIEW_CHARS) -> DataFrame:
    """First sections of each book, before and after, cut for display.

    A task keeps at most ``n`` sections per book before the shuffle, so that is all the HTML
    that moves; only the chosen sections are cleaned.
    """
    w = Window.partitionBy("book_id").orderBy("section_idx")
    picked = (
        sections.select("book_id", "section_idx", "heading", "html")
        .withColumn("sample_no", F.row_number().over(w))
        .filter(F.col("sample_no") <= n)
    )
    return before_after(picked, ["book_id", "sample_no"]).select(
        "book_id", "sample_no", "heading",
        trim_preview(F.col("before"), limit).alias("before"),
        trim_preview(F.col("after"), limit).alias("after"),
    )


def changed_sections(sections: DataFrame, groups: DataFrame, drop_notes: bool = False) -> DataFrame:
    """Per book and variant: sections, and sections whose text the variant changed.

    ``groups`` comes from ``settings.variant_groups``. Notes are left out on both sides."""
    tokens = with_tokens(sections.select("book_id", "section_idx", "html"), "html", drop_notes)
    before = compute(tokens, "before", py_strip(raw_text(F.col("tokens"))))
    items = compute(before, "items", items_of_tokens()).drop("tokens", "html")

    def compared(df):
        after = compute(df, "after", M.items_text(F.col("items"))).drop("items")
        return after.withColumn("changed", F.col("before") != F.col("after")).drop("before", "after")

    return B.fan_out(items, groups, compared).groupBy("book_id", "profile", "variant").agg(
        F.count(F.lit(1)).alias("n_sections"), F.sum(F.col("changed").cast("int")).alias("n_changed"))


CHANGE_SCHEMA = ("book_id {book}, section_idx {section}, names array<struct<profile:string,variant:string>>, "
                 "changes array<struct<change:string,before_first:int,before_last:int,after_idx:int>>")
#: Bytes of paragraphs that go to a Python worker at once, about, and changes that come back.
CHANGE_BYTES, CHANGE_ROWS = 4 << 20, 50_000


def raw_paragraphs(tokens):
    """Leaves and scene marks of a section as they stand, white space squeezed, without empty ones."""
    squeezed = F.transform(raw_blocks(tokens), squeeze_spaces)
    return F.filter(squeezed, lambda x: x != "")


def paragraph_changes(sections: DataFrame, groups: DataFrame, drop_notes: bool = False) -> DataFrame:
    """``(book_id, section_idx, profile, variant, change, before_first, before_last, after_idx)``:
    the shortest edit script from the paragraphs of a section as they stand to those that a
    variant makes of them. White space within a paragraph is no change.

    A paragraph is kept, removed, inserted, or joined from two or more (``before_first`` to
    ``before_last``); every paragraph of both sides is in one row. Variants with equal switches
    are compared once, and so are those that make the same of a section. The comparison needs a
    table of lengths, so it runs on Arrow batches in Python, a section at a time; sections that
    agree are told apart at once.
    """
    bound_batches(sections.sparkSession, CHANGE_BYTES)
    kinds = dict(sections.dtypes)
    schema = CHANGE_SCHEMA.format(book=kinds["book_id"], section=kinds["section_idx"])
    tokens = with_tokens(sections.select("book_id", "section_idx", "html"), "html", drop_notes)
    before = compute(tokens, "before", raw_paragraphs(F.col("tokens")))
    items = compute(before, "items", items_of_tokens()).drop("tokens", "html")

    def compared(df):
        after = compute(df, "after", F.filter(F.transform("items", lambda x: squeeze_spaces(x["text"])), lambda x: x != ""))
        return after.select("book_id", "section_idx", "names", "before", "after").mapInArrow(_changes(), schema)

    return B.fan_out(items, groups, compared).select(
        "book_id", "section_idx", "profile", "variant", F.inline("changes"))


def _changes():
    def run(batches):
        import pyarrow as pa

        from quirework.functions.edits import script

        kinds = (pa.string(), *[pa.int32()] * 3)
        names = ("change", "before_first", "before_last", "after_idx")

        def columns(changes):
            parts = zip(*changes, strict=True) if changes else ((),) * 4
            return len(changes), [pa.array(p, k) for p, k in zip(parts, kinds, strict=True)]

        def packed(keys, found):
            sizes = [0]
            for n, _ in found:
                sizes.append(sizes[-1] + n)
            parts = [pa.concat_arrays(p) for p in zip(*[f for _, f in found], strict=True)]
            changes = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(parts, names))
            return pa.RecordBatch.from_arrays([*keys.columns, changes], names=["book_id", "section_idx", "names", "changes"])

        before, done = None, []  # the section at hand, and what was found for it
        for batch in batches:
            keys, start, found, size = batch.select(["book_id", "section_idx", "names"]), 0, [], 0
            for at, (old, new) in enumerate(zip(batch.column("before"), batch.column("after"), strict=True)):
                if before is None or not old.equals(before):
                    before, done, paragraphs = old, [], old.as_py()
                known = next((f for after, f in done if after.equals(new)), None)
                if known is None:
                    known = columns(script(paragraphs, new.as_py()))
                    done.append((new, known))
                found.append(known)
                size += known[0]
                if size > CHANGE_ROWS:
                    yield packed(keys.slice(start, at + 1 - start), found)
                    start, found, size = at + 1, [], 0
            if found:
                yield packed(keys.slice(start), found)

    return run


def change_counts(changes: DataFrame) -> DataFrame:
    """Paragraphs kept, joined, removed and inserted per section and variant."""
    counts = [F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("kept", "joined", "removed", "inserted")]
    return changes.groupBy("book_id", "section_idx", "profile", "variant").agg(*counts)


# --- report -----------------------------------------------------------------------


def run_report(metrics: DataFrame, books: DataFrame, layouts: DataFrame, imposition: DataFrame) -> DataFrame:
    """One row per book, variant and layout.

    ``metrics`` comes from ``with_baseline``; ``books`` is ``(book_id, used_title,
    used_author)``; ``imposition`` holds one request per book with its ``imposition_mode``.
    Baseline figures are shown for other variants only, imposition figures only on request.
    """
    other = F.col("variant") != S.BASELINE_VARIANT
    mode = F.lower(py_strip(N.or_default(F.col("imposition_mode"), "none")))
    also = mode == "also"
    specs = I.signature_spec(imposition)
    joined = (
        metrics.join(books, "book_id")
        .join(layouts.drop("error", "status"), "layout_id")
        .join(specs.withColumnRenamed("pages", "sig_pages"), "book_id", "left")
    )
    padded = I.signature_padding(
        joined.withColumnRenamed("pages", "book_pages").withColumnRenamed("sig_pages", "pages")
        .withColumn("total_pages", F.col("book_pages"))
    )

    def imposed(c):
        return F.when(also & (F.col("status") == "ok"), c)

    return padded.select(
        "book_id", "variant", "layout_id",
        F.col("used_title").alias("title"),
        F.col("used_author").alias("author"),
        B.variant_label(F.col("variant")).alias("variant_label"),
        B.file_stem(F.col("used_author"), F.col("used_title"), F.col("variant"), F.col("spacing"),
                    F.col("margin"), F.col("size")).alias("file_stem"),
        B.spacing_label(F.col("spacing")).alias("spacing_label"),
        B.page_size_label(F.col("size")).alias("page_size_label"),
        B.margin_label(F.col("margin")).alias("margin_label"),
        (F.col("input_bytes") / BYTES_PER_MB).alias("input_mb"),
        (F.col("html_bytes") / BYTES_PER_MB).alias("output_mb"),
        F.col("book_pages").alias("output_pages"),
        F.when(other, F.col("baseline_pages")).alias("baseline_pages"),
        F.when(other, F.col("page_delta")).alias("page_delta"),
        F.when(other, F.col("byte_delta") / BYTES_PER_MB).alias("size_delta_mb"),
        S.lookup(mode, S.IMPOSITION_LABELS).alias("imposition_label"),
        imposed(F.col("pages")).alias("pages_per_signature"),
        imposed(S.lookup(F.col("direction"), S.DIRECTION_LABELS)).alias("direction_label"),
        F.coalesce(F.col("max_end_padding").cast("string"), F.lit("Unlimited")).alias("max_padding_label"),
        imposed(F.col("blank_pages")).alias("blank_pages_added"),
        imposed(F.col("signatures")).alias("total_signatures"),
        imposed(F.col("signatures") * F.col("sheets") * 2).alias("sheet_sides"),
        imposed(F.col("signatures") * F.col("sheets")).alias("physical_sheets"),
        F.when(also, F.col("error")).alias("imposition_error"),
    )
