"""Writers for documents, paragraphs and variant outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .book_files import write_book_files

__all__ = ["write_book_files", "write_by_variant", "write_document_files", "write_documents", "write_styled_paragraphs"]


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents as a parquet table."""
    docs.write.mode("errorifexists").parquet(path)


def write_document_files(docs: DataFrame, path: str, slug: str = "book_slug", book: str = "book_id",
                         order: str = "part_no", content: str = "part") -> None:
    """One folder of text files per slug and book, so books of one slug stay apart.

    A book in several parts is cut by range, so its files, read by name, keep its order
    and no task gets all of a large book.
    """
    (
        docs.repartitionByRange(slug, book, order)
        .sortWithinPartitions(slug, book, order)
        .select(slug, book, content)
        .write.mode("errorifexists")
        .option("lineSep", "\n")
        .partitionBy(slug, book)
        .text(path)
    )


def write_styled_paragraphs(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").parquet(path)


def write_by_variant(df: DataFrame, path: str) -> None:
    """Outputs in one folder per variant."""
    df.write.mode("errorifexists").partitionBy("variant").parquet(path)
