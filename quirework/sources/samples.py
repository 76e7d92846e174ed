"""Labelled sample files: blocks of text under ``=== name ===`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expr import islands, let
from ..functions.text import py_strip

_LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def read_sample_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text")
    )


def _is_header(line):
    s = py_strip(line)
    return s.startswith("===") & s.endswith("===")


def labelled_samples(files: DataFrame) -> DataFrame:
    """``(path, text)`` -> ``(path, sample_idx, name, body, error)``.

    Text before the first header is ignored; a file without header gives one reject row.
    """

    def blocks(lines):
        cut = F.filter(
            islands(lines, lambda line, i: (i == 0) | _is_header(line)),
            lambda g: _is_header(F.get(g, F.lit(0))),
        )
        return F.transform(
            cut,
            lambda g: F.struct(
                py_strip(F.trim(py_strip(F.get(g, F.lit(0))), F.lit("="))).alias("name"),
                py_strip(F.array_join(F.slice(g, 2, F.size(g)), "\n")).alias("body"),
            ),
        )

    found = files.withColumn("_b", let(F.split("text", _LINE_END), blocks))
    return found.select("path", F.posexplode_outer("_b").alias("sample_idx", "s")).select(
        "path", "sample_idx", "s.name", "s.body",
        F.when(F.col("sample_idx").isNull(), "no_samples").alias("error"),
    )
