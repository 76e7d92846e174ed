"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructType

#: The white space of all word and line rules: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACES.encode()
#: Texts in one batch for a Python worker.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bounded_batches(df: DataFrame, rows: int = BATCH_ROWS, size: int | None = None) -> None:
    """Let at most ``rows`` rows (and about ``size`` bytes) go to a Python worker at once: texts
    are long, and a worker holds a batch several times over. A smaller setting of the session
    stays."""
    conf = df.sparkSession.conf
    for name, most in (("Records", rows), ("Bytes", size)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        if most is not None and not 0 < int(conf.get(key).removesuffix("b")) <= most:
            conf.set(key, str(most))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later passes do not repeat its
    work, and a lost executor takes none of it away."""
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def longs(*names: str) -> StructType:
    schema = StructType()
    for name in names:
        schema.add(name, LongType())
    return schema


def code_points(x: Column) -> Column:
    return F.coalesce(F.length(x), F.lit(0)).cast("long")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Cut a stream of batches, sorted by ``keys`` (integers without nulls), into tables
    that hold whole groups only. The rows of an unfinished group wait for the next batch."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        if rest:
            before = rest[-1]
            changed[0] = any(
                before.column(k)[before.num_rows - 1].as_py() != batch.column(k)[0].as_py()
                for k in keys
            )
        starts = np.flatnonzero(changed)
        if not len(starts):
            rest.append(batch)
            continue
        cut = int(starts[-1])
        head = [*rest, batch.slice(0, cut)] if cut else rest
        if head:
            yield pa.Table.from_batches(head).combine_chunks()
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def meetings(rows: DataFrame, groups: DataFrame, keys: Sequence[str], by: str, block: int) -> DataFrame:
    """Deal the rows of each group to tasks so that every two rows meet in one of them.

    ``groups`` has the groups to compare and their size ``n``. A group of at most ``block``
    rows meets at once (``low`` = ``high`` = 0); a larger one is cut into blocks by a hash of
    ``by``, and every two blocks meet. ``side`` is the block of a row. Where two different
    blocks meet, only pairs across them are new.
    """
    blocks = groups.select(*keys, F.ceil(F.col("n") / block).cast("int").alias("_blocks"))
    cut = rows.join(blocks, list(keys)).withColumn(
        "side", F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int"))
    met = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return met.withColumns({"low": F.least("side", "_other"), "high": F.greatest("side", "_other")}).drop(
        "_other", "_blocks")
