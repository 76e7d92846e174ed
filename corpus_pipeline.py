"""Five stages from raw documents to packed sequences.

Each stage takes what its predecessor kept; between stages the documents are written as
Parquet to the shared folder and read again.

Defined results: null and empty texts fail the word count of the first stage; rows with equal ids
are documents of their own until one of each near-duplicate group is kept; an empty table gives an
empty result; very long texts pass all stages whole; further columns stay until documents become
pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirework.llm import lines, mixing, packing, quality, simhash
from quirework.llm.common import staged, table
from quirework.llm.queries import tokenizer

#: A shingle stage takes five words and a similarity of 0.8 unless its contract says
#: otherwise; SimHash has one (four words, 4 bits), which holds here as well.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy accepts."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; ``n_chars``, where it is
    there, is brought up to date."""
    done = lines.dedup(docs)
    text = F.when(F.col("_lines.n_dropped") > 0, F.col("_lines.kept")).otherwise(F.col("_d.text"))
    new = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return done.select(*[new.get(c, F.col(f"_d.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the schedule; those of a source that its target weight asks
    for more often than it has documents come again, as another epoch."""
    mixed = mixing.mix(docs)
    return mixed.repartitionByRange("_slot").sortWithinPartitions("_slot", "_k").select("_d.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents at their places in sequences."""
    return packing.pack(docs, **tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Token ids and fingerprint components are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
