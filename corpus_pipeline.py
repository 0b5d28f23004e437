"""From raw documents to packed training sequences: toxicity, near-duplicates, decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakespark.llm.common import stored, table
from lakespark.llm.decontaminate import remove_contaminated
from lakespark.llm.packing import pack_documents
from lakespark.llm.secret_scan import redact
from lakespark.llm.shingles import one_of_each_similar
from lakespark.llm.toxicity import remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score 0.5 or more go; null and empty texts stay."""
    return remove_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of a Jaccard similarity of 16 / 20 over five-word shingles join, the row of the smallest id stays: found by
    SimHash fingerprints within three bits through vantage-point trees, and completed by prefix filtering."""
    return one_of_each_similar(docs, words=5, least=16, within=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other values, go."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and ``n_chars`` follows; no document goes."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence of at most 1,024 tokens."""
    return pack_documents(docs, "byte_bpe_50k.json", end=2, capacity=1024)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: SQL can't express the learnt classifier or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over all documents; what each one returns is stored before the next."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
