"""Token counts with a digest cache.

The key of a count is the SHA-256 of the text's UTF-8 bytes (null: of the empty text) together with the
SHA-256 of the tokenizer file.  Counts that the cache holds are joined; each distinct missing text is
encoded once, whole, and its count appended to the cache, a Parquet table that later runs read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, renamed, ship, stored, tidy, without
from .tokens import encoder, vocabulary_path

CACHE = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(tokenizer: str) -> str:
    """SHA-256 of the tokenizer's file."""
    with open(vocabulary_path(tokenizer), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def cached_counts(spark, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for a tokenizer version, once each; empty if there is no cache yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(CACHE).parquet(cache) if known else spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for b in batches:
            texts, digests = b.column("text").to_pylist(), b.column("digest")
            for first, last, _, counts in own.encode_in_blocks(texts):
                yield pa.RecordBatch.from_arrays([digests.slice(first, last - first), pa.array(counts, pa.int64())], ["digest", "n_tokens"])
        tidy()

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than ``limit``) of every row of ``docs``.

    Null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids give a row each; an empty
    table gives none and adds nothing to the cache.  A text's cost is in proportion to its length.  Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    version = tokenizer_version(tokenizer)
    texts = renamed(docs, doc_id=key, text=F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = stored(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    # counts are stored before they are joined: then only the join needs rows of a digest together, and adaptive
    # execution can split one that a large part of all rows share
    known = stored(cached_counts(spark, cache, version), "known-counts")
    # one row stands for each distinct missing text; only that row's text is encoded.  The keys of the rows that are encoded, or
    # of the others, whichever are fewer, go to the texts, so that texts stay where they are as long as these are few
    # rows of a digest are put together before the cache is asked, and stored, so that a digest that many rows share can be split
    # when they are joined
    missing = keys.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first"))
    missing = stored(missing.join(known, "digest", "left_anti"), "missing")
    told = keys.join(missing, "digest", "left")
    is_first = F.col("first").isNotNull() & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    told = stored(told.select("digest", "doc_id", is_first.alias("is_first")).distinct(), "first-rows")
    chosen, others = (told.where(c).select("digest", "doc_id") for c in ("is_first", "not is_first"))
    few = chosen.count() <= others.count()
    counts = (among(texts, chosen, ["digest", "doc_id"]) if few else without(texts, others, ["digest", "doc_id"])).select("digest", "text").mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # rows can be repeated with their ids
    counts.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    found = keys.join(stored(cached_counts(spark, cache, version), "counts"), "digest")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
