"""Token counts through a digest cache.

The count of a text depends on the text as the tokenizer sees it and on the tokenizer's version, so counts are stored
under the digests of both. A run joins the digests of its documents to the stored counts, encodes each distinct
content that has none once, and appends what it encoded to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, in_arrow, table
from .tokenizer import encoder, in_groups

CACHE = "content binary, tokenizer binary, n_tokens long"


def tokenizer_digest(path: str) -> bytes:
    """Digest of the vocabulary file: a new version of a tokenizer never meets counts of an old one."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


def normalised(text: Column) -> Column:
    """The content whose count is stored. Only what no tokenizer can tell apart is made equal: null and empty."""
    return F.coalesce(text, F.lit(""))


def _count(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts, counts = batch.column("text").to_pylist(), []
            for a, b in in_groups(texts):
                counts += [len(x) // 4 for x in own.encode(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return count


def read_cache(spark: SparkSession, cache: str, version: bytes) -> DataFrame:
    """Stored counts of one tokenizer version, one row per content; a cache that isn't there yet is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    stored = spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)
    return stored.filter(F.col("tokenizer") == F.lit(version)).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of docs (columns doc_id, text; others are not looked at).

    cache: a folder, shared by all machines, that keeps counts from run to run. Contents that it lacks are brought
    together by digest, so that a group of copies is encoded once; a copy beside the first is dropped before the
    shuffle where it lies in the same task. Null texts count as empty ones (0 bytes, 0 tokens); a null doc_id stays
    null; repeated rows are all returned; an empty table gives an empty result and leaves the cache as it is.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    texts = docs.select("doc_id", normalised(F.col("text")).alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))
    stored = read_cache(spark, cache, version)
    misses = texts.select("content", "text").join(stored, "content", "left_anti").dropDuplicates(["content"])
    counted = misses.transform(in_arrow(_count(tokenizer_path), "content binary, n_tokens long"))
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    return (
        texts.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(read_cache(spark, cache, version), "content")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_token_counts. The cache is a fresh folder, so that what this query costs never depends on an earlier run."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "token-counts"))
