"""Documents to token ids in five stages; each works on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. run() applies them to the documents of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thornweave.llm import decontaminate, mixing, packed_ids, quality, similar
from thornweave.llm.common import fresh_path, materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that failed; n_chars is counted again where the text changed.

    Rows are judged by themselves, so repeated rows all stay or all go. A null or empty text has too few words and goes. Other columns
    are passed through, whatever their names. An empty table stays empty.
    """
    names = docs.columns
    judged = quality.passing(docs.select(F.struct("*").alias("row"), "text"))
    text = F.col("judged.cleaned")
    made = {"text": text, "n_chars": F.when(F.col("row.text").eqNullSafe(text), F.col("row.n_chars")).otherwise(F.char_length(text).cast("long")) if "n_chars" in names else None}
    return judged.select(*[(F.col("row")[c] if made.get(c) is None else made[c]).alias(c) for c in names])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: five-word shingles, similarity 0.8 or more.

    The smallest doc_id of a group stays (null comes last), one row of it; null and empty texts are copies of one another. Other
    columns are passed through. An empty table stays empty.
    """
    return similar.one_of_each(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    A null or empty text holds none and stays, repeated rows all stay or all go, other columns are passed through. An empty table stays
    empty, and without a benchmark all rows stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as drawn, in an order that is shuffled over all of them.

    Repeated rows are drawn alike, a row with a null doc_id by its text; a null source is a source of its own. Other columns
    are passed through, whatever their names. An empty table stays empty.
    """
    names = docs.columns
    apart = {c: next(n for n in (f"{c}{'_' * k}" for k in range(1, len(names) + 2)) if n not in names) for c in ("copy", "mix_key", "rate") if c in names}
    mixed = mixing.replicated(docs.withColumnsRenamed(apart))
    return mixed.select(*[F.col(apart.get(c, c)).alias(c) for c in names])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary files; a row for each row of docs as read back from them: doc_id, start, n_tokens, ids_crc32.

    Documents lie as Spark reads the mix: shuffled, but in the order of its splits, not by the mix's key. A null text is an empty
    one and has the end id alone; an empty table gives no rows.
    """
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packed_ids.token_output(docs, fresh_path(spark, "token-ids"), path, 2, by_id=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixed_sources", mixed_sources),
    ("token_ids", token_ids),
]

#: Fingerprints and a tokenizer's merges are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
