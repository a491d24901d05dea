"""Mixing sources to target weights by Poisson replication.

A source that is to make up a share w of T documents and has n of them repeats each T * w / n times on average. How often
one document is repeated is drawn from the Poisson distribution of that mean: a uniform number hashed from the seed and
the document's id is looked up in the distribution, so a run can be repeated and needs no state. Copies are then
ordered by another hash, over all machines. Column expressions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: A mean above this is drawn as a sum of equal parts, each from a distribution of its own: no table of the
#: distribution is long, and none of its entries underflows.
PART = 64.0
#: Sources up to so many have their rates broadcast (some kilobytes each); more are joined by a shuffle.
FEW_SOURCES = 2_000


def uniform(*parts: Column) -> Column:
    """52 bits of a digest as a number from 0 up to 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until, for a mean up to PART, more entries would change nothing in double precision."""
    most = F.lit(int(PART + 12 * PART**0.5 + 40))
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k.cast("double")
        return F.struct(p.alias("p"), F.array_append(state["sums"], F.element_at(state["sums"], -1) + p).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), most), start, add)["sums"]


def rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None, power: float) -> DataFrame:
    """source, rate, parts, sums: one row for each source. Counted from partial counts, so a hot source costs no more."""
    counted = docs.groupBy("source").agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        share = counted.withColumn("w", F.pow("n", F.lit(float(power))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        share = counted.join(F.broadcast(given).withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = share.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n")).first()
    all_w, target = float(sums.all_w or 0.0), float(sums.all_n or 0.0) if total is None else float(total)
    rate = F.lit(target) * (F.col("w") / F.lit(all_w)) / F.col("n") if all_w else F.lit(0.0)
    parted = share.select("source", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1.0), F.ceil(F.col("rate") / PART).cast("double")).cast("int"))
    return parted.withColumn("sums", poisson_table(F.col("rate") / F.col("parts")))


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, power: float = 0.5, seed: int = 7) -> DataFrame:
    """docs' rows, each as often as drawn, with copy (1, 2, ...), mix_key and rate, ordered by mix_key over the whole result.

    weights: target share of each source, in any unit; sources without one get none. Without weights a source's share is
    its number of documents to `power`. total: documents that the result is to have on average, by default as
    many as docs. A null source is a source of its own; a row with a null doc_id is drawn by its text; null or empty
    texts are rows like any other. Repeated rows are drawn alike, and so are rows that share a doc_id; the order among rows
    with the same mix_key is not defined. Columns of docs named copy, mix_key or rate are
    replaced. An empty table, and weights that fit no source, give an empty result.
    """
    own = [c for c in docs.columns if c not in ("copy", "mix_key", "rate")]
    table_ = rates(docs.select("source"), weights, total, power)
    table_ = materialise(table_, "rates")  # a row for each source, looked at more than once
    found = table_.count()
    named = table_.withColumnRenamed("source", "of_source")
    if found <= FEW_SOURCES:
        named = F.broadcast(named)
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("row.text", F.lit(""))))
    rows = docs.select(F.struct(*own).alias("row")).join(named, F.col("row.source").eqNullSafe(F.col("of_source")))

    def draw(part: Column) -> Column:  # the uniform number is bound first, so it isn't computed for each entry
        return F.transform(F.array(uniform(F.lit(str(seed)), F.lit("draw"), part.cast("string"), key)), lambda u: F.size(F.filter("sums", lambda c: c <= u)))[0]

    times = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda a, part: a + draw(part))
    counted = rows.select("row", "rate", times.alias("times")).filter("times > 0")
    copies = counted.select("row", "rate", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("place"), F.col("copy").cast("string"), key))
    return copies.select(*[F.col("row")[c].alias(c) for c in own], "copy", F.substring(mixed, 1, 16).alias("mix_key"), "rate").orderBy("mix_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_mixing: sources by the square root of their size, as many documents as there are."""
    return replicated(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")).drop("rate")


_PARTS = int(PART + 12 * PART**0.5 + 40)
ORACLE = f"""
WITH RECURSIVE n AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM n) * (pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM n)) / n AS rate FROM n),
parts AS (SELECT source, rate, greatest(1, ceil(rate / {PART}))::INT AS parts FROM rates),
cdf AS (
  SELECT source, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS c FROM parts
  UNION ALL
  SELECT cdf.source, k + 1, p * (rate / parts) / (k + 1)::DOUBLE, c + p * (rate / parts) / (k + 1)::DOUBLE
  FROM cdf JOIN parts ON cdf.source IS NOT DISTINCT FROM parts.source WHERE k < {_PARTS}
),
keyed AS (SELECT d.*, coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, '')) AS key, parts FROM documents d JOIN parts ON d.source IS NOT DISTINCT FROM parts.source),
draws AS (SELECT *, unnest(range(1, parts + 1)) AS part FROM keyed),
uniforms AS (SELECT *, ('0x' || substr(md5('7:draw:' || part || ':' || key), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM draws),
times AS (
  SELECT doc_id, text, lang, u.source, n_chars, key, sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND c <= u.u))::INT AS times
  FROM uniforms u GROUP BY ALL
),
copies AS (SELECT *, unnest(range(1, times + 1))::INT AS copy FROM times WHERE times > 0)
SELECT doc_id, text, lang, source, n_chars, copy, substr(md5('7:place:' || copy || ':' || key), 1, 16) AS mix_key FROM copies
"""
