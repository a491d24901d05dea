"""Benchmark passages in documents, by SimHash over windows of each item's size.

1. Shingles that a document shares with an item are found by hash. A window of the item's size can only be similar
   enough if so many of its shingles are among the item's, in whatever order; all windows that hold as many are taken, and no
   other can pass. The benchmark is a given set of queries: where it has more shingles than are broadcast at once, it goes over
   the documents in parts, so the documents' shingles are never shuffled.
2. A window's SimHash counts each shingle as often as it stands there. The 64 bits are cut into blocks; of two fingerprints
   within the radius, one block differs by radius / blocks bits at most. Items are indexed under all block values so
   near to theirs, so an equality join on the block finds every item of the window's size within the radius.
3. For what is found, the exact similarity is computed: shingles weighted by how often they occur, shared weight over
   joint weight.

At a similarity of 0.8, two fingerprints differ by 10 bits on average with a standard deviation of 3; the radius of 23 is over
four deviations above. Column expressions only: shingling runs inside one generated stage and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small, table, words


@dataclass(frozen=True)
class Matching:
    shingle: int = 5
    similarity: float = 0.8
    radius: int = 23
    #: Blocks of 64 / blocks bits each.
    blocks: int = 8
    #: Rows up to which tables made from the items, or keys of documents with shared shingles, are broadcast (some 50 bytes each).
    broadcast_rows: int = 500_000


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _hash(of: Column, first: Column, n: int) -> Column:
    return F.xxhash64(*[F.element_at(of, (first + k).cast("int")) for k in range(n)])


def _shingles(of: Column, n: Column, shingle: int, make) -> Column:
    """make(first word, words) for each shingle of n words; one of all words where there are fewer."""
    many = F.transform(F.sequence(F.lit(1), n - shingle + 1), lambda i: make(i, F.lit(shingle)))
    return F.when(n >= shingle, many).when(n > 0, F.array(make(F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def texts_of(of: Column, shingle: int) -> Column:
    """The shingles of a list of words as texts, repeats included."""
    return _shingles(of, F.size(of), shingle, lambda i, n: F.array_join(F.slice(of, i, n), " "))


def simhash(shingles: Column) -> Column:
    """64 bits, each set if it is set in over half of the shingles' hashes."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))

    def bits(hs: Column) -> Column:
        def add(acc: Column, bit: Column) -> Column:
            ones = F.size(F.filter(hs, lambda h: F.call_function("shiftrightunsigned", h, bit).bitwiseAND(F.lit(1)) == 1))
            return F.when(ones * 2 > F.size(hs), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), add)

    return _let(hashes, bits)


def weighted_similarity(a: Column, b: Column) -> Column:
    """Shared weight over joint weight of two lists of shingles, each shingle weighing as often as it occurs."""

    def count(of: Column, x: Column) -> Column:
        return F.size(F.filter(of, lambda y: y == x))

    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return _let(shared, lambda s: s / (F.size(a) + F.size(b) - s))


def _block(fp: Column, block: Column, bits: int) -> Column:
    return F.call_function("shiftrightunsigned", fp, block * bits).bitwiseAND(F.lit((1 << bits) - 1))


def _starts(rule: Matching) -> Column:
    """First words (from 1) of the windows of n words that hold enough shingles of an item.

    at: the places of the document's shingles that the item has too, in order; size: its words. If a window holds as many as are
    needed, the first of them and the one that completes their number lie within it, so for each such pair of
    places, all windows around both are taken.
    """
    a = F.greatest(F.lit(1), F.least("n", "size") - (rule.shingle - 1))
    b = F.greatest(F.lit(1), F.col("n") - (rule.shingle - 1))
    needed = F.ceil((a + b) * F.lit(rule.similarity / (1 + rule.similarity)) - 1e-9).cast("int")
    last = F.greatest(F.lit(1), F.col("size") - F.col("n") + 1)

    def around(j: Column) -> Column:
        low = F.greatest(F.lit(1), F.get(F.col("at"), j + needed - 1) - (a - 1))
        high = F.least(F.get(F.col("at"), j), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    first = F.transform(F.sequence(F.lit(0), F.size("at") - needed), around)
    return F.when(F.size("at") >= needed, F.array_distinct(F.flatten(first))).otherwise(F.array().cast("array<int>"))


def matches(docs: DataFrame, items: DataFrame, rule: Matching = Matching()) -> DataFrame:
    """doc_id, text_hash, item_id, start, distance, similarity: each item that a document holds, with its most similar window.

    docs: doc_id, text; items: item_id, text; other columns are not looked at. Words are compared in lower case. start
    is the window's first word, from 0; a window that would reach over the ends of the document lies at its end, and is
    the whole document where that is shorter. Null and empty texts hold nothing; null and empty items are in nothing.
    Items of fewer words than a shingle are looked for as they are. Rows that share doc_id and text are one document
    (text_hash tells apart rows that share the doc_id alone); rows of items that share item_id and text are one item.
    An empty table on either side gives an empty result.
    """
    k, bits = rule.shingle, 64 // rule.blocks
    item = items.select("item_id", words(F.lower(F.coalesce("text", F.lit("")))).alias("w")).filter(F.size("w") > 0).distinct()
    item = item.withColumn("n", F.size("w")).withColumn("shingles", texts_of(F.col("w"), k)).withColumn("fp", simhash(F.col("shingles")))
    item = materialise(item, "benchmark")  # small, and used again and again
    short = sorted(r.n for r in item.filter(F.col("n") < k).select("n").distinct().collect())  # fewer lengths than a shingle has words
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    lowered = words(F.lower(F.coalesce("text", F.lit(""))))
    own = docs.select("doc_id", text_hash, lowered.alias("w"))

    def hits(n: int) -> list[DataFrame]:
        """Places of documents' shingles of n words that an item has too; one table for each part of the items."""
        of = item.filter(F.col("n") >= k) if n == k else item.filter(F.col("n") == n)
        at = of.select("item_id", "w", "n", F.explode(F.sequence(F.lit(1), F.col("n") - n + 1)).alias("o"))
        keys = materialise(at.select(_hash(F.col("w"), F.col("o"), n).alias("key"), "item_id", "n").distinct(), "benchmark-keys")
        parts = -(-keys.count() // max(1, rule.broadcast_rows))
        spots = own.select("doc_id", "text_hash", F.size("w").alias("size"), "w", F.explode(F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1))).alias("i"))
        spots = spots.select("doc_id", "text_hash", "size", "i", _hash(F.col("w"), F.col("i"), n).alias("key"))
        return [spots.join(F.broadcast(keys.filter(F.pmod("key", F.lit(parts)) == p)), "key").drop("key") for p in range(parts)]

    each = [h for n in [k, *short] for h in hits(n)]
    if not each:
        each = [own.select("doc_id", "text_hash", F.lit(0).alias("size"), F.lit(0).alias("i")).limit(0).crossJoin(item.select("item_id", "n").limit(0))]  # no item: nothing
    met = each[0]
    for h in each[1:]:
        met = met.union(h.select(*met.columns))
    shared = met.groupBy("doc_id", "text_hash", "item_id", "n").agg(F.max("size").alias("size"), F.array_sort(F.collect_set("i")).alias("at"))
    starts = shared.select("doc_id", "text_hash", "n", _starts(rule).alias("starts")).filter(F.size("starts") > 0)
    starts = materialise(starts.groupBy("doc_id", "text_hash", "n").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")), "starts")
    named = small(starts.withColumnsRenamed({"doc_id": "of_id", "text_hash": "of_hash"}), starts.count(), rule.broadcast_rows)
    held = docs.select("doc_id", text_hash, "text").join(named, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")))
    windows = held.select("doc_id", "text_hash", "n", "starts", lowered.alias("w")).select("doc_id", "text_hash", "n", "w", F.explode("starts").alias("i"))
    windows = windows.select("doc_id", "text_hash", "n", (F.col("i") - 1).alias("start"), F.slice("w", F.col("i"), F.col("n")).alias("window"))
    windows = materialise(windows, "windows")  # else the join's planning would have a fingerprint computed twice
    prints = windows.withColumn("found", texts_of(F.col("window"), k)).drop("window").withColumn("print", simhash(F.col("found")))
    prints = materialise(prints, "window-prints")

    nearby = [m for m in range(1 << bits) if m.bit_count() <= rule.radius // rule.blocks]
    index = item.select("item_id", "n", "shingles", "fp", F.explode(F.sequence(F.lit(0), F.lit(rule.blocks - 1))).alias("block"))
    index = index.select("item_id", "n", "shingles", "fp", "block", F.explode(F.array(*[F.lit(m).cast("long") for m in nearby])).alias("off"))
    index = index.select("item_id", "n", "fp", "shingles", "block", _block(F.col("fp"), F.col("block"), bits).bitwiseXOR(F.col("off")).alias("value"))
    light = index.select("item_id", "n", "fp", "block", "value")
    light = small(light, light.count(), rule.broadcast_rows)
    looked = prints.select("*", F.explode(F.sequence(F.lit(0), F.lit(rule.blocks - 1))).alias("block"))
    looked = looked.withColumn("value", _block(F.col("print"), F.col("block"), bits))
    differ = F.col("print").bitwiseXOR(F.col("fp"))
    met_before = F.exists(
        F.array(*[F.lit(b) for b in range(rule.blocks)]),
        lambda b: (b < F.col("block")) & (F.bit_count(_block(F.col("differ"), b, bits)) <= rule.radius // rule.blocks),
    )
    pairs = looked.join(light, ["n", "block", "value"]).withColumn("differ", differ).filter(F.bit_count("differ") <= rule.radius).filter(~met_before)
    texts = item.select("item_id", "n", "fp", "shingles")
    texts = small(texts, texts.count(), rule.broadcast_rows // 100)
    verified = pairs.join(texts.withColumnRenamed("item_id", "own_id"), ["n", "fp"]).filter(F.col("own_id").eqNullSafe(F.col("item_id")))
    scored = verified.select("doc_id", "text_hash", "item_id", "start", F.bit_count("differ").cast("int").alias("distance"), weighted_similarity(F.col("found"), F.col("shingles")).alias("similarity"))
    best = scored.filter(F.col("similarity") >= rule.similarity).groupBy("doc_id", "text_hash", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "distance")).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", F.col("best.start").alias("start"), F.col("best.distance").alias("distance"), (-F.col("best.s")).alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, rule: Matching = Matching()) -> DataFrame:
    """The rows of docs that hold no item; all columns as they are."""
    own = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    held = matches(docs, items, rule).select(F.col("doc_id").alias("held_id"), F.col("text_hash").alias("held_hash")).distinct()
    return own.join(held, F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("text_hash") == F.col("held_hash")), "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_decontaminate."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.round("similarity", 6).alias("similarity"))
