"""URL filters: listed rules first, then rules mined from labels.

A url is cut into tokens (labels of its host, parts of its path, names in its query). A page is labelled by the listed rule
that speaks on it, and where none does, by `labels`. From labelled pages, FP-growth finds sets of tokens that often
stand together with a bad label; sets with enough support and confidence become rules, unless a smaller one is within
them. Tokens that are a rule by themselves are therefore taken out of the pages before sets are grown. A rule is kept in an inverted index under its rarest token, so a url meets only rules whose rarest token it holds,
and then has to hold the others as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small, table

#: Fixed values. Host, start of the path, verdict.
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_BAD = "label:bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Mining:
    #: Share of the labelled pages that hold a rule's tokens and are bad, and how many those are at least.
    support: float = 0.002
    least_pages: int = 20
    #: Share of bad ones among the labelled pages that hold a rule's tokens.
    confidence: float = 0.6
    #: Tokens of a rule at most; None for any number. A longer set can pass where each set within it failed.
    tokens: int | None = None
    #: Rules, and urls that meet one, up to so many are broadcast; more are joined by a shuffle.
    few_rules: int = 20_000


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def listed(host_: Column, path_: Column, rules=LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # a longer one is tried before
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a url; digits count as one token whatever they are. None for a url without a host."""
    low = F.lower(F.coalesce(url, F.lit("")))
    labels = F.transform(F.filter(F.split(host(low), r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    tail = F.regexp_extract(low, r"://[^/?#]*[^?#]*\?([^#]*)", 1)
    parts = F.transform(F.filter(F.split(path(low), r"[/._-]"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"[0-9]+", "0")))
    names = F.transform(F.filter(F.split(tail, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.regexp_replace(F.regexp_extract(x, r"^[^=]*", 0), r"[0-9]+", "0")))
    mark = F.when(low.contains("#"), F.array(F.lit("fragment:"))).otherwise(F.array().cast("array<string>"))
    return F.when(host(low) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(labels, parts, names, mark)))


def labelled(pages: DataFrame, labels: DataFrame, rules=LISTED) -> DataFrame:
    """items, bad: the tokens of each page whose label is known.

    Where a listed rule speaks, a page is bad if it is blocked. Else its label is the row of labels whose doc_id is its
    page_id; quality 0 or toxic 1 is bad, a row with both null says nothing. Of several rows for one page, one bad one
    makes it bad. Every labelled page is used, repeated rows each.
    """
    marks = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(F.max(F.expr("(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)")).alias("marked"))
    _, verdict = listed(host(F.col("url")), path(F.col("url")), rules)
    own = pages.select("page_id", tokens(F.col("url")).alias("items"), (verdict == "block").alias("listed")).filter(F.size("items") > 0)
    return own.join(marks, F.col("page_id") == F.col("doc_id"), "left").select("items", F.coalesce("listed", "marked").alias("bad")).filter("bad IS NOT NULL")


def mined_rules(pages: DataFrame, labels: DataFrame, mining: Mining = Mining(), rules=LISTED) -> DataFrame:
    """tokens, confidence, support: sets of tokens that tell bad pages, without those that hold a smaller set which does."""
    known = materialise(labelled(pages, labels, rules), "labelled-pages")
    n = known.count()
    if n < mining.least_pages:
        return pages.sparkSession.createDataFrame([], "tokens array<string>, confidence double, support double")
    least = max(mining.support, mining.least_pages / n) * (1 - 1e-12)  # so that no rounding asks for one page more
    share = F.avg(F.col("bad").cast("double")).alias("confidence")
    single = known.select(F.explode("items").alias("token"), "bad").groupBy("token").agg(share, (F.sum(F.col("bad").cast("double")) / n).alias("support"))
    single = materialise(single.filter((F.col("confidence") >= mining.confidence) & (F.col("support") >= least)), "url-tokens")
    taken = single.agg(F.collect_list("token").alias("taken"))  # one row; each token has its share of the pages, so they are few
    rest = known.crossJoin(F.broadcast(taken)).select(F.array_except("items", "taken").alias("items"), "bad")
    baskets = rest.select(F.when(F.col("bad"), F.array_append("items", F.lit(_BAD))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=mining.confidence).fit(baskets)
    found = model.associationRules.filter(F.element_at("consequent", 1) == _BAD).filter(F.size("antecedent") > 0)
    if mining.tokens is not None:
        found = found.filter(F.size("antecedent") <= mining.tokens)
    sets = found.select(F.sort_array("antecedent").alias("tokens"), "confidence", "support")
    every = materialise(sets.union(single.select(F.array("token"), "confidence", "support")), "mined-rules")
    # A smaller rule meets a larger one that holds it under its own token that the fewest rules have.
    each = every.select("tokens", F.explode("tokens").alias("token"))
    rare = each.join(each.groupBy("token").agg(F.count("*").alias("n")), "token").groupBy("tokens").agg(F.min_by("token", F.struct("n", "token")).alias("token")).withColumnRenamed("tokens", "part")
    met = each.join(rare, "token").filter(F.size("part") < F.size("tokens"))
    covered = met.filter(F.size(F.array_intersect("part", "tokens")) == F.size("part")).select("tokens").distinct()
    return every.join(covered, "tokens", "left_anti")


def judged(pages: DataFrame, labels: DataFrame, rules=LISTED, mining: Mining = Mining()) -> DataFrame:
    """page_id, host, path, rule, verdict, mined: one row for each row of pages (page_id, url; others are not looked at).

    rule and verdict are those of the longest listed rule that fits. Where none does, rule is null, and the verdict is
    block if the url holds all tokens of a mined rule, else allow; mined has the tokens of such a rule (the most confident one,
    of equal ones the first in order of tokens). A null url, or one without ://, has an empty host and path and no
    tokens, and is allowed. Where fewer than least_pages pages are labelled nothing is mined. Repeated rows are all returned.
    """
    found = materialise(mined_rules(pages, labels, mining, rules), "url-rules")
    n = found.count()
    own = pages.select("page_id", "url")
    urls = own.select("url").distinct().select("url", tokens(F.col("url")).alias("held"))
    if n:
        counts = urls.select(F.explode("held").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        spread = found.select("tokens", "confidence", F.explode("tokens").alias("token")).join(counts, "token", "left").select("tokens", "confidence", "token", F.coalesce("n", F.lit(0)).alias("n"))
        index = spread.groupBy("tokens", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
        index = F.broadcast(index) if n <= mining.few_rules else index
        met = urls.select("url", "held", F.explode("held").alias("token")).join(index, "token").filter(F.size(F.array_intersect("tokens", "held")) == F.size("tokens"))
        best = met.groupBy(F.col("url").alias("of_url")).agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.array_join("tokens", " ").alias("t"))).alias("best")).select("of_url", F.col("best.t").alias("mined"))
        best = materialise(best, "mined-verdicts")
        # A url without tokens meets nothing, so such rows are dealt out by their number.
        key = F.when(host(F.col("url")) == "", F.col("page_id").cast("string")).otherwise(F.col("url"))
        own = own.join(small(best, best.count(), mining.few_rules), key == F.col("of_url"), "left").drop("of_url")
    else:
        own = own.withColumn("mined", F.lit(None).cast("string"))
    named = own.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "mined")
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return named.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.when(verdict.isNull(), F.col("mined")).alias("mined"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_urls."""
    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
