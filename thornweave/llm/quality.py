"""Quality rules, line first: lines that fail go, then documents that lost too much or that fail as a whole.

Everything is a column expression over one row: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words

INK = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Fixed values. Marks that end a sentence.
ENDS = r"[.!?…。！？]"
#: Fixed values. What stands between the entries of a navigation line.
SEPARATORS = r"[|›»•·]|\x20>\x20"
OTHER_SEPARATORS = r"[›»•·]"
#: Fixed values. Phrases of page furniture in English, German, French and Spanish, looked for in lower case.
BOILERPLATE = (
    "javascript is disabled",
    "enable javascript",
    "enable cookies",
    "we use cookies",
    "uses cookies",
    "cookie policy",
    "accept all cookies",
    "terms of use",
    "terms of service",
    "privacy policy",
    "all rights reserved",
    "lorem ipsum",
    "skip to content",
    "click here",
    "sign in",
    "log in",
    "subscribe to our newsletter",
    "share this",
    "read more",
    "alle rechte vorbehalten",
    "cookies akzeptieren",
    "datenschutzerklärung",
    "newsletter abonnieren",
    "nutzungsbedingungen",
    "weiterlesen",
    "wir verwenden cookies",
    "zum inhalt springen",
    "accepter les cookies",
    "aller au contenu",
    "conditions d'utilisation",
    "lire la suite",
    "nous utilisons des cookies",
    "politique de confidentialité",
    "tous droits réservés",
    "aceptar cookies",
    "condiciones de uso",
    "iniciar sesión",
    "leer más",
    "política de privacidad",
    "saltar al contenido",
    "todos los derechos reservados",
    "utilizamos cookies",
)
_PHRASES = r"\b(?:" + "|".join(BOILERPLATE) + ")"


@dataclass(frozen=True)
class Rules:
    #: Separators that make a line navigation, and the share of its words that they are at least, in hundredths.
    separators: int = 3
    separator_share: int = 20
    #: A line with a boilerplate phrase fails if it has at most so many words; a longer one is prose about it.
    boilerplate_words: int = 30
    #: Characters of [#*$%&|<>] in a line that are too many, in hundredths of the characters in its words.
    symbol_share: int = 10
    #: A line all in capitals fails from so many letters on.
    upper_letters: int = 20
    #: A line without an end of a sentence fails if it has more words.
    unended_words: int = 12
    #: A document goes if it keeps fewer than so many hundredths of the characters in its words.
    kept_share: int = 50


def _let(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's argument is not computed again for each element."""
    return F.transform(F.array(value), use)[0]


def repeated_words(text_words: Column, length: int = 8) -> Column:
    """How many words lie in a window of so many words that is found twice or more among them, the first included.

    Windows are compared by two hashes of 64 bits each. A text whose windows all differ is told apart by a set of
    hashes; only for others the windows are sorted, and each one's place counts the words up to the next such place.
    """
    n = F.size(text_words)
    starts = F.sequence(F.lit(1), n - length + 1)

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.element_at(text_words, i + k) for k in range(length)])

    def checked(i: Column) -> Column:
        return F.struct(window(i).alias("h"), F.hash(*[F.element_at(text_words, i + k) for k in range(length)]).alias("g"), i.alias("i"))

    def places(ordered: Column) -> Column:
        size = F.size(ordered)

        def equal(a: Column, b: Column) -> Column:
            return (a["h"] == b["h"]) & (a["g"] == b["g"])

        def again(x: Column, k: Column) -> Column:
            before = F.when(k > 0, equal(x, F.get(ordered, k - 1))).otherwise(False)
            after = F.when(k + 1 < size, equal(x, F.get(ordered, k + 1))).otherwise(False)
            return before | after

        return F.array_sort(F.transform(F.filter(ordered, again), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda i, k: F.least(F.lit(length), F.coalesce(F.get(at, k + 1) - i, F.lit(length))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        exact = _let(F.array_sort(F.transform(starts, checked)), lambda o: _let(places(o), covered))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(exact)

    return F.when(n < length + 1, F.lit(0).cast("long")).otherwise(_let(F.transform(starts, window), count))


def _length(text: Column) -> Column:
    return F.char_length(text).cast("long")


def _inked(text: Column) -> Column:
    """Characters other than white space."""
    return _length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))


def _among(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(kind)).cast("long")


def _capitals(line: Column, rules: Rules) -> Column:
    """Whether a line is all in capitals. Told by its upper-case form, which is quicker than counting letters."""
    return (line == F.upper(line)) & (line != F.lower(line)) & (F.regexp_count(line, F.lit(r"\p{L}")) >= rules.upper_letters)


def _marks(line: Column, rules: Rules) -> Column:
    """Whether a line is navigation or mostly symbols."""
    separators = _among(line, SEPARATORS)
    navigation = (separators >= rules.separators) & (separators * 100 >= F.size(words(line)) * rules.separator_share)
    return navigation | (_among(line, SYMBOLS) * 100 > _inked(line) * rules.symbol_share)


def _furniture(line: Column, rules: Rules) -> Column:
    return F.lower(line).rlike(_PHRASES) & (F.size(words(line)) <= rules.boilerplate_words)


def _unended(line: Column, rules: Rules) -> Column:
    """Whether a line of several words holds no end of a sentence; a title or an entry of a list has few words."""
    return ~line.rlike(ENDS) & (F.size(words(line)) > rules.unended_words)


def line_fails(line: Column, rules: Rules = Rules(), marks: Column | None = None, furniture: Column | None = None) -> Column:
    """Whether a line goes. A line without words never does.

    marks, furniture: whether the whole text holds any mark or phrase at all; where it doesn't, no line is tried for them.
    """
    true = F.lit(True)
    fails = _unended(line, rules) | _capitals(line, rules) | ((true if marks is None else marks) & _marks(line, rules)) | ((true if furniture is None else furniture) & _furniture(line, rules))
    return line.rlike(INK) & fails


def _judgement(rules: Rules) -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    first = F.struct(
        words(text).alias("words"),
        F.split(text, "\n", -1).alias("lines"),
        _among(text, SYMBOLS).alias("n_symbols"),
        (_among(text, SYMBOLS) + _among(text, OTHER_SEPARATORS) > 0).alias("marks"),
        F.lower(text).rlike(_PHRASES).alias("furniture"),
    )

    def counted(x: Column) -> Column:
        inked = F.filter(x["lines"], lambda line: line.rlike(INK))
        left = F.filter(x["lines"], lambda line: ~line_fails(line, rules, x["marks"], x["furniture"]))
        return F.struct(
            F.size(x["words"]).cast("long").alias("n_words"),
            _length(F.array_join(x["words"], "")).alias("word_chars"),
            x["n_symbols"].alias("n_symbols"),
            _let(inked, lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")).alias("n_dup_lines"),
            repeated_words(x["words"]).alias("n_repeat_words"),
            _let(left, lambda kept: F.when(F.size(kept) < F.size(x["lines"]), F.array_join(kept, "\n"))).alias("shorter"),
        )

    def verdict(x: Column) -> Column:
        failed = (x["n_words"] < 20) | (x["n_repeat_words"] * 100 > x["n_words"] * 30)
        enough = x["shorter"].isNull() | (_inked(x["shorter"]) * 100 >= x["word_chars"] * rules.kept_share)
        base = [x[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        return F.struct(*base, failed.alias("base_failed"), (~failed & enough).alias("kept"), F.coalesce(x["shorter"], F.col("text")).alias("cleaned"))

    return _let(_let(first, counted), verdict)


def judged(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs with a column `judged`: struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and cleaned.

    cleaned is the text without the lines that fail; lines without words stay where they are. A null text counts as
    empty (no words, so base_failed) and its cleaned text is null. Everything is judged row by row: repeated rows get
    the same result, other columns are passed through (one named `judged` is replaced), an empty table stays empty.
    """
    return docs.withColumn("judged", _judgement(rules))


def passing(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of judged() that are kept. An outer generator makes them: a filter alone, or one that is inferred from an
    inner generator, would have every row judged twice."""
    kept = F.filter(F.array(_judgement(rules)), lambda j: j["kept"])
    return docs.select(*[c for c in docs.columns if c != "judged"], F.explode_outer(kept).alias("judged")).filter("judged IS NOT NULL")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_quality."""
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col(f"judged.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
