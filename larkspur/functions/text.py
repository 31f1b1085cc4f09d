"""Tokenizers as built-in expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that separate words, and the older tokenizers' trimmed characters and stop words.
SEPARATORS = r"[^a-z0-9가-힣ぁ-んァ-ヶ亜-熙\s]"
TRIMMED = ".,! "
STOP_WORDS = ["a", "an", "the", "is", "are"]


def _none() -> Column:
    return F.array().cast("array<string>")


def terms(text: Column) -> Column:
    """The distinct terms of a text: of each word its two-character substrings, and the word itself if it is longer, a number, or one character.

    Null and empty texts have no terms.  Repeated words are dropped before they are cut up.
    """
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, " ")
    words = F.array_distinct(F.filter(F.split(clean, r"\s+"), lambda w: F.length(w) > 0))

    def cut(w: Column) -> Column:
        # sequence(1, 0) would descend
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
        whole = F.when(F.length(w) > 2, F.array(w)).otherwise(_none())
        return F.when((F.length(w) < 2) | w.rlike("^[0-9]+$"), F.array(w)).otherwise(F.concat(pairs, whole))

    return F.array_distinct(F.flatten(F.transform(words, cut)))


def found_terms(text: Column, words: list[str]) -> Column:
    """For each of some terms, in an array, whether terms(text) has it, without cutting the text up.

    A term of two characters with a letter is there if the cleaned text contains it; any other term
    is there as a whole word; two digits are there also inside a word that isn't a number.
    """
    # every separator, white space included, becomes one kind of blank
    clean = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS.replace(r"\s", ""), " "), F.lit(" "))

    def has(c: Column, t: str) -> Column:
        whole = F.contains(c, F.lit(f" {t} "))
        if len(t) != 2:
            return whole
        return whole | c.rlike(f"[^0-9 ][^ ]*{t}|{t}[^ ]*[^0-9 ]") if t.isdigit() else F.contains(c, F.lit(t))

    if not words:
        return F.array().cast("array<boolean>")
    return F.transform(F.array(clean), lambda c: F.array(*[has(c, t) for t in words]))[0]  # cleaned once


def split_terms(text: Column) -> Column:
    """The first tokenizer: lower-cased words of two characters or more, trimmed."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.length(w) > 1)
    return F.array_distinct(F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(TRIMMED))))


def ascii_terms(text: Column) -> Column:
    """The second tokenizer: words of ASCII letters and digits, without stop words; single letters go."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) > 0)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(STOP_WORDS) & (w.rlike("^[0-9]+$") | (F.length(w) > 1))))


def query_terms(spark: SparkSession, keyword: str) -> list[str]:
    """The terms of one query, as the index has them; as many as the keyword has characters, at most twice."""
    return sorted(spark.range(1).select(terms(F.lit(keyword)).alias("t")).first()["t"])


def exploded(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row for each term of each row of docs."""
    return docs.select(*keep, F.explode(terms(F.col(text))).alias("term"))
