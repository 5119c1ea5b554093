"""Lemma search, autocomplete, synonyms and word overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import terms as T


class Lexicon:
    """The predicates that tie words, senses and concepts together."""

    def __init__(self, written: str, evokes: str, sense: str, lexicalized: str):
        self.written, self.evokes, self.sense, self.lexicalized = written, evokes, sense, lexicalized


def _pairs(triples: DataFrame, p: str, a: str, b: str) -> DataFrame:
    return triples.where(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))


def search_lemma(triples: DataFrame, lexicon: Lexicon, lemma: str, lang: str, degrees: DataFrame) -> DataFrame:
    """(word, synset, indegree) of concepts evoked by words with exactly this written form, highest indegree first."""
    words = triples.where((F.col("p") == lexicon.written) & (F.col("o") == T.literal(lemma, lang=lang))).select(F.col("s").alias("word"))
    found = _pairs(triples, lexicon.evokes, "word", "synset").join(words, "word", "left_semi")
    out = found.join(degrees.select(F.col("node").alias("synset"), "indegree"), "synset", "left").fillna({"indegree": 0})
    return out.select("word", "synset", "indegree").distinct().orderBy(F.desc("indegree"), "synset", "word")


def look_up_any_case(triples: DataFrame, lexicon: Lexicon, lemma: str, lang: str, degrees: DataFrame) -> DataFrame:
    """As written; where nothing is found and the first letter is a capital, in lower case."""
    found = search_lemma(triples, lexicon, lemma, lang, degrees)
    if lemma[:1].isupper() and found.isEmpty():
        return search_lemma(triples, lexicon, lemma.lower(), lang, degrees)
    return found


def completions(triples: DataFrame, written: str) -> DataFrame:
    """(key, form): the search key of each written form and its first spelling."""
    form = T.lex(F.col("o"))
    rows = triples.where(F.col("p") == written).select(F.lower(F.trim(form)).alias("key"), form.alias("form"))
    return rows.where("key <> ''").groupBy("key").agg(F.min("form").alias("form"))


def write_completions(index: DataFrame, path: str) -> None:
    """The completion index in directories by the first character of the key, in them in the order of the keys."""
    index.withColumn("first", F.substring("key", 1, 1)).hint("rebalance", "first").sortWithinPartitions("first", "key").write.partitionBy("first").parquet(path)


def _after(prefix: str) -> str | None:
    """The least string above all that start with ``prefix``; None where there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[i]) + 1
        if code <= 0x10FFFF:
            return prefix[:i] + chr(0xE000 if 0xD800 <= code <= 0xDFFF else code)
    return None


def autocomplete(index: DataFrame, prefix: str, most: int = 200) -> DataFrame:
    """The first completions of a prefix. The prefix is a range of keys, and of a stored index its first character a directory, so other files aren't read."""
    key = prefix.strip().lower()
    if not key:
        return index.limit(0)
    rows = index.where(F.col("key") >= key)
    if (end := _after(key)) is not None:
        rows = rows.where(F.col("key") < end)
    if "first" in index.columns:
        rows = rows.where(F.col("first") == key[0])
    return rows.orderBy("key", "form").limit(most).select(*[c for c in index.columns if c != "first"])


def synonyms(triples: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(word, synonym): distinct other words that evoke the same concept."""
    evokes = _pairs(triples, lexicon.evokes, "word", "synset").distinct()
    other = evokes.select(F.col("word").alias("synonym"), "synset")
    pairs = evokes.join(other, "synset").where("word <> synonym")
    return pairs.select("word", "synonym").distinct()


def word_overview(triples: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(word, synset, n_senses, first_sense): the concepts of each word with its senses in them."""
    own = _pairs(triples, lexicon.sense, "word", "sense")
    concept = _pairs(triples, lexicon.lexicalized, "synset", "sense")
    return own.join(concept, "sense").groupBy("word", "synset").agg(F.count_distinct("sense").alias("n_senses"), F.min("sense").alias("first_sense"))


def one_word_synonyms(triples: DataFrame, lexicon: Lexicon, sure: str = " ") -> DataFrame:
    """(word, form): written forms of synonyms, without those of several words and those written as the word itself, in order."""
    written = _pairs(triples, lexicon.written, "word", "form")
    found = synonyms(triples, lexicon).join(written.withColumnRenamed("word", "synonym"), "synonym").select("word", "form")
    return found.where(~T.lex(F.col("form")).contains(sure)).join(written, ["word", "form"], "left_anti").distinct().orderBy("word", "form")
