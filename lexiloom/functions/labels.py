"""Column expressions for labels, sort keys, slugs and language choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def search_string(c: Column) -> Column:
    return F.lower(F.trim(c))


def sense_labels(label: Column) -> Column:
    """The parts of a concept label ``{a; b; c}``; empty parts go before trimming."""
    parts = F.filter(F.split(label, r"[{;}]"), lambda x: x != "")
    return F.transform(parts, lambda x: F.trim(x))


#: Fixed value: a sense label is a word, a mark that begins with §, a digit or a parenthesis, and the rest of a multi-word expression.
_SENSE = r"^([^_<>]+)(_((?:§|\d|\()[^_ ]+)( .+)?)?$"


def sense_label_parts(label: Column) -> Column:
    """(word, rest, mark, more) of a sense label; absent parts are null, and all are where it is none."""
    part = lambda i: F.when(F.regexp_extract(label, _SENSE, i) != "", F.regexp_extract(label, _SENSE, i))
    return F.struct(part(1).alias("word"), part(2).alias("rest"), part(3).alias("mark"), part(4).alias("more"))


def tree_name(label: Column) -> Column:
    """``{a_§1a; b}`` as ``a``: the first lemma of a label without its mark."""
    return F.trim(F.regexp_replace(F.split(F.regexp_replace(label, r"[{}]", ""), ";")[0], r"_[§\d].*$", ""))


def sense_number(label: Column) -> Column:
    return F.regexp_extract(label, r"§(\d+)", 1).try_cast("int")


def entry_sort_key(label: Column) -> Column:
    """Struct of sense number, suffix rank and homograph number; unparsable labels last.

    A suffix ``a`` comes first, none after it, others by name; homograph 1 comes
    before labels without a number, which come before higher numbers.
    """
    number = F.regexp_extract(label, r"§(\d+)", 1)
    suffix = F.regexp_extract(label, r"§\d+([a-zæøå]*)", 1)
    homograph = F.regexp_extract(label, r"(?:^|_)(\d+)§", 1)
    rank = F.when(suffix == "a", "0").when(suffix == "", "1").otherwise(F.concat(F.lit("2"), suffix))
    which = F.when(homograph == "", 1).when(homograph == "1", 0).otherwise(homograph.try_cast("int"))
    fits = number != ""
    return F.struct(
        F.when(fits, number.try_cast("double")).otherwise(float("inf")).alias("number"),
        F.when(fits, rank).otherwise("").alias("suffix"),
        F.when(fits, which).otherwise(0).alias("homograph"),
    )


def slug(c: Column) -> Column:
    """Lower case, Danish letters spelled out, other runs of characters as one dash."""
    text = F.lower(c)
    for letter, spelled in (("æ", "ae"), ("ø", "oe"), ("å", "aa")):
        text = F.replace(text, F.lit(letter), F.lit(spelled))
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-|-$", "")


def lexfile_pos(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\w+)\.\w+$", 1)


def language_preferences(language: str | None) -> list[str | None]:
    """Languages to try in order; None stands for text without a language."""
    known = {"da": ["da", "en", None], "en": ["en", None, "da"], None: [None, "en", "da"]}
    return known.get(language, [language, "en", None, "da"])


def language_rank(lang: Column, language: str | None) -> Column:
    """Place of a language in the preferences; languages that aren't in them come last."""
    out, order = F.lit(99), language_preferences(language)
    for i, name in reversed(list(enumerate(order))):
        out = F.when((lang.isNull() | (lang == "")) if name is None else lang == name, i).otherwise(out)
    return out


def form_type(written: Column) -> Column:
    """Multi-word expression, affix or word, by spaces and hyphens at the ends."""
    return F.when(written.contains(" "), "MultiwordExpression").when(written.startswith("-") | written.endswith("-"), "Affix").otherwise("Word")


def cor_parts(identifier: Column) -> Column:
    """(namespace, lemma, form, repetition) of a dotted identifier; absent parts are null."""
    part = lambda i: F.when(F.regexp_extract(identifier, _COR, i) != "", F.regexp_extract(identifier, _COR, i))
    return F.struct(part(1).alias("namespace"), part(2).alias("lemma"), part(3).alias("form"), part(4).alias("repetition"))


_COR = r"^COR\.(?:([A-Z]+)\.)?(\d+)(?:\.(\d+))?(?:\.(\d+))?$"

#: Glyph classes of the width estimate.
NARROW, WIDE = "fijlrtI.,:;'!|()[] -", "mwMWÆ@%"


def glyph_width(c: Column) -> Column:
    """Estimated width of a text in average letters."""
    one = lambda x: F.when(F.lit(NARROW).contains(x), 0.67).when(F.lit(WIDE).contains(x), 1.33).otherwise(1.0)
    return F.aggregate(F.split(c, ""), F.lit(0.0), lambda acc, x: acc + F.when(x == "", 0.0).otherwise(one(x)))


_MARK = r"_[0-9§]+[a-z]?"


def strip_sense_markers(label: Column) -> Column:
    """``{a_§1a; b_§2}`` as ``{a; b}``."""
    return F.regexp_replace(label, _MARK, "")


def synset_indicator(label: Column) -> Column:
    """``{a_§1a; b_§2}`` as ``a, b``."""
    return F.replace(F.regexp_replace(strip_sense_markers(label), r"^\{|\}$", ""), F.lit("; "), F.lit(", "))


def marked_indicator(label: Column) -> Column:
    """``{a_§1a; b_§2}`` as ``a §1a, b §2``."""
    return F.replace(F.replace(F.regexp_replace(label, r"^\{|\}$", ""), F.lit("_"), F.lit(" ")), F.lit("; "), F.lit(", "))


def says(values: Column, value: Column) -> Column:
    """Whether a set of values holds one."""
    return F.array_contains(values, value)
