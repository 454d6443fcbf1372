"""Text as column expressions: normal form, tokens, n-grams, overlaps. All of it stays in generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a product, by what they are in a sentence.
STOP_CLASSES = {
    "articles and pointers": "the a an this that these those such same",
    "people and things": "i me my mine we us our ours you your yours he him his she her hers it its they them their theirs who whose one someone something anything everything nothing thing things stuff",
    "auxiliaries": "be am is are was were been being have has had having do does did done can could will would shall should may might must",
    "left of contractions": "s t d m ll re ve don doesn didn isn wasn won",
    "joints": "and or but nor so than then because if though although while whether as",
    "prepositions": "of in on at by to for from with about into onto over under around through between during since until up off out",
    "questions": "what which when where why how",
    "amounts": "some any each every all both either neither much many more most few less lot enough several",
    "adverbs": "not no yes just only also too very quite rather really still yet again now here there maybe please actually instead otherwise ever never always already",
    "wishing and choosing": "want wants wanted need needs like likes prefer preference preferences wish wishes requirement requirements key important matter matters mind care choice choose pick decide judgment",
    "asking and telling": "ask asking say says said tell told show give let make take get got go going know think see feel seem look looking find try browse browsing explore exploring search searching shop shopping buy buying",
    "taking back": "ignore forget drop scratch changed change earlier previous start over",
}
STOP = tuple(sorted({w for words in STOP_CLASSES.values() for w in words.split()}))


def norm(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space, no space around."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


#: Latin letters with marks, and what is left of each without them, by their decomposition.
MARKED = {c: d[0] for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()}


def folded(c: Column) -> Column:
    """Text without the marks of Latin letters."""
    return F.translate(c, "".join(MARKED), "".join(MARKED.values()))


def tokens_of(normal: Column) -> Column:
    """The tokens of a text in normal form; none of an empty one."""
    return F.filter(F.split(normal, " "), lambda t: t != "")


def tokens(c: Column) -> Column:
    return tokens_of(norm(c))


def padded(normal: Column) -> Column:
    """Between two spaces, so that ' phrase ' is found on word bounds only."""
    return F.concat(F.lit(" "), normal, F.lit(" "))


def has_phrase(normal: Column, phrase: Column) -> Column:
    return F.contains(padded(normal), padded(phrase))


def content(toks: Column, least: int = 1) -> Column:
    """Tokens that are no stop words, of so many characters at least."""
    return F.filter(toks, lambda t: ~t.isin(*STOP) & (F.length(t) >= least))


def windows(items: Column, n: int) -> Column:
    """All runs of n items, in order."""
    size = F.size(items)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.slice(items, i, n))).otherwise(F.array().cast("array<array<string>>"))


def ngrams(items: Column, n: int) -> Column:
    """Runs of n tokens, joined by spaces."""
    return F.transform(windows(items, n), lambda w: F.array_join(w, " "))


def char_grams(word: Column, n: int) -> Column:
    """All character n-grams of a word, in order, with repeats."""
    return F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def trigrams(word: Column) -> Column:
    """The distinct trigrams of a word between two bounds."""
    return F.array_distinct(char_grams(F.concat(F.lit("$"), word, F.lit("$")), 3))


def overlap(said: Column, have: Column) -> Column:
    """Share of the distinct said tokens that are also in have; 0 if none is said."""
    said = F.array_distinct(said)
    return F.when(F.size(said) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(said, have)) / F.size(said))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token lists as sets; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def idf(n: Column, df: Column) -> Column:
    """ln((n - df + 0.5) / (df + 0.5) + 1)."""
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def elided(text: Column, words: int = 6) -> Column:
    """At most so many words, with an ellipsis if there are more."""
    w = F.split(text, " ")
    return F.concat(F.array_join(F.slice(w, 1, words), " "), F.when(F.size(w) > words, F.lit("…")).otherwise(F.lit("")))
