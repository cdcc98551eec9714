"""Terms that help a recogniser with a book's names: proper nouns and phrases from its metadata, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common words that are no names although titles capitalise them, and what separates words.
COMMON = """a an the in on at to of for by up as or if it its is be do no and but nor yet so i me my we us our he him his she her they
them their you your am are was were has have had does did will would could should may might must can get got this that these those
not all one two new also just then than with from into what who how when where why""".split()
SEPARATORS = r"[\s\-/\\()\[\]:,.'\"]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def proper_nouns(found: Column) -> Column:
    """Words of three characters or more with a capital first letter that aren't common."""
    return F.filter(found, lambda w: (F.length(w) >= 3) & w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(COMMON))


def named(text: Column) -> Column:
    """A name's proper nouns and then all its words as a phrase, if there is a proper noun among several words."""
    return F.transform(F.array(words(text)), lambda w: F.when(
        (F.size(proper_nouns(w)) > 0) & (F.size(w) > 1), F.concat(proper_nouns(w), F.array(F.array_join(w, " "))),
    ).otherwise(proper_nouns(w)))[0]


def first_seen(values: Column) -> Column:
    """values without later ones that are the same in lower case."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))


def bias_terms(author: Column, narrator: Column, series: Column, title: Column) -> Column:
    """Author, narrator and series, each by its proper nouns and as a phrase, then the title's proper nouns."""
    return first_seen(F.concat(named(author), named(narrator), named(series), proper_nouns(words(title))))
