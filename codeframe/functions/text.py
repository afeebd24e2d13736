"""Tokenisers, estimators and identifier rules as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry nothing in search: English, code and single letters.
STOP_WORDS = sorted(
    "and are an as at a by be for if is in it of on or the to was with".split() + "const fn impl let mut pub self var".split() + "e i j k n s t x y".split()
)
#: Words that a model's vocabulary has whole.
ONE_TOKEN = sorted(
    set(
        "async await break case catch class const continue def else enum export false fn for from function if impl import interface lambda let mod new null pub return self struct switch this throw true try type undefined use var while".split()
        + "None True False".split()
        + "arguments behavioral changed control default dependencies fallback file flow insertions language name private props public raw required risk state static surface symbol value".split()
        + "== != <= >= => -> && || << >> ++ -- += -= *= /= = < > + - * / % ! & | ^ ~ .".split()
    )
)


def bm25_terms(text: Column) -> Column:
    """Search terms in order of first sight: pieces of each word cut before upper case, then the word.

    Words are runs of letters and digits; pieces of fewer than two bytes and stop words go.
    """
    # each different word once, and those without an inner capital are not cut
    words = F.array_except(F.split(text, r"[^\p{L}\p{Nd}\p{Nl}\p{No}]+"), F.array(F.lit("")))
    keep = lambda w: (F.octet_length(w) >= 2) & ~F.lower(w).isin(STOP_WORDS)
    pieces = lambda w: F.transform(F.filter(F.split(w, r"(?<=.)(?=\p{Lu})"), keep), lambda p: F.lower(p))
    whole = lambda w: F.filter(F.array(F.lower(w)), keep)
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.when(w.rlike(r".\p{Lu}"), F.concat(pieces(w), whole(w))).otherwise(whole(w)))))


def lower_terms(text: Column) -> Column:
    """Search terms of a text in lower case, in order of first sight: its words of two bytes or more that are no stop words."""
    words = F.split(F.lower(text), r"[^\p{L}\p{Nd}\p{Nl}\p{No}]+")
    return F.filter(F.array_except(words, F.array(*map(F.lit, ["", *STOP_WORDS]))), lambda w: F.octet_length(w) >= 2)


def camel_snake(name: Column) -> Column:
    """Lower-cased pieces between _ and - and before each upper-case letter; repeats stay."""
    cut = F.split(F.regexp_replace(name, r"(?<=[^_-])(?=\p{Lu})", "_"), "[_-]")
    return F.transform(F.filter(cut, lambda p: p != ""), lambda p: F.lower(p))


def symbol_tokens(name: Column) -> Column:
    """Pieces between _, . and -, at lower-to-upper and acronym-to-word bounds; only those over one character."""
    cut = F.regexp_replace(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.transform(F.split(F.lower(cut), r"[_.\-\s]+"), lambda p: p), lambda p: F.length(p) > 1)


def split_identifier(word: Column) -> Column:
    """Cut at _ (dropped) and from a lower-case to an upper-case letter."""
    return F.filter(F.split(F.regexp_replace(word, r"(?<=\p{Ll})(?=\p{Lu})", "_"), "_"), lambda p: p != "")


def _plain_tokens(word: Column) -> Column:
    n = F.octet_length(word)
    size = F.when(n == 0, 0).when(n <= 4, 1).when(n <= 10, 2).otherwise(F.floor((n + 3) / 4).cast("int"))
    known = word.isin(ONE_TOKEN) | F.lower(word).isin(ONE_TOKEN)
    return F.when(known, 1).when(word.rlike(r"^[0-9]+$"), F.floor((n + 3) / 4).cast("int")).otherwise(size)


def word_tokens(word: Column) -> Column:
    """Estimated model tokens of one word."""
    parts = split_identifier(word)
    cut = word.rlike(r"_|\p{Ll}\p{Lu}")  # most words have no part to look for
    known = word.isin(ONE_TOKEN) | F.lower(word).isin(ONE_TOKEN)
    summed = F.aggregate(parts, F.lit(0), lambda s, p: s + _plain_tokens(p))
    return F.when(~cut | known | (F.size(parts) <= 1), _plain_tokens(word)).otherwise(summed)


def count_tokens(text: Column) -> Column:
    """Estimated model tokens of a text: blank runs by fives, line ends, punctuation, words; at least 1."""
    # a run of n blanks has ceil(n / 5) matches of the first pattern
    marks = F.regexp_count(text, F.lit(r"[ \t]{1,5}|[\n\r{}\[\]():,;\"']"))
    words = F.array_remove(F.split(text, r"[ \t\n\r{}\[\]():,;\"']+"), "")
    return F.greatest(F.aggregate(words, F.lit(0), lambda s, w: s + word_tokens(w)) + marks, F.lit(1)).cast("long")


def estimate_tokens(text: Column) -> Column:
    """ceil(bytes / 3.8)."""
    return F.ceil(F.octet_length(text) / F.lit(3.8)).cast("long")


def reduction_percent(before: Column, after: Column) -> Column:
    """How much smaller, in percent; 0 where there was nothing."""
    return F.when(before == 0, 0.0).otherwise((before - after) / before * 100.0)


def normalize_blanks(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def decode_entities(s: Column) -> Column:
    """The five entities of linter XML; the ampersand last."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def sanitize_filename(s: Column) -> Column:
    return F.regexp_replace(s, r"[^A-Za-z0-9_-]", "_")


def truncate(s: Column, limit: int) -> Column:
    """At most ``limit`` characters."""
    return F.substring(s, 1, limit)


def head_and_tail(s: Column) -> Column:
    """Raw fallback: texts over a limit keep two thirds of it from the head and one third from the tail."""
    limit = F.least(F.greatest(F.floor(F.length(s) / 10), F.lit(2000)), F.lit(10000)).cast("int")
    head = F.floor(limit * 2 / 3).cast("int")
    tail = limit - head
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, F.lit(1), head), F.lit("\n...\n"), F.substring(s, F.length(s) - tail + 1, tail)))


def infer_type(init: Column) -> Column:
    """A type name guessed from an initializer."""
    t = F.trim(init)
    return (
        F.when(t.rlike(r"""^["'`]"""), "string").when(t.isin("true", "false"), "boolean").when(t.rlike(r"^-?[0-9]+$"), "number").when(t.rlike(r"^-?[0-9]*\.[0-9]+$"), "number")
        .when(t.startswith("["), "array").when(t.startswith("{"), "object").when(t.isin("null", "undefined", "None"), "null")
    )
