"""Text kernel: column expressions over words, n-grams and sets, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes in the order in which they are tried, and the synonyms (each pair works in both directions).
SUFFIXES = ("tion", "sion", "ing", "ment", "ness", "able", "ible", "ous", "ive", "ful", "less", "ize", "ise", "ated", "ates", "ies", "ed", "er", "ly", "al", "es", "s")
SYNONYM_PAIRS = (
    ("auth", "authentication"),
    ("db", "database"),
    ("config", "configuration"),
    ("env", "environment"),
    ("repo", "repository"),
    ("dep", "dependency"),
    ("deps", "dependencies"),
    ("dir", "directory"),
    ("impl", "implementation"),
    ("func", "function"),
    ("param", "parameter"),
    ("args", "arguments"),
    ("msg", "message"),
    ("err", "error"),
    ("req", "request"),
    ("res", "response"),
    ("jwt", "token"),
)
SYNONYMS = dict(SYNONYM_PAIRS) | {b: a for a, b in SYNONYM_PAIRS}


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def slug(text: Column, length: int = 60) -> Column:
    """Lower-case letters and digits joined by single dashes, cut at `length`."""
    dashed = F.regexp_replace(lowered(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, length)


def tokens(text: Column) -> Column:
    """All runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.regexp_extract_all(lowered(text), F.lit("[a-z0-9]+"), F.lit(0))


def spaced(text: Column) -> Column:
    """Words between white space of the lower-cased text; punctuation stays."""
    return F.filter(F.split(lowered(text), r"\s+"), lambda x: x != "")


def raw_words(text: Column) -> Column:
    """Distinct words of three or more letters, digits or underscores."""
    return F.array_distinct(F.regexp_extract_all(lowered(text), F.lit("[a-z0-9_]{3,}"), F.lit(0)))


def stem(word: Column) -> Column:
    """The word without the first suffix of the list that fits and leaves more than three letters."""
    out = None
    for s in SUFFIXES:
        holds = (F.length(word) > len(s) + 3) & word.endswith(s)
        short = F.substring(word, F.lit(1), F.length(word) - len(s))
        out = F.when(holds, short) if out is None else out.when(holds, short)
    return out.otherwise(word)


def stemmed(word: str) -> str:
    """`stem` of one word, for kernels."""
    return next((word[: -len(s)] for s in SUFFIXES if len(word) > len(s) + 3 and word.endswith(s)), word)


def synonym(word: Column) -> Column:
    """The other name of a word, null for most words."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair)), word)


def word_set(text: Column) -> Column:
    """Distinct words with their stems and synonyms."""
    words = F.array_distinct(tokens(text))
    more = F.flatten(F.transform(words, lambda w: F.array(w, stem(w), synonym(w))))
    return F.array_distinct(F.filter(more, lambda w: w.isNotNull()))


def ngrams(words: Column, n: int) -> Column:
    """Distinct runs of n words, joined by blanks.

    Shifted copies are zipped: a lambda that sliced `words` at each place would evaluate that expression once a place.
    """
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, F.lit(1), count)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(k + 1), count), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(out)


def containment(a: Column, b: Column) -> Column:
    """Common elements over the size of the smaller set; 0 where one is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(0.0)


def jaccard(a: Column, b: Column, k: int | None = None) -> Column:
    """Common elements over all elements of two lists, or of their first k; two empty lists agree fully."""
    a, b = (F.slice(x, 1, k) if k else x for x in (a, b))
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(1.0)


def word_overlap(query: Column, text_words: Column) -> Column:
    """Share of the query's words that the text has."""
    n = F.size(query)
    return F.when(n > 0, F.size(F.array_intersect(query, text_words)) / n).otherwise(0.0)


def title(text: Column, length: int = 120) -> Column:
    """The first line that is not blank, cut."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return F.substring(F.trim(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))), 1, length)


def id_prefix(ident: Column) -> Column:
    return F.substring(F.trim(ident), 1, 8)


def search_terms(query: Column, most: int = 20) -> Column:
    """Terms of a full-text query: words of letters, digits and underscores without operators, the first `most`."""
    words = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return F.slice(F.filter(words, lambda w: ~F.upper(w).isin("AND", "OR", "NOT", "NEAR")), 1, most)


def quoted_terms(query: Column) -> Column:
    """White-space terms without double quotes, each quoted."""
    parts = F.transform(F.split(F.coalesce(query, F.lit("")), r"\s+"), lambda w: F.replace(w, F.lit('"'), F.lit("")))
    return F.array_join(F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " ")


def sanitised_tag(tag: Column) -> Column:
    """A tag without the characters that end a list in the record format."""
    return F.trim(F.regexp_replace(F.regexp_replace(tag, r"[\[\],]", ""), r"[\r\n]+", " "))


def glob_pattern(glob: Column) -> Column:
    """A glob as an anchored regular expression."""
    quoted = F.regexp_replace(glob, r"([.+^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def overlap_phrase(query: Column, target: Column) -> Column:
    """The first two neighbouring query words that the target has both, else its longest shared word that says something."""
    q, t = tokens(query), tokens(target)
    stop = F.array(*map(F.lit, ("a", "an", "the", "and", "or", "in", "on", "at", "to", "of", "is", "it", "be", "as")))
    at = F.when(F.size(q) >= 2, F.sequence(F.lit(1), F.size(q) - 1)).otherwise(F.array().cast("array<int>"))
    pair = F.filter(at, lambda i: F.array_contains(t, F.element_at(q, i)) & F.array_contains(t, F.element_at(q, i + 1)))
    both = F.transform(pair, lambda i: F.concat_ws(" ", F.element_at(q, i), F.element_at(q, i + 1)))
    single = F.array_sort(F.transform(F.array_except(F.array_intersect(q, t), stop), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.coalesce(F.try_element_at(both, F.lit(1)), F.try_element_at(single, F.lit(1))["w"])
