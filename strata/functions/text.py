"""Text functions: terms of a question, coverage, structured passages, numbers, quotes, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that carry no signal in a question
QUESTION_NOISE = (
    "what which how why when where who whom whose is are was were be been being do does did the a an of for in on at to and or but "
    "with from by as that this these those it its reported report reports used use uses give given tell show shows any some there their we our "
    "value values typical about agree sources source"
).split()
STOP_WORDS = "a an and are as at be by for from has how in is it of on or that the this to was were what when which with".split()

#: Grades of a passage: with this share of the question's terms it answers it.
COVERED = 0.45


def tokens(text: Column) -> Column:
    """Words and numbers of a query, lower-cased; a formula such as HfO2 stays one token, stop words go."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9_\-]*|\d+(?:\.\d+)?)"), 1)
    return F.filter(F.transform(found, F.lower), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def terms(text: Column) -> Column:
    """The meaningful terms of a question in order, each once, lower-cased."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9][A-Za-z0-9.\-_/]*)"), 1), lambda t: F.lower(F.regexp_replace(t, r"^[.\-_/]+|[.\-_/]+$", "")))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*QUESTION_NOISE)))


def stem(word: Column) -> Column:
    """A lower-cased word without its plural ending: -ies is -y, a last -s goes, but for -us, -ss, -is and words of three letters."""
    return F.when((F.length(word) > 4) & word.rlike("[^ae]ies$"), F.concat(word.substr(F.lit(1), F.length(word) - 3), F.lit("y"))).when((F.length(word) > 3) & word.rlike("[^usi]s$"), word.substr(F.lit(1), F.length(word) - 1)).otherwise(word)


def coverage(text: Column, of: Column) -> Column:
    """The share of terms that a text holds as substrings; 0 without terms."""
    low = F.lower(text)
    return F.when(F.size(of) > 0, F.size(F.filter(of, lambda t: F.contains(low, t))) / F.size(of)).otherwise(F.lit(0.0))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text, not overlapping."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, term, F.lit("")))) / F.length(term)).cast("bigint")


def grade(cover: Column) -> Column:
    return F.when(cover >= COVERED, 3).otherwise(1)


def looks_structured(text: Column) -> Column:
    """Whether a passage is a table or caption: pipes, tabs, or a quarter of at least eight tokens numeric."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    numeric = F.size(F.filter(words, lambda w: w.rlike(r"^[-+]?\d[\d.,]*%?$")))
    return F.contains(text, F.lit("|")) | F.contains(text, F.lit("\t")) | ((F.size(words) >= 8) & (numeric / F.size(words) >= 0.25))


def conjuncts(question: Column) -> Column:
    """Parts of a compound question with three words or more, each with the subjects (formulas, capitals) that it lost; empty for a simple one."""
    parts = F.transform(F.split(question, r",?\s+and\s+|;\s*"), lambda p: F.regexp_replace(p, r"^[ ,;?]+|[ ,;?]+$", ""))
    parts = F.filter(parts, lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")) >= 3)
    subjects = F.array_distinct(F.regexp_extract_all(question, F.lit(r"(\b(?:[A-Z][a-z]?[a-z]?[0-9]+[A-Za-z0-9]*|[A-Z]{2,})\b)"), 1))

    def carried(found: Column) -> Column:
        parts, subjects = found["parts"], found["subjects"]
        lost = lambda p: (F.size(subjects) > 0) & ~F.exists(subjects, lambda s: F.contains(p, s))
        each = F.transform(parts, lambda p: F.concat(F.when(lost(p), F.concat(p, F.lit(" for "), found["all"])).otherwise(p), F.lit("?")))
        return F.when(F.size(parts) >= 2, each).otherwise(F.array().cast("array<string>"))

    def joined(found: Column) -> Column:
        return F.struct(found["parts"].alias("parts"), found["subjects"].alias("subjects"), F.array_join(found["subjects"], " ").alias("all"))

    once = F.transform(F.transform(F.array(F.struct(parts.alias("parts"), subjects.alias("subjects"))), joined), carried)  # parts and subjects are found once a question, not once a part
    return F.element_at(once, 1)


def number_of(text: Column) -> Column:
    """The first number in a text as a double, null for none."""
    return F.nullif(F.regexp_extract(text, r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)", 1), F.lit("")).try_cast("double")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def quote_in(quote: Column, source: Column) -> Column:
    """Whether a quote stands in a text but for case and white space."""
    return F.contains(F.lower(squeezed(source)), F.lower(squeezed(quote)))


def alias_norm(text: Column) -> Column:
    return F.lower(squeezed(text))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_filename(text: Column, most: int = 80) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|#^\[\]]', " "), r"\s+", " ")), 1, most)
