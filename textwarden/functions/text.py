"""Scalar functions on text, as Column -> Column, of built-in functions only unless said otherwise."""

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


@lru_cache(1)
def _unaccented() -> tuple[str, str]:
    """Every character of the basic plane whose compatibility decomposition is one base character, and those base characters."""
    pairs = []
    for point in range(0xA0, 0x10000):
        whole = unicodedata.normalize("NFKD", chr(point)) if not 0xD800 <= point < 0xE000 and not 0xAC00 <= point < 0xD7A4 else ""
        base = "".join(c for c in whole if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(point) and ord(base) < 128:
            pairs.append((chr(point), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Decompositions to several characters that occur in running text; others count as punctuation. normalize_exact knows all.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "½": "1 2", "¼": "1 4", "¾": "3 4", "…": "...", "™": "tm", "℡": "tel", "№": "no"}


def normalize(text: Column, leet: bool = False) -> Column:
    """Lower-case ASCII letters and digits between single spaces: accents go, punctuation parts words. With leet, digits that stand for letters become them."""
    t = F.translate(text, *_unaccented())
    for a, b in LIGATURES.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(t, r"\p{Mn}+", "")))  # ASCII has neither accents nor ligatures
    if leet:
        t = F.translate(t, L.LEET_FROM, L.LEET_TO)
    return F.trim(F.regexp_replace(t, "[^a-z0-9]{2,}|[^a-z0-9 ]", " "))  # a single space stays as it is


def normalize_exact(leet: bool = False):
    """normalize with the full Unicode decomposition, as a Pandas UDF; for texts beyond Latin scripts."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        t = texts.str.normalize("NFKD").map(lambda x: None if x is None else "".join(c for c in x if not unicodedata.combining(c)))
        t = t.str.lower()
        if leet:
            t = t.str.translate(str.maketrans(L.LEET_FROM, L.LEET_TO))
        return t.str.replace(r"[^a-z0-9\s]", " ", regex=True).str.replace(r"\s+", " ", regex=True).str.strip()

    return run


def compact(normal: Column) -> Column:
    return F.replace(normal, F.lit(" "), F.lit(""))


def first_of(values: list[str], text: Column) -> Column:
    """The first of the values, in their order, that the text contains; null if none."""
    return F.get(F.filter(strings(values), lambda v: F.contains(text, v)), 0)


def following(normal: Column, position: Column, length: Column, words: int = 10) -> Column:
    """Up to so many words after a match at the 1-based position; the whole text where the position is 0."""
    tail = F.trim(F.substring(normal, position + length, F.lit(sys.maxsize >> 32)))
    return F.when(position == 0, normal).otherwise(F.array_join(F.slice(F.split(tail, " +"), 1, words), " "))


def running(values: Column) -> Column:
    """The running sums of an array of whole numbers, in as many turns as its size has bits: each adds what stands 1, 2, 4 and so on places before."""
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, values, lambda sums, step: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - step), F.lit(0))))


def longest_run(text: Column) -> Column:
    """Length of the longest run of one character; 0 for empty."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)((.)\2*)"), F.lit(1)), F.length)), F.lit(0))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def invisible_count(text: Column) -> Column:
    return F.size(F.filter(strings(L.INVISIBLE), lambda c: F.contains(text, c)))


NUMBER = r"(?U)\b\d+(?:[.,]\d+)?\b"
DURATION = r"(?iU)\b\d{1,2}\s*(?:days?|months?|weeks?|years?|hours?)\b"
ENTITY = r"(?U)\b[A-Z][a-z]{2,}\b"
TAG = r"\[([A-Za-z]?\d+)\]"


def distinct_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))


def numbers(text: Column) -> Column:
    return distinct_matches(text, NUMBER)


def durations(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DURATION), F.lit(0)), lambda d: F.trim(F.lower(d)))))


def entities(text: Column) -> Column:
    return distinct_matches(text, ENTITY)


def tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TAG), F.lit(1))


def stem(word: Column) -> Column:
    """word without the longest known suffix that leaves three letters."""
    return F.regexp_replace(word, f"^(.{{3,}}?)(?:{L.SUFFIXES})$", "$1")


def content_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    told = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(strings(L.CLAIM_STOP), w))
    return F.array_sort(F.array_distinct(F.transform(told, stem)))


def topic_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) > 3) & ~F.array_contains(strings(L.TOPIC_STOP), w))


def topic_key(text: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(topic_words(text))), " ")


def claims(answer: Column) -> Column:
    """array<struct<text, tags>>: sentences of at least 12 characters without their tags. A fragment of tags alone gives them to the claim before it."""
    parts = F.filter(F.transform(F.split(F.trim(answer), r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda p: p != "")
    cleaned = F.transform(parts, lambda p: F.struct(F.btrim(F.regexp_replace(p, TAG, ""), F.lit(" .")).alias("text"), tags(p).alias("tags")))
    none = F.array().cast("array<struct<text:string,tags:array<string>>>")

    def step(done: Column, c: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["text"].alias("text"), F.concat(last["tags"], c["tags"]).alias("tags"))))
        only_tags = (F.size(c["tags"]) > 0) & (c["text"] == "")
        return F.when(only_tags & (F.size(done) > 0), joined).when(only_tags | (F.length(c["text"]) < 12), done).otherwise(F.concat(done, F.array(c)))

    return F.aggregate(cleaned, none, step)


def untagged_sentences(answer: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(answer), r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda p: (F.length(p) >= 12) & ~p.rlike(TAG))


def without_unknown_tags(answer: Column, keys: Column) -> Column:
    """answer without the tags that are not among the keys."""
    unknown = F.array_distinct(F.array_except(tags(answer), keys))
    return F.aggregate(unknown, answer, lambda t, k: F.replace(t, F.concat(F.lit("["), k, F.lit("]")), F.lit("")))


def expand_short_forms(text: Column) -> Column:
    for short, full in L.SHORT_FORMS.items():
        text = F.regexp_replace(text, rf"(?iU)\b{short}\b", full)
    return text


def date_spans(today: Column) -> dict[str, Column]:
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    span = lambda a, b: F.concat(iso(a), F.lit(" to "), iso(b))
    month, year = F.trunc(today, "MM"), F.trunc(today, "YEAR")
    return {"last month": span(F.add_months(month, -1), F.date_sub(month, 1)), "this month": span(month, today), "last year": span(F.add_months(year, -12), F.date_sub(year, 1))}


def absolute_dates(text: Column, today: Column) -> Column:
    """text with relative months and years as ISO spans, by calendar."""
    for phrase, span in date_spans(today).items():
        text = F.regexp_replace(text, F.lit(rf"(?iU)\b{phrase}\b"), span)
    return text


def subject_of(question: Column) -> Column:
    """The last word of five or more ASCII letters; null if none."""
    return F.element_at(F.when(F.size(F.regexp_extract_all(question, F.lit("[A-Za-z]{5,}"), F.lit(0))) > 0, F.regexp_extract_all(question, F.lit("[A-Za-z]{5,}"), F.lit(0))), -1)


def with_subject(text: Column, subject: Column) -> Column:
    """text with its first it, that or this replaced by the subject, if there is one."""
    return F.when(subject.isNotNull(), F.regexp_replace(text, F.lit(r"(?isU)^(.*?)\b(?:it|that|this)\b"), F.concat(F.lit("$1"), subject))).otherwise(text)


def split_questions(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, r"(?U)\band\b|\?"), lambda x: F.trim(x)), lambda p: F.length(p) > 12)
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: F.length(s) > 12)


def long_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    """Share of a's long words that b has; 0 if a has none."""
    wa = long_words(a)
    return F.when(F.size(wa) > 0, F.size(F.array_intersect(wa, long_words(b))) / F.size(wa)).otherwise(F.lit(0.0))


def swap(text: Column, a: Column | str, b: Column | str) -> Column:
    a, b = (F.lit(x) if isinstance(x, str) else x for x in (a, b))
    return F.regexp_replace(text, F.concat(F.lit(r"(?iU)\b"), a, F.lit(r"\b")), b)


def mentions(text: Column, word: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(r"(?iU)\b"), word, F.lit(r"\b")))


def half_up(x: Column, digits: int) -> Column:
    """x rounded by floor(x * 10**digits + 0.5), which engines agree on."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


# --- checksums ---


def luhn_valid(digits: Column) -> Column:
    return F.coalesce(digits.rlike("^[0-9]{12,19}$") & F.call_function("luhn_check", digits), F.lit(False))


def verhoeff_valid(digits: Column) -> Column:
    """Whether 12 digits, the first from 2 to 9, pass the Verhoeff check."""
    product, permutation = strings(L.VERHOEFF_PRODUCT), strings(L.VERHOEFF_PERMUTATION)
    digit = lambda rows, i, j: F.substring(F.get(rows, i), j + 1, F.lit(1)).cast("int")
    fits = digits.rlike("^[2-9][0-9]{11}$")
    at = lambda i: F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), lambda c, i: digit(product, c, digit(permutation, i % 8, at(i))))
    return F.coalesce(F.when(fits, total == 0), F.lit(False))


def pan_valid(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^[A-Z]{{3}}[{L.PAN_HOLDERS}][A-Z][0-9]{{4}}[A-Z]$"), F.lit(False))


def gstin_valid(text: Column) -> Column:
    fits = text.rlike("^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$")
    return F.coalesce(fits & F.when(fits, F.substring(text, 1, 2).cast("int")).between(1, 38), F.lit(False))
