"""Text functions as Column expressions; everything stays inside code generation but the NFKC path."""

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.config import EXACT_TERMS, SHORT_TERMS, STOPWORDS

#: Letters with marks and the plain letters below them, by Unicode decomposition.
MARKED = {
    chr(c): unicodedata.normalize("NFD", chr(c))[0]
    for c in range(0xC0, 0x250)
    if unicodedata.normalize("NFD", chr(c))[0].isascii() and unicodedata.normalize("NFD", chr(c)) != chr(c)
} | {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ð": "d", "Ð": "D"}
#: Letters that become two.
EXPANDED = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "Æ": "AE", "Œ": "OE", "Þ": "TH"}
SPACES = r"[\s\p{Z}]+"
NOT_ALNUM = r"[^\p{L}\p{Nd}]+"
SENTENCE_END = r"([.!?]+[\"')\]]*) +([^\p{Ll}])"
SENTENCE_MARK = "␞"
DOI = r"10\.[0-9]{4,9}/[-._;()/:a-z0-9]+"
FIELD_MARK = "␟"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squish(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def to_ascii(c: Column) -> Column:
    plain = F.translate(c, "".join(MARKED), "".join(MARKED.values()))
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), EXPANDED.items(), plain)


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else t)


def _stable_class(end: int = 0x180) -> str:
    """The characters below ``end`` that NFKC leaves alone beside any other of them, as ranges of a class."""
    stable = [c for c in range(end) if unicodedata.is_normalized("NFKC", chr(c))]
    starts = [c for c in stable if c - 1 not in stable]
    ends = [c for c in stable if c + 1 not in stable]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends))


UNSTABLE = f"[^{_stable_class()}]"


def nfkc(c: Column) -> Column:
    """NFKC, for which Spark has no function: only texts with a character that it may change leave the JVM."""
    return F.coalesce(_nfkc(F.when(c.rlike(UNSTABLE), c)), c)


def normalize_text(c: Column, lowercase: bool = False, remove_diacritics: bool = False, compatibility: bool = False) -> Column:
    """Null becomes empty, control characters become spaces, white space is squeezed."""
    out = text_or_empty(c)
    out = nfkc(out) if compatibility else out
    out = squish(F.regexp_replace(out, r"[\x00-\x1F\x7F]", " "))
    out = F.lower(out) if lowercase else out
    return to_ascii(out) if remove_diacritics else out


def normalize_for_matching(c: Column) -> Column:
    return F.trim(F.regexp_replace(normalize_text(c, True, True), NOT_ALNUM, " "))


def normalize_doi(c: Column) -> Column:
    """A lower-case DOI without its URL, or the empty string."""
    out = normalize_text(c, lowercase=True)
    for pattern in (r"^https?://(dx\.)?doi\.org/", r"^doi\s*:\s*", r"\s+", r"[.,;]+$"):
        out = F.regexp_replace(out, pattern, "")
    return F.when(out.rlike(r"^10\.[0-9]{4,9}/\S+$"), out).otherwise("")


def clean_authors(c: Column) -> Column:
    out = normalize_text(c)
    for pattern, new in ((r"\s*\|\s*", "; "), (r"\s*;\s*", "; "), (r";{2,}", ";"), (r";$", "")):
        out = F.regexp_replace(out, pattern, new)
    return out


def normalize_authors_for_id(c: Column) -> Column:
    return F.replace(normalize_for_matching(c), F.lit(" "), F.lit("_"))


def distinct_terms(terms: Column) -> Column:
    """The terms of an array that are not blank, without those equal to an earlier one for matching."""
    pairs = F.filter(
        F.transform(terms, lambda x: F.struct(F.trim(x).alias("t"), normalize_for_matching(x).alias("n"))), lambda p: p["t"] != ""
    )
    # The pairs go through arrays of one, so that they are made once and not for every term.
    both = F.transform(F.array(pairs), lambda ps: F.struct(ps.alias("ps"), F.transform(ps, lambda p: p["n"]).alias("ns")))
    kept = F.transform(both, lambda b: F.filter(b["ps"], lambda p, i: F.array_position(b["ns"], p["n"]) == i + 1))
    return F.transform(F.get(kept, 0), lambda p: p["t"])


def clean_keywords(author: Column, index: Column) -> Column:
    both = F.concat_ws("; ", *(F.regexp_replace(normalize_text(c), r"\s*[,|]\s*", "; ") for c in (author, index)))
    return F.array_join(distinct_terms(F.split(both, ";")), "; ")


def parse_year(c: Column) -> Column:
    """A whole year; fractions are cut off and other values become null."""
    number = c.cast("string").try_cast("double")
    return (F.signum(number) * F.floor(F.abs(number))).try_cast("int")


def hash_text(*columns: Column) -> Column:
    return F.sha2(F.concat_ws(FIELD_MARK, *(text_or_empty(c) for c in columns)), 256)


def tokenize(c: Column) -> Column:
    """Tokens of a text: at least two characters or a known short term, and no stop word."""
    return matching_tokens(normalize_for_matching(c))


def matching_tokens(normalized: Column) -> Column:
    """The tokens of a text that is normalised for matching."""
    words = F.split(normalized, " ")
    short, stop = F.array(*map(F.lit, SHORT_TERMS)), F.array(*map(F.lit, STOPWORDS))
    return F.filter(
        words, lambda w: (w != "") & ((F.length(w) > 1) | F.array_contains(short, w)) & ~F.array_contains(stop, w)
    )


def doi_terms(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(DOI), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;]+$", "")))


def exact_terms(c: Column) -> Column:
    """The dictionary phrases in a text, in the dictionary's order, and then its DOIs."""
    return matching_exact_terms(normalize_for_matching(c), c)


def matching_exact_terms(normalized: Column, c: Column) -> Column:
    """The exact terms of a text ``c`` of which the form for matching is at hand."""
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    words = F.array(*map(F.lit, EXACT_TERMS))
    # The text goes through an array of one, so that it is normalised once and not for every phrase.
    found = F.transform(F.array(padded), lambda p: F.filter(words, lambda w: F.contains(p, F.concat(F.lit(" "), w, F.lit(" ")))))
    return F.array_union(F.get(found, 0), doi_terms(c))


def parse_semicolon_terms(c: Column) -> Column:
    parts = F.transform(F.split(text_or_empty(c), ";"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def parse_json_tokens(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def split_sentences(c: Column) -> Column:
    return normalized_sentences(normalize_text(c))


def normalized_sentences(normalized: Column) -> Column:
    """The sentences of a normalised text."""
    marked = F.regexp_replace(normalized, SENTENCE_END, f"$1{SENTENCE_MARK}$2")
    return F.filter(F.transform(F.split(marked, SENTENCE_MARK), lambda x: F.trim(x)), lambda x: x != "")


def cue_pattern(cues: str) -> str:
    return rf"(^|[^\p{{L}}\p{{N}}_])({cues})($|[^\p{{L}}\p{{N}}_])"


def sentences_with(sentences: Column, cues: str, most: int = 3) -> Column:
    """The first ``most`` of an array of sentences that hold a cue, as one text."""
    found = F.filter(sentences, lambda s: F.lower(s).rlike(cue_pattern(cues)))
    return F.array_join(F.slice(found, 1, most), " ")


def dot(a: Column, b: Column) -> Column:
    """The sum of products of two arrays of one length, in doubles."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Zero where a norm is zero; an error where the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length"))
    return F.when(same.isNull() & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def cosine_to_unit(c: Column) -> Column:
    value = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)) + 1) / 2
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(value)
