"""Full text: inverted index, boolean match, BM25 ranking and snippets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def folded(text: Column) -> Column:
    """Lower-case runs of Unicode letters and digits without their accents."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [] if t is None else _RUNS.findall(_plain(t)))

    return run(text)


_RUNS = re.compile(r"[^\W_]+")
_ACCENTS = re.compile("[\u0300-\u036f]+")


def _plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", _ACCENTS.sub("", unicodedata.normalize("NFD", text.lower())))


def index(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """term, document, tf, and the document's length in terms."""
    words = docs.select(F.col(id_col).alias("doc"), terms(text).alias("w"))
    flat = words.select("doc", F.size("w").alias("doc_len"), F.explode("w").alias("term"))
    return flat.groupBy("term", "doc").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))


def match_all(ix: DataFrame, wanted: list[str]) -> DataFrame:
    """Documents that hold every term."""
    return ix.where(F.col("term").isin(wanted)).groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") == len(set(wanted))).select("doc")


def bm25(ix: DataFrame, wanted: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Documents that hold any term, by BM25, with ln(1 + (n - df + .5)/(df + .5)),
    from an index."""
    lengths = ix.groupBy("doc").agg(F.first("doc_len").alias("doc_len"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("doc_len").alias("avg_len"))
    return _bm25(ix.where(F.col("term").isin(wanted)), corpus, k1, b)


def bm25_texts(docs: DataFrame, id_col: str, text: Column, wanted: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """As ``bm25``, from the texts: only occurrences of the wanted terms leave the
    scan, so nothing else is exploded or shuffled."""
    words = docs.select(F.col(id_col).alias("doc"), terms(text).alias("w")).where(F.size("w") > 0)
    corpus = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("avg_len"))
    found = words.select("doc", F.size("w").alias("doc_len"), F.explode(F.filter("w", lambda t: t.isin(wanted))).alias("term"))
    return _bm25(found.groupBy("term", "doc").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len")), corpus, k1, b)


def _bm25(hit: DataFrame, corpus: DataFrame, k1: float, b: float) -> DataFrame:
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    x = hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))  # a row for each wanted term, and one
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    return x.groupBy("doc").agg(F.round(F.sum(score), 6).alias("score"))


def snippet(text: Column, term: str, width: int = 60) -> Column:
    """What surrounds the first hit of a term."""
    at = F.locate(term, F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(at - width // 2, F.lit(1)), F.lit(width)))


@lru_cache(1 << 19)
def stem(word: str) -> str:
    """The Porter stemmer, by its published steps."""
    if len(word) <= 2:
        return word
    vowel = lambda w, i: w[i] in "aeiou" or (w[i] == "y" and i > 0 and not vowel(w, i - 1))

    def m(w: str) -> int:
        marks = "".join("v" if vowel(w, i) else "c" for i in range(len(w)))
        return sum(a == "v" and b == "c" for a, b in zip(marks, marks[1:]))

    has_vowel = lambda w: any(vowel(w, i) for i in range(len(w)))
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and not vowel(w, len(w) - 1)
    cvc = lambda w: len(w) > 2 and not vowel(w, len(w) - 1) and vowel(w, len(w) - 2) and not vowel(w, len(w) - 3) and w[-1] not in "wxy"

    def swap(w: str, pairs, least: int) -> str:
        for end, new in pairs:
            if w.endswith(end):
                head = w[: -len(end)]
                return head + new if m(head) > least else w
        return w

    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif m(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = swap(w, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")), 0)
    w = swap(w, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")), 0)
    for end in ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"):
        if w.endswith(end):
            head = w[: -len(end)]
            if m(head) > 1 and (end != "ion" or head.endswith(("s", "t"))):
                w = head
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if m(w) > 1 and double(w) and w.endswith("l") else w


def stems(text: Column) -> Column:
    """The distinct stems of a text's folded words: a word is stemmed once a text, and
    once a task as long as it is remembered."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [] if t is None else list({stem(w) for w in set(_RUNS.findall(_plain(t)))}))

    return run(text)


def stemmed(words: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run(words)
