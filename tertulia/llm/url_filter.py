"""URL verdicts: rules by host and path, and a word model for urls without a rule.

Host names are often words written together.  A unigram Viterbi search splits
their labels with word counts from the whole table (page titles, path words and
parts of hyphenated labels); multinomial naive Bayes, learned from the urls
that rules decide, then scores the words of host and path.

Word counts stay a table with every word: the substrings of each distinct host,
under a 128-bit number of the host, are joined with it, and a host is split with
the counts of its own substrings, so nothing is gathered and a host may have any
length.  The words of naive Bayes are hashed to ``CELLS`` cells.

A null url, or one without ``://``, has an empty host and path and no words.
Equal urls get equal verdicts.  Without learned urls of a kind the other kind
is the verdict; without any it is allow.  Extra columns are dropped, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize
from .common import small_batches

CELLS = 1 << 16
LONGEST_WORD = 24
PIECES = 50_000  # substrings of hosts handed on at once
# verdict, host, path
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_WORD = re.compile(r"[^\W\d_]+|\d+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    shape = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    piece = lambda k: F.coalesce(F.regexp_extract(url, shape, k), F.lit(""))
    return F.translate(piece(1), _UPPER, _LOWER), piece(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host + path) and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def word_counts(pages: DataFrame, host: str, path: str, html: str | None) -> DataFrame:
    """Columns word and n: counts of all words over all rows."""
    sources = [F.split(F.lower(path), r"[^\p{L}]+"),
               F.flatten(F.transform(F.filter(F.split(host, r"\."), lambda x: x.contains("-")), lambda x: F.split(x, "[^a-z]+")))]
    if html:
        sources.append(F.split(F.lower(F.coalesce(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))), r"[^\p{L}]+"))
    words = pages.select(F.explode(F.concat(*sources)).alias("word")).filter(F.length("word").between(2, LONGEST_WORD))
    return words.groupBy("word").agg(F.count("*").alias("n"))


class Segmenter:
    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total``: the sum of all counts, if ``counts`` are a part of them."""
        self.total = max(1, sum(counts.values()) if total is None else total)
        self.score = {w: math.log(n / self.total) for w, n in counts.items()}

    def unknown(self, length: int) -> float:
        return math.log(10 / self.total) - length * math.log(10)

    def split(self, name: str) -> list[str]:
        """The most likely words of a name; a stretch without words stays whole.  Of equal splits the one with longer first words."""
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            top, at = -math.inf, 0
            for begin in range(max(0, end - LONGEST_WORD), end):
                s = best[begin] + self.score.get(name[begin:end], self.unknown(end - begin))
                if s > top:
                    top, at = s, begin
            best.append(top), back.append(at)
        out, end = [], len(name)
        while end:
            out.append(name[back[end]:end])
            end = back[end]
        return out[::-1]

    def words(self, host: str) -> list[str]:
        return [w for x in _WORD.findall(host) for w in (["#"] if x.isdigit() else self.split(x))]


def substrings(host: str):
    """What a split of the host's names may ask the word table for; some come more than once."""
    for x in _WORD.findall(host):
        if not x.isdigit():
            for a in range(len(x)):
                for b in range(a + 2, min(len(x), a + LONGEST_WORD) + 1):
                    yield x[a:b]


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``words`` of every host (a table of distinct hosts), from the counts of its own substrings."""
    total = counts.agg(F.sum("n")).first()[0] or 0

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], names=["hid", "word"])

    def cut(batches):
        """Each substring with its host's number only: a host of any length is as many short rows."""
        found = set()
        for b in batches:
            for hid, h in zip(b.column("hid").to_pylist(), b.column("host").to_pylist()):
                for w in substrings(h):
                    found.add((hid, w))
                    if len(found) >= PIECES:
                        yield batch(found)
                        found = set()
        yield batch(found)

    def segment(batches):
        for b in batches:
            words = [Segmenter({k["word"]: k["n"] for k in known or ()}, total).words(h) for h, known in zip(b.column("host").to_pylist(), b.column("known").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(words, pa.list_(pa.string()))], names=["host", "host_words"])

    named = hosts.select("host", F.unhex(F.md5("host")).alias("hid"))
    known = small_batches(named).mapInArrow(cut, "hid binary, word string").join(counts, "word").groupBy("hid").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return small_batches(named.join(known, "hid", "left").select("host", "known")).mapInArrow(segment, "host string, host_words array<string>")


def words_of(parsed: DataFrame, counts: DataFrame, out: str) -> DataFrame:
    """Adds the words of host and path."""
    hosts = materialize(host_words(parsed.select("host").distinct(), materialize(counts, "counts")), "hosts")
    names = parsed.columns
    schema = T.StructType([*parsed.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])

    def run(batches):
        for b in batches:
            words = [[*h, *("#" if x.isdigit() else x for x in _WORD.findall(p.lower()))] for h, p in zip(b.column("host_words").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(words, pa.list_(pa.string()))], names=[*names, out])

    return parsed.join(hosts, "host").select(*names, "host_words").mapInArrow(run, schema)


def cell_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(CELLS)).cast("int")


def learn(worded: DataFrame) -> np.ndarray:
    """Log odds of block against allow per cell, and the prior odds in the last entry.

    Urls are first counted by words and verdict, so a frequent host is few rows.
    """
    known = worded.filter(F.col("rule_verdict").isNotNull()).groupBy("words", "rule_verdict").agg(F.count("*").alias("n"))
    block = F.col("rule_verdict") == "block"
    tokens = known.select(F.explode(F.transform("words", cell_of)).alias("cell"), block.alias("block"), "n").groupBy("cell", "block").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, CELLS))
    for r in tokens.toLocalIterator():
        counts[int(r["block"]), r["cell"]] = r["n"]
    urls = known.groupBy(block.alias("block")).agg(F.sum("n").alias("n")).collect()
    seen = {bool(r["block"]): r["n"] for r in urls}
    odds = np.zeros(CELLS + 1)
    if not seen.get(True):
        odds[-1] = -math.inf
    elif not seen.get(False):
        odds[-1] = math.inf
    else:
        odds[:-1] = np.log((counts[1] + 1) / (counts[1].sum() + CELLS)) - np.log((counts[0] + 1) / (counts[0].sum() + CELLS))
        odds[-1] = math.log(seen[True] / seen[False])
    return odds


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str | None = "html", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """key, host, path, rule, verdict and block_odds (the model's log odds of block) of every row."""
    host, path = parts(F.col(url))
    named = pages.select(F.col(key), host.alias("host"), path.alias("path"), *([F.col(html).alias("html")] if html else []))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    counts = word_counts(named, "host", "path", "html" if html else None)
    parsed = named.select(key, "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))
    worded = materialize(words_of(parsed, counts, "words"), "words")
    odds = learn(worded)
    names = [key, "host", "path", "rule"]
    schema = T.StructType([*[parsed.schema[c] for c in names], T.StructField("verdict", T.StringType()), T.StructField("block_odds", T.DoubleType())])

    def run(batches):
        for b in batches:
            values, ends = b.column("cells").flatten().to_numpy(), np.cumsum([len(c) for c in b.column("cells").to_pylist()])
            sums = np.concatenate([[0.0], np.cumsum(odds[values])])
            score = sums[ends] - sums[np.concatenate([[0], ends[:-1]]).astype(np.int64)] + odds[-1] if len(ends) else np.zeros(0)
            by_model = np.where(score > 0, "block", "allow").tolist()
            decided = [r or m for r, m in zip(b.column("rule_verdict").to_pylist(), by_model)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(decided, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return worded.select(*names, "rule_verdict", F.transform("words", cell_of).alias("cells")).mapInArrow(run, schema)
