"""Quality rules whose thresholds follow the corpus, by language and source.

Four whole-number metrics of a text are summarised in quantile sketches:
histograms over values rounded down to six binary digits (error under 4 %).
Sketches of parts merge by adding counts, so a source's sketch is the sum of
what tasks counted, a language's the sum of its sources, the corpus' the sum of
its languages.  A group's thresholds come from its own sketch if it holds
enough texts, else from its language's, else from the corpus'.  A text is
rejected if it fails the base rules or lies far outside the middle half of its
group.  Only DataFrame functions are used.

Null and empty texts have no words and fail the base rules.  Null languages
and sources are groups like others.  Equal rows get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize
from .common import free_name, let

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WIDTH = 8  # words in a repeated window
MIN_GROUP = 200  # texts from which a group has thresholds of its own
SPREADS = 6  # interquartile ranges beyond the quartiles
# metric: (kept distance beyond the quartiles at least, lower bound too)
METRICS = {
    "word_length": (300, True),  # hundredths of code points per word
    "symbol_share": (50, False),  # thousandths of word code points
    "dup_line_share": (500, False),  # thousandths of lines with a word
    "repeat_share": (300, False),  # thousandths of words
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that the text has more than once."""

    def covered(places: Column) -> Column:
        gap = F.transform(places, lambda p, k: F.least(F.lit(WIDTH), F.coalesce(F.get(places, k + 1), p + WIDTH) - p))
        return F.aggregate(gap, F.lit(0).cast("bigint"), lambda a, g: a + g)

    def repeated(windows: Column) -> Column:
        marked = F.array_sort(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        twice = lambda s: F.filter(s, lambda x, k: F.coalesce(
            (F.get(s, k - 1)["h"] == x["h"]) | F.lit(False), F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        places = let(marked, lambda s: F.array_sort(F.transform(twice(s), lambda x: x["k"])))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(let(places, covered))

    def from_hashes(hashes: Column) -> Column:
        n = F.size(hashes)
        windows = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WIDTH)]))
        return F.when(n < WIDTH, F.lit(0).cast("bigint")).otherwise(let(windows, repeated))

    return let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus struct ``measured``: base counts, base_failed and metrics.  Narrow."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(BLANK)) != "")
    chars = F.length(F.translate(body, BLANK, ""))
    parts = F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"),
                                      (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("x"),
        chars.cast("bigint").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )

    def finish(p: Column) -> Column:
        n, repeat = p["w"]["n_words"], p["w"]["n_repeat_words"]
        share = lambda a, b, unit: F.floor(a * unit / F.greatest(b, F.lit(1)))
        return F.struct(
            n.alias("n_words"), p["word_chars"].alias("word_chars"), p["n_symbols"].alias("n_symbols"),
            p["x"]["n_dup_lines"].alias("n_dup_lines"), repeat.alias("n_repeat_words"),
            ((n < MIN_WORDS) | (repeat * 100 > n * MAX_REPEAT_PERCENT)).alias("base_failed"),
            share(p["word_chars"], n, 100).alias("word_length"), share(p["n_symbols"], p["word_chars"], 1000).alias("symbol_share"),
            share(p["x"]["n_dup_lines"], p["x"]["n_lines"], 1000).alias("dup_line_share"), share(repeat, n, 1000).alias("repeat_share"))

    return docs.withColumn("measured", let(parts, finish))


def cell(v: Column) -> Column:
    """The sketch's cell of a whole number from 0: its six leading binary digits."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(measured: DataFrame, group: list[str]) -> DataFrame:
    """Counts per group, metric and cell, of texts that pass the base rules; rows stay few whatever the group's size."""
    m = F.col("measured")
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), cell(m[k]).alias("cell")) for k in METRICS])).alias("v")
    return measured.filter(~m["base_failed"]).select(*group, values).groupBy(*group, "v.metric", "v.cell").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, group: list[str]) -> DataFrame:
    return sketch.groupBy(*group, "metric", "cell").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Per group: number of texts, and per metric the cells at one and three quarters (columns <metric>_q1, <metric>_q3)."""
    keys = W.partitionBy(*group, "metric")
    at = sketch.withColumn("up_to", F.sum("n").over(keys.orderBy("cell"))).withColumn("total", F.sum("n").over(keys))
    first = lambda q: F.min(F.when(F.col("up_to") * 4 >= F.col("total") * q, F.col("cell")))
    per_metric = at.groupBy(*group, "metric").agg(F.max("total").alias("total"), first(1).alias("q1"), first(3).alias("q3"))
    pick = lambda k, c: F.max(F.when(F.col("metric") == k, F.col(c)))
    return per_metric.groupBy(*group).agg(
        F.max("total").alias("texts"), *[pick(k, c).alias(f"{k}_{c}") for k in METRICS for c in ("q1", "q3")])


def thresholds(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Per language and source: lang, source and the bounds <metric>_low, <metric>_high."""
    own_sketch = materialize(sketches(measured, [lang, source]).withColumnsRenamed({lang: "lang", source: "source"}), "sketch")
    own = quartiles(own_sketch, ["lang", "source"])
    by_lang = quartiles(merged(own_sketch, ["lang"]), ["lang"]).withColumnRenamed("lang", "of_lang")
    corpus = quartiles(merged(own_sketch, []).withColumn("all", F.lit(1)), ["all"]).drop("all")
    prefixed = lambda df, p: df.select(*[F.col(c).alias(c if c == "of_lang" else p + c) for c in df.columns])
    joined = own.join(prefixed(by_lang, "l_"), F.col("lang").eqNullSafe(F.col("of_lang"))).crossJoin(F.broadcast(prefixed(corpus, "c_")))  # one row
    out = [F.col("lang"), F.col("source")]
    for k, (slack, lower) in METRICS.items():
        pick = lambda c: (F.when(F.col("texts") >= MIN_GROUP, F.col(f"{k}_{c}"))
                          .when(F.col("l_texts") >= MIN_GROUP, F.col(f"l_{k}_{c}")).otherwise(F.col(f"c_{k}_{c}")))
        reach = F.greatest((pick("q3") - pick("q1")) * SPREADS, F.lit(slack))
        out.append((pick("q3") + reach).alias(f"{k}_high"))
        out.append((pick("q1") - reach if lower else F.lit(None).cast("bigint")).alias(f"{k}_low"))
    return joined.select(*out)


def judge(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` plus boolean ``kept``.  Reads its input twice: store it first if measuring is dear and the rows are narrow.

    A group without a text that passes the base rules has no thresholds and
    keeps nothing, since none of its texts passes.
    """
    names = {c: free_name(measured, f"bound_{c}") for c in ("lang", "source")}
    bounds = thresholds(measured, lang, source).withColumnsRenamed(names)
    m = F.col("measured")
    inside = ~m["base_failed"]
    for k, (_, lower) in METRICS.items():
        inside &= m[k] <= F.col(f"{k}_high")
        if lower:
            inside &= m[k] >= F.col(f"{k}_low")
    on = measured[lang].eqNullSafe(bounds[names["lang"]]) & measured[source].eqNullSafe(bounds[names["source"]])
    return measured.join(bounds, on, "left").select(
        *[measured[c] for c in measured.columns], F.coalesce(inside, F.lit(False)).alias("kept"))


def quality_rules(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged.

    ``docs`` may hold a column ``measured`` or ``kept``: names inside are its own.
    """
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    kept = judge(measure(own, names[text]), names[lang], names[source]).filter("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def verdicts(docs: DataFrame, key: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """key, base counts, base_failed and kept of every row."""
    narrow = materialize(measure(docs.select(key, lang, source, text), text).drop(text), "measured")
    return judge(narrow, lang, source).select(key, *[F.col("measured")[c].alias(c) for c in [*BASE, "base_failed"]], "kept")


def oracle_sql() -> str:
    blank = r"[\x20\x09-\x0D]+"
    cell_sql = "(CAST({v} AS BIGINT) >> greatest(length(bin(CAST({v} AS BIGINT))) - 6, 0)) << greatest(length(bin(CAST({v} AS BIGINT))) - 6, 0)"
    values = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {cell_sql.format(v=k)} AS cell FROM metrics WHERE NOT base_failed" for k in METRICS)
    level = lambda name, keys: f"""
{name}_at AS (SELECT {keys} metric, cell, total, sum(n) OVER (PARTITION BY {keys} metric ORDER BY cell) AS up_to
  FROM (SELECT {keys} metric, cell, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY {keys} metric) AS total FROM sketch GROUP BY {keys} metric, cell)),
{name} AS (SELECT {keys} max(total) AS texts, {", ".join(f"min(cell) FILTER (metric = '{k}' AND up_to * 4 >= total * {q}) AS {k}_q{q}" for k in METRICS for q in (1, 3))}
  FROM {name}_at {"GROUP BY " + keys.rstrip(", ") if keys else ""})"""
    pick = lambda k, q: f"(CASE WHEN o.texts >= {MIN_GROUP} THEN o.{k}_q{q} WHEN l.texts >= {MIN_GROUP} THEN l.{k}_q{q} ELSE c.{k}_q{q} END)"
    tests = []
    for k, (slack, lower) in METRICS.items():
        reach = f"greatest(({pick(k, 3)} - {pick(k, 1)}) * {SPREADS}, {slack})"
        tests.append(f"m.{k} <= {pick(k, 3)} + {reach}")
        if lower:
            tests.append(f"m.{k} >= {pick(k, 1)} - {reach}")
    windows = "[" + ", ".join(f"words[i + {j}]" for j in range(WIDTH)) + "]"
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
places AS (SELECT r, i, {windows} AS part FROM (SELECT r, words, unnest(range(1, len(words) - {WIDTH - 2})) AS i FROM texts)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, part) AS c FROM places) WHERE c > 1),
covered AS (SELECT r, sum(least({WIDTH}, coalesce(following - i, {WIDTH}))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM twice) GROUP BY r),
counts AS (SELECT t.r, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(body, '{blank}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(body) - length(translate(body, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM texts t LEFT JOIN covered c ON t.r = c.r),
metrics AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    100 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_share,
    1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_share, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_share FROM counts),
sketch AS (SELECT lang, source, metric, cell, count(*) AS n FROM ({values}) GROUP BY lang, source, metric, cell),
{level("own", "lang, source,")}, {level("by_lang", "lang,")}, {level("corpus", "")}
SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed,
       coalesce(NOT m.base_failed AND {" AND ".join(tests)}, false) AS kept
FROM metrics m LEFT JOIN own o ON m.lang IS NOT DISTINCT FROM o.lang AND m.source IS NOT DISTINCT FROM o.source
LEFT JOIN by_lang l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN corpus c"""
