"""Pattern extraction: messages to the long table of hits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.reuse import once_per_application
from ..rules.patterns import BY_KEY, MONEY_BRANCHES, PatternRule

HIT = "array<struct<category:string,key:string,ord:int,value:string,groups:array<string>>>"
_SEP = "\u0001"


_NO_GROUPS = "cast(array() as array<string>)"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _groups_of(hit: str, regex: str, n: int) -> str:
    """All groups of one hit in one pass: rewrite it to the groups, split again."""
    refs = _SEP.join(f"${i}" for i in range(1, n + 1))
    return f"split(regexp_replace({hit}, {_sql(regex)}, {_sql(refs)}), {_sql(_SEP)})"


def _hits(text: str, rule: PatternRule) -> str:
    """Hits of one rule as an array of structs, as SQL; the cheap tests run first."""
    lists = []
    for regex in rule.java():
        raw = f"regexp_extract_all({text}, {_sql(regex)}, 0)"
        if rule.groups == 0:
            lists.append(f"transform({raw}, h -> named_struct('value', h, 'groups', {_NO_GROUPS}))")
            continue
        pairs = f"transform({raw}, h -> named_struct('h', h, 'g', {_groups_of('h', regex, rule.groups)}))"
        if rule.key == "monedas_explicitas":
            lists.append(f"transform({pairs}, p -> {_amount_and_currency('p.g')})")
        else:
            value = {"whole": "p.h", "group": "get(p.g, 0)", "tuple": "array_join(filter(p.g, x -> x <> ''), ' ')"}[rule.value]
            lists.append(f"transform({pairs}, p -> named_struct('value', {value}, 'groups', p.g))")
    found = lists[0] if len(lists) == 1 else "concat(" + ", ".join(lists) + ")"
    out = (f"transform({found}, (f, i) -> named_struct('category', {_sql(rule.category)}, 'key', {_sql(rule.key)}, "
           "'ord', i, 'value', f.value, 'groups', f.groups))")
    may = _may_match(rule)
    return f"CASE WHEN {may} THEN {out} ELSE cast(array() as {HIT}) END" if may else out


def _amount_and_currency(g: str) -> str:
    """Nine branch groups to [amount, currency, branch key]; a spelled range becomes 'a-b'."""
    at = lambda i: f"get({g}, {i})"
    branches = [(0, at(0), at(1)), (2, f"concat({at(2)}, '-', {at(3)})", at(4)), (5, at(5), at(6)), (7, at(7), at(8))]
    pick = lambda k: "CASE " + " ".join(f"WHEN {at(b[0])} <> '' THEN {b[k]}" for b in branches) + " END"
    name = "CASE " + " ".join(f"WHEN {at(b[0])} <> '' THEN '{key}'" for b, key in zip(branches, MONEY_BRANCHES)) + " END"
    amount, currency = f"trim({pick(1)})", f"trim({pick(2)})"
    return f"named_struct('value', concat_ws(' ', {amount}, {currency}), 'groups', array({amount}, {currency}, {name}))"


def _may_match(rule: PatternRule) -> str:
    """Cheap test on a prepared text that is true whenever the rule can hit, as SQL; empty when there is none."""
    tests = []
    if rule.needs:
        tests.append("(" + " OR ".join(f"contains(_fold, {_sql(x)})" for x in rule.needs) + ")")
    if rule.digit:
        tests.append("_digit")
    return " AND ".join(tests)


def prepared(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds what the cheap tests of the rules read, worked out once per text.

    Folding is the one the regex engine uses for ignore-case matching, so the
    tests never lose a hit.
    """
    return df.withColumns({"_fold": F.lower(F.upper(text)), "_digit": F.regexp_like(text, F.lit(r"(?U)\d"))})


@once_per_application
def _rule_hits(text: str, key: str) -> Column:
    return F.expr(_hits(text, BY_KEY[key]))


@once_per_application
def _rule_count(text: str, key: str) -> Column:
    rule = BY_KEY[key]
    n = " + ".join(f"regexp_count({text}, {_sql(j)})" for j in rule.java())
    may = _may_match(rule)
    return F.expr(f"CASE WHEN {may} THEN {n} ELSE 0 END" if may else n)


def match_array(text: str, keys: Iterable[str] | None = None) -> Column:
    """All hits of a prepared text column as one array, rules in their fixed order."""
    return F.concat(*[_rule_hits(text, k) for k in (BY_KEY if keys is None else keys)])


def extract_matches(messages: DataFrame, keys: Iterable[str] | None = None, text: str = "text") -> DataFrame:
    """The ``matches`` fact table: one row per hit, the message columns kept.

    Only the rules asked for are evaluated.  A narrow, shuffle-free job.  The
    array is a column of its own before it is exploded, and exploded as outer,
    so that it is compiled and worked out once.
    """
    keep = [c for c in messages.columns if c != text]
    arrays = prepared(messages, text).withColumn("_hits", match_array(text, keys))
    hits = arrays.select(*keep, F.explode_outer("_hits").alias("h")).filter(F.col("h").isNotNull())
    return hits.select(*keep, "h.category", "h.key", "h.ord", "h.value", "h.groups")


def with_money_branches(matches: DataFrame) -> DataFrame:
    """Repeat each explicit-money hit under the key of the branch that found it."""
    money = F.col("key") == "monedas_explicitas"
    keys = F.when(money, F.array(F.col("key"), F.get("groups", F.lit(2)))).otherwise(F.array("key"))
    return matches.withColumn("key", F.explode(keys))


def pattern_counts(text: str, keys: Iterable[str] | None = None) -> dict[str, Column]:
    """Hit counts per key of a prepared text; counts need no groups."""
    return {k: _rule_count(text, k) for k in (BY_KEY if keys is None else keys)}


def enrich_text(messages: DataFrame, text: str = "text", name: str = "enriched") -> DataFrame:
    """Adds the text with a bracketed count of what it holds, unchanged when it holds nothing."""
    n = pattern_counts(text)
    source, text = text, F.col(text)
    ranges = F.size(F.filter(_rule_hits(source, "monedas_explicitas"),
                             lambda h: F.get(h["groups"], F.lit(2)) == "currency_ranges"))
    money = n["monedas_explicitas"] + n["precios_implicitos"] + ranges
    dates = sum((n[k] for k in n if k.startswith("dates_")), F.lit(0))
    parts = [
        (money, "referencias monetarias"), (dates, "referencias de fecha"), (n["emails"], "emails"),
        (n["phone_numbers"], "teléfonos"), (n["urls_raw"], "enlaces"), (n["hashtags"], "hashtags"),
        (n["mentions"], "menciones"),
    ]
    found = F.concat_ws(", ", *[F.when(c > 0, F.concat_ws(" ", c.cast("string"), F.lit(w))) for c, w in parts])
    full = F.when(found == "", text).otherwise(F.concat(text, F.lit(" [Patrones: "), found, F.lit("]")))
    return prepared(messages, source).withColumn(name, full).select(*messages.columns, name)


def valid_patterns(spark: SparkSession, patterns: dict[str, str]) -> dict[str, str]:
    """The user patterns that compile; the others are dropped."""
    compile_ = spark._jvm.java.util.regex.Pattern.compile
    good = {}
    for name, regex in patterns.items():
        try:
            compile_(regex)
            good[name] = regex
        except Exception:
            continue
    return good


def named_matches(messages: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """Hits of named user patterns, ignore-case; the value is the first non-empty group, else the hit."""
    patterns = valid_patterns(messages.sparkSession, patterns)
    keep = [c for c in messages.columns if c != text]
    arrays = []
    for name, regex in patterns.items():
        java = "(?iU)" + regex
        arrays.append(named_hits(F.col(text), name, java, _group_count(messages.sparkSession, java)))
    if not arrays:
        arrays = [F.array().cast("array<struct<name:string,ord:int,value:string>>")]
    return messages.select(*keep, F.explode(F.concat(*arrays)).alias("h")).select(*keep, "h.*")


def named_hits(text: Column, name: str, java: str, n: int) -> Column:
    """Hits of one pattern with n groups.

    Groups are taken where the pattern matched in the text, so what stands
    around a hit still counts for look-ahead and look-behind.
    """
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(java), F.lit(k)).alias(f"g{k}") for k in range(n + 1)])

    def one(m, i):
        groups = [F.when(m[f"g{k}"] != "", m[f"g{k}"]) for k in range(1, n + 1)]
        return F.struct(F.lit(name).alias("name"), i.alias("ord"), F.coalesce(*groups, m["g0"]).alias("value"))

    return F.transform(found, one)


def _group_count(spark: SparkSession, regex: str) -> int:
    return spark._jvm.java.util.regex.Pattern.compile(regex).matcher("").groupCount()


def custom_matches(messages: DataFrame, regexes: list[str], text: str = "text") -> DataFrame:
    return named_matches(messages, {f"custom_pattern_{i}": r for i, r in enumerate(regexes)}, text)


def key_summary(matches: DataFrame, by: tuple[str, ...] = (), key: str = "key",
                order: tuple[str, ...] = ("id", "ord"), distinct: bool = False, shown: int = 3) -> DataFrame:
    """Per key: number of hits and a line with the first examples and the remainder.

    Only `shown` rows per key leave the map side for the examples; with
    `distinct`, a value is represented by its first position.
    """
    from .ranking import top_k

    keys = [*by, key]
    counts = matches.groupBy(*keys).agg(F.count("*").alias("n"))
    rows = matches
    if distinct:
        rows = rows.groupBy(*keys, "value").agg(F.min(F.struct(*order)).alias("_o")).select(*keys, "value", "_o.*")
    first = (
        top_k(rows, keys, list(order), shown)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(*order, "value"))).alias("s"))
        .select(*keys, F.array_join(F.transform("s", lambda x: x["value"]), ", ").alias("examples"))
    )
    more = F.when(F.col("n") > shown, F.format_string(" y %d más", F.col("n") - shown)).otherwise("")
    return counts.join(first, keys).select(
        *keys, F.col("n"), F.concat("examples", more).alias("examples")
    )
