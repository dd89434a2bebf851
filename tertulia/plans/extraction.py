"""Queries of pattern extraction and pattern summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matches as M, summaries as S
from ..rules.patterns import BY_KEY, PREDEFINED, ALARM_PATTERNS, LINK_PATTERNS, RULES, CURRENCIES
from .inputs import CONVERSATION_MESSAGES, EVENT_MESSAGES, _q, event_messages, table, text_table
from .registry import query

TEXTS = EVENT_MESSAGES + """,
texts AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text FROM documents
          UNION ALL SELECT 'e' || CAST(id AS VARCHAR), text FROM messages)"""


def texts(spark, d):
    docs = text_table(spark, d, "documents", "doc_id", "text").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    ev = event_messages(spark, d).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), "text")
    return docs.unionByName(ev)


def re2(regex: str, ignore_case: bool) -> str:
    """The rule in RE2 spelling: Unicode word class, no look-ahead."""
    r = regex.replace("(?!\\w)", "").replace("\\w", "[\\p{L}\\p{N}_]")
    return ("(?i)" if ignore_case else "") + r


def hits_sql(rule, text="text") -> str:
    """List of hit values of one rule in DuckDB."""
    if rule.key == "isbn_codes":  # the only look-ahead branch that occurs in the tables
        return f"regexp_extract_all({text}, '\\b(?:ISBN(?:-1[03])?:? )?97[89][0-9]{{10}}$')"
    if rule.key == "all_caps_words":
        return f"list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z]{{3,}}'))"
    if rule.key == "repeated_letters":  # last run of three or more in each word
        run = "list_filter(range(1, length(w) - 1), lambda i: w[i] = w[i+1] and w[i] = w[i+2])"
        return (f"list_filter(list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'), "
                f"lambda w: w[list_max({run})]), lambda x: x IS NOT NULL)")
    lists = []
    for regex in rule.regexes:
        r = _q(re2(regex, rule.ignore_case))
        if rule.key == "monedas_explicitas":
            g = [f"regexp_extract_all({text}, {r}, {i})" for i in range(1, 10)]
            z = f"list_zip({', '.join(g)})"
            lists.append(
                f"list_transform({z}, lambda t: CASE WHEN t[1] <> '' THEN trim(t[1]) || ' ' || t[2] "
                f"WHEN t[3] <> '' THEN t[3] || '-' || t[4] || ' ' || t[5] "
                f"WHEN t[6] <> '' THEN t[6] || ' ' || t[7] ELSE t[8] || ' ' || t[9] END)")
        elif rule.value == "tuple":
            g = [f"regexp_extract_all({text}, {r}, {i})" for i in range(1, rule.groups + 1)]
            items = ", ".join(f"t[{i}]" for i in range(1, rule.groups + 1))
            lists.append(f"list_transform(list_zip({', '.join(g)}), lambda t: "
                         f"array_to_string(list_filter([{items}], lambda x: x <> ''), ' '))")
        else:
            lists.append(f"regexp_extract_all({text}, {r}, {1 if rule.value == 'group' else 0})")
    return lists[0] if len(lists) == 1 else f"list_concat(list_concat({lists[0]}, {lists[1]}), {lists[2]})"


def _rule_sql(rule) -> str:
    return (f"WITH {TEXTS}, h AS (SELECT id, {hits_sql(rule)} AS a FROM texts)\n"
            "SELECT id, CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS ord, unnest(a) AS value FROM h")


def _rule_query(key):
    def run(spark, d):
        return M.extract_matches(texts(spark, d), [key]).select("id", F.col("ord").cast("long").alias("ord"), "value")

    return run


# Query numbers of the rules: basic 1-19, money 20 and up, dates 33-46.
_NUMBER = {r.key: i for i, r in enumerate(RULES[:21], 1)}
_NUMBER |= {"currency_with_symbols": 24, "currency_decimal": 27, "price_changes": 28, "labeled_prices": 29,
            "preposition_prices": 30, "discounts_percent": 31, "discounts_absolute": 32}
_NUMBER |= {r.key: i for i, r in enumerate(RULES[-14:], 33)}
for _rule in RULES:
    query(f"r{_NUMBER[_rule.key]:02d}_{_rule.key}", _rule_sql(_rule))(_rule_query(_rule.key))


def _branch_sql(i) -> str:
    r = _q(re2(BY_KEY["monedas_explicitas"].regexes[0], True))
    test, amount, cur = [("1", "trim(t[1])", "t[2]"), ("3", "t[3] || '-' || t[4]", "t[5]"),
                         ("6", "t[6]", "t[7]"), ("8", "t[8]", "t[9]")][i]
    g = ", ".join(f"regexp_extract_all(text, {r}, {k})" for k in range(1, 10))
    return (f"WITH {TEXTS}, h AS (SELECT id, list_zip({g}) AS a FROM texts), "
            "u AS (SELECT id, generate_subscripts(a, 1) - 1 AS ord, unnest(a) AS t FROM h)\n"
            f"SELECT id, CAST(ord AS BIGINT) AS ord, {amount} AS amount, {cur} AS currency FROM u WHERE t[{test}] <> ''")


def _branch_query(key):
    def run(spark, d):
        hits = M.with_money_branches(M.extract_matches(texts(spark, d), ["monedas_explicitas"]))
        return hits.filter(F.col("key") == key).select(
            "id", F.col("ord").cast("long").alias("ord"),
            F.get("groups", F.lit(0)).alias("amount"), F.get("groups", F.lit(1)).alias("currency"))

    return run


for _i, (_n, _key) in enumerate(zip([22, 23, 25, 26], M.MONEY_BRANCHES)):
    query(f"r{_n}_{_key}", _branch_sql(_i))(_branch_query(_key))

# All rules at once over every text: hits and distinct values per rule.
_ALL = " UNION ALL ".join(f"SELECT '{r.key}' AS key, unnest({hits_sql(r)}) AS value FROM texts" for r in RULES)


@query("r00_all_matches", f"""WITH {TEXTS}, h AS ({_ALL})
SELECT key, count(*) AS hits, count(DISTINCT value) AS distinct_values FROM h GROUP BY key""")
def r00(spark, d):
    h = M.extract_matches(texts(spark, d)).groupBy("key", "value").agg(F.count("*").alias("n"))
    return h.groupBy("key").agg(F.sum("n").alias("hits"), F.count("*").alias("distinct_values"))


def _len(key):
    return f"len({hits_sql(BY_KEY[key])})"


_DATE_SUM = " + ".join(_len(r.key) for r in RULES if r.key.startswith("dates_"))
_RANGE = f"len(list_filter(regexp_extract_all(text, {_q(re2(BY_KEY['monedas_explicitas'].regexes[0], True))}, 1), lambda x: x <> ''))"


@query("r47_enriched_text", f"""WITH {EVENT_MESSAGES}, c AS (
  SELECT id, text, {_len('monedas_explicitas')} + {_len('precios_implicitos')} + {_RANGE} AS money,
         {_DATE_SUM} AS dates, {_len('emails')} AS emails, {_len('phone_numbers')} AS phones,
         {_len('urls_raw')} AS urls, {_len('hashtags')} AS tags, {_len('mentions')} AS ments FROM messages),
p AS (SELECT id, text, array_to_string(list_filter([
    CASE WHEN money > 0 THEN money || ' referencias monetarias' END, CASE WHEN dates > 0 THEN dates || ' referencias de fecha' END,
    CASE WHEN emails > 0 THEN emails || ' emails' END, CASE WHEN phones > 0 THEN phones || ' teléfonos' END,
    CASE WHEN urls > 0 THEN urls || ' enlaces' END, CASE WHEN tags > 0 THEN tags || ' hashtags' END,
    CASE WHEN ments > 0 THEN ments || ' menciones' END], lambda x: x IS NOT NULL), ', ') AS s FROM c)
SELECT id, CASE WHEN s = '' THEN text ELSE text || ' [Patrones: ' || s || ']' END AS enriched FROM p""")
def r47(spark, d):
    return M.enrich_text(event_messages(spark, d)).select("id", "enriched")


def _named_sql(patterns) -> str:
    parts = []
    for name, regex in patterns.items():
        if name == "📚 Códigos ISBN":
            hits = hits_sql(BY_KEY["isbn_codes"])
        else:
            groups = 1 if name == "🗓️ Fechas español" else 0
            hits = f"regexp_extract_all(text, {_q(re2(regex, True))}, {groups})"
        parts.append(f"SELECT {_q(name)} AS name, unnest({hits}) AS value FROM messages")
    return (f"WITH {EVENT_MESSAGES}, h AS ({' UNION ALL '.join(parts)})\n"
            "SELECT name, value, count(*) AS n FROM h GROUP BY name, value")


def _named(patterns):
    def run(spark, d):
        hits = M.named_matches(event_messages(spark, d).select("id", "text"), patterns)
        return hits.groupBy("name", "value").agg(F.count("*").alias("n"))

    return run


query("r48_alarm_catalogue", _named_sql(ALARM_PATTERNS))(_named(ALARM_PATTERNS))
query("r49_link_catalogue", _named_sql(LINK_PATTERNS))(_named(LINK_PATTERNS))

_CUSTOM = [r"vendo (\w+)", r"(sin cierre", r"oferta\d+"]


@query("r50_custom_patterns", f"""WITH {EVENT_MESSAGES}, h AS (
  SELECT 'custom_pattern_0' AS name, unnest(regexp_extract_all(text, '(?i)vendo (\\w+)', 1)) AS value FROM messages
  UNION ALL SELECT 'custom_pattern_2', unnest(regexp_extract_all(text, '(?i)oferta\\d+')) FROM messages)
SELECT name, value, count(*) AS n FROM h GROUP BY name, value""")
def r50(spark, d):
    hits = M.custom_matches(event_messages(spark, d).select("id", "text"), _CUSTOM)
    return hits.groupBy("name", "value").agg(F.count("*").alias("n"))


_EXAMPLES = """
SELECT key, n, array_to_string(list_transform(ex[1:3], lambda x: x.value), ', ')
       || CASE WHEN n > 3 THEN ' y ' || (n - 3) || ' más' ELSE '' END AS examples
FROM agg"""


@query("r51_pattern_tryout", f"""WITH {EVENT_MESSAGES}, h AS (
  SELECT 'basic' AS key, id, generate_subscripts(a, 1) - 1 AS ord, unnest(a) AS value
  FROM (SELECT id, regexp_extract_all(text, '(?i)#[\\p{{L}}\\p{{N}}_]+') AS a FROM messages)
  UNION ALL SELECT 'price', id, generate_subscripts(a, 1) - 1, unnest(a)
  FROM (SELECT id, regexp_extract_all(text, '(?i)[0-9]+ usd') AS a FROM messages)),
v AS (SELECT key, value, count(*) AS c, min({{'id': id, 'ord': ord}}) AS first FROM h GROUP BY key, value),
agg AS (SELECT key, CAST(sum(c) AS BIGINT) AS n, list({{'first': first, 'value': value}} ORDER BY first) AS ex FROM v GROUP BY key)
{_EXAMPLES}""")
def r51(spark, d):
    hits = M.named_matches(event_messages(spark, d).select("id", "text"), {"basic": r"#\w+", "price": r"[0-9]+ usd"})
    return M.key_summary(hits.withColumnRenamed("name", "key"), distinct=True)


_SUMMARY_KEYS = ["emails", "hashtags", "monedas_explicitas", "dates_weekdays"]
_SUMMARY = " UNION ALL ".join(
    f"SELECT '{k}' AS key, id, generate_subscripts(a, 1) - 1 AS ord, unnest(a) AS value FROM (SELECT id, {hits_sql(BY_KEY[k])} AS a FROM messages)"
    for k in _SUMMARY_KEYS)


@query("r52_key_summary", f"""WITH {EVENT_MESSAGES}, h AS ({_SUMMARY}),
agg AS (SELECT key, count(*) AS n, list({{'id': id, 'ord': ord, 'value': value}} ORDER BY id, ord) AS ex FROM h GROUP BY key)
{_EXAMPLES}""")
def r52(spark, d):
    return M.key_summary(M.extract_matches(event_messages(spark, d).select("id", "text"), _SUMMARY_KEYS))


def event_matches(spark, d, keys=None):
    return M.extract_matches(event_messages(spark, d).drop("sender_id", "sender_name"), keys)


def _matches_cte(keys) -> str:
    parts = " UNION ALL ".join(
        f"SELECT chat_id, id, user_key, ts, text, '{BY_KEY[k].category}' AS category, '{k}' AS key, "
        f"generate_subscripts(a, 1) - 1 AS ord, unnest(a) AS value FROM (SELECT *, {hits_sql(BY_KEY[k])} AS a FROM messages)"
        for k in keys)
    return f"WITH {EVENT_MESSAGES}, h AS ({parts})\n"


_ALL_KEYS = [r.key for r in RULES]
_DATE_KEYS = [r.key for r in RULES if r.key.startswith("dates_")]
_MONEY_KEYS = ["monedas_explicitas", "precios_implicitos"]


@query("a01_message_patterns", _matches_cte(_ALL_KEYS) + """SELECT m.chat_id, m.id, count(h.key) AS hits, string_agg(h.key || '=' || h.value, '|' ORDER BY h.key, h.ord, h.value) AS patterns
FROM messages m LEFT JOIN h ON h.chat_id = m.chat_id AND h.id = m.id WHERE length(m.text) > 0 GROUP BY 1, 2""")
def a01(spark, d):
    rows = S.message_patterns(event_messages(spark, d), event_matches(spark, d))
    flat = F.array_join(F.transform("patterns", lambda p: F.concat(p["key"], F.lit("="), p["value"])), "|")
    return rows.select("chat_id", "id", F.coalesce(F.size("patterns"), F.lit(0)).cast("long").alias("hits"), flat.alias("patterns"))


@query("a02_financial_summary", _matches_cte(_MONEY_KEYS) + """SELECT
  count(DISTINCT value) FILTER (key = 'monedas_explicitas') AS explicit_currencies,
  count(DISTINCT value) FILTER (key = 'precios_implicitos') AS implicit_prices,
  count(*) AS total_monetary_references FROM h""")
def a02(spark, d):
    return S.financial_summary(event_matches(spark, d, _MONEY_KEYS))


@query("a03_currency_breakdown", _matches_cte(_MONEY_KEYS[:1]) + """SELECT
  CASE WHEN contains(lower(value), 'mlc') THEN 'mlc' WHEN contains(lower(value), 'mn') THEN 'mn'
       WHEN contains(lower(value), 'usd') THEN 'usd' WHEN contains(lower(value), 'cup') THEN 'cup'
       WHEN contains(lower(value), 'eur') THEN 'eur' END AS currency, count(*) AS n
FROM h GROUP BY 1 HAVING currency IS NOT NULL""")
def a03(spark, d):
    return S.currency_breakdown(event_matches(spark, d, _MONEY_KEYS[:1]))


@query("a04_temporal_references", _matches_cte(_DATE_KEYS) + """, e AS (SELECT *, lower(trim(value)) AS expression FROM h),
c AS (SELECT *, CAST(instr(lower(text), expression) AS INT) AS pos, CAST(length(expression) AS INT) AS n FROM e WHERE expression <> ''),
p AS (SELECT *, substr(text, pos - CAST(least(pos - 1, 49) AS INT), CAST(least(pos - 1, 49) AS INT)) AS l, substr(text, pos + n, 50) AS r FROM c),
x AS (SELECT *, trim(regexp_replace(
     CASE WHEN pos = 0 THEN text ELSE
     CASE WHEN regexp_matches(l, '[.!?;\\n]') THEN regexp_extract(l, '[^.!?;\\n]*$') ELSE '' END
     || substr(text, pos, n) || regexp_extract(r, '^[^.!?;\\n]*') END, '\\s+', ' ', 'g')) AS context FROM p)
SELECT expression, CAST(arg_min(key, {'ts': ts, 'id': id, 'key': key}) AS VARCHAR) AS key, count(*) AS total_count, count(DISTINCT user_key) AS users,
       array_to_string((list(context ORDER BY ts, id, ord, context))[1:3], ' / ') AS contexts
FROM x GROUP BY expression""")
def a04(spark, d):
    t = S.temporal_references(event_matches(spark, d, _DATE_KEYS), event_messages(spark, d))
    return t.select("expression", "key", "total_count", "users", F.array_join("example_contexts", " / ").alias("contexts"))


_REL = " OR ".join(f"contains(lower(value), '{w}')" for w in S.RELATIVE_WORDS)


@query("a05_temporal_classes", _matches_cte(_DATE_KEYS) + f"""SELECT count(*) FILTER (regexp_matches(value, '[0-9]')) AS absolute_dates,
  count(*) FILTER ({_REL}) AS relative_references, count(DISTINCT value) AS time_expressions,
  count(*) AS total_temporal_references FROM h""")
def a05(spark, d):
    return S.temporal_classes(event_matches(spark, d, _DATE_KEYS))


@query("a06_context_window", _matches_cte(["dates_weekdays", "percentages"]) + """, c AS (SELECT *, CAST(instr(lower(text), lower(value)) AS INT) AS pos, CAST(length(value) AS INT) AS n FROM h),
p AS (SELECT *, substr(text, pos - CAST(least(pos - 1, 49) AS INT), CAST(least(pos - 1, 49) AS INT)) AS l, substr(text, pos + n, 50) AS r FROM c)
SELECT id, key, trim(regexp_replace(CASE WHEN regexp_matches(l, '[.!?;\\n]') THEN regexp_extract(l, '[^.!?;\\n]*$') ELSE '' END
     || substr(text, pos, n) || regexp_extract(r, '^[^.!?;\\n]*'), '\\s+', ' ', 'g')) AS context FROM p""")
def a06(spark, d):
    m = event_messages(spark, d).select("id", "text", F.col("text").alias("body"))
    hits = M.extract_matches(m, ["dates_weekdays", "percentages"])
    return hits.select("id", "key", S.temporal_context("body", "value").alias("context"))


_SOCIAL = ["hashtags", "mentions", "urls_raw", "emojis"]


@query("a07_social_summary", _matches_cte(_SOCIAL) + """SELECT count(DISTINCT value) FILTER (key = 'hashtags') AS hashtags,
  count(DISTINCT value) FILTER (key = 'mentions') AS mentions, count(DISTINCT value) FILTER (key = 'urls_raw') AS urls,
  count(DISTINCT value) FILTER (key = 'emojis') AS emojis, count(*) FILTER (key <> 'emojis') AS social_engagement_score FROM h""")
def a07(spark, d):
    return S.social_summary(event_matches(spark, d, _SOCIAL))


@query("a08_contact_summary", _matches_cte(["emails", "phone_numbers"]) + """, v AS (SELECT DISTINCT key, value FROM h)
SELECT count(*) FILTER (key = 'emails') AS emails, count(*) FILTER (key = 'phone_numbers' AND regexp_matches(value, '[0-9]{5,}')) AS phone_numbers,
  count(*) FILTER (key = 'emails' OR regexp_matches(value, '[0-9]{5,}')) AS total_contact_points FROM v""")
def a08(spark, d):
    return S.contact_summary(event_matches(spark, d, ["emails", "phone_numbers"]))


_TECH = ["coordinates", "ip_addresses", "measurements"]


@query("a09_technical_summary", _matches_cte(_TECH) + """SELECT count(DISTINCT value) FILTER (key = 'coordinates') AS coordinates,
  count(DISTINCT value) FILTER (key = 'ip_addresses') AS ip_addresses, count(DISTINCT value) FILTER (key = 'measurements') AS measurements,
  count(DISTINCT key || '=' || value) AS total_technical_patterns FROM h""")
def a09(spark, d):
    return S.technical_summary(event_matches(spark, d, _TECH))


@query("a10_conversation_metrics", _matches_cte(_ALL_KEYS) + """SELECT count(DISTINCT id) AS total_messages_with_patterns,
  round(count(*) / (SELECT count(*) FROM messages)::DOUBLE, 6) AS patterns_per_message_avg FROM h""")
def a10(spark, d):
    m = S.conversation_metrics(event_messages(spark, d), event_matches(spark, d))
    return m.withColumn("patterns_per_message_avg", F.round("patterns_per_message_avg", 6))


@query("a11_category_ranking", _matches_cte(_ALL_KEYS) + """SELECT category, count(*) AS n FROM h
WHERE category IN ('financial', 'temporal', 'social', 'contact', 'technical') GROUP BY category ORDER BY n DESC, category""")
def a11(spark, d):
    return S.category_ranking(event_matches(spark, d))


@query("a12_emoji_frequency", _matches_cte(["emojis"]) + """, f AS (SELECT value AS emoji, count(*) AS n FROM h GROUP BY value)
SELECT emoji, n, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM f) AS unique_emojis FROM f ORDER BY n DESC, emoji LIMIT 15""")
def a12(spark, d):
    return S.emoji_frequency(event_matches(spark, d, ["emojis"]))


@query("a13_temporal_ranking", _matches_cte(_DATE_KEYS) + """SELECT lower(trim(value)) AS expression, count(*) AS total_count FROM h
GROUP BY 1 HAVING expression <> '' ORDER BY total_count DESC, expression""")
def a13(spark, d):
    t = S.temporal_references(event_matches(spark, d, _DATE_KEYS))
    return t.select("expression", "total_count").orderBy(F.col("total_count").desc(), "expression")


@query("a14_keys_per_message", _matches_cte(_ALL_KEYS) + "SELECT chat_id, id, count(DISTINCT key) AS keys, count(*) AS hits FROM h GROUP BY 1, 2")
def a14(spark, d):
    return S.keys_per_message(event_matches(spark, d))


@query("a15_reaction_totals", """WITH r AS (SELECT event_id AS id, user_id % 10 AS chat_id, event_type AS emoji,
  CAST(json_extract(props, '$.k') AS BIGINT) AS n FROM events)
SELECT emoji, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT id) AS messages FROM r GROUP BY emoji""")
def a15(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    m = e.select((F.col("user_id") % 10).alias("chat_id"), F.col("event_id").alias("id"),
                 F.create_map("event_type", k).alias("reactions"))
    return S.reaction_totals(m)
