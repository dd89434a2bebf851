"""Aggregates over the ``matches`` table.

Expected columns: chat_id, id, ts, user_key, category, key, ord, value, groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import top_k

# Short currency names, in test order.
CURRENCY_KINDS = ["mlc", "mn", "usd", "cup", "eur"]
# Words that mark a relative time expression.
RELATIVE_WORDS = ["hoy", "ayer", "mañana", "semana", "mes", "año", "próximo", "pasado"]
CATEGORIES = ["financial", "temporal", "social", "contact", "technical"]


def message_patterns(messages: DataFrame, matches: DataFrame) -> DataFrame:
    """Messages with text, each with its hits grouped by key."""
    per = matches.groupBy("chat_id", "id").agg(
        F.array_sort(F.collect_list(F.struct("key", "ord", "value"))).alias("patterns")
    )
    texts = messages.filter(F.coalesce(F.length("text"), F.lit(0)) > 0).select("chat_id", "id", "ts", "text")
    return texts.join(per, ["chat_id", "id"], "left")


def financial_summary(matches: DataFrame) -> DataFrame:
    """Distinct explicit amounts, distinct implicit amounts, all references.

    Counted from distinct values in two steps, so no value set is held in one task.
    """
    keys = ["monedas_explicitas", "precios_implicitos"]
    per_value = matches.filter(F.col("key").isin(keys)).groupBy("key", "value").agg(F.count("*").alias("n"))
    return per_value.agg(
        F.count_if(F.col("key") == keys[0]).alias("explicit_currencies"),
        F.count_if(F.col("key") == keys[1]).alias("implicit_prices"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_monetary_references"),
    )


def currency_kind(value: Column) -> Column:
    low = F.lower(value)
    kind = None
    for name in CURRENCY_KINDS:
        hit = F.contains(low, F.lit(name))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind


def currency_breakdown(matches: DataFrame) -> DataFrame:
    money = matches.filter(F.col("key") == "monedas_explicitas")
    return (
        money.withColumn("currency", currency_kind(F.col("value")))
        .filter(F.col("currency").isNotNull())
        .groupBy("currency").agg(F.count("*").alias("n"))
    )


def temporal_context(text: Column | str, expression: Column | str) -> Column:
    """Sentence piece around an expression: up to 50 characters each way, cut at .!?; and newline."""
    text = F.col(text) if isinstance(text, str) else text
    expr = F.col(expression) if isinstance(expression, str) else expression
    at = F.instr(F.lower(text), F.lower(expr))
    n = F.length(expr)
    # The character exactly 50 before the hit is never looked at, so 49 count.
    back = F.least(at - 1, F.lit(49))
    left = F.substring(text, at - back, back)
    reach_all = F.when(at - 1 > 49, F.lit("")).otherwise(left)
    cut_left = F.regexp_extract(left, r"(?s)^.*[.!?;\n]([^.!?;\n]*)$", 1)
    has_cut = F.regexp_like(left, F.lit(r"[.!?;\n]"))
    before = F.when(has_cut, cut_left).otherwise(F.lit(""))
    right = F.substring(text, at + n, F.lit(50))
    after = F.regexp_extract(right, r"(?s)^([^.!?;\n]*)", 1)
    piece = F.concat(before, F.substring(text, at, n), after)
    found = F.trim(F.regexp_replace(piece, r"(?U)\s+", " "))
    whole = F.when(F.length(text) > 100, F.concat(F.left(text, F.lit(100)), F.lit("..."))).otherwise(text)
    return F.when(at == 0, whole).otherwise(found)


def temporal_references(matches: DataFrame, messages: DataFrame | None = None, contexts: int = 3) -> DataFrame:
    """Per normalised expression: category, total, users, and the first example contexts."""
    hits = matches.filter(F.col("category") == "temporal").withColumn(
        "expression", F.lower(F.trim("value"))
    ).filter(F.col("expression") != "")
    # (expression, user) first, so that counting users needs no large set.
    first_key = F.min(F.struct("ts", "id", "key"))
    per_user = hits.groupBy("expression", "user_key").agg(F.count("*").alias("n"), first_key.alias("first"))
    table = per_user.groupBy("expression").agg(
        F.min("first")["key"].alias("key"),
        F.sum("n").alias("total_count"),
        F.count("user_key").alias("users"),
    )
    if messages is None:
        return table
    firsts = top_k(hits, ["expression"], ["ts", "id", "ord"], contexts)
    texts = messages.select("chat_id", "id", "text")
    shown = (
        firsts.join(texts, ["chat_id", "id"])
        .groupBy("expression")
        .agg(F.array_sort(F.collect_list(F.struct(
            "ts", "id", "ord", temporal_context("text", "expression").alias("context")))).alias("s"))
        .select("expression", F.transform("s", lambda x: x["context"]).alias("example_contexts"))
    )
    return table.join(shown, "expression")


def temporal_classes(matches: DataFrame) -> DataFrame:
    per_value = matches.filter(F.col("category") == "temporal").groupBy("value").agg(F.count("*").alias("n"))
    low = F.lower("value")
    relative = None
    for w in RELATIVE_WORDS:
        c = F.contains(low, F.lit(w))
        relative = c if relative is None else relative | c
    return per_value.agg(
        F.coalesce(F.sum(F.when(F.regexp_like("value", F.lit("[0-9]")), F.col("n"))), F.lit(0)).alias("absolute_dates"),
        F.coalesce(F.sum(F.when(relative, F.col("n"))), F.lit(0)).alias("relative_references"),
        F.count("*").alias("time_expressions"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_temporal_references"),
    )


def _distinct_by_key(matches: DataFrame, keys: list[str]) -> DataFrame:
    return matches.filter(F.col("key").isin(keys)).groupBy("key", "value").agg(F.count("*").alias("n"))


def social_summary(matches: DataFrame) -> DataFrame:
    d = _distinct_by_key(matches, ["hashtags", "mentions", "urls_raw", "emojis"])
    k = F.col("key")
    return d.agg(
        F.count_if(k == "hashtags").alias("hashtags"),
        F.count_if(k == "mentions").alias("mentions"),
        F.count_if(k == "urls_raw").alias("urls"),
        F.count_if(k == "emojis").alias("emojis"),
        F.coalesce(F.sum(F.when(k != "emojis", F.col("n"))), F.lit(0)).alias("social_engagement_score"),
    )


def contact_summary(matches: DataFrame) -> DataFrame:
    d = _distinct_by_key(matches, ["emails", "phone_numbers"])
    mail = F.col("key") == "emails"
    phone = (F.col("key") == "phone_numbers") & F.regexp_like("value", F.lit("[0-9]{5,}"))
    return d.agg(
        F.count_if(mail).alias("emails"),
        F.count_if(phone).alias("phone_numbers"),
        F.count_if(mail | phone).alias("total_contact_points"),
    )


def technical_summary(matches: DataFrame) -> DataFrame:
    d = _distinct_by_key(matches, ["coordinates", "ip_addresses", "measurements"])
    k = F.col("key")
    return d.agg(
        F.count_if(k == "coordinates").alias("coordinates"),
        F.count_if(k == "ip_addresses").alias("ip_addresses"),
        F.count_if(k == "measurements").alias("measurements"),
        F.count("*").alias("total_technical_patterns"),
    )


def conversation_metrics(messages: DataFrame, matches: DataFrame) -> DataFrame:
    """Messages with hits and hits per message over all messages."""
    hits = matches.groupBy("chat_id", "id").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("total_messages_with_patterns"), F.coalesce(F.sum("n"), F.lit(0)).alias("_hits")
    )
    total = messages.agg(F.count("*").alias("_total"))
    return hits.join(F.broadcast(total)).select(  # both sides are one row
        "total_messages_with_patterns",
        F.when(F.col("_total") > 0, F.col("_hits") / F.col("_total")).otherwise(0.0).alias("patterns_per_message_avg"),
    )


def category_ranking(matches: DataFrame) -> DataFrame:
    counts = matches.filter(F.col("category").isin(CATEGORIES)).groupBy("category").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "category")


def emoji_frequency(matches: DataFrame, top: int = 15) -> DataFrame:
    per = matches.filter(F.col("key") == "emojis").groupBy("value").agg(F.count("*").alias("n"))
    totals = per.agg(F.sum("n").alias("total"), F.count("*").alias("unique_emojis"))
    return (
        per.orderBy(F.col("n").desc(), "value").limit(top).join(F.broadcast(totals))
        .select(F.col("value").alias("emoji"), "n", "total", "unique_emojis")
    )


def keys_per_message(matches: DataFrame) -> DataFrame:
    return matches.groupBy("chat_id", "id").agg(F.countDistinct("key").alias("keys"), F.count("*").alias("hits"))


def reaction_totals(messages: DataFrame) -> DataFrame:
    each = messages.select("chat_id", "id", F.explode("reactions").alias("emoji", "n"))
    return each.groupBy("emoji").agg(F.sum("n").alias("total"), F.countDistinct("chat_id", "id").alias("messages"))
