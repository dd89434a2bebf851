"""Incremental pattern alarms in batch form.

The alarm table is configuration: some rows per user.  Its distinct patterns
are read once by the driver so that each becomes a literal, compiled-once
expression.  A message is matched once against the patterns its chat wants; its
hits, not the message, then meet alarms by an equality join on chat and pattern.
Messages come as a table or as a store cut by day and chat (`sources.store`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.store import MessageStore
from .matches import _group_count, named_hits, extract_matches, valid_patterns
from .ranking import top_k

PATTERNS_AT_ONCE = 100


def interval_minutes(interval: Column | str, months: bool = False, floor: bool = True) -> Column:
    """Minutes of an interval struct; a month counts 30 days where months are asked for."""
    i = F.col(interval) if isinstance(interval, str) else interval
    part = lambda n: F.coalesce(i[n].cast("long"), F.lit(0))
    total = part("days") * 1440 + part("hours") * 60 + part("minutes")
    if months:
        total = total + part("months") * 43200
    return F.greatest(total, F.lit(1)) if floor else total


def next_run(base: Column, minutes: Column, now: Column) -> Column:
    """First base + k * interval after now, k at least 1; null without an interval."""
    step = F.nullif(minutes.cast("long") * 60000000, F.lit(0))
    gap = F.unix_micros(now) - F.unix_micros(base)
    k = F.greatest(F.lit(1), F.floor(gap / step) + 1)
    return F.when(minutes > 0, F.timestamp_micros(F.unix_micros(base) + k * step))


def time_left(run: Column, now: Column) -> Column:
    s = F.floor((F.unix_micros(run) - F.unix_micros(now)) / 1000000)
    d, h, m = F.floor(s / 86400), F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    text = F.concat_ws(" ", F.when(d > 0, F.concat(d.cast("string"), F.lit("d"))),
                       F.when((h > 0) | (d > 0), F.concat(h.cast("string"), F.lit("h"))), F.concat(m.cast("string"), F.lit("m")))
    return F.when(run.isNull() | (s <= 0), "Ahora").otherwise(text)


def status(alarms: DataFrame, now: Column) -> DataFrame:
    day = lambda c, none: F.coalesce(F.date_format(c, "dd/MM/yyyy HH:mm"), F.lit(none))
    return alarms.select(
        "alarm_id", F.col("chat_title").alias("title"), "enabled", "total_runs", day("next_run", "N/A").alias("next_run"),
        time_left(F.col("next_run"), now).alias("time_left"), F.size("patterns").cast("long").alias("patterns"),
        day("last_analysis_time", "Nunca").alias("last_run"))


def due(alarms: DataFrame, now: Column) -> DataFrame:
    return alarms.filter(F.col("enabled") & (F.col("next_run") <= now))


def normalize(alarms: DataFrame, now: Column, zone: str = "UTC") -> DataFrame:
    """Loaded alarms: a missing range is the last seven days; enabled ones with an interval fall due now."""
    fresh = F.col("enabled") & (interval_minutes("interval", floor=False) > 0)
    return alarms.withColumns({
        "date_to": F.coalesce(F.to_utc_timestamp("date_to", zone), now),
        "date_from": F.coalesce(F.to_utc_timestamp("date_from", zone), now - F.expr("interval 7 days")),
        "last_analysis_time": F.when(fresh, F.lit(None)).otherwise(F.col("last_analysis_time")).cast("timestamp"),
        "created_at": F.when(fresh, now).otherwise(F.col("created_at")),
        "next_run": F.when(fresh, now).otherwise(F.col("next_run")),
    })


def in_range(messages: DataFrame | MessageStore, alarms: DataFrame) -> DataFrame:
    """Messages each alarm looks at: same chat, time inside its range, both ends kept.

    Of stored messages only the days and buckets that the ranges name are read.
    """
    a = alarms.select("alarm_id", "chat_id", "date_from", "date_to", F.col("patterns").alias("alarm_patterns"))
    if isinstance(messages, MessageStore):
        return messages.in_ranges(a)
    return messages.join(a, "chat_id").filter(F.col("ts").between(F.col("date_from"), F.col("date_to")))


def _watched(messages: DataFrame | MessageStore, alarms: DataFrame) -> DataFrame:
    """Every message that an alarm's chat and the span of its chat's ranges hold, once, with the chat's patterns as ``wanted``."""
    per_chat = alarms.groupBy("chat_id").agg(F.min("date_from").alias("_from"), F.max("date_to").alias("_to"),
                                             F.array_distinct(F.flatten(F.collect_list("patterns.pattern"))).alias("wanted"))
    if isinstance(messages, MessageStore):
        return messages.in_ranges(per_chat, "_from", "_to")
    return messages.join(per_chat, "chat_id").filter(F.col("ts").between(F.col("_from"), F.col("_to")))


def _pattern_hits(messages: DataFrame | MessageStore, alarms: DataFrame) -> DataFrame:
    """chat_id, id, ts and ``h`` (name: the pattern, ord, value): each distinct pattern is matched once per message that wants it.

    Every distinct pattern is a compiled branch of an expression; an expression
    holds at most PATTERNS_AT_ONCE of them, further ones go to further passes.
    """
    spark = messages.sparkSession
    found = sorted(r.p for r in alarms.select(F.explode("patterns.pattern").alias("p")).distinct().collect() if r.p)
    known = list(valid_patterns(spark, {p: p for p in found}))
    passes = [known[k:k + PATTERNS_AT_ONCE] for k in range(0, len(known), PATTERNS_AT_ONCE)] or [[]]
    empty = F.array().cast("array<struct<name:string,ord:int,value:string>>")
    rows, out = _watched(messages, alarms).select("chat_id", "id", "ts", "text", "wanted"), None
    for some in passes:
        hits = [F.when(F.array_contains("wanted", p), named_hits(F.col("text"), p, "(?iU)" + p, _group_count(spark, "(?iU)" + p))).otherwise(empty) for p in some]
        part = rows.withColumn("_hits", F.concat(*hits) if hits else empty).select("chat_id", "id", "ts", F.explode("_hits").alias("h"))
        out = part if out is None else out.unionByName(part)
    return out


def extract(messages: DataFrame, alarms: DataFrame, per_pattern: int | None = 10, label=None) -> DataFrame:
    """Hits per alarm and pattern: alarm_id, name, type, id, ord, value.

    ``per_pattern`` is the report's own limit on values; None keeps all.
    ``label`` rewrites the values of patterns named after links.
    """
    asks = alarms.select("alarm_id", "chat_id", "date_from", "date_to", F.posexplode("patterns").alias("pattern_no", "p")).select(
        "alarm_id", "chat_id", "date_from", "date_to", "pattern_no", "p.name", "p.type", "p.pattern")
    hits = _pattern_hits(messages, alarms).withColumn("pattern", F.col("h.name")).join(asks, ["chat_id", "pattern"]).filter(
        F.col("ts").between(F.col("date_from"), F.col("date_to"))).select(
        "alarm_id", "pattern_no", "name", "type", "ts", "id", F.col("h.ord").alias("ord"), F.col("h.value").alias("value"))
    if label is not None:
        low = F.lower("name")
        is_link = F.contains(low, F.lit("url")) | F.contains(low, F.lit("enlace")) | F.contains(low, F.lit("link"))
        hits = label(hits, is_link)
    if per_pattern is not None:
        hits = top_k(hits, ["alarm_id", "pattern_no"], ["ts", "id", "ord"], per_pattern)
    return hits


def link_labels(hits: DataFrame, is_link: Column) -> DataFrame:
    """Hits with the label in place of the link where the pattern is named after links; each link is labelled once."""
    from .links import labels

    marked = hits.withColumn("_link", F.when(is_link, F.col("value")))
    named = labels(marked.filter("_link is not null").select(F.col("_link").alias("url"))).select(F.col("url").alias("_link"), "label")
    return marked.join(named, "_link", "left").withColumn("value", F.coalesce("label", "value")).drop("_link", "label")


def extract_all_keys(messages: DataFrame, alarms: DataFrame, per_key: int | None = 5) -> DataFrame:
    """Every built-in rule, for alarms that ask for it with a pattern of type 'global'."""
    asks = alarms.filter(F.exists("patterns", lambda p: p["type"] == "global"))
    hits = extract_matches(in_range(messages, asks).select("alarm_id", "id", "ts", "text")).select(
        "alarm_id", F.concat(F.lit("Global_"), F.col("key")).alias("name"), "ts", "id", "ord", "value")
    return hits if per_key is None else top_k(hits, ["alarm_id", "name"], ["ts", "id", "ord"], per_key)


def counts_with_zero(hits: DataFrame, alarms: DataFrame) -> DataFrame:
    """Hits per configured pattern, patterns without any kept as zero."""
    named = alarms.select("alarm_id", F.posexplode("patterns").alias("pattern_no", "p")).select(
        "alarm_id", "pattern_no", F.col("p.name").alias("name"), F.col("p.type").alias("type"))
    n = hits.groupBy("alarm_id", "pattern_no").agg(F.count("*").alias("n"))
    return named.join(n, ["alarm_id", "pattern_no"], "left").select(
        "alarm_id", "pattern_no", "name", "type", F.coalesce("n", F.lit(0)).alias("n"))


def digest(hits: DataFrame, alarms: DataFrame, shown: int = 20) -> DataFrame:
    """Report line per pattern: count, and distinct values with their multiplicity in order of appearance.

    At most `shown` values per pattern are gathered; the rest is told as a number.
    """
    keys = ["alarm_id", "pattern_no"]
    per_value = hits.groupBy(*keys, "value").agg(F.count("*").alias("qty"), F.min(F.struct("ts", "id", "ord")).alias("at"))
    uniques = per_value.groupBy(*keys).agg(F.count("*").alias("unique_values"))
    word = F.when(F.col("qty") > 1, F.format_string("%s (%d veces)", "value", "qty")).otherwise(F.col("value"))
    first = top_k(per_value.withColumn("word", word), keys, ["at", "value"], shown).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("at", "value", "word"))).alias("s"))
    base = counts_with_zero(hits, alarms).join(uniques, keys, "left").join(first, keys, "left")
    listing = F.array_join(F.transform("s", lambda x: x["word"]), ", ")
    more = F.when(F.col("unique_values") > shown, F.format_string(" (y %d valores únicos más)", F.col("unique_values") - shown)).otherwise("")
    return base.select(
        *keys, "name", "n", F.format_string("  • %s (%s): %d encontrados", "name", "type", "n").alias("head"),
        F.when(F.col("n") > 0, F.concat(F.lit("    → encontrados: "), listing, more)).otherwise("").alias("detail"))


def report(lines: DataFrame, alarms: DataFrame, now: Column) -> DataFrame:
    """Whole alarm text, one row per alarm (a configured handful of lines each)."""
    body = lines.groupBy("alarm_id").agg(
        F.array_sort(F.collect_list(F.struct("pattern_no", "head", "detail"))).alias("s"), F.sum("n").alias("total"))
    text = F.array_join(F.flatten(F.transform("s", lambda x: F.filter(F.array(x["head"], x["detail"]), lambda t: t != ""))), "\n")
    j = body.join(alarms.select("alarm_id", "chat_title"), "alarm_id")
    return j.select("alarm_id", F.concat_ws(
        "\n", F.concat(F.lit("🔔 RESUMEN DE ALARMA: "), F.coalesce("chat_title", F.lit("Desconocido"))),
        F.concat(F.lit("📅 "), F.date_format(now, "dd/MM/yyyy HH:mm")), F.concat(F.lit("🆔 Alarma ID: "), F.col("alarm_id").cast("string")),
        F.lit(""), F.lit("📊 RESULTADOS POR PATRÓN:"), text, F.lit(""), F.format_string("📈 Total de coincidencias: %d", "total"),
        F.lit(""), F.lit("⏰ Próxima revisión según intervalo configurado")).alias("message"))


def advance(alarms: DataFrame, messages: DataFrame, now: Column) -> DataFrame:
    """State after a run: range moved on, high-water mark, run counter, next run; `updated` tells whether there was anything."""
    seen = in_range(messages, alarms).groupBy("alarm_id").agg(F.max("id").alias("top"), F.count("*").alias("seen"))
    j = alarms.join(seen, "alarm_id", "left")
    run_base = F.coalesce(now, F.col("created_at"))
    return j.withColumns({
        "last_analyzed_message_id": F.greatest("last_analyzed_message_id", "top"),
        "last_analysis_time": now, "total_runs": F.coalesce("total_runs", F.lit(0)) + 1,
        "date_from": F.col("date_to"), "date_to": now,
        "next_run": next_run(run_base, interval_minutes("interval"), now),
        "updated": F.coalesce("seen", F.lit(0)) > 0,
    }).drop("top", "seen")


def no_updates(alarms: DataFrame, messages: DataFrame) -> DataFrame:
    """Alarms whose range holds no message."""
    seen = in_range(messages, alarms).select("alarm_id").distinct()
    return alarms.join(seen, "alarm_id", "left_anti").select(
        "alarm_id", F.concat(F.lit("Sin novedades en "), F.coalesce("chat_title", F.lit("Desconocido"))).alias("notice"))


def unread_counts(messages: DataFrame, alarms: DataFrame) -> DataFrame:
    """New messages per chat, and whether an enabled alarm watches the chat."""
    watched = alarms.filter("enabled").select("chat_id").distinct().withColumn("alarm_hit", F.lit(True))
    return messages.groupBy("chat_id").agg(F.count("*").alias("unread")).join(watched, "chat_id", "left").select(
        "chat_id", "unread", F.coalesce("alarm_hit", F.lit(False)).alias("alarm_hit"))


def notification(chat_name: Column, text: Column) -> Column:
    return F.concat(F.lit("📨 Nuevo mensaje en "), chat_name, F.lit(": "), F.left(F.coalesce(text, F.lit("")), F.lit(50)), F.lit("..."))
