"""Price and activity trends, anomaly flags, correlations, summary lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize
from .matches import match_array, pattern_counts, prepared
from .ranking import median_of_counts, ordered_rank, time_slice, value_counts

TREND_KEYS = ["monedas_explicitas", "urls_raw", "hashtags", "mentions", "emails", "phone_numbers",
              "coordinates", "ip_addresses"]


def parse_price(amount: Column | str) -> Column:
    """Amount text to a number: the mean of the first two parts of a range, comma as decimal point."""
    a = F.col(amount) if isinstance(amount, str) else amount
    part = lambda i: F.trim(F.get(F.split(a, "-"), F.lit(i))).try_cast("double")
    plain = F.regexp_replace(F.replace(a, F.lit(","), F.lit(".")), r"[^\d.]", "").try_cast("double")
    return F.when(F.contains(a, F.lit("-")), (part(0) + part(1)) / 2).otherwise(plain)


def price_series(matches: DataFrame) -> DataFrame:
    """One row per explicit price: chat_id, id, ord, ts, currency, price."""
    money = matches.filter((F.col("key") == "monedas_explicitas") & F.col("ts").isNotNull())
    price = parse_price(F.get("groups", F.lit(0)))
    return money.select(
        "chat_id", "id", "ord", "ts", F.lower(F.get("groups", F.lit(1))).alias("currency"), price.alias("price")
    ).filter((F.col("price") != 0) & (F.col("currency") != ""))


def price_statistics(series: DataFrame) -> DataFrame:
    """Count, min, max, mean, median and sample deviation per currency.

    Equal prices are counted first and the counts are written down, so the
    message scan runs once and each measure works on the distinct prices.
    """
    counts = materialize(value_counts(series, ["currency"], "price"), "price_counts")
    c, v = F.col("_c"), F.col("_v")
    base = counts.groupBy("currency").agg(
        F.sum(c).alias("n"), F.min(v).alias("min_price"), F.max(v).alias("max_price"),
        (F.sum(v * c) / F.sum(c)).alias("avg_price"),
    )
    spread = counts.join(base.select("currency", "n", "avg_price"), "currency").groupBy("currency").agg(
        F.sum(F.pow(v - F.col("avg_price"), F.lit(2)) * c).alias("_ss"))
    return (
        base.join(spread, "currency").join(median_of_counts(counts, ["currency"]), "currency")
        .select("currency", "n", "min_price", "max_price", "avg_price",
                F.when(F.col("n") > 1, F.sqrt(F.col("_ss") / (F.col("n") - 1))).otherwise(0.0).alias("volatility"), "median")
    )


def price_trend(series: DataFrame) -> DataFrame:
    """Mean of the later half against the earlier half, in (ts, id, ord) order, with a 10 % band."""
    order = ["ts", "chat_id", "id", "ord"]
    # read twice below, once for the slice counts; without this the texts would be scanned twice
    r = ordered_rank(materialize(series, "price_series"), ["currency"], order, time_slice("ts"))
    early = F.col("rn") <= F.floor(F.col("n") / 2)
    halves = r.groupBy("currency").agg(
        F.count("*").alias("n"),
        F.avg(F.when(early, F.col("price"))).alias("first_half"),
        F.avg(F.when(~early, F.col("price"))).alias("second_half"),
    )
    label = (
        F.when(F.col("n") < 2, "estable")
        .when(F.col("second_half") > F.col("first_half") * 1.1, "alcista")
        .when(F.col("second_half") < F.col("first_half") * 0.9, "bajista")
        .otherwise("estable")
    )
    return halves.select("currency", "n", "first_half", "second_half", label.alias("trend"))


def analysis_period(messages: DataFrame) -> DataFrame:
    span = messages.agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    days = F.floor((F.unix_micros("end") - F.unix_micros("start")) / F.lit(86400000000))
    return span.select("start", "end", F.coalesce(days, F.lit(0)).cast("long").alias("days"))


def hourly_activity(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("ts").isNotNull()).groupBy(F.hour("ts").cast("long").alias("hour")).agg(
        F.count("*").alias("n"))


def daily_activity(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("ts").isNotNull()).groupBy(F.date_format("ts", "EEEE").alias("weekday")).agg(
        F.count("*").alias("n"))


def message_flags(messages: DataFrame) -> DataFrame:
    """Per message: which kinds of pattern it holds.  Every trend measure reads this one scan."""
    return prepared(messages).select("chat_id", "id", "ts", *_flag_columns())


def _flag_columns() -> list[Column]:
    from ..rules.patterns import DATES

    n = pattern_counts("text", TREND_KEYS + [r.key for r in DATES])
    dates = [n[r.key] for r in DATES]
    any_date = dates[0] > 0
    for d in dates[1:]:
        any_date = any_date | (d > 0)
    return [
        (n["monedas_explicitas"] > 0).alias("financial"),
        any_date.alias("temporal"),
        (n["urls_raw"] > 0).alias("urls"),
        ((n["hashtags"] > 0) | (n["mentions"] > 0)).alias("social"),
        n["emails"].alias("emails"),
        n["phone_numbers"].alias("phones"),
        ((n["emails"] > 0) | (n["phone_numbers"] > 0)).alias("contact"),
        ((n["coordinates"] > 0) | (n["ip_addresses"] > 0)).alias("technical"),
    ]


def flags_and_prices(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The flags of every message and the price hits, from one scan of the texts that is written down."""
    both = materialize(prepared(messages).select("chat_id", "id", "ts", *_flag_columns(), match_array("text", ["monedas_explicitas"]).alias("_hits")), "trend_base")
    hits = both.select("chat_id", "id", "ts", F.explode("_hits").alias("h")).select("chat_id", "id", "ts", "h.category", "h.key", "h.ord", "h.value", "h.groups")
    return both.drop("_hits"), hits


def patterns_by_hour(flags: DataFrame) -> DataFrame:
    f = flags.filter(F.col("ts").isNotNull())
    return f.groupBy(F.hour("ts").cast("long").alias("hour")).agg(
        F.count_if("financial").alias("financial"),
        F.count_if("temporal").alias("temporal"),
        F.count_if("urls").alias("urls"),
    )


def peak_hours(messages: DataFrame, k: int = 3) -> DataFrame:
    return hourly_activity(messages).orderBy(F.col("n").desc(), "hour").limit(k)


def recommended_hours(flags: DataFrame, k: int = 3) -> DataFrame:
    return (
        patterns_by_hour(flags).filter(F.col("financial") > 0)
        .orderBy(F.col("financial").desc(), "hour").limit(k)
        .select("hour", F.lit("Ideal para transacciones financieras").alias("recommendation"),
                F.col("financial").alias("financial_activity"))
    )


def price_spikes(statistics: DataFrame) -> DataFrame:
    return statistics.filter(F.col("volatility") > F.col("avg_price") * 0.5).select(
        "currency", "volatility", F.lit("Precio muy volátil").alias("reason"))


def night_activity(messages: DataFrame) -> DataFrame:
    return hourly_activity(messages).filter(F.col("hour").between(2, 5) & (F.col("n") > 10)).select(
        "hour", F.col("n").alias("activity_count"), F.lit("Alta actividad en horas nocturnas").alias("reason"))


def contact_bursts(flags: DataFrame) -> DataFrame:
    return flags.filter((F.col("phones") > 2) | (F.col("emails") > 2)).select(
        "chat_id", "id", "phones", "emails",
        F.lit("Múltiples datos de contacto en un solo mensaje").alias("reason"))


def financial_by_weekday(flags: DataFrame) -> DataFrame:
    return flags.filter(F.col("financial") & F.col("ts").isNotNull()).groupBy(
        F.date_format("ts", "EEEE").alias("weekday")).agg(F.count("*").alias("n"))


def most_active_day(flags: DataFrame) -> DataFrame:
    return financial_by_weekday(flags).orderBy(F.col("n").desc(), "weekday").limit(1)


def _ratio(flags: DataFrame, of: str, also: str) -> DataFrame:
    base = flags.agg(F.count_if(F.col(of)).alias("total"), F.count_if(F.col(of) & F.col(also)).alias("both"))
    return base.select(
        F.when(F.col("total") > 0, F.col("both") / F.col("total")).otherwise(0.0).alias("ratio"), "both", "total")


def social_financial(flags: DataFrame) -> DataFrame:
    return _ratio(flags, "financial", "social")


def contact_technical(flags: DataFrame) -> DataFrame:
    r = _ratio(flags, "contact", "technical")
    note = F.when(F.col("both") > 0, "Posibles transacciones con ubicación específica").otherwise(
        "Sin correlación significativa")
    return r.withColumn("implications", note)


def _lines(*columns: tuple[str, Column]):
    """Array of (section, line) that drops empty lines."""
    items = F.array(*[F.when(c.isNotNull(), F.struct(F.lit(s).alias("section"), c.alias("line"))) for s, c in columns])
    return F.filter(items, lambda x: x.isNotNull())


def correlation_insights(flags: DataFrame) -> DataFrame:
    """Insight lines from one pass over the flags."""
    per_day = flags.groupBy(F.date_format("ts", "EEEE").alias("d")).agg(
        F.count_if(F.col("financial") & F.col("ts").isNotNull()).alias("fd"),
        F.count_if("financial").alias("fin"), F.count_if(F.col("financial") & F.col("social")).alias("finsoc"),
        F.count_if("contact").alias("con"), F.count_if(F.col("contact") & F.col("technical")).alias("contec"),
    )
    one = per_day.agg(
        F.min(F.when(F.col("fd") > 0, F.struct((-F.col("fd")).alias("neg"), F.col("d").alias("d")))).alias("top"),
        F.sum("fin").alias("fin"), F.sum("finsoc").alias("finsoc"),
        F.sum("con").alias("con"), F.sum("contec").alias("contec"),
    )
    day = F.when(F.col("top").isNotNull(), F.format_string(
        "💸 Día más activo financieramente: %s con %d transacciones", F.col("top.d"), -F.col("top.neg")))
    soc = F.when(F.col("finsoc") > F.col("fin") * 0.3, F.lit(
        "📱 Las transacciones financieras frecuentemente incluyen elementos sociales (hashtags, menciones)"))
    tec = F.when(F.col("contec") > F.col("con") * 0.2, F.lit(
        "📍 Los contactos suelen venir acompañados de información técnica (coordenadas, IPs)"))
    return one.select(F.explode(_lines(("insight", day), ("insight", soc), ("insight", tec)))).select("col.*")


def executive_summary(messages: DataFrame, matches: DataFrame, flags: DataFrame) -> DataFrame:
    """Findings, recommendations and risks as (section, line) rows.

    Every input of the lines is a one-row aggregate; only those are joined.
    """
    stats = price_statistics(price_series(matches))
    money = stats.agg(
        F.min(F.struct((-F.col("n")).alias("neg"), "currency")).alias("cur"),
        F.count_if(F.col("volatility") > F.col("avg_price") * 0.5).alias("spikes"),
    )
    # one pass over the flags: per hour first, messages without a time under a null hour
    per_hour = flags.groupBy(F.hour("ts").alias("hour")).agg(
        F.count("*").alias("n"), F.count_if("financial").alias("fin"), F.count_if((F.col("phones") > 2) | (F.col("emails") > 2)).alias("bad"))
    timed = F.col("hour").isNotNull()
    hours = per_hour.agg(
        F.min(F.when(timed, F.struct((-F.col("n")).alias("neg"), F.col("hour").alias("hour")))).alias("peak"),
        F.min(F.when(timed & (F.col("fin") > 0), F.struct((-F.col("fin")).alias("neg"), F.col("hour").alias("hour")))).alias("best"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("suspicious"),
    )
    one = money.join(F.broadcast(hours))  # one row each
    fs = F.format_string
    return one.select(F.explode(_lines(
        ("key_findings", F.when(F.col("cur").isNotNull(), fs("Moneda más mencionada: %s (%d referencias)", F.col("cur.currency"), -F.col("cur.neg")))),
        ("key_findings", F.when(F.col("peak").isNotNull(), fs("Hora pico de actividad: %d:00 (%d mensajes)", F.col("peak.hour"), -F.col("peak.neg")))),
        ("recommendations", F.when(F.col("best").isNotNull(), fs("Mejor horario para engagement financiero: %d:00", F.col("best.hour")))),
        ("risk_factors", F.when(F.col("spikes") > 0, fs("Alta volatilidad detectada en %d monedas", F.col("spikes")))),
        ("risk_factors", F.when(F.col("suspicious") > 0, fs("%d mensajes con patrones sospechosos detectados", F.col("suspicious")))),
    ))).select("col.*")


def activity_bars(activity: DataFrame) -> DataFrame:
    """Counts with their ratio to the largest count (24 hours or 7 days, so the window is small)."""
    return activity.withColumn("bar", F.col("n") / F.max("n").over(W.partitionBy()))
