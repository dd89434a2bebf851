"""Queries of trends, anomalies, correlations; also source and projection queries on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matches as M, trends as T
from ..rules.patterns import BY_KEY
from .extraction import _DATE_KEYS, _DATE_SUM, _len, _q, event_matches, re2
from .inputs import EVENT_MESSAGES, event_messages
from .registry import ORACLES, query

_R20 = _q(re2(BY_KEY["monedas_explicitas"].regexes[0], True))
_ZIP = ", ".join(f"regexp_extract_all(text, {_R20}, {i})" for i in range(1, 10))
SERIES = f"""WITH {EVENT_MESSAGES},
z AS (SELECT chat_id, id, ts, generate_subscripts(a, 1) - 1 AS ord, unnest(a) AS t FROM (SELECT *, list_zip({_ZIP}) AS a FROM messages)),
amt AS (SELECT chat_id, id, ts, ord,
   CASE WHEN t[1] <> '' THEN trim(t[1]) WHEN t[3] <> '' THEN t[3] || '-' || t[4] WHEN t[6] <> '' THEN t[6] ELSE t[8] END AS amount,
   lower(CASE WHEN t[1] <> '' THEN t[2] WHEN t[3] <> '' THEN t[5] WHEN t[6] <> '' THEN t[7] ELSE t[9] END) AS currency FROM z),
series AS (SELECT *, CASE WHEN contains(amount, '-')
   THEN (CAST(trim(string_split(amount, '-')[1]) AS DOUBLE) + CAST(trim(string_split(amount, '-')[2]) AS DOUBLE)) / 2
   ELSE CAST(replace(amount, ',', '.') AS DOUBLE) END AS price FROM amt)
"""
STATS = SERIES + """, stats AS (SELECT currency, count(*) AS n, min(price) AS min_price, max(price) AS max_price, avg(price) AS avg_price,
   coalesce(stddev_samp(price), 0.0) AS volatility, median(price) AS median FROM series WHERE price <> 0 GROUP BY currency)
"""
FLAGS = f"""WITH {EVENT_MESSAGES},
flags AS (SELECT chat_id, id, ts, {_len('monedas_explicitas')} > 0 AS financial, {_DATE_SUM} > 0 AS temporal, {_len('urls_raw')} > 0 AS urls,
   {_len('hashtags')} + {_len('mentions')} > 0 AS social, {_len('emails')} AS emails, {_len('phone_numbers')} AS phones,
   {_len('emails')} + {_len('phone_numbers')} > 0 AS contact, {_len('coordinates')} + {_len('ip_addresses')} > 0 AS technical FROM messages)
"""


def series(spark, d):
    return T.price_series(event_matches(spark, d, ["monedas_explicitas"]))


def flags(spark, d):
    return T.message_flags(event_messages(spark, d))


def rounded(df, *cols, places=4):
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


@query("t01_parsed_prices", SERIES + "SELECT id, CAST(ord AS BIGINT) AS ord, price FROM series WHERE price <> 0")
def t01(spark, d):
    return series(spark, d).select("id", F.col("ord").cast("long").alias("ord"), "price")


@query("t02_price_series", SERIES + "SELECT currency, epoch_us(ts) AS ts, price FROM series WHERE price <> 0")
def t02(spark, d):
    return series(spark, d).select("currency", F.unix_micros("ts").alias("ts"), "price")


@query("t03_price_statistics", STATS + """SELECT currency, n, min_price, max_price, round(avg_price, 4) AS avg_price,
 round(volatility, 4) AS volatility, round(median, 4) AS median FROM stats""")
def t03(spark, d):
    return rounded(T.price_statistics(series(spark, d)), "avg_price", "volatility", "median")


@query("t04_price_trend", SERIES + """, r AS (SELECT currency, price, row_number() OVER (PARTITION BY currency ORDER BY ts, chat_id, id, ord) AS rn,
   count(*) OVER (PARTITION BY currency) AS n FROM series WHERE price <> 0),
h AS (SELECT currency, max(n) AS n, avg(price) FILTER (rn <= n // 2) AS f, avg(price) FILTER (rn > n // 2) AS s FROM r GROUP BY currency)
SELECT currency, n, round(f, 4) AS first_half, round(s, 4) AS second_half,
  CASE WHEN n < 2 THEN 'estable' WHEN s > f * 1.1 THEN 'alcista' WHEN s < f * 0.9 THEN 'bajista' ELSE 'estable' END AS trend FROM h""")
def t04(spark, d):
    return rounded(T.price_trend(series(spark, d)), "first_half", "second_half")


@query("t05_analysis_period", """SELECT epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS "end",
  CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS days FROM events""")
def t05(spark, d):
    return T.analysis_period(event_messages(spark, d).select("ts")).select(
        F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "days")


@query("t06_hourly_activity", "SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1")
def t06(spark, d):
    return T.hourly_activity(event_messages(spark, d))


@query("t07_weekday_activity", "SELECT dayname(ts) AS weekday, count(*) AS n FROM events GROUP BY 1")
def t07(spark, d):
    return T.daily_activity(event_messages(spark, d))


@query("t08_patterns_by_hour", FLAGS + """SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) FILTER (financial) AS financial,
  count(*) FILTER (temporal) AS temporal, count(*) FILTER (urls) AS urls FROM flags GROUP BY 1""")
def t08(spark, d):
    return T.patterns_by_hour(flags(spark, d))


@query("t09_peak_hours", "SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, hour LIMIT 3")
def t09(spark, d):
    return T.peak_hours(event_messages(spark, d))


@query("t10_recommended_hours", FLAGS + """SELECT CAST(hour(ts) AS BIGINT) AS hour, 'Ideal para transacciones financieras' AS recommendation,
  count(*) AS financial_activity FROM flags WHERE financial GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 3""")
def t10(spark, d):
    return T.recommended_hours(flags(spark, d))


@query("t11_price_spikes", STATS + """SELECT currency, round(volatility, 4) AS volatility, 'Precio muy volátil' AS reason FROM stats WHERE volatility > avg_price * 0.5""")
def t11(spark, d):
    return rounded(T.price_spikes(T.price_statistics(series(spark, d))), "volatility")


@query("t12_night_activity", """SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS activity_count, 'Alta actividad en horas nocturnas' AS reason
FROM events WHERE hour(ts) BETWEEN 2 AND 5 GROUP BY 1 HAVING count(*) > 10""")
def t12(spark, d):
    return T.night_activity(event_messages(spark, d))


@query("t13_contact_bursts", FLAGS + """SELECT chat_id, id, CAST(phones AS BIGINT) AS phones, CAST(emails AS BIGINT) AS emails,
  'Múltiples datos de contacto en un solo mensaje' AS reason FROM flags WHERE phones > 2 OR emails > 2""")
def t13(spark, d):
    t = T.contact_bursts(flags(spark, d))
    return t.withColumn("phones", F.col("phones").cast("long")).withColumn("emails", F.col("emails").cast("long"))


_DAYS = FLAGS + ", days AS (SELECT dayname(ts) AS weekday, count(*) AS n FROM flags WHERE financial GROUP BY 1)\n"


@query("t14_financial_weekdays", _DAYS + "SELECT weekday, n, row_number() OVER (ORDER BY n DESC, weekday) = 1 AS most_active FROM days")
def t14(spark, d):
    f = flags(spark, d)
    top = T.most_active_day(f).select("weekday", F.lit(True).alias("_top"))
    return T.financial_by_weekday(f).join(top, "weekday", "left").select(
        "weekday", "n", F.coalesce("_top", F.lit(False)).alias("most_active"))


@query("t15_social_financial", FLAGS + """SELECT round(count(*) FILTER (financial AND social) / count(*) FILTER (financial)::DOUBLE, 6) AS ratio,
  count(*) FILTER (financial AND social) AS both, count(*) FILTER (financial) AS total FROM flags""")
def t15(spark, d):
    return rounded(T.social_financial(flags(spark, d)), "ratio", places=6)


@query("t16_contact_technical", FLAGS + """SELECT round(count(*) FILTER (contact AND technical) / count(*) FILTER (contact)::DOUBLE, 6) AS ratio,
  count(*) FILTER (contact AND technical) AS both, count(*) FILTER (contact) AS total,
  CASE WHEN count(*) FILTER (contact AND technical) > 0 THEN 'Posibles transacciones con ubicación específica' ELSE 'Sin correlación significativa' END AS implications
FROM flags""")
def t16(spark, d):
    return rounded(T.contact_technical(flags(spark, d)), "ratio", places=6)


_INSIGHTS = _DAYS + """, top AS (SELECT weekday, n FROM days ORDER BY n DESC, weekday LIMIT 1),
r AS (SELECT count(*) FILTER (financial AND social) / count(*) FILTER (financial)::DOUBLE AS soc,
  count(*) FILTER (contact AND technical) / count(*) FILTER (contact)::DOUBLE AS tec FROM flags)
SELECT 'insight' AS section, '💸 Día más activo financieramente: ' || weekday || ' con ' || n || ' transacciones' AS line FROM top
UNION ALL SELECT 'insight', '📱 Las transacciones financieras frecuentemente incluyen elementos sociales (hashtags, menciones)' FROM r WHERE soc > 0.3
UNION ALL SELECT 'insight', '📍 Los contactos suelen venir acompañados de información técnica (coordenadas, IPs)' FROM r WHERE tec > 0.2"""


@query("t17_correlation_insights", _INSIGHTS)
def t17(spark, d):
    return T.correlation_insights(flags(spark, d))


_SUMMARY_SQL = STATS + f""", flags AS (SELECT ts, {_len('monedas_explicitas')} > 0 AS financial, {_len('emails')} AS emails, {_len('phone_numbers')} AS phones FROM messages),
hours AS (SELECT hour(ts) AS hour, count(*) AS n, count(*) FILTER (financial) AS fin FROM flags GROUP BY 1)
SELECT 'key_findings' AS section, (SELECT 'Moneda más mencionada: ' || currency || ' (' || n || ' referencias)' FROM stats ORDER BY n DESC, currency LIMIT 1) AS line
UNION ALL SELECT 'key_findings', (SELECT 'Hora pico de actividad: ' || hour || ':00 (' || n || ' mensajes)' FROM hours ORDER BY n DESC, hour LIMIT 1)
UNION ALL SELECT 'recommendations', (SELECT 'Mejor horario para engagement financiero: ' || hour || ':00' FROM hours WHERE fin > 0 ORDER BY fin DESC, hour LIMIT 1)
UNION ALL SELECT 'risk_factors', 'Alta volatilidad detectada en ' || count(*) || ' monedas' FROM stats WHERE volatility > avg_price * 0.5 HAVING count(*) > 0
UNION ALL SELECT 'risk_factors', count(*) || ' mensajes con patrones sospechosos detectados' FROM flags WHERE phones > 2 OR emails > 2 HAVING count(*) > 0"""


@query("t18_executive_summary", _SUMMARY_SQL)
def t18(spark, d):
    return T.executive_summary(event_messages(spark, d), event_matches(spark, d, ["monedas_explicitas"]), flags(spark, d))


def _section(name, oracle, *columns):
    """Lines of a report section from the SQL of the measure's own query; ``d:`` marks fractions."""
    text = lambda c: f"'{c[2:]}=' || CAST(CAST({c[2:]} AS DECIMAL(30,4)) AS VARCHAR)" if c.startswith("d:") else f"'{c}=' || CAST(\"{c}\" AS VARCHAR)"
    body = " || '; ' || ".join(text(c) for c in columns)
    return f"SELECT '{name}' AS section, {body} AS line FROM ({ORACLES[oracle] if oracle in ORACLES else oracle})"


_TREND_REPORT = " UNION ALL ".join([
    _section("metadata", "SELECT count(*) AS total_messages_analyzed FROM events", "total_messages_analyzed"),
    _section("analysis_period", "t05_analysis_period", "start", "end", "days"),
    _section("price_statistics", "t03_price_statistics", "currency", "n", "d:min_price", "d:max_price", "d:avg_price", "d:volatility", "d:median"),
    _section("price_trend", "t04_price_trend", "currency", "n", "d:first_half", "d:second_half", "trend"),
    _section("hour", "t06_hourly_activity", "hour", "n"),
    _section("weekday", "t07_weekday_activity", "weekday", "n"),
    _section("patterns_by_hour", "t08_patterns_by_hour", "hour", "financial", "temporal", "urls"),
    _section("peak_hours", "t09_peak_hours", "hour", "n"),
    _section("recommended_hours", "t10_recommended_hours", "hour", "recommendation", "financial_activity"),
    _section("price_spikes", "t11_price_spikes", "currency", "d:volatility", "reason"),
    _section("night_activity", "t12_night_activity", "hour", "activity_count", "reason"),
    _section("contact_bursts", "t13_contact_bursts", "chat_id", "id", "phones", "emails", "reason"),
    _section("financial_weekdays", "t14_financial_weekdays", "weekday", "n", "most_active"),
    _section("social_financial", "t15_social_financial", "d:ratio", "both", "total"),
    _section("contact_technical", "t16_contact_technical", "d:ratio", "both", "total", "implications"),
    f"SELECT section, line FROM ({ORACLES['t17_correlation_insights']})",
    f"SELECT section, line FROM ({_SUMMARY_SQL})",
])


@query("t19_trend_report", _TREND_REPORT)
def t19(spark, d):
    from ..operators.reports import trend_report

    return trend_report(event_messages(spark, d))


@query("t20_activity_bars", """WITH a AS (SELECT 'hour' AS unit, CAST(hour(ts) AS VARCHAR) AS slot, count(*) AS n FROM events GROUP BY hour(ts)),
b AS (SELECT 'weekday' AS unit, dayname(ts) AS slot, count(*) AS n FROM events GROUP BY dayname(ts))
SELECT unit, slot, n, round(n / max(n) OVER ()::DOUBLE, 6) AS bar FROM a UNION ALL SELECT unit, slot, n, round(n / max(n) OVER ()::DOUBLE, 6) FROM b""")
def t20(spark, d):
    m = event_messages(spark, d).select("ts")
    hours = T.activity_bars(T.hourly_activity(m)).select(F.lit("hour").alias("unit"), F.col("hour").cast("string").alias("slot"), "n", "bar")
    days = T.activity_bars(T.daily_activity(m)).select(F.lit("weekday").alias("unit"), F.col("weekday").alias("slot"), "n", "bar")
    return rounded(hours.unionByName(days), "bar", places=6)
