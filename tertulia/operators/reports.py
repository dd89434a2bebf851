"""Whole reports assembled from the single measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from . import trends as T


PLACES = 4


def _line(df: DataFrame, *columns: str) -> Column:
    """``name=value`` of each column; fractions with a fixed number of places."""
    kinds = dict(df.dtypes)
    text = lambda c: F.round(c, PLACES).cast(f"decimal(30,{PLACES})").cast("string") if kinds[c] == "double" else F.col(c).cast("string")
    return F.concat_ws("; ", *[F.concat(F.lit(c + "="), text(c)) for c in columns])


def report_sections(messages: DataFrame) -> dict[str, DataFrame]:
    """Every measure of the trend report as a table of its own.

    The texts are scanned once; prices and flags are written down, and each
    measure is a small aggregate of one of them.
    """
    flags, hits = T.flags_and_prices(messages)
    series = T.price_series(hits)
    statistics = materialize(T.price_statistics(series), "price_statistics")
    top = T.most_active_day(flags).select("weekday", F.lit(True).alias("most_active"))
    period = T.analysis_period(flags)
    return {
        "metadata": flags.agg(F.count("*").alias("total_messages_analyzed")),
        "analysis_period": period.select(F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "days"),
        "price_statistics": statistics,
        "price_trend": T.price_trend(series),
        "hour": T.hourly_activity(flags),
        "weekday": T.daily_activity(flags),
        "patterns_by_hour": T.patterns_by_hour(flags),
        "peak_hours": T.peak_hours(flags),
        "recommended_hours": T.recommended_hours(flags),
        "price_spikes": T.price_spikes(statistics),
        "night_activity": T.night_activity(flags),
        "contact_bursts": T.contact_bursts(flags),
        "financial_weekdays": T.financial_by_weekday(flags).join(top, "weekday", "left").withColumn("most_active", F.coalesce("most_active", F.lit(False))),
        "social_financial": T.social_financial(flags),
        "contact_technical": T.contact_technical(flags),
        "insight": T.correlation_insights(flags).select("line"),
        "summary": T.executive_summary(flags, hits, flags),
    }


def trend_report(messages: DataFrame) -> DataFrame:
    """The whole trend report as (section, line) rows."""
    out = None
    for name, df in report_sections(messages).items():
        if name == "summary":
            rows = df.select("section", "line")
        elif df.columns == ["line"]:
            rows = df.select(F.lit(name).alias("section"), "line")
        else:
            rows = df.select(F.lit(name).alias("section"), _line(df, *df.columns).alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out


def iso_strings(df: DataFrame) -> DataFrame:
    """Every timestamp column as an ISO-8601 string, nested ones left to the JSON writer's format."""
    cols = [
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(c) if t in ("timestamp", "timestamp_ntz") else F.col(c)
        for c, t in df.dtypes
    ]
    return df.select(*cols)
