"""Engine tables derived from the driver tables, with the same derivation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns of a table for work that is heavy per row."""
    return spread(table(spark, sf_dir, name).select(*columns))


# Sentence tails that give the event messages every kind of pattern.
# {m} stands for a number taken from the event id.
TAILS = [
    "gracias por todo",
    "escribe a vendedor{m}@correo.com o visita https://tienda.example.com/p/{m}",
    "llama al +53 555 12 34 {m} o al 52345678",
    "#rebaja #oferta{m} @tienda 😀 🚀",
    "coordenadas 23.1136, -82.3666 servidor 192.168.1.{m}",
    "billetera 0xab12cd34ab12cd34ab12cd34ab12cd34ab12cd34",
    "tarjeta 4111 1111 1111 1{m}",
    "libro ISBN 9780306406157",
    "placa ABC {m} pesa 12.5 kg y mide {m} cm",
    "rebaja de {m}% off hoy",
    "suma 2 + 3 = 5 OFERTA REAL",
    'muuuy bueno "garantia total" (sin caja {m})',
    "rango 10-{m} usd",
    "entre 50 y {m} mn",
    "otro {m} en mlc",
    "antes $20 usd",
    "cuesta {m}.50 y subio a 30",
    "precio: {m} por 40",
    "rebajado a {m}",
    "entrega 12/05/2024 o 15 de enero de 2024 o marzo 3, 2024",
    "hoy o pasado mañana, hace {m} semanas",
    "esta semana o este finde o el mes que viene o este año",
    "el lunes en verano antes de navidad",
    "esta tarde o al dia siguiente o recientemente, ¿tienes?",
    "servicio excelente pero muy lento",
    "no es bueno y nunca recomiendo esa calidad baja",
    "me encanta, muy rápido y fácil de usar",
    "contactos a@b.com c@d.com e@f.com ip 10.0.0.{m}",
    "ver https://github.com/u{m}/r/issues/{m} y https://www.youtube.com/watch?v=abc{m}",
]
CURRENCY_BY_REMAINDER = ["usd", "mn", "mlc", "eur"]


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as chat messages: chat_id, id, sender_id, user_key, sender_name, ts, text."""
    return as_event_messages(text_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value"))


def as_event_messages(e: DataFrame) -> DataFrame:
    m = (F.col("event_id") % 90 + 10).cast("string")
    tail = F.replace(
        F.element_at(F.array(*[F.lit(t) for t in TAILS]), (F.col("event_id") % len(TAILS) + 1).cast("int")),
        F.lit("{m}"), m,
    )
    cur = F.element_at(F.array(*[F.lit(c) for c in CURRENCY_BY_REMAINDER]), (F.col("event_id") % 4 + 1).cast("int"))
    amount = F.col("value").cast("decimal(10,2)").cast("string")
    text = F.concat(F.lit("Vendo "), "event_type", F.lit(" a "), amount, F.lit(" "), cur, F.lit(" "), tail)
    return e.select(
        (F.col("user_id") % 10).alias("chat_id"), F.col("event_id").alias("id"), F.col("user_id").alias("sender_id"),
        F.col("user_id").cast("string").alias("user_key"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("sender_name"),
        F.col("ts").cast("timestamp").alias("ts"), text.alias("text"),
    )


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


EVENT_MESSAGES = f"""
messages AS (
  SELECT user_id % 10 AS chat_id, event_id AS id, user_id AS sender_id, CAST(user_id AS VARCHAR) AS user_key,
         'user ' || CAST(user_id AS VARCHAR) AS sender_name, ts,
         'Vendo ' || event_type || ' a ' || CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) || ' '
         || ([{", ".join(_q(c) for c in CURRENCY_BY_REMAINDER)}])[event_id % 4 + 1] || ' '
         || replace(([{", ".join(_q(t) for t in TAILS)}])[event_id % {len(TAILS)} + 1],
                    '{{m}}', CAST(event_id % 90 + 10 AS VARCHAR)) AS text
  FROM events)"""


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` as chat messages with explicit replies to the previous turn."""
    c = text_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn") * 90)
    return c.select(
        (F.col("conv_id") % 10).alias("chat_id"), (F.col("conv_id") * 100 + F.col("turn") + 1).alias("id"),
        F.col("role").alias("sender_name"), F.col("role").alias("user_key"),
        F.when(F.col("turn") > 0, F.col("conv_id") * 100 + F.col("turn")).alias("reply_id"),
        start.alias("ts"), F.col("text"),
    )


CONVERSATION_MESSAGES = """
messages AS (
  SELECT conv_id % 10 AS chat_id, conv_id * 100 + turn + 1 AS id, role AS sender_name, role AS user_key,
         CASE WHEN turn > 0 THEN conv_id * 100 + turn END AS reply_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn * 90) AS ts, text
  FROM conversations)"""
