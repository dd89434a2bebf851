"""Readers of chat exports, pair rows and labelled text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from .. import schema as S


def _documents(spark: SparkSession, paths) -> DataFrame:
    return spark.read.option("ignoreMissingFiles", True).text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def first_existing(spark: SparkSession, names: list[str], folders: tuple[str, ...] = ("", "chats")) -> list[str]:
    """For each export its path in the first of the folders that has it; exports that none has are left out.

    A name that is a path of its own is found as it stands.  Only names are
    looked up; nothing is read.
    """
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()

    def found(path):
        at = jvm.Path(path)
        return at.getFileSystem(conf).exists(at)

    out = []
    for name in names:
        path = next((p for p in (f"{f.rstrip('/')}/{name}" if f else name for f in folders) if found(p)), None)
        if path is not None:
            out.append(path)
    return out


def read_named(spark: SparkSession, names: list[str], folders: tuple[str, ...] = ("", "chats")) -> DataFrame:
    """Messages of the named exports, each from the first folder that has it."""
    return read_messages(spark, first_existing(spark, names, folders) or [_none(spark)])


def _none(spark: SparkSession) -> str:
    """A path without files."""
    from ..session import new_table_path

    path = new_table_path(spark, "none")
    spark.range(0).select(F.lit("").alias("value")).write.text(path)
    return path


def read_exports(spark: SparkSession, paths) -> DataFrame:
    """One row per readable export: file, chat_id, chat_name, messages.

    Object documents and bare message lists are both accepted; any other shape
    gives an empty list.  ``chat_id`` is the rank of the file name: the files
    are listed once and ranked over that (file-count sized) listing, unreadable files included.
    """
    opts = {"mode": "PERMISSIVE"}
    docs = _documents(spark, paths)
    is_list = F.ltrim("value").startswith("[")
    parsed = docs.select(
        "file",
        F.when(~is_list, F.from_json("value", S.EXPORT, opts)).alias("doc"),
        F.when(is_list, F.from_json("value", T.ArrayType(S.MESSAGE), opts)).alias("bare"),
        F.get_json_object("value", "$").isNotNull().alias("ok"),
    ).filter("ok")
    names = docs.select("file")
    ranks = names.select("file", (F.row_number().over(W.orderBy("file")) - 1).cast("long").alias("chat_id"))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.json$", "")
    return parsed.join(ranks, "file").select(
        "file",
        "chat_id",
        F.coalesce(F.col("doc.metadata.chat_name"), F.url_decode(stem)).alias("chat_name"),
        F.col("doc.metadata").alias("metadata"),
        F.coalesce("doc.messages", "bare", F.array().cast(T.ArrayType(S.MESSAGE))).alias("messages"),
    )


def read_messages(spark: SparkSession, paths) -> DataFrame:
    """The canonical ``messages`` table of a directory of exports."""
    rows = read_exports(spark, paths).select(
        "file", "chat_id", F.col("chat_name").alias("export_name"), F.explode("messages").alias("m")
    )
    return normalize_messages(
        rows.select("file", "chat_id", "export_name", "m.*")
    )


def read_message_lines(spark: SparkSession, path: str) -> DataFrame:
    """The ``messages`` table from JSON lines as `sinks.write_export` lays them out; chats of any size are split over tasks."""
    fields = [f for f in S.MESSAGE.fields if f.name not in ("chat_id", "chat_name")]
    schema = T.StructType([*fields, T.StructField("chat_id", T.LongType()), T.StructField("chat_name", T.StringType())])
    raw = spark.read.schema(schema).json(path).withColumn("file", F.col("_metadata.file_path")).withColumn("export_name", F.col("chat_name"))
    return normalize_messages(raw)


def normalize_messages(raw: DataFrame) -> DataFrame:
    """Parse dates once, resolve the two spellings of user and time, drop id-less rows."""
    user = F.coalesce(F.col("sender_id"), F.col("user_id"))
    return (
        raw.filter(F.col("id").isNotNull())
        .withColumn("date", F.coalesce("date", "timestamp"))
        .withColumn("ts", F.try_to_timestamp("date"))
        .withColumn("sender_id", user)
        .withColumn("user_key", F.coalesce(F.col("sender_id").cast("string"), F.col("sender_name")))
        .drop("user_id", "timestamp")
    )


def chat_display_names(messages: DataFrame) -> DataFrame:
    """Names seen in the messages, else the cleaned file name, else 'Chat'."""
    valid = F.when((F.col("chat_name") != "unknown") & (F.col("chat_name") != ""), F.col("chat_name"))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.json$", "")
    stem = F.regexp_replace(stem, r"_\d{4}-\d{2}-\d{2}_\d{4}-\d{2}-\d{2}$", "")
    cleaned = F.trim(F.regexp_replace(stem, "_+", " "))
    names = messages.groupBy("chat_id", "file").agg(F.array_sort(F.collect_set(valid)).alias("names"))
    return names.select(
        "chat_id",
        F.when(F.size("names") > 0, F.col("names"))
        .when(cleaned != "", F.array(cleaned))
        .otherwise(F.array(F.lit("Chat")))
        .alias("chats_analyzed"),
    )


def between_days(messages: DataFrame, first, last, ts: str = "ts") -> DataFrame:
    """Calendar-day range, both ends kept, written as a half-open range on the raw column so it reaches the scan."""
    lo, hi = F.to_timestamp(F.lit(str(first))), F.to_timestamp(F.lit(str(last)))
    return messages.filter((F.col(ts) >= lo) & (F.col(ts) < hi + F.expr("interval 1 day")))


def between_times(messages: DataFrame, a, b, ts: str = "ts") -> DataFrame:
    """Instant range, both ends kept; swapped bounds are put in order."""
    lo, hi = F.to_timestamp(F.lit(str(a))), F.to_timestamp(F.lit(str(b)))
    return messages.filter(F.col(ts).between(F.least(lo, hi), F.greatest(lo, hi)))


def read_pairs(spark: SparkSession, path) -> DataFrame:
    """Pair rows from JSON lines; blank lines give no row."""
    return spark.read.schema(S.PAIR).json(path).filter(F.col("a").isNotNull())


def read_labelled(spark: SparkSession, path, text_col="texto", label_col="sentimiento", label_map=None) -> DataFrame:
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    label = (label_map or truthy_label)(F.col(label_col))
    return raw.select(F.col(text_col).alias("text"), label.alias("label"))


def truthy_label(c: Column) -> Column:
    """Default label rule: a number whose whole part is one, or a positive word, is 1."""
    # Words read as a positive label.
    words = ["true", "positivo", "pos", "p", "yes", "y"]
    s = F.lower(F.trim(c.cast("string")))
    number = s.try_cast("double")
    return F.when(number.isNotNull(), (number >= 1) & (number < 2)).otherwise(
        F.coalesce(s.isin(words), F.lit(False))
    ).cast("int")


def threshold_label(t: float, strict: bool = False):
    """Label rule ``value >= t`` (or ``> t``); unreadable values are 0."""

    def rule(c: Column) -> Column:
        v = c.try_cast("double")
        return F.coalesce((v > t) if strict else (v >= t), F.lit(False)).cast("int")

    return rule
