"""Writers of exports, graphs, pairs, predictions and state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import sanitize_filename
from ..operators.reports import iso_strings

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_messages(messages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Messages as JSON lines under one folder per chat name; no chat is gathered in one place."""
    messages.withColumn("chat_folder", sanitize_filename(F.col("chat_name"))).write.mode(mode).option(
        "timestampFormat", ISO).partitionBy("chat_folder").json(path)


def export_documents(messages: DataFrame) -> DataFrame:
    """Nested export document per chat: one document is one value, so use `write_export` for chats of any size."""
    cols = [c for c in messages.columns if c not in ("chat_id", "chat_name")]
    g = messages.groupBy("chat_id", "chat_name").agg(
        F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "id", F.struct(*cols).alias("m")))).alias("s"))
    meta = F.struct(F.col("chat_name"), F.to_date("a").alias("start_date"), F.to_date("b").alias("end_date"), F.col("n").alias("total_messages"),
                    F.current_timestamp().alias("generated_at"))
    return g.select(_chat_folder().alias("chat_folder"), meta.alias("metadata"), F.transform("s", lambda x: x["m"]).alias("messages"))


def _chat_folder() -> Column:
    """Names that look alike once cleaned stay apart by the chat's number."""
    return F.concat_ws("-", F.col("chat_id").cast("string"), sanitize_filename(F.col("chat_name")))


def write_documents(messages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One indented JSON document per chat, each in a folder of its own."""
    body = F.to_json(F.struct("metadata", "messages"), {"pretty": "true", "timestampFormat": ISO})
    export_documents(messages).select("chat_folder", body.alias("value")).write.mode(mode).partitionBy("chat_folder").text(path)


def write_export(messages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Chats of any size as JSON lines in one folder per chat; `exports.read_message_lines` reads them."""
    messages.withColumn("chat_folder", _chat_folder()).write.mode(mode).option("timestampFormat", ISO).partitionBy("chat_folder").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nodes and edges as two tables, partitioned by nothing: both are keyed by chat inside."""
    nodes.write.mode(mode).parquet(f"{path}/nodes")
    edges.write.mode(mode).parquet(f"{path}/edges")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    iso_strings(df).write.mode(mode).option("timestampFormat", ISO).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_results(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def pending(rows: DataFrame, done: DataFrame | None, key: list[str]) -> DataFrame:
    """Rows not yet in the saved output, for a run that takes up where the last one stopped."""
    return rows if done is None else rows.join(done.select(*key), key, "left_anti")


def append_predictions(rows: DataFrame, path: str, key: list[str], predict, saved: DataFrame | None) -> DataFrame:
    todo = pending(rows, saved, key)
    predict(todo).write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


MANIFEST = "run long, name string, columns array<string>, rows long, saved_at timestamp"


def save_run(tables: dict[str, DataFrame], base: str, run: int) -> None:
    """The result tables of one run beside those of earlier runs, and a line for each in the manifest.

    A table is listed only when it is written whole, so a run that broke off is
    not read; a run that is saved again replaces its tables.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        path = f"{base}/tables/{name}/run={run}"
        df.write.mode("overwrite").parquet(path)
        rows = spark.read.schema(df.schema).parquet(path).count()
        line = spark.range(1).select(F.lit(run).cast("long").alias("run"), F.lit(name).alias("name"), F.array(*map(F.lit, df.columns)).alias("columns"),
                                     F.lit(rows).cast("long").alias("rows"), F.current_timestamp().alias("saved_at"))
        line.write.mode("overwrite").parquet(f"{base}/manifest/run={run}/name={name}")


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """What is saved: run, name, columns, rows, saved_at."""
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{base}/manifest")


def load_saved(spark: SparkSession, base: str, latest: bool = False) -> dict[str, DataFrame]:
    """Saved tables by name, with a column ``run``; columns that only some runs have are null in the others.

    ``latest`` keeps each table's last run only.  Tables are told apart by the
    manifest (names and runs reach the driver).
    """
    saved: dict[str, list[int]] = {}
    for r in manifest(spark, base).select("name", "run").orderBy("name", "run").collect():
        saved.setdefault(r["name"], []).append(r["run"])
    out = {}
    for name, runs in saved.items():
        paths = [f"{base}/tables/{name}/run={k}" for k in (runs[-1:] if latest else runs)]
        out[name] = spark.read.option("mergeSchema", True).option("basePath", f"{base}/tables/{name}").parquet(*paths).withColumn("run", F.col("run").cast("long"))
    return out
