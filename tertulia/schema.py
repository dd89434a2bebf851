"""Fixed schemas of the canonical tables."""

from pyspark.sql import types as T

MENTION = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("text", T.StringType()),
])

MEDIA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("downloaded", T.BooleanType()),
])

MESSAGE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("sender_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("sender_name", T.StringType()),
    T.StructField("sender_username", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("reactions", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("mentions", T.ArrayType(MENTION)),
    T.StructField("reply_id", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("chat_name", T.StringType()),
    T.StructField("media", MEDIA),
])

METADATA = T.StructType([
    T.StructField("chat_name", T.StringType()),
    T.StructField("start_date", T.StringType()),
    T.StructField("end_date", T.StringType()),
    T.StructField("total_messages", T.LongType()),
    T.StructField("generated_at", T.StringType()),
])

EXPORT = T.StructType([
    T.StructField("metadata", METADATA),
    T.StructField("messages", T.ArrayType(MESSAGE)),
])

PAIR_SIDE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("sender_id", T.LongType()),
    T.StructField("date", T.StringType()),
])

PAIR = T.StructType([
    T.StructField("a", PAIR_SIDE),
    T.StructField("b", PAIR_SIDE),
    T.StructField("label", T.IntegerType()),
    T.StructField("time_delta_min", T.DoubleType()),
    T.StructField("same_author", T.IntegerType()),
    T.StructField("chat_id", T.LongType()),
    T.StructField("hard_negative", T.BooleanType()),
    T.StructField("features_extra", T.StructType([
        T.StructField("len_a", T.IntegerType()),
        T.StructField("len_b", T.IntegerType()),
        T.StructField("tfidf_jaccard", T.DoubleType()),
        T.StructField("seq_ratio", T.DoubleType()),
        T.StructField("emoji_diff", T.IntegerType()),
        T.StructField("both_have_url", T.IntegerType()),
        T.StructField("both_all_caps", T.IntegerType()),
    ])),
])

ALARM = T.StructType([
    T.StructField("alarm_id", T.IntegerType()),
    T.StructField("chat_id", T.LongType()),
    T.StructField("chat_title", T.StringType()),
    T.StructField("interval", T.StructType([
        T.StructField("months", T.IntegerType()),
        T.StructField("days", T.IntegerType()),
        T.StructField("hours", T.IntegerType()),
        T.StructField("minutes", T.IntegerType()),
    ])),
    T.StructField("date_from", T.TimestampType()),
    T.StructField("date_to", T.TimestampType()),
    T.StructField("patterns", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("type", T.StringType()),
    ]))),
    T.StructField("last_analyzed_message_id", T.LongType()),
    T.StructField("last_analysis_time", T.TimestampType()),
    T.StructField("total_runs", T.IntegerType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("next_run", T.TimestampType()),
])
