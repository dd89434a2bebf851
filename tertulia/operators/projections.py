"""Column work on raw exports: senders, reactions, mentions, media, chat lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c) != "", c)


def sender_id(peer: Column) -> Column:
    return F.coalesce(peer["user_id"], peer["chat_id"], peer["channel_id"])


def full_name(first, last) -> Column:
    return F.concat_ws(" ", _text(first), _text(last))


def sender_name(title, first, last) -> Column:
    return F.coalesce(_text(title), full_name(first, last))


def alarm_sender(username, first, ident) -> Column:
    i = F.col(ident) if isinstance(ident, str) else ident
    return F.coalesce(_text(username), _text(first), i.cast("string"), F.lit("unknown"))


def preview_sender(first, last, title, username) -> Column:
    u = _text(username)
    return F.coalesce(_text(full_name(first, last)), _text(title), F.when(u.isNotNull(), F.concat(F.lit("@"), u)), F.lit(""))


def reaction_map(results: Column) -> Column:
    """Array of (emoticon, count) to a map; entries without an emoticon are dropped."""
    named = F.filter(results, lambda r: r["emoticon"].isNotNull())
    return F.map_from_entries(F.transform(named, lambda r: F.struct(r["emoticon"], r["count"])))


def mentions(text, entities) -> Column:
    """Mentioned pieces of the text with their user where known."""
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(entities, lambda e: F.struct(
        e["user_id"].alias("user_id"), F.substring(t, e["offset"] + 1, e["length"]).alias("text")))


def media(message_id, kind, attributes, images: bool = True, audio: bool = True, documents: bool = True) -> Column:
    """Media descriptor from its kind and document attributes, under the download options."""
    i = (F.col(message_id) if isinstance(message_id, str) else message_id).cast("string")
    k = F.col(kind) if isinstance(kind, str) else kind
    attrs = F.coalesce(attributes, F.array().cast("array<struct<mime_type:string,voice:boolean,file_name:string>>"))
    voice = F.exists(attrs, lambda a: F.coalesce(a["voice"], F.lit(False)))
    sound = voice | F.exists(attrs, lambda a: F.coalesce(a["mime_type"].startswith("audio/"), F.lit(False)))
    named = F.get(F.filter(attrs, lambda a: _text(a["file_name"]).isNotNull()), F.lit(0))["file_name"]
    none = F.lit(None).cast("string")
    mtype = (F.when((k == "photo") & F.lit(images), "photo")
             .when((k == "document") & sound & F.lit(audio), "audio")
             .when((k == "document") & F.lit(documents), "document")
             .when(k == "document", "unsupported"))
    name = (F.when(mtype == "photo", F.concat(F.lit("photo_"), i, F.lit(".jpg")))
            .when(mtype == "audio", F.concat(F.lit("audio_"), i, F.when(voice, ".ogg").otherwise(".mp3")))
            .when(mtype == "document", F.coalesce(F.concat(i, F.lit("_"), named), F.concat(F.lit("document_"), i))).otherwise(none))
    return F.struct(mtype.alias("type"), name.alias("filename"))


def chat_name(title, first, last, username) -> Column:
    return F.coalesce(_text(title), _text(full_name(first, last)), _text(username))


def user_display_name(name, username, ident) -> Column:
    n, u = _text(name), _text(username)
    i = F.col(ident) if isinstance(ident, str) else ident
    return (F.when(n.isNotNull() & u.isNotNull(), F.concat(n, F.lit(" @"), u)).when(n.isNotNull(), n)
            .when(u.isNotNull(), F.concat(F.lit("@"), u)).otherwise(F.concat(F.lit("Usuario "), i.cast("string"))))


def preview_line(date, sender, text, media_col=None) -> Column:
    """``date — sender: text`` with the media note."""
    base = F.concat(F.coalesce(date, F.lit("")), F.lit(" — "), F.coalesce(sender, F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")))
    if media_col is None:
        return base
    m = F.col(media_col) if isinstance(media_col, str) else media_col
    note = (F.when(m.isNull(), "").when(F.coalesce(m["downloaded"], F.lit(False)), F.concat(F.lit(" [Media: "), F.coalesce(m["filename"], F.lit("file")), F.lit("]")))
            .otherwise(" [Media: no descargado]"))
    return F.concat(base, note)


def latest_previews(messages: DataFrame, n: int = 50) -> DataFrame:
    """Newest n messages of each chat that have text or media."""
    has = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    if "media" in messages.columns:
        has = has | F.col("media.type").isNotNull()
    w = W.partitionBy("chat_id").orderBy(F.col("ts").desc(), F.col("id").desc())
    return messages.filter(has).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def chat_categories(chats: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """One row per chat and list it appears in: all, unread, personal or groups, folder; own chat first in `rank`.

    chats: id, name, kind (user/chat/channel/other), is_self, unread_count, folder_id.
    folders: folder_id, folder_name; a folder without chats has no row.
    """
    own = F.coalesce("is_self", F.lit(False))
    named = chats.withColumn("name", F.when(own, "💾 Mensajes guardados").otherwise(F.col("name")))
    person = (F.col("kind") == "user") & ~own
    group = F.col("kind").isin("chat", "channel")
    lists = F.filter(F.array(
        F.lit("all"), F.when(F.coalesce("unread_count", F.lit(0)) > 0, "unread"), F.when(own, "saved"),
        F.when(person, "personal").when(group, "groups").when(~own, "personal")), lambda x: x.isNotNull())
    rank = F.when(own, 0).otherwise(1).cast("long")
    out = named.select("id", "name", "unread_count", rank.alias("rank"), F.explode(lists).alias("category"))
    if folders is not None:
        f = named.join(folders, "folder_id").select("id", "name", "unread_count", rank.alias("rank"),
                                                   F.concat(F.lit("folder:"), F.col("folder_name")).alias("category"))
        out = out.unionByName(f)
    return out
