"""Link classification: URL to platform, content type, ids and label.

All rules of a platform are one regular expression with one branch per rule.
One replace turns a URL into the captured pieces of the branch that fitted, so
a URL costs one regex run for its platform, and the first fitting rule wins
because alternatives are tried in order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls as U
from ..functions.reuse import once_per_application
from ..rules.links import FILE_TYPES, NOT_FILES, PLATFORMS, Platform

_H, _P, _Q, _S = "\u0002", "\u0003", "\u0004", "\u0001"
_SLOTS = ("mark", "u", "i", "x", "q")


@dataclass(frozen=True)
class CompiledRules:
    regex: str
    refs: str
    types: list[str]
    subs: list[str]
    consts: dict[str, list[str]]


def _repeat(line: str) -> list[str]:
    m = re.match(r"^(\S*)<([^<>]+)>(\S*)(.*)$", line)
    if not m:
        return [line]
    return [f"{m[1]}{w}{m[3]}{m[4].replace('<>', w)}" for w in m[2].split("|")]


def _path_regex(template: str, reserved: tuple[str, ...]) -> tuple[str, list[str]]:
    """Path part of a rule as a regex and the fields of its groups in order."""
    fields: list[str] = []

    def group(m):
        name, refuse, cls = m[1], m[2], m[3] or rf"[^/{_P}]+"
        ban = rf"(?!(?:{'|'.join(re.escape(r) for r in reserved)})[/?{_P}])" if refuse else ""
        if name == "_":
            return f"{ban}(?:{cls})"
        fields.append(name)
        return f"{ban}({cls})"

    raw = template.startswith("re:")
    body = template[3:] if raw else template
    anywhere = not raw and body.startswith("~")
    body = body[1:] if anywhere else body
    open_end = not raw and not anywhere and body.endswith("*")
    body = body[:-1] if open_end else body
    closed = anywhere and body.endswith("$")
    body = body[:-1] if closed else body
    out = re.sub(r"\{(\w)(!)?(?::((?:[^{}]|\{[^{}]*\})*))?\}", group, body)
    if not raw and not anywhere and body == "/":
        out = "/?"
    lead = ".*?" if anywhere else ""
    tail = ".*" if open_end or (anywhere and not closed) else ""
    return lead + out + tail, fields


def _query_regex(ask: str | None) -> tuple[str, bool]:
    if ask is None:
        return rf"[^{_Q}]*", False
    if ask.startswith("*"):
        return rf"[^{_Q}]*{re.escape(ask[1:])}[^{_Q}]*", False
    if ask.startswith("="):
        k, v = ask[1:].split(":")
        return rf"(?:[^{_Q}]*?&)?{k}={v}(?:&[^{_Q}]*)?", False
    if ask.startswith("."):
        return rf"(?:[^{_Q}]*?&)?{ask[1:]}=[^&{_Q}][^{_Q}]*", False
    return rf"(?:[^{_Q}]*?&)?{ask}=([^&{_Q}]+)[^{_Q}]*", True


def compile_rules(p: Platform) -> CompiledRules:
    branches, refs, types, subs = [], [], [], []
    consts: dict[str, list[str]] = {"u": [], "i": [], "x": []}
    n = 0
    for line in [x for raw in p.rules.strip().splitlines() for x in _repeat(raw)]:
        head, template, *rest = line.split(" ")
        kind, _, sub = head.partition("/")
        gate = re.match(r"^(=?)([A-Za-z0-9.]+)!(.*)$", template)
        host = rf"[^{_H}]*"
        if gate:
            name = re.escape(gate[2])
            host = name if gate[1] else rf"[^{_H}]*{name}[^{_H}]*"
            template = gate[3]
        path, fields = _path_regex(template, p.reserved)
        ask = next((t[1:] for t in rest if t.startswith("?")), None)
        frag = next((t[1:] for t in rest if t.startswith("#")), ".*")
        fixed = dict(t.split("=", 1) for t in rest if t[0] not in "?#")
        query, captured = _query_regex(ask)
        frag_re, frag_fields = re.subn(r"\{i:([^{}]*)\}", r"(\1)", frag)
        groups = ["mark", *fields, *(["q"] if captured else []), *(["i"] * frag_fields)]
        at = {}
        for g in groups:
            n += 1
            at.setdefault(g, n)
        branches.append(f"({host}{_H}{path}{_P}{query}{_Q}{frag_re})")
        refs.append(_S.join(f"${at[s]}" if s in at else "" for s in _SLOTS))
        types.append(kind)
        subs.append(sub)
        for c in consts:
            consts[c].append(fixed.get(c, ""))
    return CompiledRules("(?s)^(?:" + "|".join(branches) + ")$", _S.join(refs), types, subs, consts)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strings(values: list[str]) -> Column:
    return F.expr("array(" + ", ".join(_sql(v) for v in values) + ")")


def _mapping(entries: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in entries.items()) + ")")


def _by_platform(pick, platforms) -> Column:
    out = None
    for p in platforms:
        c = F.col("platform") == p.key
        out = F.when(c, pick(p)) if out is None else out.when(c, pick(p))
    return out


def bare_host(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def route(host: Column, platforms: list[Platform] = PLATFORMS, bare: Column | None = None) -> Column:
    """Platform of a host: a listed domain, with or without www., or any sub-domain where that is the rule.

    Every platform's test names ``host`` and ``bare`` (the host without www.), so
    on large tables both should be columns worked out before.
    """
    bare = bare_host(host) if bare is None else bare
    out = None
    for p in platforms:
        hit = host.isin(list(p.domains)) | bare.isin(list(p.domains))
        if p.any_subdomain:
            hit = hit | host.endswith(p.any_subdomain)
        out = F.when(hit, p.key) if out is None else out.when(hit, p.key)
    return out


def not_a_file(url: Column) -> Column:
    out = None
    for h in NOT_FILES:
        c = F.contains(url, F.lit(h))
        out = c if out is None else out | c
    return out


def file_class(url) -> Column:
    """Display name of the file class of a link, null for other links."""
    url = F.col(url) if isinstance(url, str) else url
    ext = F.lower(F.regexp_extract(url, r"\.([a-zA-Z0-9]+)(?:\?.*)?$", 1))
    out = None
    for name, exts in FILE_TYPES:
        c = ext.isin(list(exts))
        out = F.when(c, name) if out is None else out.when(c, name)
    return F.when(~not_a_file(url), out)


def file_label(url) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.concat(F.lit("["), file_class(url), F.lit(": "), F.element_at(F.split(url, "/"), -1), F.lit("]"))


def generic_label(host: Column) -> Column:
    parts = F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")
    name = F.get(parts, F.size(parts) - 2)
    cap = F.concat(F.upper(F.left(name, F.lit(1))), F.lower(F.substring(name, F.lit(2), F.length(name))))
    return F.when(F.size(parts) >= 2, F.concat(F.lit("[🔗 Enlace a "), cap, F.lit("]"))).otherwise("[🌐 Enlace externo]")


@dataclass(frozen=True)
class _Steps:
    """Column expressions of `classify`, one dict per projection."""

    steps: list[dict[str, Column]]


@once_per_application
def _steps(url: str, platforms: tuple[Platform, ...]) -> _Steps:
    rules = {p.key: compile_rules(p) for p in platforms}
    pf, parts, rule = F.col("platform"), F.col("_parts"), F.col("_rule")
    plain = F.when(pf.isin([p.key for p in platforms if p.strip]), F.regexp_replace("_path", "/+$", "")).otherwise(F.col("_path"))
    asked = F.when(pf.isin([p.key for p in platforms if p.with_query]) & (F.col("_query") != ""),
                   F.concat(plain, F.lit("?"), F.col("_query"))).otherwise(plain)
    subject = F.concat(F.col("_host"), F.lit(_H), asked, F.lit(_P), F.col("_query"), F.lit(_Q), F.col("_frag"))
    pieces = _by_platform(lambda p: F.regexp_replace("_subject", F.lit(rules[p.key].regex), F.lit(rules[p.key].refs)), platforms)
    step = len(_SLOTS)
    marks = F.transform(F.sequence(F.lit(0), (F.size(parts) / step).cast("int") - 1), lambda k: F.get(parts, k * step) != "")
    at = lambda k: F.coalesce(F.get(parts, rule * step + k), F.lit(""))
    of_rule = lambda pick: F.get(_by_platform(lambda p: _strings(pick(rules[p.key])), platforms), rule)
    fixed = lambda f: F.coalesce(of_rule(lambda r: r.consts[f]), F.lit(""))
    full = lambda k, f: F.when(at(k) != "", at(k)).otherwise(fixed(f))
    names = {p.key: p.types for p in platforms}
    look = lambda j: _by_platform(
        lambda p: F.element_at(_mapping({k: e[j] for k, e in names[p.key].items()}), F.col("content_type")), platforms)
    return _Steps([
        {"_host": U.host(url), "_path": U.path(url), "_query": U.query(url), "_frag": U.fragment(url)},
        {"_bare": bare_host(F.col("_host"))},
        {"platform": route(F.col("_host"), platforms, F.col("_bare"))},
        {"_subject": subject},
        {"_parts": F.split(pieces, _S)},
        {"_rule": F.when(F.size(parts) >= step, F.array_position(marks, True).cast("int") - 1)},
        {"content_type": F.coalesce(of_rule(lambda r: r.types), _by_platform(lambda p: F.lit(p.default), platforms)),
         "sub": F.coalesce(of_rule(lambda r: r.subs), F.lit("")), "user": full(1, "u"), "ident": full(2, "i"), "extra": full(3, "x"),
         "query_text": U.decode(at(4))},
        *_adjustments(),
        {"emoji": F.coalesce(look(0), _by_platform(lambda p: F.lit(p.emoji), platforms)), "type_name": F.coalesce(look(1), F.lit("Contenido"))},
        {"_platform_label": _by_platform(_label, platforms)},
        {"label": F.coalesce(file_label(url), F.col("_platform_label"), generic_label(F.col("_host")))},
    ])


def classify(urls: DataFrame, url: str = "url", platforms: list[Platform] = PLATFORMS) -> DataFrame:
    """Adds platform, content_type, sub, user, ident, extra, query_text, emoji, type_name, label."""
    d = urls
    for columns in _steps(url, tuple(platforms)).steps:
        d = d.withColumns(columns)
    return d.select(*urls.columns, "platform", "content_type", "sub", "user", "ident", "extra", "query_text", "emoji", "type_name", "label")


def _adjustments() -> list[dict[str, Column]]:
    """Host- and query-dependent changes that are not path rules."""
    pf, t, h, q = F.col("platform"), F.col("content_type"), F.col("_host"), F.col("_query")
    media = t.isin("video", "short", "live", "embedded", "playlist")
    music, kids = F.contains(h, F.lit("music.youtube.com")), F.contains(h, F.lit("youtubekids.com"))
    tube = pf == "youtube"
    sub_host = F.regexp_extract(h, r"^([^.]+)\.[^.]+\.", 1)
    blog = (pf == "tumblr") & (sub_host != "") & ~sub_host.isin("www", "tumblr")
    kind = (F.when(tube & music & media, F.concat(F.lit("music_"), t)).when(tube & music & (t == "channel_home"), "music")
            .when(tube & kids & media, F.concat(F.lit("kids_"), t)).when(tube & kids & (t == "channel_home"), "kids")
            .when(blog & (t == "tumblr_home"), "blog_home").otherwise(t))
    user = F.when(blog & (F.col("user") == ""), sub_host).when(pf == "telegram", F.regexp_replace("user", "^@", "")).otherwise(F.col("user"))
    words = (F.when((pf == "amazon") & (t == "search"), F.when(U.param(q, "k") != "", U.param(q, "k")).otherwise(U.param(q, "field-keywords")))
             .when(pf == "google", U.param(q, "q")).when(pf.isin("imgur", "stackoverflow"), F.replace(F.col("query_text"), F.lit("+"), F.lit(" ")))
             .when(pf == "pinterest", F.trim("query_text")).otherwise(F.col("query_text")))
    given = F.when(F.col("ident") != "", F.col("ident")).otherwise(F.col("query_text"))
    ident = F.when((pf == "threads") & (t == "search"), F.replace(given, F.lit("%20"), F.lit(" "))).otherwise(given)
    lang = F.when((pf == "stackoverflow") & (sub_host != "") & ~sub_host.isin("www", "stackoverflow"), sub_host).otherwise("")
    return [{"_lang": lang, "_kind": kind, "_user": user, "_ident": ident, "_words": words},
            {"content_type": F.col("_kind"), "user": F.col("_user"), "ident": F.col("_ident"), "query_text": F.col("_words")}]


def _cut(c: Column, n: int, over: int | None = None) -> Column:
    return F.when(F.length(c) > (over or n), F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def _opt(before: str, c: Column, after: str = "", when: Column | None = None) -> Column:
    """Piece of a label, empty when its value is."""
    test = c != "" if when is None else (c != "") & when
    return F.when(test, F.concat(F.lit(before), c, F.lit(after))).otherwise("")


def _joined(sep: str, first: str, *pieces: Column) -> Column:
    """Non-empty pieces joined, after a lead-in when there are any."""
    text = F.array_join(F.filter(F.array(*pieces), lambda x: x != ""), sep)
    return _opt(first, text)


def _label(p: Platform) -> Column:
    """Label of a platform link, from the classified columns."""
    e, n, t, s = F.col("emoji"), F.col("type_name"), F.col("content_type"), F.col("sub")
    u, i, x, q = F.col("user"), F.col("ident"), F.col("extra"), F.col("query_text")
    lit = F.lit
    site = lit(" de " + p.site)
    wrap = lambda *c: F.concat(lit("["), e, lit(" "), *c, lit("]"))
    titled = lambda *c: wrap(n, site, *c)
    asks = (t == "search") & (q != "")
    k = p.key
    if k in ("instagram", "likee"):
        short = _cut(i, 8)
        body = (F.when(u != "", F.concat(lit(" de @"), u, _opt(" - ID: ", short))).when(i != "", F.concat(lit(" - ID: "), short)).otherwise(site))
        return F.when(asks, wrap(n, lit(": "), _cut(q, 15))).otherwise(wrap(n, body)) if k == "likee" else wrap(n, body)
    if k == "youtube":
        ident = F.when((t == "search") | (t == "channel"), "").otherwise(i)
        start, at = U.param("_query", "start"), U.param("_query", "t")
        time = (F.when(s == "watch", F.when(at != "", at).otherwise(start)).when(s == "embed", F.when(start != "", start).otherwise(at))
                .when(s == "brief", at).otherwise(""))
        listed = F.when(s == "watch", U.param("_query", "list")).otherwise("")
        sections = F.element_at(F.create_map(*[lit(v) for v in ("videos", "Videos", "playlists", "Playlists", "community", "Comunidad", "about", "Acerca de")]), x)
        feeds = F.element_at(F.create_map(*[lit(v) for v in ("subscriptions", "Suscripciones", "trending", "Trending", "history", "Historial", "library", "Biblioteca")]), x)
        chan = (F.when(s == "name", F.concat(lit("Canal: "), u)).when(s == "handle", F.concat(lit("Canal: @"), u)).when(s == "id", F.concat(lit("Canal ID: "), u)).otherwise(""))
        return titled(_joined(" - ", " - ", F.when(t == "hashtag", F.concat(lit("#"), i)).otherwise(_opt("ID: ", ident)), chan, _opt("Playlist: ", listed),
                              _opt("Sección: ", F.coalesce(sections, x), when=t == "channel"), _opt("Feed: ", F.coalesce(feeds, x), when=t == "feed"),
                              _opt("Búsqueda: ", q, when=t == "search"), _opt("Tiempo: ", time)))
    if k == "twitter":
        with_id = t.isin("tweet", "photo", "video", "retweets", "likes", "list", "communities", "moments", "messages", "event", "space", "explore")
        tag = F.when(t == "hashtag", _opt("#", i)).when(with_id, _opt("- ID: ", i)).otherwise("")
        return F.when((t == "search") & (i != ""), titled(lit(": "), _cut(i, 20))).otherwise(titled(_joined(" ", " ", _opt("de @", u), tag)))
    if k in ("github", "gitlab"):
        shown = ["file", "directory", "commit", "issue", "wiki"] + (
            ["pull_request", "release", "project", "gist"] if k == "github" else
            ["merge_request", "tag", "snippet", "pipeline", "job", "milestone", "settings", "graphs", "network", "badge"])
        return titled(_opt(" de ", u), _opt("/", x), _opt(" - Archivo: ", i, when=t.isin(shown)))
    if k == "reddit":
        place = F.when(t == "user", _opt("de u/", u)).otherwise(_opt("en r/", u))
        ident = F.when(t.isin("post", "comment"), _opt("- ID: ", _cut(i, 8))).when(t == "wiki", _opt("- ", i)).otherwise("")
        return F.when(asks, wrap(n, lit(" en r/"), u, lit(": "), _cut(q, 15))).otherwise(titled(_joined(" ", " ", place, ident, _opt("(", x, ")"))))
    if k == "facebook":
        return titled(_opt(" (", s, ")"), _opt(" - ID: ", i))
    if k == "linkedin":
        short = F.when(t.isin("profile", "company"), i).otherwise(_cut(i, 8))
        return F.when(asks, wrap(n, lit(": "), _cut(q, 15))).otherwise(titled(_opt(" - ID: ", short), _opt(" (", s, ")")))
    if k == "threads":
        own = t.isin("profile", "profile_replies", "profile_reposts", "profile_likes")
        return F.when((t == "search") & (i != ""), wrap(n, lit(": "), _cut(i, 20))).otherwise(
            titled(_joined(", ", " - ", _opt("ID: ", i, when=t == "post"), _opt("@", u))))
    if k == "whatsapp":
        silent = t.isin("home", "chat", "chat_with_text", "business_home", "web_app", "web", "features", "security", "privacy", "terms")
        return titled(_opt(" - ID: ", i, when=~silent))
    if k == "discord":
        return titled(_opt(" - Servidor: ", u), _opt(" (Canal: ", i, ")"))
    if k == "flickr":
        who = F.when(t.isin("group", "user"), _opt(" - ID: ", u)).otherwise(_opt(" de ", u))
        return titled(who, _opt(" - ID: ", i))
    if k == "medium":
        page = i.isin("about", "latest", "search", "write")
        ident = F.when(t.isin("topic", "personal"), _opt("- ID: ", i)).when(page, "").otherwise(_opt("- ID: ", _cut(i, 8)))
        return F.when(asks, wrap(n, lit(": "), _cut(q, 15))).otherwise(titled(_joined(
            " ", " ", _opt("de @", u), _opt("en ", x), ident, _opt("(", i, ")", when=page), F.when(s == "featured", "(destacado)").otherwise(""))))
    if k == "pinterest":
        words = F.when(q != "", q).otherwise(i)
        own = t.startswith("profile_")
        ident = F.when(own, "").when(t == "pin", _opt("- ID: ", _cut(i, 8))).otherwise(_opt("- ", i))
        who = F.when(own, F.concat(lit("de @"), u, lit(" - "), n)).otherwise(_opt("de @", u))
        return F.when((t == "search") & (words != ""), titled(lit(": "), words)).otherwise(titled(_joined(" ", " ", who, ident)))
    if k == "snapchat":
        return titled(_joined(" ", " ", _opt("de ", u), _opt("- ", i)))
    if k == "stackoverflow":
        lang = F.col("_lang")
        name = F.when(lang == "es", F.concat(lit("Stack Overflow en español - "), n)).when(lang != "", F.concat(lit("Stack Overflow "), lang, lit(" - "), n)).otherwise(n)
        bare = t.isin("tag", "company", "documentation", "teams", "blog", "help", "badges", "tag_info", "tag_unanswered")
        ident = F.when(bare, i).otherwise(_opt("ID: ", i))
        return F.when(asks, wrap(name, lit(": "), _cut(q, 20))).otherwise(
            wrap(name, _joined(", ", " - ", ident, _opt("Respuesta: ", x), _opt("Usuario: ", u))))
    if k == "tumblr":
        ident = (F.when(t.isin("search", "blog_home", "tumblr_home"), "").when(t == "tag", _opt("#", i)).when(t == "explore", _opt("Categoría: ", i))
                 .when(t == "help", _opt("Artículo: ", i)).when(t == "blog", _opt("Post: ", i)).otherwise(_opt("ID: ", i)))
        return F.when((t == "search") & (i != ""), wrap(n, lit(": "), _cut(i, 20))).otherwise(titled(_joined(", ", " - ", _opt("de ", u), ident)))
    if k == "amazon":
        return titled(_opt(" - ID: ", i), _opt(" - Categoría: ", x), _opt(" - Búsqueda: '", q, "'", when=t == "search"))
    if k == "google":
        plain = t.isin("search", "gmail")
        body = (F.when(F.contains(t, lit("search")) & (q != ""), F.concat(lit(": "), _cut(q, 25)))
                .when(t.isin("photos_search", "maps_search") & (i != ""), F.concat(lit(": "), _cut(i, 25)))
                .when((i != "") & ~plain, F.concat(lit(" - ID: "), _cut(i, 15))).otherwise(""))
        return F.when(t.isin("translate", "contacts"), wrap(n)).otherwise(wrap(n, body))
    if k == "imgur":
        short = F.when(t == "gallery", _cut(i, 9, 10)).otherwise(_cut(i, 10))
        return (F.when(asks, wrap(n, lit(": "), _cut(q, 20))).when((t == "memegen") & (u != ""), wrap(n, lit(": "), u, lit("/"), x))
                .when(t == "subreddit", wrap(n, lit(" en r/"), u, lit(" - ID: "), i)).otherwise(wrap(n, _opt(" - ID: ", short))))
    if k == "telegram":
        return titled(_joined(", ", " - ", _opt("de @", u), _opt("ID: ", i, when=~t.isin("channel", "message")), _opt("Mensaje: ", x)))
    # label of platforms added by users
    shown = F.when(t != "profile", _opt(" - ", t)).otherwise("")
    return F.concat(lit("["), e, lit(" " + p.site), _opt(" de @", u), shown, _opt(" - ID: ", i), lit("]"))


def labels(urls: DataFrame, url: str = "url", platforms: list[Platform] = PLATFORMS) -> DataFrame:
    """Distinct URLs with their classification; repeated links are worked out once."""
    return classify(distinct_urls(urls.select(url), url), url, platforms)


URLS_PER_TASK = 500_000


def distinct_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct URLs in parts of about URLS_PER_TASK, which bounds what a task holds.

    The shuffle of a plain ``distinct`` is coalesced to about as many parts as
    there are cores, so a task would hold more the larger the table is.  URLs are
    made distinct per (URL, split) first, so a frequent one is no task of its own.
    """
    parts = max(urls.sparkSession.sparkContext.defaultParallelism, -(-urls.count() // URLS_PER_TASK))
    salt = F.pmod(F.spark_partition_id(), F.lit(parts))
    fewer = urls.withColumn("_split", salt).repartition(parts, url, "_split").distinct()
    return fewer.select(url).repartition(parts, url).distinct()


def message_urls(messages: DataFrame, text: str = "text", keys: tuple[str, ...] = ("chat_id", "id")) -> DataFrame:
    return messages.select(*keys, F.posexplode(U.find_urls(text)).alias("ord", "url"))


def rewrite(messages: DataFrame, text: str = "text", keys: tuple[str, ...] = ("chat_id", "id"), platforms: list[Platform] = PLATFORMS) -> DataFrame:
    """Texts with every URL replaced in place by its label.

    Only URLs travel: they are labelled once each, joined back by URL, and
    gathered per message in order of appearance.
    """
    found = message_urls(messages, text, keys)
    named = found.join(labels(found, "url", platforms).select("url", "label"), "url")
    per = named.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("_l"))
    pieces = F.split(F.col(text), U.URL, -1)
    put = F.array_join(F.zip_with(pieces, F.transform("_l", lambda x: x["label"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return messages.join(per, list(keys), "left").withColumn(text, F.when(F.col("_l").isNull(), F.col(text)).otherwise(put)).drop("_l")


def clean_messages(messages: DataFrame, text: str = "text", keys: tuple[str, ...] = ("chat_id", "id"), platforms: list[Platform] = PLATFORMS) -> DataFrame:
    """Links to labels, then markup to plain text."""
    from ..functions.text import strip_markup

    return rewrite(messages, text, keys, platforms).withColumn(text, strip_markup(text))


def statistics(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(F.coalesce("platform", F.lit("other")).alias("platform"), F.coalesce("content_type", F.lit("")).alias("content_type")).agg(
        F.count("*").alias("n"))


def register(platform: Platform, platforms: list[Platform] = PLATFORMS) -> list[Platform]:
    """Rule list with a user's platform added after the built-in ones."""
    return [*platforms, platform]
