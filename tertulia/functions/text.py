"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A word in the sense of the Unicode class \w; written with properties so that
# other SQL engines read it the same way.
WORD = r"[\p{L}\p{N}_]+"

# Spanish and English function words left out of content words.
STOP_WORDS = (
    "a al algo como con cual cuando de del desde donde el ella ellos en entre era es esa ese eso esta "
    "este esto fue ha hay la las le les lo los me mi muy más ni no nos o para pero por que qué se ser si "
    "sin sobre son su sus te tu un una uno y ya yo the of and to in is it that for on with as are be by this"
).split()


def words(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def content_words(text) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_except(F.array_distinct(words(text)), stop)


def jaccard(a, b, both_empty: float = 0.0) -> Column:
    """Set overlap of two distinct-element arrays; the union size needs no second set build."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(float(both_empty))).otherwise(
        common.cast("double") / union.cast("double")
    )


def clean_for_analysis(text) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[^\w\s.,!?¿¡]", ""))


def sanitize_filename(name) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def truncate(text, n: int) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def strip_markup(text) -> Column:
    """Markdown or HTML to plain text: text nodes joined by one space.

    Covers script/style bodies, comments, tags, the common named and numeric
    entities, and Markdown headings, emphasis, code marks, links, images,
    quotes and bullets.
    """
    t = F.col(text) if isinstance(text, str) else text
    steps = [
        (r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " "),
        (r"(?s)<!--.*?-->", " "),
        (r"(?s)<!?/?[A-Za-z][^>]*>", " "),
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)^\s{0,3}(#{1,6}|>|[-*+])\s+", ""),
        (r"(\*\*|__|~~|`+)", ""),
        (r"&nbsp;|&#160;", " "),
        (r"&lt;", "<"),
        (r"&gt;", ">"),
        (r"&quot;|&#34;", '"'),
        (r"&#39;|&apos;", "'"),
        (r"&amp;", "&"),
        (r"\s+", " "),
    ]
    for pattern, to in steps:
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


def intention(text) -> Column:
    """Seven-way intention label by ordered substring tests."""
    low = F.lower(text)
    # Marker words of each intention, in test order.
    markers = [
        ("question", ["?", "¿"]),
        ("offer", ["vendo", "disponible", "tengo"]),
        ("request", ["busco", "necesito", "compro"]),
        ("gratitude", ["gracias", "thank"]),
        ("greeting", ["hola", "hi", "hello", "buenos"]),
    ]
    # Speech verbs that open a statement of information, in their common forms.
    information = r"(?U)\b(dec(ir|imos)|dig[oa]|dice[ns]?|inform(ar|o|a|an|amos)|comunic(ar|o|a|an|amos))\b"
    out = None
    for label, marks in markers:
        hit = None
        for m in marks:
            c = F.contains(low, F.lit(m))
            hit = c if hit is None else hit | c
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.when(F.regexp_like(low, F.lit(information)), "information").otherwise("statement")


# Emoji code-point runs counted for pair features.
EMOJI_RUN = (
    r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}"
    r"\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}"
    r"\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
)


def emoji_runs(text) -> Column:
    return F.regexp_count(text, F.lit(EMOJI_RUN))


def has_url(text) -> Column:
    return F.regexp_like(text, F.lit(r"(?i)https?://\S+|www\.\S+"))


def all_caps(text) -> Column:
    letters = F.regexp_replace(text, r"\P{L}", "")
    return (letters != "") & (letters == F.upper(letters)) & (letters != F.lower(letters))
