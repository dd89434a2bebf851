import dataclasses

from pyspark.sql import functions as F

from tertulia.operators import matches as M, summaries as S, trends as T
from tertulia.rules.patterns import BY_KEY

TEXTS = {
    1: "Vendo laptop entre 100 y 200 usd o 150-180 mlc, escribe a ana@correo.com",
    2: "Nos vemos el 15 de enero de 2024 o pasado mañana #fiesta",
    3: "Llama al +53 555 12 34 56, b@c.org, 23.1, -82.3",
    4: "Servidor 10.0.0.1 pesa 3 kg y mide 20 cm https://a.b/c",
    5: "@pedro mira #añoño 😀 https://x.y/z",
    6: "Rebaja 25% off, 75,50 en mn hoy, ¡SÁBADO!",
}


def frame(spark):
    return spark.createDataFrame([(k, v) for k, v in TEXTS.items()], "id long, text string")


def hits(spark, *keys):
    got = M.extract_matches(frame(spark), keys or None).collect()
    out = {}
    for r in got:
        out.setdefault((r.key, r.id), []).append((r.ord, r.value))
    return {k: [v for _, v in sorted(vs)] for k, vs in out.items()}


def test_each_rule_on_the_six_messages(spark):
    h = hits(spark)
    assert h["monedas_explicitas", 1] == ["100-200 usd", "150-180 mlc"]
    assert h["monedas_explicitas", 6] == ["75,50 mn"]
    assert h["emails", 1] == ["ana@correo.com"]
    assert h["dates_spanish_format", 2] == ["15 de enero de 2024"]
    assert h["dates_relative_simple", 2] == ["pasado", "mañana"]
    assert h["hashtags", 5] == ["#añoño"]
    assert h["phone_numbers", 3][0].startswith("+53 555")
    assert h["coordinates", 3] == ["23.1, -82.3"]
    assert h["ip_addresses", 4] == ["10.0.0.1"]
    assert h["measurements", 4] == ["3 kg", "20 cm"]
    assert h["percentages", 6] == ["25%"] and h["discounts_percent", 6] == ["25"]
    assert h["dates_weekdays", 6] == ["SÁBADO"]
    assert h["emojis", 5] == ["😀"] and h["mentions", 5] == ["@pedro"]
    assert h["urls_raw", 4] == ["https://a.b/c"]


def test_branches_follow_the_hit(spark):
    rows = M.with_money_branches(M.extract_matches(frame(spark), ["monedas_explicitas"])).collect()
    assert {(r.key, r.id) for r in rows} >= {("currency_ranges_extended", 1), ("currency_ranges", 1), ("currency_in_format", 6)}


def test_spanish_date_keeps_the_month(spark):
    r = M.extract_matches(frame(spark), ["dates_spanish_format"]).first()
    assert r.groups == ["enero"]


def test_cheap_tests_never_lose_a_hit(spark):
    from tertulia.rules.patterns import RULES

    df = frame(spark)
    for rule in RULES:
        plain = df.select(sum((F.regexp_count("text", F.lit(j)) for j in rule.java()), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]
        assert M.extract_matches(df, [rule.key]).count() == plain, rule.key


def test_bad_user_pattern_is_skipped(spark):
    names = {r.name for r in M.custom_matches(frame(spark), ["(sin cierre", r"(\d+) usd|(\d+) mlc"]).collect()}
    assert names == {"custom_pattern_1"}


def test_first_non_empty_group_is_the_value(spark):
    got = {r.value for r in M.named_matches(frame(spark), {"p": r"(\d+) usd|(\d+) mlc"}).collect()}
    assert got == {"200", "180"}


def test_enriched_text(spark):
    got = {r.id: r.e for r in M.enrich_text(frame(spark), name="e").collect()}
    assert got[5].endswith("[Patrones: 1 enlaces, 1 hashtags, 1 menciones]")


def test_key_summary_line(spark):
    df = spark.createDataFrame([(1, "k", 0, "a"), (2, "k", 0, "b"), (3, "k", 0, "a"), (4, "k", 0, "c"), (5, "k", 0, "d")], "id long, key string, ord int, value string")
    r = M.key_summary(df).first()
    assert (r.n, r.examples) == (5, "a, b, a y 2 más")
    assert M.key_summary(df, distinct=True).first().examples == "a, b, c y 2 más"


def test_context_window(spark):
    df = spark.createDataFrame([("Uno. Vamos el lunes a la playa; luego nada", "lunes"), ("x" * 120, "lunes")], "t string, e string")
    a, b = [r[0] for r in df.select(S.temporal_context("t", "e")).collect()]
    assert a == "Vamos el lunes a la playa"
    assert b == "x" * 100 + "..."


def test_prices(spark):
    df = spark.createDataFrame([("10-20",), ("75,50",), ("12",), ("x-y",)], "a string")
    assert [r[0] for r in df.select(T.parse_price("a")).collect()] == [15.0, 75.5, 12.0, None]


def test_trend_of_one_price_is_stable(spark):
    df = spark.sql("select 1L chat_id, 1L id, 0 ord, timestamp'2024-01-01' ts, 'usd' currency, 5.0D price")
    assert T.price_trend(df).first().trend == "estable"
    assert T.price_statistics(df).first().volatility == 0.0


def test_user_patterns_see_their_surroundings(spark):
    df = spark.createDataFrame([(1, "precio 25 usd, precio 30 eur"), (2, "sin precio")], "id long, text string")
    got = M.named_matches(df, {"ahead": r"precio (\d+)(?= usd)", "behind": r"(?<=precio )\d+", "either": r"(usd)|(eur)"})
    assert sorted((r.id, r.name, r.ord, r.value) for r in got.collect()) == [
        (1, "ahead", 0, "25"), (1, "behind", 0, "25"), (1, "behind", 1, "30"), (1, "either", 0, "usd"), (1, "either", 1, "eur")]


def test_pretests_lose_no_hit(spark):
    """Every temporal rule over every kind of white space: the rule alone and behind its cheap test find the same."""
    blanks = [" ", "\t", "\n", "\r\n", "\u00a0", "\u2003", "\u3000", "\x0b"]
    phrases = ["la semana entrante", "la que viene", "dentro de un rato", "al día siguiente", "hace poco", "esta tarde", "este mes", "el año que viene", "semana pasada",
               "fin de semana que viene", "en enero", "hace 3 días", "pasado mañana"]
    rows = [(i, p.replace(" ", b)) for i, (p, b) in enumerate((p, b) for p in phrases for b in blanks)]
    df = M.prepared(spark.createDataFrame(rows, "id long, text string"))
    for key, rule in BY_KEY.items():
        if rule.category == "temporal":
            alone = dataclasses.replace(rule, needs=(), digit=False)
            both = df.select(F.size(F.expr(M._hits("text", rule))).alias("a"), F.size(F.expr(M._hits("text", alone))).alias("b"))
            assert both.filter("a <> b").count() == 0, key
