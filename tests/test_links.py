"""Link labels at the edges of the rules; the registered queries cover each platform's shapes."""

import pytest

from tertulia.operators import links as L
from tertulia.plans.links import SHOP
from tertulia.rules.links import Platform

CASES = [
    ("https://example.com/docs/informe.PDF", "[📄 Documento: informe.PDF]"),
    ("https://example.com/v.mp4?x=1", "[🎥 Video: v.mp4?x=1]"),
    ("https://raw.githubusercontent.com/u/r/main/a.py", "[💻 Archivo de GitHub de u/r - Archivo: main/a.py]"),
    ("http://localhost:8080/x", "[🌐 Enlace externo]"),
    ("https://www.elpais.com.uy/nota", "[🔗 Enlace a Com]"),
    ("https://instagram.com/direct/inbox/", "[📨 Bandeja directa de Instagram]"),
    ("https://instagram.com/a/b/c/d", "[📷 Inicio de Instagram]"),
    ("https://github.com/a/b/c/d/e", "[💻 Contenido de GitHub]"),
    ("https://twitter.com/hashtag/x?q=y", "[#️⃣ Hashtag de Twitter/X #y]"),
    ("https://www.youtube.com/embed/ab?start=7", "[📺 Video incrustado de YouTube - ID: ab - Tiempo: 7]"),
    ("https://youtubekids.com/watch?v=k1", "[🧒 Video en YouTube Kids de YouTube - ID: k1]"),
    ("https://facebook.com/watch?v=9", "[📺 Watch de Facebook]"),
    ("https://amazon.com/wishlist/AB12?lm=1", "[❤️ Lista de deseos pública de Amazon - ID: AB12]"),
    ("https://mail.google.com/mail/u/0/#inbox", "[📧 Bandeja de entrada]"),
    ("https://t.me/@canal", "[📢 Canal de Telegram - de @canal]"),
    ("https://medium.com/search", "[🔍 Búsqueda de Medium]"),
    ("https://pinterest.com/search/sillas", "[🔍 Búsqueda de Pinterest: sillas]"),
    ("https://stackoverflow.com/tags/spark/info", "[ℹ️ Info de etiqueta - spark]"),
    ("https://imgur.com/memegen/hola/adios", "[😂 Meme Generator: hola/adios]"),
]


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.createDataFrame([(u,) for u, _ in CASES], "url string")
    return {r.url: r.label for r in L.labels(df).collect()}


@pytest.mark.parametrize("url,label", CASES)
def test_label(labelled, url, label):
    assert labelled[url] == label


def test_rewrite_in_place(spark):
    texts = ["sin enlaces", "https://github.com/u", "ve https://github.com/u y https://github.com/u ya", ""]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "chat_id long, id long, text string")
    got = {r.id: r.text for r in L.rewrite(df).collect()}
    profile = "[👤 Perfil de GitHub de u]"
    assert got == {0: "sin enlaces", 1: profile, 2: f"ve {profile} y {profile} ya", 3: ""}


def test_user_platform_comes_after_the_built_in_ones(spark):
    df = spark.createDataFrame([("https://tienda.example.com/p/7",), ("https://tienda.example.com/ana",), ("https://github.com/u",)], "url string")
    got = {r.url: r.label for r in L.labels(df, "url", L.register(SHOP)).collect()}
    assert got["https://tienda.example.com/p/7"] == "[🏬 Tienda - product - ID: 7]"
    assert got["https://tienda.example.com/ana"] == "[👤 Tienda de @ana]"
    assert got["https://github.com/u"] == "[👤 Perfil de GitHub de u]"


def test_types_of_a_platform_are_a_mapping():
    with pytest.raises(TypeError, match="shop"):
        Platform("shop", "Tienda", ("tienda.example.com",), "🏬", "product 🏬 Producto", "product /p/{i}")


def test_routing_works_out_the_host_once(spark):
    from pyspark.sql import functions as F

    from tertulia.functions import urls as U
    from tertulia.operators import links as L
    from tertulia.plans import links as plans

    df = plans.l11(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(url") == 1 and plan.count("^www") == 1
    hosts = spark.createDataFrame([("https://www.github.com/a",), ("https://x.tumblr.com/",), ("https://nowhere.org/",)], "url string")
    got = [r.p for r in hosts.select(L.route(U.host("url")).alias("p")).collect()]
    assert got == ["github", "tumblr", None]


def test_distinct_urls_grow_in_parts_not_in_size(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(L, "URLS_PER_TASK", 500)
    url = F.when(F.col("id") % 2 == 0, F.lit("https://example.com/")).when(F.col("id") > 2, F.concat(F.lit("https://t.me/c"), (F.col("id") % 9000).cast("string")))
    urls = spark.range(20_000).select(url.alias("url"))
    got = L.distinct_urls(urls)
    held = [r.n for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == got.distinct().count() == urls.distinct().count()
    assert max(held) <= 500
