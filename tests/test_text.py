from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in values.items()))
    assert names
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("Résilier le contrat, vite!", ["resilier", "le", "contrat", "vite"]), ("camelCase HTTPServer v2Api", ["camel", "case", "httpserver", "v2", "api"]), ("this users class", ["thi", "user", "class"]), ("", [])])
def test_search_tokens(spark, text, want):
    assert one(spark, T.search_tokens(F.col("t")), t=text) == want


@pytest.mark.parametrize("name", ["ParcelSender", "parcel_sender", "parcel-senders"])
def test_one_key_for_a_name(spark, name):
    assert one(spark, T.normalize_name(F.col("t")), t=name) == "parcelsender"


@pytest.mark.parametrize(("name", "want"), [("bus", "bus"), ("docs", "docs"), ("items", "item")])
def test_short_plurals_stay(spark, name, want):
    assert one(spark, T.normalize_name(F.col("t")), t=name) == want


@pytest.mark.parametrize(("word", "want"), [("companies", "company"), ("statuses", "status"), ("boxes", "box"), ("branches", "branch"), ("analysis", "analysis"), ("users", "user"), ("gas", "gas")])
def test_singular(spark, word, want):
    assert one(spark, T.singular(F.col("t")), t=word) == want


def test_fold_and_slug(spark):
    assert one(spark, T.fold_latin(F.col("t")), t="Français Œuvre Straße é") == "francais oeuvre strasse e"
    assert one(spark, T.slugify(F.col("t")), t="  Crème & brûlée!! ") == "creme-brulee"
    assert one(spark, T.slugify(F.col("t")), t="!!!") == "unnamed"


def test_one_line(spark):
    assert one(spark, T.one_line(F.col("t")), t="  Place\nan  order\r\n\t[T1] x ") == "Place an order [T1] x"


def test_code_identifiers(spark):
    assert one(spark, T.code_identifiers(F.col("t")), t="calls `save` then create_invoice, UserAccount and run()") == ["save", "create_invoice", "UserAccount", "run"]


def test_code_leaks(spark):
    got = one(spark, T.code_leaks(F.col("t"), ["ParcelSender"]), t="The ParcelSender and UserAccount call save() via GET, app/models/user.rb and the controller; and/or PATCHes.")
    assert got == ["useraccount", "save", "get", "app/models/user.rb", "controller"]


@pytest.mark.parametrize(("count", "total", "want"), [(1, 1000, 1), (999, 1000, 99), (0, 5, 0), (5, 5, 100), (1, 2, 50), (0, 0, None)])
def test_percent(spark, count, total, want):
    assert one(spark, T.percent(F.col("c"), F.col("t")), c=count, t=total) == want


def test_citation_and_span(spark):
    got = one(spark, T.citation(F.col("t")), t="src/a.py:9-3")
    assert (got["file"], got["start_line"], got["end_line"]) == ("src/a.py", 3, 9)
    assert one(spark, T.citation(F.col("t")), t="a:b.py")["start_line"] is None
    assert one(spark, T.line_span(F.col("a").cast("int"), F.lit(None).cast("int")), a=4)["end_line"] == 4
    assert one(spark, T.line_span(F.lit(None).cast("int"), F.col("a")), a=4) is None


def test_mentions(spark):
    assert one(spark, T.mentions(F.col("t"), F.lit("RefundRequest")), t="files the refund requests today")
    assert not one(spark, T.mentions(F.col("t"), F.lit("RefundRequest")), t="a request of a refund")


def test_routes(spark):
    assert one(spark, T.route_segments(F.col("t")), t="/users/:id/orders.json") == ["users", "*", "orders"]
    assert one(spark, T.route_covers(T.route_segments(F.lit("/users")), T.route_segments(F.col("t"))), t="/users/{id}")
    assert not one(spark, T.route_covers(T.route_segments(F.lit("/orders")), T.route_segments(F.col("t"))), t="/users/{id}")


def test_cut_at_word(spark):
    assert one(spark, T.cut_at_word(F.col("t"), 12), t="one two, three four") == "one two…"
    assert one(spark, T.cut_at_word(F.col("t"), 12), t="short") == "short"
