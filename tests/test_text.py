"""Text expressions, against SQL and by hand."""

import hashlib
import html
import html.entities
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidings import fixed_values as fv
from tidings.functions import text as tx
from tidings.functions.entities import decode_entities


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.d for r in df.select("i", fn(F.col("s")).alias("d")).orderBy("i").collect()]


ENTITIES = [
    "&amp;lt;", "&#65;", "&#x1F600;", "&#X41;", "&#0;", "&#128;", "&#129;", "&#xD800;",
    "&#1114112;", "&#99999999999999999999;", "&#000065;", "&#xFDD0;", "&#11;", "&#13;", "&#xFFFE;",
    "&#x10FFFF;", "&notit;", "&copyfoo", "&;", "&", "&&amp;", "&#;", "&#x;", "a&b", "&ampx;",
    "&Amp;", "&nosuch;", "x&#65y", "&NotEqualTilde;z", "&gt", "&frac12abc;", "&" + "a" * 40 + ";",
    "plain", "", "&nbsp;&mdash;", "&amp;#65;",
]


def test_entities_equal_the_html_standard(spark):
    rng = random.Random(5)
    names = list(html.entities.html5)
    parts = ["&", "&#", "&#x", ";", " ", "\n", "<", "#", "é", "7", "1f"]
    mixed = ["".join(rng.choice(parts + [rng.choice(names), "&" + rng.choice(names)])
                     for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    every = ["&" + name + "x" for name in names]
    values = ENTITIES + mixed + every
    assert apply(spark, values, decode_entities) == [html.unescape(v) for v in values]


PIECES = ["<p>", "</p>", "<br/>", "<br >", "<li>", "<LI class=x>", "</li>", "</H2>", "<!--x\n-->",
          "<a", ">", "&amp;", "&nbsp;", "&hearts;", "\n", "\r", " ", "\x1c", " ", "　",
          "\t", "word", "😀", "wörd ", "&#10;", "<b>"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=60).map("".join), min_size=1,
                max_size=150))
def test_html_to_text_equals_the_sql(spark, values):
    """The same rules in DuckDB, as the catalog states them."""
    import duckdb

    from tidings.plans.oracle import plain
    for other in ("&#10;", "&hearts;", "&nbsp;"):    # the SQL knows the tables' entities only
        values = [v.replace(other, "") for v in values]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, html VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = dict(con.execute(f"SELECT i, {plain('html')} FROM t").fetchall())
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    for row in tx.with_plain_text(df, "s", "d", 10**6).collect():
        assert row.d == want[row.i]


@pytest.mark.parametrize(("markup", "text"), [
    (None, ""), ("", ""), ("<ul><li>a</li><li>b</li></ul>", "- a\n\n- b"),
    ("<p>a&nbsp;b</p><p>&amp;lt;</p>", "a\xa0b\n&lt;"), ("a<!-- x\n -->b<br/>c", "ab\nc"),
])
def test_html_to_text_by_hand(spark, markup, text):
    df = spark.createDataFrame([(markup,)], "s string")
    assert tx.with_plain_text(df, "s", "d").first().d == text


@pytest.mark.parametrize(("value", "cut"), [
    ("b" * 100, "b" * 100), ("b" * 101, "b" * 100 + fv.ELLIPSIS), ("a" * 99 + " b", "a" * 99 + fv.ELLIPSIS),
    ("word " * 40, ("word " * 20).rstrip() + fv.ELLIPSIS),
    ("line\n" * 30, ("line\n" * 20).rstrip() + fv.ELLIPSIS),
    ("a" * 40 + "\n" + "c" * 100, "a" * 40 + fv.ELLIPSIS),
    ("a" * 39 + "\n" + "c" * 100, "a" * 39 + "\n" + "c" * 60 + fv.ELLIPSIS),
    (" " + "b" * 200, " " + "b" * 99 + fv.ELLIPSIS), ("😀" * 120, "😀" * 100 + fv.ELLIPSIS),
])
def test_truncation_edges(spark, value, cut):
    assert apply(spark, [value], lambda c: tx.truncate_text(c, 100)) == [cut]


def test_ids(spark):
    urls = ["https://example.com/a", "https://example.com/é?x=1#ü", ""]
    want = [hashlib.sha1(u.encode()).hexdigest()[:16] for u in urls]
    assert apply(spark, urls, tx.url_id) == want


def test_strip_knows_unicode_whitespace(spark):
    values = [w + "x" + w for w in fv.WHITESPACE] + ["​x", "  a b \n", None]
    assert apply(spark, values, tx.strip) == [v and v.strip() for v in values]


def test_trailer_lines(spark):
    body = ("Fix\n  co-authored-BY: a\nReviewed-by : kept\n Signed-off-by:b\n"
            "not Signed-off-by: kept\n\nReviewed-by: c")
    assert apply(spark, [body, "Co-authored-by: only\n"], tx.drop_trailer_lines) == [
        "Fix\nReviewed-by : kept\nnot Signed-off-by: kept", ""]


def test_clean_title(spark):
    assert apply(spark, [" <!-- a\n --> <b>A &amp;amp; B</b>\n", "<i></i>&nbsp;"],
                 tx.clean_title) == ["A &amp; B", ""]


def test_plain_text_does_not_leave_the_jvm(spark, plan_of):
    df = spark.createDataFrame([("<p>a</p>",)], "s string")
    plan = plan_of(tx.with_plain_text(df, "s", "d"))
    assert "Python" not in plan and "Exchange" not in plan
