"""Pages to corpus rows, and labels by prefix."""

import duckdb
import pytest
from pyspark.sql import functions as F

from panelkit import functions as fn
from panelkit.operators import audits, evidence, text
from panelkit.plans import queries


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<html><script>x</script><p>报告正文</p></html>", "报告正文"),
        ("<div class='content'><p>short</p></div><div class='Article-body'><p>the longer one</p></div><p>outside, longer than both of them</p>", "the longer one"),
        ("<div class='detail'><p>aa</p></div><div class='detail'><p>bb</p></div>", "aa"),
        ("<p>版权所有 x</p><p>kept</p><ul><li>首页</li></ul>", "kept"),
        ("<div class='content'>loose text that no block holds, most of it<p>x</p></div>", "loose text that no block holds, most of it\nx"),
        ("<p>ＡＢＣ  \n\n  创新\t能力&nbsp;x</p>", "ABC\n创新 能力 x"),
        ("<ul><li><p>twice</p></li></ul>", "twice\ntwice"),
        ("<p>one<p>two", "one two\ntwo"),
        ("<nav><p>menu</p></nav><form><p>field</p></form><footer>end</footer>", ""),
        ("<main class=x>in<p>a</p><p>b</p></main>", "a\nb"),
        ("plain & text", "plain & text"),
        ("", ""),
        (None, None),
    ],
)
def test_page_text(markup, want):
    assert text.page_text(markup) == want


def test_a_container_by_tag():
    assert text.page_text("<p>out</p><article><h2>t</h2><p>in</p></article>", tags=frozenset(["article"])) == "t\nin"


def test_decoding():
    assert text.decoded_page("政府工作报告".encode("gb18030")) == ("政府工作报告", "gb18030", "ok")
    assert text.decoded_page("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == ("é", "iso-8859-1", "ok")
    assert text.decoded_page('<meta charset="gb2312">政'.encode("gb2312")) == ('<meta charset="gb2312">政', "gb2312", "ok")
    assert text.decoded_page(b"a\xff\xff\xff", "text/html; charset=no-such")[1:] == ("utf-8", "warning")


def test_page_corpus(spark):
    page = "<div class='content'><p>支持人才引进。</p><p>推进技术创新和制造业升级。</p><p>人才与创新协同。</p></div>".encode("gb18030")
    rows = [(1, page, "text/html"), (2, b"<p>\xff\xff</p>", None), (3, None, None)]
    out = text.page_corpus(spark.createDataFrame(rows, "id int, payload binary, kind string"), "payload", ["创新", "制造业"], ["人才"], "kind", short_full=10, short_kept=5)
    assert out.columns[:2] == ["id", "kind"] and "payload" not in out.columns
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["kept_text"] == "推进技术创新和制造业升级。\n\n人才与创新协同。"
    assert (got[1]["core_hits"], got[1]["context_hits"], got[1]["hits"], got[1]["kept_paragraphs"]) == (3, 2, 5, 2)
    assert (got[1]["encoding"], got[1]["decode_status"], got[1]["quality_flags"]) == ("gb18030", "ok", "ok")
    assert got[1]["kept_share"] == pytest.approx(got[1]["kept_chars"] / got[1]["full_chars"])
    assert got[2]["quality_flags"] == "short_text;empty_kept;decode_warning" and got[3]["quality_flags"] == "empty_text;empty_kept" and got[3]["kept_share"] == 0


def test_longest_prefix_goes_by_class_first(spark):
    known = [("内蒙古", "内蒙古自治区", 1), ("吉林", "吉林省", 1), ("吉林市", "wrong", 2), ("长春", "吉林省", 2), ("长春市", "吉林省", 2), ("吉", "吉林省", 3), ("内", "short", 3), ("", "nothing", 1), ("长", "b", 3), ("长", "a", 3)]
    prefixes = spark.createDataFrame(known, "prefix string, label string, class int")
    rows = [("“内蒙古 呼和浩特", "内蒙古自治区"), ("吉林市昌邑区", "吉林省"), ("长春市x", "吉林省"), ("内江", "short"), ("长沙", "a"), ("x", None), (None, None), ("", None), ("x", None)]
    df = spark.createDataFrame(rows, "address string, want string")
    got = evidence.longest_prefix(df, "address", prefixes).collect()
    assert len(got) == len(rows) and all(r["label"] == r["want"] for r in got)
    assert evidence.longest_prefix(df, "address", prefixes.limit(0)).where(F.col("label").isNotNull()).count() == 0


def test_paragraphs_keep_digits_at_their_ends(spark):
    df = spark.createDataFrame([(1, "0 thing 50\n1 thing 1\n thing 22 \n3"), (2, "0 thing\n\n 10 thing 1 \n\nrest")], "id int, t string")
    got = {r["id"]: r for r in text.keyword_paragraphs(df, "t", ["thing"], ["rest"]).collect()}
    assert got[1]["kept_text"] == "0 thing 50\n\n1 thing 1\n\nthing 22" and got[1]["kept_paragraphs"] == 3
    assert got[2]["kept_text"] == "0 thing\n\n10 thing 1"


def test_names_and_reasons_keep_digits_at_their_ends(spark):
    df = spark.createDataFrame([("0 A 0→ B 1 ", "0 orders; 1 return1")], "names string, reason string")
    assert df.select(fn.split_names(F.col("names"))).first()[0] == ["0 A 0", "B 1"]
    assert sorted(r["cause"] for r in audits.failures(df, [], [], "reason").collect()) == ["0 orders", "1 return1"]


def test_doubles_are_rounded_as_in_sql(spark):
    values = [641 / 640, 2.5, -0.0000015, 1.0, 0.1 + 0.2, 123456.785, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(queries.r("v")).collect()]
    assert got == [duckdb.execute("select round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
