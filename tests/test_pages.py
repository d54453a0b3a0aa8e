"""Page job on hand-written pages."""

import time

import pytest
from pyspark.sql import functions as F

from leadloom.functions import contacts, html, text, vocab
from leadloom.functions.text import _parts, contains_any
from leadloom.operators import pages
from leadloom.sources import seeding

WORKSHOP = """
<html><head><title>Canal Street Workshop</title></head><body><h2>Repairs</h2>
  <form method="post" action="/repairs/new"><label>What broke?</label>
    <select name="item" aria-label="Kind of item"><option>Lamp</option></select>
    <input type="date" id="dropoff"><textarea placeholder="Describe the damage"></textarea>
    <input name="member_no" id="m1" placeholder="If you have one"><button>Request a quote</button></form>
</body></html>
"""


def parse(spark, *htmls):
    df = spark.createDataFrame([(i, "https://a.example.org/", h) for i, h in enumerate(htmls)],
                               "page_id long, url string, html string")
    return {r.page_id: r for r in pages.parse(df).collect()}


def test_request_form(spark):
    row = parse(spark, WORKSHOP)[0]
    assert (row.form_count, row.lead_form) == (1, True)
    form = row.form_details[0]
    assert form.action == "/repairs/new"
    assert [" ".join(f.split()) for f in form.fields] == [
        "item Kind of item", "dropoff", "Describe the damage", "member_no m1 If you have one"]
    assert form.text == "What broke? Lamp Request a quote"
    assert row.text == "Canal Street Workshop Repairs What broke? Lamp Request a quote"


def test_stray_quotes(spark):
    rows = parse(spark, '<p class="a"">Hello one</p><p>two</p>', "<p title=don't>Alpha</p><p>Beta</p><p title=can't>Gamma</p>",
                 """<a href="/contact"">Contact us</a><a title=don't href='/b'>B</a>""", """<script data-x=don't>var secret="1";</script>ok""")
    assert [rows[i].text for i in range(4)] == ["Hello one two", "Alpha Beta Gamma", "Contact us B", "ok"]
    assert rows[2].hrefs == ["/contact", "/b"]


def test_hidden_without_close_tag(spark):
    rows = parse(spark, '<div>a<p style="display:none">secret<p>next</div>end', '<ul><li aria-hidden="true">x<b>y</b><li>z</ul>w',
                 '<div>k<span aria-hidden="true">lost<b>more</div>seen', 'a<p style="display:none">gone <i>too',
                 '<tr><td aria-hidden="true">no<td>yes</tr>')
    assert [rows[i].text for i in range(5)] == ["a next end", "z w", "k seen", "a", "yes"]


def test_many_hidden_elements(spark):
    def seconds(n):
        page = "<ul>" + '<li><i aria-hidden="true">x</i>word</li>' * n + "</ul>"
        begin = time.perf_counter()
        assert parse(spark, page)[0].text == " ".join(["word"] * n)
        return time.perf_counter() - begin
    seconds(10)
    few = seconds(800)
    assert seconds(8000) < 15 * few


def test_references(spark):
    rows = parse(spark, "&#0000000064; &#x00000041; &#150; &#x80; &#99999999999; &#12AB; &#; &#0;")
    assert rows[0].text == "@ A – € � &#12AB; &#; �"


def test_forms(spark):
    one_field = '<form><input name="q"></form>'
    six = "<form></form>" * 5 + "<form><input name=a><input name=b></form>"
    rows = parse(spark, one_field, six, "<p>Full name, then contact us</p>")
    assert not rows[0].lead_form
    assert rows[1].lead_form and rows[1].form_count == 6 and len(rows[1].form_details) == 5
    assert rows[2].lead_form and rows[2].form_count == 0


@pytest.mark.parametrize("body, reason, length", [
    ("", "empty", 0), (" \n\t ", "empty", 0), ("x" * 499, "small_html", 0), ("x" * 500, "ok", 500),
    ("<!--" + "c" * 500 + "-->" + "t" * 99, "little_text", 99), ("<!--" + "c" * 500 + "-->" + "t" * 100, "ok", 100),
    ("Captcha first, then access denied. " + "x" * 500, "blocked: access denied", 535),
    ("<script>captcha" + "c" * 500 + "</script>" + "t" * 100, "ok", 100),
    ("<iframe>captcha</iframe>" + "t" * 500, "blocked: captcha", 508)])
def test_quality(spark, body, reason, length):
    row = parse(spark, body)[0]
    assert (row.reason, row.text_length, row.usable) == (reason, length, reason == "ok")


def test_visible_text(spark):
    rows = parse(
        spark,
        "a<!-- x --><script>var s = '<!--';</script>b<style>p</style> c&nbsp;d\n e<br>f",
        '<div style="DISPLAY : none">x<div>y</div>z</div>k<span aria-hidden="true">h</span>l<p aria-hidden="TRUE">m</p>',
        "<noscript>n</noscript><svg><text>v</text></svg><iframe>i</iframe><template>t</template>w",
        "1 &lt; 2 &amp;lt; &#64; &#x41; &bogus; &eacute; &#0;",
        '<img style="display:none">seen<script>never closed')
    assert rows[0].text == "a b c d e f"
    assert rows[0].raw_text.startswith("a b c d\n e f")
    assert rows[1].text == "k l m"
    assert (rows[2].text, rows[2].plain_text, rows[2].raw_text) == ("w", "i w", "n v i w")
    assert rows[3].text == "1 < 2 &lt; @ A &bogus; é �"
    assert rows[4].text == "seen"


def test_long_tag_is_no_problem(spark):
    row = parse(spark, "<p " + "a='1' " * 20000 + ">ok</p>" + "<b " + "x" * 200000)[0]
    assert row.text.startswith("ok")


def test_emails(spark):
    rows = parse(
        spark, '<a href="mailto:A@X.org?subject=1">m</a> z@y.org b@y.org',
        '<a href="mailto:a@x.org,b@x.org">m</a>', "i&#64;x.org", '<p title="i&#64;x.org">', "a [at] x [dot]org",
        "a [at] x [dot] org", "x@sub.google.com logo@2x.png a@google.com.de", "ab at c.d dot net")
    assert rows[0].emails == ["a@x.org", "b@y.org", "z@y.org"]
    assert rows[1].mailto_emails == [] and rows[1].emails == ["a@x.org", "b@x.org"]
    assert rows[2].emails == [] and rows[3].emails == ["i@x.org"]
    assert rows[4].emails == ["a@x.org"] and rows[5].emails == []
    assert rows[6].emails == ["a@google.com.de", "logo@2x.png"]
    assert rows[7].emails == ["ab@c.d.net"]


def test_email_scan_equals_plain_search(spark):
    import re
    plain = re.compile(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")
    samples = ["a@b.com5%x@y.org", "a@b.c@d.ef", "a@@b.com", "..a@b.co.uk-z@q.de", "x" * 5000 + "@b.com", "a@b.com,c@d.org"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(F.regexp_extract_all("s", F.lit(contacts.EMAIL), F.lit(0))).collect()]
    assert got == [plain.findall(s) for s in samples]


def test_phones(spark):
    rows = parse(
        spark, "+1 (310) 555-1212 and 3105551213", "1-800-555-1212 888.555.1212", '<a href="tel:911">x</a>',
        '<div style="display:none"><a href="tel:212-555-0000">x</a></div>', "212-555-0001 212-555-0002", "123456789012",
        '<a href="TEL: 310-555-9999 ">x</a> 310-555-9999 (310) 555-9999')
    assert rows[0].phones == ["+1 (310) 555-1212", "3105551213"]
    assert rows[1].phones == [] and rows[2].phones == ["911"] and rows[3].phones == []
    assert rows[4].phones == ["212-555-0001", "212-555-0002"] and rows[5].phones == []
    assert rows[6].phones == ["310-555-9999", "(310) 555-9999"]


def test_head_and_links(spark):
    rows = parse(
        spark, "<title> A &amp; B </title><meta content='first' name=DESCRIPTION><meta name='description' content='x'>",
        '<script type="application/ld+json">[{"@type":["B","A"]},{"@type":"C"}]</script>'
        '<script type="application/ld+json">{"@type":"D"} x</script><!-- <script type="application/ld+json">{"@type":"E"}</script> -->',
        '<a title="x href=no" HREF = "/a?b=1&amp;c=2">T <b>u</b></a><a>bare</a><a href>empty</a><a href=x>open<a href=y>next</a>')
    assert (rows[0].title, rows[0].description) == ("A & B", "first")
    assert rows[1].schema_types == ["A", "B", "C"]
    assert rows[2].hrefs == ["/a?b=1&c=2", "", "", "x", "y"]
    assert rows[2].link_texts == ["T u", "bare", "empty", "open", "next"] and rows[2].link_count == 4


def test_keyword_features_are_substrings(spark):
    row = parse(spark, '<a href="https://fedex.com/">previews</a>')[0]
    assert row.social and row.reviews and not row.booking
    assert parse(spark, "Book <b>now</b>")[0].booking


def test_page_job_splits_blanks(spark):
    df = spark.createDataFrame([(1, "u", " "), (2, "u", "x")], "page_id long, url string, html string")
    good, bad = pages.page_job(df)
    assert [r.page_id for r in good.collect()] == [2] and [r.page_id for r in bad.collect()] == [1]


def test_words_with_a_common_part(spark):
    words = ["book online", "book now", "reserve now", "checkout", "aab", "ab/"]
    texts = words + ["book", " now", "reserve  now", "", "checkou", "kout", "aa", "b/", "say book nowhere", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.a, r.b) for r in df.select(contains_any("t", words).alias("a"), contains_any(F.col("t"), words).alias("b")).collect()]
    wanted = [None if t is None else any(w in t for w in words) for t in texts]
    assert got == [(w, w) for w in wanted]
    # One scan tells that none of several words with a common part is there.
    assert len(_parts(vocab.FEATURES["live_chat"])) == 1


def test_parts_of_the_test_view_grow_with_the_pages(spark, tmp_path):
    spark.range(50_000).selectExpr("id as page_id", "'u' as url", "'h' as html").write.parquet(f"{tmp_path}/pages.parquet")
    assert seeding.pages(spark, str(tmp_path)).rdd.getNumPartitions() == 25


def test_every_reference_is_decoded_and_usual_ones_without_the_map(spark):
    from leadloom.functions import text, vocab

    assert "when e = '&amp;' then" in text._decode_sql("x") and "when e = '&quot;' then" in text._decode_sql("x")
    rows = [(f"a{e}b", f"a{v}b") for e, v in vocab.ENTITIES.items()] + [("&nosuch; &amp &#38;amp;", "&nosuch; &amp &amp;")]
    found = spark.createDataFrame(rows, "x string, wanted string").withColumn("found", text.decode_entities("x"))
    assert found.where("not found <=> wanted").collect() == []
