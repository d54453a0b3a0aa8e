"""HTML extraction: parsing, regions, tree matching against plain recursion, and wrappers of a host."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from leadloom.llm import html_extraction as h

CASES = {
    "regions": ("<body><header><h1>Site</h1></header><nav>menu</nav><article><header><h1>Title</h1></header><p>one<p>two  &amp;\n three</p><aside>side</aside>"
                "<form>mail <input></form></article><div class='comments'><article>reader</article></div><footer>foot</footer>", "Title\none\ntwo & three"),
    "unclosed": ("<article><h1>A</h1><p><b>x<br><p>y<ul><li>1<li>2</ul>z", "A\nx\ny\n1\n2\nz"),
    "raw": ("<p>a</p><script>if (x < 'y') '</p><p>no'</script><style>p{}</style><title>t</title><p>b<!-- <p>no --></p>", "a\nb"),
    "raw without end": ("<p>a</p><script>var x = 1; <p>b</p>", "a"),
    "comment without end": ("<p>a</p><!-- <p>b</p>", "a"),
    "quotes": ("<p title='a > b' class=\"c\">x</p><a href=\"y>z</a><p>w</p>", "x\nz\nw"),
    "signs": ("<p>1 < 2 &lt; 3 &eacute;&#233;&#xe9; &am &nbsp; &</p>", "1 < 2 < 3 ééé &am &"),
    "marks": ("<div class='page has-sidebar'><div id=siteHeader>head</div><div class='left side-bar'>kept</div><div class=cookieNotice>no</div><p>text"
              "<span class=ad>buy</span> more</p></div>", "kept\ntext more"),
    "mark around article": ("<div class='sidebar widget'><main><p>m</p><div role=navigation>n</div></main></div><p>out</p>", "m"),
    "only marked": ("<div class=banner>all there is</div>", "all there is"),
    "hidden": ("<div hidden>a</div><div style='display: none'>b</div><div aria-hidden=true>c</div><i hidden>d</i>e", "e"),
    "inline ad and a block": ("<p>a <span class=ad>b <div>c</div></span> d</p>", "a\nd"),
    "table": ("<table><tr><td>a<td>b<tr><th>c</table>", "a\nb\nc"),
    "empty": ("", ""), "text": (" just\ttext ", "just text"), "markup": ("<html><body></body></html>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    assert h.main_text(CASES[name][0]) == CASES[name][1]


def test_long_and_deep_pages():
    deep = "<div>" * 30_000 + "in" + "</div>" * 30_000
    long = "<article>" + "".join(f"<p>{k}</p><h2>{k}</h2>" for k in range(20_000)) + "</article>"
    for page in (deep, long, "<a " * 50_000, "<p title='" * 20_000, "</div>" * 50_000 + "<" * 50_000):
        h.main_text(page)
    assert h.main_text(deep) == "in" and len(h.main_text(long).split("\n")) == 40_000
    tree = h.Tree.of(h.Page(long))[0]
    assert h.main_text(long, tree) == ""  # its own wrapper: every text stands in its place
    assert h.main_text(deep, h.Tree.of(h.Page(deep))[0]) == ""


def plain_weight(a, b, x, y):
    """The best matching of two small trees, by trying every choice of child pairs in order."""
    if x.labels[a] != y.labels[b]:
        return 0
    best, mine, theirs = 0, x.children[a], y.children[b]
    for n in range(min(len(mine), len(theirs)) + 1):
        for left in itertools.combinations(mine, n):
            for right in itertools.combinations(theirs, n):
                got = [plain_weight(p, q, x, y) for p, q in zip(left, right)]
                best = max(best, sum(got)) if all(got) else best
    return 1 + (not x.texts[a].isdisjoint(y.texts[b])) + best


def test_matching_against_plain_recursion():
    random.seed(4)

    def tree(n):
        # In page order: a parent stands before its children.
        return h.Tree([0, *(random.randrange(3) for _ in range(n - 1))], [-1, *(random.randrange(max(0, k - 3), k) for k in range(1, n))],
                      [[random.randrange(3)] for _ in range(n)])

    for _ in range(60):
        x, y = tree(random.randrange(1, 9)), tree(random.randrange(1, 9))
        pairs = x.matched(y)
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
        assert all(x.labels[a] == y.labels[b] for a, b in pairs)
        assert all((x.parents[a], y.parents[b]) in pairs for a, b in pairs if (a, b) != (0, 0))
        assert sum(1 + (not x.texts[a].isdisjoint(y.texts[b])) for a, b in pairs) == plain_weight(0, 0, x, y)


def soup(k, note="Read all our offers"):
    """A page without any telling names: only its host's other pages show what is template."""
    body = "".join(f"<div class=x>line {k} {i}</div>" for i in range(k % 4 + 1))
    return f"<body><div class=t1><div>{note}</div></div><div class=m><h1>Head {k}</h1>{body}</div><div class=t2><span>Call us</span> today</div>"


def told(k):
    return "\n".join([f"Head {k}", *(f"line {k} {i}" for i in range(k % 4 + 1))])


@pytest.mark.parametrize("parts", [1, 8])
def test_wrapper(spark, parts):
    rows = [(k, f"http://Soup.example/{k}", soup(k)) for k in range(30)] + [(100 + k, "https://few.example", soup(k)) for k in range(3)]
    # A third of a host's rows are copies of one page: they count once and lose nothing.
    rows += [(200 + k, "http://copies.example/a", soup(5)) for k in range(10)] + [(300 + k, "http://copies.example", soup(40 + k)) for k in range(9)]
    rows += [(400 + k, "no host", soup(k)) for k in range(9)] + [(500, "http://soup.example/x", soup(77, "Another line"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    got = {r.page_id: r for r in h.html_extraction(df).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert all(got[k].text == told(k) for k in range(30))
    assert all(got[200 + k].text == told(5) for k in range(10)) and got[300].text == told(40)
    assert got[101].text == "Read all our offers\n" + told(1) + "\nCall us today" and got[404].text.startswith("Read all")
    assert got[500].text == "Another line\n" + told(77)


def test_odd_rows(spark):
    long = "<article>" + "<p>very long page</p>" * 50_000 + "</article>"
    rows = [(1, None, None), (2, "http://a.example", ""), (3, "http://a.example", "<p>x"), (3, "http://a.example", "<p>x"), (None, "http://a.example", "<p>y"),
            (4, "://", "<p>z"), (5, "http://a.example", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("text", F.lit("t"))
    got = h.html_extraction(df).collect()
    assert sorted((str(r.page_id), r.url, r.text[:14], r.n_chars) for r in got) == sorted(
        [("1", None, "", 0), ("2", "http://a.example", "", 0), ("3", "http://a.example", "x", 1), ("3", "http://a.example", "x", 1),
         ("None", "http://a.example", "y", 1), ("4", "://", "z", 1), ("5", "http://a.example", "very long page", 50_000 * 15 - 1)], key=lambda r: (r[0], str(r[1])))
    assert h.html_extraction(df.limit(0)).collect() == []


def test_pairs_do_not_depend_on_the_number_of_children(monkeypatch):
    draw = random.Random(5)

    def page(n):
        rows = []
        for _ in range(n):
            more = "".join(f"<{t}>{draw.choice(['more', 'x', str(draw.randrange(9))])}</{t}>" for t in draw.choices(["h2", "p", "ul"], k=draw.randrange(4)))
            tag = draw.choice(["div", "section"])
            rows.append(f"<{tag}>{more}</{tag}>")
        return h.Tree.of(h.Page("".join(rows)))[0]

    for n in (1, 3, 12, 40):
        for _ in range(8):
            x, y = page(n), page(draw.randrange(n + 5))
            monkeypatch.setattr(h, "TABLE_PAIRS", 1 << 40)
            loops = x.matched(y)
            monkeypatch.setattr(h, "TABLE_PAIRS", -1)
            assert x.matched(y) == loops


def test_many_children_are_matched_by_the_full_table():
    # 300 lines that differ in shape by turns; the second page lacks the first line, so the n-th of a shape is another line.
    line = lambda k: f"<p>line {k}</p>" if k % 2 else f"<div><b>line {k}</b></div>"
    x, y = (h.Tree.of(h.Page("".join(line(k) for k in range(first, 300))))[0] for first in (0, 2))
    shared = {t for a, b in x.matched(y) for t in x.texts[a] & y.texts[b]}
    assert len(shared) == 298
