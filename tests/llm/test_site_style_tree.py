import html
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from barfold.llm import site_style_tree as st

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><a href="/">Site</a></header><nav><ul><li>One<li>Two</ul></nav>
<div class="left-sidebar">Side</div><div id="cookie-banner">We use cookies</div>
<div class="content"><h1>Head&amp;line</h1><p>First <b>bold<br>text &lt;x&gt; &#8212; y<p>Second
 line&nbsp;here &eacute;&notaref; &amp</div><form><label>Name</label><input></form>
<section class="post-comments"><p>I like it</p></section><div class="ad">Buy</div><div hidden>no</div><footer>&copy; me</footer>"""


def test_one_page_by_its_markup():
    assert st.text_of(PAGE, frozenset()) == "Head&line\nFirst bold text <x> — y\nSecond line here é¬aref; &"
    article = "<body><div>menu</div><article><header><h1>A</h1></header>x<aside>no</aside><div>y</div></article>z"
    assert st.text_of(article, frozenset()) == "A\nx\ny"
    for broken in ("", None, "plain  text", "<", "a < b", "<p", "<p title='", "</div></p>x", "<!-- open", "<script>no", "<b><i>"):
        assert isinstance(st.text_of(broken, frozenset()), str)
    assert st.text_of("a < b <!-- c --> d", frozenset()) == "a < b d"
    assert st.text_of("<div>" * 5000 + "deep", frozenset()) == "deep"


def test_repeated_branches_of_a_site_go(spark):
    rows = [(i, f"http://a.org/{i}", f"<div class=x><div class=m>Our offers</div><div class=t>Story {i} is long</div></div>")
            for i in range(12)]
    rows += [(i, f"http://b.org/{i}", "<div class=m>Our offers</div>") for i in range(20, 22)]
    got = {r.page_id: r.text for r in st.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 is long" and got[20] == "Our offers"


def _texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in st.main_text(df).collect()}


def test_tree_decides_inside_and_outside_articles(spark):
    """Repeated parts of articles go, by element and by paragraph; own text beside a teaser article stays."""
    def page(i):
        return (f"<article><h1>Head {i}</h1><p>Story {i} is long</p><p>Write to us</p><div class=end>Read on daily</div></article>"
                "<div class=foot>All rights</div>")

    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(12)]
    rows += [(i, f"http://b.org/{i}", f"<article>Buy our book</article><div class=text>Tale {i} is long</div><div>Home</div>")
             for i in range(20, 32)]
    rows += [(40, "http://c.org/1", page(40)), (41, "http://c.org/2", "<article>Buy our book</article><div class=text>Tale</div>")]
    got = _texts(spark, rows)
    assert [got[i] for i in range(12)] == [f"Head {i}\nStory {i} is long" for i in range(12)]
    assert [got[i] for i in range(20, 32)] == [f"Tale {i} is long" for i in range(20, 32)]
    assert (got[40], got[41]) == ("Head 40\nStory 40 is long\nWrite to us\nRead on daily", "Buy our book")


def test_pages_of_one_article_keep_it(spark):
    rows = [(i, f"http://a.org/{i}", f"<nav>{i}</nav><article><p>One story</p></article>") for i in range(12)]
    rows += [(20, "http://a.org/x", "<article><p>Other story</p></article>")]
    got = _texts(spark, rows)
    assert {got[i] for i in range(12)} == {"One story"} and got[20] == "Other story"


def test_wrappers_are_no_junk(spark):
    story = "<article><h1>Head</h1><p>Story</p></article>"
    for around in ("<form id=aspnetForm>", "<div class='content-sidebar-wrap'>", "<div class=layout-menu-left>",
                   "<div id=social-history>", "<div class=sidebar>", "<div style='display: none'>", "<div role=form>"):
        wrapped = f"<body><nav>a menu</nav>{around}<aside>Side</aside>{story}<div class=sidebar>More</div></body>"
        assert st.text_of(wrapped, frozenset()) == "Head\nStory"
        assert st.text_of(f"<body>{around}<p>{'A long story. ' * 9}</p></div></form><p>Foot", frozenset()).startswith(
            "A long" if around not in ("<div class=sidebar>",) else "Foot")
    beside = f"{story}<div class=related><article>Teaser</article></div><aside><article>Other</article></aside>"
    assert st.text_of(beside, frozenset()) == "Head\nStory"
    rows = [(i, f"http://a.org/{i}", f"<p>{'Text %d. ' % i * 9}</p><div class=social-history>Event {i}</div><div class=top-banner>Hi</div>")
            for i in range(12)]
    got = _texts(spark, rows)
    assert all(got[i].endswith(f"Text {i}.\nEvent {i}") for i in range(12))


def test_copies_are_no_repetition(spark):
    rows = [(i, f"http://a.org/{i}", "<div class=t>One story</div>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in st.main_text(df).collect()} == {"One story"}


def test_rows_of_every_kind(spark):
    rows = [(1, None, PAGE), (2, "no address", None), (3, "http://x.org", ""), (3, "http://x.org", ""), (None, "http://x.org", "<p>a"),
            (4, "http://x.org/long", "<p>" + "w " * 300000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2))
    got = sorted((r.page_id or 0, len(r.text)) for r in st.main_text(df).collect())
    assert got == [(0, 1), (1, len(st.text_of(PAGE, frozenset()))), (2, 0), (3, 0), (3, 0), (4, 599999)]
    assert st.main_text(df.limit(0)).count() == 0


def test_given_pages_by_a_plain_rule(spark):
    """The given pages hold their text in ``article``: h1 and p elements, some of them left open."""
    path = "/root/testdata/sf0.001/pages.parquet"
    got = {r.page_id: r.text for r in st.main_text(spark.read.parquet(path)).collect()}
    for row in pq.read_table(path).to_pylist():
        inner = re.search(r"<article>(.*?)(</article>|$)", row["html"], re.DOTALL)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", " ", p)) for p in re.split(r"</?(?:h1|p)>", inner)]
        want = "\n".join(t for p in parts if (t := " ".join(p.split())))
        assert got[row["page_id"]] == want
