from tidewire.llm.html_text import Page, extract, extract_text, vote

FULL = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";x(0);</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy this now please.</div>
<div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; line</h1><p><b>First   &eacute; para&nbsp;x.<br><p>Second <i>para</i>graph &lt;b&gt;.</p><ul><li>one<li>two</ul>
<form>Name <input></form><div class="comments"><p>Nice post!</p></div><aside>See also</aside></article><footer>&copy; me</footer></body></html>"""
WANT = "Head & line\nFirst é para x.\nSecond paragraph <b>.\none\ntwo"


def test_article_only():
    assert extract(FULL) == WANT
    assert extract(FULL.replace("</body></html>", "").replace("</article>", "")) == WANT
    assert Page(FULL).path(Page(FULL).best()[0]) == "html>body.has-sidebar>article"


def test_odd_input():
    assert extract(None) == extract("") == extract("<nav>x</nav>") == ""
    assert extract("plain 1 < 2 text") == "plain 1 < 2 text"
    assert extract("<div>" * 20000 + "deep") == "deep"
    assert extract("<p>a<p>b</p></p>c<script>never closed") == "a\nb\nc"
    long = "word " * 40000
    assert extract(f"<article><p>{long}</p></article>") == long.strip()
    assert extract("<div hidden>no</div><div>yes</div>") == "yes"


def test_host_consensus_overrules_one_page(spark):
    body = "<div class='post p{}'><p>{}</p></div><div class='widget'><p>{}</p></div>"
    rows = [(i, f"http://H.com/{i}", body.format(i, f"Story {i} goes on and on.", "w"), "t") for i in range(5)]
    rows += [(9, "https://h.com/x", body.format(9, "Short.", "Much longer widget text than the story of this page has."), None)]
    rows += [(10, "http://other.org", FULL, None), (11, None, FULL, None), (12, "http://h.com/y", None, None), (9, "https://h.com/x", rows[-1][2], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert {r["host"]: r["path"] for r in vote(df).collect()} == {"h.com": "div.p#.post", "other.org": "html>body.has-sidebar>article"}
    got = extract_text(df).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and by[9] == "Short." and by[3] == "Story 3 goes on and on." and by[10] == by[11] == WANT and by[12] == ""
    assert extract_text(df.limit(0)).count() == 0
