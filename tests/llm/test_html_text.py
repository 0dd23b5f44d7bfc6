import pytest
from pyspark.sql import functions as F

from assetlake.llm.html_text import Page, extract_text


def text(html):
    return "\n".join(Page(html).result()[0])


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<p>b &amp; c&nbsp;d &#233;&copy;", "a\nb & c d é©"),
        ("<h1>T</h1><p><b>x.<br><p>y</p>", "T\nx.\ny"),
        ("<p>one<br>two</p>", "one two"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "a\nb\nc\nd\ne"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<script>var t='</p><p>no';</script><style>p{}</style>yes", "yes"),
        ("<SCRIPT>no</SCRIPT >yes<script>unclosed <p>x</p>", "yes"),
        ("<!-- <p>no</p> -->yes<!-- unclosed <p>x</p>", "yes"),
        ("<a title=\"x > y\">in</a>line <b>bo</b>ld 1 < 2 & 3 > 2 <", "inline bold 1 < 2 & 3 > 2 <"),
        ("<nav>no</nav><header><h1>no</h1></header><main>yes<aside>no</aside></main>rest", "yes"),
        ("<div>no</div><article><header><h1>T</h1><p>by</p></header><p>x</p></article>", "T\nx"),
        ("<article>x<div class='comments'><article>no</article></div></article><p>no</p>", "x"),
        ("<div class='ad'>no</div><div class='lead'>yes</div><div id=cookie-notice>no</div>", "yes"),
        ("<p hidden>no<p style='display: none'>no<div role=navigation>no</div>yes", "yes"),
        ("<form><p>no</form>x<p>y</form>z", "x\nyz"),
        ("<p>a</b>b</i></p></p>c</div>d", "ab\ncd"),
        ("<title>no</title><textarea><p>no</textarea>x", "x"),
        ("<![CDATA[x < y]]> z", "x < y z"),
        ("<p>&lt;b&gt; &quot;q&quot; &unknown; &amp;amp;</p>", '<b> "q" &unknown; &amp;'),
    ],
)
def test_blocks(html, want):
    assert text(html) == want


def page(i, body):
    share = "<div class=box><p>Follow this site</p></div>"
    return f"<html><body><div><p>Welcome to the site</p></div>{body}{share}</body></html>"


def test_templates_and_edges(spark):
    rows = [(i, f"http://A.example.com/{i}", page(i, f"<p>page {i} says {'more ' * i}</p><p>same line</p>")) for i in range(10)]
    rows += [(20 + i, f"https://u@b.example.com:80/{i}", page(i, f"<p>other {i}</p>")) for i in range(3)]
    art = "<article><p>same line</p><div class=x>Read on</div><p>article {} {}</p></article>"
    rows += [(40 + i, f"//c.example.com/{i}", page(i, art.format(i, "word " * 30))) for i in range(8)]
    rows += [(60, None, None), (61, "nohost", ""), (62, None, page(0, "<p>x</p>"))]
    rows += [(0, "http://A.example.com/0", rows[0][2])] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(7))
    out = {}
    for r in extract_text(df.repartition(4)).collect():
        assert r.n_chars == len(r.text)
        out.setdefault(r.page_id, set()).add((r.url, r.text))
    assert sum(len(v) for v in out.values()) == len(rows) - 2
    assert {t for _, t in out[3]} == {"page 3 says more more more"}
    assert {t for _, t in out[21]} == {"Welcome to the site\nother 1\nFollow this site"}
    assert {t for _, t in out[44]} == {"same line\narticle 4 " + "word " * 29 + "word"}
    assert {t for _, t in out[60]} == {""} and {t for _, t in out[61]} == {""}
    assert extract_text(df.limit(0)).count() == 0


def test_long_and_deep_markup():
    assert len(text("<p>" + "w " * 500_000)) == 999_999
    assert text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert text('<a "' * 20_000)


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in extract_text(df.repartition(3)).collect()}


def test_template_on_a_small_share_of_a_host(spark):
    """Six pages of a section, among 60 others of the host, lose the section's template."""
    section = "<div class=s><p>About this section</p></div>"
    rows = [(i, f"http://d.example.com/{i}", f"{section if i < 6 else ''}<p>story {i}</p>") for i in range(66)]
    rows += [(70 + i, f"http://d.example.com/c{i}", "<p>copied text</p>") for i in range(8)]
    out = extracted(spark, rows)
    assert all(out[i] == f"story {i}" for i in range(66))
    assert all(out[70 + i] == "copied text" for i in range(8))


def test_template_of_over_half_of_the_text(spark):
    long = f"<div class=x><p>{'legal notice ' * 20}</p></div>"
    rows = [(i, f"http://e.example.com/{i}", f"{long}<p>story {i}</p>") for i in range(7)]
    # within an article it is counted on every page, and stays where it is most of the text
    body = lambda i: f"<article>{long}<p>{'own words ' * (60 if i < 2 else 0)}{i}</p></article>"
    rows += [(20 + i, f"http://f.example.com/{i}", body(i)) for i in range(6)]
    out = extracted(spark, rows)
    assert all(out[i] == f"story {i}" for i in range(7))
    assert all(("legal notice" in out[20 + i]) == (i >= 2) for i in range(6))


def test_elements_outside_the_article_count(spark):
    box = "<div class=x><p>Read on</p></div>"
    inside = lambda i: f"<article><p>{'own ' * 20}{i}</p>{box if i < 2 else ''}</article>"
    rows = [(i, f"http://g.example.com/{i}", f"{inside(i)}{box if i >= 2 else ''}") for i in range(6)]
    assert all(t == f"{'own ' * 20}{i}" for i, t in extracted(spark, rows).items())
