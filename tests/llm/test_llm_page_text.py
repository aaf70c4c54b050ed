import html
import os
import re

import pytest

from plainspeak.llm import page_text

FOLDER = "/root/testdata/sf0.01"


def texts(page):
    return [t for t, _ in page_text.analyse(page)[2]]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain < text & more", ["plain < text & more"]),
        ("<p>one<p>two <b>bold</b><br>x &amp; y &copy; &#x41;", ["one", "two bold x & y © A"]),
        ("<nav>n</nav><header>h</header><p>t<footer>f</footer><aside>a</aside><form>q</form>", ["t"]),
        ("<div class='ad'>a</div><div id='cookie-notice'>c</div><div class=comments>r</div><div class=lead>t</div>", ["t"]),
        ("<script>if(a<b){'<p>'}</script><style>p{}</style><p>t</p><!-- <p>c -->", ["t"]),
        ("<p>before</p><article><h1>T</h1><p>a</p><div class=share>s</div></article><p>after</p>", ["T", "a"]),
        ("<main><p>a</p></main><p>b</p>", ["a"]),
        ("<article><header><h1>T</h1><p>by x</p></header><p>a</p></article>", ["T", "a"]),
        ("<div class='has-sidebar'><article><p>a</article></div>", ["a"]),
        ("<article class=comment>c</article><article><p>a</p></article>", ["a"]),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
        ("<p title='a > b'>t</p><p title='x>u", ["t", "u"]),
        ("<p>a\n\t b c</p>", ["a b c"]),
        ("<p>half an entity &am", ["half an entity &am"]),
        ("<p hidden>h</p><p style='display: none'>h</p><p aria-hidden=true>h</p><p>t", ["t"]),
        ("<script>never closed <p>x", []),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_deep_nesting_is_no_problem():
    assert texts("<div>" * 20_000 + "x") == ["x"]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, row long, host string, seen string")


def test_site_templates(spark):
    box = "<div class=box><p>Follow our site every day</p></div>"
    rows = []
    for i in range(20):
        rows.append((i, f"http://a.com/{i}", f"<body><div><p>story {i}</p></div>{box}", "", 0, "", ""))
        rows.append((100 + i, f"http://b.com/{i}", f"<body><article><p>story {i}</p><p>All rights with the author</p>{box}</article>", "", 0, "", ""))
        rows.append((200 + i, f"http://c.com/{i}", "<body><div><p>one page, fetched often</p></div>", "", 0, "", ""))
    rows.append((300, "http://d.com/", f"<body><div><p>story</p></div>{box}", "", 0, "", ""))
    found = {r["page_id"]: r["text"] for r in page_text.extract(pages_of(spark, rows)).collect()}
    for i in range(20):
        assert found[i] == f"story {i}"  # recurs on its host
        assert found[100 + i] == f"story {i}\nAll rights with the author"  # a shared sentence of articles stays
        assert found[200 + i] == "one page, fetched often"  # copies of one page are one page
    assert found[300] == "story\nFollow our site every day"


def test_odd_rows(spark):
    rows = [
        (1, None, None, "", 0, "", ""),
        (1, "not a url", "", "", 0, "", ""),
        (None, "http://[broken", "<p>t", "", 0, "", ""),
        (2, "http://x.org", "<p>" + "wörd " * 50_000, "", 0, "", ""),
    ]
    found = page_text.extract(pages_of(spark, rows)).collect()
    assert sorted((str(r["page_id"]), len(r["text"]), r["n_chars"]) for r in found) == [
        ("1", 0, 0), ("1", 0, 0), ("2", 249_999, 249_999), ("None", 1, 1),
    ]
    assert page_text.extract(pages_of(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_given_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in page_text.extract(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", page["html"], re.S)[1]
        parts = [re.sub(r"<br>", " ", re.sub(r"</?b>", "", x)) for x in re.split(r"</?(?:p|h1)>", article)]
        lines = [" ".join(html.unescape(x).split()) for x in parts]
        assert found[page["page_id"]] == "\n".join(x for x in lines if x)
