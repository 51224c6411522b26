from html.parser import HTMLParser

import pytest

from cardwright.llm.html_text import html_text, page_text

CASES = [
    (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("a < b <3", "a < b <3"),
    ("<p>one<p>two", "one\n\ntwo"), ("<div>a</div><div>b</div>c", "a\nb\nc"), ("x<br>y<br><br>z", "x\ny\n\nz"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"), ("<ol start=9><li>a<li>b<li value=3>c</ol>", "9. a\n10. b\n3. c"),
    ("<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>x<td>22</table>", "name       n\nlong name  1\nx          22"),
    ("<table><td>a<td>b</table>after", "a  b\n\nafter"), ("<pre>\n a\n   b</pre>", " a\n   b"),
    ("<script>var a='<p>';</script><style>p{}</style>x<!-- y -->", "x"), ("<p hidden>a<p>b<p style='display: none'>c", "b"),
    ("<div style=visibility:hidden>a<b style=visibility:visible>b</b></div>", "b"), ("<details><summary>s</summary>t</details><details open><summary>u</summary>v</details>", "s\nu\nv"),
    ("<b>a</b> <i>b</i>c&nbsp;d", "a bc d"), ("<p>unclosed <b title=\"x>bold", "unclosed bold"), ("<textarea>a\n b</textarea>", "a\n b"),
    ("<table><tr><td><p>in<p>cell<td>x</table>", "in    x\n\ncell"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_rendering(html, text):
    assert page_text(html) == text


def test_deep_and_wide_pages():
    assert page_text("<div>" * 30_000 + "x") == "x"
    assert len(page_text("<table>" + f"<tr><td>{'y' * 5000}<td>b" + "<tr><td>a<td>b" * 3000 + "</table>")) < 100_000


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def test_all_words_of_the_sample_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text(pages).collect():
        plain = Plain()
        plain.feed(r["html"])
        got = "".join(x.removeprefix("- ") for x in r["text"].split("\n"))
        assert "".join(got.split()).replace("-", "") == "".join("".join(plain.words).split()).replace("-", "")


def test_columns_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "<p>a", "old")], "page_id long, html string, text string")
    assert html_text(pages).select("page_id", "text").collect() == [(1, "a")]
    assert html_text(pages.limit(0)).count() == 0
