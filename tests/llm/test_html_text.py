from __future__ import annotations

import pytest

from lectern.llm import html_text as H

LONG = "A sentence, with commas, and enough words in it, to be taken for real text, as it should be."

PAGES = [
    ("article", f"<body><nav><a href=/a>Menu</a></nav><article><h1>Title</h1><p>{LONG}</p><p>Two &amp; three&nbsp;x</p></article>"
                "<footer>&copy; Site</footer></body>", ["Title", LONG, "Two & three x"]),
    ("divs only", f"<body><div class=header>Site</div><div class=content><h2>Head</h2><div>{LONG}</div><div>{LONG}</div></div>"
                  "<div class='sidebar'>Side, bar, links</div><div id=comments><p>I, reader, say, so</p></div></body>",
     ["Head", LONG, LONG]),
    ("unclosed", f"<p><b>{LONG}<br><p>Next one<ul><li>first<li>second</ul>", [LONG, "Next one", "first", "second"]),
    ("siblings", f"<div><h1>Top</h1><div><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p></div>", ["Top", LONG, LONG, LONG]),
    ("scripts", f"<p>{LONG}</p><script>if (a < b) document.write('<p>no</p>')</script><style>p {{}}</style><!-- no -->", [LONG]),
    ("forms and notices", f"<main><p>{LONG}</p><form><p>Mail, please, now</p><input></form>"
                          f"<div class='cookie-notice'><p>{LONG}</p></div><p>End</p></main>", [LONG, "End"]),
    ("advert inside", f"<article><p>{LONG}</p><div class='ad'><p>Buy, buy, buy</p></div><p>After</p></article>", [LONG, "After"]),
    ("link list", f"<div><ul>{'<li><a href=x>Some, link, text, here</a></li>' * 20}</ul></div><div><p>{LONG}</p><p>b</p></div>",
     [LONG, "b"]),
    ("white space", f"<article><p>  a\n\t b </p>\n<p>{LONG}</p><p> </p>tail text</article>", ["a b", LONG, "tail text"]),
    ("references", f"<p>{LONG}</p><p>&lt;b&gt; &#233;&#x1F642; &unknown; &amp;lt;</p>", [LONG, "<b> é🙂 &unknown; &lt;"]),
    ("inline", f"<p>{LONG}</p><p>one<b>two</b> <i>three</i><span>four</span></p>", [LONG, "onetwo threefour"]),
    ("table", f"<article><p>{LONG}</p><table><tr><td>a<td>b<tr><td>c</table></article>", [LONG, "a", "b", "c"]),
    ("header in article", f"<article><header><h1>No</h1></header><p>{LONG}</p><section class=comments>x, y</section></article>", [LONG]),
    ("unclosed advert", f"<article><div class=ad>Buy<p>now</article><p>{LONG}</p>", [LONG]),
    ("unclosed paragraphs and items", f"<article><p class=ad>Buy<p>{LONG}<ul><li class=promo>no<li>yes</ul><p class='x'>End", [LONG, "yes", "End"]),
    ("camel case", f"<main><div class=cookieBanner><p>We, use, cookies</p></div><p>{LONG}</p><div id=userComments>x</div></main>", [LONG]),
    ("parts beside an inner div", f"<article><h1>T</h1><div>{f'<p>{LONG}</p>' * 30}</div><ul><li>one</ul><table><tr><td>cell</table>"
                                  "<section>short</section></article>", ["T", *[LONG] * 30, "one", "cell", "short"]),
    ("content that is named like parts", f"<main><p>{LONG}</p><section class='related-work'><p>Work</p></section><p class='legal-basis'>"
                                         "Basis</p><div class='related-posts'>x</div><div class=share>y</div></main>", [LONG, "Work", "Basis"]),
    ("notice and comment only", "<div class='cookie-notice'><p>We, use, them</p></div><div id=comments><p>I, reader, say</p></div>", [""]),
    ("plain text", "just words", ["just words"]),
    ("cut tag", f"<article><p>{LONG}</p><p>more <a hre", [LONG, "more"]),
]


@pytest.mark.parametrize("name,html,want", PAGES, ids=[p[0] for p in PAGES])
def test_main_text(name, html, want):
    assert H.main_text(html).split("\n") == want


def test_nothing_and_depth():
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav>x</nav>") == ""
    deep = "<div>" * 5_000 + f"<p>{LONG}</p>" + "</div>" * 5_000
    assert H.main_text(deep) == LONG
    assert H.main_text(f"<p>{LONG}</p>" + "<a " * 200_000) == LONG
    many = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert H.main_text(many).count("\n") == 19_999


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, extra int"
    rows = [(1, "u", PAGES[0][1], "old", 1), (1, "u", PAGES[0][1], "old", 1), (2, None, None, None, None), (None, "v", "", "x", 2)]
    pages = spark.createDataFrame(rows, schema)
    found = H.extracted(pages)
    assert found.columns == ["page_id", "url", "extra", "text"]
    assert sorted(str(r["text"]) for r in found.collect()) == sorted(["\n".join(PAGES[0][2])] * 2 + ["", ""])
    assert H.extracted(pages.limit(0)).count() == 0
