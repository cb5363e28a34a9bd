import pytest

import html as entities
import re
import time

import numpy as np

from tessera.llm import html_text
from tessera.llm.html_text import content_lines, extract_text, main_text, smoothed

WORDS = "Plain prose that goes on for a while, as articles do, with more than a few words in each line. "


def page(body, head="<title>T</title><style>p{}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("<p></p><script>x</script>", ""),
        ("just text &amp; more", "just text & more"),
        (page("<nav><ul><li><a href='/a'>A</a></ul></nav><article><h1>Title</h1><p>One\n  two<br>three</p><p>Four</article><footer>F</footer>"), "Title\n\nOne two three\n\nFour"),
        (page("<div class='ad'>buy</div><article><p><b>Open bold<br><p>Next &lt;b&gt; &eacute;&#8212;&#x41;</article>"), "Open bold\n\nNext <b> é—A"),
        (page("<article><header><h1>Kept</h1></header><p>Body</p><aside>not</aside><form>no</form><section class='comments'><p>hi</p></section></article>"), "Kept\n\nBody"),
        (page("<div class='header'>top</div><article><div class='entry-header'><h1 id='related-work'>Kept</h1></div><blockquote>Short</blockquote></article>"), "Kept\n\nShort"),
        (page("<header><h1>Site</h1></header><main><p>" + WORDS * 3 + "</p></main>"), (WORDS * 3).strip()),
        (page("<article><p>a<!-- note --> b</p><p hidden>no</p><p style='display: none'>no</p><table><tr><td>x<td>y</table></article>"), "a b\n\nx\n\ny"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_regions_without_an_article_are_chosen_by_their_ratio():
    links = "".join(f"<div><a href='/{k}'>go {k}</a> <a href='/x'>x</a> <b>y</b></div>" for k in range(12))
    body = "".join(f"<p>{WORDS * 2}</p>" for _ in range(6))
    got = main_text(page(f"<div>{links}</div><div id='main-text'>{body}</div><div>{links}</div>"))
    assert got == "\n\n".join([(WORDS * 2).strip()] * 6)


def test_smoothing_keeps_a_constant_and_clusters_split_levels():
    assert np.allclose(smoothed(np.full(9, 3.0)), 3.0)
    ratios = np.array([1.0] * 20 + [90.0] * 20)
    assert content_lines(ratios, np.zeros(40, bool)).tolist() == [False] * 20 + [True] * 20
    assert content_lines(np.array([9.0] * 40), np.zeros(40, bool)).all()


def test_long_page_is_whole():
    paragraphs = [f"p{k} " + WORDS.strip() for k in range(5_000)]
    assert main_text(page("<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>")) == "\n\n".join(paragraphs)


def test_tables(spark):
    rows = [(1, "u", page("<article><p>x</p></article>"), "c"), (1, "u", page("<article><p>x</p></article>"), "c"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [(1, "u", "x"), (1, "u", "x"), (None, None, "")]
    assert extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html,text",
    [
        (page("<article><p>A</p><section id='discussion'><p>B</p></section><section id='related-work'><p>C</p></section><div class='alert-levels'><p>D</p></div></article>"), "A\n\nB\n\nC\n\nD"),
        (page("<article class='post comments-open'><p>A</p><div class='share-buttons'>x</div><div class='sidebar'>y</div></article>"), "A"),
        (page("<div class='content has-sidebar'><p>A</p></div>"), "A"),
        (page("<div class='no-sidebar'><article><p>A</p></article></div>"), "A"),
        (page("<div class='widget'><p>A</p></div>"), "A"),
        ("<html><head><title>T</title><body><article><p>A</p></article>", "A"),
        ("<html><head><title>T</title><meta charset='x'><p>A</p>", "A"),
        (page("<article><p>" + WORDS + "</p><table><tr><td><a href='/x'>Linked cell</a></td><td>y</td></tr></table></article>"), WORDS.strip() + "\n\nLinked cell\n\ny"),
    ],
)
def test_article_text_is_whole(html, text):
    assert main_text(html) == text


LINKS = "".join(f"<p><a href='/{k}'>Read {k}</a> <a href='/{k}#c'>{k}</a></p>" for k in range(12))
BITS = "".join(f"<p><b>{k}</b> <i>min</i></p>" for k in range(12))
PROSE = "".join(f"<p>{WORDS * 2}</p>" for _ in range(6))
NEUTRAL = {
    "no article": page(f"<div>{BITS}</div><div>{PROSE}</div><div>{BITS}</div>"),
    "article with a neutral box": page(f"<article>{PROSE}<div>{BITS}</div></article>"),
}


@pytest.mark.parametrize("html", [page(f"<div>{LINKS}</div><div>{PROSE}</div><div>{LINKS}</div>"), page(f"<article>{PROSE}<div>{LINKS}</div></article>")])
def test_boxes_of_links_go(html):
    assert main_text(html) == "\n\n".join([(WORDS * 2).strip()] * 6)


@pytest.mark.parametrize("name", NEUTRAL)
def test_clusters_alone_tell_neutral_boxes_apart(name, monkeypatch):
    wanted = "\n\n".join([(WORDS * 2).strip()] * 6)
    assert main_text(NEUTRAL[name]) == wanted
    # with the clustering stubbed the result is another
    monkeypatch.setattr(html_text, "threshold", lambda level: 0.0)
    assert main_text(NEUTRAL[name]) != wanted


@pytest.mark.parametrize(
    "html,text",
    [
        (page("<form action='/'><div id='page'><article><h1>T</h1><p>A form around the page</p></article></div></form>"), "T\n\nA form around the page"),
        (page(f"<form><div>{PROSE}</div></form>"), "\n\n".join([(WORDS * 2).strip()] * 6)),
        (page(f"<article>{PROSE}<form><p>Your address</p><input name='a'><button>Go</button></form></article>"), "\n\n".join([(WORDS * 2).strip()] * 6)),
        (page("<article><p>Let <math><mi>x</mi><annotation>TeX</annotation></math> be <svg><text>t</text></svg> a <button>b</button> number.</p></article>"), "Let x be a number."),
        (page("<article><p>One<script>1</script> line<span class='ad'>buy</span> only</p></article>"), "One line only"),
        (page("<article><p>" + WORDS + "</p><div class='table'><table>" + "<tr><td>7</td><td>8</td></tr>" * 20 + "</table></div></article>"), WORDS.strip() + "\n\n7\n\n8" * 20),
        ("<p>a<!-- never closed <p>b", "a"),
        ("<p>a <a href='odd>k</a><p>more", "a k\n\nmore"),
    ],
)
def test_forms_inline_elements_and_unfinished_markup(html, text):
    assert main_text(html) == text


def plain_article(html):
    """The article of a well-formed page by substitution alone."""
    body = re.search(r"<article>(.*?)</article>", html, re.DOTALL)[1]
    blocks = re.split(r"</?(?:p|h1|h2|ul|li)>", body.replace("<br>", " "))
    return "\n\n".join(t for b in blocks if (t := " ".join(entities.unescape(re.sub(r"<!--.*?-->|<[^>]+>", "", b, flags=re.DOTALL)).split())))


def test_all_pages_against_a_plain_second_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_text(pages).collect()}
    assert got == {r["page_id"]: plain_article(r["html"]) for r in pages.collect()} and len(got) == 250


@pytest.mark.parametrize("piece", ["<span>a</b>", "<b><div><span>a</b>", "<a ", "<!--", "<p><i>", "<td></table>", "<"])
def test_long_odd_pages_take_linear_time(piece):
    def seconds(n):
        start = time.perf_counter()
        main_text(piece * n)
        return time.perf_counter() - start

    seconds(500)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.02)


PROSE = "<p>" + "A sentence of the article that goes on for a while and says something. " * 4 + "</p>"


def test_a_list_of_linked_sources_stays():
    source = '<li><a href="/s">Author, A. and Writer, B. (2001). A long title of a cited work. Journal of Examples.</a></li>'
    text = main_text(f"<body><article>{PROSE * 3}<section><h2>References</h2><ul>{source * 6}</ul></section></article></body>")
    assert text.count("Journal of Examples") == 6 and "References" in text
    menu = "<ul>" + '<li><a href="/n">Next page</a></li>' * 8 + "</ul>"
    assert "Next page" not in main_text(f"<body><article>{PROSE * 3}<section>{menu}</section></article></body>")


def test_a_headline_beside_the_article_stays():
    page = f"<body><nav>Menu</nav><div><h1>The headline</h1><span>By somebody</span><article>{PROSE * 3}</article></div></body>"
    assert main_text(page).startswith("The headline\n\nA sentence")
    own = f"<body><header><h1>Site</h1></header><div><h1>Other</h1><article><h1>Own</h1>{PROSE}</article></div></body>"
    assert main_text(own).startswith("Own\n\n") and "Other" not in main_text(own)


def test_articles_of_readers_go():
    comments = f'<section><article class="comment">{PROSE.replace("sentence", "remark")}</article></section>'
    text = main_text(f'<body><main><article class="post">{PROSE * 3}</article>{comments}</main></body>')
    assert "remark" not in text and text.count("A sentence") == 12
