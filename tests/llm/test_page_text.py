import html
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from tidemark.llm import page_text, q_page_text


def inside_article(source):
    """The text of the only article of a plain page, by cutting its tags."""
    body = source[source.index("<article>") + 9 : source.rindex("</article>")]
    blocks = re.split(r"</?(?:p|h1)>", body)
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n".join(b for b in lines if b)


@pytest.mark.parametrize("which", ["data", "larger"])
def test_whole_table(spark, request, which):
    folder = request.getfixturevalue(which)
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    want = Counter((r.page_id, r.url, t, len(t)) for r in pages for t in [inside_article(r.html)])
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in q_page_text.query(spark, folder).collect())
    assert got == want


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def site(rng, n_pages, name, wrap):
    """Pages of one host that share boxes without telling names, and their expected text."""
    boxes = [f"<div><p>{words(rng, 8)}</p><p>{words(rng, 6)}</p></div>" for _ in range(3)]
    out = []
    for k in range(n_pages):
        parts = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(3, 6))]
        inner = "".join(f"<p>{p}</p>" + (boxes[0] if i == 1 else "") for i, p in enumerate(parts))
        out.append((f"https://{name}/{k}", f"<html><body>{boxes[1]}{wrap[0]}<h1>Title {k}</h1>{inner}{wrap[1]}{boxes[2]}</body></html>", "\n".join([f"Title {k}", *parts])))
    return out


def extracted(spark, rows):
    """Texts in order of ``rows`` (url, html)."""
    frame = spark.createDataFrame([(k, u, h, "x", "y", 3) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, marks string, n_pages int").repartition(3)
    return [r.text for r in sorted(page_text.extract_main_text(frame).collect(), key=lambda r: r.page_id)]


@pytest.mark.parametrize("wrap", [("<article>", "</article>"), ("<div class='content'>", "</div>"), ("<div>", "</div>")])
def test_templates_of_a_host_go(spark, wrap):
    rng = random.Random(5)
    rows = site(rng, 12, "a.example", wrap) + site(rng, 8, "b.example:8080", wrap)
    assert extracted(spark, [(u, h) for u, h, _ in rows]) == [t for _, _, t in rows]


def test_copies_and_common_passages_stay(spark):
    rng = random.Random(6)
    license_line, article = "Released under a licence.", [words(rng, 40) for _ in range(4)]
    rows = []
    for k in range(20):
        copied = k < 12
        parts = list(article) if copied else [words(rng, 40) for _ in range(4)]
        parts[2] = words(rng, 30) if copied and k % 2 else parts[2]
        parts += [license_line] if k % 3 == 0 else []
        rows.append((f"http://x@Copies.example/{k % 15}", f"<nav>Home {k}</nav><article>{''.join(f'<p>{p}' for p in parts)}</article>", "\n".join(parts)))
    rows += rows[:3]
    assert extracted(spark, [(u, h) for u, h, _ in rows]) == [t for _, _, t in rows]


CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple <b>text</b> a < b", "plain & simple text a < b"),
    ("<article>one<br>two<p>three  \n four<p>five&nbsp;&eacute;&#x41;</article>after", "one two\nthree four\nfive éA"),
    ("<body><header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>Text</p></main><footer>f</footer>", "Title\nText"),
    ("<article><h1>T</h1><p>a<form><input><label>Name</label></form><p>b<aside>no</aside><div class='ad-slot'>buy</div><script>x('</p>')</script><style>p{}</style><!-- <p>no</p> --><p>c</article>", "T\na\nb\nc"),
    ("<article><p>a</p><section id='comments'><article class='comment'><p>reader</p></article></section></article>", "a"),
    ("<article><p>a</p></article><section id='comments'><article><p>reader one says a lot more than the text</p></article></section>", "a"),
    ("<form id='aspnet'><article><p>in a form</p></article><p>menu</p></form>", "in a form"),
    ("<div class='has-sidebar content'><p>kept</p><div class='sidebar'>gone</div></div>", "kept"),
    ("<p>text of a page<ul class='menuList'><li><a href=x>a</a><li>b</ul><div><a href='#'>link</a> <a>link</a></div>", "text of a page"),
    ("<article><ul><li>one<li>two<ul><li>in</ul></ul><table><tr><td>a<td>b<tr><th>c</th></table></article>", "one\ntwo\nin\na b\nc"),
    ("<article><p hidden>x</p><p style='display: none'>y</p><p>a <span class='share'>share</span> b</p><div role=navigation>n</div></article>", "a b"),
    ("<article><p>un<b>bold<i>both</b>it</i>al &lt;tag&gt; &am &amp</article><div class=cookie-notice>Cookies</div>", "unboldbothital <tag> &am &"),
    ("<article><p title='>'>quoted</p><p class=\"open>kept</p></article>", "quoted\nkept"),
    ("<article></article>", ""),
    ("<nav>only a menu</nav>", ""),
    ("<![CDATA[data]]><textarea><p>no</textarea>yes", "datayes"),
    ("<article><p>a&#0;b\ud83d</article>".encode("utf-8", "replace").decode(), "a�b?"),
]


def test_cases(spark):
    assert extracted(spark, [("http://h.example/1" if k % 2 else None, h) for k, (h, _) in enumerate(CASES)]) == [t for _, t in CASES]


class Plain(HTMLParser):
    """All text of a page by the standard library's parser, white space dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_data(self, data):
        self.found.append(data)


def test_all_text_of_random_markup():
    rng = random.Random(8)
    bits = ["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<br>", "<!-- c -->", "&amp;", "&lt;", "word ", "<td>", "<tr>", "<table>", "</table>", "<h2>", "</h2>", "text", "<span id=q>", "</span>", "<section>", "</section>"]
    for _ in range(500):
        source = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        plain = Plain()
        plain.feed(source)
        plain.close()
        assert "".join(page_text.main_text(source).split()) == "".join("".join(plain.found).split())


def test_long_and_hostile_pages_take_linear_time():
    start = time.perf_counter()
    for source in ("<div>" * 100_000 + "x", "<b>" * 100_000 + "x", "<p>" * 100_000 + "x", '<a "' * 100_001, "<a href='" * 50_001, "<" * 200_000, "<!--" * 100_000, "</p>" * 100_000 + "<li>" * 50_000, "<script>" * 50_000, "&" * 100_000):
        page_text.main_text(source)
    assert page_text.main_text("<article>" + "<p>word word</p>" * 200_000 + "</article>").count("\n") == 199_999
    assert time.perf_counter() - start < 60


def test_empty_table(spark):
    assert page_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
