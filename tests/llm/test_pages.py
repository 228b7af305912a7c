from __future__ import annotations

import html
import itertools
import re
import time

import pyarrow.parquet as pq
import pytest

from flowlens.llm import pages


@pytest.fixture(scope="module")
def chain():
    return pages.trained()


def test_held_out_pages(chain):
    f, wrong, right, missed, n = pages.extractor(chain), 0, 0, 0, 0
    for page, main in pages.labelled_pages(300, seed=77):
        got = set(f(page).split("\n"))
        for b in pages.leaf_blocks(page):
            n += 1
            right += b.text in got and b.text in main
            wrong += b.text in got and b.text not in main
            missed += b.text not in got and b.text in main
    assert wrong / n < 0.01 and missed / n < 0.01 and right > 1000


def test_held_out_pages_without_a_named_article(chain):
    f, wrong, right, missed, n = pages.extractor(chain), 0, 0, 0, 0
    for page, main in pages.labelled_pages(300, seed=78, unnamed=1.0):
        got = set(f(page).split("\n"))
        for b in pages.leaf_blocks(page):
            n += 1
            right += b.text in got and b.text in main
            wrong += b.text in got and b.text not in main
            missed += b.text not in got and b.text in main
    assert wrong / n < 0.01 and missed / n < 0.01 and right > 1000


UNNAMED = [
    ("<html><body><h1>A title</h1><p>Bare paragraph one goes on a while, with words.</p><p>Second bare paragraph.</p></body></html>", ["A title", "Bare paragraph one goes on a while, with words.", "Second bare paragraph."]),
    ("<body><div id=nav><a href=/>Home</a> | <a href=/b>Blog</a></div><div><h2>A day out</h2><p>We went to the sea. It was good.</p><ul><li>Sand</li><li>Salt</li></ul></div><div class=footer>Copyright 2020 X</div></body>", ["A day out", "We went to the sea. It was good.", "Sand", "Salt"]),
    ("<header><a href=/>Site</a></header><div class='c12'><div class='xk'><h1>Hello</h1><p>Text of the story, and it has <a href=x>links</a> inside.</p><blockquote>Quoted words.</blockquote></div></div><aside><h3>Related</h3><ul><li><a href=/>More</a></li></ul></aside><footer>&copy; 2020</footer>", ["Hello", "Text of the story, and it has links inside.", "Quoted words."]),
    ("<p>One sentence.</p><p>And another one, that is a bit longer.</p>", ["One sentence.", "And another one, that is a bit longer."]),
    ("Plain text only.", ["Plain text only."]),
    ("<nav><ul><li><a href=/>Home</a></li></ul></nav><p>First paragraph of the page, no box at all.</p><div class=comments><h3>Comments</h3><article class=comment><p>Nice one, thanks.</p></article></div>", ["First paragraph of the page, no box at all."]),
    ("<h1>Recipes</h1><div>Mix the flour with water. Stir it well.</div><div>Bake it for an hour.</div><div class='cookie-banner'>We use cookies. <button>OK</button></div>", ["Recipes", "Mix the flour with water. Stir it well.", "Bake it for an hour."]),
]


@pytest.mark.parametrize(("page", "text"), UNNAMED)
def test_articles_in_plain_boxes_and_bare_paragraphs(chain, page, text):
    assert pages.extractor(chain)(page) == "\n".join(text)


def test_blocks_outside_a_named_article_are_apart():
    apart = lambda p: [b.apart for b in pages.leaf_blocks(p)]
    assert apart("<p>a</p><article><p>b</p></article><p>c</p>") == [True, False, True]
    assert apart("<p>a</p><div class=post-content><p>b</p></div><p>c</p>") == [True, False, True]
    assert apart("<p>a</p><div class=comments><article><p>b</p></article></div>") == [False, False]
    assert apart("<p>a</p><article class=comment><p>b</p></article>") == [False, False]


def test_articles_of_the_table(chain, sf_dir):
    f = pages.extractor(chain)
    for page in pq.read_table(f"{sf_dir}/pages.parquet")["html"].to_pylist():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S).group(1)
        inner = re.sub(r"</?(a|b|br)\b[^>]*>", " ", re.sub(r"<[^>]*\Z", "", inner))
        parts = [" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]+>", inner)]
        assert f(page) == "\n".join(x for x in parts if x)


def test_whole_page(chain):
    page = """<!doctype html><html><head><title>T</title><style>p > a{}</style></head><body><header><a href="/">Site</a></header>
    <nav class=menu><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><main><article><header><h1>The title</h1></header>
    <p>First &amp; best&nbsp;&lt;p&gt; text,   with <b>bold
    </b>words.<div class="ad-slot"><p>Buy this now.</p></div><p>Second<br>line. <script>if (a < b) document.write("<p>no</p>")</script>
    <form><label>Mail</label><input></form><ul><li>Item one.<li>Item two.</ul></article>
    <section id="comments"><h2>Comments</h2><article class="comment"><p>I think that this was good.</p></article></section></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other</a></li></ul></aside><div class="cookie-notice"><p>We use cookies.</p></div>
    <footer><p>&copy; 2024 Someone. All rights reserved.</p></footer></body></html>"""
    assert pages.extractor(chain)(page).split("\n") == ["The title", "First & best <p> text, with bold words.", "Second line.", "Item one.", "Item two."]


def test_broken_markup():
    texts = lambda p: [b.text for b in pages.leaf_blocks(p)]
    assert texts("<p>a<p>b</div></p>c <a href='x>y'>d") == ["a", "b", "c d"]
    assert texts("<p title=\"x>y\">a</p><p>b &am") == ["a", "b &am"]
    assert texts("<p>a</p><p>b</p") == ["a", "b"]
    assert texts("a < b and c > d <") == ["a < b and c > d"]
    assert texts("<p>x<!-- <p>y</p> --></p><script>z") == ["x"]
    assert texts("<TD>1<Td>2") == ["1", "2"]
    assert texts(None) == texts("") == texts("<br><p> \n</p>") == []
    assert len(texts("<p>" * 50_000 + "x")) == 1
    assert texts("<div>" * 5_000 + "x" + "</div>" * 5_000) == ["x"]


def test_self_closed_and_unclosed_elements_cut_nothing_off():
    texts = lambda p: [b.text for b in pages.leaf_blocks(p)]
    assert texts('<p>One <svg class="i"/> two.</p><p>Three.</p>') == ["One two.", "Three."]
    for name in "svg button select template datalist".split():
        assert texts(f"<p>a</p><{name}/><p>b</p><{name} x='>' /><p>c</p>") == ["a", "b", "c"]
        assert texts(f"<p>a</p><{name}><p>b</p>") == ["a", "b"]
        assert texts(f"<p>a</p><{name}/><p>b</p><{name}>hidden</{name}><p>c</p>") == ["a", "b", "c"]
        assert texts(f"<p>a</p><{name}><p>b</p><{name} id=2>hidden <i>too</i></{name}><p>c</p>") == ["a", "b", "c"]
        assert texts(f"<p>a</p><{name.upper()}>hidden <{name}>more</{name}> and more</{name}><p>c</p>") == ["a", "c"]
    for name in "math object canvas video audio iframe noscript".split():
        assert texts(f"<p>a</p><{name}/><p>b</p><{name} x='>' /><p>c</p>") == ["a", "b", "c"]
        assert texts(f"<p>Let <{name}>x = 1</{name}> hold.</p>") == ["Let x = 1 hold."]
    for name in ("script", "style", "textarea", "title"):
        assert texts(f"<p>a</p><{name}>b<p>c</p>") == ["a"]
        assert texts(f"<p>a</p><{name}/>b</{name}><p>c</p>") == ["a", "c"]
    assert texts("<p>a</p>" + "<svg>" * 20_000 + "<p>b</p>") == ["a", "b"]


def test_query_equals_enumerated_labels(spark, chain):
    """The query's text is that of the best of all labellings, where a page has few blocks."""
    rows = [(n, f"u{n}", page) for n, (page, _) in enumerate(pages.labelled_pages(250, seed=9)) if 0 < len(pages.leaf_blocks(page)) <= 10]
    assert len(rows) > 10
    rows += [(1000, "u", "<p>" + "x" * 300_000 + "</p>"), (1001, "u", "<div><p>One two three.</p></div>" * 20_000)]
    out = {r["page_id"]: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, page in rows[:-2]:
        blocks = pages.leaf_blocks(page)
        scores = [chain.bias + sum(chain.weights.get(f, 0.0) for f in pages.block_features(b)) for b in blocks]

        def total(labels, scores=scores):
            inner = sum(chain.step[a][b] for a, b in itertools.pairwise(labels))
            return chain.start[labels[0]] + chain.end[labels[-1]] + inner + sum(s for s, y in zip(scores, labels, strict=True) if y)

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=total)
        assert out[i]["text"] == "\n".join(b.text for b, y in zip(blocks, best, strict=True) if y)
        assert out[i]["n_chars"] == len(out[i]["text"])
    assert len(out) == len(rows)


def test_nulls_repeats_and_other_columns(spark, chain):
    rows = [(1, "u", "<article><p>One sentence here.</p></article>", "x"), (1, "u", "<article><p>One sentence here.</p></article>", "x"), (None, None, None, "x"), (3, "u", "", "x")]
    out = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), chain)
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(1, "u", "One sentence here.", 18)] * 2 + [(None, None, "", 0), (3, "u", "", 0)]))
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string"), chain).count() == 0


@pytest.mark.parametrize("tag", ["<svg", "<svg>", "<select>", "<button ", "<math", "<svg a=\"", "<svg><svg></svg>", "<script ", "<svg/>", "</svg ", "<svg></svg x>", "<!--"])
def test_tags_without_end_cost_no_more_than_their_length(tag):
    began = time.process_time()
    pages.leaf_blocks(tag * (300_000 // len(tag)))
    assert time.process_time() - began < 5


def test_hidden_elements_end_as_they_begin():
    text = lambda h: [b.text for b in pages.leaf_blocks(h)]
    assert text("<p>a<svg>x</svg>b") == ["ab"] and text("<p>a<svg/>b") == ["ab"] and text("<p>a<svg>b") == ["ab"]
    assert text("<p>a<svg>x<svg>y</svg>z<svg/></svg>b") == ["ab"] and text("<p>a<SVG>x<svg>y<svg>z</svg></svg></svg>b") == ["axb"]
    assert text("<p>a<svg>x</svg y>b") == ["axb"] and text('<p>a<svg t="</svg>">x</svg>b') == ["ab"]
