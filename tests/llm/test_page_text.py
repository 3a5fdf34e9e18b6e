"""Main text: markup against the standard library's parser, pages against their own layout."""

import html
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from skyfix.llm import page_text
from skyfix.llm.queries_page_text import op2_page_text

SF = "/root/testdata/sf0.001"


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = []

    def handle_data(self, data):
        self.parts.append(data)

    def handle_starttag(self, tag, attrs):
        self.parts.append(" ")

    def handle_endtag(self, tag):
        self.parts.append(" ")


def test_bad_markup_keeps_the_text_that_a_parser_keeps():
    r = random.Random(8)
    bits = [" title=it's", " a='q>r'", ' b="x"', " c", " d=u", ' e = "v>"', " /", "\n", " f='say \"hi\"'", " g=5\"", " h=a'b'c"]
    for _ in range(3000):
        tags = ["<" + r.choice(["p", "div", "b", "li"]) + "".join(r.choice(bits) for _ in range(r.randrange(5))) + r.choice([">", " >"]) for _ in range(4)]
        page = "".join(f"{t}word{i} & more{i} 1<2 {r.choice(['', '</p>', '</div >', '</>', '<!x>', '<?y>', '<!-- > -->'])}" for i, t in enumerate(tags)) + "<p>last</p>"
        parser = Text()
        parser.feed(page)
        parser.close()
        got = [w for _, text, _ in page_text.blocks(page) for w in text.split()]
        assert got == "".join(parser.parts).split(), page


def test_stray_quotes_lose_no_text():
    texts = lambda page: [text for _, text, _ in page_text.blocks(page)]
    assert texts("<p title=it's>Don't lose this text please.</p><p>Second.</p>") == ["Don't lose this text please.", "Second."]
    assert texts('<p><a href="x>link</a> text</p><p>Second.</p>') == ["link text", "Second."]
    assert texts("<p>A <noscript>n</noscript> b</p><noscript><p>No</p></noscript>C<svg><title>t</title><text>label</text></svg>") == ["A n b", "No", "C label"]
    assert texts("a < b and 3<4 </ x> z<!-->y<!--->w<!-- q --!>v <a x") == ["a < b and 3<4 zywv <a x"]


@pytest.mark.parametrize("bit", ['<a "', "<a x='", '<a x=">" ', "<", "</", "<!", "<p ", "<script>", "<select>", "<div>x", "<noscript>"])
def test_long_pages_take_time_in_proportion(bit):
    began = time.time()
    page_text.blocks(bit * (300_000 // len(bit)))
    assert time.time() - began < 8


def test_stretches_of_a_long_page_score_like_the_whole():
    weights, paths = page_text.load_weights(), {}
    for page in pq.read_table(f"{SF}/pages.parquet", columns=["html"]).column(0).to_pylist()[:20]:
        found = page_text.blocks(page)
        whole = page_text.scores([page_text.features(found, paths)], weights)[0]
        assert np.allclose(page_text.long_scores(found, paths, weights, 7), whole, atol=1e-3)


def test_query_gives_the_articles(spark):
    """The given pages mark their text by <article>; each of its blocks, and nothing else."""
    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    rows = op2_page_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        # Only a tag of its own ends a block in these articles; <b> and <br> are inside one.
        parts = [html.unescape(re.sub(r"<(?!br)[^>]*>", "", p).replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(" ".join(p.split()) for p in parts if p.split()) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, blocks string, text string"
    many = "<p>" + "word " * 20 + "end.</p>"
    df = spark.createDataFrame([(1, "u", None, "b", "t"), (None, None, "", "b", "t"), (2, "v", f"<article>{many * 3000}</article>", "", ""), (2, "v", f"<article>{many}</article>", "", "")], schema)
    got = page_text.extract(df).collect()
    assert len(got) == 4 and sorted(len(r.text) for r in got)[:2] == [0, 0] and max(r.text.count("\n") for r in got) == 2999
    assert page_text.extract(df.limit(0)).count() == 0


LAYOUTS = {tag or "none": lambda inner, t=tag: f"<{t}>{inner}</{t}>" if t else inner for tag in ("article", "section", "div", "main", "")}
LAYOUTS |= {f"{n} wrappers": lambda inner, n=n: "<div>" * n + f"<article>{inner}</article>" + "</div>" * n for n in (1, 3, 6, 12)}
LAYOUTS |= {f"{n} sections in div": lambda inner, n=n: '<div class="container">' + "<section>" * n + inner + "</section>" * n + "</div>" for n in (1, 12)}
LAYOUTS |= {"named": lambda inner: f'<div class="row"><div id="zq9">{inner}</div></div>'}


@pytest.mark.parametrize("layout", list(LAYOUTS))
def test_article_is_found_in_any_container(layout):
    """The article of every given page of sf0.01, put into other elements, by blocks."""
    w = page_text.load_weights()
    right = kept = there = 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        before, inner, after = re.fullmatch(r"(.*)<article>(.*)</article>(.*)", page, re.S).groups()
        truth = [t for _, t, _ in page_text.blocks(inner)]
        found = page_text.blocks(before + LAYOUTS[layout](inner) + after)
        z = page_text.scores([page_text.features(found, {})], w)[0]
        got = [t for (_, t, _), s in zip(found, z) if s > 0]
        right += len(truth) - sum((Counter(truth) - Counter(got)).values())
        kept, there = kept + len(got), there + len(truth)
    print(layout, "recall", right / there, "precision", right / kept)
    assert right >= 0.98 * there and right >= 0.98 * kept


def test_references_and_hidden_elements():
    texts = lambda page: [text for _, text, _ in page_text.blocks(page)]
    assert texts("<p>&<b>lt;</b> R&<b>reg</b>ion a&amp;lt; &<!-- -->amp;</p>") == ["&lt; R&region a&lt; &amp;"]
    assert texts("<p>x <desc>title para</desc> y</p><p><metadata>m</metadata></p>") == ["x title para y", "m"]
    assert texts("<p>a <svg><desc>no</desc><text>b</text></svg> <math><mi>c</mi><annotation>no</annotation></math></p><desc>d</desc>") == ["a b c", "d"]
    assert texts('<p>One</p><a "<p title="a>b">Two</p><p title="c>d">Three</p>')[-1] == "Three"
