"""Main text: where the ratios decide and where not, against the articles' own blocks, and long pages."""

import html
import re
import time

import numpy as np
import pytest

from tidemark.llm import html_text

SF = "/root/testdata/sf0.01"


def blocks_of_article(page: str) -> str:
    """The text of the article's blocks, found with regular expressions."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = [re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", b)) for b in re.split(r"</?(?:p|h1|h2|div|ul|li)\b[^>]*>", inner)]
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in parts) if t)


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]


def test_every_page_gives_the_blocks_of_its_article(pages):
    assert all(html_text.main_text(p) == blocks_of_article(p) for p in pages)


def wrong_with(pages, want, monkeypatch, raw):
    """How many pages differ when every line's raw ratio, before any weight, is replaced by raw(ratio)."""
    flush = html_text.Lines.flush

    def replaced(self):
        before = len(self.lines)
        flush(self)
        if len(self.lines) > before:
            text, ratio, at = self.lines[-1]
            self.lines[-1] = (text, raw(ratio), at)

    with monkeypatch.context() as patch:
        patch.setattr(html_text.Lines, "flush", replaced)
        return sum(html_text.main_text(p) != w for p, w in zip(pages, want, strict=True))


def test_with_marks_the_ratios_hardly_matter(pages, monkeypatch):
    """Menus, adverts and articles of these pages are all marked: any ratio gives the article."""
    rng = np.random.default_rng(1)
    want = [blocks_of_article(p) for p in pages]
    assert [wrong_with(pages, want, monkeypatch, raw) for raw in (float, lambda _: 1.0, lambda _: rng.random() * 200)] == [0, 0, 0]


def test_without_marks_the_ratios_decide(pages, monkeypatch):
    rng = np.random.default_rng(1)
    want = [blocks_of_article(p) for p in pages]
    bare = [p.replace("<article", "<div").replace("</article", "</div") for p in pages]
    monkeypatch.setattr(html_text, "HINTS", frozenset())
    monkeypatch.setattr(html_text, "ASIDE", frozenset())
    real, constant, random = (wrong_with(bare, want, monkeypatch, raw) for raw in (float, lambda _: 1.0, lambda _: rng.random() * 200))
    assert real < 0.55 * len(pages) and min(constant, random) > 0.9 * len(pages)


def test_without_any_mark_the_ratios_find_the_text():
    text = "A sentence of the story that goes on for some time, as sentences of stories do."
    links = "".join(f'<li><a href="/{i}">Topic {i}</a></li>' for i in range(8))
    page = f"<body><div><ul>{links}</ul></div><div><h1>Title</h1><p>{text}</p><p>Short.</p><p>{text} {text}</p></div><div><a>Imprint</a> <a>About</a></div></body>"
    assert html_text.main_text(page) == f"Title\n{text}\nShort.\n{text} {text}"


def test_heading_and_intro_beside_the_text_stay():
    text = "A sentence of the story that goes on for some time, as sentences of stories do. " * 8
    page = f"<body><nav><a>x</a></nav><div><h1>Title</h1><p>Intro.</p><blockquote><div>{text}</div></blockquote><p>End.</p></div><footer>of the site</footer></body>"
    assert html_text.main_text(page) == f"Title\nIntro.\n{text.strip()}\nEnd."


def test_comments_and_adverts_inside_an_article_go_but_not_an_article_inside_a_marked_element():
    text = "A sentence of the story that goes on for some time, as sentences of stories do."
    page = f'<article><h1>T</h1><p>{text}</p><div class="ad"><p>Buy this now.</p></div><p>{text}</p><section class="comments"><p>I liked that, thank you.</p></section></article>'
    assert html_text.main_text(page) == f"T\n{text}\n{text}"
    assert html_text.main_text(f'<nav><a>x</a></nav><div class="content-ad"><p>{text}</p><p>{text}</p></div>') == f"{text}\n{text}"


def test_threshold_parts_two_clusters():
    assert 2 < html_text.threshold(np.array([1.0, 40.0, 2.0, 50.0, 1.5])) <= 40
    assert html_text.threshold(np.array([3.0])) == html_text.threshold(np.array([3.0, 3.0])) == 0.0


def test_smoothing_equals_its_definition():
    rng = np.random.default_rng(0)
    values, alike = rng.random(30), np.repeat([0, 1, 0], [11, 1, 18])
    run = np.repeat([0, 1, 2], [11, 1, 18])
    for sigma in (0.5, 1.0, 2.0):
        want = []
        for i in range(30):
            w = [np.exp(-0.5 * ((i - j) / sigma) ** 2) * (abs(i - j) <= np.ceil(2 * sigma)) * (run[i] == run[j]) for j in range(30)]
            want.append(np.dot(w, values) / np.sum(w))
        assert np.allclose(html_text.smoothed(values, alike, sigma), want)


@pytest.mark.parametrize("piece", ["<div><p>some text", "<b>x</i>", "<ul><li>x", "<table><tr><td>x", "<div class=ad>x</p>"])
def test_long_unclosed_pages_take_time_in_proportion(piece):
    def seconds(n):
        began = time.perf_counter()
        html_text.main_text(piece * n)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(80_000) < 12 * max(seconds(20_000), 0.05)
