"""Tag-path ratios against a restatement on the standard library's parser, and hostile pages."""

import math
import random
import time
from html.parser import HTMLParser

import pandas as pd
import pytest
from conftest import DATA

from tandemetry.llm import html_paths

TEXT = {"p", "h1", "h2", "li", "blockquote"}
FURNITURE = {"nav", "footer", "aside", "form"}
WORDS = {"ad", "comments", "sidebar", "share", "widget", "search"}


class Plain(HTMLParser):
    """(path, text, link characters) of every text of a well-formed page of few tags; a path is a tuple of labels."""

    def __init__(self):
        super().__init__()
        self.path, self.texts, self.link = [], [], False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
        else:
            self.path.append((tag, "" if tag in TEXT or not attrs else attrs[0][1]))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        else:
            self.path.pop()

    def handle_data(self, data):
        if data.strip():
            key = tuple(self.path)
            if self.texts and self.texts[-1][0] == key and self.texts[-1][3] == len(self.path):
                self.texts.pop()
            self.texts.append((key, data.strip(), len(data.strip()) if self.link else 0, -1))


def restated(page):
    parser = Plain()
    parser.feed(page)
    rows = [(p, t, n) for p, t, n, _ in parser.texts]
    paths = list(dict.fromkeys(p for p, *_ in rows))
    bad = lambda label: label[0] in FURNITURE or bool(WORDS & set(label[1].replace("-", " ").split()))
    ratio, links, chars = {}, {}, {}
    for path in paths:
        mine = [(t, n) for p, t, n in rows if p == path]
        size, linked = sum(len(t) for t, _ in mine), sum(n for _, n in mine)
        marks = sum(c in ".,;:!?" for t, _ in mine for c in t)
        ratio[path], links[path], chars[path] = (size - linked) / len(mine) * (1 + marks / len(mine)), linked / size, size - linked
    articled = any(("article", "") in p and not any(map(bad, p)) for p in paths)
    mass = {p: chars[p] * (0.3 if any(map(bad, p)) else 1) * (0.3 if articled and ("article", "") not in p else 1) for p in paths}
    top = max(paths, key=lambda p: mass[p], default=None)
    if top is None or mass[top] == 0:
        return ""
    article = top[: top.index(("article", "")) + 1] if ("article", "") in top else ()
    spine = {top[:k] for k in range(len(top) + 1)}
    weight = {}
    for p in paths:
        spoilt = any(bad(p[k]) and p[: k + 1] not in spine for k in range(len(p)))
        weight[p] = 0.2 if spoilt or p[: len(article)] != article else 1.0
    value = [ratio[p] * weight[p] for p, *_ in rows]
    near = []
    for i in range(len(rows)):
        w = {j: math.exp(-((i - j) ** 2) / 2) for j in range(i - 2, i + 3) if 0 <= j < len(rows)}
        near.append(sum(value[j] * x for j, x in w.items()) / sum(w.values()))
    fused = {}
    for p in paths:
        mine = [v for v, (q, *_) in zip(near, rows, strict=True) if q == p]
        fused[p] = math.sqrt(ratio[p] * weight[p] * sum(mine) / len(mine))
    good = {p for p in paths if p == top or weight[p] * (1 - links[p]) * min(1, fused[p] / fused[top]) >= 0.25}

    def holder(p):
        while p and p[-1][0] in TEXT | {"ul"}:
            p = p[:-1]
        return p

    holders = {holder(p) for p in good if chars[p] >= 0.25 * chars[top]} | ({article} if article else set())
    inside = {p for p in paths if any(p[: len(h)] == h for h in holders)}
    titled = any(p[-1][0] == "h1" for p in inside)
    lone = {p for p in paths if not titled and p[-1][0] == "h1" and (p[:-1] in spine or article and p[: len(article)] == article)}
    good |= {p for p in inside | lone if weight[p] * (1 - links[p]) >= 0.25}
    return "\n\n".join(t for p, t, _ in rows if p in good)


def made_page(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join("word" + ("," if rng.random() < 0.2 else "") for _ in range(rng.randrange(1, n))) + "."
    div = lambda body, cls="": f'<div class="{cls}">{body}</div>' if cls else f"<div>{body}</div>"
    story = "<h1>" + say(6) + "</h1>" * 1 + "".join(f"<p>{say(40)}</p>" if rng.random() < 0.7 else f"<h2>{say(5)}</h2>" if rng.random() < 0.5 else f"<ul><li>{say(9)}</li><li>{say(9)}</li></ul>" for _ in range(rng.randrange(1, 9)))
    story += div(f"<p>{say(30)}</p>", rng.choice(["ad", "body", "comments", "quote"]))
    wrap = rng.choice(["article", "", "post", "sidebar", "share-story", "search-result"])
    story = f"<article>{story}</article>" if wrap == "article" else div(story, wrap) if wrap else story
    parts = ["<nav><ul>" + "".join(f"<li><a>{say(3)}</a></li>" for _ in range(4)) + "</ul></nav>", div(say(14), "ad"), story, div(f"<p>{say(20)}</p>" * rng.randrange(1, 4), rng.choice(["comments", "related", "col"])), f"<aside>{say(20)}</aside>", f"<footer>{say(12)}</footer>"]
    return "<body>" + "".join(x for x in parts if rng.random() < 0.85 or x is story) + "</body>"


def test_equals_a_restatement(monkeypatch):
    monkeypatch.setattr(html_paths, "WORDS", frozenset(WORDS))
    different = 0
    for seed in range(400):
        page = made_page(seed)
        want = restated(page)
        assert html_paths.main_text(page) == want, page
        with monkeypatch.context() as m:
            m.setattr(html_paths, "CUT", -1.0)
            different += html_paths.main_text(page) != want
    assert different > 300


STORY = "<h1>Head</h1><p>" + "Some words here, and more of them follow. " * 10 + "</p><p>Short.</p><h2>Part</h2><p>" + "Again words, in a line. " * 30 + "</p><ul><li>One item</li><li>Two</li></ul>"


@pytest.mark.parametrize("name", ["post", "reader-content", "post comments-open", "widget-text", "share-story", "search-result", "sidebar", "hidden"])
@pytest.mark.parametrize("shape", ['<div class="{}">{}</div>', '<section id="{}"><div>{}</div></section>', '<form class="{}">{}</form>'])
def test_no_name_drops_the_story(name, shape):
    page = f'<html><head><title>T</title><body><nav><ul><li><a>Home</a><li><a>News</a></ul></nav><div class="ad">Buy it now, please do.</div>{shape.format(name, STORY)}<div class="comments"><p>Great story, thanks a lot!</p></div><footer>&copy; me. All rights.</footer>'
    got = html_paths.main_text(page)
    assert got.startswith("Head\n\nSome words here") and "\n\nShort.\n\nPart\n\n" in got and got.endswith("One item\n\nTwo")


def test_comments_longer_than_the_story_go():
    page = f'<body><main><h1>Top</h1><article><p>{"A line, of the story. " * 20}</p><p>Short.</p></article><section class="comments">{"<p>" + "I think so, too, really. " * 8 + "</p>"}</section></main><aside>More</aside></body>'
    got = html_paths.main_text(page)
    assert got.startswith("Top\n\nA line") and got.endswith("Short.")


def test_the_ratio_decides_without_names():
    page = "<body><div class=x>Menu entry</div><div class=y>" + "<p>A long line, with commas, and stops. It goes on, and on.</p>" * 5 + "</div><div class=z>Imprint</div></body>"
    assert html_paths.main_text(page).count("A long line") == 5 and "Menu" not in html_paths.main_text(page) and "Imprint" not in html_paths.main_text(page)


def test_threshold_acts_on_every_page(monkeypatch):
    pages = pd.read_parquet(f"{DATA}/pages.parquet").html
    before = [html_paths.main_text(p) for p in pages]
    monkeypatch.setattr(html_paths, "CUT", -1.0)
    assert all(html_paths.main_text(p) != b for p, b in zip(pages, before, strict=True))


def test_broken_markup():
    assert html_paths.main_text("<div><![CDATA[hello world") == "hello world"
    assert html_paths.main_text("<p>x <![CDATA[a & b]]> y") == "x a & b y"
    assert html_paths.main_text("<p>a < b and c</p><p>x &lt; y") == "a < b and c\n\nx < y"
    assert html_paths.main_text('<p>one <a href="x>two</a> three</p>') == "one two three"
    assert [html_paths.main_text(x) for x in ("", None, "<", "a</", "<!-- x", "<script>x", "&amp;  b")] == ["", "", "<", "a</", "", "", "& b"]


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "x", "<a x='" * 160_000, "<a x='>'" * 120_000, "<p><button>" + "<b>" * 60_000 + "<div></i>" * 60_000, "<![CDATA[" * 110_000, "</div>" * 160_000, "<p>" + "<span>" * 80_000 + "<div>" * 80_000, "<ul><li>a" * 60_000])
def test_hostile_megabytes_are_linear(page):
    def seconds(text):
        began = time.process_time()
        html_paths.main_text(text)
        return time.process_time() - began

    small, large = seconds(page[: len(page) // 8]), seconds(page)
    assert large < 24 * small + 0.5


def test_odd_rows_and_an_empty_table(spark):
    schema = "html string, url string, page_id long, text string, n_chars string"
    rows = [(None, None, None, "clash", "x"), ("", "u", 1, None, None), ("<p>a b</p>", "u", 2, None, None), ("<p>a b</p>", "u", 2, None, None), ("<p>" + "é " * 500_000, "u", 3, "t", "y")]
    got = [(r.page_id, r.url, len(r.text), r.n_chars) for r in html_paths.extract(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == sorted([(None, None, 0, 0), (1, "u", 0, 0), (2, "u", 3, 3), (2, "u", 3, 3), (3, "u", 999_999, 999_999)], key=str)
    assert html_paths.extract(spark.createDataFrame([], schema)).count() == 0
