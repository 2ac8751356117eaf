"""Main text: marked articles as the answer, pages without marks, the linear scan against all runs, odd pages."""

from __future__ import annotations

import html as entities
import random
import re

from sowmill.llm.html import extract_text, items, learn_weights, main_text, run_blocks, scored, weigh

PAGE_SCHEMA = "page_id long, url string, html string, text string, n_chars long"


def article_of(page):
    inner = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    plain = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in blocks]
    return "\n\n".join(b for b in plain if b)


def test_articles_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = extract_text(pages, learn_weights(pages)).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert r.text == article_of(r.html)


def test_mark_of_the_article_is_not_read(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    weights = learn_weights(pages)
    for r in pages.limit(40).collect():
        bare = re.sub(r"</?article>", "", r.html)
        assert main_text(bare, weights) == main_text(r.html, weights)


PAGE = """<html><head><title>No title</title><style>p > b {}</style></head><body class="home"><header><h2>Site name of the paper</h2></header>
<nav><a href="/a">Home</a> <a href="/b">All the news</a></nav><div class="cookie-notice"><p>We use cookies on this site to serve you.</p></div>
<div class="post"><h1>The &amp; title &lt;here&gt;</h1><p>First  paragraph\n of the <a href="x">linked</a> story that goes on for quite some words &eacute;&#33;</p><script>var s = "<p>no</p>";</script>
<div class="ad-box">Buy this great thing now for less</div><ul><li>one item of the list</li><li>second item of the list</li></ul><p>Last words of the story are these.<br>And more.</p>
<form><p>Write to us</p><input type="text"></form></div>
<aside><p>Other stories that you may like to read as well</p></aside><section id="comments"><p>I do not agree with one word of this story</p></section>
<footer>All rights are reserved by us</footer></body></html>"""


def test_fixed_weights_on_a_page_without_marks():
    assert main_text(PAGE, {}) == ("The & title <here>\n\nFirst paragraph of the linked story that goes on for quite some words é!\n\none item of the list\n\nsecond item of the list\n\n"
                                   "Last words of the story are these. And more.")


def test_linear_scan_finds_the_best_run():
    draw = random.Random(1)
    for _ in range(150):
        page = "".join(draw.choice(["<p>alpha beta</p>", "<a href='#'>menu</a>", "<hr>", "<div>gamma</div>", "<nav>delta</nav>", "<br>", "word "]) for _ in range(12))
        sequence, blocks = items(page)
        values = [v for _, v in scored(sequence, {})]
        runs = [(sum(values[i:j]), i, j) for i in range(len(values)) for j in range(i + 1, len(values) + 1)]
        best = max((r[0] for r in runs), default=0)
        text = main_text(page, {})
        if best <= 0:
            assert text == ""
            continue
        answers = set()
        for total, i, j in runs:
            if abs(total - best) < 1e-9:
                answers.add("\n\n".join(blocks[b] for b in run_blocks(sequence, i, j) if blocks[b]))
        assert text in answers


def test_weights_have_the_right_signs():
    weights = weigh({"word p": (900, 10), "word li link": (5, 200), "tag p": (90, 5), "tag a": (10, 100), "word boilerplate": (1, 50)})
    assert weights["word p"] > 0 > weights["word li link"] and weights["tag p"] < 0 and weights["tag a"] < 0 and weights["word boilerplate"] <= -1


def test_odd_pages(spark):
    broken = "<p>Open <b>tags <i>and a stray < sign & an ampersand; <a href=\"x>y\">quoted</a> text<p>second block of words <!-- never closed"
    rows = [(1, None, None, "x", 1), (2, "u", "", "x", 1), (3, "u", "plain words without any tag", "x", 1), (4, "u", broken, "x", 1), (None, None, "<p>no id here</p>", "x", 1),
            (5, "u", "<p>same page</p>", "x", 1), (5, "u", "<p>same page</p>", "x", 1), (6, "u", "<nav>menu words only</nav>", "x", 1), (7, "u", "<script>never ends", "x", 1),
            (8, "u", "<p>" + "long text " * 50_000 + "</p>", "x", 1), (9, "u", "<" * 3000 + "a" * 3000, "x", 1)]
    pages = spark.createDataFrame(rows, PAGE_SCHEMA)
    found = extract_text(pages, learn_weights(pages))
    assert found.columns == ["page_id", "url", "text"] and found.count() == len(rows)
    by_id = {r.page_id: r.text for r in found.collect()}
    assert by_id[1] == by_id[2] == by_id[6] == by_id[7] == ""
    assert by_id[3] == "plain words without any tag" and by_id[None] == "no id here" and by_id[5] == "same page"
    assert by_id[4] == "Open tags and a stray < sign & an ampersand; quoted text\n\nsecond block of words"
    assert by_id[8] == ("long text " * 50_000).strip()
    assert extract_text(pages.limit(0), learn_weights(pages.limit(0))).count() == 0


STORY = "<p>First words of the story, which goes on for long enough to be the article.</p><p>More words of the same story stand in a second block.</p>"
WANTED = "First words of the story, which goes on for long enough to be the article.\n\nMore words of the same story stand in a second block."


def test_forms_that_must_not_cost_article_text():
    shell = '<body><nav><a href="/">Home</a> <a href="/x">More</a></nav>{}<footer>All rights reserved by us</footer></body>'
    cases = {
        f'<svg width="1" viewBox="0 0 1 1"/><div>{STORY}</div><svg><title>x</title></svg>': WANTED,
        f'<div>{STORY}<iframe src="a"><p>Words after a frame that never ends are still words of it.</p></div>': f"{WANTED}\n\nWords after a frame that never ends are still words of it.",
        f'<div>{STORY}<p><a href="x">A paragraph that is one link</a></p><p>Some last words follow it here.</p></div>': f"{WANTED}\n\nA paragraph that is one link\n\nSome last words follow it here.",
        f'<div><header><h1>The headline of the post</h1></header>{STORY}</div>': f"The headline of the post\n\n{WANTED}",
        f'<div>{STORY}<section class="related-work"><p>Related work is discussed in this part of the text.</p></section><p>And this ends the article now.</p></div>':
            f"{WANTED}\n\nRelated work is discussed in this part of the text.\n\nAnd this ends the article now.",
        f'<div>{STORY}<pre>x = 1</pre></div>': f"{WANTED}\n\nx = 1",
        f'<div>{STORY}<div class="related-posts"><p>Read these other posts as well, dear reader.</p></div></div>': WANTED,
        f'<div>{STORY}<div class="ad-box">Buy now</div><p>End.</p></div>': None,
    }
    for inner, wanted in cases.items():
        found = main_text(shell.format(inner), {})
        assert "Home" not in found and "rights" not in found and "Buy" not in found
        assert wanted is None or found == wanted, inner
        assert WANTED in found


def test_many_unclosed_elements_take_linear_time():
    import time

    start = time.time()
    for name in ("iframe", "svg", "object", "select", "title", "textarea"):
        assert main_text(f"<div>{STORY}" + f"<{name}>" * 20_000 + "</div>", {}) == WANTED
    assert time.time() - start < 20
