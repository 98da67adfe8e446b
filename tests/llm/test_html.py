import html as entities
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from html_heldout import PAGES as HELD_OUT

from cardloom.llm import html_extract as H
from cardloom.llm.html_labelled import PAGES

W = H.learn()


def test_best_run_by_force():
    import random

    rng = random.Random(1)
    for _ in range(300):
        x = [rng.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(rng.randrange(12))]
        a, b = H.best_run(x)
        best = max([0.0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1))])
        assert sum(x[a:b]) == pytest.approx(best)


@pytest.mark.parametrize("page", PAGES[:6])  # the later ones teach words that no other page has
def test_labelled_pages_from_the_others(page):
    weights = H.learn([p for p in PAGES if p != page])
    kept = [w for it in H.items(page) if it.text and it.main for w in it.text.split()]
    got = H.main_text(page, weights).split()
    common = len(set(kept) & set(got))
    assert common >= 0.8 * len(set(kept)) and common >= 0.8 * len(set(got))


CASES = {
    "": "",
    "<p>": "",
    "plain words without any markup": "plain words without any markup",
    "<article><p>One two three four five.<p>Six &amp; seven &eacute;&nbsp;eight<br>nine   ten</article>": "One two three four five.\n\nSix & seven é eight nine ten",
    '<script>var a = "<p>not this text at all, never</p>";</script><main><p>Only this one should be here.</p></main><style>p{}</style>': "Only this one should be here.",
    "<article><p>Before the advert stands this text.</p><div class=ad>Buy now, cheap!</div><p>After it comes more text to read.</p></article><footer>All rights reserved by us</footer>": "Before the advert stands this text.\n\nAfter it comes more text to read.",
    "<nav><a href=/>Home</a></nav><article><h1>Title here</h1><p>Body of the article, long enough.</p></article><div id=comments><p>What a nice article this is, thank you!</p></div>": "Title here\n\nBody of the article, long enough.",
    "<article><p>Never closed <b>and bold text <i>inside": "Never closed and bold text inside",
}


def f1(got, want):
    common = sum((Counter(got) & Counter(want)).values())
    return 2 * common / (len(got) + len(want))


@pytest.mark.parametrize("name", HELD_OUT)
def test_held_out_site_templates(name):
    page, blocks = HELD_OUT[name]
    assert f1(H.main_text(page, W).split(), " ".join(blocks).split()) >= 0.9, H.main_text(page, W)


def test_held_out_mean():
    mean = sum(f1(H.main_text(page, W).split(), " ".join(blocks).split()) for page, blocks in HELD_OUT.values()) / len(HELD_OUT)
    assert mean >= 0.97, mean


def test_table_of_the_driver():
    """The article of every page, whose markup is known: all between <article> tags."""
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    for r in rows:
        inside = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        want = re.sub(r"<br>", " ", inside)
        want = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h\d|li|ul|ol|div|table|tr|blockquote)\b[^>]*>", want)]
        assert H.main_text(r["html"], W) == "\n\n".join(b for b in want if b), r["page_id"]


def test_hints_cover_the_markers():
    for said in re.split(r"\|", "© us|(c) 2020|copyright|all rights reserved|terms of use|terms of service|privacy policy|imprint|legal notice|we use cookies|cookie settings|subscribe|newsletter|sign up|signing up|your inbox|free trial|log in|login|sign in|password|create an account|your account|share this|tweet|follow us|like us|related posts|most read|you may also|you might|read more|recommended|trending|advert|sponsored|promoted|buy now|shop now|order now|special offer|20 % off|leave a comment|comments|reply|replies|posted by|says:|wrote:|skip to|back to top|next page|previous page|filed under|tags:|menu|table of contents|on this page"):
        assert H.SAYS.search(said), said
        assert any(h in said.lower() for h in H.HINTS), said


@pytest.mark.parametrize("html", CASES)
def test_cases(html):
    assert H.main_text(html, W) == CASES[html]


def test_table(spark):
    rows = [(1, "u", "<article><p>Some words are in here.</p></article>", 3), (2, None, None, 4), (2, None, None, 4), (None, "v", "", 5), (3, "w", "<p>" + "long words " * 40000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(H.extract(pages).collect(), key=str)
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.n_chars for r in got}[3] == len("long words " * 40000) - 1
    assert not H.extract(pages.where("false")).count()
