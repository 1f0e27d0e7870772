"""Main text of awkward pages: marks that mislead, inline adverts, unclosed elements, very long pages."""

import time

import pytest

from loomspan.llm import html_extract as hx

W = hx.DEFAULT_WEIGHTS
PROSE = "Some long prose, with commas, and a full stop at the end of it, as an article has it."
MORE = "Another paragraph follows the first, again with commas, and it ends with a full stop too."
NAV = "<nav><a href=a>Home</a> <a href=b>News</a></nav>"
FOOT = "<footer>Copyright, all rights reserved.</footer>"


@pytest.mark.parametrize(
    "page",
    [
        "<article class='story tags'>{}</article>",
        "<div class='content with sidebar'>{}</div>",
        "<body class='nav'><div class='has banner'>{}</div></body>",
        "<div class='no-sidebar'>{}</div>",
        "<form action=x><main>{}</main></form>",
        "<div class=overlay><article>{}</article></div>",
        "<div id=pageWrapper><div class='col-md-8 single-post'>{}</div></div>",
        "<div class='category-legal'><article>{}</article></div>",
    ],
)
def test_one_word_does_not_drop_the_text(page):
    body = f"<p>{PROSE}</p><p>{MORE}</p>"
    for around in ("{}", f"{NAV}{{}}{FOOT}", "<header><h1>Site</h1></header>{}" + FOOT):
        assert hx.main_text(around.format(page.format(body)), W) == f"{PROSE}\n{MORE}"


def test_heading_of_the_article_stays():
    page = f"{NAV}<article><div class='post-header'><h1>The title</h1></div><p>{PROSE}</p></article>{FOOT}"
    assert hx.main_text(page, W) == f"The title\n{PROSE}"


@pytest.mark.parametrize("box", ["<div class=comments>{}</div>", "<section id=commentList>{}</section>", "<div class='cookie-notice'>{}</div>", "<div class='site-footer'>{}</div>", "<aside>{}</aside>", "<div role=navigation>{}</div>", "<div class='ad-banner'>{}</div>", "<div class='related-posts'>{}</div>", "<div class=adBox>{}</div>"])
def test_boilerplate_goes_however_long(box):
    much = f"<p>{MORE}</p>" * 12
    page = f"<main><article><p>{PROSE}</p>{box.format(much)}</article></main>{box.format(much)}"
    assert hx.main_text(page, W) == PROSE
    assert hx.main_text(f"<article><p>{PROSE}</p></article>" + box.format(f"<article>{much}</article>"), W) == PROSE


def test_inline_elements_have_cues():
    assert hx.main_text(f"<article><p>{PROSE} <span hidden>SECRET <b>x</b></span>And <span class='ad'>Buy <i>now</i></span>more.</p><p>{MORE}</p></article>", W) == f"{PROSE} And more.\n{MORE}"
    assert hx.main_text(f"<article><p>{PROSE} <span class=ad>Buy</p><p>{MORE}</p></article>", W) == f"{PROSE}\n{MORE}"


@pytest.mark.parametrize("open_", ["<button>Go", "<select><option>A", "<select>", "<object data=x>", "<video src=y>"])
def test_unclosed_controls_do_not_swallow_the_page(open_):
    assert hx.main_text(f"<article><p>{PROSE}</p>{open_}<p>{MORE}</p></article>{FOOT}", W) == f"{PROSE}\n{MORE}"


def test_long_pages_take_time_in_proportion():
    def took(page):
        began = time.process_time()
        hx.main_text(page, W)
        return time.process_time() - began

    snippet = "<div><p>Short one</p><p>Some neutral words, more of them.</p><span>and</span><div>x y z</div></div>"
    assert took(snippet * 12_000) < 12  # over a megabyte without a telling tag
    assert took("<a " * 300_000) < 5 and took("<a href='" * 100_000) < 5 and took("<div>" * 20_000 + "x" + "</p>" * 20_000) < 12
    assert took("<p>text</p>direct<ul><li>a</li>b<li>c</li></ul>" * 10_000) < 12


def test_arcs_do_not_cross():
    page = hx.Page("<div><p>a</p>b<p>c</p><div><p>d</p>e<p>f</p></div><p>g</p></div>h<div>i</div>" * 5)
    arcs = [(a, b) for a, b, _ in hx.smoothness(page) if b > a + 1]
    assert arcs and not any(a < c < b < d for a, b in arcs for c, d in arcs)
