"""Pages whose article must not be lost."""

from tessera.llm.html_main import main_text

ARTICLE = "".join(f"<p>Paragraph {k} of the article, with commas, and enough words to count as prose, as articles have.</p>" for k in range(6))
PLAIN = " ".join(f"Paragraph {k} of the article, with commas, and enough words to count as prose, as articles have." for k in range(6))


def test_open_head_ends_with_body_content_or_text():
    assert main_text(f"<html><head><title>T</title><meta charset=utf-8><body><div>{ARTICLE}</div></body></html>") == PLAIN
    assert main_text(f"<head><title>T</title><div>{ARTICLE}</div>") == PLAIN
    assert main_text("<head><title>T</title>Text alone") == "Text alone"


def test_unwanted_name_parts_do_not_cut_the_article():
    links = "<div class='sidebar'><a href='/x'>Other page</a></div>"
    for names in ("class='content has-sidebar'", "id='post-social'", "class='has-sidebar'"):
        assert main_text(f"<html><head></head><body><div {names}>{ARTICLE}</div>{links}</body></html>") == PLAIN


def test_small_unwanted_parts_are_cut():
    junk = "<div class='post-comments'><p>Nice post, thanks.</p></div><div class='share'>Share this</div>"
    assert main_text(f"<body><article>{ARTICLE}{junk}</article></body>") == PLAIN


def test_sections_named_by_their_topic_stay():
    sections = "".join(f"<{t} {k}='{name}'><h3>{name}</h3><p>What it says of {name}.</p></{t}>" for t, k, name in (("section", "class", "related-work"), ("div", "class", "social-history"), ("div", "class", "rail-transport"), ("section", "id", "cookie-recipes"), ("div", "id", "Footer_design"), ("div", "class", "adLib")))
    want = " ".join(f"{n} What it says of {n}." for n in ("related-work", "social-history", "rail-transport", "cookie-recipes", "Footer_design", "adLib"))
    assert main_text(f"<body><article>{ARTICLE}{sections}</article><footer>f</footer></body>") == f"{PLAIN} {want}"


def test_chrome_inside_the_article_goes():
    for name in ("share-buttons", "related-posts", "ad", "ad-slot-2", "newsletter-cta", "commentList", "reader-comments", "cookie-banner", "site-footer", "promo_box", "sidebarLeft", "notice"):
        assert main_text(f"<body><article>{ARTICLE}<div class='x1 {name}'><p>Not of it.</p></div></article></body>") == PLAIN, name
    links = "<div class='social-networks'><a href=a>One</a> <a href=b>Two</a></div>"
    assert main_text(f"<body><article>{ARTICLE}{links}</article></body>") == PLAIN


def test_fallbacks_and_examples_stay():
    assert main_text(f"<article>{ARTICLE}<noscript><p>Seen <b>without</b> scripts.</p></noscript><xmp><b>x</b> &amp;</xmp><noembed>No <i>embed</i>.</noembed></article>") == f"{PLAIN} Seen without scripts. <b>x</b> &amp; No embed."


def test_names_of_headings_paragraphs_and_inline_elements_cut_nothing():
    page = f'<article><h2 id="Social_structure">Society</h2>{ARTICLE}<p id="side-effects">Side effects, too.</p><p>A <span class="ad">word</span>.</p></article>'
    assert main_text(page) == f"Society {PLAIN} Side effects, too. A word."


def test_formulas_and_fallbacks_stay():
    assert main_text("<article><p>Let <math><mi>x</mi></math> be, so, <object data=q>fall back</object></p></article>") == "Let x be, so, fall back"


def test_long_and_deep_pages_take_linear_time():
    import time

    n = 20_000
    pages = ["<div>" * n + "<p>a, b" * n, "<i><div>" + "<b>" * n + "</i>" * n + "<h1>x</h1>" * n, "<header>" * n, "<a href='" * n, "<![CDATA[>" * n, "<table>" + "<tr><td>x<li>" * n, "<textarea>" * n]
    began = time.time()
    for page in pages:
        main_text(page)
    assert time.time() - began < 60


def test_ties_go_to_the_first_container():
    assert main_text("<section><p>one, two</p></section><footer>x</footer><div><p>six, ten</p></div>").startswith("one, two")
