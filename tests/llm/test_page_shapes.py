"""Main text of pages of many shapes: one article, told plainly, in all wrappers with all kinds of parts around it."""

import itertools

import pytest

from tallywing.llm import html_text

TREE = html_text.grow(html_text.LABELLED)
LONG = " ".join(["river", "stone", "walks", "under", "seven", "quiet", "lamps"] * 12)
SECOND = " ".join(["birds", "cross", "the", "narrow", "gorge", "before", "noon"] * 6)
ARTICLE = f"<h1>A title of five words</h1><p>{LONG}</p><p>{SECOND}</p>"
WANT = f"A title of five words\n\n{LONG}\n\n{SECOND}"

MENUS = {
    "nav": '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>', "open nav": '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul>',
    "named menu": '<div id="menu"><a href="/">Home</a> <a href="/a">About us</a></div>', "bare links": '<ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul>', "header": '<header><div>My site of things</div><nav><a href="/">Home</a></nav></header>', "none": "",
}
WRAPPERS = {
    "article": "<article>{}</article>", "main": "<main>{}</main>", "plain": "<div>{}</div>", "no-sidebar": '<div id="page" class="no-sidebar">{}</div>', "has-sidebar": '<div class="content has-sidebar">{}</div>',
    "with-sidebar": '<div class="with-sidebar"><article>{}</article></div>', "layout": '<div class="layout-sidebar-right"><main>{}</main></div>', "ad-free": '<div class="ad-free story">{}</div>', "form": '<form id="aspnetForm" action="x"><div>{}</div></form>',
    "form article": '<form id="aspnetForm"><article>{}</article></form>', "role": '<div class="sidebar-wrapper"><div role="main">{}</div></div>', "camel": '<div class="pageHasSidebar"><section>{}</section></div>', "wrapper": '<div id="banner-page"><div>{}</div></div>',
    "body property": '<div class="widget"><div itemprop="articleBody">{}</div></div>', "in main": "<main><article>{}</article></main>", "header theme": '<div class="header-theme"><article>{}</article></div>',
}
AFTER = {
    "footer": "<footer>&copy; a company of the town 2020</footer>", "comments": f'<section id="comments"><h3>Two comments</h3><article class="comment"><p>{LONG} says one reader</p></article><div class="comment-body">{SECOND}</div></section>',
    "advert": f'<div class="ad">Buy one of our excellent lamps today</div><div class="cookie-notice"><p>{SECOND}</p></div>', "sidebar": '<aside><h4>More to read</h4><a href="/x">Another story about lamps</a></aside><div class="sidebar"><p>Some words on the author of this page</p></div>', "none": "",
}


@pytest.mark.parametrize("menu", MENUS)
@pytest.mark.parametrize("after", AFTER)
def test_article_in_every_wrapper(menu, after):
    for name, wrapper in WRAPPERS.items():
        page = f"<html><head><title>t</title></head><body>{MENUS[menu]}{wrapper.format(ARTICLE)}{AFTER[after]}</body></html>"
        assert html_text.main_text(page, TREE)[0] == WANT, name


def test_parts_inside_of_the_article_go():
    for inner in ('<div class="share-buttons">Share this now</div>', f'<div class="ad"><p>{SECOND}</p></div>', "<aside>An aside of some words</aside>", '<form><label>Your name</label><input></form>', f'<div class="newsletter-signup">{SECOND}</div>', f"<p hidden>{SECOND}</p>"):
        page = f"<article><h1>A title of five words</h1><p>{LONG}</p>{inner}<p>{SECOND}</p></article>"
        assert html_text.main_text(page, TREE)[0] == WANT, inner


def test_a_teaser_is_no_article():
    page = f'<div class="post"><p>{LONG}</p><p>{SECOND}</p></div><article><a href="/next">Our next story on lamps</a></article>'
    assert html_text.main_text(page, TREE)[0] == f"{LONG}\n\n{SECOND}"


def test_lists_of_links_inside_an_article_stay_whole():
    links = "".join(f'<li><a href="/{i}">Entry number {i}</a></li>' for i in range(4))
    page = f"<nav><a href=/>Home</a></nav><article><p>{LONG}</p><ul>{links}</ul><p>{SECOND}</p><ol>{links}</ol></article><footer>x</footer>"
    entries = "\n\n".join(f"Entry number {i}" for i in range(4))
    assert html_text.main_text(page, TREE)[0] == f"{LONG}\n\n{entries}\n\n{SECOND}\n\n{entries}"


def test_title_in_the_article_s_own_header():
    page = f'<header><h1>The site</h1></header><article><header><h1>A title of five words</h1><div class="by">By somebody</div></header><p>{LONG}</p><p>{SECOND}</p></article>'
    assert html_text.main_text(page, TREE)[0] == WANT


def test_comments_longer_than_the_article_go():
    for name, tag in itertools.product(("comments", "comment-list", "disqus_thread"), ("article", "li", "p")):
        comments = "".join(f"<{tag}>{LONG} {i}</{tag}>" for i in range(8))
        for article in (f"<article>{ARTICLE}</article>", f"<div>{ARTICLE}</div>"):
            assert html_text.main_text(f'{article}<div id="{name}">{comments}</div>', TREE)[0] == WANT, (name, tag)


def test_names():
    assert [html_text.hinted(n) for n in ("no-sidebar", "hasSidebar", "adBanner", "sidebarRight", "comments-open", "comment-body", "header", "story", "ad-free story", "menu2", "share-price", "")] == [0, 0, 2, 2, 0, 3, 1, 0, 0, 2, 0, 0]


def test_deep_nesting_takes_linear_time():
    page = '<div class="header">' * 20_000 + f"<p>{LONG}</p>" * 200
    assert LONG in html_text.main_text(page, TREE)[0]
