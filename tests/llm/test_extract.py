from html import escape

import pytest
from hypothesis import given, settings, strategies as st

from playlens.llm import extract as ex

LONG = "the of and is it for the a text that is in the page and was as long as it had to be for the one who is on it"


def page(body):
    return f"<!DOCTYPE html><html><head><title>the title of it</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize("unwanted", [
    "<nav><ul><li><a href='/'>Home</a></li><li>Products</li></ul></nav>", "<header><p>Site of it all</p></header>", f"<footer><p>{LONG}</p></footer>", f"<aside><p>{LONG}</p></aside>",
    f"<div class='ad-box'><p>{LONG}</p></div>", f"<div id=cookie_notice>{LONG}</div>", f"<section class=\"comments\"><article><p>{LONG}</p></article></section>", f"<form><p>{LONG}</p><select><option>x</select></form>",
    f"<!-- {LONG} -->", f"<script>{LONG}</script>", f"<div style='display: none'>{LONG}</div>", f"<div hidden>{LONG}</div>", f"<p class=advert>{LONG}</p>", "<p><a href=x>all of the links in it</a></p>",
])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_unwanted_parts_go(unwanted, tag):
    body = f"{unwanted}<{tag}><h1>A title</h1><p>{LONG}</p><p>Short.</p></{tag}>{unwanted}"
    assert ex.main_text(page(body)) == f"A title\n\n{LONG}\n\nShort."


def test_short_blocks_follow_their_neighbours():
    body = f"<p>Menu</p><p>{LONG}</p><p>Short one.</p><p>{LONG}</p><div><a href=x>one</a> <a href=y>two</a></div><p>x</p><div><a href=z>three</a></div>"
    assert ex.main_text(f"<body>{body}</body>") == f"Menu\n\n{LONG}\n\nShort one.\n\n{LONG}"


def test_references_and_white_space():
    html = page(f"<article><p>{LONG}\n  a &amp;amp; b&nbsp;&lt;b&gt; &copy &am;<br>c<b> d</b></p></article>")
    assert ex.main_text(html) == LONG + " a &amp; b <b> © &am; c d"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", "<p"), (4, "w", "<article>" + f"<p>{LONG}</p>" * 3000), (5, "x", "plain text"), (6, "y", "<!-- open"), (7, "z", "<script>never closed")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = ex.extracted(table).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[4] == "\n\n".join([LONG] * 3000)
    assert ex.extracted(table.filter("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='x'>", "</div>", "<a href=\"", "<b", ">", "text the of ", "&am", "<!--", "-->", "<li>", "<script>", "</script>", "<td>", "<nav>", "</nav>", "'", '"']), max_size=40))
def test_any_markup_is_read(parts):
    assert isinstance(ex.main_text("".join(parts)), str)


@settings(max_examples=50, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=60))
def test_article_text_comes_back(text):
    own = " ".join(f"{LONG} {text}".split())
    assert ex.main_text(f"<article><p>{escape(f'{LONG} {text}')}</p></article>") == own


RUSSIAN = "Вчера вечером жители небольшого города собрались на площади, чтобы обсудить строительство нового моста через реку."
POLISH = "Wczoraj wieczorem mieszkańcy niewielkiego miasta zebrali się na rynku, żeby omówić budowę nowego mostu przez rzekę."
CHINESE = "昨天晚上，小城的居民聚集在广场上，讨论在河上修建一座新桥的计划，许多人发表了意见。"


@pytest.mark.parametrize("own", [RUSSIAN, POLISH, CHINESE])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_languages_without_a_stop_word_list(own, tag):
    menu = "<ul><li><a href=x>Strona</a></li><li><a href=y>Kontakt</a></li></ul>"
    body = f"<nav>{menu}</nav><{tag}><p>{own}</p><p>{own}</p><p>{own}</p></{tag}><div>{menu}</div><footer><p>{own}</p></footer>"
    assert ex.main_text(page(body)) == "\n\n".join([own] * 3)


@pytest.mark.parametrize("own", [RUSSIAN, CHINESE])
def test_other_scripts_beside_a_text_with_stop_words(own):
    assert ex.main_text(page(f"<div><p>{LONG}</p><p>{own}</p></div>")) == f"{LONG}\n\n{own}"


def test_keywords_without_sentences_stay_out_beside_a_text():
    words = "shoes boots sandals sneakers slippers trainers loafers moccasins espadrilles brogues pumps wedges"
    assert ex.main_text(page(f"<article><p>{LONG}</p></article><div>{words}</div>")) == LONG


def test_a_paragraph_stays_beside_linked_ones():
    code = "def mean(values): total = sum(values); count = len(values); return total / count if count else None"
    body = f"<article><p>{LONG}</p><p><a href=x>all of the links in it</a></p><pre>{code}</pre></article>"
    assert ex.main_text(page(body)) == f"{LONG}\n\n{code}"


def test_layout_words_and_headers_of_articles_are_no_marks():
    body = f"<div class='page has-sidebar'><article><div class='entry-header'><h1>A title</h1></div><p>{LONG}</p></article><div class='sidebar'><p>{LONG}</p></div></div>"
    assert ex.main_text(page(body)) == f"A title\n\n{LONG}"


@pytest.mark.parametrize("name", ["Comments", "userComments", "AdBox", "site-footer", "NAV"])
def test_capitals_in_names(name):
    assert ex.main_text(page(f"<article><p>{LONG}</p></article><div class='{name}'><p>{LONG}</p></div>")) == LONG
