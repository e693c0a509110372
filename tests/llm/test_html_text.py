import random
import re
from html import escape, unescape

import pytest
from pyspark.sql import functions as F

from claimlens.llm import html_text
from claimlens.llm.common import read_table
from claimlens.llm.html_text import blocks_of, extract, main_text

LONG = "It is the first of the long sentences that were in this article, and they have a lot of words in it."


def test_page_with_everything():
    page = f"""<!DOCTYPE html><html><head><title>T</title><meta charset="utf-8"></head><body class="home sidebar-right">
    <header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">{LONG}</div>
    <div class="ad">{LONG}</div><div class="layout"><main><article><h1>Head &amp; tail</h1><p>{LONG}<p>Short.
    <p>A <b>bo</b>ld <a href="x">link</a>&nbsp;&#65;&#x42;&eacute;</p><!-- no --><script>var t="</p><p>no";</script><style>p{{}}</style>
    <form><label>Mail</label><input name="a"><button>Go</button></form><div class='sponsored promo'>{LONG}</div>
    <blockquote>Said "so"</blockquote><ul><li>one</li><li>two</li></ul><aside>{LONG}</aside>
    <section id="comments"><p>{LONG}</p></section><p>The end</p></article></main><div class="sidebar">{LONG}</div></div>
    <footer>&copy; 2020</footer></body></html>"""
    assert main_text(page) == f'Head & tail {LONG} Short. A bold link ABé Said "so" one two The end'


def test_page_without_article():
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><p>Title</p><p>{LONG}</p><p>Ok.</p><p>{LONG}</p><div>" + "zzxx qqyy " * 20 + "</div><p>Odd</p></body>"
    assert main_text(page) == f"Title {LONG} Ok. {LONG}"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a b"), ("<article>Ti.</article><footer>f</footer>", "Ti."), ("<article", ""),
    ("<article>1 < 2 & 3 > 2</article>", "1 < 2 & 3 > 2"), ("<article><p title='a>b'>x</p><p>y", "x y"), ("<div><a href='/'>all link</a></div>", ""),
    ("<article><p>unclosed <b>bold<br><p>next</article><nav>n</nav>", "unclosed bold next"), ("<nav>menu</nav></div></nav><p>after</p>", "after"),
    ("<script>never closed <p>x", ""), ("<article>a<!-- open", "a"), ("<article><div hidden>no</div><div style='display:none'>no</div>yes</article>", "yes"),
    ("<article>&lt;p&gt; &amp;amp;   x</article>", "<p> &amp; x"), ("<article><div class='header-image'>kept</div></article>", "kept"),
])
def test_small_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("start,end", [
    ('<body style="overflow-x:hidden"><p>', "</body>"), ('<main class="overflow-hidden"><p>', "</main>"), ('<div style="overflow:hidden"><p>', "</div>"),
    ('<article class="post tag-politics"><p>', "</article>"), ('<main class="site-main no-sidebar"><p>', "</main>"),
    ('<article class="entry has-comments"><p>', "</article>"), ('<article class="widget"><p>', "</article>"), ('<div class="post tag-x has-comments"><p>', "</div>"),
    ('<div class="layout sidebar-right"><article><p>', "</article></div>"), ('<form id="aspnetForm"><div><p>', "</div></form>"),
    ('<div data-x="hidden" aria-label="hidden gems"><p>', "</div>"), ("<div class='widget'><p>", "</p></div><div class='ad'><p>Buy it.</p></div>"),
])
def test_names_do_not_throw_an_article_away(start, end):
    assert main_text(start + LONG + end) == LONG


@pytest.mark.parametrize("tag", ['div hidden', 'div class="x" hidden=""', 'div style="color:red; visibility: hidden"', "div style='display:none'", 'div class="comments"', "nav"])
def test_hidden_and_named_parts_stay_out(tag):
    assert main_text(f"<article><p>{LONG}</p><{tag}>{LONG}</{tag.split()[0]}><p>The end</p></article>") == f"{LONG} The end"


def test_related_cards_do_not_replace_the_text():
    card = "<article><a href=1>Another story to be read by all of the readers that are here on this site today</a><p>More.</p></article>"
    got = main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p></div>{card * 3}</body>")
    assert got.startswith(f"{LONG} {LONG}") and "Another" not in got


def test_stop_words_decide_outside_an_article_only():
    junk = "Zzxx qqyy wwkk " * 30
    assert main_text(f"<article><p>{LONG}</p><p>{junk}</p><p>{LONG}</p></article>") == f"{LONG} {junk.strip()} {LONG}"
    assert main_text(f"<div><p>{LONG}</p><p>{junk}</p><p>{LONG}</p></div>") == f"{LONG} {LONG}"


@pytest.mark.parametrize("box", ['div class="comments"', 'section id="comments"', 'div class="comment-list"', 'div class="sidebar"', 'div id="cookie-banner"', 'div class="related-posts"', "form", 'div class="ad"'])
@pytest.mark.parametrize("inside", [True, False])
def test_boxes_never_win_by_size(box, inside):
    many, end = f"<{box}>" + f"<p>{LONG} Indeed.</p>" * 12 + f"</{box.split()[0]}>", "</article>"
    page = f"<body><article><p>{LONG}</p><p>{LONG}</p>" + (many + end if inside else end + many) + "</body>"
    assert main_text(page) == f"{LONG} {LONG}"
    page = page.replace("<article>", "<div class='post'>").replace("</article>", "</div>")
    assert main_text(page) == f"{LONG} {LONG}"


def test_comments_marked_up_as_articles():
    many = '<div id="comments"><ol>' + f'<li class="comment"><article class="comment-body"><p>{LONG}</p></article></li>' * 9 + "</ol></div>"
    assert main_text(f"<main><article><p>{LONG}</p></article>{many}</main>") == LONG


@pytest.mark.parametrize("page", [
    f'<body><a name="top"><p>{LONG}</p><p>{LONG}</p></body>', f'<body><a href="#x"><p>{LONG}</p><p>{LONG}</p></body>',
    f'<body><div><a href="#x">Home</div><p>{LONG}</p><p>{LONG}</p></body>', f'<body><p><a href="1">one<a href="2">two</a></p><p>{LONG}</p><p>{LONG}</p></body>',
    f"<body><a href='1'>x</a></a></a><p>{LONG}</p><p>{LONG}</p></body>",
])
def test_unclosed_links_do_not_empty_a_page(page):
    assert main_text(page).endswith(f"{LONG} {LONG}")


def test_closed_links_around_blocks_count():
    assert main_text(f"<body><p>{LONG}</p><p>{LONG}</p><a href='1'><div>{LONG}</div></a></body>") == f"{LONG} {LONG}"


def test_code_and_tables_of_an_article_stay():
    code = "for (int i = 0; i < n; ++i) { total += weights[i] * values[i]; } // " + "x = y + z; " * 40
    row = "<tr><td>" + "</td><td>".join(["Alpha 12.5 kg", "Beta 13.75 kg " * 30, "Gamma"]) + "</td></tr>"
    got = main_text(f"<article><p>{LONG}</p><pre><code>{escape(code)}</code></pre><table><tr><th>Name</th></tr>{row * 3}</table><p>{LONG}</p></article>")
    assert " ".join(code.split()) in got and got.count("Beta 13.75 kg") == 90 and "Gamma" in got and got.count(LONG) == 2


def test_layout_around_an_article_beside_other_text():
    tagline = "This is the site of all of the stories that were told in this town, and it is as old as the town."
    page = f'<body><p>{tagline}</p><div class="layout sidebar-right"><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><div class="sidebar"><p>{LONG} No.</p></div></div></body>'
    assert LONG in main_text(page) and "No." not in main_text(page)


def plain_passes(blocks, words_of):
    """Both passes written out: blocks (text, linked, part) without names, one language."""
    labels = []
    for text, linked, part in blocks:
        stop = len([w for w in re.findall(r"[^\W\d_]+", text.lower()) if w in words_of]) / max(1, len(re.findall(r"[^\W\d_]+", text)))
        if linked > 0.5 * len(text):
            labels.append(None if part == "article" else False)
        elif len(text) < 70:
            labels.append(None)
        elif part == "article":
            labels.append(True if stop >= 0.2 else None)
        else:
            long = len(text) >= 140 and linked <= 0.2 * len(text)
            labels.append(True if stop >= (0.2 if long else 0.3) else None if stop >= 0.2 else False)
    out = list(labels)
    for k, label in enumerate(labels):
        if label is None:
            same = [(abs(j - k), not labels[j]) for j in range(len(blocks)) if blocks[j][2] == blocks[k][2] and labels[j] is not None]
            out[k] = not min(same)[1] if same else blocks[k][2] == "article" or not any(b[2] == "article" for b in blocks) and blocks[k][1] <= 0.5 * len(blocks[k][0])
    return [t for (t, _, _), keep in zip(blocks, out) if keep]


def test_two_passes_like_brute_force():
    rng = random.Random(9)
    stop = html_text.STOP_WORDS["en"]
    for _ in range(400):
        blocks = []
        for _ in range(rng.randint(1, 25)):
            n, share = rng.choice([1, 3, 9, 14, 20, 40, 80]), rng.choice([0.0, 0.15, 0.22, 0.27, 0.35, 0.5])
            text = " ".join(rng.choice(sorted(stop)) if rng.random() < share else rng.choice(["lorem", "qqyy", "stories", "hill"]) for _ in range(n))
            blocks.append((text, rng.choice([0, 0, 0, len(text) // 5, len(text) // 2 + 1, len(text)]), rng.choice(["article", "page", "page"])))
        found = [html_text.Block(*b) for b in blocks]
        en = html_text.LANGUAGES.index("en")
        keep = html_text.second_pass(found, [html_text.first_pass(b, en) for b in found])
        assert [b.text for b, k in zip(found, keep) if k] == plain_passes(blocks, stop)


@pytest.mark.parametrize("lang", ["pl", "hu", "en", ""])
@pytest.mark.parametrize("text", [
    "W tym roku rząd przedstawił nowy plan rozwoju kolei, który ma objąć całą Polskę, i zapowiedział, że budowa nowych linii zacznie się jeszcze przed końcem lata.",
    "Regeringen presenterade en ny plan för järnvägen som ska omfatta hela landet, och sade att bygget av de nya linjerna börjar redan före sommarens slut.",
    "Правительство представило новый план развития железных дорог, который охватит всю страну, и сообщило, что строительство новых линий начнётся уже до конца лета.",
    "A kormány új tervet mutatott be a vasút fejlesztésére, amely az egész országra kiterjed, és bejelentette, hogy az új vonalak építése már a nyár vége előtt megkezdődik.",
    "政府公布了新的铁路发展计划，该计划将覆盖全国，并宣布新线路的建设将在夏季结束之前开始。" * 4,
])
def test_languages_beside_the_given_ones(lang, text):
    menu = "<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div>"
    assert main_text(f'<html lang="{lang}"><body>{menu}<div><p>{text}</p></div>{menu}</body></html>') == text


def test_blocks_survive_any_markup():
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<article>", "</article>", "<nav>", "</nav>", "<a href='", "'>", '"', "<", ">", "</", "x y", "&amp;", "&#", "<!--", "-->", "<script>", "</script>", "<div class=ad>", "</div>"]
    for _ in range(3000):
        for block in blocks_of("".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))):
            assert block.text and block.text == " ".join(block.text.split())


def test_given_pages(spark):
    pages = read_table(spark, "/root/testdata/sf0.001", "pages")
    for r in extract(pages.withColumn("n_chars", F.lit(1))).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        assert r.text == " ".join(unescape(re.sub("</?(?:p|h1)>|<br>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert r.n_chars == len(r.text)


def test_table(spark):
    rows = [(1, "u", "<p>" + escape(LONG) + "</p>", "own"), (2, None, None, None), (None, "u", "", "x"), (1, "u", "<p>" + escape(LONG) + "</p>", "own")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in extract(df).collect())
    assert got == [("1", LONG, len(LONG))] * 2 + [("2", "", 0), ("None", "", 0)]
    assert extract(df.limit(0)).count() == 0
    assert len(main_text("<article>" + "<p>" + LONG + "</p>" * 2 + ("<p>" + LONG) * 20_000)) > 20_000 * len(LONG)
