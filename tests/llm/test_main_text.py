"""Main text of pages: markup in many shapes with a known article."""

import html
import random
import time

import pytest
from nearfield.llm.htmltext import extract, main_text

LONG = " ".join(["Some long enough paragraph of text that says a lot, with many words in it."] * 3)
NEXT = LONG + " And more."
SHORT = "A reader says something about it here."

PAGES = {
    "two articles": (f"<article><p>{LONG}</p></article><article><p>{NEXT}</p></article>", [LONG, NEXT]),
    "article split over containers": (f"<h1>T</h1><div><p>{LONG}</p></div><div><p>{NEXT}</p></div><p>{LONG}</p>", ["T", LONG, NEXT, LONG]),
    "a paragraph beside the container": (f"<div><p>{LONG}</p></div><p>{NEXT}</p>", [LONG, NEXT]),
    "comments as articles": (f"<article><h1>T</h1><p>{LONG}</p></article><div id='comments'><article class='comment-body'><p>{SHORT}</p></article></div>", ["T", LONG]),
    "more comments than article": (f"<div class=post><h1>T</h1><p>{LONG}</p></div><div id='comments'><article><p>{LONG}</p></article><article><p>{NEXT}</p></article></div>", ["T", LONG]),
    "comments never closed": (f"<article><p>{LONG}</p></article><section class=comment-list><article><p>{NEXT}</p></article>", [LONG]),
    "teasers in hidden elements": (f"<main><nav><article><p>{SHORT}</p></article></nav><aside><article>{LONG}</article></aside><template><article>{LONG}</article></template><article><p>{NEXT}</p></article></main>", [NEXT]),
    "article of a marked name": (f"<h1>T</h1><div class='related-work'><p>{LONG}</p><p>{NEXT}</p></div>", ["T", LONG, NEXT]),
    "part of a marked name": (f"<article><h1>T</h1><div class='related-work'><p>{LONG}</p></div></article>", ["T", LONG]),
    "list of related pages": (f"<article><h1>T</h1><p>{LONG}</p></article><div class='related-posts'><p>{SHORT}</p></div>", ["T", LONG]),
    "sidebar never closed": (f"<div class='sidebar'><p>link</p><div class='content'><p>{LONG}</p><p>{NEXT}</p></div>", [LONG, NEXT]),
    "menu never closed": (f"<nav><ul><li><a href=x>a</a><article><p>{LONG}</p></article>", [LONG]),
    "wrapper of a marked name": (f"<div class='layout-with-sidebar'><div class=content><h1>T</h1><p>{LONG}</p></div><div class=sidebar><p>{SHORT}</p></div></div>", ["T", LONG]),
    "headline and lead before the body": (f"<article><h1>H</h1><p>lead</p><div itemprop=articleBody><p>{LONG}</p><p>{NEXT}</p></div></article>", ["H", "lead", LONG, NEXT]),
    "headline above the article": (f"<main><h1>H</h1><article><p>{LONG}</p></article></main>", ["H", LONG]),
    "a short last section": (f"<div><section><p>{LONG * 8}</p></section><section><p>{LONG}</p></section></div>", [LONG * 8, LONG]),
    "links without names": (f"<div><a href=x>Home</a> <a href=y>About</a></div><div><h1>T</h1><p>{LONG}</p><ul><li>a</li><li>b</li></ul></div><div><a href=q>Imprint</a></div>", ["T", LONG, "a", "b"]),
    "an advert in a line": (f"<article><p>x <span class=ad>buy <span>now</span> it</span> y {LONG}</p></article>", [f"x y {LONG}"]),
    "an item that is an advert": (f"<article><ul><li>one<li class=ad>two<li>three</ul><p>{LONG}</p></article>", ["one", "three", LONG]),
    "an unfinished tag": (f"<article><p>{LONG}</p>a < b &amp; c <a href='x", [LONG, "a < b & c"]),
    "nothing": ("<nav>x</nav>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_shapes_of_pages(name):
    page, text = PAGES[name]
    assert main_text(f"<html><head><title>x</title></head><body>{page}</body></html>" if "never" not in name and "unfinished" not in name else f"<body>{page}") == "\n".join(text)


def made(r: random.Random) -> tuple[str, str]:
    """A page and its article."""
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzé&<") for _ in range(r.randint(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    links = lambda n: "".join(f"<li><a href='/{i}'>{html.escape(words(1))}</a></li>" for i in range(n))
    blocks, text = [], []
    for _ in range(r.randint(2, 9)):
        kind, own = r.choice("ppppph2lqt"), words(r.randint(12, 60))
        if kind in "h2":
            own = words(r.randint(1, 5))
            blocks.append(f"<h2>{html.escape(own)}</h2>")
        elif kind == "l":
            items = [words(r.randint(1, 4)) for _ in range(r.randint(1, 5))]
            blocks.append("<ul>" + "".join(f"<li>{html.escape(x)}{r.choice(['', '</li>'])}" for x in items) + "</ul>")
            text += items
            continue
        elif kind == "q":
            blocks.append(f"<blockquote>{html.escape(own)}</blockquote>")
        elif kind == "t":
            blocks.append(f"<p>{html.escape(own[:20])} <em>{html.escape(own[20:])}</em>{r.choice(['', '</p>'])}")
            own = " ".join(f"{own[:20]} {own[20:]}".split())
        else:
            blocks.append(f"<p>{html.escape(own)}{r.choice(['', '</p>'])}")
        text.append(own)
        if r.random() < 0.2:
            blocks.append(r.choice(["<div class='ad-slot'>Buy this now, it is cheap</div>", "<form><input name=q><label>Find</label></form>", "<script>if (a < b) { f('</p>'); }</script>", "<aside><p>An aside on something else that nobody asked for.</p></aside>"]))
    inner, title = "\n ".join(blocks), words(4)
    whole = [title, *text]
    head = f"<h1>{html.escape(title)}</h1>"
    body = r.choice([f"<article>{head}{inner}</article>", f"<main>{head}<article>{inner}</article></main>", f"<main><article>{head}<div itemprop='articleBody'>{inner}</div></article></main>", f"<div class='content'><article class='post'>{head}<section>{inner}</section></article></div>"])
    before = f"<header><a href=/>Site</a><p>The best of pages since {r.randint(1900, 2000)}</p></header><nav><ul>{links(r.randint(2, 9))}</ul></nav><div class='cookie-notice'><p>We use cookies to make this site better for you, see below.</p></div>"
    said = "".join(f"{a}<p>{html.escape(words(r.randint(5, 60)))}</p>{b}" for a, b in [r.choice([("<article class='comment'>", "</article>"), ("<div class='comment-body'>", "</div>"), ("<article>", "</article>"), ("<li>", "</li>")]) for _ in range(r.randint(0, 6))])
    comments = r.choice([f"<section id='comments'>{said}</section>", f"<div class='comments-area'><h2>Comments</h2>{said}</div>", f"<ol class='comment-list'>{said}</ol>", f"<div id='disqus_thread'>{said}</div>"])
    after = f"<aside class='sidebar'><p>{html.escape(words(20))}</p></aside><div class='related-posts'><article><h3>{html.escape(words(3))}</h3><p>{html.escape(words(9))}</p></article></div><footer><p>&copy; all of us</p></footer>"
    return f"<!DOCTYPE html><html><head><title>{html.escape(title)}</title><style>p{{}}</style></head><body>{before}{body}{comments}{after}</body></html>", "\n".join(whole)


def test_generated_pages(spark):
    r = random.Random(11)
    pages = [made(r) for _ in range(1000)]
    assert sum(main_text(page) != text for page, text in pages) == 0
    rows = spark.createDataFrame([(i, "u", page) for i, (page, _) in enumerate(pages)], "page_id long, url string, html string")
    assert {(x["page_id"], x["text"], x["n_chars"]) for x in extract(rows).collect()} == {(i, text, len(text)) for i, (_, text) in enumerate(pages)}


@pytest.mark.parametrize("part", ["<div>x", "<div><p>line of text here</p>", "<", "<a ", "<!--", "</x", "<a b='", "&", "<span class=ad>x", "<div></section>", "<script>", "<p><b><i>t"])
@pytest.mark.parametrize("end", ["", ">"])
def test_time_is_linear(part, end):
    began = time.process_time()
    main_text(part * 50_000 + end)
    assert time.process_time() - began < 12


def test_columns_may_have_any_name(spark):
    rows = spark.createDataFrame([(1, "a", f"<p>{LONG}</p>")], "text long, `a b` string, html string")
    assert [tuple(x) for x in extract(rows, keep=("text", "a b", "html")).collect()] == [(1, "a", f"<p>{LONG}</p>", LONG, len(LONG))]
