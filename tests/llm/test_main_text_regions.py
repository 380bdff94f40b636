"""Regions chosen by the clustering: made pages of known content, odd shapes, time on malformed pages."""

import random
import time

import pytest

from riskweave.llm import main_text

text = main_text.main_text
WORDS = "river stone lamp window paper garden north early quiet seldom market engine letter winter".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def made_page(rng, article):
    """A page of shuffled boilerplate around known blocks, and these blocks."""
    blocks = [words(rng, 6)] + [words(rng, rng.choice((8, 25, 60, 250))) for _ in range(rng.randint(4, 15))]
    inner = f"<h1>{blocks[0]}</h1>"
    for block in blocks[1:]:
        if rng.random() < 0.2:
            inner += rng.choice(("<aside>{}</aside>", "<div class=ad>{}</div>", "<form><p>{}</p></form>")).format(words(rng, 9))
        inner += rng.choice(("<p>{}</p>", "<p>{}", "<ul><li>{}</li></ul>", "<p><b>{}</b></p>")).format(block)
    menu = "".join(f"<li><a href=/{n}>{words(rng, 2)}</a></li>" for n in range(rng.randint(5, 20)))
    parts = [
        f"<ul>{menu}</ul>", f"<nav><ul>{menu}</ul></nav>", f"<div class='cookie-notice'>{words(rng, 20)}</div>",
        f"<div class=ad>{words(rng, 15)}</div>", f"<footer>{words(rng, 10)}</footer>", f"<script>{words(rng, 50)}</script>",
        f"<section id=comments><article>{words(rng, 30)}</article></section>", f"<div class=site-info>{words(rng, 9)}</div>",
    ]
    rng.shuffle(parts)
    cut = rng.randint(0, len(parts))
    tag = "article" if article else "div"
    page = "".join(parts[:cut]) + f"<{tag}>{inner}</{tag}>" + "".join(parts[cut:])
    return f"<html><head><title>{blocks[0]}</title></head><body>{page}</body></html>", "\n\n".join(blocks)


@pytest.mark.parametrize("article", [True, False])
def test_made_pages(article):
    rng = random.Random(5)
    pages = [made_page(rng, article) for _ in range(300)]
    wrong = [(page, want) for page, want in pages if text(page) != want]
    assert not wrong, (len(wrong), wrong[0])


def test_body_beside_a_teaser():
    body = [f"{n} " + "w " * 199 + "w" for n in range(8)]
    page = "<article><h2>teaser</h2></article><ul><li><a href=/>a</a></li></ul><div>" + "".join(f"<p>{b}</p>" for b in body) + "</div>"
    assert [b for b in text(page).split("\n\n") if b != "teaser"] == body
    # The body beside an article of its own size stays out, the article stays whole.
    long = "".join(f"<p>{b}</p>" for b in body)
    assert text(f"<article>{long}<p>x</p></article><div><p>Some unnamed box of text</p></div>") == "\n\n".join([*body, "x"])


def test_every_page_is_clustered(monkeypatch):
    """The clustering decides on pages with article too: without its upper lines the body is lost."""
    calls = []
    real = main_text.upper_cluster
    monkeypatch.setattr(main_text, "upper_cluster", lambda lines: calls.append(len(lines)) or real(lines))
    body = "".join(f"<p>{'w ' * 200}</p>" for _ in range(3))
    page = f"<article><h2>teaser</h2></article><div>{body}</div>"
    with_ratios = text(page)
    monkeypatch.setattr(main_text, "upper_cluster", lambda lines: [False] * len(lines))
    assert calls == [4] and with_ratios.count("w w") > 0 and text(page) == "teaser"


def test_named_parts_and_forms():
    assert text("<article>A</article><div class=user-comments><article>reply text</article></div>") == "A"
    for name in ("sidebar-box", "share-list", "comment-respond"):
        assert text(f"<article><p>A</p><div class={name}>x</div></article>") == "A"
        assert text(f"<main><p>A</p><div class={name}><p>x</p></div></main>") == "A"
    long = "b" * 200
    for name in ("header", "site-info"):
        assert text(f"<div class={name}>Site of all things</div><div><p>{long}</p><p>{long}</p></div>") == f"{long}\n\n{long}"
    assert text("<article><p>A</p><form><p>Email:</p></form></article>") == "A"
    assert text("<main><form><p>The whole page</p></form></main>") == "The whole page"
    menu = "<ul><li><a href=/1>one</a></li><li><a href=/2>two</a></li></ul>"
    assert text(f"<main><p>Some words.</p>{menu}</main>") == "Some words."
    assert text(f"<main>{menu}</main>") == "one\n\ntwo"
    assert text("<main><p>See</p><ul><li><a href=/1>one</a></li></ul></main>") == "See\n\none"


@pytest.mark.parametrize(
    "shape",
    [
        lambda n: "<b>" * n + "x</i>" * n,
        lambda n: "<p><button>" + "<b>" * n + "<div></div>x" * n,
        lambda n: "<div>x" * n,
        lambda n: "<article>" * n + "x</b>" * n,
        lambda n: "<form>" * n + "<li><p>a" * n,
    ],
)
def test_time_grows_with_the_page(shape):
    def seconds(n):
        page = shape(n)
        best = []
        for _ in range(3):
            start = time.process_time()
            text(page)
            best.append(time.process_time() - start)
        return min(best)

    assert seconds(16_000) < 12 * seconds(4_000) + 0.1
