import html
import random
import re

import pytest

from lodestone.llm import wrappers
from lodestone.llm.wrappers import aligned, host_wrappers, loaded, main_texts, regex, skeleton, tree

SCHEMA = "page_id long, url string, html string, text string"


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h, "own") for i, u, h in rows], SCHEMA).repartition(4)
    return sorted(((r.page_id, r.url, r.text, r.n_chars) for r in main_texts(df).collect()), key=str)


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefgé&<") for _ in range(draw.randint(2, 9))) for _ in range(n))


def article(draw):
    return [words(draw, draw.randint(4, 40)) for _ in range(draw.randint(1, 7))]


def page(draw, host, blocks, style):
    """One page of a host's template around ``blocks``."""
    w = lambda n: html.escape(words(draw, n))
    body = [html.escape(b).replace(" ", draw.choice([" ", "\n ", "&#32;"]), 1) for b in blocks]
    menu = "".join(f'<li><a href="/{w(1)}">{w(1)}</a></li>' for _ in range(draw.randint(2, 6)))
    comments = "".join(f"<div class='comment'><p>{w(9)}</p></div>" for _ in range(draw.randint(0, 3)))
    if style == 0:
        paragraphs = "".join(draw.choice([f"<p>{b}</p>", f"<P>{b}", f"<p><b>{b}</b><br></p>"]) for b in body[1:])
        return (f"<html><head><title>{w(3)}</title><script>var x='</p>';</script><style>p{{}}</style></head><body><header>{w(4)}</header><nav><ul>{menu}</ul></nav>"
                f"<!-- <p>{w(3)}</p> --><div class='ad'>{w(5)}</div><article><h1>{body[0]}</h1>{paragraphs}</article><section id=comments>{comments}</section>"
                f"<footer>{w(5)}</footer></body></html>")
    if style == 1:
        paragraphs = "".join(f"<div>{b}</div>" for b in body)
        return (f"<body><div id='top-menu'>{menu}</div><div class=\"cookie-notice\"><p>{w(8)}</p></div><main><div class='post-content'>{paragraphs}"
                f"<form><p>{w(2)}</p><input value=x><button>{w(1)}</button></form></div>{comments}</main><div role=complementary><p>{w(20)}</p></div>")
    if style == 2:  # names tell nothing
        paragraphs = "".join(f"<p>{b}</p>" for b in body)
        links = "".join(f"<a href=#>{w(2)}</a> " for _ in range(6))
        return f"<table><tr><td>{links}</td></tr><tr><td><div>{paragraphs}</div></td></tr><tr><td><a href=#>{w(1)}</a></td></tr></table>"
    quote = "".join(draw.choice([f"<p>{b}</p>", f"<blockquote>{b}</blockquote>", f"<ul><li>{b}</li></ul>"]) for b in body)
    return f"<nav>{menu}</nav><div class='article-body'>{quote}<div class='share-bar'><a>{w(1)}</a></div></div><aside><h3>{w(2)}</h3><p>{w(30)}</p></aside>"


@pytest.mark.parametrize("fan_in", [64, 2])
def test_planted_articles_come_back_whole(spark, monkeypatch, fan_in):
    monkeypatch.setattr(wrappers, "FAN_IN", fan_in)
    draw = random.Random(8)
    rows, want = [], []
    for i in range(160):
        style = draw.randrange(4)
        site = f"{draw.choice(['www', 'm'])}.s{style}.example.org"
        blocks = article(draw)
        url = draw.choice([f"https://{site}/p/{i}", f"http://{site.upper()}:80/p?{i}"])
        rows.append((i, url, page(draw, site, blocks, style)))
        text = "\n".join(" ".join(b.split()) for b in blocks)
        want.append((i, url, text, len(text)))
    assert run(spark, rows) == sorted(want, key=str)


def test_nulls_empty_repeated_and_broken_pages(spark):
    long = "<p>" + "word " * 200_000 + "</p>"
    deep = "<div>" * 5000 + "inner" + "</div>" * 5000
    rows = [(1, None, None), (2, "http://a.org/", ""), (None, "http://a.org/", "<article><p>x</p></article>"), (4, "no url", "plain &amp; text < 3"),
            (5, "http://b.org", "<article>" + long + "</article>"), (5, "http://b.org", "<article>" + long + "</article>"),
            (6, "http://c.org", deep), (7, "http://d.org", "<nav><li>menu</nav>"), (8, "http://e.org", "<article><p>cut of<p class='x"),
            (9, "http://f.org", "<script>never closed <article><p>x</p>"), (10, "http://g.org", '<article a="x <p>one</p>\n\n<p>two"</p></article>')]
    got = {}
    for i, _, text, n in run(spark, rows):
        got.setdefault(i, []).append(text)
        assert n == len(text)
    assert got[1] == got[2] == got[7] == got[9] == [""] and got[None] == ["x"] and got[4] == ["plain & text < 3"]
    assert got[5] == [" ".join(["word"] * 200_000)] * 2 and got[6] == ["inner"] and got[8] == ["cut of"]
    assert "one" in got[10][0] and got[10][0].endswith('two"')
    assert run(spark, []) == []


def test_expression_holds_every_page():
    """Alignment in any order: optional, repeated and group items, one item per kind."""
    pages = ["<div><h1>t</h1><p>a</p></div>", "<div><h1>t</h1><p>a</p><p>b</p></div>", "<div><p>a</p><ul><li>x</li></ul><p>b</p></div>", "<div><h2>s</h2><p>a</p><h2>s</h2><p>b</p></div>"]
    found = [skeleton(tree(p)) for p in pages]
    assert regex(found[1]) == "<div><h1>TEXT</h1>(<p>TEXT</p>)+</div>"
    assert regex(found[3]) == "<div>(<h2>TEXT</h2><p>TEXT</p>)+</div>"
    assert regex(found[2]) == "<div>(<p>TEXT</p>(<ul><li>TEXT</li></ul>)?)+</div>"
    for seed in range(20):
        order = random.Random(seed).sample(found, 4)
        whole = order[0]
        for other in order[1:]:
            whole = aligned(whole, other)
        pattern = re.compile(re.sub(r"TEXT", "#", regex(whole)))
        for p in pages:
            assert pattern.fullmatch(re.sub(r">[a-z]+<", ">#<", p)), (regex(whole), p)


def test_host_wrappers(spark):
    df = spark.createDataFrame([("http://a.org/1", "<p>x</p>"), ("http://A.org/2", "<p>x</p><p>y</p><hr><footer>z</footer>")], "url string, html string")
    assert [tuple(r) for r in host_wrappers(df).collect()] == [("a.org", "(<p>TEXT</p>)+(<footer>TEXT</footer>)?")]
    assert loaded("[]") == ()
