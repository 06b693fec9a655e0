import random
import time

import numpy as np
import pytest

from rolesift.llm import extract

from .conftest import prose


def page(k, rng):
    paragraphs = [prose(rng, rng.randint(15, 60)).capitalize() + "." for _ in range(rng.randint(2, 6))]
    body = "".join(f"<p><b>{p}<br><p>" if j % 3 == 2 else f"<p>{p} &amp;\n  <i>so</i>on</p>" for j, p in enumerate(paragraphs))
    text = " ".join(p if j % 3 == 2 else f"{p} & soon" for j, p in enumerate(paragraphs))
    links = "".join(f'<li><a href="/{j}">{prose(rng, 1)}</a></li>' for j in range(6))
    whole = (
        f'<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{links}</ul></nav><!-- x -->'
        f'<div class="ad">{prose(rng, 12)}.</div><article><h1>Head {k}</h1>{body}</article><div class="comments"><p>{prose(rng, 30)}</p></div><footer>&copy; {prose(rng, 9)}</footer></body></html>'
    )
    return whole, f"Head {k} {text}"


def test_extracts_articles(spark):
    rng = random.Random(1)
    made = [page(k, rng) for k in range(60)]
    rows = [(k, f"u{k}", h, "x", 2) for k, (h, _) in enumerate(made)]
    rows += [(100, None, None, "x", 2), (101, "u", "", "x", 2), (102, "u", "<p>" * 3000 + "deep", "x", 2), (103, "u", "<<a <b c='>' \"<script>x", "x", 2)]
    pages = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, text string, label int").repartition(3)
    forest = extract.train(pages, n_trees=8, depth=4)
    found = extract.extract(pages, forest).collect()
    assert len(found) == len(rows) + 1
    got = {r.page_id: r for r in found}
    assert sum(got[k].text == t for k, (_, t) in enumerate(made)) >= 58
    assert got[100].text == got[101].text == "" and got[100].n_chars == 0
    assert all(r.n_chars == len(r.text) for r in found)


def test_frames_are_dropped_under_other_names(spark):
    rng = random.Random(7)
    rows = [(k, "u", page(k, rng)[0]) for k in range(60)]
    forest = extract.train(spark.createDataFrame(rows, "page_id long, url string, html string"))
    hits = 0
    for k in range(40):
        paragraphs = [prose(rng, rng.randint(15, 60)) for _ in range(rng.randint(2, 6))]
        text = extract.made_page(paragraphs, [prose(rng, 200)], rng)
        nodes = extract.parse(text)
        kept = np.array([j == 0 or "data-keep" in x.attrs for j, x in enumerate(nodes)])
        want = set(extract.rendered(nodes, kept).split())
        got = set(extract.text_of([text.replace(" data-keep", "")], forest)[0].split())
        hits += len(want & got) >= 0.95 * max(len(want), len(got))
    assert hits >= 32, (hits, len(want), len(got), len(forest))


@pytest.mark.parametrize(
    "html",
    [
        '<article><svg-icon name="x"></svg-icon><p>All of the article.</p></article>',
        '<article><select-box></select-box><template-card /><p>All of the article.</p></article>',
        '<article><svg viewBox="0 0 1 1"/><p>All of the article.</p></article>',
        '<article><svg/><svg title="a>b" /><p>All of the article.</p></article><svg></svg>',
        "<article><svg><title>no</title></svg><p>All of the article.</p></article>",
        "<html><head><title>T <b>no</b></title><meta charset=utf-8><script>no</script><article><p>All of the article.</p></article>",
        "<head><title>T</title>\n<p>All of the article.</p>",
        "<head><title>T</title>All of <i>the</i> article.",
        "<head><title>T</title></head><body><p>All of the article.</p></body>",
    ],
)
def test_pages_that_leave_out_tags_keep_their_text(html):
    assert extract.text_of([html], None) == ["All of the article."]


@pytest.mark.parametrize("page", ["<b>" * 70_000 + "<div></div>" * 70_000, "<div>" * 100_000 + "</x>" * 110_000, "<div>" * 60_000 + "<li>" * 100_000, "<li><p>" * 120_000])
def test_deep_pages_take_linear_time(page):
    start = time.perf_counter()
    assert len(extract.parse(page)) > 90_000 and time.perf_counter() - start < 5


@pytest.mark.parametrize("seed", range(10))
def test_decoding_has_no_contradictions(seed):
    rng = random.Random(seed)
    nodes = [extract.Node("div", "", -1, 0)] + [extract.Node("div", "", rng.randrange(k), 1) for k in range(1, 200)]
    p = np.array([rng.uniform(0.02, 0.98) for _ in nodes])
    kept = extract.decode(nodes, p)
    for k, x in enumerate(nodes):
        path = [k]
        while nodes[path[-1]].parent >= 0:
            path.append(nodes[path[-1]].parent)
        assert kept[k] == all(p[j] > 0.5 for j in path[:-1])


def test_long_articles_are_kept_whole(spark):
    rng = random.Random(3)
    rows = [(k, "u", page(k, rng)[0]) for k in range(40)]
    body = "".join(f"<p>{prose(rng, 20)} <b>{prose(rng, 3)}</b></p>" for _ in range(500))
    rows.append((99, "u", f"<html><body><nav><ul><li><a href='/'>{prose(rng, 2)}</a></li></ul></nav><article>{body}</article></body></html>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.extract(pages, extract.train(pages, n_trees=8)).collect()}
    assert len(got[99].split()) == 500 * 23


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract.extract(none, extract.train(none)).count() == 0
