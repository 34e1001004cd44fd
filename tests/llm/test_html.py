"""Alignment of long lists and malformed markup."""

import random
import time

import numpy as np
import pytest

from curator.llm import html_extract as H


def _text(page):
    return "|".join(b[3] for b in H.blocks_of(H.parse(page)))


@pytest.mark.parametrize("cells", [1, 30, 4_000_000])
def test_rows_give_the_heaviest_alignment(monkeypatch, cells):
    monkeypatch.setattr(H, "_CELLS", cells)
    rng = np.random.default_rng(cells)
    for _ in range(150):
        n, m, p, q = rng.integers(1, 12, 4)
        rows, columns, weights = rng.integers(0, p, n), rng.integers(0, q, m), rng.integers(0, 4, (p, q))
        best = np.zeros((n + 1, m + 1), int)
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i, j] = max(best[i + 1, j], best[i, j + 1], best[i + 1, j + 1] + weights[rows[i], columns[j]])
        got = H.aligned(rows, columns, weights)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        assert all(weights[rows[i], columns[j]] for i, j in got)
        assert sum(weights[rows[i], columns[j]] for i, j in got) == best[0, 0]


def test_long_lists_weigh_as_short_ones(monkeypatch):
    """The same trees aligned pair by pair and by rows: equal totals."""
    rng = random.Random(8)
    item = lambda: rng.choice(["<p>{}</p>", "<div><p>{}</p></div>", "<div class=n><p>a</p><p>{}</p></div>"]).format(rng.choice("abcdefgh"))
    for _ in range(60):
        drafts, page = (["".join(item() for _ in range(rng.randint(1, 14))) for _ in range(2)] for _ in range(2))
        totals = []
        for pairs in (10**9, 0):
            monkeypatch.setattr(H, "_PAIRS", pairs)
            matching = H.grown(drafts[:1])
            totals.append(H.match_trees(matching, H.parse(page[0])))
        weight = []
        for pairs in (10**9, 0):
            monkeypatch.setattr(H, "_PAIRS", pairs)
            matching, tree = H.grown(drafts[:1]), H.parse(page[0])
            matching.keyed(tree)
            weight.append(matching.weight(matching.wrapper, tree))
        assert weight[0] == weight[1]


@pytest.mark.parametrize("least, most", [(10, 33), (170, 193)])
def test_a_notice_goes_from_short_and_long_articles(spark, least, most):
    rng = random.Random(most)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    rows, want = [], {}
    for i in range(48):
        own = [words(12) for _ in range(rng.randint(least, most))]
        at = 3 if i < 24 else len(own) - 3
        shown = [*own[:at], "Read more of this in our weekly letter for all subscribers", *own[at:]]
        rows.append((i, "http://news.example/a" if i < 24 else "http://press.example/a", f"<html><body><article><h1>{words(4)}</h1>{''.join(f'<p>{x}</p>' for x in shown)}</article></body></html>"))
        want[i] = own
    got = {r.page_id: r.text.split("\n")[1:] for r in H.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_a_long_list_with_a_change_in_its_midst_takes_seconds():
    """Rows and columns that no end decides: texts that the wrapper knows, in another order."""
    page = lambda own: "<body>" + "".join(f"<p>{x}</p>" for x in own) + "</body>"
    begun = time.perf_counter()
    matching = H.grown([page([*range(400), *["v%d" % i for i in range(9_000)]])])
    H.match_trees(matching, tree := H.parse(page(["w%d" % i for i in range(9_000)] + [*range(399, -1, -1)])))
    assert len({b[0] for b in H.blocks_of(tree)} - {-1}) == 9_400 and time.perf_counter() - begun < 60


def test_malformed_markup_takes_linear_time():
    n = 100_000
    for page in ('<a "' * n, "<a '" * n + ">", "<div>" * 5_000 + "</section>" * n, "<div" * n, "<!" * n, "</" * n, '<p x="' * n + "'>", "<" + "a" * n * 4, "<a" + "b" * n + '"' * n, "<article>" * 5_000 + "<p>x" * n):
        begun = time.perf_counter()
        H.parse(page)
        assert time.perf_counter() - begun < 20, page[:20]


def test_malformed_markup_keeps_its_text():
    assert _text('one <a "two</p><p>three') == 'one <a "two|three'
    assert _text("<p>1 < 2</p><p>a <b") == "1 < 2|a <b"
    assert _text("<div><p>one</section></p>two</div></div><p>three</p>") == "one|two|three"
    assert _text('<p title="a > b">one</p><p>two <i title="three</p>') == 'one|two <i title="three'
    assert _text("<div<p>one</div>") == "one"
    assert _text("") == "" and _text("<") == "<" and _text("a<") == "a<"


def test_tags_have_ends_where_the_pattern_finds_them():
    rng = random.Random(2)
    for _ in range(3000):
        page = "".join(rng.choices(["<a", "</b", ">", '"', "'", " ", "x", "/"], k=rng.randint(1, 25)))
        ends = H.TagEnds(page)
        for at in range(len(page)):
            if H._NAME.match(page, at):
                token = H._TOKEN.match(page, at)
                assert ends.has(at) == (token[2] is not None), (page, at)
