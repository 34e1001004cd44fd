"""Bodies by selectors against the standard library's parser."""

import random
from html.parser import HTMLParser

from curator.sources import elements as E

SELECTORS = [
    E.Selector("a", 1, "div", "rm_txt"), E.Selector("a", 2, "div", "view TRS"), E.Selector("", 1, "div", "content"), E.Selector("", 2, "div", id="content"), E.Selector("", 3, "article"),
]


class Tree(HTMLParser):
    """Elements as lists [name, attributes, children]; an end tag closes the last open element of its name, and nothing else."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.flat, self.text, self.raw = [], [], None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.flat.append(["start", tag, dict(attrs), ""])

    def handle_endtag(self, tag):
        self.flat.append(["end", tag, {}, ""])

    def handle_data(self, data):
        if self.flat:
            self.flat[-1][3] += data

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    handle_charref = handle_entityref


def plain_body(html, source, least=100):
    flat = Tree(html).flat
    ends, open_ = {}, {}
    for i, (kind, tag, _, _) in enumerate(flat):
        if tag in E.VOID:
            continue
        if kind == "start":
            open_.setdefault(tag, []).append(i)
        elif open_.get(tag):
            ends[open_[tag].pop()] = i
    hidden = set()
    for i, (kind, tag, _, _) in enumerate(flat):
        if kind == "start" and tag in E.HIDDEN:
            hidden |= set(range(i, ends.get(i, len(flat))))

    def text(lo, hi, flow=False):
        out = "".join(("" if flow or flat[i][1] in E.INLINE else "\n") + flat[i][3] for i in range(lo, hi) if i not in hidden)
        lines = [" ".join(line.split()) for line in out.split("\n")]
        out = "\n".join(x for x in lines if x)
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
            out = out.replace(name, char)
        return out

    for s in sorted((s for s in SELECTORS if s.source in ("", source)), key=lambda s: (s.source == "", s.rank)):
        for i, (kind, tag, attrs, _) in enumerate(flat):
            if kind == "start" and tag == s.tag and set(s.classes.split()) <= set((attrs.get("class") or "").split()) and (not s.id or attrs.get("id") == s.id):
                body = text(i, ends.get(i, len(flat)))
                if len(body) > least:
                    return s.rank, body
                break
    paragraphs = []
    starts = [i for i, f in enumerate(flat) if f[0] == "start" and f[1] == "p" and i not in hidden]
    for k, i in enumerate(starts):
        end = min(ends.get(i, i + 1), starts[k + 1] if k + 1 < len(starts) else len(flat))
        body = text(i, end, True)
        if len(body) > 20:
            paragraphs.append(body)
    joined = "\n".join(paragraphs)
    return None, joined if len(joined) > least else None


def some_page(rng):
    words = lambda n: " ".join(rng.choices(["alpha", "béta", "x &lt; y", "gamma&nbsp;delta", "<b>bold</b>", "q<br>r", "<i>odd"], k=n))
    p = lambda n: f"<p>{words(n)}</p>"
    menu = "<nav><ul><li>menu " + words(4) + "</ul></nav><!-- <div class=content>" + words(30) + "</div> -->"
    body = "".join(p(rng.randint(2, 12)) for _ in range(rng.randint(1, 5)))
    inner = f"<div>{words(5)}<div class='x'>{body}</div>{words(3)}</div><script>if (a < b) {{ '<div class=content>' }}</script>{words(4)}"
    forms = [
        f"<div class='big content' id=q>{inner}</div><footer>{words(30)}</footer>", f'<div id="content">{inner}</div><div class="content">short</div>', f"<article>{inner}</article>", f"{body}{words(9)}", words(3),
        f'<div class="TRS view">{inner}</div>', f"<div class=rm_txt>few</div><div class='TRS_x'>{inner}</div><div class=content>{inner}", f"</div></div><div class=content>{inner}</div></div>{p(40)}", "",
    ]
    return f"<html><head><title>t</title><style>p {{}}</style></head><body>{menu}{rng.choice(forms)}<aside>{p(30)}</aside></body></html>"


def test_bodies_equal_those_of_a_plain_parser(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), some_page(rng)) for i in range(150)] + [(900, "a", None), (901, None, ""), (902, "a", "no tags at all " * 20)]
    pages = spark.createDataFrame(rows, "page_id int, source string, html string").repartition(3)
    got = {r.page_id: (r.rank, r.body) for r in E.bodies(pages, E.selector_table(spark, SELECTORS)).collect()}
    assert len(got) == len(rows)
    for i, source, html in rows:
        assert got[i] == plain_body(html or "", source), html
    assert sum(rank is None and body is not None for rank, body in got.values()) >= 5
    assert {rank for rank, _ in got.values()} >= {1, 2, 3}
