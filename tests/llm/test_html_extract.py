import math
import random

import numpy as np

from verisift.llm import html_extract
from verisift.llm.html_extract import Line, clusters, extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div class="cookie-notice">We use cookies on this site to make everything better for you.</div>
<header><h2>Site</h2><nav><ul><li><a href=/>Home</a></li><li><a href=/x>More</a></li></ul></nav></header><div class="ad">Buy now &amp; save</div>
<div class="sidebar"><p>Related stories that are long enough to look like a paragraph of text.</p></div>
<article><header><h1>A  head&nbsp;line</h1></header><p><b>First para &lt;with&gt; <i>in</i>line.<br><p>Is.</p>
<p>Second para, which is a good deal longer than the others and has no tags at all in it.</p><form><label>Mail</label><input></form>
<div id="comments"><p>Great article, thanks a lot for writing all of this down!</p></div></article>
<footer>&copy; 2024 the site, all rights reserved</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "A head line\nFirst para <with> inline.\nIs.\nSecond para, which is a good deal longer than the others and has no tags at all in it."


def test_without_article_element():
    page = PAGE.replace("<article>", "<div><div class=body>").replace("</article>", "</div></div>").replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")
    got = main_text(page)
    assert got.startswith("A head line\nFirst para") and "cookies" not in got and "rights" not in got and "Great article" not in got


def plain(inner):
    return main_text(f'<html><body><div class="header">The site</div><div id=content>{inner}</div><div class="related"><p>Another story.</p></div><footer>(c)</footer></body></html>')


def test_whole_region_without_article_element():
    line = "A sentence of a length that is usual in running text, with some more words."
    sections = plain(f"<h1>Head</h1><section>{f'<p>{line}</p>' * 13}</section><section>{f'<p>{line} Two.</p>' * 7}</section>")
    assert sections == "\n".join(["Head", *[line] * 13, *[line + " Two."] * 7])
    for open_, item, close in (("<ul>", "<li>{}</li>", "</ul>"), ("<ol>", "<li>{}</li>", "</ol>"), ("<table>", "<tr><td>{}</td></tr>", "</table>"), ("<blockquote>", "<p>{}</p>", "</blockquote>"), ("<pre>", "{}<br>", "</pre>"), ("<div>", "<p>{}</p>", "</div>")):
        got = plain(f"<h1>Head</h1><p>{line} One.</p>{open_}{item.format(line) * 12}{close}<p>{line} End.</p>")
        assert got == "\n".join(["Head", line + " One.", *[line] * 12, line + " End."]), open_
        assert line in plain(f"{open_}{item.format(line) * 3}{close}")


def test_boxes_of_the_article_itself():
    line = "A sentence of a length that is usual in running text, with some more words."
    inner = f'<div class="entry-header"><h1>Head</h1></div><p>{line}</p><div class="discussion"><p>{line} Discussed.</p></div><div id="legal"><p>Law.</p></div><div class="newsletter"><p>Sign up!</p></div><p>{line}</p>'
    want = "\n".join(["Head", line, line + " Discussed.", "Law.", line])
    assert main_text(f"<body><article>{inner}</article></body>") == want and plain(inner) == want
    assert main_text(f"<body>{inner}</body>") == want


LONG = "A sentence of a length that is usual in running text, with some more words."


def test_wrappers_are_no_boxes_beside():
    body, want = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>", f"Head\n{LONG}\n{LONG}"
    for open_, close in (('<div class="content has-sidebar">', "</div>"), ('<div id="page" class="no-header">', "</div>"), ('<form id="aspnetForm">', "</form>"), ('<div class="sidebar-page">', "</div>"), ('<div class="adsFree">', "</div>")):
        assert main_text(f"<body>{open_}{body}{close}<footer>(c)</footer></body>") == want, open_
        assert main_text(f"<body>{open_}<article>{body}</article>{close}<footer>(c)</footer></body>") == want, open_
    assert main_text(f"<body><form><p>{LONG}</p></form><footer>(c)</footer></body>") == LONG
    assert main_text(f"<body><div class=x>{body}<form><label>Your mail</label><input></form></div></body>") == want
    assert main_text(f'<article><div class="post-header"><h1>Head</h1></div><p>{LONG}</p></article>') == f"Head\n{LONG}"
    assert main_text(f'<article><form action="/s"><p>Search here</p></form><p>{LONG}</p><div class="cookieNotice">We use cookies</div></article>') == LONG


def test_of_several_articles_the_one_with_the_text():
    main = f"<article><h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></article>"
    for beside in ("<article><h2>Teaser</h2><p>Read more about it.</p></article>", f"<article><h2>Teaser</h2><p>{LONG}</p></article>", f'<div class="sidebar"><article><p>{LONG}</p></article></div>'):
        for page in (main + beside, beside + main, f"<main>{beside}{main}</main>", f"<main>{main}<section>{beside * 2}</section></main>"):
            assert main_text(f"<body>{page}</body>") == f"Head\n{LONG}\nShort.\n{LONG}"
    comments = f'<article class="comment"><p>{LONG}</p></article>' * 5
    assert main_text(f'<body>{main}<div id="comments">{comments}</div></body>') == f"Head\n{LONG}\nShort.\n{LONG}"


#: Pages without names: only the ratio can tell the text from what is beside it.
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Entry {i}</a></li>' for i in range(6)) + "</ul>"
NAMELESS = [
    f"<body><div>{MENU}</div><div><h1>Head</h1>{f'<p>{LONG}</p>' * 4}<p>End.</p></div><div>{MENU}</div></body>",
    f"<body><div><p>Welcome back</p></div><div>{MENU}</div><div><h1>Head</h1>{f'<p>{LONG}</p>' * 4}<p>End.</p></div><div><a>More</a> <a>Links</a></div></body>",
    f"<body><table><tr><td>{MENU}</td></tr></table><div><div><h1>Head</h1></div><div>{f'<p>{LONG}</p>' * 4}<p>End.</p></div></div><div>{MENU}<p>{LONG}</p></div></body>",
]


def test_ratio_smoothing_and_clusters_decide(monkeypatch):
    want = "\n".join(["Head", *[LONG] * 4, "End."])
    assert [main_text(p) for p in NAMELESS] == [want] * 3
    monkeypatch.setattr(html_extract, "gaussian", lambda x, sigma=1.0: np.ones(len(x)))
    assert all(main_text(p) != want for p in NAMELESS)
    # a short line between long ones is content by its neighbours
    monkeypatch.undo()
    lines = [Line(t, 2, 0, (0,)) for t in ("x" * 300, "y" * 300, "short", "z" * 300, *["m"] * 9)]
    assert clusters(lines)[1][0] == (0, 5)
    monkeypatch.setattr(html_extract, "gaussian", lambda x, sigma=1.0: x)
    assert clusters(lines)[1][:2] == [(0, 2), (3, 4)]


def test_clusters_equal_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        lines = []
        for _ in range(rng.randrange(0, 30)):
            n = rng.choice([3, 20, 90, 400])
            lines.append(Line("x" * n, rng.randrange(0, 9), rng.choice([0, 0, n, n // 2]), (0,), rng.random() < 0.2, rng.random() < 0.1))
        ratio = [0.0 if ln.aside or ln.doubt else (len(ln.text) - ln.links) / max(1, ln.tags) for ln in lines]
        kernel = {d: math.exp(-d * d / 2) for d in range(-2, 3)}
        smooth = [sum(kernel[d] * ratio[i + d] for d in kernel if 0 <= i + d < len(lines)) / sum(kernel.values()) for i in range(len(lines))]
        mean = sum(smooth) / max(1, len(smooth))
        std = math.sqrt(sum((x - mean) ** 2 for x in smooth) / max(1, len(smooth)))
        live = [i for i, ln in enumerate(lines) if not (ln.aside or ln.doubt)]
        limit = min(0.5 * std, max((smooth[i] for i in live), default=0.0))
        want = {i for i in live if smooth[i] >= limit - 1e-9}
        if any(abs(smooth[i] - limit) < 1e-6 for i in live):
            continue
        high, runs = clusters(lines)
        assert set(np.flatnonzero(high)) == want == {i for a, b in runs for i in range(a, b)}
        assert all(a < b for a, b in runs) and all(b < c for (_, b), (c, _) in zip(runs, runs[1:]))


def test_edges(spark):
    assert main_text(None) == "" and main_text("") == "" and main_text("<p></p>") == "" and main_text("<nav>x</nav>") == ""
    assert main_text("plain text &am") == "plain text &am" and main_text("<article><p>cut o") == "cut o"
    assert main_text("<article>" + "<p>word " * 5000) == "\n".join(["word"] * 5000)
    d = spark.createDataFrame([(1, "u", "<p>x</p>", 5), (1, "u", "<p>x</p>", 5), (2, None, None, None)], "page_id long, url string, html string, text int")
    got = extract(d, name="text").collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, "x"), (1, "x"), (2, "")]
    assert extract(d.limit(0)).count() == 0
