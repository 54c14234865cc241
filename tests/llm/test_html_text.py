"""HTML extraction (op11): minimum cut against enumeration, pages of many kinds, accuracy against the articles' own text."""
import itertools
import random

import numpy as np
import pytest

from vigil.llm import html_text as H
from vigil.llm.queries import op11_html

WEIGHTS = np.array(list(H.SHAPE.values()))
PROSE = "The river rose in the night, and by the morning it had reached the lower fields. Nobody had seen it so high before."


def text_of(source, weights=WEIGHTS):
    page = H.Page(source)
    return "\n".join(t for t, good in zip(page.texts, H.label(page, weights)) if good)


def cost(excess, edges, labels):
    cut = sum(abs(e) for e, on in zip(excess, labels) if (e > 0) != on and e)
    return cut + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_min_cut_against_all_labellings():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 9)
        excess = [rng.randrange(-6, 7) for _ in range(n)]
        edges = [(a, b, rng.randrange(0, 5)) for a in range(n) for b in range(a + 1, n) if rng.random() < .5]
        costs = {labels: cost(excess, edges, labels) for labels in itertools.product([False, True], repeat=n)}
        best = min(costs.values())
        got = H.min_cut(excess, edges)
        assert costs[tuple(got)] == best
        assert sum(got) == max(sum(labels) for labels, c in costs.items() if c == best)


def test_smoothness_decides_what_costs_leave_open():
    assert H.min_cut([1000, -300, 1000], [(0, 1, 500), (1, 2, 500)]) == [True, True, True]
    assert H.min_cut([1000, -1300, 1000], [(0, 1, 500), (1, 2, 500)]) == [True, False, True]
    assert H.min_cut([-1000, 300, 0, -1000], [(0, 1, 500), (1, 2, 100), (2, 3, 500)]) == [False, False, False, False]


@pytest.mark.parametrize("inside, want", [
    ("<h1>T &amp; t</h1><p>One <b>two</b>&nbsp;\n three.<br>Four<p>Five", "T & t\nOne two three. Four\nFive"),
    ("<header><h1>T</h1><p>By A. Writer</p></header><p>One.</p><footer>Filed under x</footer>", "T\nOne."),
    ("<p>One.</p><div class='ad'>Buy</div><p>Two.</p><aside><p>" + PROSE + "</p></aside><p>Three.</p>", "One.\nTwo.\nThree."),
    ("<p>One.</p><section id='comments'><article class='comment'><p>" + PROSE + "</p></article></section>", "One."),
    ("<p>One.</p><form><label>Name</label><input><textarea>typed</textarea><select><option>a<option>b</select><button>Go</button></form>", "One."),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table>", "a\nb\nc\n1\n2\n3"),
    ("<p>a</p><script>if (x < 1) { '</p>' }</script><style>p{}</style><!-- <p>no</p> --><template><p>no</p></template><p>b</p>", "a\nb"),
    ("<blockquote>q</blockquote><pre>x\n  y</pre><figure><figcaption>c</figcaption></figure><dl><dt>d<dd>e</dl>", "q\nx y\nc\nd\ne"),
    ("a < b <p title='x > y'>c</i></span></section>d &am &#233; &bogus;", "a < b\nc\nd &am é &bogus;".replace("c\nd", "cd").replace("cd", "c\nd")),
    ("<p hidden>no</p><p style='display:none'>no</p><p aria-hidden=true>no</p><p>yes</p>", "yes"),
    ("<div class='newsletter'>Subscribe</div><div class='entry-content'><p>ok</p></div><div class='cookie-notice'>We use</div>", "ok"),
])
def test_articles(inside, want):
    page = "<!DOCTYPE html><html><head><title>no</title></head><body class='has-sidebar'><nav><ul><li><a href=/>Home</a></ul></nav>"
    assert text_of(page + "<article>" + inside + "</article><footer>&copy; me</footer></body></html>") == want


def test_pages_without_clear_markup():
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("Home", "News", "Shop", "About"))
    page = f"<body><div><ul>{links}</ul></div><div><h2>The flood</h2><p>{PROSE}</p><p>{PROSE}</p><p>It went.</p><p>{PROSE}</p></div><div><a href=/>Up</a></div>"
    assert text_of(page) == "\n".join(["The flood", PROSE, PROSE, "It went.", PROSE])
    assert text_of("") == "" and text_of("<p>") == "" and text_of("<a href='") == ""
    assert text_of("<main><p>a</p><div class=sidebar><div class=content>b</div></div></main>") == "a"
    assert text_of("<form><div role=main><p>a</p></div></form><div role=navigation>b</div>") == "a"


def test_very_long_and_deep_pages():
    page = H.Page("<article>" + "<p>" + PROSE + "<div class=ad><p>" + PROSE + "</div>" * 1 + "</article>")
    assert len(page.texts) == 2
    n = 5000
    body = "".join(f"<p>{PROSE} {i}</p><div class=ad>{PROSE}</div>" for i in range(n))
    assert text_of(f"<article>{body}</article>").count("\n") == n - 1
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert text_of("<article>" + deep + "<p>a</p></article>") == "deep\na"
    assert text_of("<article><p>a</p>" + "<a x=\"" * 20_000) == "a"


def make_page(rng, i):
    words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 200))]
    cuts = sorted(rng.sample(range(1, len(words)), min(len(words) - 1, rng.randrange(0, 5))))
    parts = [" ".join(words[a:b]) + rng.choice([".", " &", "", " \"x\""]) for a, b in zip([0, *cuts], [*cuts, len(words)])]
    esc = [p.replace("&", "&amp;").replace('"', "&quot;") for p in parts]
    extras = ["<div class='related'><p>see also</p></div>", "<!-- x -->", "<script>a()</script>", "<div class=ad>buy &copy;</div>"]
    inside = "".join(f"<p>{'<b>' if rng.random() < .3 else ''}{p}{rng.choice(['</p>', '', '<br>'])}"
                     f"{rng.choice(extras) if rng.random() < .2 else ''}" for p in esc)
    menu = "".join(f"<li><a href='/{k}'>{w}</a></li>" for k, w in enumerate(words[:5]))
    return (f"<html><head><title>t</title></head><body><nav><ul>{menu}</ul></nav><article><h1>Title {i}</h1>{inside}</article>"
            f"<footer>foot</footer>", "\n".join([f"Title {i}", *parts]))


def test_query_over_pages(spark, tmp_path):
    rng = random.Random(5)
    made = [make_page(rng, i) for i in range(120)]
    rows = [(i, f"http://h/{i}", h) for i, (h, _) in enumerate(made)]
    rows += [(3, None, made[3][0]), (None, "u", made[4][0]), (200, "u", None), (201, None, ""), (None, None, None)]
    want = [(i, f"http://h/{i}", t) for i, (_, t) in enumerate(made)] + [(3, None, made[3][1]), (None, "u", made[4][1]), (200, "u", ""),
                                                                        (201, None, ""), (None, None, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, hash int")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = op11_html(spark, str(tmp_path)).collect()
    assert sorted(map(repr, ((r.page_id, r.url, r.text) for r in got))) == sorted(map(repr, want))
    assert all(r.n_chars == len(r.text) for r in got)
    empty = H.extract(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"]


def test_trained_shape_tells_held_out_blocks_apart(spark):
    """Mark-up is left out: the shape model alone on pages that it has not seen."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    train, test = pages.filter("page_id % 2 = 0"), pages.filter("page_id % 2 = 1")
    weights = H.fit(train)
    again = H.fit(train.repartition(7))
    assert np.array_equal(weights, again)
    right = total = 0
    for (source,) in test.select("html").collect():
        page = H.Page(source)
        truth = np.array([page.evidence[k] > 0 for k in page.nodes])
        right += ((page.shapes() @ weights > 0) == truth).sum()
        total += len(truth)
    assert right / total > 0.95
