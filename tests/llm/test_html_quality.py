import itertools
import random
import time

from textloom.llm.html_blocks import parse
from textloom.llm.html_samples import pages
from textloom.llm.html_text import classifier, errors, extract, features, labels, main_text
from textloom.llm.mincut import minimum_cut
from textloom.llm.quality import Sample, fit, score, train

ARTICLE = "<h1>Title</h1><p>First paragraph of the text, long enough to count. It has two sentences.</p><p>A &lt; B &amp; <b>bold</b>\n  text.<p>Unclosed paragraph here.</p>"
WANT = "Title\n\nFirst paragraph of the text, long enough to count. It has two sentences.\n\nA < B & bold text.\n\nUnclosed paragraph here."
AROUND = (
    "<nav><ul><li><a href='/'>Home</a></li></ul></nav>", "<header><h2>The site</h2><p>All the news that is fit. Every day.</p></header>", "<footer>&copy; 2020 Someone. All rights reserved.</footer>",
    "<aside><p>You may also like this. And this one too.</p></aside>", "<div class='sidebar'><p>Some words about the author. They write.</p></div>", "<div id='cookie-banner'><p>We use cookies. Please accept them all.</p></div>",
    "<div class=\"ad\">Buy our product now! It is the best.</div>", "<form><p>Your mail address, please. We send letters.</p><button>Go</button></form>", "<script>var a = '<p>no</p>';</script>", "<style>p{}</style>",
    "<section class='comments'><h3>Comments</h3><p>I liked this article a lot. Thank you for it.</p></section>", "<!-- <p>hidden</p> -->", "<noscript><p>Enable scripts. Please.</p></noscript>", "<ul class=\"menu\"><li>One</li></ul>",
    "<div class='siteFooter'><p>About this site. All of it.</p></div>", "<div id='cookieBar'><p>This site keeps cookies. Agree to them.</p></div>", "<div class='adbox'><p>The best car there is. Try it.</p></div>",
)


def test_pages():
    for before, after in itertools.product(AROUND, AROUND):
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}<article>{ARTICLE}</article>{after}</body></html>"
        assert main_text(page) == WANT, (before, after)


def test_furniture_inside_the_article():
    page = f"<body><article>{ARTICLE[:60]}</p><div class='advert'>Buy now! Only today.</div><p>Second paragraph of the text, which goes on. And on.</p></article></body>"
    assert "Buy" not in main_text(page) and "Second paragraph" in main_text(page)


def test_names_that_only_sound_like_furniture():
    page = "<body><div class='article-header'><h1>Title here</h1></div><div class='story-body'><p>First paragraph of the text, long enough. It goes on.</p><p class='adequate'>Second paragraph, with more words. And more.</p></div></body>"
    assert main_text(page).startswith("Title here\n\nFirst") and "Second" in main_text(page)


def test_odd_markup():
    assert main_text("") == ""
    for page in ("<p", "<p class='", "<!-- open", "<script>x", "</p></div>", "<b><i>" * 3000, "a < b", "\x00", "&#xZZ;"):
        assert isinstance(main_text(page), str)
    assert [b.text for b in parse("<body>x<br>y<td>z</td>").blocks] == ["x y", "z"]


def test_time_follows_the_page():
    """Markup that a backtracking or stack-walking scanner takes quadratic time for."""
    n = 100_000
    for page in (
        "<a " * n, "<p>x" + "</b>" * n, "<a href='x" * n, "<a b=\"" * n, "<b>" * n + "x<div>y</div>" * 1000, "<b>" * n + "</i>" * n, "<script>" + "</script " * n, "<!--" * n, "<div><i>" * (n // 4) + "</b>" * n,
        "<td><b>" * (n // 4) + "</tr>" * n, "<p " + "class='" * n, "<a =" * n + ">", "<" * n, "</" * n, "&" * n, "<div>x" * (n // 10), "<title>" * n, "<b><div><i>" + "<i>" * n + "</b>" * n,
    ):
        began = time.process_time()
        parse(page)
        assert time.process_time() - began < 3, page[:30]


def test_text_that_is_no_furniture_is_kept():
    """Formulas, drawings and what stands in for media are text of the page."""
    page = f"<body><article>{ARTICLE}<p>Let <math><mi>x</mi> = <mn>2</mn></math> be a number, as it was said before.</p><p>See <object>the table</object> and <svg><text>a label</text></svg> and <canvas>a drawing</canvas> here.</p></article></body>"
    got = main_text(page)
    assert "Let x = 2 be a number" in got and "See the table and a label and a drawing here." in got


def test_the_cut_decides():
    """On made-up pages that neither the classifier nor the edges were made with: the cut changes labels, for the better."""
    n, changed, by_cut, by_cost = errors(pages(120, 11), classifier())
    assert changed > 0.02 * n and by_cut < 0.85 * by_cost and by_cut < 0.1 * n


def test_short_parts_of_an_article_are_drawn_in():
    lone = [b for b in parse("<body><div><p>Yes</p></div></body>").blocks]
    assert sum(w * x for w, x in zip(classifier(), features(lone[0]))) < 1.5
    page = "<body><ul><li><a href=/>Home</a></li></ul><div><p>Some long paragraph that is text for sure, as anyone can see. It has sentences.</p><p>So</p><p>Another long paragraph that is text for sure, as anyone can see. It has some too.</p></div></body>"
    assert main_text(page).split("\n\n")[1] == "So" and "Home" not in main_text(page)


def test_extraction_against_a_plain_form():
    """The whole of main_text, with the labelling done by trying all of them: least cost over blocks, nodes and edges."""
    for page in pages(60, 21):
        parsed = parse(page)
        if not 2 <= len(parsed.blocks) <= 11:
            continue
        seen = []
        chosen, _ = labels(parsed, classifier(), cut=lambda s, t, e: seen.append((s, t, e)) or minimum_cut(s, t, e))
        s, t, e = seen[0]
        cost = lambda x: sum(t[i] if x[i] else s[i] for i in range(len(s))) + sum(w for a, b, w in e if x[a] != x[b])  # noqa: B023, E731
        best = min(map(cost, itertools.product((True, False), repeat=len(s))))
        assert any(abs(cost([*chosen, *rest]) - best) < 1e-6 for rest in itertools.product((True, False), repeat=len(s) - len(chosen)))
        assert main_text(page) == "\n\n".join(b.text for b, good in zip(parsed.blocks, chosen) if good)


def test_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 7)
        s, t = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 5)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6]
        cost = lambda x: sum(t[i] if x[i] else s[i] for i in range(n)) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: B023, E731
        assert cost(minimum_cut(s, t, edges)) == min(map(cost, itertools.product((True, False), repeat=n)))


def test_extract_rows(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x"), (2, None, None, "x"), (None, "u", "", None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r["text"] for r in got] == [WANT, "", ""] and got[0].asDict().keys() == {"page_id", "url", "text"}
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def texts(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    good = [" ".join(word() for _ in range(rng.randint(5, 200))) + "." for _ in range(n)]
    bad = [" ".join(word().upper() + "!!" for _ in range(rng.randint(5, 200))) for _ in range(n)]
    return [(t, 1) for t in good] + [(t, 0) for t in bad]


def test_classifier_learns(spark):
    seen, new = texts(60, 1), texts(60, 2)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(seen + new)] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k, 9) for i, (_, k) in enumerate(seen)] + [(None, 1, 1), (5000, 0, 1), (3, None, 1)], "doc_id long, quality int, text int")
    model = fit(docs, labels, Sample(per_label=60, epochs=6))
    got = {r["doc_id"]: r["score"] for r in score(docs.withColumn("score", docs["doc_id"]), model).collect()}
    assert len(got) == 243 and all(0 <= s <= 1 for s in got.values())
    right = [(got[120 + i] >= 0.5) == (k == 1) for i, (_, k) in enumerate(new)]
    assert sum(right) / len(right) > 0.95
    assert score(docs.limit(0), model).count() == 0


def test_one_label_or_none():
    assert train([b"a"], [1]).prior > 0 > train([b"a"], [0]).prior
    assert train([], []).prior == 0


def test_the_end_of_a_long_text_counts(spark):
    model = train([t.encode() for t, _ in texts(60, 1)], [k for _, k in texts(60, 1)], Sample(epochs=6))
    good, bad = (t for t, _ in (texts(1, 9)[0], texts(1, 9)[1]))
    rows = spark.createDataFrame([(1, good * 50), (2, good * 10 + bad * 60)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in score(rows, model).collect()}
    assert got[1] > 0.5 > got[2]
