import random
from collections import Counter

from furrow.llm import pages


def test_field_on_held_out_layouts():
    r, right, field = random.Random(1234), 0, pages.trained()
    for _ in range(200):
        html, kept = pages.labelled(r)
        right += field.extract(html) == " ".join(kept)
    assert right >= 180


#: Pages written by hand, in layouts of which labelled() composes none as a whole, and their main texts.
HELD_OUT = [
    (
        "<html><body><div id='top'><a href='/'>Example Times</a></div><table class='menu'><tr><td><a href='/a'>World</a></td><td><a href='/b'>Sport</a></td></tr></table>"
        "<div id='article-text'><h1>Rain at last</h1><p>After months of drought it rained on Monday.</p><p>Farmers were relieved, <a href='/f'>said their union</a>.</p></div>"
        "<div id='disqus_thread'><p>First!</p><p>Finally some rain, I love it.</p></div><div class='footer'>Contact us</div></body></html>",
        "Rain at last After months of drought it rained on Monday. Farmers were relieved, said their union.",
    ),
    (
        "<body><header><h1>My blog</h1><p>Notes on cooking</p></header><main><article><h2>Bread</h2><p>Mix flour and water. Wait.</p><ol><li>Knead it.</li><li>Bake it.</li></ol></article>"
        "<section id='comments'><h3>2 comments</h3><div>Nice bread.</div><div>Mine burnt.</div></section></main><aside><h3>About me</h3><p>I cook and write.</p></aside></body>",
        "Bread Mix flour and water. Wait. Knead it. Bake it.",
    ),
    (
        "<html><head><title>T</title></head><body><nav><a href='/'>Home</a> | <a href='/x'>Docs</a></nav><article><h1>Sorting</h1><p>Call <code>sort(x)</code> to sort.</p>"
        "<pre>x = sort(y)</pre><blockquote>Sorting is half of computing.</blockquote><p>The value is <math><mi>n</mi><mo>=</mo><mn>5</mn></math> here.</p></article><footer>&copy; Docs</footer></body></html>",
        "Sorting Call sort(x) to sort. x = sort(y) Sorting is half of computing. The value is n=5 here.",
    ),
    (
        "<body><div class='cookie-banner'><p>This site uses cookies. <a href='#'>Accept</a></p></div><div class='site-header'>News today</div><div class='story'><h1>Moon</h1><p>It rose.</p><p>And <a href='/s'>sun</a> came.</p>"
        "<div class='advert'>Buy our boots now!</div><p>People slept.</p></div><div class='related'><h3>Related</h3><ul><li><a href='/1'>Stars</a></li></ul></div></body>",
        "Moon It rose. And sun came. People slept.",
    ),
    (
        "<body><article><h1>Deep</h1><p>One.</p></article><aside class='sidebar'>" + "<div>" * 700 + "Sale" + "</div>" * 700 + "</aside><article><p>Two sentences, at last. They end here.</p></article></body>",
        "Deep One. Two sentences, at last. They end here.",
    ),
    (
        "<body><ul class='navigation'><li><a href='/'>Start</a><li><a href='/b'>Books</a></ul><div class='post-content'><h1>Tea</h1><p>Tea is a drink.<p>It is old.<ul><li>Green<li>Black</ul></div>"
        "<form class='newsletter'><label>Your mail</label><input><button>Go</button></form><div class='copyright'>All rights reserved.</div></body>",
        "Tea Tea is a drink. It is old. Green Black",
    ),
    (
        "<body><main><h1>Budget</h1><p>Figures for the year follow.</p><table><tr><th>Year</th><th>Sum</th></tr><tr><td>2020</td><td>17</td></tr></table><p>They grew.</p></main>"
        "<div class='share'><a href='/t'>Share this</a></div><footer><p>Imprint and privacy of the site.</p></footer></body>",
        "Budget Figures for the year follow. Year Sum 2020 17 They grew.",
    ),
    (
        "<body><div class='wrapper'><div class='masthead'><a href='/'>The Paper</a></div><div class='entry'><h1>Caf&eacute;s close</h1><p>Two caf&#233;s will close, the owner said.</p><p>She &lt;sold&gt; them.</p></div>"
        "<div class='comments-area'><ol><li class='comment'><p>What a pity, they were good.</p></li></ol></div></div></body>",
        "Cafés close Two cafés will close, the owner said. She <sold> them.",
    ),
    (
        "<body><div role='navigation'><a href='/1'>One</a> <a href='/2'>Two</a></div><div role='main'><h1>Walks</h1><p>We walked far; the hills were steep, and cold.</p><figure><img src='x'><figcaption>The hills.</figcaption></figure></div></body>",
        "Walks We walked far; the hills were steep, and cold. The hills.",
    ),
    ("<body><div class='popup'>Subscribe to our letter!</div><p>Only one plain paragraph, without any frame.</p></body>", "Only one plain paragraph, without any frame."),
]


def test_pages_by_hand():
    """Words of the ten pages that are kept as they should be, and the pages that are right as a whole."""
    field, whole, hit, got_n, want_n = pages.trained(), 0, 0, 0, 0
    for html, want in HELD_OUT:
        got = field.extract(html)
        whole += got == want
        a, b = Counter(got.split()), Counter(want.split())
        hit, got_n, want_n = hit + (a & b).total(), got_n + a.total(), want_n + b.total()
        if got != want:
            print(repr(got), repr(want), sep="\n")
    print(f"{whole} of {len(HELD_OUT)} pages, words: precision {hit / got_n:.3f}, recall {hit / want_n:.3f}")
    assert whole >= 9 and hit >= 0.95 * got_n and hit >= 0.97 * want_n


def test_depth_and_attributes_are_not_cut():
    html = "<article><p>Before it.</p></article><aside class='" + "x " * 400 + "sidebar'>" + "<div>" * 5000 + "Buy" + "</div>" * 5000 + "</aside><article><p>The article goes on here, after it.</p></article>"
    found = pages.blocks(html)
    assert [t for _, t in found] == ["Before it.", "Buy", "The article goes on here, after it."]
    assert "tag:aside" in found[1][0] and "name:sidebar" in found[1][0] and "tag:aside" not in found[2][0] and "tag:div" not in found[2][0]
    long = "word " * 300_000
    assert pages.trained().extract(f"<article><p>{long}</p></article>") == long.strip()


def test_one_page_in_full():
    html = (
        "<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header>Site name</header><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
        "<div class='cookie-notice'><p>We use cookies, you know.</p></div><article><h1>On   tea &amp; milk</h1><p>Be.</p><p>Tea <b>is</b>\n good&#33;<br>Yes."
        "<form><label>Mail</label><input></form></article><aside><h3>More</h3><p>Other things to read today.</p></aside><section class='comments'><p>I disagree, this is wrong.</p></section>"
        "<footer>&copy; 2024 Site</footer></body></html>"
    )
    assert pages.trained().extract(html) == "On tea & milk Be. Tea is good! Yes."


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    f = pages.trained()
    g = np.random.default_rng(3)
    for n in (1, 2, 5, 7):
        s = g.normal(size=(n, 2))
        score = lambda y, s=s: sum(s[i, v] for i, v in enumerate(y)) + sum(f.steps[a, b] for a, b in itertools.pairwise(y))
        assert tuple(f.decode(s)) == max(itertools.product((0, 1), repeat=n), key=score)


def test_odd_pages(spark):
    odd = [None, "", "plain words only", "<p>" * 3000 + "deep", "<div>" * 3000 + "x", "<", "<![if x]><p>hm", "<script>never closed", "<article>" + "<p>word.</p>" * 3000 + "</article>"]
    rows = [(i, None if i == 2 else "u", h, "t", 5) for i, h in enumerate(odd)] + [(None, "u", odd[8], "t", 5)] * 2
    got = pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[0].text == "" and by[1].text == "" and by[8].text == " ".join(["word."] * 3000)
    assert all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id is None] == [by[8].text] * 2
    none = pages.extracted(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.count() == 0 and none.columns == ["page_id", "url", "text", "n_chars"]
