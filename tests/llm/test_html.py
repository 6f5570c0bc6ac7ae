import pytest
from pyspark.sql import functions as F

from pressgauge.llm import html

SHOP = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
FOOT = "<div class='comments'><p>first!</p></div><aside>more</aside><footer>&copy; us</footer></body></html>"


@pytest.fixture(scope="module")
def weights():
    counts = {}
    for k in range(30):
        page = f"{SHOP}<div class=ad>buy now {k}</div><article><h1>Head {k}</h1><p>{'words here ' * 40}</p></article>{FOOT}"
        for feature, (a, b) in html.count_features(page).items():
            old = counts.get(feature, (0, 0))
            counts[feature] = (old[0] + a, old[1] + b)
    return html.Weights(counts, 20.0)


CASES = [
    ("<article><h1>A&amp;B</h1><p>one  two\n three<br>four</p><p>x<b>y</b>z</p></article>", "A&B\none two three four\nxyz"),
    ("<main><p>unclosed<p>next<ul><li>a<li>b</ul></main>", "unclosed\nnext\na\nb"),
    ("<article><p>start</p><div class='ad'>" + "buy this " * 50 + "</div><p>end</p></article>", "start\nend"),
    ("<article><p>story <form>mail <input name=q></form></p><section id=comments><p>nice</p></section></article>", "story"),
    ("<div>Site name</div><article><p>Only this</p></article><div>Imprint</div>", "Only this"),
    ("<div id='content'><h2>T</h2><p>caf&eacute; &#233; &lt;tag&gt; a < b</p></div>", "T\ncafé é <tag> a < b"),
    ("<article><p style='overflow:hidden' title='a > b'>kept</p><p hidden>gone</p></article>", "kept"),
    ("<article><header><h1>Own head</h1></header><p>t</p></article>", "Own head\nt"),
    ("<article><!-- <p>no</p> --><style>p{}</style><p>yes</p><noscript>no</noscript></article>", "yes"),
    ("<article><p>nested <nav><div>menu</div></nav> rest</p></article>", "nested\nrest"),
]


NAMED = [
    ("<article><h2 id='search-engines'>Search</h2><p>one</p><h3 id=social-media>Media</h3><p>two</p></article>", "Search\none\nMedia\ntwo"),
    ("<article><p>a</p><section id='related-work'><h2>Related work</h2><p>b</p></section><p id='notice-3'>c</p></article>", "a\nRelated work\nb\nc"),
    ("<div id='content'><h2 id='login'>How to log in</h2><p id='search-1'>" + "well " * 9 + "</p></div>", "How to log in\n" + "well " * 8 + "well"),
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", "so x=2 holds"),
    ("<article><p>a</p><section class='comments-section'><p>no</p></section><div class='ad wide'>no</div><p class=advert>no</p><p>b</p></article>", "a\nb"),
]

MIXED = ["section class='post-comments'", "div class='comment-body'", "div class=sidebar-content", "div class=widget-body", "div class='cookie-notice-text'", "div class=newsletter-content", "div id=sidebarContent", "div class='wide main-nav'", "div id=comments class=entry"]
KEPT = ["div class='content comments-open'", "div class='article-body has-sidebar'", "section class='post'", "div class='post share-count-12'", "section id=with-comments", "div class='research-notes'"]


@pytest.mark.parametrize("name", MIXED)
def test_names_of_noise_that_hold_words_of_content(weights, name):
    part = f"<{name}><p>{'not the story ' * 9}</p></{name.split()[0]}>"
    for page in (f"<article><p>a b</p>{part}<p>c</p></article>", f"<div id=content><p>a b</p>{part}<p>c</p></div>", f"<article><p>a b</p><p>c</p></article>{part}"):
        assert html.extract_text(SHOP + page + FOOT, weights) == "a b\nc"


@pytest.mark.parametrize("name", KEPT)
def test_names_of_content_that_hold_words_of_noise(weights, name):
    part = f"<{name}><p>the story</p></{name.split()[0]}>"
    assert html.extract_text(f"{SHOP}<article><p>a b</p>{part}</article>{FOOT}", weights) == "a b\nthe story"
    assert html.extract_text(f"{SHOP}{part}{FOOT}", weights) == "the story"


@pytest.mark.parametrize("body, want", NAMED)
def test_names_made_from_text(weights, body, want):
    assert html.extract_text(SHOP + body + FOOT, weights) == want


@pytest.mark.parametrize("body, want", CASES)
def test_main_text(weights, body, want):
    assert html.extract_text(SHOP + body + FOOT, weights) == want


def test_page_that_breaks_off(weights):
    assert html.extract_text(SHOP + "<article><p>breaks off in <b", weights) == "breaks off in"


@pytest.mark.parametrize("page", ["", "<", "<p", "<p class='", "<!--", "<script>x", "</p></div>", SHOP + FOOT, "<" * 50_000, "<a '" * 20_000])
def test_pages_without_text_end_soon(weights, page):
    assert html.extract_text(page, weights).strip("<") in ("", *[page]) or "a '" in page


def test_region_is_the_best_of_all():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(100):
        found = [(rng.choice("abcd"), rng.choice([None, "w", "w w", " "]), 0) for _ in range(9)]
        weights = {"a": 1.5, "b": -1.0, "c": 0.25, "d": -0.3}

        def worth(a, b, found=found, weights=weights):
            return sum(weights[f] * (1 if t is None else len(t.split())) for f, t, _ in found[a:b])

        best = max(worth(a, b) for a, b in itertools.combinations_with_replacement(range(10), 2))
        assert abs(worth(*html.region(found, weights)) - best) < 1e-9


def test_extract_rows(spark):
    page = f"{SHOP}<article><p>{'some words ' * 20}</p></article>{FOOT}"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", f"<article><p>{'long ' * 200_000}</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = sorted(((r.page_id, r.url, r.text[:10], r.n_chars) for r in html.extract(df).collect()), key=repr)
    want = [(1, "u", "some words", 219), (1, "u", "some words", 219), (2, None, "", 0), (None, "v", "", 0), (3, "w", "long long ", 999_999)]
    assert got == sorted(want, key=repr)
    assert html.extract(df.limit(0)).collect() == []
