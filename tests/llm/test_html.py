import numpy as np
import pytest

from flowloom.llm import html_extract as H

PAGE = (
    '<!DOCTYPE html><html><head><title>T {k}</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home {k}</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad --><div class="ad">Buy now {k}</div>'
    "<article><h1>Title {k} &amp; more</h1><p><b>First {k}, with some words in it.<br>And on.<p>Second&nbsp;paragraph, number {k}, which goes on for a while and has commas.</p><p>Third one.</p></article><footer>&copy; site {k}</footer></body></html>"
)
TEXT = "Title {k} & more\n\nFirst {k}, with some words in it. And on.\n\nSecond paragraph, number {k}, which goes on for a while and has commas.\n\nThird one."


@pytest.fixture(scope="module")
def model():
    return H.Extractor([PAGE.replace("{k}", str(k)) for k in range(60)])


def test_articles(model):
    pages = [PAGE.replace("{k}", str(k)) for k in range(100, 130)]
    assert model.texts(pages) == [TEXT.replace("{k}", str(k)) for k in range(100, 130)]


@pytest.mark.parametrize(
    "extra",
    ['<aside class="sidebar"><p>Most read of all the stories here</p></aside>', '<div class="cookie notice"><p>We use cookies, accept them please.</p></div>', '<form action="/s"><label>Search for it</label><input name="q"></form>',
     '<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked it a lot, thanks for it.</p></div></section>', "<header><h2>The Daily Site</h2></header>", "<style>p{}</style><noscript>Turn it on</noscript>"],
)
def test_what_surrounds_articles_stays_out(model, extra):
    page = PAGE.replace("{k}", "7")
    assert model.texts([page.replace("<article>", extra + "<article>"), page.replace("</p></article>", "</p>" + extra + "</article>")]) == [TEXT.replace("{k}", "7")] * 2


def test_decoding_never_contradicts():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        parent = [-1, *(int(rng.integers(0, k)) for k in range(1, n))]
        keep = H.decode(parent, rng.normal(0, 4, n), rng.integers(0, 50, n).astype(float))
        for k in range(1, n):  # once out, always out: a kept element's ancestors are kept up to where the article begins
            chain, p = [keep[k]], parent[k]
            while p >= 0:
                chain.append(keep[p])
                p = parent[p]
            assert "".join("1" if c else "0" for c in chain).strip("0").count("01") == 0


def test_elements_without_an_end_lose_nothing(model):
    page = PAGE.replace("{k}", "9")
    for extra in ("<svg width=1/>", '<iframe src="x"/>', "<button>", "<select/>", "<object data=x>"):
        assert model.texts([page.replace("<p>Third", extra + "<p>Third")]) == [TEXT.replace("{k}", "9")], extra


@pytest.mark.parametrize("n", [63, 64, 65, 400])
def test_many_siblings(model, n):
    texts = [f"This is paragraph {k} of a long article, with a comma." for k in range(n)]
    page = PAGE.replace("{k}", "1").replace("<p>Third one.</p>", "".join(f"<p>{t}</p>" for t in texts))
    assert model.texts([page])[0] == "\n\n".join([*TEXT.replace("{k}", "1").split("\n\n")[:-1], *texts])
    parsed = H.Page(page)
    place = H.features(parsed, model.odds)[0][:, 17]
    mates = [k for k in range(len(parsed.tag)) if parsed.tag[parsed.parent[k]] == "article" and k]
    assert np.allclose(place[mates], np.arange(len(mates)) / len(mates))


def test_very_long_pages(model):
    text = "word, " * 60_000
    assert model.texts([PAGE.replace("{k}", "1").replace("Third one.", text)])[0].endswith(text.strip())


def test_whole_query_against_articles(spark, tmp_path):
    """The registered query over a table of its own: learning and extraction together give the articles back."""
    from flowloom.llm import queries

    rows = [(k, f"http://x/{k}", PAGE.replace("{k}", str(k))) for k in range(80)] + [(80, "u", None), (81, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in queries.op4_boosted_html_text(spark, str(tmp_path)).collect()}
    want = {k: TEXT.replace("{k}", str(k)) for k in range(80)} | {80: "", 81: ""}
    assert {k: r.text for k, r in got.items()} == want and all(r.n_chars == len(want[k]) for k, r in got.items())


def test_malformed_pages(model):
    for page in ("", "   ", "no markup at all", "<", "<p", '<a title="never closed>text', "</div></p>", "<!-- open", "<script>var x", "<p>" * 3000, "<b><i><p>x</b></i>", "&amp;&#0;&bogus;"):
        assert isinstance(model.texts([page])[0], str)
    assert model.texts([None, ""]) == ["", ""]


def test_query_columns(spark, model):
    rows = spark.createDataFrame([(1, "u", PAGE.replace("{k}", "5"), 1), (2, None, None, 2), (None, "v", "", 3), (1, "u", PAGE.replace("{k}", "5"), 1)], "page_id long, url string, html string, text int")
    got = H.extract(rows, model).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted([(1, t := TEXT.replace("{k}", "5"), len(t))] * 2 + [(2, "", 0), (0, "", 0)])
    assert H.extract(rows.limit(0), model).count() == 0
    assert {r.text for r in H.extract(rows, H.fit(rows.limit(0))).collect()} == {""}


HELD = [
    "<h2>A heading in between</h2>", "<ul><li>First item here</li><li>Second item here</li></ul>", "<ol><li>Step one of it</li><li>Step two of it</li></ol>",
    "<table><tr><th>Name of it</th><td>Value of it</td></tr><tr><th>Other name</th><td>Other value</td></tr></table>", "<blockquote><p>As someone said about it, once.</p></blockquote>", "<blockquote>As someone said once</blockquote>",
    "<figure><img src='x.png'><figcaption>What the picture shows</figcaption></figure>", "<div>Plain text in a division, without more.</div>", "<div class='wide'><p>A paragraph in a division.</p></div>",
    "<section><h2>Part two of it</h2><p>What part two says, at some length.</p></section>", "<dl><dt>A term here</dt><dd>What the term means</dd></dl>", "<pre>some code here</pre>", "<p>Words <span class='hl'>and more words</span> and <a href='/x' class='l'>a link</a> here.</p>",
]


@pytest.mark.parametrize("held", HELD)
def test_what_articles_hold_stays_in(model, held):
    import html
    import re

    blocks = [" ".join(html.unescape(re.sub(r"</?(?:span|a|b)\b[^>]*>|<img[^>]*>", "", t)).split()) for t in re.split(r"</?(?:h2|ul|ol|li|table|tr|th|td|blockquote|p|figure|figcaption|div|section|dl|dt|dd|pre)\b[^>]*>", held)]
    for k, mark in ((3, "<p>Second"), (8, "<p>Third"), (12, "</article>")):
        want = TEXT.replace("{k}", str(k)).split("\n\n")
        at = {"<p>Second": 2, "<p>Third": 3, "</article>": 4}[mark]
        got = model.texts([PAGE.replace("{k}", str(k)).replace(mark, held + mark)])[0]
        assert got == "\n\n".join([*want[:at], *(b for b in blocks if b), *want[at:]])


@pytest.mark.parametrize("advert", ['<span class="ad sponsored">Buy this thing now</span>', '<a class="share social" href="/s">Share this</a>', '<small class="copyright">All rights reserved by us</small>', '<span class="promo">Only today</span>'])
def test_inline_adverts_stay_out(model, advert):
    for mark in ("<p>Third one.", "<p>Second&nbsp;paragraph, number {k}, which"):
        page = PAGE.replace(mark, mark + " " + advert).replace("{k}", "5")
        assert model.texts([page])[0].split() == TEXT.replace("{k}", "5").split()


@pytest.mark.parametrize(
    "hostile",
    ["<a " * 350_000, '<a title="x ' * 90_000, "<div>" * 100_000 + "</x>" * 100_000, "<h2>" * 250_000, "<p><li>" + "<h2>" * 250_000, "<b>" * 100_000 + "<p>" * 100_000, '<a "' * 250_000 + ">", "<a '\"> " * 150_000, "<!--" * 250_000, "<!-- >" * 150_000,
     "<script>" * 120_000, "</script " * 110_000, "<" * 1_000_000, "<!" * 500_000, "&amp" * 250_000, "<a class=" * 110_000 + ">", "<span class=x>" * 70_000],
)
def test_hostile_markup_takes_linear_time(hostile):
    import time

    began = time.perf_counter()
    H.Page(hostile)
    assert time.perf_counter() - began < 4  # about 1 MB each; twice what a slow machine takes
