"""Main text of pages."""

import html
import math
import re
import time

import pytest

from ingestctl.llm import html_text as H
from tests.conftest import rows

DIR = "/root/testdata/sf0.01"

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>"</p>"</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>
<div class="cookie-notice">We use cookies, a long notice about what we do with them and why we do.</div>
%s
<aside><p>Related reading that is long enough to look like text of its own, really.</p></aside>
<div id="comments"><p>Nice post, I read all of it and I would like to say so at length.</p></div>
<form><label>Mail</label><input name=m><button>Go</button></form><footer>&copy; Site</footer></body></html>"""
ARTICLE = "<h1>A &amp; B</h1><p>First   paragraph &lt;here&gt;<br>and on.<p>Second with <a href=x>a link</a>.<ul><li>one<li>two</ul>"
TEXT = "A & B\nFirst paragraph <here> and on.\nSecond with a link.\none\ntwo"


def test_marked_up_article():
    assert H.main_text(PAGE % f"<article>{ARTICLE}</article>") == TEXT
    assert H.main_text(PAGE % f'<main class="with-sidebar"><div>{ARTICLE}</div></main>') == TEXT
    assert H.main_text(PAGE % f'<div class="wrap sidebar"><article>{ARTICLE}<div class="ad">Buy</div></article></div>') == TEXT


def test_plain_divisions():
    long = "".join(f"<p>Paragraph {i} with quite a lot of words in it, as articles have.</p>" for i in range(6))
    expected = "\n".join(["Head", *(f"Paragraph {i} with quite a lot of words in it, as articles have." for i in range(6))])
    assert H.main_text(PAGE % f"<div><h1>Head</h1>{long}</div>") == expected


def test_odd_pages():
    for page, text in {
        "": "",
        "   ": "",
        "plain text": "plain text",
        "<p>open": "open",
        "</p></div>": "",
        "<article></article>": "",
        "<article>a<!-- b --><script>c</script>d</article>": "ad",
        "<article><p>x&nbsp;&nbsp;y&#x41;&eacute;</p></article>": "x yAé",
        "<article><table><tr><td>a<td>b<tr><td>c</table></article>": "a b\nc",
        '<article><p title="a > b">t</p></article>': "t",
    }.items():
        assert H.main_text(page) == text, page


def test_deep_and_hostile_pages_take_linear_time():
    began = time.monotonic()
    assert H.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    H.main_text("<a href='" * 2_000)
    H.main_text("<" * 100_000)
    assert len(H.main_text("<article>" + "<p>word word</p>" * 20_000)) == 20_000 * 10 - 1
    assert time.monotonic() - began < 30


def test_given_pages(spark):
    """Here the main text is all that the article element holds."""
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    got = {r["page_id"]: r for r in H.extract(pages).collect()}
    given = pages.collect()
    assert len(got) == len(given)
    for page in given:
        inside = re.search(r"<article>(.*?)</article>", page["html"], re.DOTALL)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        expected = "\n".join(b for b in blocks if b)
        row = got[page["page_id"]]
        assert (row["url"], row["text"], row["n_chars"]) == (page["url"], expected, len(expected))


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    cases = [(1, None, None, "a", "b"), (1, None, None, "a", "b"), (None, "u", "<p>x</p>", "a", "b"), (2, "u", "", None, None)]
    frame = spark.createDataFrame(cases, schema)
    assert rows(H.extract(frame)) == sorted([(1, None, "", 0)] * 2 + [(None, "u", "x", 1), (2, "u", "", 0)], key=repr)
    assert rows(H.extract(spark.createDataFrame([], schema))) == []


def words(n, of="paragraph"):
    return "".join(f"<p>{' '.join([of] * 60)}</p>" for _ in range(n))


def test_dense_parts_beside_the_article():
    for page, size in {
        f"<body><main><article>{words(4)}</article><section>{words(2)}</section></main></body>": 360,
        f"<body><article>{words(4)}</article><article>{words(3)}</article></body>": 420,
        f"<body><article>{words(3)}<article>{words(4)}</article></article></body>": 420,
        f"<body><div>{words(4)}</div><div>{words(2)}</div></body>": 360,
        f"<body><div>{words(4)}</div><div><a href=x>{'link ' * 60}</a><a href=y>link</a></div></body>": 240,
    }.items():
        assert len(H.main_text(page).split()) == size, page


def test_partial_marks_inside_an_article_need_a_second_sign():
    def kept(inner):
        return "extra" in H.main_text(f"<body><article>{words(3)}{inner}</article></body>")

    extra = words(1, "extra")
    assert kept(f'<div class="related-work">{extra}</div>') and kept(f'<div class="notice-period">{extra}</div>')
    assert not kept(f'<div class="related-work"><a href=x>{extra}</a></div>')
    assert not kept(f'<div class="subscribe-today">{extra}<input name=m></div>')
    assert not kept(f'<div class="related-posts">{extra}</div>') and not kept(f'<div id="comment-by-reader">{extra}</div>')
    assert not kept(f'<div class="ad">{extra}</div>') and not kept(f"<div hidden>{extra}</div>")


def direct_density(page, i):
    """The formula by walking an element's descendants, nothing carried over."""
    def below(j):
        return [k for k in range(j + 1, len(page.tags)) if j in ancestors(k) and not page.out[k]]

    def ancestors(k):
        found = []
        while k:
            k = page.parents[k]
            found.append(k)
        return found

    def linked(k):
        return any(page.tags[a] == "a" for a in [k, *ancestors(k)])

    def sizes(j):
        within = {j, *below(j)}
        parts = [(k, len("".join(t.split()))) for k, t in page.parts if t and k in within and not page.out[k]]
        return sum(n for _, n in parts), sum(n for k, n in parts if linked(k))

    if page.out[i]:
        return 0.0
    c, lc = sizes(i)
    if not c:
        return 0.0
    t, lt = max(1, len(below(i))), max(1, sum(page.tags[k] == "a" for k in below(i)))
    cb, lcb = sizes(page.tags.index("body") if "body" in page.tags else 0)
    inner = c / max(1, lc) * t / lt
    if inner <= 1:
        return 0.0
    return max(0.0, c / t * math.log(inner) / math.log(math.log(c / max(1, c - lc) * lc + lcb / max(1, cb) * c + math.e + 1)))


def test_densities_and_threshold_directly(spark):
    given = [r["html"] for r in spark.read.parquet(f"{DIR}/pages.parquet").limit(5).collect()]
    plain = f"<body><div>{words(4)}<a href=x>more</a></div><div>{words(2)}</div><ul><li><a>b</a><li>c</ul></body>"
    for source in [*given, plain, PAGE % f"<div>{ARTICLE}</div>", "<p>open", ""]:
        page = H.parse(source)
        density = H.densities(page)
        assert density == pytest.approx([direct_density(page, i) for i in range(len(page.tags))])
        sums = [sum(d for j, d in enumerate(density) if j and page.parents[j] == i) for i in range(len(density))]
        assert H.density_sums(page, density) == pytest.approx(sums)
        parts = H.dense_parts(page)
        if parts:
            best = max(range(len(sums)), key=lambda i: (sums[i], density[i], -i))
            path = H._path(page, best)
            assert best in parts
            for i in range(1, len(density)):
                beside = page.parents[i] in path[1:] and i not in path and density[i] >= min(density[j] for j in path) and density[i] > 0
                assert (i in parts) == (beside or i == best)
