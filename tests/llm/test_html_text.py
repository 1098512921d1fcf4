import math
import random
import time

import pytest

from folium.llm import html_text as H

PARAGRAPHS = ["Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda.", "Second paragraph, as long as the first one is and more."]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WANT = "\n\n".join(PARAGRAPHS)


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain  text\nonly", "plain text only"),
        ("<p>a", "a"),
        ("<b>x</b> y <i>z", "x y z"),
        ("<div><p>a<div>b</p>c</div>", "a\n\nbc"),
        ("</p></div>x</b>", "x"),
        ("<p title='a>b\">c'>d<p title=\"e>x</p>", "d\n\nx"),
        ("<!-- <p>no</p> --><p>yes<!-- open", "yes"),
        ("<script>if (a<b) x='</p>'</script><style>p{}</style><p>only", "only"),
        ("<p>a&amp;b &lt;p&gt; &#233;&nbsp;c&unknown;<br>d", "a&b <p> é c&unknown; d"),
    ],
)
def test_small_pages(html, text):
    assert H.main_text(html) == text


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main><div>{}</div></main>", "<div class='has-sidebar'><div id=content>{}</div></div>"])
def test_everything_around_the_article_goes(frame):
    page = (
        "<!DOCTYPE html><html><head><title>T</title></head><body class='no-sidebar'>"
        "<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class='ad'>Buy this now, it is cheap and good and here.</div><div class='cookie-notice'>We use cookies.</div>"
        + frame.format("<h1>Title</h1>" + BODY + "<div class='share-buttons'>Share</div><form>mail<input></form>"
                       "<section class=comments><article><p>Nice, I like this post very much, thank you.</p></article></section>")
        + "<aside>More</aside><div class=sidebar><p>Some side text of some length.</p></div><footer>(c) us</footer>"
    )
    assert H.main_text(page) == "Title\n\n" + WANT


@pytest.mark.parametrize(
    "odd", ["<svg class=i />", "<math/>", "<canvas>", "<object data=x>", "<noscript>", "<svg><svg></svg><text>no</text></svg>", "<canvas><canvas></canvas>"]
)
def test_elements_without_content_end_where_they_do(odd):
    assert H.main_text(f"<article><p>{PARAGRAPHS[0]}</p>{odd}<p>{PARAGRAPHS[1]}</p></article>") == WANT
    assert H.main_text(f"<article>{odd}{BODY}<svg>no</svg></article>") == WANT


def test_article_in_a_form_or_in_two_elements():
    page = f"<form id=aspnet action=/><div>{BODY}</div></form><form>mail <select><option>a</select></form>"
    assert H.main_text(page.replace("action=/>", "action='/'>")) == WANT
    assert H.main_text("".join(f"<article><p>{p}</p></article>" for p in PARAGRAPHS)) == WANT
    assert H.main_text(f"<div class='content no-sidebar'>{BODY}</div>") == WANT


def test_many_open_elements_take_linear_time():
    assert H.main_text("<canvas>" * 30000 + "<title>" * 30000 + "x") == "x"


def test_unclosed_and_deep_pages():
    assert H.main_text("<article><h1>T</h1><p><b>One.<br><p>Two  words.</article><footer>f") == "T\n\nOne.\n\nTwo words."
    assert H.main_text("<div>" * 20000 + "x") == "x"
    assert H.main_text("<p>" + "long words " * 100000) == ("long words " * 100000).strip()
    assert H.main_text("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>") == "a\n\nb\n\nc\n\nd\n\ne"


def test_frames(spark):
    rows = [(1, "u", BODY, "clash"), (1, "u", BODY, ""), (None, None, None, ""), (3, "v", "", "")]
    got = H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [
        (0, "", 0), (1, WANT, len(WANT)), (1, WANT, len(WANT)), (3, "", 0),
    ]


LONG = [f"Paragraph {i} of the article, with words enough to be read as a text of its own, and a few more." for i in range(5)]
NAMED = (
    "overflow-hidden", "elementor-widget-wrap", "text-widget", "post-share-wrap", "notice-board", "related-story",
    "hidden-xs entry", "ad-free content", "alert-body",
)


@pytest.mark.parametrize("name", NAMED)
def test_a_class_word_around_the_core_says_nothing(name):
    article = "".join(f"<p>{p}</p>" for p in LONG)
    tail = "<div><p>short tail text.</p></div>"
    for page in (f"<div class='{name}'>{article}</div>{tail}", f"<div>{''.join(f'<div class={chr(34)}{name}{chr(34)}><p>{p}</p></div>' for p in LONG)}</div>{tail}"):
        got = H.main_text(f"<html><body>{page}</body></html>")
        assert all(p in got for p in LONG)


@pytest.mark.parametrize("unit", ["<a '", "<a", "<a \">\"", "<!", "<script", "</script", "<a <", "<svg '", "<a '\">"])
def test_hostile_markup_takes_linear_time(unit):
    for page in (unit * (1_000_000 // len(unit)), "<script>" + unit * (1_000_000 // len(unit)) + "'\"", unit * (1_000_000 // len(unit)) + ">x"):
        start = time.process_time()
        H.main_text(page)
        assert time.process_time() - start < 10


def test_quotes_that_stay_open_end_at_the_next_bracket():
    assert H.main_text("<p title='x>one</p><p>two") == "one\n\ntwo"
    assert H.main_text("<p title='<b>'>one</p><p title=\"a<b\">two") == "one\n\ntwo"


def random_page(rng, depth=0):
    parts = []
    for _ in range(rng.randrange(1, 4)):
        if depth > 4 or rng.random() < 0.3:
            parts.append("word " * rng.randrange(1, 30))
        else:
            tag = rng.choice(["div", "section", "a", "b", "ul"])
            parts.append(f"<{tag}>{random_page(rng, depth + 1)}</{tag}>")
    return "".join(parts)


def test_densities_equal_a_plain_recomputation():
    rng = random.Random(4)

    def counted(node, linked):
        linked = linked or node.tag == "a"
        c = sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        t, lc, lt = 1, c if linked else 0, 1 if linked else 0
        for p in node.parts:
            if not isinstance(p, str):
                x = counted(p, linked)
                c, t, lc, lt = c + x[0], t + x[1], lc + x[2], lt + x[3]
        return c, t, lc, lt

    def density(node, linked, body):
        c, t, lc, lt = counted(node, linked)
        if not c:
            return 0.0
        base = math.log(c * lc / max(c - lc, 1) + body[2] * c / max(body[0], 1) + math.e)
        return c / t * math.log(max(c * t / (max(lc, 1) * max(lt, 1)), 1.0)) / math.log(max(base, 1.0) + 1.0)

    for _ in range(60):
        top = H.tree(random_page(rng))
        order = H._measure(top)
        body = counted(top, False)
        sums = []
        for node in order:
            above, here = False, node.parent
            while here is not None:
                above, here = above or here.tag == "a", here.parent
            assert math.isclose(node.density, density(node, above, body))
            linked = above or node.tag == "a"
            total = sum(density(p, linked, body) for p in node.parts if not isinstance(p, str))
            assert math.isclose(node.total, total)
            sums.append(total)
        assert math.isclose(H._core(top).total, max(sums))
