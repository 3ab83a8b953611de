"""HTML extraction on layouts that the tables do not have, written by hand, and on broken markup."""

import time

import numpy as np
import pytest

from shotloom.llm import html_blocks, html_extract

SF = "/root/testdata/sf0.01"
HEAD = "A quiet harbour wakes up"
BODY = [
    "The boats came back before dawn, and the people of the village walked down to the quay to see what the night had brought them.",
    "For thirty years the fishermen have kept a book in which every catch is written down, with the weather and the names of the crew.",
    "Last winter was the hardest that anyone could remember, because the storms did not end until April.",
    "Nobody complained.",
    "In the end the council decided to repair the old wall, which had stood since the war and had protected the houses behind it.",
]
P = "".join(f"<p>{t}</p>" for t in BODY)
LAYOUTS = {
    "semantic": f"<body><header><nav><a href=/>Home</a> <a href=/a>About us</a></nav></header><main><article><h1>{HEAD}</h1>{P}</article></main><aside><h3>Related articles</h3><a href=/x>More boats</a></aside><footer>© 2024 The Harbour Times. All rights reserved.</footer></body>",
    "bare classes": f"<body><div class=a1><a href=/>Home</a><a href=/n>News</a><a href=/c>Contact us</a></div><div class=a2>We use cookies to improve your experience. <a href=/p>Accept all</a></div><div class=b><h1>{HEAD}</h1>{P}</div><div class=a3>Copyright 2023 Example Inc. All rights reserved.</div></body>",
    "table": f"<body><table><tr><td><a href=/>Home</a></td><td><a href=/s>Sitemap</a></td></tr></table><table><tr><td><h2>{HEAD}</h2>{P}</td></tr></table><table><tr><td><a href=/c>Contact us</a> | <a href=/p>Privacy</a></td></tr></table></body>",
    "theme": f'<body><div class="td-header-menu"><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></div><div class="td-post-content"><h1>{HEAD}</h1>{P}<div class="td-post-sharing">Share this <a href=/f>Facebook</a></div></div><div class="td-sub-footer">Powered by WordPress</div></body>',
    "blog": f'<body><div id="top-bar">Sign up for our newsletter</div><div class="entry-content"><h2 class="entry-title">{HEAD}</h2>{P}</div><div class="comments-area"><h3>2 comments</h3><p>I was there in April and the wall was a ruin, thank you for writing about it at last.</p><p>Great article, thanks for sharing!</p></div></body>',
    "divs only": f"<body><div><div><a href=/>Home</a></div><div><a href=/l>Login</a></div></div><div><div>{HEAD}</div>{''.join(f'<div>{t}</div>' for t in BODY)}</div><div><div><a href=/t>Terms of service</a></div><div><a href=/p>Privacy policy</a></div></div></body>",
    "sidebar": f'<body><div class="wrap"><div class="left-sidebar"><h4>Popular posts</h4><ul><li><a href=/1>The old lighthouse and its keeper</a><li><a href=/2>How to mend a net</a></ul></div><div class="main-column"><h1>{HEAD}</h1>{P}</div></div></body>',
    "advert inside": f'<body><div role=navigation><a href=/>Home</a></div><div itemprop=articleBody><h1>{HEAD}</h1><p>{BODY[0]}</p><div class="ad-slot">Advertisement: buy now and save 20%</div>{"".join(f"<p>{t}</p>" for t in BODY[1:])}</div><form><label>Enter your email address</label></form></body>',
    "sections": f'<body><section class="hero-banner">Subscribe now</section><section class="story"><h1>{HEAD}</h1>{"".join(f"<section><p>{t}</p></section>" for t in BODY)}</section><section class="recommended"><p>You may also like</p><p><a href=/n>Nets, ropes and knots</a></p></section></body>',
    "lists": f'<body><ul class=menu><li><a href=/>Home</a></li><li><a href=/f>FAQ</a></li></ul><div class="post"><h1>{HEAD}</h1><ul>{"".join(f"<li>{t}</li>" for t in BODY)}</ul></div><div class="cookie-consent">This site uses cookies <button>Got it</button></div></body>',
    "unclosed": f'<html><head><meta charset=utf-8><title>x</title><div class=nav><a href=/>Home<a href=/a>About us</a></div><div class="content"><h1>{HEAD}</h1>{"".join(f"<p>{t}" for t in BODY)}</div><div class="footer">All rights reserved',
    "mail": f"<body><center><font><a href=/>Home</a></font></center><blockquote><h1>{HEAD}</h1>{P}</blockquote><center>Follow us on social media</center></body>",
}


@pytest.fixture(scope="module")
def labeller(spark):
    return html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_layouts(spark, labeller):
    want = [HEAD, *BODY]
    rows = spark.createDataFrame(list(enumerate(LAYOUTS.values())), "page_id long, html string").selectExpr("page_id", "'u' url", "html")
    hit = wrong = total = 0
    for r in html_extract.extract(rows, labeller).collect():
        got = r.text.split("\n") if r.text else []
        good = sum(t in want for t in got)
        hit, wrong, total = hit + good, wrong + len(got) - good, total + len(want)
        print(list(LAYOUTS)[r.page_id], good, "of", len(want), "wrong:", [t for t in got if t not in want])
    recall, precision = hit / total, hit / (hit + wrong)
    print(f"recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.95 and precision >= 0.95


def test_saved_labeller(labeller, tmp_path):
    labeller.save(str(tmp_path / "m.npz"))
    again = html_extract.Labeller.load(str(tmp_path / "m.npz"))
    s = [html_extract.Sequence(html_blocks.read_blocks(LAYOUTS["theme"]))]
    assert np.array_equal(labeller.scores(s)[0], again.scores(s)[0])


def test_windows_become_rows_and_back():
    for s, _, _ in html_extract.training_windows(LAYOUTS["blog"]):
        t = html_extract.Sequence.from_row(**s.row())
        assert len(s) == len(t) and all(map(np.array_equal, s.paths, t.paths)) and all(map(np.array_equal, s.words, t.words)) and np.array_equal(s.measures, t.measures)


def test_pages_of_one_id_are_sampled(spark, tmp_path):
    """An id that all pages share, or none, does not empty the sample."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(60).selectExpr("CAST(NULL AS LONG) page_id", "url", "html")
    pages.write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    out = html_extract.extract(pages, sample=30).toPandas()
    assert len(out) == 60 and (out["n_chars"] > 0).mean() > 0.9


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><meta charset=utf-8><p>hello world</p>", ["hello world"]),
        ("<p>a</p><object data=x><p>b</p>", ["a", "b"]),
        ("<p data-x=it's>hello brave</p><p>it's new</p>", ["hello brave", "it's new"]),
        ('<a href="foo>link</a> text <a href="bar">z</a>', ["link text z"]),
        ('<p title="<b>a > b</b>">hi</p>', ["hi"]),
        ("<p>a <!-- never <b>closed</b> text</p><p>more", ["a closed text", "more"]),
        ("a < b and c > d </ x> <3 e", ["a < b and c > d </ x> <3 e"]),
        ("<title>t<p>kept", ["t", "kept"]),
    ],
)
def test_odd_markup(page, want):
    got = [b.text for b in html_blocks.read_blocks(page)]
    assert got == want


BROKEN = ["<p title='x", '<p a=">" ', "<!-- a ", "<![CDATA[ ", "<div>x", "<title>", "<svg>", "<template>", "<p a='b>c", "</div>", "<li>x", "<svg><template>a</p>", '<a href="x>y</a> ', "<textarea>x", "<button>x", "<div class=a>x", "<div><center>x", "<center></p>x"]


@pytest.mark.parametrize("unit", BROKEN)
def test_broken_markup_takes_linear_time(unit):
    """CPU time of twice the page against that of the page: a quadratic reader takes four times as long, or sixteen for four."""

    def cpu(size):
        page = unit * (size // len(unit))
        began = time.process_time()
        html_blocks.read_blocks(page)
        html_blocks.read_blocks(page + "'\">")
        return time.process_time() - began

    one, four = (min(cpu(n) for _ in range(2)) for n in (100_000, 400_000))
    assert four < 9 * one + 0.05


def test_deep_nesting_keeps_texts():
    page = "".join(f"<div>{k}" for k in range(500)) + "</div>" * 500 + "end"
    blocks = html_blocks.read_blocks(page)
    assert [b.text for b in blocks] == [*map(str, range(500)), "end"] and max(len(b.path) for b in blocks) == html_blocks.MOST_DEPTH + 1 and blocks[-1].path == ()
    page = "<div>" * 300 + "<article class='post long'><p>in</p></article><p>out</p>" + "</div>" * 300
    inside, outside = html_blocks.read_blocks(page)
    assert {n for e in inside.path for n in (e.tag, *e.names)} >= {"article", "post", "long"} and inside.path[-1].tag == outside.path[-1].tag == "p"
    assert not any(e.tag == "article" for e in outside.path)


@pytest.mark.parametrize("depth", [0, 5, 8, 12, 20, 40, 97, 200])
@pytest.mark.parametrize("wrapper,inner", [("<div>", "<div>"), ('<div class="wrap">', '<article class="post">'), ('<section id=w><div class="box">', "<main>")])
def test_articles_are_kept_at_any_depth(labeller, depth, wrapper, inner):
    closing = "".join(f"</{t[1:].split()[0].rstrip('>')}>" for t in reversed(wrapper.replace("><", "> <").split(" <") if "><" in wrapper else [wrapper]))
    page = f"<html><body>{wrapper * depth}<nav><a href=/>Home</a> <a href=/a>About us</a></nav>{inner}<h1>{HEAD}</h1>{P}</{inner[1:].split()[0].rstrip('>')}>{closing * depth}</body></html>"
    blocks = html_blocks.read_blocks(page)
    score = labeller.scores([html_extract.Sequence(blocks)])[0]
    assert [b.text for b, s in zip(blocks, score, strict=True) if s >= 0.5] == [HEAD, *BODY]


def test_form_parts_are_no_text():
    page = "<p>Before <button>Save for later</button><select><option>One<option>Two</select> after</p><button>Go<p>kept</p>"
    assert [b.text for b in html_blocks.read_blocks(page)] == ["Before after", "Go", "kept"]
