"""HTML extraction on a second set of layouts, whose wording stands in no list of the module."""

import re

import pytest

from shotloom.llm import html_extract

SF = "/root/testdata/sf0.01"
HEAD = "How the mill got its wheel back"
BODY = [
    "When the flood of that spring carried the wheel away, the miller sat down on the wall and did not speak for an hour.",
    "It had turned for two hundred years, through three wars and a fire, and nobody alive had ever seen the river without it.",
    "The carpenters of four villages came to measure the axle, and each of them went home with a different number.",
    "So they waited.",
    "Only in autumn, when the water was low, did a boy find the old drawings behind a board in the attic of the school.",
    "The new wheel was hung on a Sunday, and the whole valley stood on the bridge to hear the first stone move.",
]
P = "".join(f"<p>{t}</p>" for t in BODY)
LAYOUTS = {
    "museum": f"<body><header><nav><a href=/v>Plan your visit</a><a href=/t>Tickets</a><a href=/k>For schools</a></nav></header><article><h1>{HEAD}</h1>{P}</article><footer><p>Registered charity no. 11200</p><p><a href=/w>Volunteering</a></p></footer></body>",
    "town": f'<body><ul id="topnav"><li><a href=/r>Residents</a><li><a href=/b>Bins and recycling</a></ul><main><h2>{HEAD}</h2>{P}</main><div id="footer">Town hall, Market Square, open weekdays</div></body>',
    "host": f'<body><div class="content"><h1>{HEAD}</h1>{P}</div><div class="foot">Hosted by Northern Web Ltd</div></body>',
    "keep on": f'<body><div class="article-body"><h1>{HEAD}</h1>{P}</div><aside><p>Keep exploring</p><a href=/1>Bridges of the upper valley</a><a href=/2>A school with one pupil</a></aside></body>',
    "consent": f'<body><div id="consent-layer"><p>This page stores small files on your device. Choose what you permit.</p><a href=/o>Options</a></div><div class="post"><h1>{HEAD}</h1>{P}</div></body>',
    "readers": f'<body><article><h1>{HEAD}</h1>{P}</article><section id="comments"><div class="comment"><p>My grandfather carried one of those beams up the hill.</p></div><div class="comment"><p>The drawings hang in the school now, go and see them!</p></div></section></body>',
    "letters": f'<body><div class="newsletter-box">A letter every Friday, free of charge.</div><div class="story-text"><h1>{HEAD}</h1>{P}</div></body>',
    "old table": f"<body><table><tr><td><a href=/g>Guest book</a> <a href=/l>Link list</a></td></tr><tr><td><h1>{HEAD}</h1>{P}</td></tr></table></body>",
    "plain": f"<body><div><a href=/u>Upwards</a></div><div><h1>{HEAD}</h1>{P}</div></body>",
    "sales": f'<body><div class="page-content"><h1>{HEAD}</h1><p>{BODY[0]}</p><div class="advert">New boots for wet paths, from the makers of the old ones</div>{"".join(f"<p>{t}</p>" for t in BODY[1:])}</div></body>',
    "buttons": f'<body><div role="navigation"><a href=/m>Maps</a><a href=/y>By year</a></div><div role="main"><h1>{HEAD}</h1>{P}<button>Save for later</button><select><option>Large type<option>Small type</select></div></body>',
    "quoted": f'<body><div class="breadcrumb"><a href=/v>Valley</a> / <a href=/v/m>Mills</a></div><div class="entry"><h1>{HEAD}</h1><blockquote><p>{BODY[0]}</p></blockquote>{"".join(f"<p>{t}</p>" for t in BODY[1:])}</div><div class="pager"><a href=/13>Thirteen</a></div></body>',
}



def test_wording_is_not_the_modules():
    known = {w.lower() for w in html_extract.WORDING}
    for page in LAYOUTS.values():
        assert not known & {t.strip().lower() for t in re.split("<[^>]*>", page)}


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
        print(list(LAYOUTS)[r.page_id], good, "of", len(want), "wrong:", [t for t in got if t not in want], "lost:", [t for t in want if t not in got])
    recall, precision = hit / total, hit / (hit + wrong)
    print(f"recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9
