"""Nothing is left out: cases that a cut of words, blocks or labels would lose."""

import pytest

from shotloom.llm import html_blocks, html_extract, langid, licenses


def test_every_notice_of_a_file_is_named(spark):
    texts, want = [], []
    names = sorted(licenses.TEMPLATES)
    for some in [names, *([a, b] for a in names for b in names if a < b)]:
        texts.append(" . and more prose between them . ".join(licenses.TEMPLATES[x][0] for x in some))
        want.append(set(some))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in licenses.scan(docs).collect():
        assert want[row.doc_id] <= set(row.labels.split(",")), (row.doc_id, row.labels)


def test_digits_and_capitals_count_to_the_end_of_a_block():
    block = html_blocks.Block([], "a" * 200 + "7" * 100 + "B" * 100, 0.0)
    measures = html_extract._measures(block, 0, 1)
    assert measures[4:6] == [0.25, 0.25]


def test_training_reaches_the_end_of_a_page():
    body = "".join(f"<p>Paragraph {k} of a long article.</p>" for k in range(301))
    got = html_extract.training_pages([f"<html><body><article>{body}</article><footer><p>The footer.</p></footer></body></html>"])
    page = []
    for s, y in got:  # the page as it is comes first
        page.append((s, y))
        if sum(len(s) for s, _ in page) >= 302:
            break
    assert sum(len(s) for s, _ in page) == 302
    assert all(len(s) == len(y) <= html_extract.MOST_TRAINED for s, y in got)
    assert [float(y.sum()) for _, y in page] == [len(y) for _, y in page[:-1]] + [len(page[-1][1]) - 1]
    places = [float(x) for s, _ in page for x in s.measures[:, 3]]
    assert places == sorted(places) and (places[0], places[-1]) == (0, 1) and places.count(1.0) == 1


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>t</title><meta charset=x><p>one<p>two", ["one", "two"]),
        ("<html><head><style>a</style><body><p>one</body></html>", ["one"]),
        ("<head><template><p>no</p></template><script>x</script></head><p>one", ["one"]),
        *((f"<div><p>one<{t}>two</div><p>three</p>", ["onetwo", "three"]) for t in "object svg math canvas audio video template".split()),
        ("<div><svg><path d=x><text>two</text><p>three</p></div><p>four", ["two", "three", "four"]),
        ("<svg><path d=x>one", ["one"]),
        ("<template>one<p>two", ["one", "two"]),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> b", ["a x=1 b"]),
        ("<p>a <object data=x>fallback</object> b", ["a fallback b"]),
        ("<div>a<template><div><li>no</div></template>b<svg><foreignObject><p>no</p></foreignObject></svg>c</div>", ["abc"]),
        ("<div>a<svg><svg>no</svg>no</svg>b<svg/>c</div><div>d<svg>e</div><div>f<svg>no</svg>g</div>", ["abc", "de", "fg"]),
    ],
)
def test_unclosed_elements_lose_no_text(page, want):
    assert [b.text for b in html_blocks.read_blocks(page)] == want


def test_every_label_is_learned(spark):
    labels = [f"l{k:03}" for k in range(302)]
    rows = [(k, f"word{chr(0x4E00 + k) * 3}", x) for k, x in enumerate(labels)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == labels
