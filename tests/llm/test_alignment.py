"""Tokenizer alignment against a plain version: whole texts through the libraries, byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from shotloom.llm import alignment
from shotloom.llm.common import tokenizer_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [
    None, "", " ", "  lead", "trail  ", "a\n b", "a \nb", " \n ", "▁x", "x ▁ y", "a ▁b", "😀 😀😀", "a b 　c", "\x00 \x1c x \x85 y", "don't 's it's", "<|endoftext|> <s> </s> <unk>", "é" * 50, "漢字 漢 字",
    "a" * 5000, "​ x ᠎ y z", "é ́x", "﻿q", " \t x\t y", "ﬁ ½ Ａ", "１２ ３", "\r\n\r\n a", "َ ُ x", "👩‍👩‍👧 k", "the the the", "the the the",
]


@pytest.fixture(scope="module")
def aligner():
    return alignment.model(tokenizer_path(A), tokenizer_path(B))


def plain(m, text):
    """(groups, n_a, n_b, n_groups, linked id pairs) from tokens' decoded bytes alone."""
    nothing = ("", 0, 0, 0, [])
    if not text:
        return nothing
    raw = (" " + text).encode()
    a, b = m.a.encode(" " + text, add_special_tokens=False).ids, m.b.encode(text)
    if b"".join(m.a_bytes[i] for i in a) != raw or b"".join(m.b_bytes[i] for i in b) != raw:
        return nothing
    of_a, of_b = [], []  # the token of each byte
    for k, i in enumerate(a):
        of_a += [k] * len(m.a_bytes[i])
    for k, i in enumerate(b):
        of_b += [k] * len(m.b_bytes[i])
    groups, links, start = [], [], 0
    for at in range(len(raw)):
        last = at + 1 == len(raw)
        if at == 0 or (of_a[at], of_b[at]) != (of_a[at - 1], of_b[at - 1]):
            links.append((a[of_a[at]], b[of_b[at]]))
        if last or (of_a[at] != of_a[at + 1] and of_b[at] != of_b[at + 1]):
            groups.append(",".join(str(a[k]) for k in range(of_a[start], of_a[at] + 1)) + "|" + ",".join(str(b[k]) for k in range(of_b[start], of_b[at] + 1)))
            start = at + 1
    return ";".join(groups), len(a), len(b), len(groups), links


def plain_table(m, rows):
    told = [(i, *plain(m, t)) for i, t in rows]
    count = Counter(p for *_, links in told for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted(
        (i, n_a, n_b, n_groups, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for i, groups, n_a, n_b, n_groups, links in told
    )


def scored(docs):
    out = alignment.align_scored(docs, digest=True)
    return sorted(tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(" \n\ta'b.1é漢😀 \x85ſK▁") for _ in range(r.randint(1, 40))) for _ in range(n)]


def test_words_are_aligned_as_in_whole_texts(aligner):
    texts = ODD + random_texts(1500, 3)
    for text, (groups, links, n_a) in zip(texts, aligner.align(texts), strict=True):
        p = plain(aligner, text)
        assert (groups, n_a) == p[:2]
        assert sorted(divmod(x, len(aligner.b_bytes)) for x in links.tolist()) == sorted(p[4])
        assert groups.count("|") == p[3] and len(links) + p[3] - n_a == p[2]


def test_spans_are_refined_inside_characters(aligner):
    a, a_end, b, b_end, good = aligner.spans("😀漢 é")
    raw = " 😀漢 é".encode()
    assert good and a_end[-1] == b_end[-1] == len(raw)
    assert len(set(a_end.tolist())) == len(a) and len(set(b_end.tolist())) == len(b)
    assert any(not _whole(raw[:e]) for e in a_end.tolist())  # a token that ends inside a character


def _whole(data):
    try:
        data.decode()
        return True
    except UnicodeDecodeError:
        return False


def test_forgotten_words_are_learned_again(aligner, monkeypatch):
    texts = random_texts(300, 9) + ["one two three " * 5] * 3
    want = [(g, n, x.tolist()) for g, x, n in aligner.align(texts)]
    monkeypatch.setattr(alignment, "KEPT_BYTES", 2000)
    small = alignment.Aligner(tokenizer_path(A), tokenizer_path(B))
    got = [row for k in range(0, len(texts), 7) for row in small.align(texts[k : k + 7])]
    assert [(g, n, x.tolist()) for g, x, n in got] == want
    assert len(small.young) < 50


def test_scores_cover_the_corpus(spark, aligner):
    rows = [(k % 50, t) for k, t in enumerate(ODD + random_texts(60, 5))]
    docs = spark.createDataFrame([(t, i, 1, "x") for i, t in rows], "text string, doc_id long, n_a int, pairs string").repartition(3)
    assert scored(docs) == plain_table(aligner, rows)


def test_counted_pairs_in_slices(spark, aligner):
    rows = list(enumerate(ODD + random_texts(40, 6)))
    written = alignment.materialize(alignment.align(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("row", alignment.F.monotonically_increasing_id()))
    counts = alignment.materialize(alignment.pair_counts(written, len(aligner.b_bytes)))
    one, many = (sorted((r.doc_id, r.n_best, r.count_sum) for r in alignment.scored(written, counts, size).collect()) for size in (10**6, 40))
    assert one == many and any(c for _, _, c in one)


def test_documents_of_the_table(spark, aligner):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert scored(docs) == plain_table(aligner, [(r.doc_id, r.text) for r in docs.collect()])


def test_real_groups_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    row = alignment.align_scored(docs).first()
    assert row.groups.count("|") == row.n_groups and row.n_links >= row.n_groups
    assert alignment.align_scored(docs.where("false"), digest=True).count() == 0
    assert alignment.align_scored(spark.createDataFrame([(1, None)], "doc_id long, text string"), digest=True).first().groups_sha256 == ""
