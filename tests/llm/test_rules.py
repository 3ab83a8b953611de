"""License scans and quality rules against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest
from oracle import compare

from shotloom.llm import licenses, quality

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
TEXTS = [
    None, "", "   ", "MIT License", "x MIT\nlicense, Apache-License; GNU General Public License mit license", "KMIT License lİcense mit LICENSE",
    "nothing here " * 5000, "mit license " * 3000, MIT, MIT.replace("without restriction", ""), "a b c d e " * 30, "foo ## bar\nfoo ## bar\n\n\nfoo ## bar\n one", "MIT License",
]


def base_places(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return words, sorted(found)


def documents(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, score int")


def check_scan(texts, rows):
    assert len(rows) == len(texts)
    for r in rows:
        words, found = base_places(texts[r.doc_id])
        assert r.n_words == len(words)
        assert r.n_base == len(found)
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_scan_small(spark):
    rows = licenses.scan(documents(spark, TEXTS)).collect()
    check_scan(TEXTS, rows)
    by = {r.doc_id: r for r in rows}
    assert by[8].labels == "mit" and by[8].score > 0.9
    assert by[9].labels == ""
    assert by[6].labels == "" and by[6].score == 0


def test_scan_empty(spark):
    assert licenses.scan(documents(spark, TEXTS).limit(0)).collect() == []


def test_scan_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_scan(texts, licenses.scan(docs).collect())


def test_scan_runs_no_python(spark):
    plan = licenses.scan(documents(spark, TEXTS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


@pytest.mark.parametrize("text", [*TEXTS, "a\x1fb \x85 c d é", "x\n \nx\n \n", "q w e r t q w e r t y q w e r"])
def test_statistics(text):
    assert tuple(quality.statistics(text)[:5]) == brute(text)


def test_quality(spark):
    docs = documents(spark, TEXTS)
    labels = spark.createDataFrame([(1, 1), (None, 0), (99, 0), (3, None)], "doc_id long, quality int")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        n, chars, symbols, dup, rep = brute(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.kept and r.base_failed)
    assert quality.quality(docs.limit(0), labels).collect() == []


def test_labels_of_repeated_ids(spark):
    """The same trees whatever the order of rows: contradicting labels go, one text of an id is learned from."""
    docs = [(i % 150, ("good plain words of prose here " if i % 2 else "## $$ ## %% && ") * (3 + i % 7) + str(i)) for i in range(400)]
    labels = [(i, i % 2) for i in range(150)] + [(i, 1 - i % 2) for i in range(0, 150, 10)] + [(3, 1)] * 5
    stats = quality.document_statistics(spark.createDataFrame(docs, "doc_id long, text string"))
    grown = []
    for part in (docs, docs[::-1]):
        stats = quality.document_statistics(spark.createDataFrame(part, "doc_id long, text string"))
        trees = quality.train(stats, spark.createDataFrame(labels if part is docs else labels[::-1], "doc_id long, quality int"))
        grown.append((trees.base, trees.threshold.tolist(), trees.value.tolist()))
    assert grown[0] == grown[1] and len(grown[0][1]) > 1


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    out = quality.quality(docs, seen).join(rest, "doc_id").toPandas()
    assert ((out["score"] >= quality.KEEP) == (out["quality"] == 1)).mean() > 0.97


def test_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 2))
    y = ((x[:, 0] - 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.random(2000)) < 0.6).astype(float)
    trees = quality.Trees().grow(x, y, [-1, 0])
    grid = np.linspace(0, 1, 200)
    for other in (0.1, 0.5, 0.9):
        s = trees.scores(np.stack([grid, np.full(200, other)], axis=1))
        assert (np.diff(s) <= 1e-12).all()
    assert ((trees.scores(x) > 0.5) == (y > 0)).mean() > 0.85


def plain_scan(texts):
    """The template labels, said again: rarest words, one alignment at a time."""
    index = licenses._postings()
    docs = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    seen = Counter(w for d in docs for w in set(d) if w in index)
    idf = {w: np.log((len(docs) + 2) / (seen[w] + 1)) + 1e-6 for w in index}
    out = []
    for d in docs:
        known = sorted({w for w in d if w in index})
        said = f" {' '.join(d)} "
        named = {}
        for label, (_, phrases) in licenses.TEMPLATES.items():
            posts = [(w, at) for w in known for name, at in index[w] if name == label]
            shifts = {}
            for i, w in enumerate(d):
                for v, at in posts:
                    if v == w:
                        hits, got = shifts.get(i - at, (0, 0.0))
                        shifts[i - at] = hits + 1, got + idf[w]
            good = [got for hits, got in shifts.values() if hits >= licenses.LEAST_HITS]
            if good and all(f" {p} " in said for p in phrases):
                score = min(1.0, max(good) / sum(idf[w] for w, _ in posts))
                if score >= licenses.LEAST_SCORE:
                    named[label] = score
        out.append(named)
    return out


def test_templates_against_plain_version(spark):
    import random

    r = random.Random(4)
    texts = list(TEXTS)
    for text, _ in licenses.TEMPLATES.values():
        words = text.split()
        texts.append(f"some prose before. {text.upper()}")
        texts.append(" ".join(words[: len(words) // 2]))
        texts.append(" ".join(w for w in words if r.random() > 0.1))
        texts.append(" ".join("filler" if r.random() < 0.15 else w for w in words) + " the end of it")
        texts.append(" ".join(r.sample(words, len(words))))
    texts.append(" ".join(t for t, _ in licenses.TEMPLATES.values()))
    want = plain_scan(texts)
    for row in licenses.scan(documents(spark, texts)).collect():
        base = set(filter(None, row.base_labels.split(",")))
        assert row.labels == ",".join(sorted(base | set(want[row.doc_id])))
        assert row.score == pytest.approx(1.0 if base else max(want[row.doc_id].values(), default=0.0))
    assert sum(map(bool, want)) > 12


def test_templates_against_sql(spark, tmp_path):
    texts = [*TEXTS, *(f"before {t.upper()} after" for t, _ in licenses.TEMPLATES.values()), " ".join(t for t, _ in licenses.TEMPLATES.values()), "KMIT License mit license é mit License"]
    documents(spark, texts).drop("words", "score").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert compare(licenses.scan(spark.read.parquet(str(tmp_path / "documents.parquet"))), licenses.oracle_sql(), str(tmp_path)) == len(texts)
