"""The pipeline's stages, one by one and together, against plain Python."""

import random
from collections import Counter

from test_dedup import norm, plain_components, plain_fingerprint
from test_texts import check_pieces

import corpus_pipeline
from shotloom.llm.common import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    r = random.Random(3)
    words = {"en": "the of and house river morning people light water under".split(), "fr": "le des maison rivière matin gens lumière sous avec très".split()}
    rows = [(1, None, "en", "s0", None), (2, "1234 5678", "en", "s0", 9), (3, "", None, None, 0)]
    for i in range(10, 250):
        lang = r.choice(["en", "fr"])
        rows.append((i, " ".join(r.choice(words[lang]) + r.choice(["", "s", "en"]) for _ in range(r.randint(30, 90))), lang, f"s{0 if r.random() < 0.5 else r.randint(1, 4)}", 1))
    texts = [x[1] for x in rows[3:]]
    rows += [(1000 + k, texts[k].upper(), "en", "s1", 1) for k in range(20)]
    rows += [(2000 + k, texts[k] + " last", "en", "s2", 1) for k in range(20, 40)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages(spark):
    docs = documents(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and len(set(names)) == 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, before, "unused"))
        assert docs.columns == before.columns
        kept[name] = (before.collect(), docs.collect())

    before, after = kept["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {1, 2, 3}

    before, after = kept["exact_dedup"]
    best = {}
    for r in before:
        best[norm(r.text)] = max(best.get(norm(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(best.values())

    before, after = kept["simhash_near_dedup"]
    before = sorted(before, key=lambda r: r.doc_id)
    of = plain_components([plain_fingerprint(r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({before[c].doc_id for c in of})
    assert len(after) < len(before)

    before, after = kept["source_mixing"]
    copies = Counter(r.doc_id for r in after)
    assert set(copies) == {r.doc_id for r in before} and max(copies.values()) <= 2

    one_each = docs.dropDuplicates(["doc_id"])
    check_pieces({r.doc_id: r.text for r in one_each.collect()}, corpus_pipeline.STAGES[-1][1](spark, one_each, "unused").collect())
    whole = corpus_pipeline.STAGES[-1][1](spark, docs, "unused").toPandas()
    assert whole["length"].sum() == sum(n * t for n, t in ((copies[i], t) for i, t in whole.groupby("doc_id")["doc_tokens"].first().items()))


def test_run(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 100 and corpus_pipeline.ORACLE_SQL is None


def test_odd_columns_and_rows(spark):
    """Extra and clashing columns stay, nulls in any column, ties, a very long text and repeated rows go through."""
    rows = [tuple(r) for r in documents(spark).collect()[:60]] + [(7, "the light of the house " * 20_000, "en", None, None), (None, "river and morning people of the house", None, None, None)]
    rows = [(*r, 1, "c", None, 0.5) for r in [*rows, *rows[-2:], rows[5]]]
    docs = spark.createDataFrame(rows, SCHEMA + ", whole int, __llm_file string, __llm_row long, score double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, "unused"))
        assert docs.columns == before.columns and {tuple(r) for r in docs.collect()} <= {tuple(r) for r in before.collect()}, name
    assert docs.where("length(text) > 100000").count() >= 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "unused").where("doc_tokens > 50000").count() > 10


def test_empty(spark):
    docs = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, "unused"))
    assert docs.count() == 0
