"""Exact dedup, SimHash, components and mixing against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shotloom.llm import common, components, exact_dedup, mixing, simhash

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, source string, digest string, fp int, keep_id string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1, "clash") for i, t, s in rows], SCHEMA)


def norm(text):
    return (text or "").translate(LOWER)


ROWS = [(5, "Same Text", "a"), (9, "same text", "b"), (7, "SAME TEXT", None), (1, None, "a"), (2, "", "a"), (None, "", "a"), (3, "É", "a"), (4, "é", "a"), (6, "other", "a"), (6, "other", "a"), (None, "alone", None), (8, "x " * 40_000, "a"), (10, "X " * 40_000, "a")]


def check_exact(rows, out):
    assert len(out) == len(rows)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    want = Counter((i, max((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)])) for i, t, _ in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out) == want
    assert sum(r.kept for r in out) == len(groups)
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_exact_small(spark):
    out = exact_dedup.exact_groups(documents(spark, ROWS)).collect()
    check_exact(ROWS, out)
    sha = {r.doc_id: r.digest for r in out}
    assert sha[9] == sha[7] == hashlib.sha256(b"same text").hexdigest()
    kept = exact_dedup.keep_first_of_equal(documents(spark, ROWS))
    assert kept.columns == documents(spark, ROWS).columns
    assert Counter(norm(r.text) for r in kept.collect()) == Counter(dict.fromkeys((norm(t) for _, t, _ in ROWS), 1))


def test_exact_when_digests_clash(spark):
    """With a digest of the length only, the check on full bytes must tell the texts apart."""
    rows = [(i, random.Random(i % 7).choice(["aa", "bb", "cc", "ddd", "eee"]), "s") for i in range(60)]
    check_exact(rows, exact_dedup.exact_groups(documents(spark, rows), digest=lambda b: str(len(b))).collect())


def test_exact_over_micro_batches(spark, tmp_path):
    rows = [(i, f"text {i % 10}", "s") for i in range(100)]
    docs = documents(spark, rows).repartition(8)
    docs.write.parquet(str(tmp_path / "d"))
    check_exact(rows, exact_dedup.exact_groups(spark.read.parquet(str(tmp_path / "d")), files_per_batch=1).collect())


def test_exact_second_stream_hits_the_first(spark, tmp_path):
    """A state that lasts: what a later call brings is held against what earlier calls left."""
    first, second = [(i, f"text {i % 5}", "s") for i in range(20)], [(100 + i, f"Text {i}", "s") for i in range(8)]
    docs = []
    for k, rows in enumerate((first, second)):
        documents(spark, rows).repartition(3).write.parquet(str(tmp_path / f"d{k}"))
        docs.append(spark.read.parquet(str(tmp_path / f"d{k}")))
    state = str(tmp_path / "state")
    check_exact(first, exact_dedup.exact_groups(docs[0], state_path=state, files_per_batch=1).collect())
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs[1], state_path=state, earlier=docs[0], files_per_batch=1).collect()}
    assert got == {100 + i: (100 + i, 5 if i < 5 else 1, True) for i in range(8)}
    assert len(list((tmp_path / "state" / "updates").iterdir())) > 4  # micro-batches of both calls


def test_exact_clash_with_an_earlier_load(spark, tmp_path):
    old, new = documents(spark, [(1, "aa", "s"), (2, "bb", "s")]), documents(spark, [(3, "AA", "s"), (4, "cc", "s")])
    state, digest = str(tmp_path / "state"), lambda b: str(len(b))
    old.write.parquet(str(tmp_path / "old"))
    old = spark.read.parquet(str(tmp_path / "old"))
    exact_dedup.exact_groups(old, digest=digest, state_path=state)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(new, digest=digest, state_path=state, earlier=old).collect()}
    assert got == {3: (3, 2), 4: (4, 1)}


def test_only_hits_are_compared(spark):
    docs = documents(spark, ROWS)
    hit = docs.select(F.sha2(F.lit("same text"), 256).alias("digest")).distinct()
    rows = exact_dedup._texts(docs, exact_dedup._mask(hit), "doc_id", "text", exact_dedup.sha256_hex).collect()
    assert {r.doc_id for r in rows} == {5, 7, 9} and all(bytes(r.norm) == b"same text" for r in rows)


def test_hot_keys_are_joined_whole(spark):
    left = spark.range(40_000).select(F.when(F.col("id") < 25_000, 0).otherwise(F.col("id") % 100).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    out = common.join_hot(left, right, ["k"], "n", 40_000)
    assert out.count() == 40_000 and out.select("id").distinct().count() == 40_000


def test_clashing_columns_stay(spark):
    rows = [(1, "a b", "s", 7, "x", "m"), (2, "A b", "s", 8, "y", "n"), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __llm_row long, whole string, _metadata string")
    for keep in (exact_dedup.keep_first_of_equal, simhash.keep_one_of_each, mixing.mixed_documents):
        out = keep(docs)
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= set(rows) and out.count() >= 2


def test_exact_empty(spark):
    empty = documents(spark, ROWS).limit(0)
    assert exact_dedup.exact_groups(empty).collect() == []
    assert exact_dedup.keep_first_of_equal(empty).collect() == []


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", norm(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """Least member of each component of items linked at 3 or fewer differing bits."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "one", "Two words", "a b c", "A b C d E f g é \x1f x y", "w " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_hash_is_sparks(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def near_copies(n=200, seed=1):
    """Random words, near copies, a chain of one-bit steps is left to test_links."""
    r = random.Random(seed)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(0, 80))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        words = r.choice(base).split()
        if words and r.random() < 0.5:
            words[r.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return out


def test_near_groups(spark):
    texts = [None, "", *near_copies()]
    rows = [(1000 - i, t, "s") for i, t in enumerate(texts)]
    out = simhash.near_groups(documents(spark, rows), tile=16).collect()
    fps = [plain_fingerprint(t) for t in texts]
    of = plain_components(fps)
    least = {}
    for k, c in enumerate(of):
        least[c] = min(least.get(c, 10**9), 1000 - k)
    assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in out} == {(1000 - k, fps[k], least[c]) for k, c in enumerate(of)}
    assert sum(r.first for r in out) == len(least)
    kept = simhash.keep_one_of_each(documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values()) and kept.columns == SCHEMA.replace(",", "").split()[::2]


def test_near_groups_odd_rows(spark):
    rows = [(3, "same words here", "a"), (3, "same words here", "a"), (None, "same words here", "a"), (None, "quite another text", "a"), (9, "x", "a")]
    out = simhash.near_groups(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter([(3, 3), (3, 3), (None, 3), (None, None), (9, 9)])
    assert simhash.keep_one_of_each(documents(spark, rows)).count() == 3
    assert simhash.near_groups(documents(spark, rows).limit(0)).collect() == []


def test_links_on_random_bits(spark):
    """Clusters of close fingerprints and far ones, with tiles and sub-tiles of several sizes."""
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in base:
        y = int(x)
        for _ in range(int(r.integers(0, 15))):
            for b in r.integers(0, 64, int(r.integers(0, 4))):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    cell = Counter(((x >> 32).bit_count(), (x & 0xFFFFFFFF).bit_count()) for x in fps)
    assert sum(n for n in cell.values() if n > 1) > 64  # with tiles and bands of one the pairs of a band are spread by salts
    for tile, band in ((1, 1), (2, 3), (10_000, 32)):
        pairs = components.components(simhash.links(df, tile=tile, band=band)).collect()
        root = {p.node % 2**64: p.root % 2**64 for p in pairs}
        got = defaultdict(set)
        for x in fps:
            got[root.get(x, x)].add(x)
        want = defaultdict(set)
        for x, c in zip(fps, plain_components(fps), strict=True):
            want[c].add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_compare_dense_tile():
    """All in one cluster: a spanning forest leaves, not all pairs."""
    x = np.array([1 << i for i in range(64)] + [0] + [3 << i for i in range(60)], dtype=np.uint64)
    x = np.unique(np.concatenate([x, x | np.uint64(1 << 50)]))
    u, v = simhash.compare(x, x, True)
    assert len(u) == len(x) - 1 and len(set(v.tolist())) == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7), (200, 201), (201, 202), (202, 200)]
    out = components.components(spark.createDataFrame(chain, "u long, v long"))
    got = {r.node: r.root for r in out.collect()}
    assert got == {i: 0 for i in range(1, 51)} | {101: 100, 102: 100, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def sources(spark, n=3000):
    r = random.Random(5)
    rows = [(i, "w " * r.randint(1, 60), r.choice(["big"] * 30 + ["mid"] * 8 + ["small", None])) for i in range(n)]
    return documents(spark, rows), rows


def test_mixing(spark):
    docs, rows = sources(spark)
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += max(len(t.split()), -(-len(t) // 8))
    out = mixing.mix(docs, target_entropy=0.7, max_epochs=100.0, block_tokens=500).collect()
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items()}
    weight = {r.source: r.weight for r in out}
    assert sum(weight.values()) == pytest.approx(1)
    entropy = -sum(w * np.log(w) for w in weight.values()) / np.log(len(p))
    assert entropy == pytest.approx(0.7, abs=1e-4)
    a = np.log(weight["big"] / weight["mid"]) / np.log(p["big"] / p["mid"])
    assert all(np.log(weight["big"] / weight[s]) == pytest.approx(a * np.log(p["big"] / p[s])) for s in ("small", None))
    budget = max(tokens[s] / weight[s] for s in p)
    given, copies = Counter(), Counter()
    for r in out:
        given[r.source] += r.n_tokens
        copies[r.doc_id] += 1
    for s in p:
        assert weight[s] * budget <= given[s] + 1 and given[s] <= weight[s] * budget + 61  # the last document may pass the edge
    assert set(copies) == {i for i, _, _ in rows}  # no document is lost
    for s in p:
        n = [copies[i] for i, _, x in rows if x == s]
        assert max(n) - min(n) <= 1
    assert len({(r.doc_id, r.epoch) for r in out}) == len(out)
    order = defaultdict(dict)
    for r in out:
        assert order[(r.source, r.epoch)].setdefault(r.block, r.block_rank) == r.block_rank
    assert all(len(set(x.values())) == len(x) for x in order.values())


def test_mixing_limits(spark):
    docs, rows = sources(spark)
    copies = Counter(r.doc_id for r in mixing.mix(docs, target_entropy=1.0, max_epochs=2.0).collect())
    assert max(copies.values()) <= 2
    few = mixing.mix(docs, target_entropy=0.8, budget_tokens=5000, block_tokens=200).collect()
    assert 4900 <= sum(r.n_tokens for r in few) <= 5000 + 4 * 60
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() >= len(rows)
    assert mixing.mix(docs.limit(0)).collect() == []
    odd = documents(spark, [(1, None, None), (1, None, None), (None, "a b", None)])
    assert Counter(r.doc_id for r in mixing.mix(odd).collect()) == Counter([1, 1, None])


def test_mixing_keeps_the_limit_for_any_budget(spark):
    docs, rows = sources(spark)
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += max(len(t.split()), -(-len(t) // 8))
    total = sum(tokens.values())
    for budget in (total // 2, total, int(1.6 * total), 2 * total, 5 * total):
        out = mixing.mix(docs, max_epochs=2.0, budget_tokens=budget).collect()
        copies, weight = Counter(r.doc_id for r in out), {r.source: r.weight for r in out}
        assert max(copies.values()) <= 2
        assert sum(r.n_tokens for r in out) == pytest.approx(min(budget, 2 * total), rel=0.01)
        if budget < 2 * total:
            assert all(w * budget <= 2 * tokens[s] * (1 + 1e-6) for s, w in weight.items())


def test_mixing_counts_texts_without_spaces(spark):
    docs = documents(spark, [(1, "日本語" * 800, "ja"), (2, "word " * 900, "en"), (3, "", "en"), (4, "x " * 100_000, "long")])
    assert {r.doc_id: r.n_tokens for r in mixing.mix(docs).collect()} == {1: 900, 2: 900, 3: 1, 4: 100_000}
    own = mixing.mix(docs, n_tokens=F.length("text")).collect()
    assert {r.doc_id: r.n_tokens for r in own} == {1: 2400, 2: 4500, 3: 1, 4: 200_000}


def test_mixing_hot_source_is_whole(spark):
    rows = [(i, "a b c", "one" if i % 3 else f"s{i % 5}") for i in range(999)]
    out = mixing.mix(documents(spark, rows)).select("doc_id").distinct()
    assert out.count() == 999
    assert out.agg(F.sum("doc_id")).first()[0] == sum(range(999))
