"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt into tiles by the population counts of their two halves (and, in full cells, a hash).
Two tiles are compared only if their population counts differ by no more than the radius, since every differing bit
changes a count by one.  A comparison is numpy exclusive-or and bit counts over sub-tiles ordered by the counts of
the four 16-bit quarters, where bounds on these counts skip most sub-tile pairs; the rest are compared in full, so
no link is lost.  Of the links between two tiles a spanning forest leaves the task, never all pairs.

Up to BAND tiles of a cell travel together as a band.  Pairs of bands are found by their names alone; a pair carries one band
of fingerprints, so what is shuffled falls with the size of a band, and the pairs of a band are spread over tasks by a salt
whose number grows with the bands.  Inside a pair, tiles are compared two by two.  A fingerprint that
many documents share is one entry of a tile, and its documents are joined by broadcast (see common.join_hot).

Defined results: a null text counts as empty; texts without words share the fingerprint zero and link like any other; a
text of any length is read whole, its shingles counted in parts; rows that repeat, or tie on doc_id, share their group,
and the one at the least locator stays; a null doc_id takes part but never names a group that has another id; an empty
table gives an empty one; columns other than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, join_hot, located, materialize, settings, utf8, whole_rows, with_row_key
from .components import components

RADIUS = 3
SHINGLE = 3
TILE = 16384
BAND = 32  # tiles: 4 MB of fingerprints
SUB = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = utf8(text).lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 65536):
        h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams[at : at + 65536]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, locator, fp): the 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.pop("text")], dtype="<u8")
            yield b.assign(fp=fp.view("<i8"))

    keyed = with_row_key(located(docs), doc_id=F.col(id_col).cast("long"), text=F.col(text_col))
    return keyed.mapInPandas(run, f"doc_id long, {ROW[0]} string, {ROW[1]} long, fp long")


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view("<u2").reshape(-1, 4)).astype(np.int16)


def _boxes(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(q), SUB)
    return np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)


def _spread(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the rows and columns of a link matrix, equal if they are connected inside it."""
    n, m = close.shape
    far = n + m
    left, right = np.arange(n), np.arange(n, far)
    while True:
        new_left = np.minimum(left, np.where(close, right[None, :], far).min(axis=1))
        new_right = np.minimum(right, np.where(close, new_left[:, None], far).min(axis=0))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def compare(a: np.ndarray, b: np.ndarray, same: bool, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (or inside one), as two arrays of fingerprints."""
    qa, qb = _quarters(a), _quarters(b)
    oa, ob = (np.lexsort(q.T[::-1]) for q in (qa, qb))
    a, b, qa, qb = a[oa], b[ob], qa[oa], qb[ob]
    (la, ha), (lb, hb) = _boxes(qa), _boxes(qb)
    gap = np.maximum(0, np.maximum(la[:, None] - hb[None], lb[None] - ha[:, None])).sum(axis=2)
    nodes = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    linked: set[int] = set()
    for i, j in zip(*np.nonzero(gap <= radius), strict=True):
        if same and j < i:
            continue
        x, y = a[i * SUB : (i + 1) * SUB], b[j * SUB : (j + 1) * SUB]
        close = np.bitwise_count(x[:, None] ^ y[None]) <= radius
        if same and i == j:
            np.fill_diagonal(close, False)
        rows, cols = np.nonzero(close.any(axis=1))[0], np.nonzero(close.any(axis=0))[0]
        if not len(rows):
            continue
        left, right = _spread(close[np.ix_(rows, cols)])
        at = np.concatenate([rows + i * SUB, cols + j * SUB + shift])
        for node, label in zip(at.tolist(), at[np.concatenate([left, right])].tolist(), strict=True):
            linked.add(node)
            p, q = root(node), root(label)
            if p != q:
                parent[max(p, q)] = min(p, q)
    out = [(k, r) for k in linked if (r := root(k)) != k]
    return nodes[[k for k, _ in out]], nodes[[r for _, r in out]]


def compare_bands(x: list[np.ndarray], y: list[np.ndarray] | None, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning forests of the links between each tile of one band and each of the other (or of a band with itself)."""
    for i, one in enumerate(x):
        for two in x[i:] if y is None else y:
            yield compare(one, two, two is one, radius)


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, band: int = BAND) -> DataFrame:
    """(u, v): links that connect the same fingerprints as all pairs within the radius.  fps: distinct, column fp."""
    spark = fps.sparkSession
    half = lambda c: F.bit_count(c).cast("int")
    cells = fps.select("fp", half(F.shiftrightunsigned("fp", 32)).alias("a"), half(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("b"))
    full = {(r.a, r.b): -(-r.n // tile) for r in cells.groupBy("a", "b").agg(F.count("*").alias("n")).collect() if r.n > tile}  # 33 * 33 cells at most
    parts = spark.createDataFrame([(a, b, n) for (a, b), n in full.items()], "a int, b int, parts long") if full else spark.createDataFrame([], "a int, b int, parts long")
    dealt = cells.join(F.broadcast(parts), ["a", "b"], "left").withColumn("k", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))))
    tiles = dealt.groupBy("a", "b", "k").agg(F.collect_list("fp").alias("x"))
    bands = materialize(tiles.groupBy("a", "b", F.floor(F.col("k") / band).alias("g")).agg(F.collect_list("x").alias("x")))
    salts = -(-max(1, sum(-(-n // band) for n in full.values())) // 64)

    steps = [(p, q) for p in range(radius + 1) for q in range(-radius, radius + 1) if p + abs(q) <= radius and (p > 0 or q >= 0)]
    step = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in steps)))
    near = bands.select("a", "b", "g", step.alias("s")).select(F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("g").alias("g0"), (F.col("a") + F.col("s.p")).alias("a"), (F.col("b") + F.col("s.q")).alias("b"))
    same_cell = (F.col("a0") == F.col("a")) & (F.col("b0") == F.col("b"))
    pairs = near.join(bands.select("a", "b", "g"), ["a", "b"]).where(~same_cell | (F.col("g0") <= F.col("g")))
    pairs = pairs.withColumn("same", same_cell & (F.col("g0") == F.col("g"))).withColumn("salt", F.pmod(F.xxhash64("a0", "b0", "g0"), F.lit(salts)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = materialize(pairs.repartition(n, "a0", "b0", "g0", "a", "b", "g"))  # names of bands, spread evenly
    one = bands.select(F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("g").alias("g0"), "x")
    two = bands.select("a", "b", "g", F.col("x").alias("y"))
    if salts > 1:
        two = two.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    pairs = pairs.join(one, ["a0", "b0", "g0"]).join(two, ["a", "b", "g"] + ["salt"] * (salts > 1)).select("x", F.when(~F.col("same"), F.col("y")).alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        views = lambda tiles: [np.asarray(t, dtype="<i8").view("<u8") for t in tiles]
        for batch in batches:
            us, vs = [np.empty(0, "<u8")], [np.empty(0, "<u8")]
            for x, y in zip(batch["x"], batch["y"], strict=True):
                for u, v in compare_bands(views(x), None if y is None else views(y), radius):
                    us.append(u)
                    vs.append(v)
            yield pd.DataFrame({"u": np.concatenate(us).view("<i8"), "v": np.concatenate(vs).view("<i8")})

    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="8"):  # pairs of up to 8 MB
        return materialize(pairs.mapInPandas(run, "u long, v long"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, locator, fp, component_id, first (the row that stays when one of a group does)."""
    slim = materialize(fingerprints(docs, id_col, text_col, shingle))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW))
    distinct = materialize(slim.groupBy("fp").agg(least.alias("least"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), radius, tile))
    member = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = materialize(member)
    groups = materialize(member.groupBy("root").agg(F.min("least").alias("head"), F.count("*").alias("size")))
    of = materialize(join_hot(member.select("fp", "n", "root"), groups, ["root"], "size", distinct.count()).select("fp", "n", "head"))
    here = F.struct("doc_id", *ROW)
    head = F.struct("head.doc_id", *(f"head.{c}" for c in ROW))
    every = join_hot(slim, of, ["fp"], "n", slim.count())
    return every.select("doc_id", *ROW, "fp", F.col("head.doc_id").alias("component_id"), here.eqNullSafe(head).alias("first"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the smallest doc_id; all columns stay."""
    docs = located(docs)
    gone = near_groups(docs, id_col, text_col, radius).where("not first").select(*ROW)
    return whole_rows(docs).join(gone, list(ROW), "left_anti").select("whole.*")
