"""Alignment of two tokenizers over the same texts.

The spans that the tokenizers give with their tokens, in characters, are coarse cuts: a token that ends where the next one
begins ends at that character's first byte.  Tokens that share a character with a neighbour (pieces of a multibyte
character, byte-fallback tokens) have no cut of their own in characters; theirs are refined with the number of their decoded
bytes.  The decoded bytes of both sides must then spell the text, or it has no tokens.  Cuts that both sides have divide the
text into groups; the segments between the cuts of either side are the links, one for each overlapping pair of tokens.

A single space between two other characters is a cut on both sides: byte-level pre-tokens begin with it, and no piece of the
sentencepiece model has a space after another character (checked).  So a text is aligned word by word; words that a worker
has not met lately are encoded in batches and kept in two generations of bounded size, of which the older one is forgotten.

Counts of id pairs cover the whole corpus and are summed by Spark.  Scores join them to the documents' own pairs by
broadcast, in slices of SLICE pairs, so any number of pairs will do and no document's pairs are shuffled.

Defined results: a text that is null, empty, or whose decoded bytes differ from it (a literal U+2581, say) has no tokens:
zeros, and an empty string of groups; texts and words of any length are aligned whole; pairs that tie for an id's highest
count are all best; repeated rows are documents of their own, in counts too; an empty table gives an empty one; other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tokenizer_path

SPACE = "▁"
#: A single space between characters that are neither spaces nor taken for white space by either tokenizer.
BLANK = f"\\s{SPACE}᠎​"
CUT = re.compile(f"(?<=[^ {SPACE}]) (?=[^{BLANK}])")
UNEVEN = re.compile(f" [{BLANK}]|{SPACE}|^ | \\Z")  # a text that cannot just be split at its spaces
ALONE = re.compile(f"[{BLANK}]|.*[ {SPACE}]\\Z", re.DOTALL)  # no cut at its ends: not to be encoded beside others
TOGETHER, TOGETHER_CHARS = 512, 16384  # words that are encoded as one text
KEPT_BYTES, KEPT_LENGTH, ENTRY = 140_000_000, 64, 280  # of a generation of words; longest kept word; bytes of an entry beside its texts
TEXTS_AT_ONCE, CHARS_AT_ONCE = 256, 4_000_000
SLICE = 1_000_000  # counted pairs that are broadcast at once: some tens of MB

_models: dict[tuple[str, str], "Aligner"] = {}


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def words(text: str) -> list[str]:
    return CUT.split(text) if UNEVEN.search(text) else text.split(" ")


class Aligner:
    """Tokenizers a (byte-level BPE, .json) and b (sentencepiece, .model), with the decoded bytes of all their ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings in texts are plain text
        of = _byte_level()
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in names):
            raise ValueError("pieces cross a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.pair = np.dtype(np.int32 if len(self.a_bytes) * len(names) < 2**31 else np.int64)
        # ids as texts with what follows: another id of the side, the other side, the next group, the next word
        self.a_text = np.array([f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"], object)
        self.b_text = np.array([f"{i}{end}" for i in range(len(names)) for end in ",;\n"], object)
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.size = 0

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
        """(ids, byte ends) of space+text by a, and of text by b, whose own first space counts; whether both spell space+text."""
        padded = " " + text
        raw = padded.encode()
        start = np.arange(len(padded) + 1) if len(raw) == len(padded) else _byte_starts(padded)
        e = self.a.encode(padded, add_special_tokens=False)
        m = self.b.encode(text, return_type="offset_mapping")
        a, b = np.array(e.ids, np.int64), np.array(m["ids"], np.int64)
        span, spanned = _pairs(e.offsets, len(a)), _pairs(m["offsets"], len(b)) + 1
        a_end = _refined(start, span, self.a_len[a])
        b_end = _refined(start, spanned, self.b_len[b])
        same = b"".join(map(self.a_bytes.__getitem__, e.ids)) == raw and b"".join(map(self.b_bytes.__getitem__, m["ids"])) == raw
        return a, a_end, b, b_end, same and _told(a_end, self.a_len[a]) and _told(b_end, self.b_len[b])

    def told(self, words: list[str]) -> dict[str, tuple | bool]:
        """Each word's groups as text, id pairs of its links (bytes of numbers), and number of tokens of a; False if its
        bytes are not told.  The words are encoded as one text, or one by one if that fails."""
        a, a_end, b, b_end, good = self.spans(" ".join(words))
        if not good:
            return {words[0]: False} if len(words) == 1 else {w: v for x in words for w, v in self.told([x]).items()}
        edge = np.cumsum([len(w.encode()) + 1 for w in words])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        every = np.union1d(a_end, b_end)
        pair = a[np.searchsorted(a_end, every)] * len(self.b_bytes) + b[np.searchsorted(b_end, every)]
        texts = "".join(self._told_groups(a, a_end, b, b_end, both, edge)).split("\n")
        n_a = np.diff(np.searchsorted(a_end, edge, "right"), prepend=0).tolist()
        to = (np.searchsorted(every, edge, "right") * self.pair.itemsize).tolist()
        data = pair.astype(self.pair).tobytes()
        links = [data[i:j] for i, j in zip([0, *to], to, strict=False)]
        return dict(zip(words, zip(texts, links, n_a, strict=False), strict=True))

    def _told_groups(self, a, a_end, b, b_end, both, edge) -> list[str]:
        in_a, in_b = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        last_a, last_b = np.r_[in_a[1:] != in_a[:-1], True], np.isin(b_end, both, assume_unique=True).astype(np.int64)
        last_b += np.isin(b_end, edge, assume_unique=True)
        order = np.argsort(np.r_[2 * in_a, 2 * in_b + 1], kind="stable")
        told = np.concatenate([self.a_text[2 * a + last_a], self.b_text[3 * b + last_b]])[order]
        return told.tolist()

    def learn(self, new: list[str]) -> dict[str, tuple | bool]:
        out: dict[str, tuple | bool] = {}
        some: list[str] = []
        chars = 0
        for w in new:
            if ALONE.match(w):
                out.update(self.told([w]))
                continue
            some.append(w)
            chars += len(w) + 1
            if len(some) == TOGETHER or chars > TOGETHER_CHARS:
                out.update(self.told(some))
                some, chars = [], 0
        if some:
            out.update(self.told(some))
        return out

    def align(self, texts: list[str | None]) -> list[tuple[str, np.ndarray, int]]:
        """(groups, id pairs of its links, tokens of a) of each text."""
        split = [words(t) if t else [] for t in texts]
        found = [list(map(self.young.get, s)) for s in split]
        lacking = [k for k, f in enumerate(found) if None in f]
        here: dict[str, tuple | bool] = {}
        new: list[str] = []
        for w in {w for k in lacking for w, v in zip(split[k], found[k], strict=True) if v is None}:
            v = self.old.get(w)
            if v is None:
                new.append(w)
            else:
                here[w] = v
        here.update(self.learn(new))
        for k in lacking:
            found[k] = [here[w] if v is None else v for w, v in zip(split[k], found[k], strict=True)]
        for w, v in here.items():
            if len(w) <= KEPT_LENGTH:
                self.keep(w, v)
        out = []
        for f in found:
            if not f or False in f:
                out.append(("", np.zeros(0, self.pair), 0))
                continue
            groups, links, n_a = zip(*f, strict=True)
            out.append((";".join(groups), np.frombuffer(b"".join(links), self.pair), sum(n_a)))
        return out

    def keep(self, word: str, value: tuple | bool) -> None:
        if self.size > KEPT_BYTES:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[word] = value
        self.size += ENTRY + 2 * len(word) + (len(value[0]) + len(value[1]) if value else 0)


def _pairs(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    return np.fromiter(chain.from_iterable(spans), np.int64, 2 * n).reshape(-1, 2)


def _byte_starts(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.r_[0, np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))]


def _refined(start: np.ndarray, span: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: where a character's end is the token's own, that; else so many bytes past the last such end as
    the tokens since then have."""
    if not len(span):
        return np.zeros(0, np.int64)
    end = start[np.minimum(span[:, 1], len(start) - 1)]
    own = np.r_[(span[1:, 0] >= span[:-1, 1]) & (span[1:, 1] > span[:-1, 1]), True] & (span[:, 1] > span[:, 0])
    upto = np.cumsum(size)
    last = np.maximum.accumulate(np.where(own, np.arange(len(end)), -1))
    return np.where(own, end, upto + np.where(last >= 0, end[last] - upto[last], 0))


def _told(end: np.ndarray, size: np.ndarray) -> bool:
    """Whether the cuts agree with the decoded bytes."""
    return bool((np.diff(end, prepend=0) == size).all() and (size > 0).all())


def model(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _models:
        _models[a_path, b_path] = Aligner(a_path, b_path)
    return _models[a_path, b_path]


ALIGNED = "doc_id long, groups string, n_a long, n_b long, n_groups long, n_links long, pairs array<long>, times array<int>"


def align(docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's alignment: groups as ``a1,a2|b1;a3|b2,b3``, numbers of tokens, groups and links, and the distinct linked id
    pairs (a's id * size of b's vocabulary + b's id) with how often they are linked."""
    paths = (a or tokenizer_path("byte_bpe_50k.json"), b or tokenizer_path("piece_bpe_32k.model"))

    def parts(texts: list[str | None]) -> Iterator[list[str | None]]:
        some, chars = [], 0
        for t in texts:
            some.append(t)
            chars += len(t or "")
            if len(some) == TEXTS_AT_ONCE or chars > CHARS_AT_ONCE:
                yield some
                some, chars = [], 0
        if some:
            yield some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, schema = model(*paths), pa.schema([("doc_id", pa.int64()), ("groups", pa.string()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
        for batch in batches:
            done = 0
            for texts in parts(batch.column(1).to_pylist()):
                rows = aligner.align(texts)
                pairs, times = zip(*(np.unique(p, return_counts=True) for _, p, _ in rows), strict=True)
                at = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                # each group has one sign between its sides; a cut of either side ends a link, and both have those of groups
                n_a, n_groups, n_links = [n for _, _, n in rows], [g.count("|") for g, _, _ in rows], [len(p) for _, p, _ in rows]
                n_b = [k + m - n for n, m, k in zip(n_a, n_groups, n_links, strict=True)]
                yield pa.record_batch([
                    batch.column(0)[done : done + len(texts)], pa.array([g for g, _, _ in rows], pa.string()), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)),
                    pa.ListArray.from_arrays(at, pa.array(np.concatenate(pairs), pa.int64())), pa.ListArray.from_arrays(at, pa.array(np.concatenate(times).astype(np.int32), pa.int32())),
                ], schema=schema)
                done += len(texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): documents that hold each id pair linked, and whether no pair of its a has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / b_size))  # as many rows as b has ids, at most
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_a))


def scored(aligned: DataFrame, counts: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """Rows of a written alignment (with their own key, ``row``) with n_best and count_sum.

    Both are sums over a row's pairs, so the counted pairs may come in slices, each small enough to be broadcast."""
    slices = max(1, -(-counts.count() // slice_size))
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = None
    for k in range(slices):
        own = counts if slices == 1 else counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k)
        part = each.join(F.broadcast(own), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
        sums = part if sums is None else sums.unionByName(part)
    if slices > 1:
        sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).drop("row")


def align_scored(docs: DataFrame, digest: bool = False, a: str | None = None, b: str | None = None) -> DataFrame:
    """align() with n_best and count_sum over the whole corpus, without the pairs; ``digest`` gives the groups' SHA-256
    (empty without tokens) in their place."""
    b_path = b or tokenizer_path("piece_bpe_32k.model")
    out = align(docs, a, b_path)
    if digest:
        out = out.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
    written = materialize(out.withColumn("row", F.monotonically_increasing_id()))  # once written, a row's number stays
    counts = materialize(pair_counts(written, vocabulary_size(b_path)))
    return scored(written, counts)


def vocabulary_size(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
