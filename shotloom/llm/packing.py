"""Packing along a space-filling curve.

A document's token ids (from the tokenizers library, then the end id) give a hashed vector: each id has a pseudo-random
position in DIMS dimensions, and the document lies at their mean.  The Hilbert index of that point is the sort key.
Documents are range-partitioned by it (copies of one text spread by a hash), sorted, and laid end to end: each run of
4096 ids is a sequence, so neighbours on the curve share sequences.  The number of partitions follows from the number of
ids (see partitions()), not from a setting.  What is left at the end of a partition, less than a sequence, is laid end to
end with what MERGED neighbouring partitions leave, and so on; only the last rest of all is cut into sequences whose
lengths are powers of two, which need no padding.

Tokenizing works on words, or on chunks between spaces or line feeds, which this tokenizer never joins; new ones are
encoded by the library, many to a call, and the ids of those up to CACHED_LENGTH characters are kept in each worker, within
bounds in bytes (SLOTS, POOLED, CACHE_BYTES).

Defined results: a null or empty text is the end id alone; a text of any length is cut into as many pieces as it takes;
repeated rows are packed separately, and rows that tie on the curve lie in order of a hash and their doc_id; an empty
table gives no pieces; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tokenizer_path

LENGTH = 4096
END_ID = 2
DIMS, BITS = 3, 16
CACHE_BYTES = 100_000_000
CACHED_LENGTH, ENTRY = 64, 200  # longest kept word; bytes of a dictionary entry beside the characters and ids
MERGED = 64  # partitions whose rests are laid end to end in the next step
#: Characters whose lower case and splits are the same everywhere; no apostrophe or angle bracket (contractions, special strings).
PLAIN = re.compile("[ \n!-&(-;=?-~ß-öø-ÿÀ-ÖØ-Þœ]*")
SLOTS = 1 << 21  # of the table of plain words (60 MB); it is begun anew when half full
POOLED = 1 << 25  # ids that it holds, about, at most (64 MB)

_state: dict[str, tuple] = {}


class Kept(dict):
    """Ids of parts of texts; ``held`` is about how many bytes they take."""

    held = 0


def _tokenizer(path: str):
    """(tokenizer, table of plain words, kept ids of chunks, positions of ids) of this worker."""
    if path not in _state:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        n = t.get_vocab_size(with_added_tokens=True)
        if n > 65536:
            raise ValueError("ids do not fit in 16 bits")
        positions = np.random.default_rng(7).standard_normal((n, DIMS)).astype(np.float32)
        _state[path] = (t, WordTable(), Kept(), positions)
    return _state[path]


def _library(tokenizer, parts: list[str], whole: bool) -> list[bytes]:
    """Ids of each part, many parts to a call.  Which part an id belongs to is told by the word that it comes from, if
    each part is a whole word, and else by its offset."""
    out: list[bytes] = []
    for at in range(0, len(parts), 1000):
        some = parts[at : at + 1000]
        e = tokenizer.encode(" ".join(some), add_special_tokens=False)
        ids = np.array(e.ids, dtype="<u2")
        if whole:
            of, ends = np.array(e.word_ids, np.int64), np.arange(1, len(some) + 1)
        else:
            of, ends = np.array([o[0] for o in e.offsets], np.int64), np.cumsum([len(c) + 1 for c in some])
        edges = [0, *np.searchsorted(of, ends).tolist()]
        data = ids.tobytes()
        out += [data[2 * i : 2 * j] for i, j in zip(edges, edges[1:])]
    return out


class WordTable:
    """Ids of plain words that the worker has met: a hash table in numpy arrays, keyed by the words' bytes.

    A word of up to 16 characters is two 64-bit numbers, so looking up all words of a batch takes a few array operations;
    longer words go by a dictionary."""

    #: Class of each byte of plain lower-case text (œ stands at the multiplication sign): 0 gap, 1 letter, 2 digit, 3 other.
    KIND = np.full(256, 3, np.uint8)
    KIND[[10, 32]] = 0
    KIND[48:58] = 2
    KIND[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100), 0xD7]] = 1
    MASKS = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self) -> None:
        self.low, self.high = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.at, self.size = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.clear()

    def clear(self) -> None:
        self.low[:] = 0
        self.pool, self.used, self.words = np.empty(1 << 16, "<u2"), 0, 0
        self.long: dict[str, tuple[int, int]] = {}

    def _add(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of ids that are put in the pool."""
        n = np.array([len(x) // 2 for x in ids], np.int64)
        data = np.frombuffer(b"".join(ids), "<u2")
        if self.used + len(data) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(2 * len(data) + self.used, "<u2")])
        self.pool[self.used : self.used + len(data)] = data
        at = self.used + np.cumsum(n) - n
        self.used += len(data)
        return at, n

    @staticmethod
    def _slot(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slot of each word; -1 - slot, of the first free one, where it is not in the table."""
        slot = self._slot(low, high)
        out, rest = np.empty(len(low), np.int64), np.arange(len(low))
        while len(rest):
            here, free = self.low[slot], self.low[slot] == 0
            done = free | (here == low[rest]) & (self.high[slot] == high[rest])
            out[rest[done]] = np.where(free[done], -1 - slot[done], slot[done])
            rest, slot = rest[~done], (slot[~done] + 1) & (SLOTS - 1)
        return out

    def encode(self, tokenizer, texts: list[str]) -> list[bytes]:
        """Ids of plain texts."""
        if self.words > SLOTS // 2 or self.used > POOLED or len(self.long) > SLOTS // 16:
            self.clear()
        said = "\n".join(texts).lower() + "\n"
        data = np.frombuffer(said.replace("œ", "×").encode("latin-1") + bytes(16), np.uint8)
        kind = self.KIND[data[: len(said)]]
        begins = np.r_[True, kind[1:] != kind[:-1]] | (kind == 2)
        edge = np.append(np.flatnonzero(begins), len(said))
        real = kind[edge[:-1]] > 0
        start, n = edge[:-1][real], np.diff(edge)[real]
        at, size = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)

        eight = np.ndarray(len(data) - 7, "<u8", data.tobytes(), strides=(1,))
        short = np.flatnonzero(n <= 16)
        low = eight[start[short]] & self.MASKS[np.minimum(n[short], 8)]
        high = eight[start[short] + 8 * (n[short] > 8)] & self.MASKS[np.maximum(n[short] - 8, 0)]
        slot = self._find(low, high)
        new = np.flatnonzero(slot < 0)
        if len(new):
            order = new[np.lexsort((high[new], low[new]))]
            first = order[np.r_[True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])]]
            first = first[: max(0, SLOTS * 3 // 4 - self.words)]  # what a batch brings beyond that goes by the dictionary
            begin, end = start[short[first]], start[short[first]] + n[short[first]]
            ids = _library(tokenizer, [said[i:j] for i, j in zip(begin.tolist(), end.tolist())], True)
            put_at, put_n = self._add(ids)
            rest = np.arange(len(first))
            while len(rest):  # of words that want one slot the first gets it
                want = -1 - self._find(low[first[rest]], high[first[rest]])
                _, one = np.unique(want, return_index=True)
                got, to = rest[one], want[one]
                self.low[to], self.high[to], self.at[to], self.size[to] = low[first[got]], high[first[got]], put_at[got], put_n[got]
                rest = np.delete(rest, one)
            self.words += len(first)
            slot[new] = self._find(low[new], high[new])
        here = short[slot >= 0]
        at[here], size[here] = self.at[slot[slot >= 0]], self.size[slot[slot >= 0]]

        long = np.concatenate([np.flatnonzero(n > 16), short[slot < 0]])
        if len(long):
            words = [said[i:j] for i, j in zip(start[long].tolist(), (start[long] + n[long]).tolist())]
            fresh = list({w for w in words if w not in self.long})
            if fresh:
                self.long.update(zip(fresh, zip(*(x.tolist() for x in self._add(_library(tokenizer, fresh, True))))))
            at[long], size[long] = np.array([self.long[w] for w in words], np.int64).T
            for w in fresh:
                if len(w) > CACHED_LENGTH:
                    del self.long[w]

        ends = np.cumsum(size)
        flat = self.pool[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        limits = np.cumsum([len(t) + 1 for t in texts])
        cut = [0, *np.r_[0, ends][np.searchsorted(start, limits)].tolist()]
        return [flat[2 * i : 2 * j] for i, j in zip(cut, cut[1:])]


def _chunks(tokenizer, kept: Kept, texts: list[list[str]]) -> list[bytes]:
    """Ids of texts that are lists of chunks; new ones are encoded, and short ones kept."""
    new = list(set().union(*texts).difference(kept))
    ids = dict(zip(new, _library(tokenizer, new, False), strict=True))
    out = [b"".join([ids[c] if c in ids else kept[c] for c in t]) for t in texts]
    short = {c: x for c, x in ids.items() if len(c) <= CACHED_LENGTH}
    kept.held += sum(map(len, short)) * 2 + ENTRY * len(short)
    kept.update(short)
    if kept.held > CACHE_BYTES:
        kept.clear()
        kept.held = 0
    return out


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Each text's ids with the end id, as little-endian 16-bit numbers.

    A text of plain letters, digits and signs falls into words just as the tokenizer splits it; any other text falls
    into chunks between spaces or line feeds, which the tokenizer never joins."""
    tokenizer, words, chunks, _ = _tokenizer(path)
    end = END_ID.to_bytes(2, "little")
    out: list[bytes] = []
    for at in range(0, len(texts), 256):
        some = ["" if t is None else t for t in texts[at : at + 256]]
        plain = [PLAIN.fullmatch(t) is not None for t in some]
        in_words = iter(words.encode(tokenizer, [t for t, p in zip(some, plain, strict=True) if p]))
        in_chunks = iter(_chunks(tokenizer, chunks, [list(filter(None, t.replace("\n", " ").split(" "))) for t, p in zip(some, plain, strict=True) if not p]))
        out += [next(in_words if p else in_chunks) + end for p in plain]
    return out


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, dims) with so many bits each.

    Gray-code walk from the highest bit down: the orthant of a bit is looked up in the current rotation, which each
    step then updates (reflections and exchanges of axes)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = np.int64(1) << b, (np.int64(1) << b) - 1
        for d in range(dims):
            on = (x[d] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (np.int64(1) << b), (np.int64(1) << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def tokenized(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, salt, ids): ids are 16-bit numbers, key is the place on the curve."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        *_, positions = _tokenizer(path)
        for b in batches:
            ids = encode_texts(list(b["text"]), path)
            mean = np.array([positions[np.frombuffer(x, "<u2")].mean(axis=0) for x in ids], dtype=np.float64).reshape(-1, DIMS)
            points = np.rint((np.tanh(3 * mean) + 1) / 2 * (2**BITS - 1))
            salt = [zlib.crc32(x) ^ zlib.crc32(str(i).encode()) for x, i in zip(ids, b["doc_id"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "key": hilbert_index(points), "salt": salt, "ids": ids})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, key long, salt long, ids binary")


def partitions(n_ids: int) -> int:
    """Into how many partitions so many ids go: a million ids each in small tables; partitions grow with the fourth root of
    the table, so that 10^13 ids make 170,000 partitions of some 60 million (120 MB)."""
    return max(1, math.ceil((n_ids / 2**20) ** 0.75))


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, rest binary"


def _layer(step: int, last: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Lay runs of ids (doc_id, start, ids, doc_tokens) end to end; the rest of a partition goes on as runs, in column
    ``rest``, or, in the last step, as sequences of lengths that are powers of two."""

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        sequence = (step << 56) + (part << 32)
        rows: list[tuple] = []
        held: list[tuple] = []  # pieces of the open sequence: (doc_id, start, ids, doc_tokens)
        filled = 0

        def close(size: int) -> None:
            """Emit the first ``size`` ids that are held as one sequence."""
            nonlocal sequence, filled
            offset = 0
            while offset < size:
                doc, start, ids, n = held[0]
                take = min(len(ids), size - offset)
                rows.append((doc, start, take, zlib.crc32(ids[:take].astype("<u4").tobytes()), n, sequence, offset, part, None))
                if take < len(ids):
                    held[0] = (doc, start + take, ids[take:], n)
                else:
                    held.pop(0)
                offset += take
            sequence += 1
            filled -= size

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")]).astype({"doc_id": "Int64", "sequence_id": "Int64"})
            rows.clear()
            return out

        for b in batches:
            for doc, first, data, n in zip(b["doc_id"], b["start"], b["ids"], b["doc_tokens"], strict=True):
                ids = np.frombuffer(data, "<u2")
                at = 0
                while at < len(ids):
                    take = min(LENGTH - filled, len(ids) - at)
                    held.append((None if pd.isna(doc) else int(doc), int(first) + at, ids[at : at + take], int(n)))
                    at, filled = at + take, filled + take
                    if filled == LENGTH:
                        close(LENGTH)
            if rows:
                yield frame()
        if last:
            for bit in range(LENGTH.bit_length() - 1, -1, -1):
                if filled & (1 << bit):
                    close(1 << bit)
        else:
            for offset, (doc, start, ids, n) in enumerate(held):
                rows.append((doc, start, len(ids), 0, n, None, offset, part, ids.tobytes()))
        if rows:
            yield frame()

    return lay


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ready = materialize(tokenized(docs, tokenizer, id_col, text_col))
    n = partitions((ready.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 2)
    runs = ready.repartitionByRange(n, "key", "salt").sortWithinPartitions("key", "salt", "doc_id")
    runs = runs.select("doc_id", F.lit(0).cast("long").alias("start"), "ids", F.expr("octet_length(ids) div 2").alias("doc_tokens"))
    done, step = [], 0
    while True:
        laid = runs.mapInPandas(_layer(step, n == 1), PIECE)
        if n > 1:
            laid = materialize(laid)
        done.append(laid.where("rest is null").drop("part", "rest"))
        if n == 1:
            return reduce(DataFrame.unionAll, done)
        n, step = -(-n // MERGED), step + 1
        rests = laid.where("rest is not null").repartitionByRange(n, "part").sortWithinPartitions("part", "offset")  # less than LENGTH ids of each partition
        runs = rests.select("doc_id", "start", F.col("rest").alias("ids"), "doc_tokens")
