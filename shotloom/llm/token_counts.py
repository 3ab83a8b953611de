"""Token counts by rank-synchronous array merging.

The texts of a batch fall into pre-tokens (a run of spaces and what follows it), which no piece of the vocabulary
crosses.  Pre-tokens that the worker has not met yet become one ragged numpy array of symbols.  In each round every
sequence's lowest-rank adjacent pair (the leftmost among equals) is merged at once, pairs around a merge get new
ranks, and sequences without a pair that merges leave with their number of symbols.  Characters that are no piece
count one token per UTF-8 byte.

A sequence of over INDEXED symbols takes all its pairs of the lowest rank in one round: overlapping pairs go to the left
one, and the round ends after the first merge that makes a pair of a still lower rank, as one merge after the other would.
Its places are indexed by rank, so a round costs what it merges, not what the sequence holds.

Counts of pre-tokens of up to CACHED_LENGTH characters are kept up to about CACHE_BYTES per worker.

Defined results: a null or empty text has no tokens; texts of any length, and runs of any length without a space, are
counted whole; pairs that tie in rank merge from the left; repeated rows are counted each; an empty table gives an empty
one; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path, utf8

LIMIT = 4096
CACHE_BYTES = 160_000_000
CACHED_LENGTH, ENTRY = 64, 160  # longest kept pre-token; bytes of a dictionary entry beside the characters
INDEXED = 512
NONE = np.int32(2**31 - 1)
SPACE = "▁"

_models: dict[str, "Merges"] = {}


class Merges:
    """Pair ranks of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in normal}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("pieces cross a space")
        order = {p: k for k, p in enumerate(sorted(pieces, key=lambda p: (-sp.get_score(pieces[p]), pieces[p])))}
        names = dict(pieces)  # symbol numbers; a character that is in a piece but is none itself gets one too
        for p in pieces:
            for c in p:
                names.setdefault(c, len(names) + n)
        self.size = max(names.values(), default=0) + 1
        self.weight = np.ones(self.size + 1, np.int64)
        for c, i in names.items():
            if c not in pieces:
                self.weight[i] = len(c.encode())
        self.of_code = np.full(0x110000, -1, np.int64)
        for c, i in names.items():
            if len(c) == 1:
                self.of_code[ord(c)] = i
        pairs = {}
        for p, k in order.items():
            for cut in range(1, len(p)):
                if p[:cut] in names and p[cut:] in names:
                    pairs[names[p[:cut]] * self.size + names[p[cut:]]] = (k, names[p])
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.into = np.zeros(len(order), np.int64)
        for k, i in pairs.values():
            self.into[k] = i
        self.cache: dict[str, int] = {}
        self.cached = 0  # bytes, about

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol numbers of all characters (-1: no piece has it) and the tokens that these count for."""
        code = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
        sym = self.of_code[code]
        return sym, np.where(sym < 0, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 0)

    def count(self, texts: list[str]) -> list[int]:
        lens = np.array([len(t) for t in texts], np.int64)
        sym, extra = self.symbols(texts)
        seq = np.repeat(np.arange(len(texts)), lens)
        counts = np.bincount(seq, extra, len(texts)).astype(np.int64)
        long = lens > INDEXED
        if long.any():
            ends = np.cumsum(lens)
            for k in np.flatnonzero(long).tolist():
                counts[k] += self.by_rank(sym[ends[k] - lens[k] : ends[k]])
            sym, seq = sym[~long[seq]], seq[~long[seq]]
        # rank[i]: of the pair (i, i + 1)
        rank = np.full(len(sym), NONE, np.int32)
        if len(sym) > 1:
            rank[:-1] = np.where(seq[1:] == seq[:-1], self.rank(sym[:-1], sym[1:]), NONE)
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            length = np.diff(np.r_[first, len(sym)])
            low = np.minimum.reduceat(rank, first)
            done = low == NONE
            if done.any():
                out = np.repeat(done, length)
                gone = sym[out]
                counts += np.bincount(seq[out], np.where(gone < 0, 0, self.weight[gone]), len(texts)).astype(np.int64)
                sym, seq, rank = sym[~out], seq[~out], rank[~out]
                low, length = low[~done], length[~done]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(low, length))
            at = at[np.r_[True, seq[at][1:] != seq[at][:-1]]]
            sym[at] = self.into[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))  # each merge before has removed a symbol
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            for touched in (new, np.maximum(new - 1, 0)):
                right = np.minimum(touched + 1, len(sym) - 1)
                rank[touched] = np.where((seq[touched] == seq[right]) & (touched != right), self.rank(sym[touched], sym[right]), NONE)
        return counts.tolist()

    def by_rank(self, sym: np.ndarray) -> int:
        """Tokens of one sequence; each round merges the pairs of its lowest rank, found by an index from ranks to places."""
        n = len(sym)
        sym = np.append(sym, -1)  # the end, which merges with nothing
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        places: dict[int, list[np.ndarray]] = {}
        chunk: dict[int, int] = {}  # how many places of a rank are tried in a round, after one that ended early
        ranks: list[int] = []

        def note(at: np.ndarray) -> None:
            rank = self.rank(sym[at], sym[after[at]])
            at, rank = at[rank != NONE], rank[rank != NONE]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edge = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            for r, part in zip(rank[edge].tolist(), np.split(at, edge[1:]), strict=True):
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(part)

        note(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            parts = places.pop(r)
            every = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            most = chunk.pop(r, n)
            every, rest = every[:most], every[most:]
            every = every[sym[every] >= 0]
            at = every[self.rank(sym[every], sym[after[every]]) == r]
            right = after[at]
            follows = np.r_[False, right[:-1] == at[1:]]  # shares a symbol with the pair before it
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(at)))) if len(at) else at
            at, right = at[run % 2 == 0], right[run % 2 == 0]
            if len(at):
                new = self.into[r]
                beyond = after[right]
                left = np.where(np.r_[False, beyond[:-1] == at[1:]], new, np.where(before[at] >= 0, sym[before[at]], -1))
                whole = np.full(len(at), new)
                lower = np.minimum(self.rank(left, whole), self.rank(whole, sym[beyond])) < r
                if lower.any():
                    end = int(lower.argmax()) + 1
                    rest = np.concatenate([every[every > at[end - 1]], rest])
                    at, right, beyond = at[:end], right[:end], beyond[:end]
                    chunk[r] = 64
                elif len(rest):
                    chunk[r] = 2 * most
                sym[at], sym[right] = new, -2
                after[at] = beyond
                before[beyond] = at
                note(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
            elif len(rest):
                chunk[r] = 2 * most
            if len(rest):
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].insert(0, rest)
        left = sym[:n]
        return int(self.weight[left[left >= 0]].sum())

    def count_texts(self, texts: list[str | None]) -> list[int]:
        out = []
        for at in range(0, len(texts), 256):
            split = [pre_tokens(t) for t in texts[at : at + 256]]
            new = list(set().union(*split).difference(self.cache))
            counted: dict[str, int] = {}
            for k in range(0, len(new), 200_000):
                counted.update(zip(new[k : k + 200_000], self.count([c if c.startswith(SPACE) else SPACE + c for c in new[k : k + 200_000]]), strict=True))
            self.cache.update(counted)
            out += [sum(map(self.cache.__getitem__, s)) for s in split]
            for c in counted:
                if len(c) > CACHED_LENGTH:
                    del self.cache[c]
                else:
                    self.cached += ENTRY + 2 * len(c)
            if self.cached > CACHE_BYTES:
                self.cache.clear()
                self.cached = 0
        return out


def pre_tokens(text: str | None) -> list[str]:
    """What follows single spaces, or, if spaces run together, each run of space marks with what follows it."""
    if not text:
        return []
    chunks = text.replace(SPACE, " ").split(" ")
    if "" not in chunks:
        return chunks
    return re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))


def model(path: str) -> Merges:
    if path not in _models:
        _models[path] = Merges(path)
    return _models[path]


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    path = tokenizer or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        merges = model(path)
        for b in batches:
            texts = list(b.pop("text"))
            yield b.assign(n_bytes=[len(utf8(t)) for t in texts], n_tokens=merges.count_texts(texts))

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
