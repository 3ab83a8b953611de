"""Secret scans by the entropy of sliding windows.

Base spans come from three exact patterns.  Beside these, candidate strings (runs of the characters that keys are made of)
are read by a window of fixed length for each character class: hex digits, letters and digits, and base64.  The window's
Shannon entropy comes from counts that change by the character that enters and the one that leaves: the sum of c log2 c is
kept, so a step costs the same whatever the window's length.  A string with a window whose entropy reaches its class's
threshold, and which mixes kinds of characters as random strings do, becomes a span.

An allow-list suppresses what looks random and is no secret: UUIDs, digests and versions named as such by the word before
them, paths and joined words, placeholders, alphabets and other sequences, and data URIs.

Defined results: a null or empty text has no spans; texts of any length and candidates of any length are read whole, in time
in proportion to their length; spans of one kind never overlap, nor does an added span overlap a base span; spans that tie
in place are listed in the order of KINDS; repeated rows are read each; an empty table gives an empty one; other columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "entropy"]
#: The base patterns and the least sizes of what they find.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # a run that is long enough is found from its first character on, like any run
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16
#: A text without one of these, in lower case, assigns nothing.
ASSIGNED_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Character classes: name, what a string of the class may hold, window length, least entropy of a window in bits, and the
#: least number of kinds of characters (digits, small, capital letters, signs) in it.
CLASSES = [
    ("hex", frozenset("0123456789abcdefABCDEF-"), 20, 3.0, 2),
    ("alnum", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 20, 3.6, 3),
    ("base64", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"), 20, 3.8, 3),
]
LOG = [0.0, *(c * math.log2(c) for c in range(1, 65))]

UUID = re.compile("[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
WORDLIKE = re.compile("[A-Z]?[a-z]{2,}[0-9]{0,2}|[A-Z]{2,}|[0-9]{1,4}")
PARTS = re.compile("[-_/+=]+")
#: Words right before a string that say what else it is; marks of placeholders; a key's own beginnings, which
#: outweigh words before it.
HARMLESS = re.compile(r"(?:commit|checksum|sha-?1|sha-?256|sha-?384|sha-?512|md5|digest|hash|etag|integrity|revision|rev|uuid|guid|fingerprint|isbn|doi|version|build|urn|blob|tree|base64,|data:[a-z]+/[a-z0-9.+-]+;)[\"'=:#( \t]*(?:sha(?:1|256|384|512)[-:])?\Z", re.IGNORECASE)
PLACEHOLDERS = ("example", "placeholder", "changeme", "your", "xxxx", "dummy", "sample", "lorem", "redacted", "deadbeef", "abcdef", "012345", "123456", "qwerty")
KEY_STARTS = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "pk_live_", "AIza", "eyJ", "npm_", "ASIA")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the leftmost matches of each pattern that are long enough."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGNED_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _kind_of(c: str) -> int:
    return 0 if "0" <= c <= "9" else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3


def hot_windows(s: str, window: int, least: float, kinds: int) -> list[tuple[int, int]]:
    """Spans of ``s`` that windows of high entropy cover, from counts that change by one character in and one out."""
    if len(s) < window:
        return []
    most = window * (math.log2(window) - least) + 1e-9  # entropy = log2 w - (sum of c log2 c) / w
    counts: dict[str, int] = {}
    held = [0, 0, 0, 0]
    total = 0.0
    out: list[tuple[int, int]] = []
    for at, c in enumerate(s):
        if at >= window:
            gone = s[at - window]
            n = counts[gone]
            total += LOG[n - 1] - LOG[n]
            counts[gone] = n - 1
            held[_kind_of(gone)] -= 1
        n = counts.get(c, 0)
        total += LOG[n + 1] - LOG[n]
        counts[c] = n + 1
        held[_kind_of(c)] += 1
        if at >= window - 1 and total <= most and sum(k > 0 for k in held) >= kinds:
            start = at - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], at + 1)
            else:
                out.append((start, at + 1))
    return out


def _sequence(s: str) -> bool:
    """Whether most neighbours are equal or follow each other, as in alphabets and runs of one character."""
    steps = sum(0 <= ord(b) - ord(a) <= 1 for a, b in zip(s, s[1:], strict=False))
    return 2 * steps > len(s)


def allowed(text: str, start: int, end: int) -> bool:
    """Whether a string is on the allow-list: no secret, whatever its entropy."""
    s = text[start:end]
    if s.startswith(KEY_STARTS):
        return any(p in s[8:].lower() for p in PLACEHOLDERS[:9])
    if HARMLESS.search(text, max(0, start - 32), start) or text[max(0, start - 3) : start] == "://":
        return True
    low = s.lower()
    if UUID.fullmatch(s) or _sequence(s) or any(p in low for p in PLACEHOLDERS):
        return True
    parts = [p for p in PARTS.split(s) if p]
    plain = sum(len(w) for p in parts for w in WORDLIKE.findall(p) if len(w) >= 4 or w == p)
    return 10 * plain > 6 * sum(map(len, parts))  # a path, joined words, or a name in camel case


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Strings of high entropy that are not on the allow-list, from left to right, each whole."""
    out = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        for _, held, window, least, kinds in CLASSES:
            if held.issuperset(s):  # the narrowest class that holds the string
                if hot_windows(s, window, least, kinds) and not allowed(text, m.start(), m.end()):
                    out.append(m.span())
                break
    return out


def secret_spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind, end), sorted; an added span gives way to base spans."""
    if not text:
        return [], []
    base = sorted(base_spans(text))
    taken: list[tuple[int, int]] = []
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    added, k = [], 0
    for s, e in entropy_spans(text):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k == len(taken) or taken[k][0] >= e:
            added.append((s, len(BASE), e))
    return base, sorted(base + added)


def _label(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and every row's base and all spans, as kind:start:end by start (code points, end exclusive)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [secret_spans(t) for t in b.pop("text")]
            yield b.assign(
                **{f"n_{name}": [sum(x[1] == k for x in base) for base, _ in found] for k, name in enumerate(BASE)}, base=[_label(base) for base, _ in found], spans=[_label(every) for _, every in found]
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def redacted(text: str | None, mark: str = "*") -> str | None:
    """A text with every character of its secrets replaced."""
    if text is None:
        return None
    out, at = [], 0
    for s, _, e in secret_spans(text)[1]:
        if e > at:
            out += [text[at : max(s, at)], mark * (e - max(s, at))]
            at = e
    return "".join(out) + text[at:]
