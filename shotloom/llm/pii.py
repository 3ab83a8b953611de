"""Personal data by weak supervision.

Base spans come from four exact patterns.  Beside these, candidate spans (card-like, phone-like and id-like numbers,
secrets, names after a title, street addresses) are judged by labelers that vote yes, no or nothing: pattern labelers,
gazetteer labelers and context labelers.  All votes over the corpus are counted by pattern; expectation-maximisation
estimates, for each kind, how often each labeler votes which way on true and on false spans.  The posteriors of a bounded
sample of candidates then train the final span classifier, a logistic regression on votes, on the words around a span and
on its shape, so it can tell apart what no labeler names.  Candidates that it accepts become spans.

Examples made by rule (seed_examples), true and false ones of each kind, anchor both steps: a corpus in which all
candidates are alike would not say what a false one looks like.

One pass reads the texts and writes base spans and candidates; the counts (a few thousand patterns at most) are summed
by Spark, so the estimates cover every document.  All searches take time in proportion to the text.

Defined results: a null or empty text has no spans; texts of any length, and runs of any length without a space, are read
whole; repeated rows are read each; candidates that tie in place go to the kind that is listed first; an empty table gives
an empty one; other columns are not read, so their names cannot clash.  Spans of one kind never overlap, nor does an added
span overlap a base span.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BASE = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a match cannot start inside a run of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Candidate kinds in the order that they are listed after the base kinds, and their patterns.
CANDIDATES = {
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "secret": re.compile(r"(?<![\w/+-])[A-Za-z0-9_/+-]{20,}+={0,2}(?![\w/+-])"),
    "local_phone": re.compile(r"(?<![\w+-])(?<!\w\.)(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-]|\.\w)"),
    "address": re.compile(r"(?<!\w)[0-9]{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard|St|Ave|Rd|Blvd)(?!\w)"),
    "person": re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?"),
}
KINDS = [*BASE, *CANDIDATES]
#: A text without any of these signs or words holds no candidate of the kind (cheap test before a pattern).
NEEDS = {"address": re.compile("Street|Avenue|Road|Lane|Drive|Boulevard|St|Ave|Rd|Blvd"), "person": re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof)\b")}
#: Words near a span that speak for its kind, and words that speak for something harmless.
CUES = {
    "ssn": {"ssn", "social", "security", "taxpayer", "insured", "born"}, "iban": {"iban", "account", "bank", "transfer", "konto", "compte", "payee", "beneficiary"},
    "secret": {"token", "key", "secret", "password", "passwd", "pwd", "api", "apikey", "bearer", "aws", "private", "credential", "credentials", "authorization", "auth", "passphrase"},
    "local_phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "contact", "dial", "reach", "ring", "number", "text", "voicemail", "extension"},
    "address": {"address", "lives", "living", "resident", "residing", "home", "ship", "deliver", "delivery", "mail", "moved", "at"},
    "person": {"patient", "contact", "name", "signed", "dear", "by", "sincerely", "regards", "client", "tenant", "employee", "met", "from", "told", "asked", "wrote", "thank", "thanked", "said", "says", "saw", "with", "to", "for", "agreed", "arrived"},
}
HARMLESS = set(
    "version isbn issn doi page pages figure fig table chapter section sha sha1 sha256 commit checksum hash digest md5 uuid guid etag revision build order invoice example serial part model item catalog sku path file directory "
    "package library module class movie film novel drink brand episode series song album character game ticket row lot measurement ratio score".split()
)
#: Of these, words for where a personal number is kept.
ON_RECORD = {"file", "path", "directory", "class", "page"}
#: Account number lengths by country code; common first and last names; beginnings of well-known tokens.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GE": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26, "UA": 29,
}
FIRST_NAMES = set(
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Donald Steven Paul Andrew Peter George Kenneth Kevin Brian Edward Ronald Jason Jeffrey Ryan Jacob Gary Eric Frank "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Betty Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Laura Anna Maria Helen Julia Emma Olivia Sophia Claire Marie "
    "Jean Pierre Luc Hans Klaus Jürgen Stefan Andreas Petra Sabine Carlos Juan Jose Luis Ana Carmen Giulia Marco Paolo Ivan Olga Elena Ahmed Mohammed Fatima Wei Li Ming Priya Raj Amit Kenji Yuki".split()
)
LAST_NAMES = set(
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Perez Thompson White Harris Sanchez Clark Lewis Robinson Walker "
    "Young Allen King Wright Scott Torres Hill Green Adams Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Weber Schmidt Fischer Meyer Wagner Becker Schulz Hoffmann Dubois Durand Moreau Rossi Bianchi "
    "Silva Santos Kim Park Nguyen Tran Chen Wang Zhang Singh Kumar Patel Khan Ali Tanaka Sato Novak Kowalski Jansen Larsen".split()
)
#: Names after a title that are brands or characters.
NOT_PERSONS = set("Pepper Robot Clean Strange Doubtfire Bean Muscle Potato Incredible Who Evil Dre Seuss".split())
TOKEN_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "npm_", "SG.")
VOTES = ["form", "gazetteer", "cue", "harmless", "shape", "layout"]
HASHED = 1024  # places of context and shape features
SAMPLE = 4000  # candidates that the classifier is trained on beside the examples, at most


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a domain of two labels or more: from each @ to the left and to the right."""
    out, done = [], 0
    while (at := text.find("@", done)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end): leftmost matches of each pattern, those that pass its test."""
    out = [(0, s, e) for s, e in emails(text)]
    if "." in text:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def _entropy(s: str) -> float:
    n = np.unique(list(s), return_counts=True)[1] / len(s)
    return float(-(n * np.log2(n)).sum())


def _form(kind: str, s: str) -> int:
    """Pattern labeler: does the span satisfy its kind's own check?"""
    if kind == "ssn":
        a, b, c = s.split("-")
        return 1 if a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000" else -1
    if kind == "iban":
        t = s.replace(" ", "")
        return 1 if len(t) == IBAN_LENGTHS.get(t[:2], len(t)) and 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1 else -1
    if kind == "secret":
        return 1 if _entropy(s) > 3.0 else -1
    if kind == "local_phone":
        d = _digits(s)
        return 1 if d[0] not in "01" and d[3] not in "01" else -1
    return 0


def _gazetteer(kind: str, s: str) -> int:
    if kind == "iban":
        return 1 if s[:2] in IBAN_LENGTHS else -1
    if kind == "secret":
        return 1 if s.startswith(TOKEN_STARTS) else 0
    if kind == "person":
        names = s.split()[1:]
        known = any(w in FIRST_NAMES or w in LAST_NAMES for w in names)
        return 1 if known else -1 if names[0] in NOT_PERSONS else 0  # a name that no list holds says nothing
    return 0


def _shape(kind: str, s: str) -> int:
    """Pattern labeler: signs inside the span that speak for or against it."""
    if kind == "secret":
        if re.fullmatch("[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}", s):
            return -1
        parts = re.split("[-_/+]", s)
        plain = sum(len(p) for p in parts if re.fullmatch("[A-Z]?[a-z]{2,14}[0-9]?|[A-Z]{2,10}|[0-9]{1,4}", p))
        if plain > 0.6 * sum(map(len, parts)):  # a path, or words and numbers joined
            return -1
        return 1 if all(re.search(c, s) for c in ("[0-9]", "[a-z]", "[A-Z]")) else 0
    if kind in ("ssn", "local_phone", "iban"):
        return -1 if len(set(_digits(s))) < 3 else 0
    return 0


def _layout(kind: str, text: str, start: int) -> int:
    """Context labeler: what stands right before the span."""
    before = text[max(0, start - 4) : start].rstrip("\"' ")
    if before.endswith(("=", ":")):
        return 1
    return -1 if before.endswith(("#", "$", "§")) or (kind == "secret" and before.endswith((".", "~", "\\", "@"))) else 0


def _near(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Words before and after a span."""
    return re.findall("[a-z0-9]+", text[max(0, start - 40) : start].lower()), re.findall("[a-z0-9]+", text[end : end + 20].lower())


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    s = text[start:end]
    before, after = _near(text, start, end)
    near = {*before, *after}
    # "SSN on file": a file is no argument against a number that is named; a secret's own words may stand in a path
    harmless = near & (HARMLESS - ON_RECORD if kind != "secret" and near & CUES[kind] else HARMLESS)
    return (_form(kind, s), _gazetteer(kind, s), 1 if near & CUES[kind] else 0, -1 if harmless else 0, _shape(kind, s), _layout(kind, text, start))


def signs(kind: str, text: str, start: int, end: int) -> list[int]:
    """Hashed features of a candidate: the words around it and its own shape."""
    s = text[start:end]
    before, after = _near(text, start, end)
    classes = re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s))))
    named = [*(f"<{w}" for w in before[-4:]), *(f">{w}" for w in after[:2]), f"={classes[:12]}", f"n{min(len(s), 80) // 4}", f"e{int(4 * _entropy(s))}"]
    return sorted({zlib.crc32(f"{kind} {x}".encode()) % HASHED for x in named})


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (sorted, apart from each other) that overlap none that is taken (sorted by start, ends never falling)."""
    out, k = [], 0
    for s, e in spans:
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k == len(taken) or taken[k][0] >= e:
            out.append((s, e))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of spans that overlap no base span and no earlier one."""
    out = []
    taken: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in base):  # base spans of two kinds may overlap: their union
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    for k, (kind, pattern) in enumerate(CANDIDATES.items(), len(BASE)):
        if kind in NEEDS and not NEEDS[kind].search(text):
            continue
        found = _free([m.span() for m in pattern.finditer(text) if kind != "secret" or re.search("[0-9]", m.group())], taken)
        out += [(k, s, e) for s, e in found]
        taken = sorted(taken + found)
    return out


def judged(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(kind, start, end, vote pattern in base three, hashed features) of each candidate."""
    out = []
    for k, s, e in candidates(text, base):
        code = 0
        for v in votes(KINDS[k], text, s, e):
            code = 3 * code + v + 1
        out.append((k, s, e, code, signs(KINDS[k], text, s, e)))
    return out


def _decode(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3**k % 3 - 1 for k in range(len(VOTES) - 1, -1, -1)], axis=1)


def seed_examples(each: int = 60, seed: int = 8) -> list[tuple[str, bool]]:
    """Texts with one candidate, and whether it is personal: sentences by rule, with random numbers, names and keys."""
    r = random.Random(seed)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda: r.choice("core data local share lib model train report image test python cache result build common user config".split())

    def hexed(*sizes: int) -> str:
        return some("0123456789abcdef", r.choice(sizes))

    def key() -> str:
        return r.choice([lambda: hexed(32, 40, 48, 64), lambda: some(lower + upper + digits, r.randint(24, 48)), lambda: some(lower + upper + digits + "/+", 40), lambda: "AKIA" + some(upper + digits, 16), lambda: r.choice(["ghp_", "sk-"]) + some(lower + upper + digits, 36)])()

    def no_key() -> str:
        uuid = "-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
        path = "/" + "/".join(word() for _ in range(r.randint(3, 5))) + f"/v{r.randint(1, 9)}/{word()}"
        joined = r.choice("-_").join(word() for _ in range(4)) + f"-{r.randint(1, 2030)}"
        return r.choice(["commit {h}", "sha256 checksum {h}", "md5 hash {h}", "revision {h} was merged", "digest: {h}", "uuid {u}", "request {u} failed", "object {u}", "see {p}", "installed in {p} today", "open {p}", "the {j} package", "branch {j}", "tag {j}"]).format(h=hexed(32, 40, 64), u=uuid, p=path, j=joined)

    def iban(good: bool) -> str:
        country = r.choice([c for c, n in IBAN_LENGTHS.items() if n in (20, 22, 24)])
        rest = some(digits, IBAN_LENGTHS[country] - 4)
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        t = country + f"{check if good else (check + r.randint(1, 90)) % 97:02}" + rest
        return t if r.random() < 0.5 else " ".join(t[i : i + 4] for i in range(0, len(t), 4))

    local = lambda: f"{some('23456789', 1)}{some(digits, 2)}-{some('23456789', 1)}{some(digits, 2)}-{some(digits, 4)}"
    ssn = lambda: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"
    road = lambda: f"{r.randint(1, 999)} {r.choice(['Oak', 'Maple', 'Church', 'Park', 'High', 'Mill'])} {r.choice(['Street', 'Avenue', 'Road', 'Lane', 'Drive'])}"
    names = sorted(FIRST_NAMES), sorted(LAST_NAMES)
    syllables = "ba ber da den el fa gar ha jo ka kin la lund ma mor na ol pe qui ra ros sa sen ta tor u va vik wen zo".split()
    made = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 4))).capitalize()
    title = lambda: r.choice(["Mr.", "Mrs.", "Ms", "Ms.", "Dr.", "Prof.", "Mr"])
    # listed names, and made-up ones that no list holds, with and without a first name
    person = lambda: f"{title()} {r.choice([lambda: f'{r.choice(names[0])} {r.choice(names[1])}', lambda: made(), lambda: made(), lambda: f'{made()} {made()}'])()}"
    no_person = lambda: r.choice([lambda: r.choice(["Dr Pepper", "Mr Robot", "Mr Clean", "Dr Strange", "Mrs Doubtfire", "Mr Bean"]), lambda: f"{title()} {made()}"])()
    kinds = [
        (["api_key = \"{}\"", "password: {}", "export SECRET_KEY={}", "Authorization: Bearer {}", "the access token is {}", "token={}", "my private key {}"], key, ["{}"], no_key),
        (["SSN {}", "social security number: {}", "her ssn is {}", "insured no. {}", "the SSN in our file is {}"], ssn, ["part {}", "order {} shipped", "catalog item {}", "invoice {}", "serial no. {}", "model {}"], ssn),
        (["IBAN {}", "transfer it to {}", "bank account {}", "account: {}"], lambda: iban(True), ["serial {}", "part no {}", "code {}", "ticket {}"], lambda: iban(False)),
        (["call {}", "phone: {}", "tel. {}", "contact us on {}", "my mobile is {}", "reach me: {}", "her number is {}", "text {} later"], local, ["ratio {}", "score {}", "figure {}", "table {}", "version {}", "order {}", "row {}", "page {}", "part {}"], local),
        (["lives at {}", "home address: {}", "ship to {}", "she moved to {}"], road, ["page {}", "figure {}", "chapter {}", "a song called {}", "episode {}"], road),
        (["Dear {}", "signed by {}", "patient: {}", "I met {} there", "regards, {}", "{} told the court", "we asked {} to wait", "{}", "{} will see you now", "a letter from {}", "the office of {}", "{} has agreed", "{} and others came", "they thanked {}"], person,
         ["the drink {}", "the film {}", "a character named {}", "the brand {}", "an episode of {}", "the song {}", "a novel, {}", "the game {}"], no_person),
    ]
    wrap = lambda t: r.choice(["", "So ", "Then, as was said, "]) + t + r.choice(["", ".", " and so on"])
    out = []
    for yes, make, no, other in kinds:
        out += [(wrap(r.choice(yes).format(make())), True) for _ in range(each)] + [(wrap(r.choice(no).format(other())), False) for _ in range(each)]
    return out


def _seeds() -> tuple[np.ndarray, np.ndarray, list[list[int]], np.ndarray]:
    """(kind, vote pattern, features, truth) of the examples."""
    rows = [(k, code, at, truth) for text, truth in seed_examples() for k, _, _, code, at in judged(text, base_spans(text))]
    return np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), [x[2] for x in rows], np.array([x[3] for x in rows], float)


#: How a labeler that nothing is known of votes (no, nothing, yes) on false and on true spans, and the weight of that belief.
PRIOR, STRENGTH = np.array([[0.3, 0.55, 0.15], [0.1, 0.5, 0.4]]), 6.0


def aggregate_votes(kind: np.ndarray, code: np.ndarray, n: np.ndarray, sure: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rates by kind, vote rates by kind, labeler, truth and vote, posterior of each (kind, vote pattern)).

    Expectation-maximisation over counts ``n``; ``sure`` gives kinds, patterns and truths of examples.  A labeler has vote
    rates of its own for each kind, on true and on false spans, so it may be sharp on one and blind on the other."""
    v, known = _decode(code) + 1, sure if sure is not None else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    w, truth = _decode(known[1]) + 1 if len(known[0]) else np.zeros((0, len(VOTES)), int), known[2]
    rate = np.full(len(KINDS), 0.5)
    table = np.broadcast_to(PRIOR, (len(KINDS), len(VOTES), 2, 3)).copy()
    labeler = np.arange(len(VOTES))[None]
    post = np.full(len(code), 0.5)
    for _ in range(rounds):
        log = np.log(table)
        odds = np.log(rate[kind] / (1 - rate[kind])) + (log[kind[:, None], labeler, 1, v] - log[kind[:, None], labeler, 0, v]).sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        table = np.broadcast_to(PRIOR * STRENGTH, (len(KINDS), len(VOTES), 2, 3)).copy()
        total = np.full((len(KINDS), 2), 4.0)
        for c in (0, 1):
            mine, given = n * (post if c else 1 - post), truth if c else 1 - truth
            np.add.at(table, (kind[:, None], labeler, c, v), mine[:, None])
            np.add.at(table, (known[0][:, None], labeler, c, w), given[:, None])
            total[:, c] += np.bincount(kind, mine, len(KINDS)) + np.bincount(known[0], given, len(KINDS))
        table /= table.sum(axis=3, keepdims=True)
        rate = np.clip(total[:, 1] / total.sum(axis=1), 0.05, 0.95)
    return rate, table, post


PLAIN = len(KINDS) * (1 + 2 * len(VOTES)) + 1  # features that are not hashed


def _features(kind: np.ndarray, code: np.ndarray, hashed: list[list[int]]) -> np.ndarray:
    """Kind, votes of each labeler on the kind, hashed context and shape."""
    v, rows = _decode(code), np.arange(len(kind))
    x = np.zeros((len(kind), PLAIN + HASHED), np.float32)
    x[:, 0] = 1
    x[rows, 1 + kind] = 1
    for j in range(len(VOTES)):
        for side, sign in enumerate((1, -1)):
            on = v[:, j] == sign
            x[rows[on], 1 + len(KINDS) * (1 + 2 * j + side) + kind[on]] = 1
    for row, at in enumerate(hashed):
        x[row, PLAIN + np.asarray(at, np.int64)] = 1
    return x


def train_classifier(kind: np.ndarray, code: np.ndarray, n: np.ndarray, sample: tuple[np.ndarray, np.ndarray, list[list[int]]], steps: int = 40) -> np.ndarray:
    """Weights of the span classifier, fitted to posteriors of the sample and to the truth of the examples (half the
    weight each), by Newton's method; hashed features are held closer to zero than votes."""
    sure = _seeds()
    post = aggregate_votes(kind, code, n, (sure[0], sure[1], sure[3]))[2]
    of = {(k, c): p for k, c, p in zip(kind.tolist(), code.tolist(), post.tolist(), strict=True)}
    mine = np.array([of[k, c] for k, c in zip(sample[0].tolist(), sample[1].tolist(), strict=True)])
    x = np.concatenate([_features(sample[0], sample[1], sample[2]), _features(sure[0], sure[1], sure[2])]).astype(float)
    y = np.concatenate([mine, sure[3]])
    w = np.concatenate([np.full(len(mine), len(sure[3]) / max(1, len(mine))), np.ones(len(sure[3]))])
    used = np.flatnonzero(x.any(axis=0))  # the weight of a feature that no row has is 0
    x, hold = x[:, used], np.where(used < PLAIN, 0.3, 1.5)
    beta = np.zeros(len(used))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(hess, x.T @ (w * (y - p)) - hold * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    whole = np.zeros(PLAIN + HASHED)
    whole[used] = beta
    return whole


def _label(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


FOUND = "doc_id long, base array<int>, found array<struct<kind:int,start:int,end:int,code:int,at:array<int>>>"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans (three numbers each) and judged candidates of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base, found = [], []
            for t in b["text"]:
                spans = base_spans(t or "")
                base.append([x for s in spans for x in s])
                found.append([dict(zip(("kind", "start", "end", "code", "at"), c, strict=True)) for c in judged(t or "", spans)])
            yield pd.DataFrame({"doc_id": b["doc_id"], "base": base, "found": found})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, FOUND)


def fit(slim: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights, from the candidates of find_spans()."""
    each = slim.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    seen = each.groupBy("kind", "code").agg(F.count("*").alias("n")).orderBy("kind", "code").toPandas()  # kinds x 3^6 rows at most
    share = 2.0 * sample / max(1, seen["n"].sum())
    place = F.pmod(F.xxhash64(F.lit("spans"), "doc_id", "start", "end", "at"), F.lit(1_000_000)) / 1_000_000
    some = each.where(place < share).orderBy(place, "kind", "code", "at").limit(sample).select("kind", "code", "at").toPandas()  # ``sample`` rows at most
    numbers = lambda c: c.to_numpy(np.int64)
    return train_classifier(numbers(seen["kind"]), numbers(seen["code"]), seen["n"].to_numpy(float), (numbers(some["kind"]), numbers(some["code"]), list(some["at"])))


def detect(docs: DataFrame, accept: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    slim = materialize(find_spans(docs, id_col, text_col))
    beta = fit(slim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for base, found in zip(b["base"], b["found"], strict=True):
                spans = [tuple(map(int, base[i : i + 3])) for i in range(0, len(base), 3)]
                counts = [sum(k == n for k, _, _ in spans) for n in range(len(BASE))]
                sha = hashlib.sha256(_label(spans).encode()).hexdigest()
                for at in range(0, len(found), 1000):  # a text may hold any number of candidates
                    some = found[at : at + 1000]
                    x = _features(np.array([c["kind"] for c in some]), np.array([c["code"] for c in some]), [c["at"] for c in some])
                    good = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))) >= accept
                    spans += [(int(c["kind"]), int(c["start"]), int(c["end"])) for c, yes in zip(some, good.tolist(), strict=True) if yes]
                rows.append((*counts, sha, _label(spans)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return slim.mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
