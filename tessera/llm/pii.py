"""Personal data by candidate gradient boosting.

Four exact rules give the base spans. High-recall generators propose further,
overlapping spans of personal data and of secrets (keys, tokens, passwords); boosted
trees judge each by its format and context. The trees are fitted on half of the
examples, their probabilities calibrated on a quarter, and the threshold at the
wanted precision is set on the last quarter. The examples are made up here, so no
text is learned from.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import ship
from .gbdt import Boosted, boost

BASE = ("email", "ip", "card", "phone")
ADDED = ("email_spelled", "iban", "ipv6", "phone_local", "ssn", "secret", "private_key")
KINDS = (*BASE, *ADDED)
RANK = {k: i for i, k in enumerate(KINDS)}
#: The precision on held-back examples that the added spans must reach.
PRECISION = 0.995
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive, and from the first digit of a run only: a match from a later one would fail alike, so long runs stay linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
GENERATORS = {
    "email_spelled": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]+)+"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ipv6": re.compile(r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:])"),
    "phone_local": re.compile(r"(?<![A-Za-z0-9+])\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![A-Za-z0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![A-Za-z0-9-])"),
}
#: Any long run of characters that keys are written in; a dot ends it unless more of the like follows.
KEY_RUN = re.compile(r"(?<![A-Za-z0-9+/_=~-])[A-Za-z0-9+/_~-]{16,}+(?:\.[A-Za-z0-9_-]{8,}+)*+={0,2}(?![A-Za-z0-9])")
#: Steps over words too short for a key; what it stops at is a longer one.
SHORT_WORDS = re.compile(r"\s*(?:\S{1,15}+(?!\S)\s*)*+")
LONG_WORD = re.compile(r"\S++")
#: One of these is in every text that SECRET_NAME finds something in.
SECRET_WORDS = ("token", "secret", "passw", "passphrase", "pwd", "key", "auth", "credential", "bearer", "kennwort", "contrase", "mot de passe")
SECRET_NAME = re.compile(r"token|secret|passw|passphrase|pwd|api.?key|access.?key|auth|credential|bearer|client.?key|private.?key|signing.?key|kennwort|contrase|mot de passe", re.I)
ASSIGNED = re.compile(r"[A-Za-z0-9_-]{0,40}+(?:[\"'\])]{1,2})?(?: {0,3}(?:=>|:=|[=:])| is) {0,3}(?:bearer |basic )?[\"']?([^\s\"'<>,;()]{6,})", re.I)
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,-]*?-----END [A-Z ]{0,40}PRIVATE KEY-----|[A-Za-z0-9+/=\s]*)")
HASH_CUES = re.compile(r"commit|sha|md5|checksum|hash|digest|etag|revision|uuid|guid|blob|base64|integrity|fingerprint|crc|build", re.I)
KNOWN = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk[-_]|pk[-_]|rk[-_]|xox[abprs]-|eyJ|AIza|ya29\.|SG\.|npm_|dop_v1_)")
GOOD_CUES = re.compile(r"phone|tel|call|fax|mobil|cell|ssn|social|iban|account|konto|mail|contact|reach|write|text|address|host", re.I)
BAD_CUES = re.compile(r"order|invoice|isbn|version|page|part|model|serial|item|ref|score|range|code|total|year", re.I)

FEATURES = 32

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """The email rule, looking only around each @ (the local part is the run before it)."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    out = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], RANK[s[2]]))


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of all generators."""
    out: list[Span] = []
    if "(at)" in text or "[at]" in text:
        out += [(m.start(), m.end(), "email_spelled") for m in GENERATORS["email_spelled"].finditer(text)]
    if DIGIT.search(text):
        for kind in ADDED[1:5]:
            out += [(m.start(), m.end(), kind) for m in GENERATORS[kind].finditer(text)]
    at = SHORT_WORDS.match(text).end()
    while at < len(text):
        end = LONG_WORD.match(text, at).end()
        out += [(m.start(), m.end(), "secret") for m in KEY_RUN.finditer(text, at, end)]
        at = SHORT_WORDS.match(text, end).end()
    low = text.lower()
    if any(w in low for w in SECRET_WORDS):
        for name in SECRET_NAME.finditer(text):
            if m := ASSIGNED.match(text, name.end()):
                out.append((*m.span(1), "secret"))
    if "-----BEGIN" in text:
        out += [(m.start(), m.end(), "private_key") for m in KEY_BLOCK.finditer(text)]
    return list(dict.fromkeys(out))


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    if not 15 <= len(s) <= 34 or not s.isalnum():
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def classes(s: str) -> list[float]:
    """What a run is made of: shares of digits, capitals and small letters, changes between them, its longest
    run of letters, entropy of a character."""
    n = max(len(s), 1)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    letters = max(map(len, re.findall(r"[A-Za-z]+", s)), default=0)
    counts = [s.count(c) / n for c in set(s)]
    return [kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, changes / n, float(letters), -sum(p * math.log2(p) for p in counts)]


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    start, end, kind = span
    s = text[start:end]
    near = text[max(0, start - 32) : start]
    digits = [c for c in s if c.isdigit()]
    groups = re.findall(r"[0-9A-Za-z]+", s)
    before, after = text[start - 1 : start], text[end : end + 1]
    seps = {c for c in s if not c.isalnum()}
    area = "".join(digits[:3])
    # the nearest cue counts: a hash in a line about tokens is none
    secret, hashed = (max((m.end() for m in cue.finditer(near)), default=-1) for cue in (SECRET_NAME, HASH_CUES))
    return [
        float(ADDED.index(kind)), float(end - start), float(len(digits)), float(len(groups)), float(len(groups[0]) if groups else 0), float(len(seps)),
        float(s.startswith("(")), float("-" in s), float("." in s), float(" " in s), float(kind == "iban" and iban_valid(s)),
        float(kind == "ssn" and area not in ("000", "666") and area < "900" and "".join(digits[3:5]) != "00"), float(len(set(s.lower()))),
        float(bool(GOOD_CUES.search(near))), float(bool(BAD_CUES.search(near))), float(before in "/=_#.,"), float(after in "/=_%-"), float(near[-2:-1] == ":"),
        *classes(s), float(not s.strip("0123456789abcdefABCDEF")), float(s.count("/")), float(s.count("_") + s.count("-")), float(bool(KNOWN.match(s))),
        float(secret >= 0 and secret > hashed), float(hashed > secret), float(before in "\"'" and after in "\"'" and bool(before)), float(near.rstrip(" \"'")[-1:] in ("=", ":") or near.rstrip(" \"'")[-2:] == "=>"),
    ]


def examples(n: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Made-up personal data and secrets in context, and look-alikes: numbers of orders, versions, ranges, hashes of
    files and commits, addresses of pages, long words, names in programs."""
    rng = random.Random(11)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    cue = lambda *xs: rng.choice([*xs, *xs, word()]) + rng.choice([" ", ": ", " is ", " at "])

    def iban(valid: bool) -> str:
        body = d(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        if not valid:
            check = (check + rng.randint(1, 90)) % 97
        s = f"DE{check:02d}{body}"
        return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    makers = [
        (1, lambda: cue("phone", "call me", "tel", "mobile", "fax") + rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}"])),
        (1, lambda: rng.choice(["ssn", "social security", "my ssn"]) + rng.choice([": ", " ", " is "]) + f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{d(4)}"),
        (1, lambda: cue("iban", "account", "konto") + iban(True)),
        (1, lambda: cue("host", "address", "from") + ":".join(f"{rng.randrange(65536):x}" for _ in range(8))),
        (1, lambda: cue("mail", "write", "contact") + f"{word()}{rng.choice([' (at) ', '(at)', ' [at] '])}{word()}{rng.choice([' (dot) ', '.', ' [dot] '])}com"),
        (0, lambda: rng.choice(["order ", "invoice ", "ref ", "part ", "item ", "serial ", "", word() + " "]) + rng.choice([f"{d(2)}-{d(3)}-{d(4)}", f"{d(4)}.{d(3)}.{d(4)}", f"{d(3)}-{d(3)}-{d(4)}/", f"{d(4)} {d(3)} {d(4)}", f"#{d(3)}-{d(3)}-{d(4)}"])),
        (0, lambda: rng.choice(["code ", "ref ", "page ", "total ", "score ", word() + " "]) + rng.choice([f"{d(3)} {d(2)} {d(4)}", f"{rng.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}", f"{d(3)}-00-{d(4)}", f"{d(3)} {d(2)} {d(4)}"])),
        (0, lambda: rng.choice(["", "key ", "code "]) + iban(False)),
        (0, lambda: rng.choice(["time ", "ratio ", "mac "]) + ":".join(d(2) for _ in range(8))),
    ]
    hexes, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    run = lambda chars, *sizes: "".join(rng.choice(chars) for _ in range(rng.choice(sizes)))
    upper = lambda s: s.upper() if rng.random() < 0.3 else s

    def key() -> str:
        return rng.choice([
            lambda: upper(run(hexes, 24, 32, 40, 48, 64)), lambda: run(alnum, 20, 24, 32, 40, 64), lambda: run(alnum + "+/", 24, 40, 43) + rng.choice(["", "=", "=="]), lambda: run(alnum + "_-", 22, 32, 43),
            lambda: rng.choice(["ghp_", "sk-", "sk_live_", "xoxb-", "AIza", "glpat-"]) + run(alnum, 16, 24, 36), lambda: "AKIA" + run(alnum[:26] + "234567", 16), lambda: "eyJ" + ".".join(run(alnum, 20, 40, 60) for _ in range(3)),
        ])()

    def named() -> str:
        name = rng.choice(["token", "api_key", "apikey", "secret", "client_secret", "access_token", "auth_token", "AWS_SECRET_ACCESS_KEY", "private_key", "api-key", "my token", "refresh_token", "credential"])
        how, quote = rng.choice([" = ", "=", ": ", ":", " := ", " => ", '": ']), rng.choice(['"', '"', "'", ""])
        return upper(name) + how + quote + key() + quote + rng.choice(["", "", ";", ",", "!!", "***", "."])

    def password() -> str:
        size = rng.randint(8, 18)
        s = "".join(rng.choice(alnum + "!#$%*-_@") for _ in range(size - 2)) + rng.choice("0123456789") + rng.choice("!#$%*0123456789")
        return upper(rng.choice(["password", "passwd", "pwd", "passphrase", "db_password"])) + rng.choice(["=", " = ", ": ", " is "]) + rng.choice(['"{}"', "'{}'", "{}"]).format(s)

    def plain_name() -> str:
        return "".join(w.capitalize() if rng.random() < 0.5 else w for w in (word() for _ in range(rng.randint(2, 5))))

    def long_word() -> str:
        return rng.choice(["", "-", "_", "/"]).join(word() for _ in range(rng.randint(4, 9)))

    def in_program() -> str:
        right = rng.choice([lambda: plain_name() + "()", lambda: "_".join(word() for _ in range(3)), lambda: word() + "." + plain_name(), lambda: word() + word(), lambda: "required", lambda: "********", lambda: "<your-token>", lambda: long_word()])()
        return rng.choice(["token", "password", "secret", "auth", "api_key", "passwd"]) + rng.choice([" = ", ": ", "=", " is "]) + right

    makers += [
        (1, named), (1, named), (1, named), (1, password),
        (1, lambda: rng.choice(["Authorization: Bearer ", "authorization: Basic ", "bearer "]) + key()),
        (1, lambda: rng.choice(["", word() + " "]) + rng.choice(["ghp_", "sk-", "sk_live_", "xoxb-", "AIza", "glpat-"]) + run(alnum, 16, 24, 36)),
        (1, lambda: rng.choice(["", word() + " "]) + rng.choice(["AKIA", "ASIA"]) + run(alnum[:26] + "234567", 16)),
        (1, lambda: "-----BEGIN " + rng.choice(["", "RSA ", "EC ", "OPENSSH "]) + "PRIVATE KEY-----\n" + "\n".join(run(alnum + "+/", 64) for _ in range(rng.randint(2, 6))) + "\n-----END PRIVATE KEY-----"),
        (0, lambda: rng.choice(["commit ", "sha1 ", "sha256:", "md5 = ", "md5: ", "checksum: ", 'etag = "', "revision ", "hash: ", 'digest="', "sha256 = "]) + upper(run(hexes, 32, 40, 64)) + rng.choice(["", '"'])),
        (0, lambda: rng.choice(["", "uuid ", "id=", "guid: "]) + "-".join(run(hexes, k) for k in (8, 4, 4, 4, 12))),
        (0, lambda: rng.choice(["https://", "http://www.", "/usr/", "see ", ""]) + "/".join(rng.choice([word(), d(4), d(2), word() + "-" + word()]) for _ in range(rng.randint(4, 7))) + rng.choice(["", ".html", "/", ".png"])),
        (0, long_word), (0, plain_name), (0, in_program), (0, in_program),
        (0, lambda: rng.choice(["=", "-", "_", "~", "/"]) * rng.randint(16, 60)), (0, lambda: run("ACGT", 20, 40, 80)), (0, lambda: rng.choice(["", "no ", "order ", "isbn "]) + d(rng.randint(16, 24))),
        (0, lambda: rng.choice(["data:image/png;base64,", "base64,", "integrity=sha384-"]) + run(alnum + "+/", 40, 64, 120)),
        (0, lambda: rng.choice(["a", "ha", "la", "xyz", "1", "10", "ab1"]) * rng.randint(9, 40)),
        (0, lambda: "_".join(rng.choice([word(), word().upper(), d(2), "v" + d(1)]) for _ in range(rng.randint(3, 6)))),
    ]
    x, y = [], []
    turn = 0
    while len(y) < n:
        label, make = makers[turn % len(makers)]
        turn += 1
        text = f"{word()} {word()} {make()} {word()}"
        if rng.random() < 0.1:
            text = text.upper() if not label else text
        for span in candidates(text):
            x.append(describe(text, span))
            y.append(label)
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(y))
    return np.array(x)[order], np.array(y, float)[order]


@cache
def trained(precision: float = PRECISION) -> tuple[Boosted, float]:
    """The trees, and the least probability from which held-back examples reach the precision.

    Half of the examples fit the trees, a quarter calibrates, a quarter sets the threshold.
    """
    x, y = examples()
    part = np.arange(len(y)) % 4
    model = boost(x, y, part < 2, part == 2)
    p, t = model.probability(x[part == 3]), y[part == 3]
    order = np.argsort(-p)
    right = np.cumsum(t[order]) / np.arange(1, len(t) + 1)
    ok = np.flatnonzero(right >= precision)
    return model, max(float(p[order][ok[-1]]) if len(ok) else 1.1, 0.8)


def added_spans(text: str, base: list[Span], model: Boosted, threshold: float) -> list[Span]:
    """What the trees add to the base spans of one text."""
    found = candidates(text)
    return chosen(found, model.probability(np.array([describe(text, s) for s in found])), base, threshold) if found else []


def chosen(found: list[Span], p: np.ndarray, base: list[Span], threshold: float) -> list[Span]:
    """Proposals above the threshold, the longest (then the likeliest) where they overlap; none overlaps a base span."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e, _ in sorted(base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = []
    for k in sorted(np.flatnonzero(p >= threshold).tolist(), key=lambda k: (found[k][0] - found[k][1], -p[k], found[k])):
        start, end, _ = found[k]
        # what is taken is disjoint and in order, so only the last one that starts before the end can overlap
        at = bisect_left(starts, end)
        if not at or ends[at - 1] <= start:
            starts.insert(at, start)
            ends.insert(at, end)
            out.append(found[k])
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], RANK[x[2]])))


def find(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all, in code points), n_spans (their number).

    Null and empty texts have no spans. Spans of different base kinds may overlap; added
    ones overlap nothing. Repeated rows get equal results; other columns are ignored.
    """
    ship(docs.sparkSession)
    model, threshold = trained()
    names = ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_spans"]
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *[StructField(n, LongType()) for n in names[1:5]], StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("n_spans", LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                x = batch.slice(at, 1000)
                rows, texts = [], [t.as_py() or "" for t in x.column("text")]
                # the trees judge the proposals of all texts at once
                found = [candidates(s) for s in texts]
                p = np.split(model.probability(np.array([describe(s, c) for s, own in zip(texts, found, strict=True) for c in own]).reshape(-1, FEATURES)), np.cumsum([len(own) for own in found])[:-1])
                for k, s in enumerate(texts):
                    base = base_spans(s)
                    more = chosen(found[k], p[k], base, threshold) if found[k] else []
                    n = [sum(b[2] == k for b in base) for k in BASE] if base else [0, 0, 0, 0]
                    rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(base) + len(more)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:6]], pa.array(cols[6], pa.int64())], names)

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one."""
    out, end = [], 0
    for item in spans.split(",") if spans else []:
        kind, s, e = item.rsplit(":", 2)
        if int(s) >= end:
            out += [text[end : int(s)], f"[{kind}]"]
        end = max(end, int(e))
    return "".join([*out, text[end:]])
