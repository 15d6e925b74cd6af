"""Secrets in text: fixed patterns, and candidate strings of high entropy.

Patterns (kinds ``assign``, ``access``, ``hex``) are matched leftmost and
non-overlapping; a match that fails its length test is dropped.

The entropy scan adds spans of kind ``entropy``.  Candidates are maximal runs
of base64-like characters, without the patterns' spans.  A window of ``WINDOW`` characters slides over each
run of a character class inside the candidate; the counts of its characters,
and the sum of c*log2(c) that gives its Shannon entropy, change by the one that
leaves and the one that enters.  A run is a span, whole, if one of its windows reaches the class's threshold,
which 99 of 100 windows of random characters of the class do, and the run holds each kind of
character of the class.  The allow-list drops harmless candidates (identifiers in UUID form, paths
and addresses, numbers, words without digits, published checksums).  So random keys without a digit
are lost, and keys of fewer than ``WINDOW`` characters are no candidates.

Nulls: a null text is read as empty and has no spans.  Every input row gives
one row; empty tables give empty results; texts of any length are scanned whole
(bytes are first reduced to character classes, so plain prose costs a few
memory scans).
"""

from __future__ import annotations

import math
import re
from itertools import islice, takewhile

from pyspark.sql import DataFrame

from lexiflow.llm.common import scan_spans, span_digest

KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Class -> (its runs, least entropy in bits of a window, kinds of character that a run must hold). The entropies are the
#: first percentiles of 100,000 random windows (hex 2.884; base32 3.346, base36 3.404; base62 and base64 3.646), rounded down.
CLASSES = {
    "hex": (re.compile(r"[0-9A-Fa-f]{%d,}" % WINDOW), 2.88, (frozenset("0123456789"), frozenset("abcdefABCDEF"))),
    "base36": (re.compile(r"[0-9A-Z]{%d,}|[0-9a-z]{%d,}" % (WINDOW, WINDOW)), 3.34,
               (frozenset("0123456789"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))),
    "base64": (re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % WINDOW), 3.64, (frozenset("0123456789"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                                frozenset("abcdefghijklmnopqrstuvwxyz"))),
}
CLOG = [0.0, 0.0, *(c * math.log2(c) for c in range(2, WINDOW + 1))]

#: Candidates that match one of these, whole, are not secrets.
ALLOWED = [re.compile(x) for x in (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # identifiers
    r"[0-9_=+/-]+",                                         # numbers, dates, rulers
    r"[A-Za-z_=+/-]+",                                      # words, also joined ones
    r"/?([a-z0-9_-]+/)+[a-z0-9_-]*",                        # paths
    r"([A-Za-z]+[0-9]{0,4}[-_])+[A-Za-z]*[0-9]{0,4}",       # names with numbered parts
)]
#: What stands right before a candidate that is published on purpose.
PUBLISHED = re.compile(r"(?:sha(?:1|256|384|512)|md5|commit|integrity|etag|checksum|digest)[\"']?\s*[-:= ]\s*[\"']?$|://\S*$", re.I)

_TO_HEX = bytes(104 if chr(c) in "0123456789abcdef" else 46 for c in range(256))
_TO_RUN = bytes(120 if CANDIDATE.fullmatch(chr(c) * WINDOW) else 46 for c in range(256))


def pattern_spans(text: str, raw: bytes) -> list[tuple[str, int, int, bool]]:
    """Spans of the fixed patterns; ``raw`` is the text with one byte for each code point."""
    out = []
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end(), True) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end(), True) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"h" * 16 in raw.translate(_TO_HEX):
        out += [("hex", m.start(), m.end(), True) for m in HEX.finditer(text)]
    return out


def hot_windows(run: str, least: float, need) -> list[tuple[int, int]]:
    """Joined [start, end) of the windows of ``run`` whose entropy is at least ``least``."""
    count: dict[str, int] = {}
    have = [0] * len(need)
    total, spans = 0.0, []
    for i, c in enumerate(run):
        n = count.get(c, 0)
        total += CLOG[n + 1] - CLOG[n]
        count[c] = n + 1
        for k, s in enumerate(need):
            have[k] += c in s
        if i >= WINDOW:
            d = run[i - WINDOW]
            n = count[d]
            total += CLOG[n - 1] - CLOG[n]
            count[d] = n - 1
            for k, s in enumerate(need):
                have[k] -= d in s
        if i >= WINDOW - 1 and math.log2(WINDOW) - total / WINDOW >= least and all(x >= 2 for x in have):
            a = i - WINDOW + 1
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((a, i + 1))
    return spans


def entropy_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int, bool]]:
    found, taken, k = [], sorted(taken), 0
    for m in CANDIDATE.finditer(text):
        word, at = m.group(), m.start()
        if any(x.fullmatch(word) for x in ALLOWED) or PUBLISHED.search(text[max(0, at - 40):at]):
            continue
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        for a, b in takewhile(lambda t, end=m.end(): t[0] < end, islice(taken, k, None)):
            a, b = max(a - at, 0), min(b - at, len(word))
            word = word[:a] + " " * (b - a) + word[b:]  # a blank is in no run
        for runs, least, need in CLASSES.values():
            found += [(at + r.start(), at + r.end()) for r in runs.finditer(word)
                      if all(any(c in s for c in r.group()) for s in need) and hot_windows(r.group(), least, ())]
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and a < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return [("entropy", a, b, False) for a, b in joined]


def secret_spans(text: str) -> list[tuple[str, int, int, bool]]:
    raw = text.encode("ascii", "replace")
    out = pattern_spans(text, raw)
    if b"x" * WINDOW in raw.translate(_TO_RUN):
        out += entropy_spans(text, [s[1:3] for s in out])
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row."""
    return scan_spans(df, id_col, text_col, lambda: secret_spans)


def report(docs: DataFrame) -> DataFrame:
    return span_digest(scan(docs), KINDS)
