"""Secrets in texts: fixed patterns, and random-looking strings by two character Markov models."""

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.common import documents, map_columns

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: What the models judge: runs of key characters, long enough for the ratio to tell.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}  # 0: before the first character
LOOKUP = np.array([CODE.get(chr(i), 0) for i in range(256)])
LEAST = 20
N = len(ALPHABET) + 1
#: Ordinary words and identifiers have as many key characters in a row.
ORDINARY = 4
#: Characters whose transitions are counted at a time.
TEXT = 1 << 20
#: How a match of ``ASSIGN`` begins, in lower case.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Bytes of the characters of a kind become ``x``, all others spaces: whether a text has a long run is one search then.
KEY_BYTES = bytes(120 if chr(i) in CODE else 32 for i in range(256))
HEX_BYTES = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))


def has_run(text: bytes, kind: bytes, n: int) -> bool:
    return b"x" * n in text.translate(kind)


def assignments(text: str) -> list[re.Match]:
    """The matches of ``ASSIGN``, leftmost and not overlapping, tried only where one of ``NAMES`` stands: at every
    character, in either case, the pattern takes most of the time of a scan."""
    low = text.lower()
    if len(low) != len(text):  # a letter that becomes two moves what follows
        return list(ASSIGN.finditer(text))
    places = []
    for name in NAMES:
        at = low.find(name)
        while at >= 0:
            places.append(at)
            at = low.find(name, at + 1)
    out, end = [], 0
    for at in sorted(places):
        m = ASSIGN.match(text, at) if at >= end else None
        if m:
            out.append(m)
            end = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), code points, by start and then kind as listed. Leftmost, not overlapping, for each kind."""
    found = [(m.start(), m.end(), 0) for m in assignments(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if has_run(text.encode(), HEX_BYTES, 24):
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _transitions(counts: Counter, s: str, by: int = 1) -> None:
    last = 0
    for c in s:
        k = CODE.get(c, 0)
        counts[last * N + k] += by
        last = k


def ordinary_transitions(text: bytes) -> np.ndarray:
    """How often each transition comes in the runs of at least ``ORDINARY`` key characters; the sign before a run has
    code 0, so a run's first transition begins there."""
    codes = np.concatenate((np.zeros(1, np.uint16), LOOKUP.astype(np.uint16)[np.frombuffer(text, np.uint8)], np.zeros(ORDINARY, np.uint16)))
    key = codes > 0
    n = len(text) + 1
    begins = np.logical_and.reduce([key[i : i + n] for i in range(ORDINARY)])  # as many key characters from here on
    held = begins.copy()
    for i in range(1, ORDINARY):
        held[i:] |= begins[:-i]
    return np.bincount((codes[: n - 1] * N + codes[1:n])[held[1:]], minlength=N * N)


def labelled_strings(docs: DataFrame) -> DataFrame:
    """(secret, pair, n): character transitions over all documents, in strings labelled by the fixed patterns (the
    values that they match) and in all other runs of key characters (ordinary words and identifiers).

    The result has at most 2 x 68 x 68 rows, whatever the input.
    """

    def make():
        def fn(text):
            rest, size, plain = [], 0, np.zeros(N * N, np.int64)
            counts = {True: Counter(), False: Counter()}
            for t in text:
                t = t or ""
                spans = base_spans(t)
                for a, b, kind in spans:
                    value = t[a:b]
                    if kind == "assign":
                        value = ASSIGN.match(value)[2]
                    _transitions(counts[True], value)
                at = 0
                for a, b, _ in spans:
                    rest.append(t[at : max(a, at)])
                    at = max(at, b)
                rest.append(t[at:])
                size += len(t)
                if size > TEXT:
                    plain += ordinary_transitions(" ".join(rest).encode())
                    rest, size = [], 0
            plain += ordinary_transitions(" ".join(rest).encode())
            counts[False].update({int(k): int(plain[k]) for k in np.nonzero(plain)[0]})
            out = [(s, k, n) for s, c in counts.items() for k, n in c.items()]
            return [list(x) for x in zip(*out, strict=True)] if out else None

        return fn

    parts = map_columns(docs.select("text"), make, "secret boolean, pair int, n long")
    return parts.groupBy("secret", "pair").agg(F.sum("n").alias("n"))


def ratio_table(rows: list, prior: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio (secret against ordinary, natural logarithm) of each transition.

    Secrets that the patterns find may be of few kinds (hex) or absent, so the model of random strings also gets one
    count for each transition within each usual alphabet of keys: digits with lower case, with upper case, or all.
    """
    n = np.full((2, N, N), prior)
    for secret, pair, count in rows:
        n[int(secret), pair // N, pair % N] += count
    lower, upper, digits = (np.array([0, *(CODE[c] for c in ALPHABET if f(c))]) for f in (str.islower, str.isupper, str.isdigit))
    both = n[1].copy()
    shape = np.zeros((N, N))
    for own in (np.union1d(lower, digits), np.union1d(upper, digits), np.union1d(np.union1d(lower, upper), digits)):
        shape[np.ix_(own, own)] += 1.0 / len(own)
    both = both / both.sum(1, keepdims=True) + shape / np.maximum(shape.sum(1, keepdims=True), 1e-9) + 1e-4
    plain = n[0] / n[0].sum(1, keepdims=True)
    return np.log(both / both.sum(1, keepdims=True)) - np.log(plain)


def _gains(s: str, table: np.ndarray, bound: float) -> np.ndarray:
    """Log-likelihood ratio of each character of a run less ``bound``."""
    codes = np.concatenate(([0], LOOKUP[np.frombuffer(s.encode(), np.uint8)]))
    return table[codes[:-1], codes[1:]] - bound


def _one_case(s: str) -> bool:
    """No digit and letters of one case at most."""
    return not any(c.isdigit() for c in s) and (s == s.lower() or s == s.upper())


def likely_random(s: str, table: np.ndarray, bound: float = 1.0) -> bool:
    """Whether the mean log-likelihood ratio a character is over ``bound`` and the string isn't letters of one case
    alone (words of any language run together score high, too, where the corpus has few like them)."""
    return not _one_case(s) and float(_gains(s, table, bound).mean()) > 0


def random_parts(s: str, table: np.ndarray, bound: float = 1.0) -> list[tuple[int, int]]:
    """The parts of a run that the models call random: the whole run; else its stretch of at least ``LEAST`` characters
    with the greatest sum of ratios over ``bound``, up to the nearest sign that is no letter or digit on both sides, and
    the same for what is before and after."""
    if likely_random(s, table, bound):
        return [(0, len(s))]
    gains, out, todo = _gains(s, table, bound), [], [(0, len(s))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST:
            continue
        sums = np.concatenate(([0.0], np.cumsum(gains[lo:hi])))
        low = np.minimum.accumulate(sums[:-LEAST])
        j = int(np.argmax(sums[LEAST:] - low))
        if sums[j + LEAST] <= low[j]:
            continue
        a, b = lo + int(np.argmin(sums[: j + 1])), lo + j + LEAST
        one_case = _one_case(s[a:b])
        while not one_case and a > lo and s[a - 1].isalnum():
            a -= 1
        while not one_case and b < hi and s[b].isalnum():
            b += 1
        if not one_case:
            out.append((a, b))
        todo += [(lo, a), (b, hi)]
    return sorted(out)


def random_spans(text: str, base: list[tuple[int, int, str]], table: np.ndarray, bound: float = 1.0) -> list[tuple[int, int]]:
    """Spans of the random parts of the runs in ``text``, without the characters of the ``base`` spans; what is left
    beside one counts where it goes on from a hex string or is over ``bound`` itself."""
    out = []
    if not has_run(text.encode(), KEY_BYTES, LEAST):
        return out
    for m in CANDIDATE.finditer(text):
        near = [x for x in base if x[0] < m.end() and m.start() < x[1]]
        for a, b in random_parts(m[0], table, bound):
            a, b = a + m.start(), b + m.start()
            rest, at = [], a
            for x, y, _ in near:
                if y > a and x < b:
                    if x > at:
                        rest.append((at, x))
                    at = max(at, y)
            if at == a:
                out.append((a, b))
                continue
            if at < b:
                rest.append((at, b))
            for x, y in rest:
                glued = any(k == "hex" and (p == y and text[y - 1].isalnum() or q == x and text[x].isalnum()) for p, q, k in near)
                if glued or float(_gains(text[x:y], table, bound).mean()) > 0:
                    out.append((x, y))
    return out


def find_secrets(docs: DataFrame, table: np.ndarray, bound: float = 1.0) -> DataFrame:
    """Spans of every whole text: those of the patterns, and the parts of runs of key characters that the models call
    random, as far as they are outside of those. Null text: the empty one. Other columns are ignored; a row in gives a row out."""

    def digest(spans):
        return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    def one(t):
        base = base_spans(t or "")
        more = [(a, b, "random") for a, b in random_spans(t or "", base, table, bound)]
        kinds = Counter(k for _, _, k in base)
        every = sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))
        return kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(digest(base).encode()).hexdigest(), digest(every), len(more)

    def make():
        return lambda doc_id, text: [doc_id, *map(list, zip(*map(one, text), strict=True))]

    ddl = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return map_columns(docs.select("doc_id", "text"), make, ddl)


def trained_table(docs: DataFrame) -> np.ndarray:
    return ratio_table([tuple(r) for r in labelled_strings(docs).collect()])  # at most 2 x 68 x 68 rows


def redacted(docs: DataFrame, bound: float = 1.0, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns kept, each span that ``find_secrets`` finds in ``text`` replaced by ``mark`` (spans that
    touch or overlap: by one mark). A null text stays null."""
    table = trained_table(docs)

    def make():
        def fn(text):
            out = []
            for t in text:
                spans = base_spans(t or "")
                spans += [(*x, "") for x in random_spans(t or "", spans, table, bound)]
                parts, at = [], 0
                for a, b, _ in sorted(spans):
                    if a > at or not parts:
                        parts += [t[at:a], mark]
                    at = max(at, b)
                out.append("".join([*parts, t[at:]]) if parts else t)
            return out

        return fn

    from meterline.llm.common import replace_text

    return replace_text(docs, make)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with their secrets. Null and empty texts have none (the hash of the empty text); repeated rows each keep
    a row; an empty table gives no rows; other columns are left out."""
    docs = documents(spark, sf_dir)
    return find_secrets(docs, trained_table(docs))
