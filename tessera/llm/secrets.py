"""Secret scans: fixed patterns, and random strings found by their token efficiency.

A random string takes many tokens for its length under a byte-pair vocabulary, for no merge was learnt for it; words, names and
paths take few. Candidates are runs of at least ``MIN_CHARS`` characters of the base64 and URL-safe alphabets; where a whole run is
no random string, its parts of that length between ``/`` and ``=``, then between ``_``, ``-`` and ``+``, are tested on their own, so that words
in front don't dilute a key. Known digests (hexadecimal of the length of MD5, SHA-1, SHA-2), UUIDs and identifiers (words
of less than ``MIN_CHARS`` letters joined by ``_``, ``-``, ``/`` or case changes, and numbers) are excluded before the ratio of characters to
tokens is tested.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import appended, documents, kept

MAX_RATIO, MIN_CHARS = 2.2, 20
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CHARS},}}")
PARTS = [re.compile(r"[^/=]+"), re.compile(r"[^/=_+-]+")]
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}
FIELDS = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex", "n_random")] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]


def vocabulary(path: str, pattern: str):
    """The tiktoken encoding of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def known(s: str) -> bool:
    """Whether a candidate is a digest, a UUID or an identifier rather than a secret."""
    if DIGEST.match(s) and len(s) in DIGEST_LENGTHS or UUID.match(s):
        return True
    if s.isdigit() or len(set(s)) < 6:
        return True
    groups = [g for g in re.split(r"[_/=+-]+|(?<=[a-z])(?=[A-Z])", s) if g]
    words = all(g.isalpha() and (g.islower() or g.isupper() or g[0].isupper() and g[1:].islower()) and len(g) < MIN_CHARS or g.isdigit() for g in groups)
    return words and sum(map(len, groups)) >= 4 * len(groups)


def base_spans(t: str) -> list[tuple[int, int, str]]:
    out = []
    low = t.lower()
    if any(w in low for w in WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    if "AKIA" in t:
        out += [(*m.span(), "access") for m in ACCESS.finditer(t) if len(m[0]) >= 20]
    out += [(*m.span(), "hex") for m in HEX.finditer(t)]
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], ORDER[x[2]])))


def scan(t: str, tokens, max_ratio: float) -> tuple[list, list]:
    """Spans of the fixed patterns, and of random strings that touch none of them."""
    base, extra = base_spans(t), []
    starts, ends = [], []  # of the base spans' union
    for a, b, _ in sorted(base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def random(start: int, end: int) -> bool:
        i = bisect_right(ends, start)  # the first that ends behind the start
        if i < len(ends) and starts[i] < end:
            return False
        s = t[start:end]
        if known(s):
            return False
        return len(s) < max_ratio * len(tokens(s))

    def search(start: int, end: int, separators: list) -> None:
        if random(start, end):
            extra.append((start, end, "random"))
        elif separators:
            for m in separators[0].finditer(t, start, end):
                if m.end() - m.start() >= MIN_CHARS:
                    search(*m.span(), separators[1:])

    for m in CANDIDATE.finditer(t):
        search(*m.span(), PARTS)
    return base, extra


def secret_scan(docs: DataFrame, vocab: str, pattern: str, text: str = "text", *, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Every row of ``docs`` with counts by kind, all spans (code points, end exclusive) and a digest of the base spans.

    Null and empty texts have no spans. A text of any length is scanned whole, in time that grows with it. Repeated rows are scanned
    alike. Columns named as a result are replaced. An empty table gives an empty result.
    """

    def fn(col: pa.Array) -> list:
        enc = cached(vocab, pattern)
        rows = []
        for t in col.to_pylist():
            base, extra = scan(t or "", enc.encode_ordinary, max_ratio)
            kinds = [k for *_, k in base]
            rows.append((*(kinds.count(k) for k in ("assign", "access", "hex")), len(extra), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + extra)))
        return [list(c) for c in zip(*rows, strict=True)]

    return appended(docs, text, FIELDS, fn, keeps=True)


def cached(vocab: str, pattern: str):
    return kept((vocab, pattern), lambda: vocabulary(vocab, pattern))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir), *default_vocabulary()).select("doc_id", *[f.name for f in FIELDS])
