"""Quality rules: word statistics and repetition limits from a suffix array over each document's words.

Words are maximal runs of bytes other than space and U+0009..U+000D. A document's words are numbered, a suffix array over
the numbers is built by prefix doubling, and longest-common-prefix (LCP) values between neighbours are read off the stored
doubling ranks. Neighbours with an LCP of at least ``min_repeat`` words delimit LCP intervals; the interval of greatest depth
around a suffix is the longest repeated substring that starts there. Spans of substrings that aren't left-maximal lie inside
spans of those that are, so the union over suffixes is the union over maximal repeated substrings. A document is rejected if
that union covers more than ``max_covered`` of its words or the longest repeat has more than ``max_longest`` words.

Only suffixes whose first three words occur twice in their document are sorted further, so the cost of ordinary prose is one
pass over its three-word windows. All documents of a slice share one array: numbers are distinct between documents, so no
match crosses a boundary.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import appended, blobs, documents

MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.3, 50
PART = 1 << 20
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("covered_words", T.LongType()),
    T.StructField("longest_repeat", T.LongType()),
]
_CONT, _SPACE, _SYMBOL = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[0x80:0xC0] = _CONT
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[ord(c) for c in "#*$%&|<>"]] = _SYMBOL


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each key's group in sorted order (its first index), and the size of the group."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
    size = np.diff(np.r_[first, len(s)])
    start, count = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
    start[order], count[order] = np.repeat(first, size), np.repeat(size, size)
    return start, count


def suffix_repeats(g: np.ndarray, rank: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of suffixes with a repeated three-symbol prefix, and the longest match of each with another suffix.

    ``g``: symbols; ``rank``, ``count``: of the windows of three symbols (see ``_ranks``), padded to the length of ``g``.
    """
    n = len(g)
    active = np.flatnonzero(count > 1)
    if not len(active):
        return active, active
    cand, levels, h = active, [(3, rank)], 3
    while len(active):
        at = active + h
        nxt = np.where(at < n, rank[np.minimum(at, n - 1)], -1)
        order = np.lexsort((nxt, rank[active]))
        a, r, x = active[order], rank[active][order], nxt[order]
        group = np.r_[True, r[1:] != r[:-1]]
        fresh = group | np.r_[True, x[1:] != x[:-1]]
        i = np.arange(len(a))
        new = r + np.maximum.accumulate(np.where(fresh, i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
        rank = rank.copy()
        rank[a] = new
        h *= 2
        levels.append((h, rank))
        same = np.zeros(len(a), bool)
        same[1:] = ~fresh[1:]
        same[:-1] |= ~fresh[1:]
        active = a[same]
    sa = cand[np.argsort(rank[cand], kind="stable")]
    i, j, lcp = sa[:-1], sa[1:], np.zeros(max(len(sa) - 1, 0), np.int64)
    for step, r in reversed(levels):
        x, y = i + lcp, j + lcp
        ok = (x < n) & (y < n)
        ok[ok] = r[x[ok]] == r[y[ok]]
        lcp[ok] += step
    for _ in range(2):
        x, y = i + lcp, j + lcp
        ok = (x < n) & (y < n)
        ok[ok] = g[x[ok]] == g[y[ok]]
        lcp[ok] += 1
    return sa, np.maximum(np.r_[0, lcp], np.r_[lcp, 0])


def measure(texts: list[bytes], min_repeat: int) -> dict[str, np.ndarray]:
    """The statistics of each text, by name."""
    import pandas as pd

    n = len(texts)
    words = [t.split() for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, n)
    total = int(n_words.sum())
    flat = np.empty(total, object)
    flat[:] = list(chain.from_iterable(words))
    doc = np.repeat(np.arange(n), n_words)
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, n))]
    kind = _KIND[data]

    def of(mask: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(mask, dtype=np.int64)]
        return c[at[1:]] - c[at[:-1]]

    out = {"n_words": n_words, "word_chars": np.diff(at) - of((kind == _CONT) | (kind == _SPACE)), "n_symbols": of(kind == _SYMBOL)}
    dup = np.zeros(n, np.int64)
    for k, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup[k] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    covered, longest, repeat = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if total >= 3:
        codes = pd.factorize(flat)[0].astype(np.int64)
        g = pd.factorize(doc * np.int64(total + 1) + codes)[0].astype(np.int64)
        # windows across a boundary occur once, for symbols differ between documents
        pair, _ = _ranks(g[:-1] * np.int64(total + 1) + g[1:])
        rank, count = _ranks(pair[:-1] * np.int64(total + 1) + g[2:])
        again = np.r_[count > 1, False, False]
        in_window = again.copy()
        in_window[1:] |= again[:-1]
        in_window[2:] |= again[:-2]
        repeat = np.bincount(doc[in_window], minlength=n)
        at_pos, length = suffix_repeats(g, np.r_[rank, total, total + 1], np.r_[count, 1, 1])
        big = length >= min_repeat
        at_pos, length = at_pos[big], length[big]
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, at_pos, 1)
        np.add.at(edge, at_pos + length, -1)
        covered = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)
        np.maximum.at(longest, doc[at_pos], length)
    return out | {"n_repeat_words": repeat, "covered_words": covered, "longest_repeat": longest}


def quality_rules(docs: DataFrame, text: str = "text", *, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Every row of ``docs`` with the statistics and the verdict ``kept``.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged alike. Columns of ``docs`` with the name
    of a result are replaced. An empty table gives an empty result. One text of any length is handled whole.
    """

    def fn(col: pa.Array) -> list:
        m = measure(blobs(col), min_repeat)
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        kept = ~failed & (m["covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)
        m |= {"base_failed": failed, "kept": kept}
        return [m[f.name] for f in FIELDS]

    return appended(docs, text, FIELDS, fn, PART)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", *[f.name for f in FIELDS])


#: The statistics of the base rule; the suffix-array columns have no SQL form, so the oracle covers a query without them.
ORACLE_BASE = r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
n AS (SELECT *, len(ws) AS n_words FROM w),
win AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] AS k FROM n, LATERAL (SELECT unnest(range(1, n_words - 1)) AS i) WHERE n_words >= 3),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS m FROM win),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM c WHERE m >= 2) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT n.doc_id, n_words::BIGINT AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
  length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AS base_failed
FROM n LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
"""


def quality_base(spark, sf_dir: str) -> DataFrame:
    """The base columns alone, which SQL can check."""
    return quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


