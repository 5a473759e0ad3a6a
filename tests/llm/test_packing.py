import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import packing as P
from tessera.llm.columns import utf8

TOK = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def naive(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= n]
        i = min(fit, key=lambda j: bins[j]) if fit else len(bins)
        if i == len(bins):
            bins.append(size)
        bins[i] -= n
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    r = random.Random(0)
    for _ in range(200):
        size = r.choice([10, 16, 33, 64])
        lengths = [r.randint(1, size) for _ in range(r.randint(0, 150))]
        counts = {x: lengths.count(x) for x in set(lengths)}
        runs, room = P.plan_runs(counts, size), {}
        for n, m in counts.items():
            own = sorted(x for x in runs if x[0] == n)
            for i in range(m):
                _, first, per, seq, off = [x for x in own if x[1] <= i][-1]
                room.setdefault(seq + (i - first) // per, []).append((off + (i - first) % per * n, n))
        left = []
        for spans in room.values():
            at = 0
            for off, n in sorted(spans):
                assert off == at
                at += n
            left.append(size - at)
        assert sorted(left) == naive(lengths, size)


def test_segment_tree():
    r, t, held = random.Random(1), P.SegmentTree(50), {}
    for _ in range(2000):
        c = r.randint(0, 50)
        d = r.choice([1, 2, -held.get(c, 0)])
        held[c] = held.get(c, 0) + d
        t.add(c, d)
        need = r.randint(0, 50)
        assert t.tightest(need) == min((x for x, n in held.items() if n and x >= need), default=None)


def test_word_encoder_is_the_tokenizer():
    enc = P.WordEncoder(TOK)
    r = random.Random(3)
    letters = list("aB é.,;:!?'\n -_)»́Σ1½ßİ日<|ʰ\x0b\x1c\x85　")
    texts = ["<|ENDOFTEXT|> <|endoftext|>x", "Σας ΟΔΟΣ. é. İ. x", "a). b», c. d.. \ne!? \n.", "", "don't. I'LL, 12.5, x"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for t, got in zip(texts, enc(*utf8(pa.array(texts))), strict=True):
        assert got == np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_pack(spark):
    r = random.Random(5)
    rows = [(1, None), (2, ""), (None, "alpha"), (3, "beta " * 90)] + [(i, " ".join(r.choice(["red", "green", "blue"]) for _ in range(r.randint(0, 40)))) for i in range(4, 60)]
    rows += rows[-3:]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = P.pack(df, TOK, seq_len=32).collect()
    enc = P.WordEncoder(TOK)
    want = []
    for k, t in rows:
        ids = enc.tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(k, p, 32 * p, len(ids[32 * p : 32 * p + 32]), zlib.crc32(np.array(ids[32 * p : 32 * p + 32], "<u4").tobytes())) for p in range(-(-len(ids) // 32))]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got), key=key) == sorted(want, key=key)
    seqs = {}
    for g in got:
        seqs.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for spans in seqs.values():
        at = 0
        for off, n in sorted(spans):
            assert off == at
            at += n
        assert at <= 32
    assert sorted(32 - sum(n for _, n in s) for s in seqs.values()) == naive([w[3] for w in want], 32)
    assert P.pack(df.limit(0), TOK).count() == 0


def test_other_tokenizers_are_taken_as_they_are(spark, tmp_path):
    """A cased vocabulary that keeps white space, as no word cache may: ids are the tokenizer's own."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = {c: i + 2 for i, c in enumerate("abHIhi ")}
    tok = Tokenizer(models.BPE(vocab={**letters, "hi": 9, "Hi": 10, "i ": 11}, merges=[("h", "i"), ("H", "i"), ("i", " ")]))
    tok.pre_tokenizer = pre_tokenizers.Sequence([])
    path = str(tmp_path / "cased.json")
    tok.save(path)
    texts = ["Hi hi", "hi  Hi ", "", "ab Hi i i"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in P.pack(df, path).collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids + [P.END_ID]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert not P.WordEncoder(path).apart and P.WordEncoder(TOK).apart


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x", 3), (2, None, 8, "y", 4)], "doc_id long, text string, piece int, length string, part int")
    got = {r.doc_id: r for r in P.pack(df, TOK).collect()}
    assert (got[1].piece, got[1].length, got[2].length) == (0, 3, 1)
    assert P.pack(df, TOK).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
