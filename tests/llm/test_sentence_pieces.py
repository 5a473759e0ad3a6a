import hashlib
import struct

import pytest

from tessera.llm import sentence_pieces as Q

pytest.importorskip("public_tokenizers")
TEXTS = ["", "a  b", "▁x y", " lead", "日本 語", "\U0001F600 hi", "tab\tnew\nline", "é é ﬁ", "trailing  ", "<s> </s> <unk>", "x" * 3000]


@pytest.fixture(scope="module")
def pieces():
    return Q.Pieces(Q.default_model())


@pytest.mark.parametrize("text", TEXTS)
def test_spans_agree_with_the_library(pieces, text):
    raw = text.encode()
    ids = pieces.sp.encode(text)
    lo, hi = pieces.spans(raw, ids)
    want = [(p.begin, p.end) for p in pieces.sp.encode(text, return_type="proto").pieces]
    byte = [i for i, x in enumerate(ids) if pieces.sp.is_byte(x)]
    for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        if i not in byte:
            assert (a, b) == want[i]
    assert b"".join(raw[a:b] for a, b in zip(lo, hi, strict=True)) == raw


def test_digests(spark, pieces):
    rows = [(i, t) for i, t in enumerate([None, *TEXTS])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for r in Q.encode_digests(df, Q.default_model()).collect():
        t = rows[r.doc_id][1] or ""
        ids = pieces.sp.encode(t)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(pieces.sp.decode(ids).encode()).hexdigest()
    full = {r.doc_id: r for r in Q.encode(df, Q.default_model()).collect()}
    assert full[0].ids == [] and full[2].decoded == "a  b"
    assert Q.encode_digests(df.limit(0), Q.default_model()).count() == 0


def charmap(entries):
    """A compiled character map from {key: replacement}: a double-array trie laid out by brute force."""
    pool, where = b"", {}
    for k, v in entries.items():
        where[k] = len(pool)
        pool += v + b"\0"
    units, labels = {0: 0}, {}
    taken = {0}

    def place(node, prefix):
        kids = sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in where
        need = kids + ([0] if leaf else [])
        base = next(b for b in range(1, 1 << 16) if all((b ^ c) not in taken and (b ^ c) > 0 for c in need))
        off = base ^ node
        units[node] = units.get(node, 0) & 0x800000FF | labels.get(node, 0) | off << 10 | (0x100 if leaf else 0)
        for c in need:
            taken.add(base ^ c)
        if leaf:
            units[base] = where[prefix] | 0x80000000
        for c in kids:
            labels[base ^ c] = c
            units[base ^ c] = c
        for c in kids:
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    n = -(-(max(units) + 1) // 256) * 256  # the library wants whole KB
    flat = [units.get(i, 0) for i in range(n)]
    return struct.pack("<I", 4 * n) + struct.pack(f"<{n}I", *flat) + pool


def test_longest_prefix_map():
    entries = {b"A": b"a", b"AB": b"xyz", "é".encode(): b"e", b"Q": b""}
    m = Q.CharMap(charmap(entries))
    assert m.longest(b"ABC", 0) == (2, b"xyz")
    assert m.longest(b"AC", 0) == (1, b"a")
    assert m.longest("é".encode(), 0) == (2, b"e")
    assert m.longest(b"zA", 0) is None and m.longest(b"zA", 1) == (1, b"a")
    p = Q.Pieces(Q.default_model())
    p.map = m
    text = "AB éQ z".encode()
    out, own = p.normalise(text)
    assert p.align(text)[0] == out
    assert out.decode() == "▁xyz▁e▁z"
    # the mark put before everything, then the bytes of AB, the space, é, the space and z
    assert own == [-1] * 3 + [0] * 3 + [2] * 3 + [3] + [6] * 3 + [7, 8]
    assert own[-1] == len(text)


def test_model_with_a_map(spark, tmp_path):
    """End to end with a model whose compiled map isn't empty: ids and spans are the library's, extra spaces removed or kept."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    for extra in (False, True):
        proto = pb.ModelProto()
        with open(Q.default_model(), "rb") as f:
            proto.ParseFromString(f.read())
        proto.normalizer_spec.precompiled_charsmap = charmap({b"A": b"a", b"AB": b"xyz", "é".encode(): b"e", "ﬁ".encode(): b"fi", b"\t": b" "})
        proto.normalizer_spec.remove_extra_whitespaces = extra
        model = str(tmp_path / f"{extra}.model")
        with open(model, "wb") as f:
            f.write(proto.SerializeToString())
        own = Q.Pieces(model)
        texts = ["AB é ﬁne", "CABLE\tBAR  été", "plain words", "", None, "日本 ABBA"]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = Q.encode(df, model).collect()
        for r in rows:
            t = texts[r.doc_id] or ""
            want = own.sp.encode(t, return_type="proto").pieces
            assert r.ids == [p.id for p in want] and r.decoded == own.sp.decode(r.ids)
            byte = [own.sp.is_byte(i) for i in r.ids]
            for i, p in enumerate(want):
                inside = i + 1 < len(want) and want[i + 1].begin == p.end  # a piece that ends inside a replacement covers its source too
                assert byte[i] or r.starts[i] == p.begin and (r.ends[i] == p.end or inside and r.ends[i] > p.end)
        digests = {r.doc_id: r.spans_sha256 for r in Q.encode_digests(df, model).collect()}
        assert digests == {r.doc_id: hashlib.sha256(struct.pack(f"<{2 * len(r.ids)}q", *r.starts, *r.ends)).hexdigest() for r in rows}


def test_clashing_names_and_long_text(spark):
    from tessera.llm.columns import SLICE_BYTES

    long = "word " * (SLICE_BYTES // 5 + 1000)
    df = spark.createDataFrame([(1, "a b", "x", [7]), (2, long, "y", None), (None, "a b", None, [])], "doc_id long, text string, n_tokens string, ids array<int>")
    got = {r.doc_id: r for r in Q.encode_digests(df, Q.default_model()).collect()}
    assert got[1].n_tokens == got[None].n_tokens == 2 and got[1].ids == [7] and got[1].ids_sha256 == got[None].ids_sha256
    assert got[2].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
    full = {r.doc_id: r for r in Q.encode(df, Q.default_model()).collect()}
    assert full[1].n_tokens == "x" and len(full[1].ids) == 2 and full[2].ends[-1] == len(long)
