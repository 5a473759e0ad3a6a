import hashlib
import random
import re
import string

import pytest

from tessera.llm import redaction
from tessera.llm import secrets as S

pytest.importorskip("public_tokenizers")

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}


def brute(t):
    spans = [(m.start(), ORDER[k], k, m.end()) for k, p, ok in BASE for m in p.finditer(t or "") if ok(m)]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))


def cases():
    r = random.Random(2)
    parts = ["password=", "TOKEN: '", "api_key:", "Apikey = ", "ſecret=", "toKen=abcde", "password=token:abcdef", "AKIA" + "Z9" * 8, "AKIA12", "0123456789abcdef" * 2, "deadbeef", " é ", "\n", "xyz", '"', "secret"]
    out = [None, "", "é" * 50 + " password=hunter22"]
    return out + ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(400)]


def test_base_patterns(spark):
    rows = [(i, t) for i, t in enumerate(cases())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for g in S.secret_scan(df, *S.default_vocabulary()).collect():
        want = brute(rows[g.doc_id][1])
        assert g.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), rows[g.doc_id]
        have = [x for x in g.spans.split(",") if x and not x.startswith("random")]
        assert ",".join(have) == want
        assert g.n_assign == want.count("assign:") and g.n_access == want.count("access:") and g.n_hex == want.count("hex:")


def brute_random(t, tokens):
    """The method's spans by the rule in words: runs, then their parts, at least 20 long, not known, of few characters a token."""
    base = [(m.start(), m.end()) for _, p, ok in BASE for m in p.finditer(t) if ok(m)]

    def known(s):
        if len(s) in (32, 40, 56, 64, 96, 128) and (set(s) <= set("0123456789abcdef") or set(s) <= set("0123456789ABCDEF")):
            return True
        if [len(x) for x in s.split("-")] == [8, 4, 4, 4, 12] and set(s) <= set(string.hexdigits + "-"):
            return True
        if set(s) <= set(string.digits) or len(set(s)) < 6:
            return True
        words = []
        for chunk in re.findall(r"[A-Za-z0-9]+", s):
            at = 0
            for i in range(1, len(chunk)):
                if chunk[i - 1].islower() and chunk[i].isupper():
                    words.append(chunk[at:i])
                    at = i
            words.append(chunk[at:])
        plain = all(w.isdigit() or w.isalpha() and len(w) < 20 and w in (w.lower(), w.upper(), w.capitalize()) for w in words)
        return plain and sum(map(len, words)) >= 4 * len(words)

    def split(start, end, marks):
        at = start
        for i in range(start, end + 1):
            if i == end or t[i] in marks:
                if i > at:
                    yield at, i
                at = i + 1

    def look(start, end, left):
        if end - start < 20:
            return []
        s = t[start:end]
        if all(b <= start or end <= a for a, b in base) and not known(s) and len(s) < 2.2 * len(tokens(s)):
            return [(start, end)]
        return [x for part in split(start, end, left[0]) for x in look(*part, left[1:])] if left else []

    letters = set(string.ascii_letters + string.digits + "+/_=-")
    runs = split(0, len(t), {c for c in t if c not in letters})
    return [x for run in runs for x in look(*run, ["/=", "/=_+-"])]


def test_random_spans_against_brute_force(spark):
    r = random.Random(12)
    enc = S.vocabulary(*S.default_vocabulary())
    key = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    kinds = [string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters + string.digits + "+/_-", string.hexdigits, "0123456789abcdef", "01"]
    parts = ["path/to/module/", "some_name_here=", "password=", " ", "\n", "é", "AKIA", "-", "_", "/", "ordinary words of prose ", "camelCaseIdentifierOfLength", "123e4567-e89b-12d3-a456-426614174000"]
    rows = [(i, "".join(r.choice(parts) if r.random() < 0.6 else key(r.choice([8, 19, 20, 24, 32, 40, 64]), r.choice(kinds)) for _ in range(r.randint(1, 9)))) for i in range(600)]
    rows += [(1000, " ".join(key(30, kinds[2]) for _ in range(3000)))]
    got = S.secret_scan(spark.createDataFrame([*rows, rows[3]], "doc_id long, text string"), *S.default_vocabulary()).collect()
    assert len(got) == len(rows) + 1
    found = 0
    for g in got:
        want = brute_random(dict(rows)[g.doc_id], enc.encode_ordinary)
        have = [tuple(map(int, x.split(":")[1:])) for x in g.spans.split(",") if x.startswith("random")]
        assert have == want, dict(rows)[g.doc_id]
        assert g.n_random == len(want)
        found += len(want)
    assert found > 3000


@pytest.mark.parametrize(("text", "hit"), [
    ("key qX7vB2nL9kT4wZ8pR1mC6yH3 end", True),
    ("see gHp_Zk39QmXw7Lr2TbVn5YcJd8Ef ok", True),
    ("d41d8cd98f00b204e9800998ecf8427e", False),
    ("123e4567-e89b-12d3-a456-426614174000", False),
    ("someVeryLongIdentifierNameInCode", False),
    ("path/to/some/module/with_long_name", False),
    ("Donaudampfschifffahrtsgesellschaft", False),
    ("11111111111111111111111111", False),
])
def test_random_strings(text, hit):
    enc = S.vocabulary(*S.default_vocabulary())
    _, extra = S.scan(text, enc.encode_ordinary, S.MAX_RATIO)
    assert bool(extra) == hit


@pytest.mark.parametrize("letters", [string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters + string.digits])
@pytest.mark.parametrize("front", ["", "usr/local/share/service/config/module/account/", "value_of_the_session_storage_backend_handler=", "usr/local/share/" + "0f" * 16 + "/"])
def test_planted_keys(letters, front):
    """One-case keys and keys behind words; the words and a digest in front are left alone."""
    enc = S.vocabulary(*S.default_vocabulary())
    r = random.Random(4)
    hits = 0
    for _ in range(200):
        t = f"see {front}{''.join(r.choice(letters) for _ in range(28))} end"
        hits += any(a <= 4 + len(front) and b == len(t) - 4 for a, b, _ in S.scan(t, enc.encode_ordinary, S.MAX_RATIO)[1])
    assert hits >= 190
    assert not S.scan(f"see {front} end", enc.encode_ordinary, S.MAX_RATIO)[1]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a password=hunter22 b", "k"), (2, None, "k"), (3, "", "k")], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.text, r.spans) for r in redaction.redact(df, *S.default_vocabulary()).collect()}
    assert got == {1: ("a [ASSIGN] b", "k"), 2: (None, "k"), 3: ("", "k")}
    twice = redaction.redact(df.union(df), *S.default_vocabulary())
    assert twice.count() == 6 and twice.distinct().count() == 3
    assert redaction.redact(df.limit(0), *S.default_vocabulary()).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "password=hunter22", "mine", 7)], "doc_id long, text string, spans string, other int")
    r = S.secret_scan(df, *S.default_vocabulary()).first()
    assert (r.spans, r.other) == ("assign:0:17", 7)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.secret_scan(df, *S.default_vocabulary()).count() == 0
