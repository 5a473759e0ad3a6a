import itertools
import random
import struct
import zlib

import pytest

from tessera.llm import packing, quality_rules, secrets

from . import test_packing, test_secrets, test_shingle_join

pipe = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    words = [f"word{i}" for i in range(3000)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, near = prose(70), prose(120).split()
    rows = [(i, prose(90)) for i in range(10, 30)]
    rows += [(1, " ".join(near)), (2, " ".join(near[:60] + ["changed"] + near[61:])), (3, prose(60) + " " + passage), (4, passage + " " + prose(60)), (5, prose(60) + " password=hunter2222"), (6, "too short"), (7, "spam spam " * 60), (8, None)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


def test_stages(spark, folder):
    docs = first = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in pipe.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == first.columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
    every = {r.doc_id for r in first.collect()}
    assert every - set(seen["quality_rules"]) == {6, 7, 8}
    assert set(seen["quality_rules"]) - set(seen["shingle_join"]) == {2}
    before, after = seen["shingle_join"], seen["suffix_dedup"]
    assert {k for k in after if after[k].text != before[k].text} == {4}
    assert after[4].n_chars == len(after[4].text) < 700
    assert "hunter" not in seen["secret_scan"][5].text
    packed = pipe.STAGES[4][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(seen["secret_scan"])


def test_run(spark, folder):
    out = pipe.run(spark, folder)
    assert {r.doc_id for r in out.collect()} >= {1, 3, 4, 5}
    assert pipe.ORACLE_SQL is None


def test_near_copies_of_null_id(spark):
    r = random.Random(2)
    text = " ".join(f"word{r.randrange(3000)}" for _ in range(120))
    rows = [(k, text) for k in (None, None, 1, 2, 3)] + [(4, " ".join(f"other{r.randrange(3000)}" for _ in range(120)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pipe.keep_one_of_near(spark, docs, "").collect()
    assert sorted((x.doc_id for x in got), key=str) == [4, None, None]


def brute_quality(t):
    """Kept: 50 words, few of them in repeated windows of three, few in repeats of ten or more, no repeat of over a hundred."""
    w = (t or "").split()
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    if len(w) < 50 or 100 * len(again) > 50 * len(w):
        return False
    covered, longest = set(), 0
    for i in range(len(w)):
        for j in range(i):
            n = 0
            while i + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            if n >= quality_rules.MIN_REPEAT:
                longest = max(longest, n)
                covered |= {*range(i, i + n), *range(j, j + n)}
    return len(covered) <= quality_rules.MAX_COVERED * len(w) and longest <= quality_rules.MAX_LONGEST


def test_against_brute_force(spark, tmp_path):
    """``run`` against the five stages in plain Python, over texts with copies, near copies, shared passages, secrets and repeats."""
    r = random.Random(21)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, texts = prose(40), []
    for i in range(60):
        t = prose(r.randint(30, 160)) if i % 4 or not texts else r.choice(texts)
        w = t.split()
        for _ in range(r.choice([0, 0, 1, 3])):
            w[r.randrange(len(w))] = r.choice(words)
        t = " ".join(w)
        t = t + " " + passage if r.random() < 0.3 else t
        t = t + " token: 'Zk39QmXw7Lr2' " if r.random() < 0.2 else t
        t = t + " qX7vB2nL9kT4wZ8pR1mC6yH3" if r.random() < 0.2 else t
        texts.append(" ".join([t] * 3) if i % 13 == 5 else t)
    texts += [None, "", prose(7000)]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    out = pipe.run(spark, d).collect()

    docs = {k: t for k, t in rows if brute_quality(t)}
    assert 0 < len(docs) < len(rows)
    classes = test_shingle_join.brute(list(docs.items()))
    kept = {k: t for k, t in docs.items() if classes[k][1] == k}
    assert len(kept) < len(docs)
    seen, cut = set(), {}
    for k, t in sorted(kept.items()):
        gone = set()
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                gone |= {*range(i, i + 100)}
            seen.add(t[i : i + 100])
        cut[k] = "".join(c for i, c in enumerate(t) if i not in gone)
    assert cut != kept
    enc = secrets.vocabulary(*secrets.default_vocabulary())
    clean = {}
    for k, t in cut.items():
        spans = [(m.start(), m.end(), n) for n, p, ok in test_secrets.BASE for m in p.finditer(t) if ok(m)]
        spans += [(a, b, "random") for a, b in test_secrets.brute_random(t, enc.encode_ordinary)]
        for a, b, n in sorted(spans, reverse=True):  # here no two overlap
            t = f"{t[:a]}[{n.upper()}]{t[b:]}"
        clean[k] = t
    assert any("[ASSIGN]" in t for t in clean.values()) and any("[RANDOM]" in t for t in clean.values())
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(packing.default_tokenizer()), {}
    for k, t in clean.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, packing.END_ID]
        for p, lo in enumerate(range(0, len(ids), packing.SEQ_LEN)):
            part = ids[lo : lo + packing.SEQ_LEN]
            want[k, p] = (lo, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    assert {(x.doc_id, x.piece): (x.start, x.length, x.ids_crc32) for x in out} == want and len(out) == len(want)
    at = {}
    for x in out:
        at.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for spans in at.values():
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(spans)))
        assert min(spans)[0] == 0 and sum(n for _, n in spans) <= packing.SEQ_LEN
    assert len(at) == len(test_packing.naive([n for _, n, _ in want.values()], packing.SEQ_LEN))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, gone string, kept string, c0 string, k long"


@pytest.mark.parametrize("stage", [s for s, _ in pipe.STAGES[:4]])
def test_stage_on_odd_rows(spark, stage):
    """Null ids and texts, rows given twice, other columns with the names that stages use, an empty table."""
    fn = dict(pipe.STAGES)[stage]
    r = random.Random(3)
    good = " ".join(f"word{r.randrange(5000)}" for _ in range(80))
    other = ["en", None, 3, "mine", "g", "no", "c", 9]
    rows = [(1, good, *other), (1, good, *other), (None, None, *other), (None, "", *other), (2, None, *other), (7, "short text", *other)]
    docs = spark.createDataFrame(rows, COLUMNS)
    got = fn(spark, docs, "odd")
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    found = got.collect()
    assert all((x.n_words, x.gone, x.kept, x.c0, x.k) == ("mine", "g", "no", "c", 9) for x in found)
    assert sum(x.doc_id == 1 and x.text == good for x in found) == 2
    assert len(found) == (2 if stage == "quality_rules" else 6)
    assert fn(spark, docs.limit(0), "odd").count() == 0


def test_stages_leave_other_results_alone(spark, folder):
    """A result that still reads its scratch tables outlives the stages of another folder."""
    from tessera.llm import shingle_join

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = shingle_join.shingle_components(docs)
    for _, stage in pipe.STAGES:
        stage(spark, docs, "another")
    assert held.count() == docs.count()
