"""Learning abbreviations, legal forms and their families from sure pairs, without labels."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import written
from .components import components

# Thresholds of the lexicon.
MIN_N, MIN_CONF, MIN_RATE, LEGAL_SHARE, LEGAL_DROP, FAMILY_SHARE = 30, 0.8, 0.2, 0.005, 0.1, 0.6
# End of fixed values.


def drop_counters(p: DataFrame, a: str, b: str, group: str = "country") -> DataFrame:
    """(country, w, has, dropped, has_b, added): pairs whose first side has a word and those where the second lacks it, and
    the reverse."""
    # sets are met by hashing, for long names have thousands of words

    def found(words, x: bool, y: bool):
        return F.transform(words, lambda t: F.struct(t.alias("w"), F.lit(x).alias("x"), F.lit(y).alias("y")))

    sides = found(F.array_intersect(a, b), True, True), found(F.array_except(a, b), True, False), found(F.array_except(b, a), False, True)
    rows = F.explode(F.concat(*sides)).alias("r")
    x, y = F.col("r.x"), F.col("r.y")
    return p.select(group, rows).groupBy(group, F.col("r.w").alias("w")).agg(F.count_if(x).alias("has"), F.count_if(x & ~y).alias("dropped"), F.count_if(y).alias("has_b"), F.count_if(y & ~x).alias("added"))


def abbreviations(p: DataFrame, a: str, b: str, group: str = "country", least: int = MIN_N) -> DataFrame:
    """(country, token, expansion): short words whose counterpart on the other side is a longer word with the same letters in
    order, or a run of words they are the initials of; only the dominant, well-attested expansion of each."""
    kind = p.schema[group].dataType.simpleString()

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for g, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x is not None and y is not None:
                    for k in (*expansions(x, y), *expansions(y, x)):
                        n[g, *k] += 1
            g, t, e, m = zip(*((*k, v) for k, v in n.items()), strict=True) if n else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(g, batch.schema.field(0).type), pa.array(t, pa.string()), pa.array(e, pa.string()), pa.array(m, pa.int64())], [group, "t", "e", "n"])

    both = p.select(group, F.col(a), F.col(b)).mapInArrow(count, f"{group} {kind}, t string, e string, n long").groupBy(group, "t", "e").agg(F.sum("n").alias("n"))
    unmatched = both.filter("e IS NULL").select(group, "t", F.col("n").alias("unm"))
    c = both.filter("e IS NOT NULL")
    best = Window.partitionBy(group, "t").orderBy(F.desc("n"), "e")
    c = c.withColumns({"rn": F.row_number().over(best), "total": F.sum("n").over(Window.partitionBy(group, "t"))}).filter("rn = 1").join(unmatched, [group, "t"])
    shorter = (F.length("t") <= 2) | (F.length(F.replace("e", F.lit(" "), F.lit(""))) - F.length("t") >= 2)
    rate = F.when(F.length("t") > 1, MIN_RATE).otherwise(0.5)
    ok = shorter & (F.col("n") >= least) & (F.col("n") / F.col("total") >= MIN_CONF) & (F.col("n") / F.col("unm") >= rate)
    return c.filter(ok).select(group, F.col("t").alias("token"), F.col("e").alias("expansion"))


def expansions(x: list[str], y: list[str]) -> Iterator[tuple[str, str | None]]:
    """(t, None) for each short word of ``x`` that ``y`` lacks, and (t, e) for each expansion that ``y`` has for it, each once."""
    own, other = set(x), set(y)
    short = [t for t in own - other if t is not None and len(t) <= 4 and re.fullmatch("[a-z]+", t)]
    if not short:
        return
    free, by_letter = other - own - {None}, defaultdict(list)
    for w in free:
        by_letter[w[:1]].append(w)
    words = [w for w in y if w is not None]
    first = "".join(w[:1] or "\0" for w in words)
    for t in short:
        yield t, None
        found = {w for w in by_letter[t[0]] if len(w) > len(t) and is_subsequence(t, w)}
        if 2 <= len(t) <= 3:
            at = first.find(t)
            while at >= 0:
                run = words[at : at + len(t)]
                if free.issuperset(run):
                    found.add(" ".join(run))
                at = first.find(t, at + 1)
        for e in found:
            yield t, e


@lru_cache(1 << 16)
def is_subsequence(short: str, long: str) -> bool:
    at = 0
    for c in short:
        at = long.find(c, at) + 1
        if not at:
            return False
    return True


def legal_words(counters: DataFrame, s1: DataFrame, words: str, group: str = "country", least: int = MIN_N) -> DataFrame:
    """(country, w): words at the end of names that pairs drop more often than the median such word, words always followed by
    one, and the records' spellings of these."""
    n = s1.groupBy(group).agg(F.count("*").alias("n1"))
    last = s1.select(group, F.explode(F.array_distinct(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2))).alias("w")).groupBy(group, "w").agg(F.count("*").alias("ends"))
    x = last.join(n, group).join(counters, [group, "w"])
    cand = x.filter((F.col("ends") / F.col("n1") >= LEGAL_SHARE) & F.col("w").rlike("^[a-z]+$") & (F.col("has") >= least)).withColumn("rate", F.col("dropped") / F.col("has"))
    cut = cand.groupBy(group).agg((F.median("rate") + LEGAL_DROP).alias("cut"))
    legal = cand.join(cut, group).filter("rate >= cut").select(group, "w")
    two = s1.filter(F.size(words) > 1).select(group, F.element_at(words, -2).alias("first"), F.element_at(words, -1).alias("w")).groupBy(group, "first", "w").agg(F.count("*").alias("v"))
    whole = s1.select(group, F.explode(F.array_distinct(words)).alias("first")).groupBy(group, "first").agg(F.count("*").alias("m"))
    lead = two.join(legal, [group, "w"]).join(whole, [group, "first"]).join(n, group)
    lead = lead.filter(F.col("first").rlike("^[a-z]+$") & (F.col("v") / F.col("n1") >= LEGAL_SHARE) & (F.col("v") / F.col("m") >= 0.8))
    legal = legal.union(lead.select(group, F.col("first").alias("w"))).distinct()
    extra = counters.filter((F.col("has_b") >= least) & F.col("w").rlike("^[a-z]+$") & (F.col("added") / F.col("has_b") >= 0.5)).select(group, F.col("w").alias("u"))
    legal = written(legal, "legal")
    # as ``text.related``, with what belongs to one word found before words meet; related words begin alike
    marks = lambda c, n: {"l": F.substring(c, 1, 1), f"skel_{n}": X.skeleton_word(F.col(c)), f"len_{n}": F.length(c), f"like_{n}": F.array_join(F.filter(F.split(c, ""), lambda x: x != ""), ".*")}
    extra = extra.join(legal.withColumnRenamed("w", "u"), [group, "u"], "left_anti").withColumns(marks("u", 1))
    same = (F.col("skel_1") == F.col("skel_2")) & (F.length("skel_1") >= 2)
    short = (F.col("len_2") - F.col("len_1") >= 2) & F.rlike(F.col("w"), F.col("like_1")) | (F.col("len_1") - F.col("len_2") >= 2) & F.rlike(F.col("u"), F.col("like_2"))
    near = extra.join(legal.withColumns(marks("w", 2)), [group, "l"]).filter(same | short).select(group, F.col("u").alias("w"))
    return legal.union(near).distinct()


def swaps(p: DataFrame, legal: DataFrame, a: str, b: str, group: str = "country") -> DataFrame:
    """(country, u, t, v): how often legal words replace one another, of related words; with no ``t``, how often ``u`` replaces any or is replaced.

    A word that one side has alone replaces the related ones that the other has alone, or each of these if none is. Unrelated replacements
    are only counted, for a pair of long names has as many as the product of its words.
    """
    kind = p.schema[group].dataType.simpleString()

    def alone(x: str, y: str, added: bool):
        return F.transform(F.array_except(x, y), lambda t: F.struct(t.alias("w"), F.lit(added).alias("added")))

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for g, gone, added in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for u, t, v in replacements(gone, added):
                    n[g, u, t] += v
            g, u, t, v = zip(*((*k, v) for k, v in n.items()), strict=True) if n else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(g, batch.schema.field(0).type), pa.array(u, pa.string()), pa.array(t, pa.string()), pa.array(v, pa.int64())], [group, "u", "t", "v"])

    x = p.select(F.monotonically_increasing_id().alias("i"), group, F.concat(alone(a, b, False), alone(b, a, True)).alias("rs"))
    x = x.select("i", group, F.explode("rs").alias("r")).select("i", group, F.col("r.w").alias("w"), F.col("r.added").alias("added")).join(legal, [group, "w"], "left_semi")
    side = {k: F.collect_list(F.when(F.col("added") == v, F.col("w"))).alias(k) for k, v in (("gone", False), ("new", True))}
    x = x.groupBy("i", group).agg(*side.values()).filter((F.size("gone") > 0) & (F.size("new") > 0)).select(group, "gone", "new")
    return x.mapInArrow(count, f"{group} {kind}, u string, t string, v long").groupBy(group, "u", "t").agg(F.sum("v").alias("v"))


def replacements(gone: list[str], added: list[str]) -> Iterator[tuple[str, str | None, int]]:
    """(u, t, 1) and (t, u, 1) for each added word and the gone ones related to it, and (w, None, n) for each word's number of replacements."""
    by_letter, to_any, total = defaultdict(list), 0, Counter()
    for t in gone:
        by_letter[t[:1]].append(t)
    for u in added:
        near = [t for t in by_letter.get(u[:1], ()) if related(u, t)]
        for t in near:
            yield u, t, 1
            yield t, u, 1
            total[t] += 1
        to_any += not near
        total[u] += len(near) or len(gone)
    for t in gone:
        total[t] += to_any
    for w, n in total.items():
        if n:
            yield w, None, n


@lru_cache(1 << 18)
def related(u: str, t: str) -> bool:
    """As ``text.related``, of words that begin alike."""
    if len(u) > len(t):
        u, t = t, u
    return len(t) - len(u) >= 2 and is_subsequence(u, t) or len(skeleton(u)) >= 2 and skeleton(u) == skeleton(t)


@lru_cache(1 << 16)
def skeleton(w: str) -> str:
    return w[:1] + re.sub("[aeiouhy]", "", w[1:])


def families(p: DataFrame, legal: DataFrame, counts: DataFrame, a: str, b: str, group: str = "country", least: int = MIN_N) -> DataFrame:
    """(country, token, canonical): legal words that replace one another, with the most frequent of each family."""
    both = swaps(p, legal, a, b, group)
    tot = both.filter("t IS NULL").select(group, "u", F.col("v").alias("tot"))
    both = both.filter(F.col("t").isNotNull() & (F.col("v") >= least)).join(tot, [group, "u"])
    n = counts.select(group, "w", "n")
    e = both.join(n.withColumnsRenamed({"w": "u", "n": "nu"}), [group, "u"], "left").join(n.withColumnsRenamed({"w": "t", "n": "nt"}), [group, "t"], "left").na.fill(0, ["nu", "nt"])
    e = e.filter((F.col("v") >= least) & (F.col("v") / F.col("tot") >= FAMILY_SHARE) & (F.col("nu") <= F.col("nt")))
    where = F.hex(F.encode(group, "UTF-8"))  # holds no mark that could part it wrongly
    name = F.concat_ws("|", where, "u"), F.concat_ws("|", where, "t")
    found = components(e.select(name[0].alias("a"), name[1].alias("b")))
    member = found.union(found.select(F.col("component").alias("node"), "component")).distinct()
    m = member.select(F.decode(F.unhex(F.substring_index("node", "|", 1)), "UTF-8").alias(group), F.substring_index("node", "|", -1).alias("w"), "component").join(n, [group, "w"], "left").na.fill(0, ["n"])
    top = m.groupBy(group, "component").agg(F.max(F.struct("n", "w")).alias("top"))
    return m.join(top, [group, "component"]).select(group, F.col("w").alias("token"), F.col("top.w").alias("canonical"))


def learn(p: DataFrame, s1: DataFrame, a: str, b: str, words: str, group: str = "country", least: int = MIN_N) -> DataFrame:
    """(country, kind, token, value): the lexicon as one flat table."""
    counters = drop_counters(p, a, b, group)
    counts = s1.select(group, F.explode(F.array_distinct(words)).alias("w")).groupBy(group, "w").agg(F.count("*").alias("n"))
    abbr = abbreviations(p, a, b, group, least).select(group, F.lit("abbreviation").alias("kind"), "token", F.col("expansion").alias("value"))
    legal = written(legal_words(counters, s1, words, group, least), "legal")
    fam = families(p, legal, counts, a, b, group, least).select(group, F.lit("family").alias("kind"), "token", F.col("canonical").alias("value"))
    return abbr.union(legal.select(group, F.lit("legal").alias("kind"), F.col("w").alias("token"), F.lit("").alias("value"))).union(fam)
