"""Making pairs: folds, truth, pseudo-labels and negative samples."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import AT_ONCE, Endings
from .scan import scan
from .windows import best_first


def fold(entity_id: Column, n: int = 10) -> Column:
    """The fold of an id: CRC-32 of its UTF-8 bytes modulo ``n``; the same everywhere and for ever."""
    return (F.crc32(F.encode(entity_id, "UTF-8")) % n).cast("int")


def record_folds(records: DataFrame, owners: DataFrame, top: DataFrame) -> DataFrame:
    """(rid, fold): the owner's fold; for an unmatched record that of the entity it resembles most, else its own."""
    x = records.join(owners.select("rid", "owner"), "rid", "left").join(top.select("rid", F.col("sid").alias("like")), "rid", "left")
    return x.select("rid", fold(F.coalesce(F.col("owner").cast("string"), F.col("like").cast("string"), F.col("rid").cast("string"))).alias("fold"))


def pseudo_labels(c: DataFrame, high: float, low: float, top: int = 5, rid: str = "rid", sid: str = "sid", score: str = "score") -> DataFrame:
    """(rid, sid, y): of records with a sure best candidate, that one as 1 and others of the ``top`` as 0; of records without
    any likely one, all as 0."""
    order = best_first(rid, score, [sid])
    x = c.withColumns({"rank": F.row_number().over(order) - 1, "best": F.max(score).over(Window.partitionBy(rid))})
    sure = F.col("best") >= high
    y = (sure & (F.col("rank") == 0)).cast("int")
    return x.filter((F.col("rank") < top) & (sure | (F.col("best") <= low))).select(rid, sid, y.alias("y")).distinct()


# The factors and the modulus of the order of negatives.
FACTOR, OTHER_FACTOR, MODULUS = 7919, 104729, 10007
# End of fixed values.


def negatives(p: DataFrame, k: int, id_: str = "id", block: str = "block", name: str = "name") -> DataFrame:
    """(id, other): ``k`` rows of the same block with another name, in order of (7919 id + 104729 other) modulo 10007, then of other.

    The order starts at a residue that the row gives and goes on through those of the others, so no pairs are made: of each
    residue the few rows that can be wanted are kept, and one pass over a block's residues finds what each start meets first. Blocks with
    negative ids, whose remainders may be negative, are joined.
    """
    p = p.select(F.col(id_).alias("id"), F.col(block).alias("block"), F.col(name).alias("name")).filter("id IS NOT NULL AND block IS NOT NULL AND name IS NOT NULL")
    below = p.filter("id < 0").select("block").distinct()
    rest, p = p.join(below, "block", "left_semi"), p.join(below, "block", "left_anti")
    # the residue of a row as an other, and the one its own order starts at
    p = p.withColumns({"at": (F.col("id") % MODULUS * OTHER_FACTOR % MODULUS).cast("int"), "from": F.pmod(-(F.col("id") % MODULUS) * FACTOR, F.lit(MODULUS)).cast("int")})
    same = p.withColumn("rn", F.row_number().over(Window.partitionBy("block", "at", "name").orderBy("id"))).filter(F.col("rn") <= k)
    some = same.withColumn("rn", F.row_number().over(Window.partitionBy("block", "at").orderBy("id"))).filter(F.col("rn") <= 2 * k)
    starts = p.select("block", F.col("from").alias("at")).distinct().select("block", "at", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("name"))
    rows = some.select("block", "at", F.col("id").cast("long").alias("id"), "name").unionByName(starts)
    kind = p.schema["block"].dataType.simpleString()

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        """What each start of a block meets first: at most ``k`` rows of a name and 2 ``k`` in all, so any one name may be left out."""
        others: dict[int, list] = {}
        asked = set()
        for at, i, n in zip(pdf["at"].tolist(), pdf["id"].tolist(), pdf["name"].tolist(), strict=True):
            if n is None:
                asked.add(at)
            else:
                others.setdefault(at, []).append((int(i), n))
        met, out = [], []
        for around in range(2):
            for at in sorted(asked | set(others), reverse=True):
                if at in others:
                    count: dict[str, int] = {}
                    fresh = []
                    # a second time round, rows met further on are the same ones again, behind their first place
                    new = sorted(others[at])
                    for o in [*new, *[o for o in met if o not in new]] if around else [*new, *met]:
                        if count.get(o[1], 0) < k and len(fresh) < 2 * k:
                            count[o[1]] = count.get(o[1], 0) + 1
                            fresh.append(o)
                    met = fresh
                if around and at in asked:
                    out += [(pdf["block"].iloc[0], at, place, *o) for place, o in enumerate(met)]
        return pd.DataFrame(out, columns=["block", "at", "place", "other", "oname"])

    lists = rows.groupBy("block").applyInPandas(first, f"block {kind}, at int, place int, other long, oname string")
    x = p.select("id", "name", "block", F.col("from").alias("at")).join(lists, ["block", "at"]).filter("name != oname")
    order = Window.partitionBy("id").orderBy((F.col("id") % MODULUS * FACTOR + F.col("other") % MODULUS * OTHER_FACTOR) % MODULUS, "other")
    a, b = rest.select("id", "block", "name"), rest.select(F.col("id").alias("other"), F.col("block").alias("ob"), F.col("name").alias("oname"))
    y = a.join(b, (F.col("block") == F.col("ob")) & (F.col("name") != F.col("oname")))
    x, y = (t.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).select(F.col("id").alias(id_), "other") for t in (x, y))
    return x.unionByName(y)


def stratified(d: DataFrame, flag: Column, n: int, share: float, key: str) -> DataFrame:
    """``n`` rows, ``share`` of them with the flag, chosen by a hash of the key."""
    from ..sources.tables import sample_rows

    inside = int(round(n * share))
    return sample_rows(d.filter(flag), inside, key).union(sample_rows(d.filter(~flag), n - inside, key))


def least_hashed(queries: DataFrame, base: DataFrame, part: Column, k: int, id_: str, other: str, ending: str = "") -> DataFrame:
    """(id, other): the ``k`` other rows of a row's part with the least MD5 of ``id|other`` and ``ending``.

    Every pair is hashed, where the rows are, and only the best of each row leave the task.
    """
    # a chunk of ids is small, and so is the part of base rows it is tried on at once
    x = scan(queries, base, part, {"id": (F.col(id_), F.col(other)), "text": (F.col(id_).cast("string"), F.col(other).cast("string"))}, lambda t: _Least(t, k, ending.encode()), f"id {queries.schema[id_].dataType.simpleString()}, other {base.schema[other].dataType.simpleString()}, digest string", held=2048)
    order = Window.partitionBy("id").orderBy("digest", "other")
    return x.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).select(F.col("id").alias(id_), F.col("other").alias(other))


class _Least:
    """The best ``k`` others of each held query so far."""

    def __init__(self, queries: pa.Table, k: int, ending: bytes):
        self.k, self.ending = k, ending
        self.id, self.text = queries["id"].to_pylist(), [t.encode() for t in queries["text"].to_pylist()]
        self.best: list[list] = [[] for _ in self.id]  # (digest, other), in order
        self.others, self.n = [], 0
        self.alike: dict[int, list[int]] = {}
        for i, t in enumerate(self.text):
            self.alike.setdefault(len(t), []).append(i)

    def add(self, base: pa.Table) -> None:
        self.others.append(base)
        self.n += base.num_rows
        if self.n >= AT_ONCE:
            self.flush()

    def flush(self) -> None:
        if not self.n:
            return
        t = pa.concat_tables(self.others)
        self.others, self.n = [], 0
        ids, texts = t["id"].to_pylist(), [x.encode() + self.ending for x in t["text"].to_pylist()]
        endings, at = Endings(texts), {}
        for j, x in enumerate(ids):
            at.setdefault(x, []).append(j)
        own = max(map(len, at.values()))
        for rows in self.alike.values():
            step = max(32 * AT_ONCE // len(ids), 1)
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                heads = endings.heads([self.text[i] + b"|" for i in some])
                # the row itself may be among the least, and equal heads are told apart by the whole digest
                most = self.k + own
                last = np.partition(heads, most - 1, axis=1)[:, most - 1 : most] if most < len(ids) else np.full((len(some), 1), 0xFFFFFFFF, np.uint32)
                row, col = np.nonzero(heads <= last)
                for r, j in zip(row.tolist(), col.tolist(), strict=True):
                    i = some[r]
                    if ids[j] != self.id[i]:
                        self.best[i].append((hashlib.md5(self.text[i] + b"|" + texts[j]).hexdigest(), ids[j]))
                for i in some:
                    self.best[i] = sorted(self.best[i])[: self.k]

    def rows(self):
        self.flush()
        found = [(i, o, h) for i, best in zip(self.id, self.best, strict=True) for h, o in best]
        for lo in range(0, len(found), 50_000):
            cut = found[lo : lo + 50_000]
            yield pa.RecordBatch.from_pydict({"id": [x[0] for x in cut], "other": [x[1] for x in cut], "digest": [x[2] for x in cut]})


def rarest_word_negatives(p: DataFrame, words: str, k: int, id_: str = "id", block: str = "block") -> DataFrame:
    """(id, other): up to ``k`` rows of the block that share a row's rarest word, chosen by a hash of both ids.

    A row meets the rows that have its rarest word, which may be many: all of them are hashed.
    """
    w = p.select(block, id_, F.explode(F.array_distinct(words)).alias("w")).distinct()
    df = w.groupBy(block, "w").agg(F.count("*").alias("df")).filter("df > 1")
    rare = w.join(df, [block, "w"]).withColumn("rn", F.row_number().over(Window.partitionBy(id_).orderBy("df", "w"))).filter("rn = 1")
    part = F.when(F.col(block).isNotNull(), F.struct(block, "w"))
    return least_hashed(rare.select(block, "w", id_), w.withColumnRenamed(id_, "other"), part, k, id_, "other")


def random_negatives(p: DataFrame, k: int, id_: str = "id", block: str = "block", buckets: int = 64) -> DataFrame:
    """(id, other): ``k`` rows of the block by chance: each row is tried on one hashed bucket of its block."""

    def bucket(side: int) -> Column:
        digest = F.md5(F.concat_ws("|", id_, F.lit(side)))
        return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).alias("g")

    a, b = p.select(block, id_, bucket(1)), p.select(block, F.col(id_).alias("other"), bucket(2))
    return least_hashed(a, b, F.when(F.col(block).isNotNull(), F.struct(block, "g")), k, id_, "other", "|3")


def owned_excluded(neg: DataFrame, truth: DataFrame, keys: tuple[str, str] = ("id", "other")) -> DataFrame:
    """Negatives without pairs that are true."""
    return neg.join(truth.select(*keys), list(keys), "left_anti")
