"""Nearest-neighbour joins within blocks: exact, by matrix products of chunks, by inverted lists, by hashing; and sparse TF-IDF.

Record and entity ids are of one space: a row is no neighbour of itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot, norm
from ..session import written
from .scan import scan
from .windows import best_first

#: Recall that the approximate joins aim at, and the queries a choice is measured on.
RECALL, MEASURED = 0.9, 1000
#: Rows a side of the matrix products inside cells and buckets.
CHUNK = 512
#: Rounding that a matrix product may differ by from a sum in order, of vectors of length one; results that so much could change are summed in order.
NEAR = 1e-11
#: Scores that a task looks at at once.
AT_ONCE = 1 << 20
#: Stands for a null score: below all others, above the row itself. In single precision ``LOW`` does.
NULL, LOW = -1e300, -1e30
#: Lengths of vectors whose products single precision can tell apart; others are multiplied in double precision.
FINE = 1e-12, 1e12


def unit(v: Column) -> Column:
    """A vector of length one, in double precision; zero stays zero."""
    # the norm is bound to a name of its own: inside the inner function it would be summed again for every element
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))[0]


class _Held:
    """Vectors of the held queries; a null vector scores null with all others."""

    def __init__(self, queries: pa.Table):
        self.ids, self.v, self.known = _vectors(queries)
        with np.errstate(over="ignore"):
            self.longest, self.single = _longest(self.v), self.v.astype(np.float32)

    def scores(self, base: pa.Table, single: bool = True):
        """(slice of queries, base ids, scores, how far they may be from sums in order, exact(rows, columns)) in pieces.

        The row itself scores -inf, and a null vector ``NULL``, or ``LOW`` in single precision.
        """
        ids, v, known = _vectors(base)
        n = min(self.v.shape[1], v.shape[1]) if len(v) and len(self.v) else 0
        longest = _longest(v)
        single = single and all(x == 0 or FINE[0] <= x <= FINE[1] for x in (self.longest, longest))
        # a sum of n rounded products of rounded factors, in any order
        near = 1.1 * (n + 4) * 2.0 ** (-24 if single else -53) * self.longest * longest
        null, x, y = (LOW, self.single, v.astype(np.float32)) if single else (NULL, self.v, v)
        order = np.argsort(ids, kind="stable")
        first, last = (np.searchsorted(ids[order], self.ids, side) for side in ("left", "right"))
        step = max(AT_ONCE // max(len(ids), 1), 1)
        for lo in range(0, len(self.ids), step):
            some, mine = self.v[lo : lo + step], self.known[lo : lo + step]
            s = x[lo : lo + step, :n] @ y[:, :n].T
            if not mine.all() or not known.all():
                s[~mine] = null
                s[:, ~known] = null
            for i in np.flatnonzero(last[lo : lo + step] > first[lo : lo + step]):
                s[i, order[first[lo + i] : last[lo + i]]] = -np.inf

            def exact(rows, columns, some=some):
                out = np.zeros(len(rows))
                for i in range(0, len(rows), 1 << 15):
                    x, y = some[rows[i : i + (1 << 15)], :n], v[columns[i : i + (1 << 15)], :n]
                    for d in range(n):
                        out[i : i + (1 << 15)] += x[:, d] * y[:, d]
                return out

            yield lo, ids, s, near, exact


def _longest(v: np.ndarray) -> float:
    """The greatest finite length of a row."""
    sizes = np.sqrt(np.einsum("ij,ij->i", v, v))
    return float(sizes.max(initial=0.0, where=np.isfinite(sizes)))


def _vectors(t: pa.Table):
    ids, lists = t["id"].to_numpy(), pa.concat_arrays(t["v"].chunks)
    if ids.dtype == object:
        ids = ids.astype(str)
    known, sizes = lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values, size = lists.flatten(), int(sizes.max(initial=0))
    if values.null_count:
        holes = np.repeat(np.arange(len(lists)), sizes)[values.is_null().to_numpy(zero_copy_only=False)]
        known = known.copy()
        known[holes] = False
        values = values.fill_null(0.0)
    values = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if (sizes == size).all():
        return ids, values.reshape(len(lists), size), known
    v = np.zeros((len(lists), size))
    v[np.arange(size)[None, :] < sizes[:, None]] = values
    return ids, v, known & (sizes == size)


class _Best:
    """The best ``k`` base rows of each held query; equal scores in order of the id."""

    def __init__(self, queries: pa.Table, k: int):
        self.held, self.k = _Held(queries), k
        n = len(self.held.ids)
        self.row, self.sid, self.score = np.empty(0, np.int64), None, np.empty(0)
        self.last = np.full(n, -np.inf)  # the k-th best so far

    def add(self, base: pa.Table) -> None:
        k, found = self.k, []
        for lo, ids, s, near, exact in self.held.scores(base):
            null = LOW if s.dtype == np.float32 else NULL
            i, j = _at_least_best(s, np.maximum(self.last[lo : lo + len(s)] - near, null), k, near)
            score = s[i, j].astype(np.float64)
            real = score > null
            score[~real] = NULL
            score[real] = exact(i[real], j[real])
            found.append((i + lo, ids[j], score))
        row, sid, score = (np.concatenate(x) for x in zip(*found, strict=True))
        if self.sid is not None:
            row, sid, score = np.concatenate([self.row, row]), np.concatenate([self.sid, sid]), np.concatenate([self.score, score])
        order = np.lexsort((sid, -score, row))
        row, sid, score = row[order], sid[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        self.last[row[place == k - 1]] = score[place == k - 1]
        self.row, self.sid, self.score = row[keep], sid[keep], score[keep]

    def rows(self):
        for lo in range(0, len(self.row), 50_000):
            cut = slice(lo, lo + 50_000)
            score = self.score[cut]
            yield pa.RecordBatch.from_pydict({"rid": self.held.ids[self.row[cut]], "sid": self.sid[cut], "score": pa.array(score, mask=score <= NULL)})


def _at_least_best(s: np.ndarray, least: np.ndarray, k: int, near: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that are ``least`` of their row or more, and can be among its best ``k``.

    Columns are looked at in groups. The k-th of the groups' greatest scores is no more than the k-th score, which differs from the exact
    one by ``near``, as every other does.
    """
    groups = max(64, 8 * k)
    deep = s.shape[1] // groups
    head, tail = s[:, : deep * groups].reshape(len(s), deep, groups), s[:, deep * groups :]
    top = head.max(axis=1, initial=-np.inf)
    if deep < 2 or np.isnan(top).any():
        return np.nonzero(s >= _down(least, s.dtype)[:, None])
    least = np.maximum(least, np.partition(top, groups - k, axis=1)[:, groups - k] - 2 * near)
    least = _down(least, s.dtype)
    row, group = np.nonzero(top >= least[:, None])
    at, deep_at = np.nonzero(head[row, :, group] >= least[row, None])
    i, j = np.nonzero(tail >= least[:, None])
    return np.concatenate([row[at], i]), np.concatenate([deep_at * groups + group[at], j + deep * groups])


def _down(x: np.ndarray, kind: np.dtype) -> np.ndarray:
    """In that precision, never above."""
    return np.nextafter(x.astype(kind), kind.type(-np.inf))


class _AtLeast:
    """How many base rows each held query scores ``levels`` or more with, and each level's exact count."""

    def __init__(self, queries: pa.Table, levels: list[float]):
        self.held, self.levels = _Held(queries), levels
        self.n = np.zeros((len(self.held.ids), len(levels)), np.int64)

    def add(self, base: pa.Table) -> None:
        for lo, _, s, near, exact in self.held.scores(base):
            for c, level in enumerate(self.levels):
                low, high = _down(np.array([level - near]), s.dtype)[0], -_down(np.array([-level - near]), s.dtype)[0]
                sure, some = (np.array([np.count_nonzero(x) for x in s >= y]) for y in (high, low))
                self.n[lo : lo + len(s), c] += sure
                at = np.flatnonzero(some > sure)
                i, j = np.nonzero((s[at] >= low) & (s[at] < high))
                if len(i):
                    i = at[i]
                    np.add.at(self.n, (i[exact(i, j) >= level] + lo, c), 1)

    def rows(self):
        yield pa.RecordBatch.from_pydict({"rid": self.held.ids} | {f"c{c}": self.n[:, c] for c in range(len(self.levels))})


class _Bins:
    """Scores of all held queries by bin of equal width over [low, high]; the last bin is closed on the right."""

    def __init__(self, queries: pa.Table, low: float, high: float, bins: int):
        self.held, self.low, self.high, self.bins = _Held(queries), low, high, bins
        self.n, self.block, self.kind = np.zeros(bins, np.int64), queries["block"][0], queries.schema.field("block").type

    def count(self, s: np.ndarray) -> None:
        s = s[(s >= self.low) & (s <= self.high)]
        at = np.minimum(np.floor((s - self.low) / (self.high - self.low) * self.bins), self.bins - 1).astype(np.int64)
        self.n += np.bincount(at, minlength=self.bins)

    def add(self, base: pa.Table) -> None:
        for _, _, s, _, exact in self.held.scores(base, single=False):
            s[s == -np.inf] = NULL
            place = (s - self.low) * (self.bins / (self.high - self.low))
            edge = np.abs(place - np.rint(place)) < 2 * NEAR * self.bins / (self.high - self.low)
            i, j = np.nonzero(edge & (s > NULL))
            s[edge] = NULL
            self.count(s.ravel())
            if len(i):
                self.count(exact(i, j))

    def rows(self):
        some = np.flatnonzero(self.n)
        yield pa.RecordBatch.from_pydict({"block": pa.array([self.block.as_py()] * len(some), self.kind), "bin": some, "n": self.n[some]})


def top_k(pairs: DataFrame, k: int, query: str = "rid", base: str = "sid", score: str = "score", first: int = 0) -> DataFrame:
    """The best ``k`` of every query with their rank, counted from ``first``."""
    x = pairs.withColumn("rank", F.row_number().over(best_first(query, score, [base])))
    return x.filter(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1 + first).cast("long"))


def _pair_columns(id_: str, other: str) -> dict:
    return {"id": (F.col(id_), F.col(other)), "v": (F.col("v"), F.col("v"))}


def exact(queries: DataFrame, base: DataFrame, k: int, block: str = "block") -> DataFrame:
    """(rid, sid, score, rank) by scores of all pairs of a block: matrix products tell the best from the rest, and those are summed in order.

    Queries are dealt over tasks and base rows streamed past them; of equal vectors only as many rows as a query can want travel.
    """
    w = Window.partitionBy(block, "v").orderBy("sid")
    b = base.withColumns({"nth": F.dense_rank().over(w), "same": F.row_number().over(w) - F.rank().over(w)}).filter((F.col("nth") <= k + 1) & (F.col("same") < k))
    schema = f"rid {queries.schema['rid'].dataType.simpleString()}, sid {base.schema['sid'].dataType.simpleString()}, score double"
    return top_k(scan(queries, b, F.col(block), _pair_columns("rid", "sid"), lambda t: _Best(t, k), schema), k)


def at_least(queries: DataFrame, base: DataFrame, levels: list[float], block: str = "block") -> DataFrame:
    """(rid, c0, c1, ...): how many rows of its block a query scores each level or more with."""
    schema = f"rid {queries.schema['rid'].dataType.simpleString()}, " + ", ".join(f"c{i} long" for i in range(len(levels)))
    x = scan(queries, base, F.col(block), _pair_columns("rid", "sid"), lambda t: _AtLeast(t, levels), schema)
    return x.groupBy("rid").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(levels))])


def binned(queries: DataFrame, base: DataFrame, low: float, high: float, bins: int, block: str = "block") -> DataFrame:
    """(block, bin, n): how many pairs of each block score in each bin."""
    columns = _pair_columns("rid", "sid") | {"block": (F.col(block), F.col(block))}
    schema = f"block {queries.schema[block].dataType.simpleString()}, bin long, n long"
    x = scan(queries, base, F.col(block), columns, lambda t: _Bins(t, low, high, bins), schema)
    return x.groupBy(F.col("block").alias(block), "bin").agg(F.sum("n").alias("n"))


def blocked(queries: DataFrame, base: DataFrame, k: int, block: str = "block", chunk: int = 2048) -> DataFrame:
    """As ``exact``, by matrix products of chunks of at most about ``chunk`` rows a side.

    Each block's rows are dealt into as many chunks as its size asks for, so a hot block is many small tasks; a chunk
    pair yields its best ``k`` and a window merges them.
    """
    return top_k(chunk_best(queries, base, k, block, chunk), k)


def chunk_best(queries: DataFrame, base: DataFrame, k: int, block: str, chunk: int) -> DataFrame:
    """(rid, sid, score): the best ``k`` of every query in every chunk of its blocks; a query may be in several."""

    def chunks(df: DataFrame, key: str, other: str) -> DataFrame:
        n = df.groupBy(block).agg(F.ceil(F.count("*") / chunk).alias(f"n_{key}"))
        d = df.join(n, block).withColumn(f"c_{key}", F.pmod(F.xxhash64(key), F.col(f"n_{key}")))
        return d.groupBy(block, f"c_{key}").agg(F.collect_list(F.struct(key, "v")).alias(other))

    both = chunks(queries, "rid", "q").join(chunks(base, "sid", "b"), block)

    def run(batches):
        best = {}  # of the latest query chunks: ids and scores of the best so far

        def rows():
            for (_, rids), (sids, s) in best.items():
                yield pd.DataFrame({"rid": np.repeat(rids, s.shape[1]), "sid": sids.ravel(), "score": s.ravel()})
            best.clear()

        for pdf in batches:
            for q, b, part in zip(pdf["q"], pdf["b"], pdf["part"], strict=True):
                x = np.array([r["v"] for r in q], np.float64)
                y = np.array([r["v"] for r in b], np.float64)
                rids, sids = np.array([r["rid"] for r in q]), np.array([r["sid"] for r in b])
                s = np.where(rids[:, None] == sids, -np.inf, x @ y.T)
                sids = np.broadcast_to(sids, s.shape)
                key = part, tuple(rids.tolist())
                if key in best:
                    sids, s = (np.concatenate(c, axis=1) for c in zip(best[key], (sids, s), strict=True))
                elif len(best) >= 256:
                    yield from rows()
                order = np.lexsort((sids, -s), axis=1)[:, :k]
                best[key] = np.take_along_axis(sids, order, 1), np.take_along_axis(s, order, 1)
        yield from rows()

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((queries, "rid"), (base, "sid"))) + ", score double"
    return both.select("q", "b", F.col(block).cast("string").alias("part")).mapInPandas(run, schema).filter("rid != sid")


def enough(queries: DataFrame, base: DataFrame, place: Column, most: int, k: int, recall: float, block: str, seed: int) -> int | None:
    """The least effort that finds a share of ``recall`` of the true best ``k``, less three standard errors; None if ``most`` doesn't.

    ``place`` tells from the ``key`` of a query and the ``other`` of its neighbour with which effort the pair is found, 0 for never. Measured
    exactly for a bounded sample of queries.
    """
    from ..sources.tables import sample_rows

    s = sample_rows(queries, MEASURED, "rid", seed)
    true = exact(s, base, k, block).join(s.select("rid", "key"), "rid").join(base.select("sid", "other"), "sid")
    n = {r["at"]: r["n"] for r in true.groupBy(place.alias("at")).agg(F.count("*").alias("n")).collect()}  # at most ``most`` + 1 rows
    total, found = sum(n.values()), 0
    asked = max(total / k, 1)
    for at in range(1, most + 1):
        found += n.get(at, 0)
        share = found / total if total else 1.0
        if share - 3 * np.sqrt(share * (1 - share) / asked) >= recall:
            return at
    return None


def filled(found: DataFrame, queries: DataFrame, base: DataFrame, k: int, block: str) -> DataFrame:
    """``found`` with the exact best ``k`` of every query that has fewer rows."""
    found = written(found, "knn")
    full = found.groupBy("rid").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("rid")
    short = queries.join(full, "rid", "left_anti")
    return found.join(full, "rid", "left_semi").unionByName(exact(short, base, k, block).select(found.columns))


def inverted_lists(queries: DataFrame, base: DataFrame, k: int, probes: int = 4, cells: int = 16, sample: int = 100_000, block: str = "block", seed: int = 0, recall: float = RECALL) -> DataFrame:
    """Approximate: k-means cells over a bounded sample, every vector in its nearest cell, queries in their nearest ``probes``.

    More cells are probed where a sample of queries needs them for ``recall``; queries with fewer than ``k`` rows are answered exactly.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..sources.tables import sample_rows

    q, b = (written(df.filter(F.col("v").isNotNull() & F.col(block).isNotNull()), "vectors") for df in (queries, base))
    train = sample_rows(b, sample, "sid", seed).select(array_to_vector("v").alias("features"))
    centers = [c.tolist() for c in KMeans(k=cells, seed=seed, maxIter=10).fit(train).clusterCenters()]  # ``cells`` rows
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])

    def ranked(v: Column) -> Column:
        scores = F.transform(table, lambda c, i: F.struct((-dot(c, v)).alias("s"), i.alias("cell")))
        return F.transform(F.array_sort(scores), lambda s: s["cell"])

    q, b = q.withColumn("key", ranked(F.col("v"))), b.withColumn("other", ranked(F.col("v"))[0])
    if probes < len(centers):
        probes = max(probes, enough(q, b, F.array_position("key", F.col("other")), len(centers), k, recall, block, seed))
    x = q.select("rid", "v", F.col(block), F.explode(F.slice("key", 1, probes)).alias("cell"))
    x = x.select("rid", "v", F.struct(block, "cell").alias("part"))
    y = b.select("sid", "v", F.struct(F.col(block), F.col("other").alias("cell")).alias("part"))
    return filled(top_k(chunk_best(x, y, k, "part", CHUNK), k), queries, base, k, block)


def hashed(queries: DataFrame, base: DataFrame, k: int, tables: int = 4, width: float = 0.5, block: str = "block", seed: int = 0, recall: float = RECALL, most: int = 32) -> DataFrame:
    """Approximate: random-projection hashing of unit vectors, candidates that share a bucket of some table, exact scores.

    More tables, up to ``most``, are used where a sample of queries needs them for ``recall``, and exact neighbours where those don't do either;
    queries with fewer than ``k`` rows are answered exactly.
    """
    q, b = (written(df.filter(F.col("v").isNotNull() & F.col(block).isNotNull()), "vectors") for df in (queries, base))
    size = b.agg(F.max(F.size("v"))).first()[0] or 0
    lines = np.random.default_rng(seed).standard_normal((most, size))
    lines /= np.linalg.norm(lines, axis=1, keepdims=True)

    def buckets(v: Column, n: int) -> Column:
        table = F.array(*[F.array(*[F.lit(float(x)) for x in line]) for line in lines[:n]])
        return F.transform(table, lambda line: F.floor(dot(line, v) / width))

    place = F.array_position(F.zip_with("key", "other", lambda x, y: x == y), True)
    n = enough(q.withColumn("key", buckets(F.col("v"), most)), b.withColumn("other", buckets(F.col("v"), most)), place, most, k, recall, block, seed)
    if n is None:
        return exact(queries, base, k, block)
    n = max(n, tables)

    def parts(df: DataFrame, id_: str) -> DataFrame:
        x = df.select(id_, "v", F.col(block), F.posexplode(buckets(F.col("v"), n)).alias("table", "bucket"))
        return x.select(id_, "v", F.struct(block, "table", "bucket").alias("part"))

    near = chunk_best(parts(q, "rid"), parts(b, "sid"), k, "part", CHUNK).groupBy("rid", "sid").agg(F.max("score").alias("score"))
    return filled(top_k(near, k), queries, base, k, block)


def char_ngrams(c: Column, n: int = 3) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))


def tfidf(df: DataFrame, id_: str, terms: Column, idf: DataFrame, block: str = "block") -> DataFrame:
    """(block, id, term, w): term frequency times idf, rows of length one. ``idf``: (block, term, idf)."""
    tf = df.select(block, id_, F.explode(terms).alias("term")).groupBy(block, id_, "term").agg(F.count("*").alias("tf"))
    x = tf.join(idf, [block, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    n = x.groupBy(block, id_).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return x.join(n, [block, id_]).filter("norm > 0").select(block, id_, "term", (F.col("w") / F.col("norm")).alias("w"))


def sparse_scores(queries: DataFrame, base: DataFrame, query: str, other: str, block: str = "block") -> DataFrame:
    """(query, other, score): cosines of sparse rows, by a join on the term inside the block and a sum per pair."""
    b = base.select(block, "term", other, F.col("w").alias("w2"))
    return queries.select(block, "term", query, "w").join(b, [block, "term"]).groupBy(query, other).agg(F.sum(F.col("w") * F.col("w2")).alias("score"))


def mutual_best(queries: DataFrame, base: DataFrame, block: str = "block") -> DataFrame:
    """(rid, sid, best, second, mutual): every query's best base row, its score and the next one's, and whether the query is that row's best."""
    two = exact(queries, base, 2, block)
    back = exact(base.withColumnRenamed("sid", "rid"), queries.withColumnRenamed("rid", "sid"), 1, block).select(F.col("rid").alias("sid"), F.col("sid").alias("back"))
    first = Window.partitionBy("rid").orderBy("rank")
    x = two.withColumn("second", F.lead("score").over(first)).filter("rank = 0").join(back, "sid")
    return x.select("rid", "sid", F.col("score").alias("best"), F.coalesce("second", F.lit(0.0)).alias("second"), (F.col("back") == F.col("rid")).alias("mutual"))
