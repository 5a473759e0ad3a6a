"""Window operators over candidate pairs: ranks, gaps, near ties, shares, leave-one-out context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_first(group: str | list[str], score: str, tie: list[str]):
    """A window with the best score first; ties in ascending order of ``tie``."""
    group = [group] if isinstance(group, str) else group
    return Window.partitionBy(*group).orderBy(F.col(score).desc(), *tie)


def rank_in(group: str, score: str, tie: list[str], base: int = 0) -> Column:
    return (F.row_number().over(best_first(group, score, tie)) - 1 + base).cast("long")


def retrieval_features(c: DataFrame, rid: str = "rid", sid: str = "sid", score: str = "score", temperature: float = 0.05, near: tuple[float, ...] = (0.02, 0.05, 0.1)) -> DataFrame:
    """rank, top1, gap to it, gap to the next candidate (its score + 1 for the last), near ties and the softmax share.

    All windows have one partitioning, so there is one exchange.
    """
    whole = Window.partitionBy(rid)
    order = best_first(rid, score, [sid])
    s = F.col(score)
    out = c.withColumns({"rank": rank_in(rid, score, [sid]), "top1": F.max(s).over(whole), "next": F.lead(s).over(order)})
    cols = {"gap_top1": F.col("top1") - s, "gap_next": s - F.coalesce("next", F.lit(-1.0))}
    for d in near:
        cols[f"n{int(round(d * 100)):02d}"] = F.count_if(s >= F.col("top1") - d).over(whole)
    e = F.exp((s - F.col("top1")) / temperature)
    cols["soft"] = e / F.sum(e).over(whole)
    return out.withColumns(cols).drop("next")


def entity_ranks(c: DataFrame, rid: str = "rid", sid: str = "sid", score: str = "score") -> DataFrame:
    """Of every candidate: its rank among the entity's, how many the entity has, and how many of them it tops."""
    whole = Window.partitionBy(sid)
    return c.withColumns({"s1_rank": rank_in(sid, score, [rid]), "s1_nref": F.count("*").over(whole), "s1_ntop": F.count_if(F.col("rank") == 0).over(whole)})


def other_max(value: str, group: str, tie: list[str]) -> Column:
    """Largest value of the group's other rows; null where there is none."""
    w = best_first(group, value, tie)
    second = F.nth_value(value, 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(F.row_number().over(w) == 1, second).otherwise(F.max(value).over(Window.partitionBy(group)))


def best_rows(p: DataFrame, rid: str = "rid", sid: str = "sid", score: str = "p", floor: float = 0.2) -> DataFrame:
    """The best candidate of every record, with the runner-up's score (0 if none), the margin and candidates >= ``floor``."""
    w = best_first(rid, score, [sid])
    out = p.withColumns({"rn": F.row_number().over(w), "p2": F.coalesce(F.lead(score).over(w), F.lit(0.0)), "rec_n20": F.count_if(F.col(score) >= floor).over(Window.partitionBy(rid))})
    return out.filter("rn = 1").drop("rn").withColumn("margin", F.col(score) - F.col("p2"))


def entity_context(d: DataFrame, sid: str = "sid", rid: str = "rid", score: str = "p", source: str = "src") -> DataFrame:
    """What else claims a record's entity, itself left out."""
    whole, mine = Window.partitionBy(sid), Window.partitionBy(sid, source)
    p = F.col(score)

    def others(level: float, w=whole) -> Column:
        return F.count_if(p >= level).over(w) - (p >= level).cast("long")

    same = others(0.5, mine)
    return d.withColumns({
        "e_n": F.count("*").over(whole) - 1,
        "e_ge90": others(0.9), "e_ge50": others(0.5), "e_ge20": others(0.2),
        "e_sum": F.sum(p).over(whole) - p,
        "e_max_other": F.coalesce(other_max(score, sid, [rid]), F.lit(0.0)),
        "e_rank": rank_in(sid, score, [rid]),
        "e_ge50_same_src": same, "e_ge50_other_src": others(0.5) - same,
    })


def number_peers(d: DataFrame, sid: str = "sid", rid: str = "rid", number: str = "kr", score: str = "p") -> DataFrame:
    """Other records of the entity with the same number: how many, largest and summed score; null without a number."""
    w = Window.partitionBy(sid, number)
    p, has = F.col(score), F.col(number) >= 0
    first = Window.partitionBy(sid, number).orderBy(p.desc(), rid)
    second = F.nth_value(score, 2).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    largest = F.when(F.row_number().over(first) == 1, second).otherwise(F.max(score).over(w))
    return d.withColumns({
        "e_np_n": F.when(has, F.count("*").over(w) - 1),
        "e_np_max": F.when(has, largest),
        "e_np_sum": F.when(has, F.sum(p).over(w) - p),
        "e_np_keys": F.size(F.collect_set(F.when(has, F.col(number))).over(Window.partitionBy(sid))).cast("long"),
    })


def scorer_context(c: DataFrame, score: str = "ce", rid: str = "rid", sid: str = "sid", missing: float = -20.0) -> DataFrame:
    """Context of an external scorer's logit: rank and gap in the record, rank and other positives in the entity."""
    c = c.withColumn(score, F.coalesce(score, F.lit(missing)))
    s = F.col(score)
    return c.withColumns({
        f"{score}_rank": rank_in(rid, score, [sid]),
        f"{score}_gap": s - other_max(score, rid, [sid]),
        f"{score}_s1_rank": rank_in(sid, score, [rid]),
        f"{score}_s1_pos": F.count_if(s > 0).over(Window.partitionBy(sid)) - (s > 0).cast("long"),
    })


def shortlist(c: DataFrame, rule: str, rid: str = "rid", sid: str = "sid", score: str = "score") -> DataFrame:
    """Candidates a rule keeps: ``top:k``, ``gap:d`` (within d of the best), ``softmax:t:mass`` (until the mass before is reached)
    or ``model:tau`` (a column ``keep_p``). The best candidate is kept by every rule but the last."""
    kind, *args = rule.split(":")
    whole, order = Window.partitionBy(rid), best_first(rid, score, [sid])
    if kind == "top":
        return c.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= int(args[0])).drop("rn")
    if kind == "gap":
        return c.withColumn("top", F.max(score).over(whole)).filter(F.col("top") - F.col(score) <= float(args[0])).drop("top")
    if kind == "softmax":
        e = F.exp((F.col(score) - F.max(score).over(whole)) / float(args[0]))
        c = c.withColumn("e", e)
        before = F.coalesce(F.sum("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.sum("e").over(whole)
        return c.withColumn("before", before).filter(F.col("before") < float(args[1])).drop("e", "before")
    return c.filter(F.col("keep_p") >= float(args[0]))


def first_per_group(df: DataFrame, group: str, n: int, order: list) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rn") <= n).drop("rn")
