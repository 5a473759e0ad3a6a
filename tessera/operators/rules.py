"""Decision rules on claims: positions and census, word statistics, restoring and rejecting lists, structural acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.metrics import partial_udf, unlike_udf, unmatched_udf
from .windows import best_first


def positions(d: DataFrame, sid: str = "sid", number: str = "kr", own: str = "ks") -> DataFrame:
    """``pos`` of each claim: NONE without numbers, SAME at the entity's, D at its most frequent other one, else OTHER."""
    known = (F.col(number) >= 0) & (F.col(own) >= 0)
    other = d.filter(known & (F.col(number) != F.col(own))).groupBy(sid, number).agg(F.count("*").alias("n"))
    most = other.groupBy(sid).agg(F.max(F.struct("n", (-F.col(number)).alias("m"))).alias("x")).select(sid, (-F.col("x.m")).alias("dk"))
    pos = F.when(~known, "NONE").when(F.col(number) == F.col(own), "SAME").when(F.col(number) == F.col("dk"), "D").otherwise("OTHER")
    return d.join(most, sid, "left").withColumn("pos", pos).drop("dk")


def census(d: DataFrame, sid: str = "sid", most: int = 4) -> DataFrame:
    """``n_d``: claims of the entity away from its number, ``most`` at the utmost."""
    return d.withColumn("n_d", F.least(F.count_if(F.col("pos").isin("D", "OTHER")).over(Window.partitionBy(sid)), F.lit(most)).cast("long"))


def word_spread(x: DataFrame, least: int, word: str = "w", count: str = "n_d", plain: str = "plain", bins: int = 5) -> DataFrame:
    """(w, n, tv): total variation between a word's claims and unedited ones, over the census 0..bins-1.

    The reference distribution is one row, so it is broadcast.
    """
    cells = [F.count_if(F.col(count) == i) for i in range(bins)]
    ref = x.filter(plain).agg(*[(c / F.count("*")).alias(f"r{i}") for i, c in enumerate(cells)])
    w = x.filter(~F.col(plain)).groupBy(word).agg(F.count("*").alias("n"), *[c.alias(f"c{i}") for i, c in enumerate(cells)]).filter(F.col("n") >= least)
    tv = sum((F.abs(F.col(f"c{i}") / F.col("n") - F.coalesce(F.col(f"r{i}"), F.lit(0.0))) for i in range(bins)), F.lit(0.0)) / 2
    return w.crossJoin(F.broadcast(ref)).select(word, "n", tv.alias("tv"))


def word_classes(spread: DataFrame, true: float = 0.10, decoy: float = 0.20, ratio: float = 0.1) -> DataFrame:
    """``spread`` (with same/D counts) with ``kind``: true-like, decoy-like or neither."""
    like = (F.col("tv") <= true) & (F.col("n") / F.greatest(F.col("n_other"), F.lit(1)) >= ratio)
    return spread.withColumn("kind", F.when(like, "true").when(F.col("tv") >= decoy, "decoy").otherwise("unclear"))


def word_fixes(d: DataFrame, added: str, true: list[str], decoy: list[str]) -> DataFrame:
    """``fix``: restore claims that add only true-like words, reject those that add a decoy-like one."""
    known, bad = F.array(*[F.lit(w) for w in true]), F.array(*[F.lit(w) for w in decoy])
    only = (F.size(added) > 0) & (F.size(F.array_except(added, known)) == 0)
    return d.withColumn("fix", F.when(only, "restore").when(F.arrays_overlap(added, bad), "reject").otherwise("leave"))


def word_rates(x: DataFrame, high: DataFrame, pseudo: int = 20, least: int = 30, least_low: int = 300, group: str = "c", word: str = "w", same: str = "same") -> DataFrame:
    """(c, w, n, rate, z): smoothed rate of claims at the entity's number per word, scaled between words that say nothing
    (the 5th percentile, weighted by frequency) and unedited claims (``high``)."""
    base = x.groupBy(group).agg(F.avg(F.col(same).cast("double")).alias("base"))
    c = x.groupBy(group, word).agg(F.count("*").alias("n"), F.sum(F.col(same).cast("double")).alias("s")).filter(F.col("n") >= least)
    r = c.join(base, group).withColumn("rate", (F.col("s") + pseudo * F.col("base")) / (F.col("n") + pseudo))
    low = r.filter(F.col("n") >= least_low).groupBy(group).agg(F.percentile("rate", F.lit(0.05), F.floor(F.col("n") / 100) + 1).alias("lo"))
    z = (F.col("rate") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return r.join(low, group).join(high, group).select(group, word, "n", "rate", F.least(F.greatest(z, F.lit(-0.5)), F.lit(1.5)).alias("z"))


def word_suspicion(pairs: DataFrame, entities: DataFrame, a: str = "cn1", b: str = "cn2", group: str = "country", least: int = 20) -> DataFrame:
    """(country, w, susp, log_df): how much more often a word is added to a name than it occurs in names, less the median."""
    n_pm = pairs.groupBy(group).agg(F.count("*").alias("n_pm"))
    n_s1 = entities.groupBy(group).agg(F.count("*").alias("n_s1"))
    ins = pairs.select(group, F.explode(F.array_distinct(F.array_except(b, a))).alias("w")).groupBy(group, "w").agg(F.count("*").alias("ins")).filter(F.col("ins") >= least)
    df = entities.select(group, F.explode(F.array_distinct(a)).alias("w")).groupBy(group, "w").agg(F.count("*").alias("df"))
    x = ins.join(df, [group, "w"], "left").na.fill(0, ["df"]).join(n_pm, group).join(n_s1, group)
    raw = F.log((F.col("ins") / F.greatest("n_pm", F.lit(1)) + 1e-5) / (F.col("df") / F.col("n_s1") + 1e-5))
    x = x.withColumn("raw", raw)
    med = x.groupBy(group).agg(F.median("raw").alias("med"))
    return x.join(med, group).select(group, "w", (F.col("raw") - F.col("med")).alias("susp"), F.log(F.col("df") / F.col("n_s1") + 1e-6).alias("log_df"))


def occupants(entities: DataFrame, place: list[str]) -> DataFrame:
    """``here``: how many entities are at the same place."""
    c = entities.groupBy(*place).agg(F.count("*").alias("here"))
    return entities.join(c, place)


def restore_empty(d: DataFrame, accepted: float, floor: float, unlabelled: Column, score: str = "q", judge: str = "llm") -> DataFrame:
    """The best claim from ``floor`` up of every entity that has nothing accepted; where there are no labels, the judge must
    not say no. A claim without a judgement isn't a no."""
    has = d.filter(F.col(score) >= accepted).select("sid").distinct()
    no = unlabelled & F.coalesce(F.col(judge) <= 0, F.lit(False))
    left = d.filter((F.col(score) >= floor) & ~no).join(has, "sid", "left_anti")
    return left.withColumn("rn", F.row_number().over(best_first("sid", score, ["rid"]))).filter("rn = 1").drop("rn")


def restore_unique_name(d: DataFrame, name1: str, name2: str, entity_count: str, judge: str = "llm") -> DataFrame:
    """Claims without an address whose name only one entity has, and to which the judge says yes."""
    return d.filter((F.col("address2") == "") & (F.col(name1) == F.col(name2)) & (F.col(entity_count) == 1) & F.coalesce(F.col(judge) > 0, F.lit(False)))


def near_number(d: DataFrame, candidates: DataFrame, reach: int = 13) -> DataFrame:
    """Claims for whose record another candidate's number is 1 to ``reach`` below the claim's (an anchor of shifted numbers)."""
    c = candidates.select("rid", F.col("sid").alias("sid2"), F.col("n1").alias("k2"))
    hit = d.join(c, "rid").filter((F.col("sid2") != F.col("sid")) & (F.col("n1") - F.col("k2")).between(1, reach)).select("rid", "sid").distinct()
    return d.join(hit, ["rid", "sid"], "left_semi")


def on_street(u: Column, w: Column) -> Column:
    """Whether ``u`` has words and each has a counterpart in ``w``."""
    return (F.size(u) > 0) & (F.size(unmatched_udf(u, w)) == 0)


def structural(d: DataFrame, unknown_z: float = 1.0, least_z: float = 0.1) -> DataFrame:
    """Claims that agree in house, second number, street and name, and add no word that says otherwise.

    Columns: house1/2 and number2_1/2, street1 (distinctive words), words2 (address words), name1/2 (core names, arrays), rare1
    (the rarest core word), full1/2 (whole names), z (map of word scores).
    """
    house = (F.col("house1") == F.col("house2")) & (F.col("house1") != "")
    second = (F.col("second1") < 0) | (F.col("second2") < 0) | (F.col("second1") == F.col("second2"))
    street = (F.size("street1") == 0) | (2 * (F.size("street1") - F.size(unmatched_udf(F.col("street1"), F.col("words2")))) >= F.size("street1"))
    first = F.try_element_at("name1", F.lit(1)) == F.try_element_at("name2", F.lit(1))
    rare = F.array_contains("name2", F.col("rare1"))
    added = unmatched_udf(F.col("full2"), F.col("full1"))
    fine = F.forall(added, lambda t: F.coalesce(F.try_element_at(F.col("z"), t), F.lit(unknown_z)) >= least_z)
    return d.filter(house & second & street & first & rare & fine)


def exact_place(d: DataFrame) -> DataFrame:
    """Claims at the exact address of its only entity whose name adds nothing: initials, a subset, or a website of the name.

    Columns: n1/n2 numbers, street1/2 words, here (entities at the address), name1/2 core names (arrays), raw2 (lower-case ASCII
    name), base (whether other models agree).
    """
    place = (F.col("n2") >= 0) & (F.col("n1") == F.col("n2")) & (F.col("here") == 1) & on_street(F.col("street1"), F.col("street2")) & on_street(F.col("street2"), F.col("street1"))
    only = F.element_at("name2", 1)

    def spells(least: int) -> Column:
        return F.startswith(X.initials(F.filter("name1", lambda t: F.length(t) >= least)), only)

    ini = (F.size("name2") == 1) & F.length(only).between(2, 5) & (spells(1) | spells(4))
    subset = F.size(F.array_except("name2", "name1")) == 0
    stem = F.regexp_replace(F.substring_index("raw2", ".", 1), "[^a-z]", "")
    web = X.is_website(F.col("raw2")) & (partial_udf(F.array_join("name1", ""), stem) >= 80)
    return d.filter(place & (ini | (F.col("base") & (subset | web))))


def made_up(words: Column, known: Column) -> Column:
    """Words of four letters or more that no entity's name has."""
    return F.filter(words, lambda t: (F.length(t) >= 4) & t.rlike("^[a-z]+$") & ~F.array_contains(known, t))


def change_report(d: DataFrame, before: Column, after: Column, true: Column, by: str) -> DataFrame:
    """What a rule changes, by group: rows, share of true ones, accepted before and after."""
    x = d.filter(before != after)
    return x.groupBy(by).agg(F.count("*").alias("changed"), F.round(F.avg(true.cast("double")), 6).alias("precision"), F.count_if(before).alias("before"), F.count_if(after).alias("after"))


def restore_core_name(d: DataFrame, core1: str = "cn1", core2: str = "cn2", entity_count: str = "n_core", judge: str = "llm") -> DataFrame:
    """Claims without an address whose core name equals the entity's, which no other entity has, where the judge says yes."""
    return d.filter((F.col("address2") == "") & (F.col(core1) == F.col(core2)) & (F.col(core1) != "") & (F.col(entity_count) == 1) & F.coalesce(F.col(judge) > 0, F.lit(False)))


def restore_vetoed(d: DataFrame, main: str = "mq", threshold: float = 0.7) -> DataFrame:
    """Vetoed claims without an address that the main model accepts and whose every name word is on the entity's name, or
    whose core name only that entity has."""
    words = on_street(F.col("name2"), F.col("name1"))
    return d.filter((F.col("address2") == "") & (F.col(main) >= threshold) & (words | (F.col("n_core") == 1)))


def restore_alias(d: DataFrame, known: DataFrame, sure: float = 0.80, likely: float = 0.10, most: int = 2, generic: int = 200) -> DataFrame:
    """Claims at the exact address of its only entity under a made-up name, where the main model's score ``mq`` is high, or is
    not hopeless and the entity has few such names.

    ``known``: (w, n), how many entities' names have a word. A made-up name has a new word of four letters or more, else only
    generic or short words, and nothing like the entity's name. Columns: rid, sid, name1/2 (arrays), raw2, here, n1/n2, street1/2.
    """
    place = (F.col("n2") >= 0) & (F.col("n1") == F.col("n2")) & (F.col("here") == 1) & on_street(F.col("street1"), F.col("street2")) & on_street(F.col("street2"), F.col("street1"))
    x = d.filter(place & ~F.col("raw2").rlike(r"\.(com|fr|in|net|org)\b|^[@#]"))
    w = x.select("rid", "sid", F.explode("name2").alias("w")).join(known, "w", "left")
    new = (F.length("w") >= 4) & F.col("w").rlike("^[a-z]+$") & F.col("n").isNull()
    fine = new | (F.coalesce("n", F.lit(0)) >= generic) | (F.length("w") <= 2)
    names = w.groupBy("rid", "sid").agg(F.bool_or(new).alias("has_new"), F.bool_and(fine).alias("all_fine")).filter("has_new AND all_fine").select("rid", "sid")
    own = F.filter("name1", lambda t: F.length(t) >= 2)
    joined = F.array_join("name2", "")
    x = x.join(names, ["rid", "sid"], "left_semi").filter(F.size(own) > 0)
    apart = (F.size(unlike_udf(F.col("name2"), own)) == F.size("name2")) & ~F.exists(own, lambda t: (F.length(t) >= 4) & F.contains(joined, t))
    x = x.filter(apart).withColumn("n_alias", F.count("*").over(Window.partitionBy("sid")))
    return x.filter((F.col("mq") >= sure) | ((F.col("mq") >= likely) & (F.col("n_alias") <= most)))


def reject_decoy_words(d: DataFrame, decoys: list[str], unlabelled: Column, added: str = "added") -> DataFrame:
    """Claims of blocks without labels that add a decoy-like word (see ``word_classes``)."""
    return d.filter(unlabelled & F.arrays_overlap(added, F.array(*[F.lit(w) for w in decoys])))


def unjudged(d: DataFrame, scores: DataFrame, keys: tuple[str, str] = ("rid", "sid")) -> DataFrame:
    """Claims that rules would like a judgement of and that have none yet."""
    return d.join(scores.filter(F.col("llm").isNotNull()).select(*keys), list(keys), "left_anti")


def distinctive_street(street: Column, common: Column) -> Column:
    """Street words without those that many addresses of the block have."""
    return F.array_except(street, common)


def baseline(d: DataFrame, rule: str, a: float, b: float = 0.0) -> Column:
    """Simple acceptance rules: cosine, name and address, the same with mutual best, or a weighted sum."""
    if rule == "cosine":
        return F.col("score") >= a
    if rule == "both":
        return (F.col("name") >= a) & (F.col("address") >= b)
    if rule == "mutual":
        return (F.col("name") >= a) & (F.col("address") >= b) & F.col("mutual")
    return 0.4 * F.col("name") + 0.6 * F.col("address") >= a


def baseline_grid(d: DataFrame, grid: list[tuple[str, float, float]], true: str = "tru") -> DataFrame:
    """(rule, a, b, accepted, precision, recall) of every rule of the grid, in one pass over the pairs."""
    t = F.col(true)
    aggs = [F.count_if(t).alias("t")]
    for i, (rule, a, b) in enumerate(grid):
        ok = baseline(d, rule, a, b)
        aggs += [F.count_if(ok).alias(f"n{i}"), F.count_if(ok & t).alias(f"h{i}")]
    row = d.agg(*aggs)
    cells = [F.struct(F.lit(r).alias("rule"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.col(f"n{i}").alias("accepted"), F.try_divide(F.col(f"h{i}"), F.col(f"n{i}")).alias("precision"), F.try_divide(F.col(f"h{i}"), F.col("t")).alias("recall")) for i, (r, a, b) in enumerate(grid)]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def weak_names(d: DataFrame, by: list[str], name: str = "name", address: str = "address", low: float = 50.0) -> DataFrame:
    """Of pairs with unlike names: their share, how like their addresses are, and the share where both are unlike."""
    weak = F.col(name) < low
    return d.groupBy(*by).agg(
        F.avg(weak.cast("double")).alias("weak_share"),
        F.percentile(F.when(weak, F.col(address)), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("address_q"),
        F.avg((weak & (F.col(address) < low)).cast("double")).alias("both_weak"),
    )


def blend_report(d: DataFrame, before: str, after: str, extra: str, threshold: float, by: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """By group: unsure rows, those with an extra score, accepted before and after."""
    return d.groupBy(by).agg(F.count_if((F.col(before) > low) & (F.col(before) < high)).alias("unsure"), F.count(extra).alias("scored"), F.count_if(F.col(before) >= threshold).alias("before"), F.count_if(F.col(after) >= threshold).alias("after"))
