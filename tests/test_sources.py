import pytest
from pyspark.sql import functions as F

from tessera.sources import tables
from tessera.streaming.resolve import link_stream


def test_tsv_keeps_quotes_and_empties(spark, tmp_path):
    f = tmp_path / "a.tsv"
    f.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tThe "Shop\t\tUS\n')
    r = tables.read_tsv(spark, str(f)).first()
    assert tuple(r) == ("S1-1", 'The "Shop', "", "US")


def test_truth_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "entity string, pos int")
    p = spark.createDataFrame([("a", "r2"), ("a", "r1"), ("c", "r3")], "entity string, record string")
    links = tables.joined_ids(e, p)
    assert {r.entity: r.ids for r in links.collect()} == {"a": "r1,r2", "b": "", "c": "r3"}
    wanted = ["source1_entity_id\tmatched_entity_ids", "a\tr1,r2", "b\t", "c\tr3"]
    for one in (True, False):
        tables.write_links(links.join(e, "entity"), str(tmp_path / f"out{one}"), order="pos", one_file=one)
        parts = [f.read_text().splitlines() for f in sorted((tmp_path / f"out{one}").glob("part-*"))]
        assert [x for p_ in parts for x in p_[1:]] == wanted[1:] and all(p_[0] == wanted[0] for p_ in parts if p_)
        assert len(parts) == 1 or not one
    assert tables.explode_truth(links, "entity", "ids").count() == 3
    bad = links.union(spark.createDataFrame([("x", "r1,r9")], "entity string, ids string"))
    found = {r.problem: r.n for r in tables.validate_links(bad, e.select("entity"), p.select("record")).collect()}
    assert found == {"unknown entity": 1, "missing entity": 0, "entity twice": 0, "unknown record": 1, "record of several entities": 1}


def test_cache_steps_and_shards(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    steps = tables.Steps(spark, str(tmp_path))
    assert steps.run("a", build).count() == steps.run("a", build).count() == 3
    assert len(calls) == 1
    spark.createDataFrame([(1, None)], "k int, v double").write.parquet(str(tmp_path / "s1"))
    spark.createDataFrame([(1, 2.0)], "k int, v double").write.parquet(str(tmp_path / "s2"))
    spark.createDataFrame([(1, 3.0)], "k int, v double").write.parquet(str(tmp_path / "s3"))
    spark.createDataFrame([(1, float("nan"))], "k int, v double").write.parquet(str(tmp_path / "s0"))
    assert tables.read_shards(spark, str(tmp_path / "s*"), ["k"]).first()["v"] == 2.0


def test_small_helpers(spark, tmp_path):
    df = spark.range(100)
    a, b = (sorted(r.id for r in tables.sample_rows(df.repartition(n), 10, "id").collect()) for n in (2, 5))
    assert a == b and len(a) == 10
    tables.write_json(spark, [{"a": 1}], str(tmp_path / "x.json"))
    assert tables.read_json(spark, str(tmp_path / "x.json")) == [{"a": 1}]
    u = tables.union_sources(S2=df.limit(1), S3=df.limit(2))
    assert {r.src: r["count"] for r in u.groupBy("src").count().collect()} == {"S2": 1, "S3": 2}
    assert tables.resolve_values("unlabelled", ["a", "b"], ["b"]) == ["b"]
    assert spark.createDataFrame([("S2-9",)], "e string").select(tables.source_of(F.col("e"))).first()[0] == "S2"


def test_stream(spark, tmp_path):
    cols = "entity_id string, business_name string, country string"
    e = spark.createDataFrame([("S1-1", "Acme Tools", "US"), ("S1-2", "Blue Ocean", "US")], cols)
    spark.createDataFrame([("S2-1", "acme tools", "US"), ("S2-2", "nothing", "US")], cols).write.parquet(str(tmp_path / "in"))
    got = []
    q = link_stream(spark.readStream.schema(cols).parquet(str(tmp_path / "in")), e, lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert [(r.rid, r.sid) for r in got] == [("S2-1", "S1-1")]


def test_scratch_belongs_to_its_scope(spark):
    from tessera import session

    with session.scratch_scope() as outer:
        kept = session.written(spark.range(3), "kept")
        with session.scratch_scope() as inner:
            session.written(spark.range(4), "gone")
    assert len(outer) == 2 and len(inner) == 1
    session.remove_paths(spark, inner)
    assert not inner and kept.count() == 3


def test_stores_and_aliases(spark, tmp_path):
    a = spark.createDataFrame([(1, [1, 2])], "id int, ids array<int>")
    assert tables.concat_stores(a, a).count() == 2
    a.write.parquet(str(tmp_path / "t"))
    assert tables.alias_table(spark, "other_name", str(tmp_path / "t")).count() == spark.table("other_name").count() == 1
