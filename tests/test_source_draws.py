"""Normal draws of source counts."""

from conftest import DATA
from pyspark.sql import functions as F

from tesselark.operators import particles as PT
from tesselark.plans import catalogue, tables as T


def counts(df):
    return {r["elem_id"]: r["n"] for r in df.collect()}


def test_draws_are_normal_and_decided_by_the_key(spark):
    rows = spark.range(50_000).withColumn("z", PT.normal_draw(3, F.col("id")))
    mean, deviation, within = rows.agg(F.avg("z"), F.stddev("z"), F.avg((F.abs("z") < 1).cast("int"))).first()
    assert abs(mean) < 0.02 and abs(deviation - 1) < 0.02 and abs(within - 0.6827) < 0.01
    other = spark.range(50_000).repartition(7).withColumn("z", PT.normal_draw(3, F.col("id")))
    assert rows.exceptAll(other).isEmpty()
    assert not rows.exceptAll(rows.withColumn("z", PT.normal_draw(4, F.col("id")))).isEmpty()


def test_counts_by_class(spark):
    """All particles are placed, in order until they are used up, on the owner's elements of the classes asked for."""
    elem = spark.range(3000).select(F.col("id").alias("eid"), (F.col("id") % 3).cast("int").alias("owner"), (F.col("id") % 5).cast("int").alias("class_id"))
    got = counts(PT.source_elements_by_class(elem, 1, 2, 120_000, seed=1))
    assert sorted(got) == [e for e in range(3000) if e % 3 == 1 and e % 5 <= 2] and sum(got.values()) == 120_000
    assert got == counts(PT.source_elements_by_class(elem.repartition(5), 1, 2, 120_000, seed=1))
    used = [got[e] for e in sorted(got)][:500]  # the last elements take what is left
    assert 195 < sum(used) / len(used) < 205 and min(got.values()) >= 0 and 40 < (sum((n - 200) ** 2 for n in used) / len(used)) ** 0.5 < 60


def test_no_element_and_few_particles(spark):
    elem = spark.createDataFrame([(4, 0, 1), (5, 0, 9), (6, None, None)], "eid long, owner int, class_id int")
    assert counts(PT.source_elements_by_class(elem, 3, 5, 10)) == {}
    assert counts(PT.source_elements_by_class(elem, 0, 1, 10)) == {4: 10}
    assert sum(counts(PT.source_elements_by_class(elem, 0, 9, 1)).values()) == 1


def test_query(spark):
    got = counts(catalogue.QUERIES["source_elements_normal"](spark, DATA))
    assert sum(got.values()) == T.size(spark, DATA).events
