"""How Spark derives the transport tables."""

import itertools
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from meridion import catalogue
from meridion.functions import lines as lines_
from meridion.operators import choice, road
from meridion.plans import domain

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stop_times", "links"])
def test_items_are_dealt_out_once_in_tasks_of_bounded_size(spark, monkeypatch, name):
    want = sorted(map(tuple, domain.table(spark, FOLDER, name).collect()))
    monkeypatch.setattr(domain, "TASK_BYTES", 4_000)
    got = domain.table(spark, FOLDER, name)
    plan = got._jdf.queryExecution().executedPlan().toString()
    exchanges = [e for e in re.findall(r"Exchange hashpartitioning\((\w+)#\d+L, (\d+)\)", plan) if e[0] != "o_orderkey"]
    assert len(exchanges) == 1 and int(exchanges[0][1]) > 10 and "REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, got.collect())) == want


def test_feed_frequencies_equals_sql_beyond_a_million_trips(spark, tmp_path):
    """Trips 2,000,000 later that depart a second earlier: by the SQL's sum of both, the earlier trips stand for their patterns."""
    items, orders = spark.read.parquet(f"{FOLDER}/lineitem.parquet"), spark.read.parquet(f"{FOLDER}/orders.parquet")
    later = lambda df, key: df.withColumn(key, F.col(key) + 2_000_000)
    items.withColumn("l_quantity", F.col("l_quantity") + 1).union(later(items, "l_orderkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.union(later(orders, "o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    for t in ("lineitem", "orders"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = duck.execute(catalogue.ORACLES["feed_frequencies"]).fetchall()
    got = catalogue.QUERIES["feed_frequencies"](spark, str(tmp_path)).select("line", "pattern", "trip", "headway").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", sorted(domain.SPARK))
def test_spark_derives_the_same_tables_in_one_reading(spark, name):
    got, want = domain.table(spark, FOLDER, name), domain.run(spark, FOLDER, domain.DOMAIN[name])
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("l_quantity#") > 0 and len(re.findall(r"Relation \[l_orderkey", got._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_demand_is_derived_once(spark):
    """A volume that counts how often it is worked out: 8 passes of an assignment read it once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    links = spark.createDataFrame([(0, 1, 1.0, 5.0), (1, 0, 1.0, 5.0), (0, 2, 2.0, 5.0), (2, 1, 2.0, 5.0), (1, 2, 2.0, 5.0)], "a int, b int, time double, capacity double")
    demand = spark.createDataFrame([(0, 1, 9.0), (1, 2, 4.0)], "origin int, destination int, volume double").mapInArrow(counted, "origin int, destination int, volume double")
    flow, _ = road.equilibrium(links, demand, "msa", 7, 0.0)
    assert seen.value == 2 and sum(flow.values()) >= 13.0


def test_sampled_deals_out_the_units_of_a_row(spark):
    od = spark.createDataFrame([(1, 2, 1000.5), (1, 2, 1000.5), (3, 4, 0.0), (5, 6, 7.0), (7, 8, 999.25)], "origin int, destination int, volume double")
    whole, parts = (sorted(map(tuple, choice.sampled(od, 0.3, 1, block).collect())) for block in (100_000, 10))
    assert whole == parts and len(parts) == 5 and parts[0] == parts[1] and 200 < parts[0][2] < 400


def test_cut_is_worked_out_in_a_bounded_expression(spark):
    rng = random.Random(4)
    lines = [([(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(rng.randrange(1, 6))], rng.choice([-1.0, 0.0, 1.0, 3.0, 5.5, 8.0, 60.0])) for _ in range(60)]
    df = spark.createDataFrame(lines, "line array<struct<x:double,y:double>>, at double")
    parts = lines_.cut(F.col("line"), F.col("at"))
    assert parts._jc.toString().count("SQRT") <= 3
    for (line, at), row in zip(lines, df.select(parts.alias("p")).collect()):
        got = [[(round(q["x"], 9), round(q["y"], 9)) for q in p] for p in row["p"]]
        run, want = 0.0, None
        for k, (p, q) in enumerate(itertools.pairwise(line), 1):
            gap = math.dist(p, q)
            if at > 0 and want is None and run + gap >= at:
                mid = tuple(round(a + (b - a) * (at - run) / gap, 9) for a, b in zip(p, q))
                want = [[*line[:k], mid], [mid, *line[k:]] if run + gap > at else line[k:]]
            run += gap
        assert got == (want if want is not None and at < run else [line])
