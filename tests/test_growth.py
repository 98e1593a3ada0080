"""Operators on inputs that repeat much: what grows with pairs does not end in these times, and what is small in a file is dealt to all cores."""

import time

from pyspark.sql import functions as F

from eventloom.functions import titles as T
from eventloom.operators import joins as J
from eventloom.plans import cases


def test_nearest_places_of_one_spot(spark):
    at = lambda name: spark.range(30_000).select(F.col("id").alias(name), (F.floor(F.col("id") / 1e9) + 35.0).alias("lat"), (F.floor(F.col("id") / 1e9) + 139.0).alias("lon"))
    began = time.time()
    got = J.nearest(at("c"), at("s"), 5000, 3, "c", "s")
    assert "Broadcast" not in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in got.groupBy("s", "metres", "rk").count().orderBy("rk").collect()] == [(0, 0, 1, 30_000), (1, 0, 2, 30_000), (2, 0, 3, 30_000)]
    assert time.time() - began < 60  # 900 million pairs take minutes


def test_house_numbers_of_seven_digits_are_no_postal_code(spark):
    said = {"〒123-4567 東京都　港区1000002": "東京都 港区1000002", "1234567 港区": "港区", "港区 123-4567": "港区", "〒 1234567港区1-2": "港区1-2", "港区12345678": "港区12345678"}
    rows = spark.createDataFrame([(k,) for k in said], "c string").select("c", T.plain_address(F.col("c")).alias("p"))
    assert {r["c"]: r["p"] for r in rows.collect()} == said


def test_texts_of_parts_are_dealt_to_all_cores(spark):
    got = cases.QUERIES["day_lists"](spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
