"""Sizes of the plans that the driver keeps: it plans a query anew after each stage, so large plans cost it memory many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from shelfloom.llm import mixing, near_dedup

SF = "/root/testdata/sf0.001"


def plan_nodes(spark, run: Callable[[], DataFrame]) -> list[int]:
    """Nodes of the plan of each query that run and collecting its result take."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    listed = store.executionsList()
    last = max((listed.apply(k).executionId() for k in range(listed.size())), default=-1)
    run().collect()
    bus.waitUntilEmpty(30_000)
    listed = store.executionsList()
    ids = [i for i in (listed.apply(k).executionId() for k in range(listed.size())) if i > last]
    return [store.planGraph(i).allNodes().size() for i in ids]


def test_components_plans(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)], "a long, b long")
    nodes = plan_nodes(spark, lambda: near_dedup.connected_components(edges))
    assert nodes and max(nodes) <= 40


def test_near_dedup_plans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nodes = plan_nodes(spark, lambda: near_dedup.drop_near_copies(docs))
    assert nodes and max(nodes) <= 60


def test_mixing_plans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nodes = plan_nodes(spark, lambda: mixing.repeat_taken(docs))
    assert nodes and max(nodes) <= 80
