"""Destination graph statistics. Pass training rows only: later rows would leak into the statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.functions.numeric import exact
from riskmill.lineage import cut_lineage


def destination_degrees(edges: DataFrame) -> DataFrame:
    """Distinct senders, transactions and total amount per destination; distinct pairs are combined before counting."""
    return edges.groupBy("nameDest").agg(
        F.count_distinct("nameOrig").alias("dest_degree"), F.count("*").alias("n_transactions"),
        F.sum(exact("amount")).cast("double").alias("dest_weighted_degree"))


def connected_components(pairs: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for an undirected graph given as pairs; the component is its smallest node.

    Alternating star contraction: first every node's larger neighbours, then its smaller ones, are attached to its
    smallest neighbour, which takes about log(n) rounds. Each round is written to the checkpoint folder. A hub
    reduces map-side to one minimum, and its edges meet that single row in a join that adaptive execution can split.
    """
    start = pairs.select(F.col(left).alias("u"), F.col(right).alias("v"))
    nodes = start.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    edges = cut_lineage(start.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        edges = cut_lineage(_attach_smaller(_attach_larger(edges)))
        state = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(edges, F.col("node") == F.col("u"), "left").select(
        "node", F.coalesce("v", "node").alias("component"))


def grown_components(labels: DataFrame, pairs: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) after new pairs, from the labels before them: the same as a full run over all pairs.

    New pairs are contracted onto stored labels, so the rounds work on components that the new pairs touch, however
    many pairs the labels came from. Nodes without a label are their own component.
    """
    def label(frame: DataFrame, node: str, name: str) -> DataFrame:
        known = labels.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        return frame.join(known, F.col(node) == F.col("_node"), "left") \
            .withColumn(name, F.coalesce("_component", node)).drop("_node", "_component")
    contracted = cut_lineage(label(label(pairs.select(F.col(left).alias("u"), F.col(right).alias("v")).distinct(), "u", "a"), "v", "b"))
    moved = cut_lineage(connected_components(contracted, "a", "b", max_rounds)
                        .select(F.col("node").alias("_from"), F.col("component").alias("_to")))
    fresh = contracted.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(labels, "node", "left_anti") \
        .select("node", F.col("node").alias("component"))
    return labels.select("node", "component").unionByName(fresh).join(moved, F.col("component") == F.col("_from"), "left") \
        .select("node", F.coalesce("_to", "component").alias("component"))


def _attach_larger(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
        .where("u <> v").distinct()


def _attach_smaller(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.select("u", F.col("m").alias("v"))) \
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def component_statistics(edges: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Per destination: size and fraud rate of its component, and how many other destinations in it are flagged.

    ``flagged`` holds the destinations (nameDest) already flagged; by default those with a labelled row.
    """
    sides = edges.select(F.concat(F.lit("o:"), "nameOrig").alias("o"), F.concat(F.lit("d:"), "nameDest").alias("d"))
    found = connected_components(sides.distinct(), "o", "d")
    members = found.where(F.col("node").startswith("d:")).select(F.expr("substring(node, 3)").alias("nameDest"), "component")
    per_dest = edges.groupBy("nameDest").agg(F.count("*").alias("n"), F.sum("isFraud").cast("bigint").alias("fraud"))
    marks = per_dest.where("fraud > 0").select("nameDest") if flagged is None else flagged.select("nameDest").distinct()
    known = members.join(per_dest, "nameDest").join(marks.withColumn("mark", F.lit(1)), "nameDest", "left") \
        .withColumn("mark", F.coalesce("mark", F.lit(0)))
    sizes = found.groupBy("component").agg(F.count("*").alias("dest_component_size"))
    rates = known.groupBy("component").agg(
        (F.sum("fraud") / F.sum("n")).alias("dest_component_fraud_rate"), F.sum("mark").alias("marks"))
    return known.join(rates, "component").join(sizes, "component").select(
        "nameDest", "dest_component_size", (F.col("marks") - F.col("mark")).alias("dest_flagged_neighbours"),
        "dest_component_fraud_rate")
