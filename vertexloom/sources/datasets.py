"""Named graphs over a folder of the supplied tables, planned when asked for."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vertexloom.graph import Graph
from vertexloom.plans import testgraphs

NAMES = {"users": testgraphs.users, "simple_users": testgraphs.simple_users, "visits": testgraphs.visits, "supply": testgraphs.supply, "tree": testgraphs.tree}

DESCRIPTIONS = {name: f.__doc__.strip().splitlines()[0] for name, f in NAMES.items()}


def load(spark: SparkSession, name: str, sf_dir: str) -> Graph:
    return NAMES[name](spark, sf_dir)
