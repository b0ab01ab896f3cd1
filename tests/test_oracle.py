"""Registered queries against their SQL on the smallest tables; a choice that runs in a few minutes."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from vertexloom.plans import registry

DATA = "/root/testdata/sf0.001"
QUICK = ["degree_out", "degree_weighted_total", "edge_endpoint_source", "incident_sum", "infect_property", "find_edge_range", "graph_view", "reversed_graph", "perfect_prop_hash", "vertex_hist", "vertex_hist_irregular", "edge_average", "label_parallel_edges", "label_self_loops", "assortativity", "scalar_assortativity", "corr_hist", "avg_neighbour_corr", "local_clustering", "global_clustering", "motifs3", "adjacency", "norm_laplacian", "incidence", "transition", "pagerank10", "katz10", "weighted_distance", "weak_components", "strong_components", "line_graph", "condensation_edges", "lattice", "complete_graph", "geometric_graph", "modularity", "block_entropy", "similarity", "bfs_search", "kcore", "min_spanning_tree", "pseudo_diameter", "betweenness", "edge_betweenness", "motifs4", "trust_transitivity", "greedy_matching", "shortest_path", "topological_sort", "dominator_tree", "articulation_points", "min_cut", "isomorphism", "strong_components_rounds", "prop_to_size", "closed_forms", "file_gt", "file_graphml", "file_gml", "file_dot", "reverse_map", "random_simple_graph"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(x):
    if pd.isna(x):
        return None
    return x.item() if hasattr(x, "item") else x


def rows(df):
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, db, name):
    assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(db.execute(registry.oracle_sql()[name]).df())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
