"""Analytics as jobs over files: python -m quiltgraph.jobs NAME INPUT OUTPUT [options], or by spark-submit.

INPUT is a graph in one of the formats of ``sources.readers``; OUTPUT is a new folder of tab-separated lines.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from quiltgraph.operators import analytics
from quiltgraph.operators.graph import UNDECLARED, Graph
from quiltgraph.operators.subgraphs import form_subgraphs
from quiltgraph.plans.storage import clean_up
from quiltgraph.sources import writers
from quiltgraph.sources.readers import FORMATS, MODES, read_graph

Job = Callable[[Graph, argparse.Namespace], DataFrame]

JOBS: dict[str, Job] = {
    "vertex_count": lambda g, _: analytics.vertex_count(g),
    "edge_list": lambda g, _: analytics.edge_list(g),
    "degrees": lambda g, _: analytics.degrees(g),
    "subgraphs": lambda g, _: writers.subgraph_lines(form_subgraphs(g)).orderBy("subgraph_id", "kind", "at").select("value"),
    "meta_graph": lambda g, _: analytics.meta_graph(form_subgraphs(g)),
    "graph_stats": lambda g, _: analytics.graph_stats(form_subgraphs(g)),
    "connected_components": lambda g, _: analytics.connected_components(form_subgraphs(g)),
    "label_propagation": lambda g, a: analytics.label_propagation(form_subgraphs(g), a.direction),
    "shortest_paths": lambda g, a: analytics.shortest_paths(g, a.source),
    "pagerank": lambda g, a: analytics.pagerank(g, a.iterations, a.mode),
    "triangle_count": lambda g, _: analytics.triangle_total(g),
    "triangles_by_subgraph": lambda g, _: analytics.triangles_by_subgraph(form_subgraphs(g)),
}


def arguments(given: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quiltgraph.jobs", description=__doc__)
    parser.add_argument("name", choices=sorted(JOBS))
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--format", choices=FORMATS, default="adj")
    parser.add_argument("--malformed", choices=MODES, default=MODES[0])
    parser.add_argument("--undeclared", choices=UNDECLARED, default=UNDECLARED[0])
    parser.add_argument("--partitions", type=int, default=1, help="of an edge list")
    parser.add_argument("--no-split", action="store_true", help="a file's lines are parsed by one task")
    parser.add_argument("--source", type=int, help="of shortest_paths")
    parser.add_argument("--iterations", type=int, default=analytics.UPDATES, help="of pagerank")
    parser.add_argument("--mode", choices=("sync", "partition_lag"), default="sync", help="of pagerank")
    parser.add_argument("--direction", choices=("out", "both"), default="out", help="of label_propagation")
    args = parser.parse_args(given)
    if args.name == "shortest_paths" and args.source is None:
        parser.error("shortest_paths needs --source")
    return args


def main(given: Sequence[str] | None = None) -> None:
    args = arguments(given)
    spark = SparkSession.builder.appName(f"quiltgraph {args.name}").getOrCreate()
    g = read_graph(spark, args.input, args.format, args.malformed, args.undeclared, args.partitions, not args.no_split)
    writers.write_rows(JOBS[args.name](g, args), args.output)
    clean_up(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
