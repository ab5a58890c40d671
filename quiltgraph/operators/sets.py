"""Disjoint sets as a table of elements and their set's smallest element."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.operators.components import contract
from quiltgraph.plans.storage import materialise


@dataclass
class DisjointSets:
    """labels(element, root)."""

    labels: DataFrame

    @staticmethod
    def of(elements: DataFrame) -> DisjointSets:
        """Each distinct element of the column ``element`` as a set of its own."""
        return DisjointSets(elements.select("element").where("element is not null").distinct().select("element", F.col("element").alias("root")))

    def union(self, pairs: DataFrame) -> DisjointSets:
        """Merges the sets of the elements x and y of each row of pairs; an element without a set is an error."""
        known = self.labels.select("element", "root")
        x = pairs.join(known.select(F.col("element").alias("x"), F.col("root").alias("u")), "x", "left")
        both = materialise(x.join(known.select(F.col("element").alias("y"), F.col("root").alias("v")), "y", "left"), "pairs")
        if not both.where("u is null or v is null").isEmpty():
            raise ValueError("an element of the pairs is in no set")
        moved = contract(both.select("u", "v")).select(F.col("u").alias("root"), F.col("v").alias("new"))
        joined = known.join(moved, "root", "left").select("element", F.coalesce("new", "root").alias("root"))
        return DisjointSets(materialise(joined, "sets"))

    def find(self, elements: DataFrame) -> DataFrame:
        """(element, root) of the given elements."""
        return elements.select("element").join(self.labels, "element")

    def members(self, element) -> DataFrame:
        """The elements of one element's set; an element without a set is an error."""
        roots = self.labels.where(F.col("element") == element).select("root")
        if roots.isEmpty():
            raise ValueError(f"{element} is in no set")
        return self.labels.join(roots, "root", "left_semi").select("element")

    def sets(self) -> DataFrame:
        """(root, elements, n): all sets. A set's elements meet in one row."""
        return self.labels.groupBy("root").agg(F.sort_array(F.collect_list("element")).alias("elements"), F.count(F.lit(1)).alias("n"))

    def count(self) -> DataFrame:
        return self.labels.agg(F.count_distinct("root").alias("n_sets"))
