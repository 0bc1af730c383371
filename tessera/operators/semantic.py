"""A star-schema semantic layer: cubes of facts, dimensions, hierarchies and measures, executed as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import small

AGGREGATORS = {
    "sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max,
    "distinct-count": F.count_distinct, "median": F.median, "stddev": F.stddev_samp,
}


@dataclass(frozen=True)
class Measure:
    name: str
    expression: str
    aggregator: str = "sum"

    def column(self) -> Column:
        if self.aggregator not in AGGREGATORS:
            raise ValueError(f"no aggregator {self.aggregator!r}")
        return AGGREGATORS[self.aggregator](F.expr(self.expression)).alias(self.name)


@dataclass(frozen=True)
class Relationship:
    """source.column -> target.column. Cardinality 1 (or 1..*) joins inner, 0..1 (or *) keeps unmatched source rows."""

    target: str
    source_column: str
    target_column: str
    cardinality: str = "1"


@dataclass(frozen=True)
class Cube:
    name: str
    fact: str
    relationships: tuple[Relationship, ...]
    measures: tuple[Measure, ...]
    hierarchies: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def measure(self, name: str) -> Measure:
        for m in self.measures:
            if m.name == name:
                return m
        raise KeyError(f"cube {self.name} has no measure {name!r}")

    def joined(self, tables) -> DataFrame:
        """Fact and dimensions along the relationships; a dimension is broadcast if its size allows it."""
        out = getattr(tables, self.fact)
        for r in self.relationships:
            how = "inner" if r.cardinality.startswith("1") else "left"
            out = out.join(small(getattr(tables, r.target)), F.col(r.source_column) == F.col(r.target_column), how)
        return out

    def aggregate(self, tables, group_by: list[str], measures: list[str], where: str | None = None, mode: str = "group") -> DataFrame:
        """Measures by the levels; mode "rollup" or "cube" adds the All members and grouping_id."""
        rows = self.joined(tables)
        rows = rows.where(where) if where else rows
        grouped = {"group": rows.groupBy, "rollup": rows.rollup, "cube": rows.cube}[mode](*group_by)
        more = [F.grouping_id().cast("long").alias("grouping_id")] if mode != "group" else []
        return grouped.agg(*(self.measure(m).column() for m in measures), *more)

    def cellset(self, tables, rows: list[str], columns: str, members: list, measure: str, where: str | None = None) -> DataFrame:
        """Rows on one axis, the given members of another on columns."""
        data = self.joined(tables)
        data = data.where(where) if where else data
        return data.groupBy(*rows).pivot(columns, members).agg(self.measure(measure).column())

    def describe(self, spark) -> DataFrame:
        """Catalog rows (kind, name, detail) of dimensions, measures and relationships."""
        rows = [("measure", m.name, f"{m.aggregator}({m.expression})") for m in self.measures]
        rows += [("relationship", r.target, f"{r.source_column}={r.target_column}") for r in self.relationships]
        rows += [("hierarchy", h, ">".join(levels)) for h, levels in self.hierarchies.items()]
        return spark.createDataFrame(rows, "kind string, name string, detail string")
