"""SQL over a collection: a view for each type and an edge view for each link field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EDGE_TYPES, LIST_TYPES, FieldType
from . import relations


class Sql:
    def __init__(self, owner) -> None:
        self.owner = owner

    def table(self, type_name: str) -> DataFrame:
        """record, then the fields that are no LINK or list[link]; a missing list is empty; of list[mixed] the items as they are, null as ""."""
        ts = self.owner.schema.types[type_name]
        cols = [F.col("_record").alias("record")]
        for f in ts.fields:
            if f.effective_type in EDGE_TYPES:
                continue
            c = F.col(f"`{f.name}`")
            if f.effective_type == FieldType.LIST_MIXED:
                c = F.transform(c, lambda x: F.coalesce(x, F.lit("")))
            cols.append((F.coalesce(c, F.array().cast(f.spark)) if f.effective_type in LIST_TYPES else c).alias(f.name))
        return self.owner.tables[type_name].select(*cols)

    def edges(self, type_name: str, field: str) -> DataFrame:
        return relations.edge_table(self.owner.tables[type_name], self.owner.schema.types[type_name][field])

    def register(self, prefix: str = "") -> list[str]:
        """Make temporary views Type and Type__field; their names."""
        out = []
        for name, ts in self.owner.schema.types.items():
            self.table(name).createOrReplaceTempView(f"`{prefix}{name}`")
            out.append(f"{prefix}{name}")
            for f in ts.links(EDGE_TYPES):
                self.edges(name, f.name).createOrReplaceTempView(f"`{prefix}{name}__{f.name}`")
                out.append(f"{prefix}{name}__{f.name}")
        return out

    def sql(self, query: str) -> DataFrame:
        self.register()
        return self.owner.spark.sql(query)

