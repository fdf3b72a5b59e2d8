"""The catalogue's vocabulary: field types, schemas of types, and how they map to Spark."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import types as T


class FieldType(StrEnum):
    STRING = "string"
    INTEGER = "integer"
    NUMBER = "number"
    BOOLEAN = "boolean"
    DATE = "date"
    DATETIME = "datetime"
    LINK = "link"
    LIST_STRINGS = "list[string]"
    LIST_INTEGERS = "list[integer]"
    LIST_NUMBERS = "list[number]"
    LIST_LINKS = "list[link]"
    LIST_MIXED = "list[mixed]"
    UNKNOWN = "unknown"
    FORMULA = "formula"


F = FieldType

#: Groups that decide how links are treated: wherever links may occur; as lists of them; in edge tables and pairs.
LINK_TYPES = (F.LINK, F.LIST_LINKS, F.LIST_MIXED)
LINK_LIST_TYPES = (F.LIST_LINKS, F.LIST_MIXED)
EDGE_TYPES = (F.LINK, F.LIST_LINKS)
LIST_TYPES = (F.LIST_STRINGS, F.LIST_INTEGERS, F.LIST_NUMBERS, F.LIST_LINKS, F.LIST_MIXED)

SPARK = {
    F.INTEGER: "bigint",
    F.NUMBER: "double",
    F.BOOLEAN: "boolean",
    F.DATE: "date",
    F.DATETIME: "timestamp_ntz",
    F.LIST_STRINGS: "array<string>",
    F.LIST_INTEGERS: "array<bigint>",
    F.LIST_NUMBERS: "array<double>",
    F.LIST_LINKS: "array<string>",
    F.LIST_MIXED: "array<string>",
}

#: The place of a field's type in a full table; fields of one place go by name, full_text comes last.
SLOT = {F.STRING: 1, F.BOOLEAN: 2, F.INTEGER: 3, F.NUMBER: 3, F.DATE: 4, F.DATETIME: 4, F.LIST_STRINGS: 5, F.LIST_INTEGERS: 5, F.LIST_NUMBERS: 5, F.LINK: 6, F.LIST_LINKS: 7, F.LIST_MIXED: 7}


@dataclass(frozen=True)
class FieldSchema:
    name: str
    type: FieldType
    link_target: str | None = None
    formula: str | None = None
    output_type: FieldType | None = None

    @property
    def effective_type(self) -> FieldType:
        """The type of the field's values: a formula's is that of its results."""
        return (self.output_type or F.UNKNOWN) if self.type == F.FORMULA else self.type

    @property
    def spark(self) -> str:
        return SPARK.get(self.effective_type, "string")


@dataclass
class TypeSchema:
    name: str
    fields: list[FieldSchema] = field(default_factory=list)
    base_filter: object = None
    display: dict[str, str] = field(default_factory=dict)

    def __getitem__(self, name: str) -> FieldSchema:
        return next(f for f in self.fields if f.name == name)

    def __contains__(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def links(self, kinds=LINK_TYPES) -> list[FieldSchema]:
        return [f for f in self.fields if f.effective_type in kinds]

    def put(self, new: FieldSchema) -> None:
        """Add a field, or replace the one of its name."""
        for i, f in enumerate(self.fields):
            if f.name == new.name:
                self.fields[i] = new
                return
        self.fields.append(new)


@dataclass
class Schema:
    types: dict[str, TypeSchema] = field(default_factory=dict)

    def diff(self, other: Schema) -> dict:
        """What other has that this hasn't, and the reverse: types, fields of common types, fields of another type or target."""
        out: dict = {"added_types": sorted(other.types.keys() - self.types.keys()), "removed_types": sorted(self.types.keys() - other.types.keys()), "types": {}}
        for name in sorted(self.types.keys() & other.types.keys()):
            old, new = ({f.name: (f.effective_type, f.link_target) for f in s.types[name].fields} for s in (self, other))
            entry = {
                "added": sorted(new.keys() - old.keys()),
                "removed": sorted(old.keys() - new.keys()),
                "changed": {k: (old[k], new[k]) for k in sorted(old.keys() & new.keys()) if old[k] != new[k]},
            }
            if any(entry.values()):
                out["types"][name] = entry
        return out

    def rows(self) -> list[tuple]:
        return [(t.name, i, f.name, f.type.value, f.link_target, f.formula, f.effective_type.value) for t in self.types.values() for i, f in enumerate(t.fields)]


SCHEMA_ROWS = "type string, pos int, field string, field_type string, link_target string, formula string, output_type string"


def from_spark(data_type: T.DataType) -> FieldType:
    """The field type of an existing column; links are declared or inferred, a map or struct is unknown."""
    if isinstance(data_type, T.BooleanType):
        return F.BOOLEAN
    if isinstance(data_type, T.IntegralType):
        return F.INTEGER
    if isinstance(data_type, T.FractionalType):
        return F.NUMBER
    if isinstance(data_type, T.DateType):
        return F.DATE
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.DATETIME
    if isinstance(data_type, T.StringType):
        return F.STRING
    if isinstance(data_type, T.ArrayType):
        item = from_spark(data_type.elementType)
        return {F.INTEGER: F.LIST_INTEGERS, F.NUMBER: F.LIST_NUMBERS}.get(item, F.LIST_STRINGS)
    return F.UNKNOWN
