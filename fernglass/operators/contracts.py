"""Record contracts: one normalised view over records of several types."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import value_of
from ..records import Records, path_of_field
from .jsonschema import Compiler


@dataclass(frozen=True)
class Contract:
    """``schema`` describes the view; ``implementations``: type -> {view field: record field}."""

    name: str
    schema: dict = field(default_factory=dict)
    implementations: dict = field(default_factory=dict)

    @property
    def fields(self) -> list[str]:
        return list(self.schema.get("properties", {})) or sorted({k for m in self.implementations.values() for k in m})


def view_of(records: Records, contract: Contract, type_name: str) -> DataFrame:
    """(path, type, view columns) of the records of one implementing type; a field not mapped is NULL."""
    mapping, kind = contract.implementations[type_name], records.type_of("fields")
    cols = []
    for name in contract.fields:
        v = path_of_field(F.col("fields"), kind, mapping[name]) if name in mapping else None
        cols.append((v.col if v is not None else F.lit(None).cast("string")).alias(name))
    mine = records.df.where(F.array_contains("types", type_name.lower()))
    return mine.select("path", F.lit(type_name.lower()).alias("type"), *cols)


def contract_view(parts: list[tuple[Records, str]] | Records, contract: Contract) -> DataFrame:
    """The union of all implementing types' views, by column name."""
    if isinstance(parts, Records):
        parts = [(parts, t) for t in contract.implementations]
    return reduce(lambda a, b: a.unionByName(b), [view_of(r, contract, t) for r, t in parts])


def contract_issues(view: DataFrame, contract: Contract) -> DataFrame:
    """(path, code, field, severity, message) of view rows that violate the contract's schema."""
    shape = F.struct(*[F.col(f"`{n}`") for n in contract.fields])
    compiler = Compiler(contract.schema)
    with_view = view.select("path", shape.alias("__v"))
    v = value_of(F.col("__v"), with_view.schema["__v"].dataType)
    found = compiler.collected(compiler.issues(contract.schema, v, ""))
    out = with_view.select("path", F.explode(found).alias("i"))
    return out.select("path", F.lit("data_contract_record_invalid").alias("code"), "i.field", "i.severity", "i.message")


__all__ = ["Contract", "contract_issues", "contract_view", "view_of"]
