"""Integrity of a whole model in one pass over each table.

A model declares tables, keys, references, required columns and a text limit.
Every row is turned into the facts that its constraints need (its key, its
references, its missing or over-long values); facts are counted by value with
partial counts before the shuffle, so a channel that a third of all visits name
crosses as one row per task.  Keys and references to them then meet in one
grouping by (referenced column, value), which is the anti-join of all
references at once.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ledgerlake.operators.integrity import CUSTOMER_MODEL, FOREIGN_KEYS, PRIMARY_KEYS, TEXT_LIMIT, apply_schema

FACT = "struct<kind:string,column_name:string,target:string,value:string>"


@dataclass(frozen=True)
class Model:
    """Declared constraints: schemas (``nullable=False``: required), primary keys of single columns, references."""
    schemas: Mapping[str, StructType]
    keys: Mapping[str, list[str]] = field(default_factory=dict)
    references: Mapping[str, list[tuple[str, str, str]]] = field(default_factory=dict)
    text_limit: int = TEXT_LIMIT

    def __post_init__(self) -> None:
        for table, refs in self.references.items():
            for column, parent, parent_column in refs:
                if column not in self.schemas[table].names:
                    raise ValueError(f"{table} has no column {column}")
                if self.keys.get(parent) != [parent_column]:
                    raise ValueError(f"{table}.{column} refers to {parent}.{parent_column}, which is not its key")
        for table, columns in self.keys.items():
            if len(columns) != 1 or columns[0] not in self.schemas[table].names:
                raise ValueError(f"the key of {table} must be one of its columns")


CUSTOMERS = Model(CUSTOMER_MODEL, PRIMARY_KEYS, FOREIGN_KEYS)


def _fact(kind: str, column: str, target: str | None, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(column).alias("column_name"),
                    F.lit(target).cast("string").alias("target"), value.cast("string").alias("value")).cast(FACT)


def facts(df: DataFrame, table: str, model: Model) -> DataFrame:
    """(table_name, kind, column_name, target, value, rows): what the constraints of one table ask of its rows."""
    schema, none = model.schemas[table], F.lit(None)
    typed = apply_schema(df, schema)
    wanted = []
    for column in model.keys.get(table, []):
        wanted.append(_fact("key", column, f"{table}.{column}", F.col(column)))
    for column, parent, parent_column in model.references.get(table, []):
        wanted.append(F.when(F.col(column).isNotNull(),
                             _fact("reference", column, f"{parent}.{parent_column}", F.col(column))))
    for f in schema.fields:
        if not f.nullable and f.name not in model.keys.get(table, []):      # a key's NULLs show as its value
            wanted.append(F.when(F.col(f.name).isNull(), _fact("not null", f.name, None, none)))
        if isinstance(f.dataType, StringType):
            wanted.append(F.when(F.length(f.name) > model.text_limit, _fact("length", f.name, None, none)))
    return (typed.select(F.explode(F.array_compact(F.array(*wanted))).alias("f")).select("f.*")
            .groupBy("kind", "column_name", "target", "value").agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(table).alias("table_name"), "*"))


def check_model(tables: Mapping[str, DataFrame], model: Model = CUSTOMERS) -> DataFrame:
    """(table_name, constraint, column_name, value, rows) of every violation; an empty result is a valid model.

    ``primary key``: values that come more than once, and NULL; ``foreign key``: values without a parent row;
    ``not null`` and ``length``: counts of offending rows (no value).
    """
    missing = set(model.schemas) - set(tables)
    if missing:
        raise ValueError(f"tables missing: {sorted(missing)}")
    every = reduce(DataFrame.unionByName, [facts(tables[t], t, model) for t in model.schemas])
    here = F.struct("kind", "table_name", "column_name", "rows")
    # For a value of a referenced column: its key and the columns that refer to it (a handful); facts without a
    # target, one for each column, are groups of their own.
    met = every.groupBy("target", "value", F.when(F.col("target").isNull(), F.concat_ws(".", "table_name", "column_name"))
                        .alias("own"), F.when(F.col("target").isNull(), F.col("kind")).alias("own_kind")).agg(
        F.collect_list(here).alias("found"), F.bool_or(F.col("kind") == "key").alias("has_key"))
    each = met.select("value", "has_key", F.explode("found").alias("f")).select("value", "has_key", "f.*")
    kind = F.col("kind")
    broken = (((kind == "key") & ((F.col("rows") > 1) | F.col("value").isNull()))
              | ((kind == "reference") & ~F.col("has_key")) | kind.isin("not null", "length"))
    label = F.when(kind == "key", "primary key").when(kind == "reference", "foreign key").otherwise(kind)
    return each.where(broken).select("table_name", label.alias("constraint"), "column_name", "value", "rows")
