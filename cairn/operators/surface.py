"""The extension surface: map-reduce operators, extractors, options; and scores over section tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MapReduce:
    """An operator of two DataFrame functions; the reducer's aggregation runs partly in the mapper's tasks."""

    mapper: Callable[[DataFrame], DataFrame]
    reducer: Callable[[DataFrame], DataFrame]

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.reducer(self.mapper(df))


@dataclass(frozen=True)
class SetAnalyzer:
    """An operator of a set of ids and options; its result is a DataFrame, which nothing stores."""

    analyze: Callable[[DataFrame, dict[str, Any]], DataFrame]
    declared: dict[str, tuple[str, bool, Any]]

    def __call__(self, ids: DataFrame, given: dict[str, Any] | None = None) -> DataFrame:
        return self.analyze(ids.select("oid").distinct(), options(self.declared, given or {}))


def extractor(objects: DataFrame, process: Callable[[bytes], dict[str, Any]], schema: str) -> DataFrame:
    """(oid, fields): process of every object's content, in batches; an object for which it gives None has no row."""
    fields = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(oid, *[found[f] for f in fields]) for oid, data in zip(batch["oid"], batch["data"], strict=True) if (found := process(data)) is not None]
            yield pd.DataFrame(rows, columns=["oid", *fields])

    return objects.select("oid", "data").mapInPandas(run, f"oid string, {schema}")


CASTS: dict[str, Callable[[Any], Any]] = {"long": int, "double": float, "string": str, "boolean": lambda v: v if isinstance(v, bool) else str(v).lower() == "true"}


def options(declared: dict[str, tuple[str, bool, Any]], given: dict[str, Any]) -> dict[str, Any]:
    """Given options by declarations (type, part of the result's key, default): coerced and filled; None as default means required."""
    unknown = given.keys() - declared.keys()
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    out = {}
    for name, (kind, _, default) in declared.items():
        value = given.get(name, default)
        if value is None:
            raise ValueError(f"option {name} is missing")
        out[name] = CASTS[kind](value)
    return out


def packer_score(shape: DataFrame) -> DataFrame:
    """score and likely from (imports, sections, rwx): few imports and an odd number of executable sections count one each, a writable executable one five."""
    score = F.when(F.col("imports") < 10, 1).otherwise(0) + F.when(F.col("sections") != 1, 1).otherwise(0) + F.when(F.col("rwx"), 5).otherwise(0)
    return shape.withColumn("score", score.cast("int")).withColumn("likely", F.col("score") > 6)


def rva_to_offset(df: DataFrame, virtual: Column, raw: Column) -> DataFrame:
    """File offset of a relative address: from its section's virtual start to the section's data."""
    return df.withColumn("file_offset", F.col("rva") - virtual + raw)
