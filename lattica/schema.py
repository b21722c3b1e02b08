"""Explicit schemas: the nested graph document, and the normalised snapshot tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

SYMBOL = "struct<kind: string, name: string, sig: string>"
INVARIANT = "struct<name: string, file: string, hash: string, guards: array<string>, exercises: array<string>>"
PACKAGE = f"struct<path: string, name: string, internal: boolean, hole: boolean, files: array<string>, surface: array<{SYMBOL}>, schema: array<{SYMBOL}>, invariants: array<{INVARIANT}>, allow: array<string>>"
EDGE = "struct<`from`: string, `to`: string, kind: string, witnesses: array<string>>"
GRAPH = f"module string, commit string, packages array<{PACKAGE}>, edges array<{EDGE}>, localImplements array<{EDGE}>"

DEP_KINDS = ("import", "call")
#: Column lists of the normalised tables; each begins with snapshot_id.
TABLES = {
    "snapshot": "snapshot_id string, module string, commit string",
    "package": "snapshot_id string, path string, name string, internal boolean, hole boolean, pos int",
    "file": "snapshot_id string, path string, file string",
    "symbol": "snapshot_id string, path string, axis string, kind string, name string, sig string, pos int",
    "invariant": "snapshot_id string, path string, name string, file string, hash string, pos int",
    "guard": "snapshot_id string, path string, name string, iface string",
    "exercise": "snapshot_id string, path string, name string, concrete string",
    "allow": "snapshot_id string, path string, target string",
    "edge": "snapshot_id string, src string, kind string, dst string, scope string, pos int",
    "witness": "snapshot_id string, src string, kind string, dst string, scope string, witness string",
}


@dataclass
class Snapshots:
    """Any number of graphs as tables keyed by ``snapshot_id``."""

    snapshot: DataFrame
    package: DataFrame
    file: DataFrame
    symbol: DataFrame
    invariant: DataFrame
    guard: DataFrame
    exercise: DataFrame
    allow: DataFrame
    edge: DataFrame
    witness: DataFrame

    @classmethod
    def of(cls, spark, **tables) -> Snapshots:
        """Tables that are not given are empty."""
        return cls(**{f.name: tables[f.name] if f.name in tables else spark.createDataFrame([], TABLES[f.name]) for f in fields(cls)})

    def write(self, at: str, again: bool = False) -> None:
        """A Parquet store, partitioned by snapshot.  Snapshots that the store has are left as they are, or written
        anew if ``again``: writing twice never doubles a snapshot."""
        tables = {f.name: getattr(self, f.name) for f in fields(self)}
        held = None if again else stored(self.snapshot.sparkSession, at)
        if held is not None:
            tables = {k: t.join(held, "snapshot_id", "left_anti").select(*t.columns) for k, t in tables.items()}
        # The table of snapshots comes last: what it names is whole, even if a write before it broke off.
        for name in sorted(tables, key="snapshot".__eq__):
            tables[name].write.partitionBy("snapshot_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{at}/{name}")

    @classmethod
    def read(cls, spark, at: str) -> Snapshots:
        return cls(**{f.name: spark.read.schema(TABLES[f.name]).parquet(f"{at}/{f.name}") for f in fields(cls)})


def stored(spark, at: str) -> DataFrame | None:
    """(snapshot_id) of the snapshots that a store has; None if there is no store."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(TABLES["snapshot"]).parquet(f"{at}/snapshot").select("snapshot_id").distinct()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
