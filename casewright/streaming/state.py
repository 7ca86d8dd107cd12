"""Canonical names in a stream: the first similar earlier name, held as keyed state.

State is kept for each entity type and block of names (the first character, in any case), in the order of arrival, so a
key's state is the canonical names of one letter and type. Names that differ in their first character never meet here; the
batch form in ``operators/resolve.py`` has no such limit. Needs the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from casewright import config
from casewright.functions.normalise import jaro_winkler

RESOLVED = "entity_type string, name string, canonical_name string, score double, method string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def block(name: Column) -> Column:
    return F.lower(F.substring(name, 1, 1))


class CanonicalNames(StatefulProcessor):
    """Resolves each arriving name against the canonical names of its key; a name that has come before keeps its answer."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.canonical = handle.getListState("canonical", "name string")
        self.answers = handle.getMapState("answers", "name string", "canonical_name string, score double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["seen", "name"], kind="stable")
        held, out = [r[0] for r in self.canonical.get()], []
        new = []
        for name in arrived["name"]:
            before = self.answers.getValue((name,)) if self.answers.containsKey((name,)) else None
            if before is None:
                hit = next(((c, s) for c in held + new if (s := jaro_winkler(name, c)) >= self.threshold), None)
                if hit is None:
                    new.append(name)
                before = hit or (name, 1.0)
                self.answers.updateValue((name,), before)
            out.append((key[0], name, before[0], float(before[1]), "new_entity" if before[0] == name else "jaro_winkler"))
        if new:
            self.canonical.appendList([(n,) for n in new])
        yield pd.DataFrame(out, columns=["entity_type", "name", "canonical_name", "score", "method"])

    def close(self) -> None:
        pass


def resolve_stream(names: DataFrame, threshold: float = config.ALIAS_THRESHOLD) -> DataFrame:
    """One row for each arriving ``entity_type, name, seen``; within a batch in the order of seen."""
    keyed = names.where("name is not null and name != ''").withColumn("block", block(F.col("name")))
    return keyed.groupBy("entity_type", "block").transformWithStateInPandas(CanonicalNames(threshold), RESOLVED, outputMode="Append", timeMode="None")
