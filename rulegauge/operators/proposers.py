"""Plug-in point for proposals: a user's function from (measurement, rules in scope) to proposal JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rulegauge.operators import envelope as E
from rulegauge.operators import routing as R


def propose(records: DataFrame, rules: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], *,
            id_col: str = "measurement_id") -> DataFrame:
    """Parsed proposals of ``scorer``, which gets Arrow batches with ``measurement`` (JSON text) and ``rule_ids``
    (ids in force for the record) and returns one proposal text per row."""
    @F.pandas_udf(StringType())
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for measurement, rule_ids in parts:
            yield scorer(pd.DataFrame({"measurement": measurement, "rule_ids": rule_ids}))

    scoped = R.snapshot_rules(records.select(id_col, "ts", "jurisdiction"), rules, id_col=id_col)
    joined = records.select(id_col, F.to_json("measurement").alias("_m")).join(scoped, id_col, "left")
    raw = joined.select(id_col, score(F.col("_m"), F.coalesce("rule_ids", F.array().cast("array<string>"))).alias("raw"))
    return E.parse_proposals(raw)
