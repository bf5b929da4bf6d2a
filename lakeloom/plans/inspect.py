"""Looking at plans: what is scanned, pushed down, shuffled and broadcast."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Plan:
    text: str
    exchanges: int = 0
    broadcasts: int = 0
    python_nodes: int = 0
    pushed: list[str] = field(default_factory=list)
    read_columns: list[list[str]] = field(default_factory=list)


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def inspect(df: DataFrame) -> Plan:
    text = explain(df)
    tree = text.split("\n\n", 1)[0]
    p = Plan(text)
    p.broadcasts = len(re.findall(r"BroadcastExchange", tree))
    p.exchanges = len(re.findall(r"(?<!Broadcast)Exchange", tree))
    p.python_nodes = len(re.findall(r"BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow|FlatMapGroups", tree))
    p.pushed = [x for m in re.findall(r"PushedFilters: \[(.*?)\]\n", text) for x in [m] if x]
    p.read_columns = [re.findall(r"(\w+):", m) for m in re.findall(r"ReadSchema: struct<(.*?)>\n", text)]
    return p
