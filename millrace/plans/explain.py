"""A statement's plan as JSON, without running it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

STAGES = {"parsed": "logical", "analyzed": "analyzed", "optimized": "optimizedPlan", "physical": "executedPlan"}


def plan_tree(df: DataFrame, stage: str = "optimized") -> dict:
    """{op, detail, inputs} of the plan at a stage of STAGES, inputs nested."""
    nodes = iter(json.loads(getattr(df._jdf.queryExecution(), STAGES[stage])().toJSON()))

    def build() -> dict:
        node = next(nodes)
        return {"op": node["class"].rsplit(".", 1)[1], "inputs": [build() for _ in range(node["num-children"])]}

    return build()


def plan_rows(df: DataFrame, stage: str = "optimized") -> list[dict]:
    """The operators in the order they run, each with its id and the ids of its inputs."""
    rows: list[dict] = []

    def add(node: dict) -> int:
        inputs = [add(x) for x in node["inputs"]]
        rows.append({"id": len(rows), "op": node["op"], "inputs": inputs})
        return rows[-1]["id"]

    add(plan_tree(df, stage))
    return rows


def sql_plan(spark: SparkSession, statement: str, stage: str = "optimized") -> str:
    """The plan of a SQL statement as JSON text."""
    return json.dumps({"rels": plan_rows(spark.sql(statement), stage)})
