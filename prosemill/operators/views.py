"""SQL surface: findings, fixed texts and rules as views of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosemill.operators.check import check
from prosemill.operators.fix import fix
from prosemill.plans.config import Config, rules_table


def register(spark: SparkSession, table: str, config: Config | None = None) -> None:
    """Temporary views over a table (doc_id, text): TABLE_findings, TABLE_fixed and rules."""
    docs: DataFrame = spark.table(table)
    check(docs, config).createOrReplaceTempView(f"{table}_findings")
    fix(docs, config).createOrReplaceTempView(f"{table}_fixed")
    rules_table(spark, config).createOrReplaceTempView("rules")
