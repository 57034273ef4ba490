"""Views of the queue's tables that show what the session's scope may see.

The scope is a pair of session variables. Two rules permit a row: the service scope sees all, a tenant its own rows. What is unset
permits nothing, so a query that forgets its scope returns no row of any table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["work", "tenant_budgets", "work_cost"]


def set_scope(spark: SparkSession, scope: str | None = None, tenant: str | None = None) -> None:
    """What queries that are made from now on may see; without arguments nothing."""
    for name, value in (("sw_scope", scope), ("sw_tenant", tenant)):
        spark.sql(f"SET VARIABLE {name} = :value", {"value": value or ""})


def open_views(spark: SparkSession, **tables: DataFrame) -> None:
    """Views scoped_work, scoped_tenant_budgets and scoped_work_cost of tables with a column tenant_id, at first without a scope."""
    for name in ("sw_scope", "sw_tenant"):
        spark.sql(f"DECLARE OR REPLACE VARIABLE {name} STRING DEFAULT ''")
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"unknown table: {name}")
        df.createOrReplaceTempView(f"all_{name}")
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW scoped_{name} AS SELECT * FROM all_{name} WHERE session.sw_scope = 'service' OR tenant_id = nullif(session.sw_tenant, '')")
