"""Parameterised SQL on registered views."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame, SparkSession

_NAMES = Lock()


def run_sql(
    spark: SparkSession, text: str, params: dict | list | None = None, views: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Run SQL with bound parameters (``:name`` or ``?``).

    The result's columns, rows and count are those of the DataFrame, taken when
    the caller asks for them. ``views`` exist only while the text is analysed,
    one call at a time; a view that was there before is put back.
    """
    with _NAMES:
        there = {t.name for t in spark.catalog.listTables() if t.isTemporary} if views else set()
        kept = {name: spark.table(name) for name in views or {} if name in there}
        for name, frame in (views or {}).items():
            frame.createOrReplaceTempView(name)
        try:
            return spark.sql(text, args=params)
        finally:
            for name in views or {}:
                spark.catalog.dropTempView(name)
                if name in kept:
                    kept[name].createOrReplaceTempView(name)
