"""Small literal tables, for Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _sql(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return f"CAST({value} AS {kind})"
    if isinstance(value, (list, tuple)):
        return f"CAST([{', '.join(_sql(x, 'VARCHAR') for x in value)}] AS {kind})"
    plain = "".join(c if 32 <= ord(c) < 127 else f"' || chr({ord(c)}) || '" for c in value.replace("'", "''"))
    return f"('{plain}')"


class Literal:
    """Rows with Spark types (long, string, boolean, array<string>), usable on either side."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows

    def spark(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        names, kinds = zip(*(x.strip().split(" ", 1) for x in self.schema.split(", ")), strict=True)
        kinds = [{"long": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "double": "DOUBLE"}[k] for k in kinds]
        rows = ", ".join("(" + ", ".join(_sql(v, k) for v, k in zip(r, kinds, strict=True)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {rows}) AS t({', '.join(names)}))"
