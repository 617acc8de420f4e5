"""Tables of a database over JDBC: reads with predicates pushed down, inserts, and the schemas themselves.

Spark's own JDBC source does the work. Filters, columns, limits and aggregates
that it can say in SQL reach the database (``explain`` shows PushedFilters).
Large tables are read in parallel by ranges of a numeric column. Geometries are
stored as EWKB (``functions.wkb``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _options(url: str, properties: dict | None) -> dict:
    return {"url": url, **(properties or {})}


def table(spark: SparkSession, url: str, name: str, properties: dict | None = None, split: tuple[str, int, int, int] | None = None) -> DataFrame:
    """Rows of a table; ``split`` (column, least, greatest, partitions) reads ranges of a numeric column side by side."""
    read = spark.read.format("jdbc").options(dbtable=name, **_options(url, properties))
    if split:
        column, low, high, n = split
        read = read.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n)
    return read.load()


def insert(rows: DataFrame, url: str, name: str, properties: dict | None = None, batch: int = 1000) -> None:
    """Append rows, by columns of the same names; columns of the table that are left out get their default (a generated key)."""
    rows.write.format("jdbc").options(dbtable=name, batchsize=batch, **_options(url, properties)).mode("append").save()


def execute(spark: SparkSession, url: str, *statements: str, properties: dict | None = None) -> list[int]:
    """Run statements that give no rows, in one transaction, on the driver; the counts of changed rows."""
    jvm, keys = spark._jvm, spark._jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        if k == "driver":
            jvm.java.lang.Class.forName(v, True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        else:
            keys.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, keys)
    try:
        connection.setAutoCommit(False)
        counts = []
        for text in statements:
            with_statement = connection.createStatement()
            counts.append(with_statement.executeUpdate(text))
            with_statement.close()
        connection.commit()
        return counts
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def create_table(spark: SparkSession, url: str, name: str, columns: dict[str, str], properties: dict | None = None) -> None:
    """Create a table of the given columns and SQL types."""
    execute(spark, url, f"CREATE TABLE {name} ({', '.join(f'{c} {t}' for c, t in columns.items())})", properties=properties)


def drop_table(spark: SparkSession, url: str, name: str, properties: dict | None = None) -> None:
    execute(spark, url, f"DROP TABLE {name}", properties=properties)
