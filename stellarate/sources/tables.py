"""Table scans, table sinks and the zone layout of the store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_corrupt_record"


@dataclass(frozen=True)
class Layout:
    """Paths of the five zones under ``root`` (any Hadoop-compatible URI).

    ``prefix`` is what the file names of a data set start with.
    """

    root: str
    prefix: str = ""

    def _path(self, zone: str, name: str) -> str:
        return f"{self.root.rstrip('/')}/{zone}/{name}"

    def landing(self, table: str) -> str:
        return self._path("landing", f"{self.prefix}{table}.json")

    def rejected(self, table: str) -> str:
        return self._path("rejected", f"{self.prefix}{table}.parquet")

    def cleaned(self, table: str) -> str:
        return self._path("cleaned", f"cleaned_{self.prefix}{table}.parquet")

    def bucketed(self, table: str) -> str:
        return self._path("cleaned", f"bucketed_{self.prefix}{table}")

    def trusted(self, table: str) -> str:
        return self._path("trusted", f"{table}.parquet")

    def model(self, name: str) -> str:
        return self._path("models", name)


def read_json(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None
) -> DataFrame:
    """JSON-lines scan; without ``schema`` Spark makes one extra pass to infer it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def whole_schema(
    spark: SparkSession, path: str | list[str], known: T.StructType
) -> T.StructType:
    """Schema of a JSON-lines table with all its columns and nested fields.

    One pass over the files finds what is there. Plain columns named in ``known``
    have their type from there; nested columns and unknown ones are as found.
    """
    found = {f.name: f for f in spark.read.json(path).schema if f.name != BROKEN}
    nested = (T.StructType, T.MapType, T.ArrayType)
    fields = [
        f if not isinstance(f.dataType, nested) else found.get(f.name, f) for f in known.fields
    ]
    named = {f.name for f in fields}
    return T.StructType([*fields, *[f for f in found.values() if f.name not in named]])


def parsed_lines(
    spark: SparkSession, path: str | list[str], schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a JSON-lines table.

    A line that is no JSON object, or has a value that its column's type cannot hold,
    is not turned to nulls: it goes to the rejects as it stands, column ``line``.
    Blank lines are neither.
    """
    checked = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    lines = spark.read.text(path).where("trim(value) != ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    parsed = lines.select("value", F.from_json("value", checked, options).alias("row"))
    broken = F.col("row").isNull() | F.col(f"row.{BROKEN}").isNotNull()
    rows = parsed.where(~broken).select(*[F.col(f"row.`{f.name}`") for f in schema.fields])
    return rows, parsed.where(broken).select(F.col("value").alias("line"))


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return spark.read.parquet(*paths)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def stored(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """``df`` written to ``path`` and read back: later steps start from the files."""
    write_parquet(df, path, mode)
    return read_parquet(df.sparkSession, path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
