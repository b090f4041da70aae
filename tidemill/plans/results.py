"""Results of guarded queries, each computed once: written below the scratch folder and read from there."""

from __future__ import annotations

from dataclasses import dataclass

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.session import new_scratch
from tidemill.sources.paths import filesystem

_PLACE = "_place"


@dataclass
class Stored:
    """One written result: ``frame`` has the query's names and types, repeated names too, and its order if it has one."""

    path: str
    rows: DataFrame
    frame: DataFrame

    def first(self, n: int) -> DataFrame:
        """The first ``n`` rows in the query's order."""
        return self.frame_of(self.rows.orderBy(_PLACE).limit(n))

    def frame_of(self, rows: DataFrame) -> DataFrame:
        return _named(rows, self.frame.schema)


def _named(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns by position, since a result may repeat a name; a column without a type was not written."""
    return rows.select(*[F.lit(None).alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"c{i}").alias(f.name) for i, f in enumerate(schema.fields)])


class ResultStore:
    """The results of one session; they last until it is closed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: set[str] = set()

    def write(self, frame: DataFrame) -> Stored:
        """Run the query, once."""
        path = new_scratch(self.spark, "result")
        schema = frame.schema
        ordered = frame._jdf.queryExecution().optimizedPlan().outputOrdering().nonEmpty()
        kept = [F.col(f"c{i}") for i, f in enumerate(schema.fields) if not isinstance(f.dataType, T.NullType)]
        # Numbers grow from one part of a sorted result to the next.
        numbered = frame.toDF(*[f"c{i}" for i in range(len(schema))]).select(*kept, F.monotonically_increasing_id().alias(_PLACE))
        numbered.write.parquet(path)
        self.paths.add(path)
        rows = self.spark.read.schema(numbered.schema).parquet(path)
        return Stored(path, rows, _named(rows.orderBy(_PLACE) if ordered else rows, schema))

    def holds(self, path: str) -> bool:
        """Whether a file path is a result of this session."""
        plain = lambda p: p.removeprefix("file:").replace("//", "/").rstrip("/")
        return plain(path) in {plain(p) for p in self.paths}

    def clear(self) -> None:
        for path in self.paths:
            files, folder = filesystem(path)
            if files.get_file_info(folder).type == FileType.Directory:
                files.delete_dir(folder)
        self.paths.clear()
