"""Tables and the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and
    the master is local (tests)."""
    set_to = spark.conf.get("spark.checkpoint.dir", "") or ""
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on any file system; at the end of the driver, only if its session is still there."""
    if spark.sparkContext._jsc is None:
        if path.startswith("file://"):
            shutil.rmtree(path[7:], ignore_errors=True)
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """Written tables of one query: keep() cuts the lineage, so that a lost executor costs only the stage it
    was in; drop() deletes tables that nothing reads any more, only() all but those that still are."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(_delete, spark, self.root)
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, by: str | None = None, buckets: int = 0) -> DataFrame:
        """With by, a column of whole numbers, the table lies in buckets of it: a join on it alone with rows that are
        repartitioned by it into as many partitions doesn't shuffle the table."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        writer = df.write.option("compression", "zstd")
        if by is None:
            writer.parquet(path)
            out = self.spark.read.schema(df.schema).parquet(path)
        else:
            # only a catalogue's table may have buckets; once it is read its name isn't needed
            name = f"spark_catalog.default.tidemark_{uuid.uuid4().hex}"
            writer.format("parquet").option("path", path).bucketBy(buckets, by).saveAsTable(name)
            out = self.spark.table(name)
            self.spark.sql(f"drop table {name}")
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _delete(self.spark, self.paths.pop(id(df)))

    def only(self, *tables: DataFrame) -> None:
        self.paths = {id(df): self.paths[id(df)] for df in tables}
        for path in {f"{self.root}/{i + 1}" for i in range(self.n)} - set(self.paths.values()):
            _delete(self.spark, path)


#: rows of a few numbers each that may be broadcast, some 50 MB
BROADCAST_ROWS = 500_000


def light(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table of a few numbers a row, to be broadcast if it has BROADCAST_ROWS at most; beyond, Spark shuffles."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, like those given."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def arrow_map(df: DataFrame, schema: str, f: Callable[[pa.RecordBatch], Iterator[dict[str, object]]]) -> DataFrame:
    """mapInArrow by a function from a batch to dicts of columns (lists or arrays) of that schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = [(x.name, x.type) for x in to_arrow_schema(_parse_datatype_string(schema))]

    def run(batches):
        kinds = pa.schema(fields)
        for batch in batches:
            for out in f(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) if not isinstance(out[n], pa.Array) else out[n].cast(t) for n, t in fields], schema=kinds)

    return df.mapInArrow(run, schema)
