"""Session and table helpers shared by every query."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for a master on this machine, where spark.checkpoint.dir is unset.
FALLBACK_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set; executors need a folder they share")
    return (base or FALLBACK_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fabricloom-{name}-{uuid.uuid4().hex}"


def passing_path(spark: SparkSession, name: str) -> str:
    """A new path that is deleted when the program ends."""
    path = new_path(spark, name)
    _left[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_left: dict[str, SparkSession] = {}


@atexit.register
def _delete_at_exit() -> None:
    for path, spark in _left.items():
        if spark.sparkContext._jsc is not None:
            try:
                delete(spark, path)
            except Exception as e:  # the JVM may be gone already
                print(f"left behind: {path} ({type(e).__name__})")


class Staged:
    """A DataFrame written once to the shared folder, so that lost executors never recompute what led to it. folders: columns
    whose values get a folder each."""

    def __init__(self, df: DataFrame, name: str, *folders: str):
        self.spark, self.path = df.sparkSession, passing_path(df.sparkSession, name)
        df.write.parquet(self.path, partitionBy=list(folders) or None)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _left.pop(self.path, None)
        delete(self.spark, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written once to the shared folder and read again: what several readers need, and what bounds lineage."""
    return Staged(df, name).df


class Rounds:
    """The state of an iterative operator: each round's table replaces, and deletes, the one before."""

    def __init__(self, df: DataFrame, name: str):
        self.name, self.now = name, Staged(df, name)

    @property
    def df(self) -> DataFrame:
        return self.now.df

    def next(self, df: DataFrame) -> DataFrame:
        before, self.now = self.now, Staged(df, self.name)
        before.drop()
        return self.now.df


def local_session(cores: str = "8", partitions: int = 8, name: str = "fabricloom") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
