"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def local_session(app: str = "skein", cores: int = 8, shuffle: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, in local mode only, one of our own where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share, such as one of hdfs:// or s3a://")
    if sc.applicationId not in _own_dirs:
        path = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, path, True)
        _own_dirs[sc.applicationId] = "file://" + path
    return _own_dirs[sc.applicationId]


class Scratch:
    """Written tables that cut lineage. They survive the loss of executors, unlike cached blocks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/skein/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and read it back; the plan of the result is a plain scan."""
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._skein_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables written by save() once nothing lazy reads them any more."""
        for t in tables:
            if t is not None and getattr(t, "_skein_path", None):
                self.delete(t._skein_path)

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame) -> DataFrame:
    """df in at least two partitions a core, for stages whose cost a row is high.

    Large inputs are split finely by their scan and are left as they are.
    """
    want = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
