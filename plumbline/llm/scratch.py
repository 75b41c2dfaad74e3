"""Tables that cut lineage, written to the folder all executors share.

``spark.checkpoint.dir`` names that folder; only where it is unset (tests on one machine) a folder of our own is
made. Each call of an operator works below one random name, so concurrent runs never meet.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if "root" not in _OWN:
        _OWN["root"] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(_drop_local, _OWN["root"].removeprefix("file://"))
    return _OWN["root"]


def _drop_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """Named intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back with the same schema."""
        where = self.path(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``table()`` that nothing lazy still reads."""
        for df in tables:
            self.delete(df._scratch_path)

    def delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(spark: SparkSession, bytes_in: float, per_partition: float = 16e6) -> int:
    """Shuffle partitions for so many bytes, never under the session's own number."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(own, int(-(-bytes_in // per_partition)))
