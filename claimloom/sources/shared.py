"""Written tables in the folder that driver and executors share, and small files that are made once."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it gets a temporary folder, which is then set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="claimloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used, in the shared folder."""
    return f"{work_dir(spark)}/claimloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet and read again: lineage ends there and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API, whatever store it is in."""
    Files(spark, path).delete(path)


class Scratch:
    """Written tables that are deleted together once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, last: int | None = None) -> None:
        """Delete all tables, but for the ``last`` ones kept."""
        cut = len(self.paths) - (last or 0)
        for path in self.paths[:cut]:
            drop_path(self.spark, path)
        self.paths = self.paths[cut:]


class Files:
    """Hadoop's file system calls, for whatever store a path is in."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._io = self._jvm.org.apache.commons.io.IOUtils
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path))) if self.exists(path) else []

    def make(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new small file; False if the name is taken.  The name appears once, with its content.

        Of two writers one gets the name: on a local disk by a hard link, on HDFS by a rename, neither
        of which replaces a file.  Other stores must refuse to create a name that exists
        (conditional writes on object stores).
        """
        scheme = self.fs.getScheme()
        staged = f"{path}.{uuid.uuid4().hex}" if scheme in ("file", "hdfs", "viewfs") else path
        try:
            stream = self.fs.create(self._path(staged), False)
            stream.write(bytearray(text.encode()))
            stream.close()
        except Py4JJavaError as e:
            if staged == path and "AlreadyExists" in str(e.java_exception.getClass()):
                return False
            raise
        if staged == path:
            return True
        try:
            return self._publish(scheme, staged, path)
        finally:
            self.delete(staged)

    def _publish(self, scheme: str, staged: str, path: str) -> bool:
        if scheme != "file":
            return self.fs.rename(self._path(staged), self._path(path))
        link = [self._jvm.java.io.File(self.fs.pathToFile(self._path(p)).getPath()).toPath() for p in (path, staged)]
        try:
            self._jvm.java.nio.file.Files.createLink(*link)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass()):
                return False
            raise
        return True
