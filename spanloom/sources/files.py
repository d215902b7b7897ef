"""Small files and folders on whatever file system a path names (HDFS, object stores, local disk)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._io = spark._jvm.org.apache.commons.io.IOUtils

    def _path(self, path: str):
        return self._hadoop.Path(f"{self.root}/{path}".rstrip("/"))

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def publish(self, path: str, text: str) -> bool:
        """Makes a file that wasn't there, whole or not at all; False if it is there.

        It is written beside its place and renamed, which HDFS does at once and for one writer only. A writer that dies
        leaves a file whose name begins with a dot; readers pass those by.
        """
        folder, _, name = path.rpartition("/")
        draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        none = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._path(draft), self._path(path), none)
        except Exception:
            self.delete(draft)
            if self.exists(path):
                return False
            raise
        return True

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(n for s in self._fs.listStatus(self._path(path)) if not (n := s.getPath().getName()).startswith("."))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def copy_to(self, path: str, root: str) -> None:
        target = self._hadoop.Path(f"{root.rstrip('/')}/{path}")
        other = target.getFileSystem(self._conf)
        other.mkdirs(target.getParent())
        self._hadoop.FileUtil.copy(self._fs, self._path(path), other, target, False, self._conf)


#: Temporary folders of applications that name none.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one of the application where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.applicationId
    if own not in _OWN:
        _OWN[own] = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    return _OWN[own]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/spanloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut, safe from lost executors."""
    folder = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all that ``scratch`` paths of the shared folder hold. For the end of a job: results still to be read need them."""
    Files(spark, shared_folder(spark)).delete("spanloom")
