"""Intermediate tables in the folder that the session's executors share, and small files in any folder Spark reaches."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: How the names of temporary tables in the catalog begin.
BUCKETED = "graphloom_bucketed_"


@dataclass(frozen=True)
class Folder:
    """A folder of small files, through Hadoop's file systems."""

    spark: SparkSession
    path: str

    def _at(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def times(self, name: str = "") -> dict[str, int]:
        """Names in the folder, with the time of their last change in ms; empty where there is none."""
        fs, p = self._at(name)
        return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(p)} if fs.exists(p) else {}

    def names(self, name: str = "") -> list[str]:
        return [n for n in self.times(name) if not n.startswith(("_", "."))]

    def text(self, name: str) -> str:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def json(self, name: str) -> dict:
        return json.loads(self.text(name))

    def put(self, name: str, data: dict) -> None:
        """Writes a JSON file."""
        text = json.dumps(data)
        fs, p = self._at(name)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def put_new(self, name: str, data: dict) -> bool:
        """Writes a file whole or not at all; False if it exists."""
        aside = f"aside-{uuid.uuid4().hex}"
        self.put(aside, data)
        fs, source = self._at(aside)
        target = self._at(name)[1]
        fs.mkdirs(target.getParent())
        done = not fs.exists(target) and fs.rename(source, target)
        if not done:
            fs.delete(source, False)
        return done

    def delete(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder is set where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _own(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_dir(spark)}/graphloom/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """df computed once, as a Parquet table in the shared folder; cuts the lineage of loops. See drop_written()."""
    path = f"{_own(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df computed once, as a table in the shared folder that is dealt by key: joins on key move only the other side.

    The table is temporary like those of written(); drop_written() also takes its name out of the catalog.
    """
    spark, name = df.sparkSession, f"{BUCKETED}{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", f"{_own(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def drop_written(spark: SparkSession, days: float | None = None) -> None:
    """Deletes the intermediate tables of this application, once its results are stored; or, with days, those that any
    application left behind and that have not changed for so long."""
    if days is None:
        for t in spark.catalog.listTables(pattern=f"{BUCKETED}*"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
        Folder(spark, _own(spark)).delete("")
        return
    top = Folder(spark, f"{shared_dir(spark)}/graphloom")
    now = spark._jvm.java.lang.System.currentTimeMillis()
    for name, changed in top.times().items():
        if now - changed > days * 86_400_000:
            top.delete(name)
