"""A session with the settings the plans are written for."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, name: str = "tessera", **conf: str) -> SparkSession:
    """AQE re-plans joins and partitions at run time; long translate() literals are kept out of plan strings."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.debug.maxToStringFields": "100",
        "spark.sql.maxPlanStringLength": "20000",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """This application's folder in the shared one that the cluster names in spark.checkpoint.dir; a temporary one only where none is named, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def ease(spark: SparkSession) -> bool:
    """Has the driver's JVM give back the native memory that plans and jobs left free in its allocator; False where the JVM can't (before 17.0.9, or not on Linux)."""
    java, array = spark._jvm.java, spark.sparkContext._gateway.new_array
    kind, types, said = java.lang.Class.forName, array(java.lang.Class, 4), array(java.lang.Object, 4)
    try:  # by reflection on the interface: the server's own class isn't exported
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = kind(name)
        said[0], said[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), said)
    except Py4JError:
        return False
    return True


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Cuts the lineage of a table that several branches read: writes it to the scratch folder and reads it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    ease(spark)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application: to be called when no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
