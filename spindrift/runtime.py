"""Session set-up, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.storage import Place

#: White space as str.strip() understands it, which Java's \s (ASCII only) does not cover.
SPACE_CLASS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def session(app: str = "spindrift", cpus: str | int = "*", partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A local session with the settings the operators are tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(c: Column) -> Column:
    """The text without Unicode white space at its ends."""
    return F.regexp_replace(c, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, from spark.checkpoint.dir.

    Only a session that runs in one process may do without: it gets a private folder. Anywhere else the setting must be
    there, as a folder of the driver's machine would be none of the executors'.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", at)
    return str(Place(spark, at))


#: Nodes of a plan below which rows are spread by a shuffle.
_SPREAD = {"Join", "Aggregate", "Sort", "Window", "Deduplicate", "GlobalLimit", "Repartition", "RepartitionByExpression", "RebalancePartitions", "FlatMapGroupsInPandas"}


def _shuffles(plan) -> bool:
    below = plan.children()
    return plan.nodeName() in _SPREAD or any(_shuffles(below.apply(i)) for i in range(below.size()))


def spread(df: DataFrame) -> DataFrame:
    """The rows over more partitions, if the scan gives fewer than two for each core; else df as it is.

    For work that costs far more than moving the rows: a table in a few files would keep a few cores busy only. Large
    tables have more splits than cores and are not moved. Rows that a shuffle has spread already stay as they are; their
    partitions are not counted, as that would run the shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if _shuffles(df._jdf.queryExecution().optimizedPlan()):
        return df
    return df.repartition(3 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


_open: list[Place] = []


def clear_workspaces() -> None:
    """Removes the intermediate tables of all workspaces. Results that have not been read yet need them; at the end of the process they go by themselves."""
    while _open:
        try:
            _open.pop().delete()
        except Exception:  # noqa: BLE001, S112  # the JVM may be gone already
            continue


atexit.register(clear_workspaces)


class Workspace:
    """Intermediate tables in the shared folder.

    A step that is read more than once, or that ends an iteration, is written there and read back: lineage stays short
    and a lost executor costs no recomputation of the rounds before. `drop` removes a table nothing refers to any more.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0
        _open.append(Place(spark, self.base))

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        """The rows of df, read back from a written table, and the table's path."""
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        Place(self.spark, path).delete()


#: Rows of one key from which it is a hub.
HUB_ROWS = 100_000


def hub_join(rows: DataFrame, right: DataFrame, key: str, how: str = "inner", hub_rows: int = HUB_ROWS) -> DataFrame:
    """rows joined with a table of unique keys, where a few keys may hold a large share of the rows.

    Keys with more than `hub_rows` rows, of which a table of n rows has n / hub_rows at most, are answered from a
    broadcast; the rows of all others meet the table in a shuffle. Rows with a null key belong to no hub.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    hubs = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > hub_rows).select(key)
    if not (names := hubs.limit(HUB_ROWS + 1).collect()):
        return rows.join(right, key, how)
    if len(names) > HUB_ROWS:
        raise ValueError(f"more than {HUB_ROWS} keys with over {hub_rows} rows")
    few = F.broadcast(rows.sparkSession.createDataFrame([(r[0],) for r in names], hubs.schema))
    answers = F.broadcast(right.join(few, key, "left_semi"))
    return rows.join(few, key, "left_semi").join(answers, key, how).unionByName(rows.join(few, key, "left_anti").join(right, key, how))
