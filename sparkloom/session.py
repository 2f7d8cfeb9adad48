"""Session settings and the table reader that every query uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder; the path may be any that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a shuffle for each task.
ROWS_A_TASK = 1 << 19


def tasks_for(df: DataFrame) -> int:
    """So many tasks for the rows of a table that none gets more as the table grows; to count a Parquet table takes its footers only."""
    return max(1, -(-df.count() // ROWS_A_TASK))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names one that driver and executors share in spark.checkpoint.dir. Only a
    local session, where all is one process, gets a temporary folder instead.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="sparkloom-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there: short lineage, no second computation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder. For rounds: unlike a checkpoint, which keeps the estimates of the plan it cut,
    the next plan knows the table's real size, so that small tables are broadcast and estimates don't multiply from round to round."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made and nothing reads any more."""
    for df in tables:
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
