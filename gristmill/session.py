"""Session settings and the checkpoint folder."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "gristmill", shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """Session with adaptive execution on. Set no master or partition count on a cluster: the
    submit command and adaptive coalescing decide those there."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Word counts have nearly as many groups as rows, so a small first-level map only costs time.
        .config("spark.sql.codegen.aggregate.map.twolevel.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share. Only a local session without that
    setting gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="gristmill-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A table scan with fewer splits than cores (a small file, or one row group) is spread by key before
    row-by-row work. A large table has splits enough and is left where it is, without a shuffle."""
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if splits >= scan.sparkSession.sparkContext.defaultParallelism else scan.repartition(*keys)


#: Bytes of a table that one task takes where it makes many rows of each.
PIECE_BYTES = 2 << 20
MOST_PIECES = 20_000
#: A plan that does not know its size gives a number beyond any table.
UNKNOWN_BYTES = 1 << 50


def pieces(rows: DataFrame) -> int:
    """Partitions for work in place that makes many rows of each row, by the size that the plan knows of, so that a task's memory does not
    grow with the table. Adaptive coalescing goes by the size before that and leaves a given number alone."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    needed = -(-size // PIECE_BYTES) if size < UNKNOWN_BYTES else 0
    return min(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), needed), MOST_PIECES)
