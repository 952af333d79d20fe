"""Shared helpers of the corpus operators (Spark side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptframe.session import scratch_path, table

#: Rows numbered by one window task, on average.
NUMBER_ROWS = 250_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return table(spark, sf_dir, "documents")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts lineage in a way that survives a lost executor, and lets a result
    that is used more than once be computed once.  The shuffles that led to it are
    then done with; Spark removes their files once the driver has collected its
    garbage, which is asked for here, so that a job of many steps holds one step's
    shuffle files and not all.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def numbered(docs: DataFrame, name: str, **columns: Column) -> DataFrame:
    """``columns`` of ``docs``, a table read from Parquet files, after the rows' numbers in a column ``name``.

    A number is the file's place among the table's files and the row's place in its file, so every
    scan gives a row the same one, however the files are split among tasks.  Only what is asked for is
    selected, under the names given here, so the table's own names (``_metadata`` included) cannot clash.
    Files are told apart by a hash of their path: the driver gets 8 bytes a file.
    """
    meta = docs.metadataColumn("_metadata")
    place = docs.select(F.xxhash64(meta["file_path"]).alias("__file"), meta["row_index"].alias("__row"),
                        *[c.alias(n) for n, c in columns.items()])
    files = docs.select(F.xxhash64(meta["file_path"]).alias("__file"), meta["file_path"].alias("__path"))
    found = files.groupBy("__file").agg(F.min("__path") != F.max("__path")).collect()  # one row for each file
    if any(r[1] for r in found):
        raise ValueError("two files of the table have one hash")
    if len(found) < 2:
        return place.select(F.col("__row").alias(name), *columns)
    places = docs.sparkSession.createDataFrame(list(enumerate(sorted(r[0] for r in found))), "__place long, __hash long")
    return (place.join(F.broadcast(places), F.col("__file") == F.col("__hash"))
            .select((F.shiftleft("__place", 40) + F.col("__row")).alias(name), *columns))


def with_rows(docs: DataFrame, rows: DataFrame, number: str, how: str) -> DataFrame:
    """The rows of ``docs`` whose number is (``left_semi``) or is not (``left_anti``) in ``rows``, columns unchanged."""
    own = {f"c{i}": F.col(quoted(c)) for i, c in enumerate(docs.columns)}
    kept = numbered(docs, "__number", **own).join(rows.select(F.col(number).alias("__number")), "__number", how)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def quoted(name: str) -> str:
    """A column's name as a plain name, dots and backquotes included."""
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def number(df: DataFrame, group: str, order: list[str], spread: str, name: str,
           rows_per_task: int = NUMBER_ROWS) -> DataFrame:
    """Gapless numbers from 0 within each ``group``, without one window per large group.

    A group of more than ``rows_per_task`` rows is cut into buckets by the 64-bit hash in
    ``spread`` (a stored column, so that every reading sees the same one); a bucket's offset is the sum of
    the buckets before it.  The tables of large groups and of their buckets have at most
    ``2 * rows / rows_per_task`` rows, however many groups there are; other groups need none.
    """
    large = (df.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
             .where(F.col("__n") > rows_per_task)
             .select("__g", F.ceil(F.col("__n") / rows_per_task).alias("__buckets")))
    part = F.when(F.col("__buckets").isNull(), F.lit(0)).otherwise(F.pmod(F.col(spread), F.col("__buckets")))
    df = df.join(F.broadcast(large), F.col(group).eqNullSafe(F.col("__g")), "left").withColumn("__part", part)
    sizes = df.where(F.col("__buckets").isNotNull()).groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("__h"), F.col("__part").alias("__p"),
                          F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start_at"))
    within = Window.partitionBy(group, "__part").orderBy(*order, spread)
    ranked = df.withColumn("__rank", F.row_number().over(within) - 1)
    return (ranked.join(F.broadcast(starts), F.col(group).eqNullSafe(F.col("__h")) & (F.col("__part") == F.col("__p")), "left")
            .withColumn(name, (F.coalesce("__start_at", F.lit(0)) + F.col("__rank")).cast("long"))
            .drop("__part", "__rank", "__g", "__buckets", "__h", "__p", "__start_at"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node of ``edges`` (a long, b long): the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours and then the
    label of that label, so paths shrink by half; rounds are written tables.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = materialise(labels, f"{name}-labels")
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near")))
        step = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = step.join(jump, F.col("label") == F.col("to")).select(
            "node", "old", F.least("label", "far").alias("label"))
        new = materialise(new, f"{name}-labels")
        labels = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return labels
