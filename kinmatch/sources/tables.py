"""Reading and writing record tables."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = ("entity_id", "business_name", "business_address", "country")


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_tsv(spark: SparkSession, path: str, columns=RECORD) -> DataFrame:
    """Tab-separated text with a header, no quoting, all strings, an empty cell as the empty string."""
    return spark.read.csv(path, sep="\t", header=True, quote="", escape="", schema=text_schema(columns), enforceSchema=False).fillna("")


def read_tolerant(spark: SparkSession, path: str, columns=RECORD, quoted: bool = False) -> DataFrame:
    """As read_tsv, with odd lines kept whole in the column `bad`."""
    schema = text_schema([*columns, "bad"])
    return spark.read.csv(path, sep="\t", header=True, quote='"' if quoted else "", escape="", schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="bad", enforceSchema=True)


def line_counts(spark: SparkSession, path: str, columns=RECORD) -> DataFrame:
    """raw_lines, rows without quoting, rows with quoting, and bad lines of a file."""
    raw = spark.read.text(path).agg((F.count("*") - 1).alias("raw_lines"))
    parts = [raw]
    for name, quoted in (("rows_plain", False), ("rows_quoted", True)):
        read = read_tolerant(spark, path, columns, quoted).cache()
        parts.append(read.agg(F.count("*").alias(name), F.count_if(F.col("bad").isNotNull()).alias(f"bad_{name[5:]}")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path and size of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.round(F.col("length") / 1024, 1).alias("kb"))


def split_ids(c: Column) -> Column:
    """A comma list as an array, trimmed, without empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """source1_entity_id and matched_ids."""
    rows = read_tsv(spark, path, ("source1_entity_id", "matched_entity_ids"))
    return rows.select("source1_entity_id", split_ids(F.col("matched_entity_ids")).alias("matched_ids"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    """s1_id and cand_id, one row a true pair."""
    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode("matched_ids").alias("cand_id"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; empty lines don't count."""
    return spark.read.text(path).select(F.trim("value").alias("entity_id")).where("entity_id <> ''")


def read_columns(spark: SparkSession, path: str, columns) -> DataFrame:
    """Those of the columns that a parquet file has."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in columns if c in df.columns])


def read_some(spark: SparkSession, path: str, ids, columns) -> DataFrame:
    """The rows of a few ids; the filter reaches the file scan."""
    return spark.read.parquet(path).where(F.col("entity_id").isin(list(ids))).select(*columns)


def source_path(root: str, split: str, number: int) -> str:
    return f"{root}/{split}/{split}_source{number}.tsv"


def read_source(spark: SparkSession, root: str, split: str, *numbers: int) -> DataFrame:
    """The records of one or more sources, with the source's number."""
    out = None
    for n in numbers:
        part = read_tsv(spark, source_path(root, split, n)).withColumn("source", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def write_tsv(df: DataFrame, path: str) -> None:
    """Header, tabs, no quoting; an empty list is an empty cell."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="")


def write_frozen(df: DataFrame, path: str) -> None:
    """Fails if there is something already."""
    df.write.mode("errorifexists").parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage, whereupon Spark deletes the shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cached(spark: SparkSession, path: str, build, rows: int | None = None) -> DataFrame:
    """What the folder holds, or else what `build` gives, written there by Spark's commit protocol. Stops if it holds another number of rows than expected."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        build().write.parquet(path)
        found = spark.read.parquet(path)
    if rows is not None and (n := found.count()) != rows:
        raise ValueError(f"{path} holds {n} rows, not {rows}: it is stale")
    return found
