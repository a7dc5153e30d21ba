"""What the operators of this subpackage share: the shared folder, written stages and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII white space that the word and line rules strip: \x20 and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset and the master is local (as in tests), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusmill/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def columns_but(docs: DataFrame, *names: str) -> list[Column]:
    """The columns of docs in order, without those of these names (Spark's names don't depend on case)."""
    gone = {n.lower() for n in names}
    return [F.col(quoted(c)) for c in docs.columns if c.lower() not in gone]


def unused(docs: DataFrame, *names: str) -> list[str]:
    """These names, each with so many underscores before it that docs has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def mapped(docs: DataFrame, run, name: str, kind: T.DataType) -> DataFrame:
    """The columns of docs, whatever their names, and the column `name`, by mapInArrow(run); run sees columns c0, c1, ..."""
    plain = [f"c{k}" for k in range(len(docs.columns))]
    schema = T.StructType([*[T.StructField(p, f.dataType) for p, f in zip(plain, docs.schema, strict=True)], T.StructField(name, kind)])
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*docs.columns, name)


def let(value: Column, body) -> Column:
    """body(value), with value computed once although body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
