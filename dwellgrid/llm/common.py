"""What the text operators share: reading tables, ASCII rules for blanks and case, and cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Capital and title-case letters outside A-Z: only these make lower() differ from lower-casing A-Z alone.
OTHER_CAPITALS = "[\\p{javaUpperCase}\\p{javaTitleCase}&&[^A-Z]]"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns the operators read, as ``doc_id`` and ``text``; a null text counts as empty.

    Whatever other columns ``docs`` has, with whatever names, stays out of the operators' plans.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else.

    ``translate`` looks up every character in a map, so it is left to texts with other capitals; for the rest
    ``lower`` gives the same string.
    """
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(OTHER_CAPITALS)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    On a cluster it must be set.  Only a local session without it, as in a unit test, gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="dwellgrid-")
    spark.sparkContext.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers the package's modules, once per application, through Spark's own file distribution."""
    context = spark.sparkContext
    if getattr(context, "_dwellgrid_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="dwellgrid-ship-")  # read by the driver's file server only
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "dwellgrid.zip")
    with zipfile.ZipFile(path, "w") as package:
        for place, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    source = os.path.join(place, name)
                    package.write(source, os.path.relpath(source, os.path.dirname(root)))
    context.addPyFile(path)
    context._dwellgrid_shipped = True


def own_shuffle(number: Column) -> Column:
    """The same whole number, through an expression to which Spark does not carry a partitioning.

    A join whose one side is already an aggregate by the join's key runs in the aggregate's stage, where adaptive
    execution cannot split a hot key.  With its key in this form that side is shuffled again, a row per key, and both
    sides of the join can be split.
    """
    return F.bitwise_not(F.bitwise_not(number))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later steps neither recompute it nor depend
    on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/dwellgrid-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint (narrow frames only; Spark removes the files when they are no longer used)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
