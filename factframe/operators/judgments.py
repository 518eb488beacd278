"""An append-only store of judgments that may supersede one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factframe.operators.chains import chains
from factframe.operators.keyed import KeyedTable
from factframe.operators.storage import written

SHAPE = T.StructType([T.StructField("id", T.LongType()), T.StructField("supersedes", T.LongType()), T.StructField("version", T.IntegerType()), T.StructField("kept", T.BooleanType())])


class JudgmentStore:
    """Judgments in a table keyed by id; a deleted one stays as a row that is not kept."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.table = KeyedTable(spark, folder, SHAPE, ["id"], buckets=buckets)

    def read(self) -> DataFrame:
        return self.table.read().where("kept").select("id", "supersedes")

    def append(self, rows: DataFrame) -> DataFrame:
        """(id, outcome) of each row (id, supersedes); only `appended` ones are stored.

        `duplicate`: the id is stored, or several rows have it. `dangling`: the
        way along the superseded judgments reaches one that is neither stored nor
        among the rows. `cycle`: the way comes back to itself. Rows of one call
        may supersede one another in any order; a row that leads to a refused one
        is refused with it.
        """
        stored = self.table.read().select("id", "version", "kept")
        given = written(rows.groupBy("id").agg(F.min("supersedes").alias("supersedes"), F.count("*").alias("_n")).join(stored, "id", "left"), "judgments")
        repeated = (F.col("_n") > 1) | F.coalesce("kept", F.lit(False))
        fresh = given.where(~repeated).select("id", "supersedes", "version")
        known = self.read().select(F.col("id").alias("supersedes"), F.lit(True).alias("_known"))
        # what is stored already resolves, so a link to it ends the way well
        linked = fresh.join(known, "supersedes", "left")
        ways = chains(linked.select("id", F.when(F.col("_known").isNull(), F.col("supersedes")).alias("supersedes")))
        ends = written(ways.groupBy("id").agg(F.min("ends").alias("ends")), "ways")
        good = fresh.join(ends.where("ends = 'root'"), "id").select("id", "supersedes", (F.coalesce("version", F.lit(0)) + 1).alias("version"), F.lit(True).alias("kept"))
        self.table.replace(good)
        bad = ends.select("id", F.when(F.col("ends") == "root", "appended").otherwise(F.col("ends")).alias("outcome"))
        return given.where(repeated).select("id", F.lit("duplicate").alias("outcome")).unionByName(bad)

    def delete(self, ids: DataFrame) -> DataFrame:
        """(id, outcome): `deleted`, `missing`, or `superseded` by another judgment, which keeps it."""
        held = written(self.table.read().where("kept"), "kept")
        later = held.select(F.col("supersedes").alias("id"), F.lit(True).alias("_later")).where("id is not null").distinct()
        asked = written(ids.select("id").distinct().join(held, "id", "left").join(later, "id", "left"), "asked")
        outcome = F.when(F.col("kept").isNull(), "missing").when(F.col("_later"), "superseded").otherwise("deleted")
        told = written(asked.select("id", "supersedes", "version", outcome.alias("outcome")), "told")
        self.table.replace(told.where("outcome = 'deleted'").select("id", "supersedes", (F.col("version") + 1).alias("version"), F.lit(False).alias("kept")))
        return told.select("id", "outcome")
