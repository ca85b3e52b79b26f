"""A durable ledger of a model's calls: reserved before a job, settled by what succeeded after it.

Entries are committed to a versioned table, so runs that overlap share one day's cap. A job reserves as
many calls as it has batches, or what is left; what it then settles is the number of batches that have
an answer in its written result. Tasks that are tried again leave one result, so they count once, and
failed calls don't count. A run that is lost between the two steps has its calls held until the next day.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazelark.operators.rank import batch_index
from gazelark.shared import checkpointed
from gazelark.sources.versioned import Versioned

SCHEMA = "day date, entry string, calls long, settled boolean"
KEPT_DAYS = 3


def _standing(rows: DataFrame) -> DataFrame:
    """An entry as it was settled, or as it was reserved."""
    return rows.groupBy("day", "entry").agg(F.max_by("calls", F.struct("settled", -F.col("calls"))).alias("calls"), F.max("settled").alias("settled"))


class Ledger:
    def __init__(self, spark: SparkSession, path: str, cap: int, today: Callable[[], date] = date.today):
        self.table, self.cap, self.today = Versioned(spark, path, SCHEMA, _standing, attempts=20), cap, today

    def used(self, day: date | None = None) -> int:
        """Calls of a day, settled or held."""
        return int(self.table.read().where(F.col("day") == F.lit(day or self.today())).agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("n")).first()["n"])

    @property
    def left(self) -> int:
        return max(0, self.cap - self.used())

    def reserve(self, calls: int) -> tuple[str, int]:
        """(entry, calls granted): as many as are asked for and left, whoever else reserves meanwhile."""
        entry, day = uuid.uuid4().hex, self.today()

        def decide(state: DataFrame) -> DataFrame:
            taken = state.where(F.col("day") == F.lit(day)).agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("n"))
            granted = F.greatest(F.lit(0), F.least(F.lit(calls), F.lit(self.cap) - F.col("n"))).cast("long")
            return taken.select(F.lit(day).alias("day"), F.lit(entry).alias("entry"), granted.alias("calls"), F.lit(False).alias("settled"))

        self.table.commit_decided(decide)
        return entry, int(self.table.read().where(F.col("entry") == entry).first()["calls"])

    def settle(self, entry: str, calls: int) -> None:
        row = [(self.today(), entry, calls, True)]
        self.table.commit(self.table.spark.createDataFrame(row, SCHEMA))
        self.table.compact_when_due(F.col("day") > F.date_sub(F.lit(self.today()), KEPT_DAYS))


def screened_within(rows: DataFrame, judge: Callable[[list[dict]], set | None], ledger: Ledger, size: int = 25, order: list[str] = ("ord",), id_column: str = "ord") -> DataFrame:
    """rows with boolean `kept`, judged `size` at a time in the order of columns `order`, within the ledger.

    Null without a verdict: where the judge gave none or failed, and in batches beyond the calls granted.
    Batches are numbered over all rows, so that there are as few as can be, and each is a group of its own.
    """
    batched = checkpointed(batch_index(rows, size, list(order)))
    wanted = batched.agg(F.max("batch").alias("n")).first()["n"]
    entry, granted = ledger.reserve(0 if wanted is None else int(wanted) + 1)
    names, schema = rows.columns, T.StructType([*batched.schema, T.StructField("kept", T.BooleanType())])

    def ask(frame):
        import pandas as pd

        try:
            verdict = judge(frame[names].to_dict("records"))
        except Exception:  # noqa: BLE001 - a judge is the caller's; a failed call gives no verdict
            verdict = None
        return frame.assign(kept=pd.array([None] * len(frame) if verdict is None else [i in verdict for i in frame[id_column]], dtype="boolean"))

    answers = checkpointed(batched.where(F.col("batch") < granted).groupBy("batch").applyInPandas(ask, schema))
    ledger.settle(entry, answers.where("kept IS NOT NULL").select("batch").distinct().count())
    rest = batched.where(F.col("batch") >= granted).withColumn("kept", F.lit(None).cast("boolean"))
    return answers.unionByName(rest).drop("batch")
