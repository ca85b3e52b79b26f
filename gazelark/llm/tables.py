"""Reading the tables that the queries of this subpackage use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gazelark.shared import checkpointed  # noqa: F401 - the operators' own


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_texts(docs: DataFrame, key: str, text: str, fields: list, compute, slice_chars: int | None = None, beside: str | None = None) -> DataFrame:
    """docs' key (as it is) and the columns that compute(list of texts or None) gives, a list each.

    text: a column, or key.field where the key is a struct that holds it, so that it travels once.
    beside: a long field of a struct key, handed to compute after the texts, as an array.
    Works on Arrow batches, slice_chars (SLICE_CHARS) characters at a time; a longer text goes alone.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import types as T

    most = slice_chars or SLICE_CHARS
    inside = text.removeprefix(f"{key}.") if text.startswith(f"{key}.") else None
    chosen = docs.select(key) if inside else docs.select(key, text)
    schema = T.StructType([chosen.schema[0], *fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            column = batch.column(0).field(inside) if inside else batch.column(1)
            sizes, at = pc.fill_null(pc.utf8_length(column), 0).to_pylist(), 0
            while at < len(sizes):
                end, chars = at, 0
                while end < len(sizes) and (end == at or chars + sizes[end] <= most):
                    chars += sizes[end]
                    end += 1
                more = [batch.column(0).field(beside)[at:end].to_numpy(zero_copy_only=False)] if beside else []
                columns = compute(column[at:end].to_pylist(), *more)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end].cast(kinds[0].type), *[pa.array(c, kinds[k].type) for k, c in enumerate(columns, 1)]], schema=kinds)
                at = end

    return chosen.mapInArrow(run, schema)


#: Whole texts make large rows. What a reader, and both sides of a Python task, hold at once is bounded by these.
WHOLE_TEXTS = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def bound_batches(session: SparkSession, given: dict[str, str]) -> None:
    """WHOLE_TEXTS for a session of our own, but for what is in the settings given."""
    for name, value in WHOLE_TEXTS.items():
        if name not in given:
            session.conf.set(name, value)


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings and WHOLE_TEXTS; the caller's own stays as it is."""
    own, given = spark.newSession(), dict(spark.conf.getAll)
    for name, value in given.items():
        if own.conf.isModifiable(name) and own.conf.get(name, None) != value:
            own.conf.set(name, value)
    bound_batches(own, given)
    return own


SLICE_CHARS = 500_000
