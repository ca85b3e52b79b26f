"""Approximate nearest neighbours by cross-polytope hashing.

The mean of all unit vectors of a length is taken off first, so that vectors around one centre are told
apart by what they differ in; the cosine that ranks is that of the vectors as given. What is left, as a
unit vector, goes through three rounds of random signs and a fast Hadamard transform; its axis in a
rotation is the nearest signed one. A table's code joins the axes of as many rotations as give about
a bucket for every BUCKET_ROWS vectors; the last rotation looks at fewer coordinates, so that the
number of codes follows the number of vectors smoothly. A query looks up its nearest codes in
every table, PROBES * n**GROWTH of them, so the vectors that it meets grow far slower than the table.

Buckets hold ids. Ids met are collected for each query and block of vectors, so vectors travel once,
and a query's only to the blocks that it met; there the exact cosine in double precision ranks them.
A code that more than a HOT_SHARE-th of the vectors have is dealt out in chunks of that size (such
codes are fewer than HOT_SHARE in a table, so they are broadcast), and a query that looks it up meets
each of them. Of equal vectors the nearest + 1 smallest ids stand for all (no other can be a result), and equal
queries are asked once, so a vector that a third of the rows have is no hot bucket. A query that
finds fewer than it asks for is ranked against all vectors, in blocks.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
neither do null ids; vectors of different lengths are no candidates for each other; a query's own
id is no candidate, repeated ids count once with their best score; equal scores go by the smaller
id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazelark.llm.tables import checkpointed, read

TABLES, ROUNDS = 20, 3
PROBES, GROWTH = 2.0, 0.36  # of n vectors, a query looks up PROBES * n**GROWTH codes a table
BUCKET_ROWS = 4
NEAREST = 5
BLOCK, BLOCK_PAIRS = 4096, 2_000_000  # vectors of a block at most, and pairs that it is to meet, about
SEED = 11
HOT_SHARE = 200


def transform(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    y, half = x.copy(), 1
    while half < d:
        pairs = y.reshape(n, d // (2 * half), 2, half)
        a, b = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0], pairs[:, :, 1] = a + b, a - b
        half *= 2
    return y / np.sqrt(d)


def rotations(n: int, d: int) -> list[int]:
    """How many coordinates each rotation of a table looks at, for n vectors of d numbers."""
    width, left, out = 1 << max(0, d - 1).bit_length(), n / BUCKET_ROWS, []
    while left > 1.5:
        out.append(min(width, max(1, round(left / 2))))
        left /= 2 * out[-1]
    return out


def probed_codes(n: int) -> int:
    return max(1, round(PROBES * n**GROWTH))


def codes(vectors: np.ndarray, table: int, looks: list[int], probes: int) -> np.ndarray:
    """The `probes` nearest codes of each row in a table, the nearest first; -1 where there are no more."""
    n, d = vectors.shape
    width = 1 << max(0, d - 1).bit_length()
    start = np.zeros((n, width))
    start[:, :d] = vectors
    best, nearness = np.zeros((n, 1), np.int64), np.zeros((n, 1))
    for k, look in enumerate(looks):
        rng = np.random.Generator(np.random.PCG64([SEED, table, k, d]))
        y = start
        for _ in range(ROUNDS):
            y = transform(y * rng.choice([-1.0, 1.0], width))
        signed = np.concatenate([y[:, :look], -y[:, :look]], axis=1)  # of axis 0.., then of the negative ones
        m = min(probes, 2 * look)
        near = np.argsort(-signed, axis=1, kind="stable")[:, :m] if m > 1 else signed.argmax(axis=1)[:, None]
        # of codes and axes, each the nearest first, the i-th with the j-th has i * j - 1 pairs before it
        before = np.arange(1, best.shape[1] + 1)[:, None] * np.arange(1, m + 1) <= probes
        i, j = np.nonzero(before)
        joined, code = nearness[:, i] + np.take_along_axis(signed, near, axis=1)[:, j], best[:, i] * (2 * look) + near[:, j]
        at = np.argsort(-joined, axis=1, kind="stable")[:, :probes]
        joined, code = np.take_along_axis(joined, at, axis=1), np.take_along_axis(code, at, axis=1)
        best, nearness = code, joined
    return np.pad(best, ((0, 0), (0, probes - best.shape[1])), constant_values=-1)


def _usable(column) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.dtype]:
    """Length -> (rows, vectors) of an Arrow list column's finite, non-zero vectors."""
    values = column.values.to_numpy(zero_copy_only=False)
    kind = np.dtype("<f4") if values.dtype == np.float32 else np.dtype("<f8")
    values = values.astype(kind)
    offsets = column.offsets.to_numpy()
    lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    out = {}
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        x = values[offsets[rows][:, None] + np.arange(d)]
        fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if fine.any():
            out[int(d)] = (rows[fine], x[fine])
    return out, kind


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_USABLE = T.StructType([T.StructField("id", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("wide", T.BooleanType()), T.StructField("vec", T.BinaryType())])


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id, dim, wide, vec (its numbers' bytes, of 64 bits where wide) of the vectors that take part."""
    chosen = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), column)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(_USABLE)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found, kind = _usable(batch.column(1))
            for d, (rows, x) in found.items():
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, kind.itemsize == 8)), pa.array([v.tobytes() for v in x], pa.binary())], schema=kinds)

    return chosen.mapInArrow(run, _USABLE)


def _matrix(column, wide) -> np.ndarray:
    return np.array([np.frombuffer(v, "<f8" if w else "<f4") for v, w in zip(column.to_pylist(), wide.to_pylist())], np.float64)


_SUMS = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])


def centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the unit vectors of each length; a task adds up its own first."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                unit = _unit(_matrix(part.column(2), part.column(1)))
                sums[d], counts[d] = sums.get(d, 0) + unit.sum(axis=0), counts.get(d, 0) + len(unit)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64())), pa.array(list(counts.values()), pa.int64())], schema=to_arrow_schema(_SUMS))

    each = rows.select("dim", "wide", "vec").mapInArrow(run, _SUMS).select("dim", "n", F.posexplode("sums").alias("at", "sum"))
    means: dict[int, dict[int, float]] = {}
    for r in each.groupBy("dim", "at").agg((F.sum("sum") / F.sum("n")).alias("mean")).collect():  # as many numbers as a vector has
        means.setdefault(r["dim"], {})[r["at"]] = r["mean"]
    # rounded, so that the order in which tasks are added up decides no code
    return {d: np.round(np.array([m[k] for k in range(d)]), 9) for d, m in means.items()}


def _apart(unit: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Unit vectors without their centre, as unit vectors; zero where nothing is left."""
    left = unit - centre
    size = np.sqrt((left * left).sum(axis=1, keepdims=True))
    return np.where(size > 1e-9, left / np.maximum(size, 1e-9), 0.0)


def chunked(posted: DataFrame, probed: DataFrame, sizes: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """Both with `chunk`: postings of a hot code are dealt out, and its lookups go to each chunk."""
    of_dim = F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in sizes.items()], F.lit(1))
    counted = posted.groupBy("dim", "table", "code").agg(F.count("*").alias("n"))
    hot = F.broadcast(counted.where(F.col("n") * HOT_SHARE > of_dim).select("dim", "table", "code", F.ceil(F.col("n") * HOT_SHARE / of_dim).cast("int").alias("chunks")))
    keys = ["dim", "table", "code"]
    dealt = posted.join(hot, keys, "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"), F.lit(0))).drop("chunks")
    asked = probed.join(hot, keys, "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))).drop("chunks")
    return dealt, asked


def coded(rows: DataFrame, name: str, sizes: dict[int, int], tables: int, probes: dict[int, int], middle: dict[int, np.ndarray]) -> DataFrame:
    """name, dim, table, code: the nearest codes of each row (name, dim, wide, vec). sizes: vectors of each length; probes: codes for each; middle: centres."""
    schema = T.StructType([T.StructField(name, T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("codes", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole[a : a + 512]
                dims = batch.column(1).to_numpy()
                for d in np.unique(dims):
                    part = batch.take(pa.array(np.flatnonzero(dims == d)))
                    unit, looks = _apart(_unit(_matrix(part.column(3), part.column(2))), middle[int(d)]), rotations(sizes[int(d)], int(d))
                    own = np.hstack([codes(unit, t, looks, probes[int(d)]) for t in range(tables)])
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(own), kinds[2].type)], schema=kinds)

    each = rows.select(name, "dim", "wide", "vec").mapInArrow(run, schema).select(name, "dim", F.size("codes").alias("n"), F.posexplode("codes").alias("at", "code"))
    return each.where("code >= 0").select(name, "dim", F.floor(F.col("at") * tables / F.col("n")).cast("int").alias("table"), "code")


_FOUND = T.StructType([T.StructField("asked", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _ranker(most: int):
    """For cogrouped Arrow tables of one block: vectors (id, wide, vec), and queries (asked, wide, vec, ids).

    A query is ranked against the vectors of its ids, or all where ids is null; the `most` best ids.
    """

    def rank(block, queries):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(_FOUND)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if block.num_rows and queries.num_rows:
            order = np.argsort(block.column("id").to_numpy(), kind="stable")
            block = block.take(pa.array(order))
            ids, x = block.column("id").to_numpy(), _matrix(block.column("vec"), block.column("wide"))
            lengths = np.sqrt((x * x).sum(axis=1))
            asked, q = queries.column("asked").to_numpy(), _matrix(queries.column("vec"), queries.column("wide"))
            for j, met in enumerate(queries.column("ids").to_pylist()):
                if met is None:
                    rows = np.arange(len(ids))
                else:
                    met = np.unique(np.array(met, np.int64))
                    low, high = np.searchsorted(ids, met, "left"), np.searchsorted(ids, met, "right")
                    counts = high - low  # an id may have several vectors
                    rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                score = (x[rows] * q[j]).sum(axis=1) / (lengths[rows] * np.sqrt((q[j] * q[j]).sum()))
                best = np.lexsort((ids[rows], -score))
                _, first = np.unique(ids[rows][best], return_index=True)  # a repeated id once
                best = best[np.sort(first)][:most]
                out.append((np.full(len(best), asked[j]), ids[rows][best], np.clip(score[best], -1.0, 1.0)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.Table.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds)

    return rank


def search(vectors: DataFrame, is_query, key: str = "vec_id", column: str = "embedding", nearest: int = NEAREST, tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which is_query holds, the nearest other rows found.

    is_query: a condition on `key`, under the name id; probes: codes that a query looks up in each table.
    """
    most = nearest + 1  # as the query's own id goes
    own = checkpointed(usable(vectors, key, column).withColumn("hash", F.xxhash64("dim", "vec")))
    # of equal vectors the smallest ids; Spark limits groups before it deals them out
    named = own.select("id", "dim", "hash").distinct()
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("dim", "hash").orderBy("id"))).where(F.col("n") <= most).select("id", "dim", "hash")
    rows = checkpointed(own.dropDuplicates(["id", "dim", "hash"]).join(first, ["id", "dim", "hash"], "left_semi"))
    # columns of their own, as they meet the rows' again
    members = checkpointed(own.where(is_query(F.col("id"))).select(F.col("hash").alias("asked"), *[F.col(c).alias(c) for c in ("id", "dim", "wide", "vec")]))
    queries = checkpointed(members.dropDuplicates(["asked", "dim"]).select("asked", "dim", "wide", "vec"))
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # a row for each length of vector
    n_queries = queries.count()
    # written as dealt out: by the size of its queries alone Spark would take their many codes for a small table
    queries = checkpointed(queries.repartition(max(1, n_queries // 256), "asked"))
    lookups = {d: probes or probed_codes(n) for d, n in sizes.items()}
    blocks = max(1, -(-sum(sizes.values()) // BLOCK), min(sum(sizes.values()), n_queries * tables * max(lookups.values(), default=1) * BUCKET_ROWS // BLOCK_PAIRS))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    middle = centres(rows)
    posted = checkpointed(coded(rows, "id", sizes, tables, dict.fromkeys(sizes, 1), middle))
    posted, probed = chunked(posted, coded(queries, "asked", sizes, tables, lookups, middle), sizes)
    met = posted.join(probed, ["dim", "table", "code", "chunk"]).groupBy("asked", "dim", block).agg(F.collect_set("id").alias("ids"))  # ids of one block
    visits = met.join(queries, ["asked", "dim"]).select("dim", "block", "asked", "wide", "vec", "ids")
    everything = rows.select("dim", block, "id", "wide", "vec")
    rank = _ranker(most)

    def ranked(asked: DataFrame) -> DataFrame:
        return everything.groupBy("dim", "block").cogroup(asked.groupBy("dim", "block")).applyInArrow(lambda a, b: rank(a, b), _FOUND)

    found = checkpointed(ranked(visits))
    # the rest: queries with fewer finds than asked for, against everything in blocks
    enough = found.groupBy("asked").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= most).select("asked")
    short = queries.join(enough, "asked", "left_anti").select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "asked", "wide", "vec", F.lit(None).cast("array<bigint>").alias("ids"))
    scores = found.unionByName(ranked(short)).groupBy("asked", "vec_id").agg(F.max("score").alias("score"))
    by_vector = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    top = scores.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= most).select("asked", "vec_id", "score")
    each = members.select("asked", F.col("id").alias("query_id")).distinct().join(top, "asked").where("vec_id <> query_id")
    best = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id may have asked with several vectors
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector whose id is divisible by 50, the five nearest others."""
    return search(read(spark, sf_dir, "embeddings"), lambda key: key % 50 == 0)
