"""Product codes of vectors by integer Lloyd rounds with Hamerly's bounds.

Components become whole numbers (floor of SCALE times each), vectors are cut into PARTS equal parts,
and each part position has a codebook of its own, which begins with the parts of the vectors of the
ENTRIES smallest ids. A round assigns every part to its nearest entry (the lower index of equals) and
moves each entry to the floor of its parts' mean; after the last round the parts are assigned again.

Each part keeps one upper bound of the distance to its entry and one lower bound of the distance to
the second nearest; both are written with the assignment and change by as much as the entries have
moved since. Only where the upper bound is not strictly below the lower one is the exact distance
taken, and where that isn't either, all entries are compared, in whole numbers. So a part that is
passed over has one strictly nearest entry, its own, and ties go to the lower index as ever. Bounds
are rounded outwards to 32 bits.

Codebooks have a fixed size and go to all tasks; sums of a round are added up in each task first. Sums
of errors by label are joined to the rows: labels of more than a HOT_SHARE-th of all rows are fewer
than HOT_SHARE, so these sums are broadcast, and the other labels are shuffled.

Edge cases: vectors that are null or hold null or non-finite components go, as do empty ones and those
whose length is no multiple of PARTS; vectors of different lengths have codebooks apart; components
beyond LIMIT after scaling count as LIMIT, so that sums are exact in 64 bits; a null id is never
among the smallest, repeated ids count once there (with the smallest vector) and are coded each;
fewer ids than ENTRIES give as many entries; an empty table gives an empty result; other columns,
but for the label, are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazelark.llm.tables import read
from gazelark.shared import remove_folder, shared_folder

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 2**26
HOT_SHARE = 200
TOGETHER = 4096  # vectors that numpy works on at once


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * x.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows of parts to rows of a codebook, in whole numbers."""
    out = np.zeros((len(parts), len(book)), np.int64)
    for k in range(parts.shape[1]):
        d = parts[:, k, None] - book[:, k]
        out += d * d
    return out


def _up(x: np.ndarray) -> np.ndarray:
    """At least x as 32 bits, whatever x was rounded to in 64."""
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def scan(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, the lower index of equals; upper bound; lower bound of the second nearest)."""
    d = distances(parts, book)
    rows, nearest = np.arange(len(d)), d.argmin(axis=1)
    own = d[rows, nearest].astype(np.float64)
    if len(book) > 1:
        d[rows, nearest] = np.iinfo(np.int64).max
        second = _down(np.sqrt(d.min(axis=1).astype(np.float64)))
    else:
        second = np.full(len(d), np.float32(np.inf))
    return nearest.astype(np.uint8), _up(np.sqrt(own)), second


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry of each codebook has moved, rounded up. old, new: [parts, entries, numbers]."""
    d = new - old
    return _up(np.sqrt((d * d).sum(axis=2).astype(np.float64)))


def reassign(parts: np.ndarray, book: np.ndarray, shift: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """One part position after its entries moved by shift; changes entry and bounds in place and gives the number of full scans."""
    order = np.sort(shift)
    most, second = order[-1], order[-2] if len(order) > 1 else np.float32(0)
    widest = np.flatnonzero(shift == most)
    others = np.where((entry == widest[0]) if len(widest) == 1 else False, second, most)  # no other entry moved further
    upper[:] = _up(upper.astype(np.float64) + shift[entry])
    lower[:] = _down(lower.astype(np.float64) - others)
    open_ = np.flatnonzero(upper >= lower)
    if len(open_):
        d = parts[open_] - book[entry[open_]]
        upper[open_] = _up(np.sqrt((d * d).sum(axis=1).astype(np.float64)))
        open_ = open_[upper[open_] >= lower[open_]]
    if len(open_):
        entry[open_], upper[open_], lower[open_] = scan(parts[open_], book)
    return len(open_)


@dataclass
class Codebooks:
    """Of each vector length: the entries, and how far they moved in the last round."""

    books: dict[int, np.ndarray]
    shifts: dict[int, np.ndarray] | None = None

    def digest(self, dim: int) -> str:
        return hashlib.sha256(",".join(map(str, self.books[dim].ravel().tolist())).encode()).hexdigest()


_ROW = [T.StructField("dim", T.IntegerType()), T.StructField("vec", T.BinaryType())]
_STATE = [T.StructField("entry", T.BinaryType()), T.StructField("upper", T.BinaryType()), T.StructField("lower", T.BinaryType())]


def _pack(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers in as few bytes as all of them need."""
    most = int(np.abs(x).max(initial=0))
    kind = "<i2" if most < 2**15 else "<i4"
    return [r.tobytes() for r in x.astype(kind)]


def _unpack(column, dim: int) -> np.ndarray:
    return np.array([np.frombuffer(v, "<i2" if len(v) == 2 * dim else "<i4") for v in column.to_pylist()], np.int64).reshape(len(column), dim)


def usable(vectors: DataFrame, column: str, keep: list) -> DataFrame:
    """The columns `keep` as a struct own, dim and vec (whole numbers' bytes) of the vectors that take part."""
    chosen = vectors.select(F.struct(*keep).alias("own"), F.col(column).cast("array<double>").alias("given")).where("given IS NOT NULL")
    schema = T.StructType([chosen.schema["own"], *_ROW])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            given = batch.column(1)
            values, offsets = given.values.to_numpy(zero_copy_only=False), given.offsets.to_numpy()
            sizes = np.diff(offsets)
            for dim in np.unique(sizes[(sizes > 0) & (sizes % PARTS == 0)]).tolist():
                rows = np.flatnonzero(sizes == dim)
                x = values[offsets[rows][:, None] + np.arange(dim)]
                fine = np.isfinite(x).all(axis=1)  # nulls are not-a-number here
                rows, x = rows[fine], x[fine]
                if len(rows):
                    own = batch.column(0).take(pa.array(rows)).cast(kinds[0].type)
                    yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(rows), dim, np.int32)), pa.array(_pack(whole_numbers(x)), pa.binary())], schema=kinds)

    return chosen.mapInArrow(run, schema)


def first_codebooks(rows: DataFrame, key: str) -> Codebooks:
    """Of each length the parts of the vectors of the smallest ids: at most ENTRIES vectors a length reach the driver."""
    from pyspark.sql import Window

    keyed = rows.select(F.col(f"own.{key}").alias("key"), "dim", "vec").where("key IS NOT NULL")
    once = keyed.groupBy("dim", "key").agg(F.min("vec").alias("vec"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("dim").orderBy("key"))).where(F.col("n") <= ENTRIES)
    books: dict[int, list[np.ndarray]] = {}
    for r in ranked.orderBy("dim", "key").collect():
        raw = np.frombuffer(r["vec"], "<i2" if len(r["vec"]) == 2 * r["dim"] else "<i4")
        books.setdefault(r["dim"], []).append(raw.astype(np.int64))
    return Codebooks({d: np.array(b).reshape(len(b), PARTS, d // PARTS).transpose(1, 0, 2).copy() for d, b in books.items()})


def _batches_of(batch, dims: np.ndarray):
    """(length, rows) of a batch, TOGETHER at most."""
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        for a in range(0, len(rows), TOGETHER):
            yield dim, rows[a : a + TOGETHER]


def assigned(rows: DataFrame, shared) -> DataFrame:
    """own, dim, vec, entry, upper, lower: every part with its entry and bounds; by bounds where rows have them."""
    schema = T.StructType([rows.schema["own"], *_ROW, *_STATE])
    bounded = "entry" in rows.columns

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, codebooks = to_arrow_schema(schema), shared.value
        for batch in batches:
            for dim, at in _batches_of(batch, batch.column(1).to_numpy()):
                part = batch.take(pa.array(at))
                n, book = len(at), codebooks.books[dim]
                x = _unpack(part.column(2), dim).reshape(n, PARTS, -1)
                if bounded:
                    entry, upper, lower = (np.frombuffer(b"".join(part.column(k).to_pylist()), kind).reshape(n, PARTS).copy() for k, kind in ((3, np.uint8), (4, "<f4"), (5, "<f4")))
                    for p in range(PARTS):
                        own = [np.ascontiguousarray(c[:, p]) for c in (entry, upper, lower)]
                        reassign(x[:, p], book[p], codebooks.shifts[dim][p], *own)
                        entry[:, p], upper[:, p], lower[:, p] = own
                else:
                    entry, upper, lower = np.empty((n, PARTS), np.uint8), np.empty((n, PARTS), "<f4"), np.empty((n, PARTS), "<f4")
                    for p in range(PARTS):
                        entry[:, p], upper[:, p], lower[:, p] = scan(x[:, p], book[p])
                state = [pa.array([r.tobytes() for r in c], pa.binary()) for c in (entry, upper, lower)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(kinds[0].type), part.column(1), part.column(2), *state], schema=kinds)

    return rows.mapInArrow(run, schema)


_SUMS = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())])


def moved_codebooks(state: DataFrame, codebooks: Codebooks) -> Codebooks:
    """Each entry at the floor of its parts' mean; a task adds up its own parts and gives a row for each entry."""
    sizes = {d: b.shape for d, b in codebooks.books.items()}

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(_SUMS)
        sums = {d: np.zeros((p * e, n), np.int64) for d, (p, e, n) in sizes.items()}
        counts = {d: np.zeros(p * e, np.int64) for d, (p, e, n) in sizes.items()}
        for batch in batches:
            for dim, at in _batches_of(batch, batch.column(0).to_numpy()):
                part = batch.take(pa.array(at))
                x = _unpack(part.column(1), dim).reshape(len(at) * PARTS, -1)
                slot = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(at), PARTS) + np.arange(PARTS) * sizes[dim][1]
                order = np.argsort(slot.ravel(), kind="stable")
                own, first, n = np.unique(slot.ravel()[order], return_index=True, return_counts=True)
                sums[dim][own] += np.add.reduceat(x[order], first, axis=0)
                counts[dim][own] += n
        for dim in sizes:
            used = np.flatnonzero(counts[dim])
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), dim, np.int32)), pa.array(used.astype(np.int32)), pa.array(list(sums[dim][used]), kinds[2].type), pa.array(counts[dim][used])], schema=kinds)

    partial = state.select("dim", "vec", "entry").mapInArrow(run, _SUMS)
    one = partial.select("dim", "entry", "n", F.posexplode("sums").alias("at", "sum"))
    total = one.groupBy("dim", "entry", "at").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    books = {d: b.copy() for d, b in codebooks.books.items()}
    flat = {d: b.reshape(-1, b.shape[2]) for d, b in books.items()}
    for r in total.collect():  # as many rows as the codebooks have numbers
        flat[r["dim"]][r["entry"], r["at"]] = r["sum"] // r["n"]
    return Codebooks(books, {d: np.array([moved(codebooks.books[d][p : p + 1], books[d][p : p + 1])[0] for p in range(PARTS)]) for d in books})


@dataclass
class Coded:
    """rows: own, dim, code (hexadecimal digits by part), error (squared distances summed over parts)."""

    rows: DataFrame
    codebooks: Codebooks


_CODED = [T.StructField("dim", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", keep: list[str] = (), rounds: int = ROUNDS) -> Coded:
    """The codes of all vectors that take part, with the columns key and keep in the struct own, and the codebooks."""
    spark = vectors.sparkSession
    folder = f"{shared_folder(spark)}/vector-codes-{uuid.uuid4().hex}"
    step = lambda name: f"{folder}/{name}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(step(name))
        return spark.read.schema(df.schema).parquet(step(name))

    rows = written(usable(vectors, column, [key, *keep]), "whole")
    codebooks = first_codebooks(rows, key)
    state, before = rows, "whole"
    for r in range(rounds):
        state = written(assigned(state, spark.sparkContext.broadcast(codebooks)), f"round-{r}")
        remove_folder(spark, step(before))  # what was written now stands for it
        before = f"round-{r}"
        codebooks = moved_codebooks(state, codebooks)
    shared = spark.sparkContext.broadcast(codebooks)
    last = assigned(state, shared)
    schema = T.StructType([last.schema["own"], *_CODED])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, books = to_arrow_schema(schema), shared.value.books
        for batch in batches:
            for dim, at in _batches_of(batch, batch.column(1).to_numpy()):
                part = batch.take(pa.array(at))
                x = _unpack(part.column(2), dim).reshape(len(at), PARTS, -1)
                codes = part.column(3).to_pylist()
                entry = np.frombuffer(b"".join(codes), np.uint8).reshape(len(at), PARTS)
                d = x - books[dim][np.arange(PARTS), entry]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(kinds[0].type), part.column(1), pa.array([c.hex() for c in codes]), pa.array((d * d).sum(axis=(1, 2)))], schema=kinds)

    coded = written(last.select("own", "dim", "vec", "entry").mapInArrow(run, schema), "codes")
    remove_folder(spark, step(before))
    return Coded(coded, codebooks)


def decode(coded: Coded) -> DataFrame:
    """own, vec: the vectors that the codes stand for, each number the middle of its whole number's range."""
    shared = coded.rows.sparkSession.sparkContext.broadcast(coded.codebooks)
    schema = T.StructType([coded.rows.schema["own"], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            for dim, at in _batches_of(batch, batch.column(1).to_numpy()):
                part = batch.take(pa.array(at))
                entry = np.frombuffer(bytes.fromhex("".join(part.column(2).to_pylist())), np.uint8).reshape(len(at), PARTS)
                x = (shared.value.books[dim][np.arange(PARTS), entry].reshape(len(at), dim) + 0.5) / SCALE
                yield pa.RecordBatch.from_arrays([part.column(0).cast(kinds[0].type), pa.array(list(x), kinds[1].type)], schema=kinds)

    return coded.rows.select("own", "dim", "code").mapInArrow(run, schema)


def with_group_sums(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over the rows of the same `group`, nulls together."""
    sums = rows.groupBy(F.col(group).alias("_gz_group")).agg(F.sum(value).alias(name), F.count("*").alias("_gz_n"))
    total = rows.count()
    common = sums.where(F.col("_gz_n") * HOT_SHARE > total)  # fewer than HOT_SHARE rows
    met = rows.join(F.broadcast(common.select("_gz_group", name, F.lit(True).alias("_gz_hot"))), F.col(group).eqNullSafe(F.col("_gz_group")), "left").drop("_gz_group")
    rest = sums.where(F.col("_gz_n") * HOT_SHARE <= total).select("_gz_group", F.col(name).alias("_gz_sum"))
    hot = met.where("_gz_hot").drop("_gz_hot")
    cold = met.where("_gz_hot IS NULL").drop("_gz_hot", name).join(rest, F.col(group).eqNullSafe(F.col("_gz_group"))).withColumnRenamed("_gz_sum", name).drop("_gz_group")
    return hot.unionByName(cold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, its error, its label's error, and the digest of the codebooks."""
    coded = compress(read(spark, sf_dir, "embeddings"), keep=["label"])
    digests = F.lit(None).cast("string")
    for dim in coded.codebooks.books:
        digests = F.when(F.col("dim") == dim, coded.codebooks.digest(dim)).otherwise(digests)
    rows = coded.rows.select("own.vec_id", "own.label", "code", "error", digests.alias("codebooks_sha256"))
    return with_group_sums(rows, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
