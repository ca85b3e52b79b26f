"""Packing along a space-filling curve.

A document's token counts are hashed to a vector, scaled to unit length and projected to three
fixed random directions; the Hilbert key of the projection range-sorts the documents, and each
range is packed as one stream, so that neighbours on the curve share sequences. The ranges begin
at quantiles of (key, tie) over a sample of RANGE_SAMPLE documents a range; the tie, a hash of id,
text and the row's place in the input, cuts a large group of copies, also of rows that are repeated
as a whole. The sample's size decides how even the ranges are, and nothing else: every document is
packed. Over the same files and number of ranges it is the same sample, so that sequence_id is
reproducible; for the same reason docs should come from files or a written table, whose rows have
the same places when a task is repeated, and not straight from a shuffle.

Whole sequences of a document's own tokens are cut off first; what is left (under a sequence) joins
the stream, which is cut where a sequence is full. The open end of a range is cut into powers of
two. So no sequence is padded, and no position needs to be known outside its range.

Edge cases: a null or empty text is the end token alone; texts of any length are cut as long as
they are; repeated rows are packed each; an empty table gives an empty result; other columns are
ignored; a null doc_id stays null.
"""

from __future__ import annotations

import base64
import os
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazelark.llm.tables import map_texts, read, shuffle_partitions

SEQUENCE = 1024
END = 0
TOKENIZER = "byte_bpe_50k.json"
VECTOR_SIZE, DIMENSIONS, BITS = 4096, 3, 16
RANGE_SAMPLE = 40


class Encoder:
    """A tokenizer's ids, by its own library or by the same vocabulary as ranks, which is faster.

    The ranks are used where the file has a sibling of them (checked against the tokenizer when
    loaded, and over whole tables in the tests); a text whose runs of blanks their pattern can't
    match goes to the tokenizer, which gives the same ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = self._from_ranks(path.removesuffix(".json") + ".tiktoken")

    def _from_ranks(self, path: str):
        if not os.path.exists(path):
            return None
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        out = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        probe = "It's 12 o'clock,\n\n  \u00e9t\u00e9  \u4e2d\t" + "".join(special) + " x \x1c y"
        same = out.encode(probe, allowed_special="all") == self.tokenizer.encode(probe, add_special_tokens=False).ids
        return out if same else None

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            try:
                ids = self.ranks.encode_to_numpy(text, allowed_special="all") if self.ranks else None
            except ValueError:  # the pattern's matcher is out of room
                ids = None
            if ids is None:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids)
            out.append(ids.astype("<u4").tobytes())
        return out


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One for each tokenizer file and Python worker. name: a public tokenizer's name or a path."""
    if name not in _encoders:
        import public_tokenizers

        _encoders[name] = Encoder(name if os.sep in name else public_tokenizers.path(name))
    return _encoders[name]


def _projection() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(5))
    return rng.integers(0, VECTOR_SIZE, 1 << 16), rng.standard_normal((VECTOR_SIZE, DIMENSIONS))


_BUCKET, _DIRECTIONS = _projection()


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of integer points (rows, each coordinate of `bits` bits) along the Hilbert curve."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_points(ids: list[np.ndarray]) -> np.ndarray:
    """Quantised projections of hashed unit vectors; 16 bits over four standard deviations each way."""
    out = np.empty((len(ids), DIMENSIONS))
    for i, own in enumerate(ids):
        v = np.sqrt(np.bincount(_BUCKET[(own ^ (own >> 16)) & 0xFFFF], minlength=VECTOR_SIZE))
        out[i] = v @ _DIRECTIONS / np.sqrt((v * v).sum())
    return np.clip((out + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def _ids_and_keys(name: str, texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    raw = [b + END.to_bytes(4, "little") for b in encoder(name)([t or "" for t in texts])]
    return raw, hilbert_keys(document_points([np.frombuffer(b, "<u4") for b in raw]))


_PLACE = np.dtype([("key", "<i8"), ("tie", "<i8")])


def _places(keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
    out = np.empty(len(keys), _PLACE)
    out["key"], out["tie"] = keys, ties
    return out


def _range_starts(own: DataFrame, tokenizer: str, ranges: int) -> np.ndarray:
    """(key, tie) at which the second to the last range begin. At most about RANGE_SAMPLE pairs of
    numbers a range reach the driver. own: rows (own: struct(key, tie), text)."""
    wanted = RANGE_SAMPLE * ranges
    share = min(1.0, wanted / max(1, own.count()))
    chosen = own if share == 1.0 else own.where(F.rand(5) < share)
    fields = [T.StructField("curve_key", T.LongType())]
    found = map_texts(chosen, "own", "text", fields, lambda texts: [_ids_and_keys(tokenizer, texts)[1].tolist()]).select("curve_key", "own.tie").toArrow()
    places = np.sort(_places(found.column(0).to_numpy(), found.column(1).to_numpy()), order=["key", "tie"])
    return places[(np.arange(1, ranges) * len(places)) // ranges] if len(places) else places


def _narrow(ids: bytes) -> bytes:
    """Ids of 32 bits in two bytes each where all of them fit."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if wide.max(initial=0) < 1 << 16 else ids


def _widened(ids: bytes, n: int) -> bytes:
    """The n ids that _narrow() was given."""
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(ids) == 2 * n else ids


def _tokenised(name: str, sequence: int, shared):
    def compute(texts: list[str | None], ties: np.ndarray) -> list[list]:
        raw, keys = _ids_and_keys(name, texts)
        size = sequence * 4
        full = [len(b) // size for b in raw]
        return [
            np.searchsorted(shared.value, _places(keys, ties), "right").tolist(),
            keys.tolist(),
            [len(b) // 4 for b in raw],
            [[zlib.crc32(b[k * size : (k + 1) * size]) for k in range(n)] for b, n in zip(raw, full)],
            [_narrow(b[n * size :]) for b, n in zip(raw, full)],
        ]

    return compute


_TOKENISED = [
    T.StructField("range", T.IntegerType()),
    T.StructField("curve_key", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("full_crcs", T.ArrayType(T.LongType())),
    T.StructField("rest", T.BinaryType()),
]
_PIECE = [
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
]


class _Stream:
    """Sequences of one range, numbered from its own base."""

    def __init__(self, base: int, sequence: int):
        self.next, self.sequence = base, sequence
        self.open: list[tuple[object, int, bytes, int]] = []  # doc, start, ids as 32 bits, document's tokens
        self.filled = 0
        self.rows: list[tuple] = []

    def close(self) -> None:
        offset = 0
        for doc, start, ids, tokens in self.open:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), tokens, self.next, offset))
            offset += n
        self.next += 1
        self.open, self.filled = [], 0

    def add(self, doc, start: int, ids: bytes, tokens: int, limit: int) -> None:
        while ids:
            part = ids[: (limit - self.filled) * 4]
            self.open.append((doc, start, part, tokens))
            self.filled += len(part) // 4
            start += len(part) // 4
            ids = ids[len(part) :]
            if self.filled == limit:
                self.close()

    def document(self, doc, tokens: int, crcs: list[int], rest: bytes) -> None:
        for k, crc in enumerate(crcs):
            self.rows.append((doc, k * self.sequence, self.sequence, crc, tokens, self.next, 0))
            self.next += 1
        start = len(crcs) * self.sequence
        self.add(doc, start, _widened(rest, tokens - start), tokens, self.sequence)

    def finish(self) -> None:
        left, pieces = self.filled, self.open
        self.open, self.filled = [], 0
        at = iter(pieces)
        doc, start, ids, tokens = next(at, (None, 0, b"", 0))
        for power in (1 << b for b in range(self.sequence.bit_length() - 1, -1, -1) if left >> b & 1):
            room = power
            while room:
                take = min(room, len(ids) // 4)
                self.add(doc, start, ids[: take * 4], tokens, power)
                start, ids, room = start + take, ids[take * 4 :], room - take
                if not ids:
                    doc, start, ids, tokens = next(at, (None, 0, b"", 0))

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, sequence: int = SEQUENCE) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece.

    sequence must be a power of two; ids are those of any tokenizer, up to 32 bits.
    """
    ranges = shuffle_partitions(docs.sparkSession)
    own = docs.select(F.struct(F.col(key).alias("doc"), F.xxhash64(key, text, F.monotonically_increasing_id()).alias("tie")).alias("own"), F.col(text).alias("text"))
    starts = docs.sparkSession.sparkContext.broadcast(_range_starts(own, tokenizer, ranges))  # 16 bytes a range
    tokens = map_texts(own, "own", "text", _TOKENISED, _tokenised(tokenizer, sequence, starts), beside="tie")
    ordered = tokens.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "curve_key", "own.tie")
    narrow = ordered.select("range", F.col("own.doc").alias(key), "doc_tokens", "full_crcs", "rest")
    schema = T.StructType([narrow.schema[1], *_PIECE])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        stream, at = _Stream(0, sequence), None

        def out():
            columns = list(zip(*stream.drain()))
            return [pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds)] if columns else []

        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                for place, doc, n, crcs, rest in zip(*[c.to_pylist() for c in batch[a : a + 1000].columns]):
                    if place != at:
                        stream.finish()
                        at, stream.next = place, place << 40
                    stream.document(doc, n, crcs, rest)
                yield from out()
        stream.finish()
        yield from out()

    return narrow.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 1,024 tokens."""
    return pack(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents handed over."""
    return pack(docs)
