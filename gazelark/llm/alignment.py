"""Alignment of two tokenizers' tokens, and how often their ids are linked in a corpus.

Tokens of both sides whose bytes overlap are joined by an edge; union-find over this bipartite graph
gives the connected components, which are exactly the least groups that begin and end together.
All texts of a slice go through it at once, as texts share no bytes. In each component every token
of one side is linked with every one of the other; equal ids of a large component are counted first
and multiplied, so that its occurrences are not expanded.

Counting is distributed: the distinct pairs of a block of documents are a dictionary, with the number
of its documents that hold each; the dictionaries are added up by pair. A document keeps places in
its block's dictionary, so that the counts come back to a block and not to each document: what is
joined by pair has a row for a block, however many documents hold the pair.

Edge cases: a text has no tokens if it is null, empty, or if a side's bytes differ from it (with the
blank in front); its numbers are 0 and its groups ''. Texts of any length are aligned whole; each
row counts as a document, also where rows or ids are repeated; a null doc_id stays null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazelark.llm import packing
from gazelark.llm.pair_index import BYTES
from gazelark.llm.tables import map_texts, read
from gazelark.shared import shared_folder

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE_CHARS = 500_000
BLOCK_CHARS = 8_000_000  # of the documents that share a dictionary
DICTIONARY_ROW = 50_000  # pairs in a row
EXPANDED = 1024  # links of a component that are expanded one by one


class LeftEncoder(packing.Encoder):
    """A byte-level tokenizer's ids of a blank and the text; special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.pieces[i] = bytes(map(BYTES.__getitem__, token))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            try:
                own = self.ranks.encode_to_numpy(" " + text, allowed_special=set(), disallowed_special=()) if self.ranks else None
            except ValueError:  # the pattern's matcher is out of room
                own = None
            if own is None:
                own = self.tokenizer.encode(" " + text, add_special_tokens=False).ids
            out.append(np.asarray(own, np.int64))
        return out


class RightEncoder:
    """A model of pieces that puts the blank in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        named = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(own, np.int64) for own in self.model.encode(texts, num_threads=1)]


_encoders: dict[str, LeftEncoder | RightEncoder] = {}


def encoder(name: str) -> LeftEncoder | RightEncoder:
    """One for each file and Python worker. name: a public tokenizer's name or a path."""
    if name not in _encoders:
        import public_tokenizers

        path = name if os.sep in name else public_tokenizers.path(name)
        _encoders[name] = LeftEncoder(path) if name.endswith(".json") else RightEncoder(path)
    return _encoders[name]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches along the edges (a, b).

    Union-find over all edges at once: the root of an edge's one end is hung below the lesser root of
    the other, then paths are shortened to their roots; edges within one tree go.
    """
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above
    return root


class Aligned:
    """Tokens of both sides of some texts, laid end to end, with the group of each."""

    def __init__(self, texts: list[str | None], left: str, right: str):
        a, b = encoder(left), encoder(right)
        given = [i for i, t in enumerate(texts) if t]
        pairs = dict(zip(given, zip(a.ids([texts[i] for i in given]), b.ids([texts[i] for i in given]))))
        none = np.empty(0, np.int64)
        self.a, self.b = [none] * len(texts), [none] * len(texts)
        for i, (x, y) in pairs.items():
            whole = (" " + texts[i]).encode()
            if b"".join(map(a.pieces.__getitem__, x.tolist())) == whole == b"".join(map(b.pieces.__getitem__, y.tolist())):
                self.a[i], self.b[i] = x, y
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (self.a, self.b))
        self.from_a, self.from_b = (np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b))
        self.ids_a, self.ids_b = (np.concatenate([none, *side]) for side in (self.a, self.b))
        ends_a, ends_b = (np.cumsum(_lengths(e)[ids]) for e, ids in ((a, self.ids_a), (b, self.ids_b)))
        # between two neighbouring ends of either side lies one token of each: an edge
        ends = np.union1d(ends_a, ends_b)
        over_a, over_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        root = components(len(ends_a) + len(ends_b), over_a, over_b + len(ends_a))
        # the least node of a component is its first token of the left side, so groups are in the text's order
        group = np.cumsum(root[: len(ends_a)] == np.arange(len(ends_a))) - 1
        self.group_a, self.group_b = group[root[: len(ends_a)]], group[root[len(ends_a) :]]
        groups = int(group[-1]) + 1 if len(group) else 0
        self.in_a, self.in_b = (np.bincount(g, minlength=groups) for g in (self.group_a, self.group_b))
        self.first_a, self.first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (self.in_a, self.in_b))
        starts = np.append(self.group_a, groups)[self.from_a] if groups else np.zeros(len(self.from_a), np.int64)
        self.groups = starts  # of text i: groups[i] to groups[i + 1]

    def group_strings(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text: the ids of its groups in order."""
        group = np.concatenate([self.group_a, self.group_b])
        right = np.repeat([0, 1], [len(self.group_a), len(self.group_b)])
        order = np.argsort(group, kind="stable")
        group, right = group[order], right[order]
        mark = np.full(len(order), _COMMA)
        if len(order):
            mark[1:][right[1:] != right[:-1]] = _BAR
            mark[1:][group[1:] != group[:-1]] = _SEMICOLON
        bounds = self.from_a + self.from_b
        mark[bounds[:-1][np.diff(bounds) > 0]] = _NOTHING
        ids = np.concatenate([self.ids_a, self.ids_b])[order]
        strings = _marked(int(ids.max(initial=0)) + 1)[mark, ids].tolist()
        return ["".join(strings[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def links(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(distinct pairs in ascending order, links of each) of each text; a pair is `left id << 32 | right id`."""
        size = self.in_a * self.in_b
        small = np.flatnonzero(size <= EXPANDED)
        n = size[small]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.repeat(small, n)
        i, j = self.first_a[own] + at // self.in_b[own], self.first_b[own] + at % self.in_b[own]
        pairs = self.ids_a[i] << 32 | self.ids_b[j]
        text = np.searchsorted(self.groups[1:], own, "right")
        bounds = np.searchsorted(text, np.arange(len(self.a) + 1))
        large: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for g in np.flatnonzero(size > EXPANDED).tolist():
            x, nx = np.unique(self.ids_a[self.first_a[g] : self.first_a[g + 1]], return_counts=True)
            y, ny = np.unique(self.ids_b[self.first_b[g] : self.first_b[g + 1]], return_counts=True)
            product = ((x[:, None] << 32 | y).ravel(), (nx[:, None] * ny).ravel())
            large.setdefault(int(np.searchsorted(self.groups[1:], g, "right")), []).append(product)
        out = []
        for k in range(len(self.a)):
            found, counts = np.unique(pairs[bounds[k] : bounds[k + 1]], return_counts=True)
            if k in large:
                both = [(found, counts), *large[k]]
                found, inverse = np.unique(np.concatenate([p for p, _ in both]), return_inverse=True)
                counts = np.zeros(len(found), np.int64)
                np.add.at(counts, inverse, np.concatenate([c for _, c in both]))
            out.append((found, counts))
        return out

    def n_links(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.in_a * self.in_b)])
        return total[self.groups[1:]] - total[self.groups[:-1]]


_NOTHING, _COMMA, _BAR, _SEMICOLON = range(4)
_tables: dict[object, np.ndarray] = {}


def _marked(least: int) -> np.ndarray:
    """(mark, id) -> the mark and the id as a string."""
    if _tables.get("strings", np.empty((4, 0))).shape[1] < least:
        size = max(least, 1 << 16)
        _tables["strings"] = np.array([[f"{m}{i}" for i in range(size)] for m in ("", ",", "|", ";")], object)
    return _tables["strings"]


def _lengths(own: LeftEncoder | RightEncoder) -> np.ndarray:
    if own not in _tables:
        _tables[own] = np.array([len(p) for p in own.pieces], np.int64)
    return _tables[own]


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", left: str = LEFT, right: str = RIGHT) -> DataFrame:
    """key, left_ids, left_groups, right_ids, right_groups: the tokens of each text, and the number in the text of each one's group."""
    kind = T.ArrayType(T.LongType())
    fields = [T.StructField(n, kind) for n in ("left_ids", "left_groups", "right_ids", "right_groups")]

    def compute(texts: list[str | None]) -> list[list]:
        own = Aligned(texts, left, right)
        bounds_a, bounds_b = own.from_a[1:-1], own.from_b[1:-1]
        first = own.groups[:-1]
        numbered = lambda groups, bounds: [g - f for g, f in zip(np.split(groups, bounds), first)]
        return [own.a, numbered(own.group_a, bounds_a), own.b, numbered(own.group_b, bounds_b)] if texts else [[], [], [], []]

    return map_texts(docs, key, text, fields, compute, SLICE_CHARS)


_LONGS = T.ArrayType(T.LongType())
_OWN = [
    T.StructField("n_a", T.LongType()),
    T.StructField("n_b", T.LongType()),
    T.StructField("n_groups", T.LongType()),
    T.StructField("n_links", T.LongType()),
    T.StructField("groups_sha256", T.StringType()),
]
#: A row is a document (gaps between its places in the dictionary, links of each), or a part of a block's dictionary (pairs, documents with each).
_PARTS = [T.StructField("block", T.LongType()), T.StructField("from", T.LongType()), T.StructField("pairs", _LONGS), T.StructField("held", _LONGS), T.StructField("gaps", T.ArrayType(T.IntegerType())), T.StructField("links", _LONGS)]


def _lists(arrays: list[np.ndarray], kind):
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate([np.empty(0, np.int64), *arrays])
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind.value_type, safe=True)).cast(kind)


def _blocks(docs: DataFrame, key: str, text: str, left: str, right: str) -> DataFrame:
    """The documents' own numbers and their places, and the dictionaries, in blocks of neighbouring documents."""
    chosen = docs.select(F.struct(F.col(key)).alias("doc"), F.col(text).alias("text"))
    schema = T.StructType([*_PARTS, T.StructField("doc", chosen.schema[0].dataType), *_OWN])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        block, chars = TaskContext.get().partitionId() << 32, 0
        keys: list = []
        rows: list[tuple] = []
        links: list[tuple[np.ndarray, np.ndarray]] = []

        def filled(n: int, columns: dict):
            return pa.RecordBatch.from_arrays([columns[k.name] if k.name in columns else pa.nulls(n, k.type) for k in kinds], schema=kinds)

        def parts():
            """The block's dictionary, then its documents."""
            dictionary, held = np.unique(np.concatenate([np.empty(0, np.int64), *[p for p, _ in links]]), return_counts=True)
            for a in range(0, len(dictionary), DICTIONARY_ROW):
                row = {"block": pa.array([block]), "from": pa.array([a]), "pairs": _lists([dictionary[a : a + DICTIONARY_ROW]], kinds.field("pairs").type), "held": _lists([held[a : a + DICTIONARY_ROW]], kinds.field("held").type)}
                yield filled(1, row)
            docs_of = pa.concat_arrays(keys)
            for a in range(0, len(rows), 256):
                own = links[a : a + 256]
                row = {"block": pa.array(np.full(len(own), block)), "doc": docs_of[a : a + 256].cast(kinds.field("doc").type)}
                row["gaps"] = _lists([np.diff(np.searchsorted(dictionary, p), prepend=0) for p, _ in own], kinds.field("gaps").type)
                row["links"] = _lists([c for _, c in own], kinds.field("links").type)
                for f, values in zip(_OWN, zip(*rows[a : a + 256])):
                    row[f.name] = pa.array(values, kinds.field(f.name).type)
                yield filled(len(own), row)

        for batch in batches:
            sizes, at = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist(), 0
            while at < len(sizes):
                end, some = at, 0
                while end < len(sizes) and (end == at or some + sizes[end] <= SLICE_CHARS):
                    some += sizes[end]
                    end += 1
                own = Aligned(batch.column(1)[at:end].to_pylist(), left, right)
                digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in own.group_strings()]
                rows += zip(own.n_a.tolist(), own.n_b.tolist(), np.diff(own.groups).tolist(), own.n_links().tolist(), digests)
                links += own.links()
                keys.append(batch.column(0)[at:end])
                chars, at = chars + some, end
                if chars >= BLOCK_CHARS:
                    yield from parts()
                    block, chars = block + 1, 0
                    keys, rows, links = [], [], []
        if rows:
            yield from parts()

    return chosen.mapInArrow(run, schema)


def pair_counts(parts: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked), best (whether none of its left id is higher)."""
    held = parts.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "held")).alias("p"))
    counts = held.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("count"))
    left = F.shiftright("pair", 32)
    highest = counts.groupBy(left.alias("left_id")).agg(F.max("count").alias("highest"))
    return counts.join(highest, left == F.col("left_id")).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _scored(docs, dictionary):
    """A block's documents with the sums over their links; dictionary: place, count, best of the block's pairs."""
    import pyarrow as pa

    if not docs.num_rows:
        return pa.table({n: [] for n in ("doc", *[f.name for f in _OWN], "n_best", "count_sum")})
    size = dictionary.num_rows
    counts, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    place = dictionary.column("place").to_numpy()
    counts[place], best[place] = dictionary.column("count").to_numpy(), dictionary.column("best").to_numpy()
    n_best, sums = [], []
    for chunk_gaps, chunk_links in zip(docs.column("gaps").chunks, docs.column("links").chunks):
        for gaps, links in zip(chunk_gaps, chunk_links):
            at, own = np.cumsum(gaps.values.to_numpy(zero_copy_only=False)), links.values.to_numpy(zero_copy_only=False)
            n_best.append(int((own * best[at]).sum()) if len(at) else 0)
            sums.append(int((own * counts[at]).sum()) if len(at) else 0)
    kept = docs.select(["doc", *[f.name for f in _OWN]])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", left: str = LEFT, right: str = RIGHT) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    count_sum: over a document's links, how many documents hold their pair linked; n_best: its links
    whose pair no other of the same left id exceeds in that.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    blocks = _blocks(docs, key, text, left, right)
    blocks.write.option("compression", "zstd").parquet(folder)
    parts, own = (spark.read.schema(blocks.schema).parquet(folder) for _ in range(2))  # twice, as they meet
    counts = pair_counts(parts)
    each = parts.where("pairs IS NOT NULL").select("block", "from", F.posexplode("pairs").alias("at", "pair"))
    found = each.join(counts, "pair").select("block", (F.col("from") + F.col("at")).alias("place"), "count", F.col("best").cast("long").alias("best"))
    own = own.where("doc IS NOT NULL").select("block", "doc", *[f.name for f in _OWN], "gaps", "links")
    schema = T.StructType([own.schema["doc"], *_OWN, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    scored = own.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_scored, schema)
    return scored.select(f"doc.{key}", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of both tokenizers aligned, and their links counted over all documents."""
    return linked(read(spark, sf_dir, "documents"))
