"""MinHash near-duplicates by an inverted join on signature coordinates.

1. Every text's set of word shingles gives COORDINATES MinHash values. Texts of equal sets are one
   class from here on.
2. The (coordinate, value) pairs are counted. A pair of classes with at least MATCHES equal
   coordinates has one in common among each one's COORDINATES - MATCHES + 1 rarest (prefix), and
   values that only one class has are no use (skip): what is left is posted.
3. Of lists with the same members one is kept, by two hashes over the members: near-copies share most
   of their values. The lists are merged: within a list, the collisions of the member at hand with those not
   reached yet are counted over all coordinates, and those with MATCHES or more are linked.
   Components of these links are clusters: no pair above the match threshold lies in two of them.
4. Within a cluster the full sets, made from the texts again, are compared exactly.
5. Components of the confirmed links are the result.

Steps 3 and 4 work alike (links_in_groups): a list or cluster is cut into chunks of a fixed size.
First every chunk is merged together with the group's first member; members that it doesn't reach
then meet all chunks. Members of a reached group aren't compared with each other, so a group of
near-copies of any size costs one pass over it, and only the members unlike its first one (the
rest) cost rest x group. No list, cluster or group of copies is expanded into pairs or ever in
one task whole, and all pairs that could add a link are compared. A pair with similarity 0.8 has
fewer than MATCHES equal coordinates with probability 2e-4.

Edge cases: null, empty and wordless texts have the empty set and are linked with nothing;
repeated rows of a doc_id are reported each, and its texts' classes count as linked; a null doc_id
is linked with nothing, has a null component and is kept; an empty table gives an empty result;
texts of any length are taken whole; other columns are ignored. `stage` keeps different texts of
one doc_id apart: each is a document, and of those alike one row stays.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazelark.llm.components import connected_components
from gazelark.llm.shingles import shingle_sets, signature, signature_coefficients
from gazelark.llm.tables import checkpointed, map_texts, read
from gazelark.shared import remove_folder, shared_folder

COORDINATES, MATCHES, SEED = 64, 40, 7
LIST_CHUNK = 512  # members of a posting list in one task
CHUNK_SHINGLES = 25_000  # shingles of a cluster in one task, about
WIDTH, PERCENT = 2, 80  # the query's; operators and stages without a contract take five words
STAGE_WIDTH = 5

_FEATURES = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("set_key", T.BinaryType()),
    T.StructField("signature", T.BinaryType()),
]


def _features(width: int):
    def compute(texts: list[str | None]) -> list[list]:
        a, b = signature_coefficients(COORDINATES, SEED)
        sizes, keys, signatures = [], [], []
        for hashes in shingle_sets(texts, width):
            sizes.append(len(hashes))
            keys.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
            signatures.append(signature(hashes, a, b).astype("<u4").tobytes() if len(hashes) else None)
        return [sizes, keys, signatures]

    return compute


def _tokens(classes: DataFrame) -> DataFrame:
    """id, token: a 64-bit number for each coordinate and its value."""
    at = F.explode(F.sequence(F.lit(0), F.lit(COORDINATES - 1)))
    value = F.conv(F.hex(F.substring(F.col("signature"), F.col("at") * 4 + 1, F.lit(4))), 16, 10).cast("long")
    return classes.select("id", "signature", at.alias("at")).select("id", (F.col("at") * F.lit(2**32) + value).alias("token"))


def postings(classes: DataFrame) -> DataFrame:
    """id, token, df: each class's rarest pairs, but for those that no other class has."""
    tokens = _tokens(classes)
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(shared, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))  # at most COORDINATES a class
    room = F.lit(COORDINATES - MATCHES + 1 - COORDINATES) + F.size("shared")  # the prefix less the pairs of its own
    return ranked.where(room > 0).select("id", F.explode(F.slice("shared", F.lit(1), room)).alias("own")).select("id", "own.token", "own.df")


_LINK = T.StructType([T.StructField("team", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("near", T.BooleanType())])


def reached(n: int, links) -> np.ndarray:
    """The first member of each one's group. links(i, rest): which of the members `rest` are linked with i.

    A member is compared only with those that no group has yet.
    """
    group, rest, first = np.arange(n), np.arange(n), 0
    while len(rest):
        root = rest[0]
        rest, queue = rest[1:], [root]
        while queue and len(rest):
            hit = links(queue.pop(), rest)
            group[rest[hit]] = root
            queue.extend(rest[hit].tolist())
            rest = rest[~hit]
    return group


def _merger(prepare):
    """For Arrow tables (team, id, payload) of one team: a link from the first of each group to the others,
    and whether that is the first of the table.

    prepare(payloads) gives the function `links` of reached.
    """

    def merge(table):
        import pyarrow as pa

        ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
        team = table.column("team")[0].as_py()
        at = np.empty(0, np.int64)
        if len(ids) > 1:
            group = reached(len(ids), prepare(table.column("payload").take(pa.array(first)).to_pylist()))
            at = np.flatnonzero(group != np.arange(len(ids)))
        a = ids[group[at]] if len(at) else at
        return pa.Table.from_arrays([pa.array(np.full(len(at), team), pa.int64()), pa.array(a, pa.int64()), pa.array(ids[at], pa.int64()), pa.array(a == ids[0])], names=["team", "a", "b", "near"])

    return merge


def _by_signature(payloads: list[bytes]):
    """Linked by MATCHES or more equal coordinates."""
    signatures = np.frombuffer(b"".join(payloads), "<u4").reshape(len(payloads), COORDINATES)
    return lambda i, rest: (signatures[rest] == signatures[i]).sum(axis=1) >= MATCHES


def _by_sets(width: int, percent: int):
    """Linked by the exact similarity of the texts' shingle sets."""

    def prepare(payloads: list[str]):
        sets = list(shingle_sets(payloads, width))
        sizes = np.array([len(s) for s in sets])
        everything, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        by_hash = np.argsort(everything, kind="stable")
        everything, owner = everything[by_hash], owner[by_hash]

        def links(i: int, rest: np.ndarray) -> np.ndarray:
            low, high = np.searchsorted(everything, sets[i], "left"), np.searchsorted(everything, sets[i], "right")
            counts = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            both = np.bincount(owner[at], minlength=len(sets))[rest]
            return 100 * both >= percent * (sizes[i] + sizes[rest] - both)

        return links

    return prepare


def links_in_groups(rows: DataFrame, cut: DataFrame, prepare) -> DataFrame:
    """a, b: links that connect the members of each team as all its pairs would.

    rows: team, id, chunks (how many its team is cut into), payload; cut: those of them with more than one.
    """
    merge = _merger(prepare)
    at = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk")
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")

    # an exchange by all of the place: one by the team alone would do for Spark, and put a team in one task
    def merged(tasks: DataFrame, *place: str) -> DataFrame:
        return tasks.repartition(*place).groupBy(*place).applyInArrow(lambda table: merge(table), _LINK)

    cut = checkpointed(cut)
    tasks = rows.select("team", "id", at, "payload")
    if cut.isEmpty():
        return merged(tasks, "team", "chunk").select("a", "b")
    teams = checkpointed(cut.groupBy("team").agg(F.min("id").alias("root"), F.count("*").alias("n"), F.first("chunks").alias("chunks")))
    roots = teams.select("team", F.col("root").alias("id"))
    leading = cut.join(roots, ["team", "id"], "left_semi").select("team", "id", every, "payload")
    first = checkpointed(merged(tasks.unionByName(leading), "team", "chunk"))
    # of large teams, those unlike their first
    near = first.where("near").select("team", F.col("b").alias("id")).unionByName(roots)
    rest = checkpointed(cut.select("team", "id").join(near, ["team", "id"], "left_anti"))
    parts = rest.groupBy("team").agg(F.count("*").alias("left")).join(teams, "team").select("team", "chunks", F.ceil(F.col("left") * F.col("chunks") / F.col("n")).cast("int").alias("parts"))
    placed = parts.select("team", every, "parts")  # by chunk, so that no join deals by the team alone
    wide = cut.select("team", "id", at, "chunks", "payload").join(checkpointed(placed), ["team", "chunk"])
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int").alias("part")
    one = wide.select("team", "id", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "payload")
    other = wide.join(rest, ["team", "id"], "left_semi").select("team", "id", every, part, "payload")
    second = merged(one.unionByName(other), "team", "chunk", "part")
    return first.select("a", "b").unionByName(second.select("a", "b"))


def clusters(classes: DataFrame) -> DataFrame:
    """id, component: groups within which all pairs of classes above the match threshold lie."""
    posted = checkpointed(postings(classes).select("id", "token"))
    lists = posted.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("n > 1")
    kept = lists.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("n") / LIST_CHUNK).cast("int").alias("chunks"))
    posted = checkpointed(posted.join(kept, "token").select(F.col("token").alias("team"), "id", "chunks"))
    signatures = classes.select("id", F.col("signature").alias("payload"))
    links = links_in_groups(posted.join(signatures, "id"), posted.where("chunks > 1").join(signatures, "id"), _by_signature)
    return connected_components(checkpointed(links.distinct()))


def _grouped(docs: DataFrame, width: int, percent: int, key: str, text: str, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """(doc, n_shingles, set_key of every row; set_key, least, lead of every set that has several rows or
    links: the least doc_id of its component, and whether it is the set that stands for it).

    by_id: whether texts of one doc_id count as linked.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    made = map_texts(rows.select(F.struct("doc", "text_hash").alias("own"), "text"), "own", "text", _FEATURES, _features(width))
    features = checkpointed(made.select("own.*", *[f.name for f in _FEATURES]))
    members = features.where("set_key IS NOT NULL AND doc IS NOT NULL")
    whole = members.groupBy("set_key").agg(F.min(F.struct("doc", "text_hash")).alias("least"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("rows"))
    whole = checkpointed(whole.select("set_key", "least.*", "signature", "n_shingles", "rows"))
    # rows that share a doc_id: few in most tables, perhaps very many of one in others
    repeated = checkpointed(members.groupBy("doc").agg(F.count("*").alias("n"), F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("n > 1"))
    any_repeated = not repeated.isEmpty()
    # a class goes by its least doc_id; where that has several classes, all but one by a hash
    several = whole.groupBy("doc").agg(F.min("set_key").alias("own"), F.count("*").alias("n")).where("n > 1").select("doc", "own")
    named = whole.join(checkpointed(several), "doc", "left")
    classes = checkpointed(named.withColumn("id", F.when(F.col("set_key") != F.col("own"), F.xxhash64("set_key", "doc")).otherwise(F.col("doc"))).drop("own"))
    found = clusters(classes)
    sized = found.join(classes.select("id", "doc", "text_hash", "n_shingles"), "id")
    blocks = sized.groupBy("component").agg(F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES).cast("int").alias("chunks"), F.count("*").alias("n"))
    chosen = sized.join(blocks.where("n > 1"), "component").select("id", "doc", "text_hash", F.col("component").alias("team"), "chunks")
    folder = f"{shared_folder(docs.sparkSession)}/texts-{uuid.uuid4().hex}"
    wanted = rows.join(chosen, ["doc", "text_hash"]).select("team", "id", "chunks", F.col("text").alias("payload"))
    if any_repeated:  # rows that are repeated as a whole, once
        wanted = wanted.groupBy("team", "id", "chunks").agg(F.first("payload").alias("payload"))
    wanted.write.parquet(folder)
    texts = docs.sparkSession.read.schema("team long, id long, chunks int, payload string").parquet(folder)
    links = checkpointed(links_in_groups(texts, texts.where("chunks > 1"), _by_sets(width, percent)))
    remove_folder(docs.sparkSession, folder)
    if by_id and any_repeated:
        nodes = members.join(repeated.where("low <> high"), "doc", "left_semi").select("doc", "set_key").distinct().join(classes.select("set_key", "id"), "set_key")
        same = nodes.join(nodes.groupBy("doc").agg(F.min("id").alias("a")), "doc").where("a <> id").select("a", F.col("id").alias("b"))
        links = links.unionByName(same)
    parts = connected_components(checkpointed(links.distinct()))
    linked = checkpointed(parts.join(classes.select("id", "doc", "set_key"), "id").select("component", "doc", "set_key"))
    first = linked.groupBy("component").agg(F.min(F.struct("doc", "set_key")).alias("first"))
    linked = checkpointed(linked.join(first, "component").select("set_key", F.col("first.doc").alias("least"), (F.col("set_key") == F.col("first.set_key")).alias("lead")))
    copies = classes.where("rows > 1").join(linked, "set_key", "left_anti").select("set_key", F.col("doc").alias("least"), F.lit(True).alias("lead"))
    return features.select("doc", "n_shingles", "set_key"), checkpointed(linked.unionByName(copies))


def _labelled(features: DataFrame, labels: DataFrame) -> DataFrame:
    """features with least and lead, null where a row is alone."""
    some = F.col("set_key").isNotNull() & F.col("doc").isNotNull()
    alone = features.where(~some).withColumns({"least": F.lit(None).cast("long"), "lead": F.lit(None).cast("boolean")})
    return features.where(some).join(labels, "set_key", "left").select(*alone.columns).unionByName(alone)


def near_duplicates(docs: DataFrame, width: int = STAGE_WIDTH, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept."""
    out = _labelled(*_grouped(docs, width, percent, key, text, by_id=True))
    component = F.coalesce("least", "doc")
    return out.select(F.col("doc").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def _kept(docs: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' rows that stand for their component."""
    known = features.where("doc IS NOT NULL")
    several = checkpointed(known.groupBy("doc").count().where("count > 1").select("doc"))
    chosen = _labelled(known, labels).where("lead IS NULL OR (lead AND least = doc)")
    once = chosen.join(several, "doc", "left_anti").select(F.col("doc").alias("doc_id"))
    out = docs.join(checkpointed(once), "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
    if several.isEmpty():
        return out
    again = docs.join(several.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"))
    keyed = checkpointed(map_texts(again, "row", "row.text", [T.StructField("key_now", T.BinaryType())], _set_keys))
    own = chosen.join(several, "doc", "left_semi").select("doc", F.col("set_key").alias("key_now")).distinct()
    worded = keyed.withColumn("doc", F.col("row.doc_id").cast("long")).join(own, ["doc", "key_now"], "left_semi")
    empty = keyed.where("key_now IS NULL").select("row.*")
    return out.unionByName(worded.groupBy("doc", "key_now").agg(F.min_by("row", F.struct(F.xxhash64("row.text"), "row.text")).alias("row")).select("row.*")).unionByName(empty)


def _set_keys(texts: list[str | None]) -> list[list]:
    return [[hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None for h in shingle_sets(texts, STAGE_WIDTH)]]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents: two-word shingles, similarity of 0.8 or more."""
    return near_duplicates(read(spark, sf_dir, "documents"), WIDTH)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one of the smallest doc_id, as it is.

    Rows without a doc_id or without words stay. Of rows that share a doc_id, different texts are
    documents of their own; of those with the same shingles one stays, by the least hash of its text.
    """
    return _kept(docs, *_grouped(docs, STAGE_WIDTH, PERCENT, "doc_id", "text", by_id=False))
