"""Hierarchical weighted hash tree: documents descend region, rack and shard levels by weighted draws.

At each level every child draws u in (0, 1) from a hash of the document's key and the child's
name, and the least -ln(u) / weight wins: a child gets its share of the weights, and a changed
weight moves keys only into or out of that child. A tree grows by a region of its own, so that a
further shard takes rows only into itself.

Edge cases: a null text has size 1 (no bytes plus one) and the CRC of no bytes; a null key is
hashed as the text `null`; repeated rows go to the same shard and get slots of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazelark.llm.tables import read

RACKS, PER_RACK = 2, 2
BUCKETS = 1024


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(base: int = 8, extra: int = 0) -> list[Shard]:
    """`base` shards in racks of two and regions of two racks; each extra one in a region of its own."""
    first = [Shard(i // (RACKS * PER_RACK), i // PER_RACK, i) for i in range(base)]
    regions = -(-base // (RACKS * PER_RACK))
    racks = -(-base // PER_RACK)
    return first + [Shard(regions + k, racks + k, base + k) for k in range(extra)]


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**52))) / F.lit(float(weight))


def _choice(key: Column, level: str, weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [F.struct(_draw(key, f"{level}{n}", w).alias("draw"), F.lit(n).alias("n")) for n, w in sorted(weights.items())]
    return F.array_min(F.array(*draws)).getField("n")


def assign(key: Column, shards: list[Shard]) -> Column:
    """The shard of a key. Shards of weight 0 or less get none."""
    live = [s for s in shards if s.weight > 0]

    def weights(of: list[Shard], level: str) -> dict[int, float]:
        out: dict[int, float] = {}
        for s in of:
            out[getattr(s, level)] = out.get(getattr(s, level), 0.0) + s.weight
        return out

    def descend(of: list[Shard], levels: list[str]) -> Column:
        level, rest = levels[0], levels[1:]
        by = weights(of, level)
        chosen = _choice(key, level, by)
        if not rest:
            return chosen
        if len(by) == 1:
            return descend(of, rest)
        out = None
        for n in sorted(by):
            below = descend([s for s in of if getattr(s, level) == n], rest)
            out = F.when(chosen == n, below) if out is None else out.when(chosen == n, below)
        return out

    return descend(live, ["region", "rack", "shard"]).cast("int")


def shard_documents(docs: DataFrame, shards: list[Shard], grown: list[Shard], key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Columns: key, size, text_crc32, shard, grown_shard, slot.

    Slots are gapless from 0 in each shard: a count of each (shard, bucket) gives every bucket its
    first slot, and rows are numbered within their bucket only, so no task holds a whole shard.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(key),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        assign(name, shards).alias("shard"),
        assign(name, grown).alias("grown_shard"),
    ).withColumn("bucket", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("slot"), name, "text_crc32")), 1, 8), 16, 10).cast("long"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first_slot"))
    within = Window.partitionBy("shard", "bucket").orderBy(key, "text_crc32", "size")
    return (
        rows.join(first, ["shard", "bucket"])
        .withColumn("slot", (F.col("first_slot") + F.row_number().over(within) - 1).cast("long"))
        .select(key, "size", "text_crc32", "shard", "slot", "grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 8 shards under the law `key`, and its shard of 9."""
    out = shard_documents(read(spark, sf_dir, "documents"), tree(8), tree(8, 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_draw(level: str, n: int, weight: float) -> str:
    return f"-ln((CAST('0x' || substr(md5(k || '|{level}{n}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {float(weight)}"


def _sql_choice(level: str, members: list[int], weight: float) -> str:
    draws = ", ".join(f"{{'d': {_sql_draw(level, n, weight)}, 'n': {n}}}" for n in members)
    return f"list_min([{draws}]).n"


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents),
crc_table AS (
  SELECT list(c ORDER BY n) AS tab FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS n))
),
b AS (
  SELECT doc_id, k, octet_length(encode(text)) + 1 AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(text))), lambda i: CAST('0x' || substr(hex(encode(text)), i * 2 + 1, 2) AS BIGINT))),
      lambda c, x: xor(c // 256, tab[(xor(c, x) % 256) + 1]))) AS text_crc32
  FROM t, crc_table
),
r AS (SELECT *, {_sql_choice('region', [0, 1], 4)} AS region, {_sql_choice('rack', [0, 1], 2)} AS rack_a, {_sql_choice('rack', [2, 3], 2)} AS rack_b,
  list_min([{{'d': {_sql_draw('region', 0, 4)}, 'n': 0}}, {{'d': {_sql_draw('region', 1, 4)}, 'n': 1}}, {{'d': {_sql_draw('region', 2, 1)}, 'n': 2}}]).n AS grown_region FROM b),
s AS (SELECT *, CASE CASE region WHEN 0 THEN rack_a ELSE rack_b END WHEN 0 THEN {_sql_choice('shard', [0, 1], 1)} WHEN 1 THEN {_sql_choice('shard', [2, 3], 1)}
  WHEN 2 THEN {_sql_choice('shard', [4, 5], 1)} ELSE {_sql_choice('shard', [6, 7], 1)} END AS shard,
  CAST('0x' || substr(md5('slot|' || k || '|' || text_crc32), 1, 8) AS BIGINT) % {BUCKETS} AS bucket FROM r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot,
  CASE WHEN grown_region = 2 THEN 8 ELSE shard END AS grown_shard
FROM s
"""
