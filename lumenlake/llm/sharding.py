"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends region, rack and shard.  On each level every child draws -ln(u) / weight, u being a uniform number
hashed from the row's key and the child's name; the smallest draw wins, so a child is chosen in proportion to its
weight, and a change of one weight moves rows only into or out of that child's subtree.  A grown tree puts its new
shard into a region of its own: every other weight stays, so rows move into the new shard and nowhere else.

The law is `key`: the key and the tree decide, nothing else does.  Skew cannot arise from equal texts or a hot
source, as neither is part of the key.  Slots are numbered per (shard, sub-bucket), sub-buckets being hashed from
the key and the text's CRC, and shifted by the counts of the sub-buckets before; no task needs a whole shard, nor all
texts of a key that a third of the rows share.

Defined cases: a null key is hashed as the word null; a null text has size 1 and CRC 0; equal keys share a shard and
get different slots; other columns, whatever their names, play no part; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import text_bytes

#: Sub-buckets of a shard for the numbering of slots; at 100 TB each holds about a million rows.
SUB_BUCKETS = 4096


@dataclass(frozen=True)
class Node:
    """A node of the tree: a leaf has a shard number and a weight, an inner node has children."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    leaf_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight


def tree(regions: list[list[list[tuple[int, float]]]]) -> Node:
    """A tree from nested lists: regions of racks of (shard, weight)."""
    return Node("root", tuple(
        Node(f"region{r}", tuple(
            Node(f"region{r}/rack{k}", tuple(Node(f"region{r}/rack{k}/shard{s}", (), s, w) for s, w in rack))
            for k, rack in enumerate(racks)))
        for r, racks in enumerate(regions)))


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    r = len(root.children)
    leaf = Node(f"region{r}/rack0/shard{shard}", (), shard, weight)
    return Node(root.name, (*root.children, Node(f"region{r}", (Node(f"region{r}/rack0", (leaf,)),))))


#: Two regions of two racks of two shards.
EIGHT = tree([[[(0, 1.0), (1, 1.0)], [(2, 1.0), (3, 1.0)]], [[(4, 1.0), (5, 1.0)], [(6, 1.0), (7, 1.0)]]])


def _bits(key: Column, name: str, digits: int) -> Column:
    """The first hex digits of md5(key:name) as a number; md5 as any SQL engine has it."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{name}")).cast("binary")), 1, digits), 16, 10).cast("long")


def descend(key: Column, node: Node) -> Column:
    """The shard that the tree gives to the key."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = F.array_min(F.array(*(
        F.struct((-F.log((_bits(key, c.name, 13) + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(c.weight)).alias("draw"), F.lit(i).alias("child"))
        for i, c in enumerate(node.children))))
    out = F.when(draws["child"] == 0, descend(key, node.children[0]))
    for i, c in enumerate(node.children[1:], 1):
        out = out.when(draws["child"] == i, descend(key, c))
    return out


def shard_rows(docs: DataFrame, root: Node = EIGHT, new_shard: int | None = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    body = text_bytes(F.col("text"))
    spread = F.concat(key, F.lit(":"), F.crc32(body).cast("string"))
    placed = (F.coalesce(descend(key, root), F.lit(0)).cast("int").alias("shard"), (_bits(spread, "slot", 8) % SUB_BUCKETS).cast("int").alias("sub"))
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), *placed,
        (F.coalesce(descend(key, grown(root, new_shard)), F.lit(0)) if new_shard is not None else F.lit(None)).cast("int").alias("grown_shard"))
    # At most shards x SUB_BUCKETS rows, whatever the input: small enough to send to every task.
    before = (docs.select(*placed).groupBy("shard", "sub").count()
              .select("shard", "sub", (F.sum("count").over(Window.partitionBy("shard").orderBy("sub")) - F.col("count")).alias("start")))
    number = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "size", "text_crc32")) - 1
    return (rows.withColumn("number", number).join(F.broadcast(before), ["shard", "sub"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("number")).cast("long").alias("slot"), "grown_shard"))


def _draw_sql(name: str, weight: float) -> str:
    return f"(-ln((('0x' || substr(md5(k || ':{name}'), 1, 13))::BIGINT + 0.5) / {float(1 << 52)}) / {weight})"


def descend_sql(node: Node) -> str:
    """The same descent in DuckDB's SQL, of a key k."""
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return descend_sql(node.children[0])
    draws = [_draw_sql(c.name, c.weight) for c in node.children]
    whens = " ".join(f"WHEN {draws[i]} <= least({', '.join(draws[i + 1:])}) THEN {descend_sql(c)}" for i, c in enumerate(node.children[:-1]))
    return f"CASE {whens} ELSE {descend_sql(node.children[-1])} END"


#: CRC-32 of a blob in DuckDB's SQL, which has no such function: the usual table of 256, then a fold over the bytes.
CRC_SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, step: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t)
"""


def oracle_sql() -> str:
    """shard_rows with its defaults, over documents."""
    return f"""{CRC_SQL}, keyed AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, coalesce(text, '') AS body FROM documents),
placed AS (
  SELECT doc_id, k, strlen(body) + 1 AS size,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32,
    ({descend_sql(EIGHT)})::INTEGER AS shard, ({descend_sql(grown(EIGHT, 8))})::INTEGER AS grown_shard
  FROM keyed, crc_table),
spread AS (SELECT *, (('0x' || substr(md5(k || ':' || text_crc32 || ':slot'), 1, 8))::BIGINT % {SUB_BUCKETS}) AS sub FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY sub, doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM spread
"""
