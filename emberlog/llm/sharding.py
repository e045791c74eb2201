"""Hierarchical weighted hash tree: region, rack and shard by weighted hash draws.

A document's key descends a tree. At each node every child makes a draw that is
exponentially distributed with the child's weight as rate (``-ln(u) / weight`` with ``u`` hashed from
the key and the child's path) and the smallest draw wins, so a child receives a part of
the node's keys in proportion to its weight. A draw depends on the key and that child
alone. Raising one child's weight can therefore only move keys into that child, lowering it only
out of it, and the draws below a child change only when weights below it change:
movement is confined to the subtrees whose weights changed.

Everything is DataFrame expressions: no Python runs on the executors.

Defined cases: a null or repeated key is a key like any other (null counts as the empty string);
a null text has no bytes; an empty table gives an empty table; columns beyond those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots are numbered chunk by chunk; a chunk is a hash range of key and text. Fixed, whatever the input.
CHUNK_DIGITS = 3
#: Repeated rows that are laid out again together.
RUN = 10_000


@dataclass(frozen=True)
class HashTree:
    """``regions[r][k]`` holds the (shard number, weight) pairs of rack ``k`` of region ``r``."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @classmethod
    def uniform(cls, n_shards: int, base: int = 16, racks: int = 2, per_rack: int = 4) -> "HashTree":
        """The tree of ``n_shards`` equal shards.

        The first ``base`` shards fill regions of ``racks`` racks with ``per_rack`` shards. A shard
        commissioned later is a region of its own, so that it takes keys only into itself.
        """
        if n_shards < 1:
            raise ValueError("a tree needs a shard")
        first, regions = list(range(min(n_shards, base))), []
        for a in range(0, len(first), racks * per_rack):
            own = first[a : a + racks * per_rack]
            regions.append(tuple(tuple((s, 1.0) for s in own[b : b + per_rack]) for b in range(0, len(own), per_rack)))
        regions += [(((s, 1.0),),) for s in range(len(first), n_shards)]
        return cls(tuple(regions))

    def grow(self, weight: float = 1.0) -> "HashTree":
        """The tree with one more shard, as a region of its own."""
        return HashTree((*self.regions, (((1 + max(self.shards()), weight),),)))

    def reweigh(self, shard: int, weight: float) -> "HashTree":
        """The tree in which one shard has another weight."""
        return HashTree(tuple(tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region) for region in self.regions))

    def shards(self) -> list[int]:
        return [s for region in self.regions for rack in region for s, _ in rack]


def unit_draw(key: Column, node: str) -> Column:
    """A uniform number in (0, 1) from the first 52 bits of md5(key, node)."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"|{node}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(2**52))


def _winner(key: Column, children: list[tuple[int, str, float]]) -> Column:
    """The number of the child with the smallest weighted draw; a tie goes to the smaller number."""
    live = [c for c in children if c[2] > 0]
    if len(live) == 1:
        return F.lit(live[0][0])
    draws = [F.struct((-F.log(unit_draw(key, node)) / F.lit(weight)).alias("d"), F.lit(n).alias("n")) for n, node, weight in live]
    return F.array_min(F.array(*draws))["n"]


def _cases(pick: Column, options: list[tuple[int, Column]]) -> Column:
    out = F.lit(None).cast("int")
    for n, value in reversed(options):
        out = F.when(pick == n, value).otherwise(out)
    return out


def descend(docs: DataFrame, key: Column, tree: HashTree, prefix: str = "") -> DataFrame:
    """Add ``<prefix>region``, ``<prefix>rack`` (number within its region) and ``<prefix>shard``."""
    weigh = lambda rack: sum(w for _, w in rack)
    region, rack, shard = f"{prefix}region", f"{prefix}rack", f"{prefix}shard"
    docs = docs.withColumn(region, _winner(key, [(r, f"r{r}", sum(map(weigh, racks))) for r, racks in enumerate(tree.regions)]).cast("int"))
    docs = docs.withColumn(rack, _cases(F.col(region), [(r, _winner(key, [(k, f"r{r}/k{k}", weigh(x)) for k, x in enumerate(racks)])) for r, racks in enumerate(tree.regions)]).cast("int"))
    return docs.withColumn(
        shard,
        _cases(F.col(region), [(r, _cases(F.col(rack), [(k, _winner(key, [(s, f"r{r}/k{k}/s{s}", w) for s, w in x])) for k, x in enumerate(racks)])) for r, racks in enumerate(tree.regions)]).cast("int"),
    )


def number_slots(rows: DataFrame, shard: str, chunk: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in the order (chunk, ``order``). ``shard`` and ``chunk`` must follow from ``order``.

    Rows equal in ``order`` are added up first, so any number of repeated rows costs one row from each task; they are
    laid out again in runs of at most ``RUN``, dealt over the tasks. Distinct rows are numbered within (shard, chunk); each chunk starts at
    the number of rows in the chunks before it. The table of those starts has at most shards x chunks rows, which do not grow with the input, so
    it is broadcast.
    """
    own = rows.columns
    sums = rows.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in own if c not in order])
    counts = sums.groupBy(shard, chunk).agg(F.sum("_n").alias("_c"))
    before = Window.partitionBy(shard).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, chunk, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    within = F.coalesce(F.sum("_n").over(Window.partitionBy(shard, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumn("_w", within).join(F.broadcast(starts), [shard, chunk])
    runs = placed.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(RUN).cast("bigint")))).repartition(*order, "_from")
    each = F.sequence(F.col("_from"), F.least(F.col("_from") + RUN, F.col("_n")) - 1)
    return runs.withColumn("_i", F.explode(each)).withColumn(slot, (F.col("_start") + F.col("_w") + F.col("_i")).cast("bigint")).select(*own, slot)


def shard_documents(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal every row of ``docs`` to a shard by the law ``key`` and number it within its shard."""
    tree = HashTree.uniform(n_shards)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = descend(rows, F.col("_key"), tree)
    rows = descend(rows, F.col("_key"), tree.grow(), "grown_")
    rows = rows.withColumn("_chunk", F.substring(F.md5(F.concat_ws("|", "_key", "text_crc32").cast("binary")), 1, CHUNK_DIGITS))
    rows = number_slots(rows, "shard", "_chunk", ["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def _sql_winner(children: list[tuple[int, str, float]]) -> str:
    if len(children) == 1:
        return str(children[0][0])
    u = "((CAST('0x' || substr(md5(k || '|{}'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
    return "list_min([" + ", ".join(f"{{'d': -ln({u.format(node)}) / {weight}::DOUBLE, 'n': {n}}}" for n, node, weight in children) + "])['n']"


def _sql_shard(tree: HashTree) -> tuple[str, str, str]:
    """SQL for region, for rack given ``{r}`` and for shard given ``{r}`` and ``{k}``."""
    weigh = lambda rack: sum(w for _, w in rack)
    region = _sql_winner([(r, f"r{r}", sum(map(weigh, racks))) for r, racks in enumerate(tree.regions)])
    rack = "CASE {r} " + " ".join(f"WHEN {r} THEN {_sql_winner([(k, f'r{r}/k{k}', weigh(x)) for k, x in enumerate(racks)])}" for r, racks in enumerate(tree.regions)).replace("{'", "{{'").replace("}", "}}") + " END"
    shard = "CASE {r} * 100 + {k} " + " ".join(f"WHEN {r * 100 + k} THEN {_sql_winner([(s, f'r{r}/k{k}/s{s}', w) for s, w in x])}" for r, racks in enumerate(tree.regions) for k, x in enumerate(racks)).replace("{'", "{{'").replace("}", "}}") + " END"
    return region, rack, shard


#: crc32 (before the final inversion) of the bytes of ``{0}`` in DuckDB, which has no such function; joins ``crc_table``.
SQL_CRC32 = (
    "list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda b: CAST('0x' || b AS BIGINT))), "
    "lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1]))"
)
SQL_CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t)"


def oracle_sql(n_shards: int = 16) -> str:
    tree = HashTree.uniform(n_shards)
    (r, k, s), (gr, gk, gs) = _sql_shard(tree), _sql_shard(tree.grow())
    return f"""
WITH {SQL_CRC_TABLE},
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, coalesce(text, '') AS body FROM documents),
a AS (SELECT *, {r} AS region, {gr} AS grown_region FROM d),
b AS (SELECT *, {k.format(r='region')} AS rack, {gk.format(r='grown_region')} AS grown_rack FROM a),
c AS (SELECT *, {s.format(r='region', k='rack')} AS shard, {gs.format(r='grown_region', k='grown_rack')} AS grown_shard,
  xor({SQL_CRC32.format('body')}, 4294967295::BIGINT) AS text_crc32, CAST(octet_length(encode(body)) + 1 AS BIGINT) AS size FROM b, crc_table)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k || '|' || CAST(text_crc32 AS VARCHAR)), 1, {CHUNK_DIGITS}), doc_id, text_crc32, size) - 1 AS BIGINT) AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard, CAST(region AS INTEGER) AS region, CAST(rack AS INTEGER) AS rack FROM c
"""
