"""Sharding by histogram sort: shards of nearly equal bytes, one exchange.

Groups of equal texts stay whole unless they are larger than a shard. Those of over 1/HEAVY of a shard, of which
there are under shards * HEAVY, are packed first, the largest into the emptiest shard. All other rows fill what is
left: they are ordered by (hash of the text, doc_id, a number of the row), so that equal texts are neighbours, and a
splitter that settles inside a small group moves to the nearer end of it. A group larger than a shard is cut, by
doc_id and then anywhere. Splitters are found by counting: each round
counts the exact bytes and rows below a few candidate boundaries for every open splitter (one aggregation
over the slim, checkpointed keys, a handful of rows to the driver), shrinks the splitter's bracket to the
keys that are really there and interpolates anew, until each splitter is within `tolerance` of its target or
no boundary is nearer. Rows are then exchanged once, by shard and, where a shard has more rows than a task
should sort, by a hash of the whole key; counts of these parts make the slots of a shard gapless.

DataFrame and SQL functions only.

Defined results: a null text counts as empty (size 1, crc32 0); a null doc_id sorts first, one that is no number
by its hash; an empty table gives an empty result. Columns of other names pass through; size, text_crc32, law,
shard, slot and grown_shard replace equal names; key_h, key_d and key_r (the sort key) and names that begin with
__shard_ are this module's own: columns of these names do not pass through.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, table, text_of

HEAVY = 64
LOW = -(1 << 63)
SPAN = 1 << 64


def size_and_crc(text: str = "text") -> dict[str, Column]:
    return {
        "size": (F.octet_length(text_of(text)) + 1).cast("long"),
        "text_crc32": F.crc32(text_of(text).cast("binary")),
    }


def keyed(df: DataFrame, text: str = "text") -> DataFrame:
    """df with size, text_crc32 and the sort key key_h, key_d, key_r; to be checkpointed, as rows are numbered as they come."""
    key = {"key_h": F.xxhash64(text_of(text)), "key_d": F.coalesce(F.col("doc_id").cast("string").try_cast("long"), F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("string"))), F.lit(LOW)), "key_r": F.monotonically_increasing_id()}
    return df.withColumns(size_and_crc(text) | key)


def place(bounds: list[int]) -> Column:
    """How many of the boundaries (192-bit keys) are at most the row's key."""
    if not bounds:
        return F.lit(0)
    probes = ", ".join("struct({}, {}, {})".format(*[long_sql(x + LOW) for x in (b // SPAN // SPAN, b // SPAN % SPAN, b % SPAN)]) for b in bounds)
    return F.expr(f"size(filter(array({probes}), p -> p <= struct(key_h, key_d, key_r)))")


def long_sql(x: int) -> str:
    return f"{x}L" if x > LOW else f"({x + 1}L - 1L)"


def packed(h: int, d: int, r: int) -> int:
    return ((h - LOW) * SPAN + (d - LOW)) * SPAN + (r - LOW)


class Splitter:
    """One boundary being sought: how many bytes belong below it, and the bracket of keys around it."""

    def __init__(self, target: float, tolerance: float, low: int, high: int, total: int, rows: int) -> None:
        self.target, self.tolerance = target, tolerance
        self.low, self.below_low, self.rows_low = low, 0, 0  # a boundary and what is below it
        self.high, self.below_high, self.rows_high = high, total, rows
        self.tries = 0

    def best(self) -> tuple[int, int, int]:
        """The nearer end of the bracket: boundary, bytes and rows below it."""
        if self.target - self.below_low <= self.below_high - self.target:
            return self.low, self.below_low, self.rows_low
        return self.high, self.below_high, self.rows_high

    def open(self) -> bool:
        return self.high - self.low > 1 and abs(self.best()[1] - self.target) > self.tolerance

    def probes(self) -> list[int]:
        """Where the target lies if keys are spread evenly, points around it, and the thirds (so that any bracket shrinks)."""
        width = self.high - self.low
        share = (self.target - self.below_low) / max(1, self.below_high - self.below_low)
        guess = self.low + int(share * (1 << 53)) * width // (1 << 53)
        near = width >> 7
        self.tries += 1
        tries = {guess, guess - near, guess + near, self.low + width // 3, self.high - width // 3}
        return [p for p in tries if self.low < p < self.high] or [self.low + width // 2]

    def learn(self, boundary: int, below: int, rows: int) -> None:
        if boundary <= self.low or boundary >= self.high:
            return
        if below <= self.target:
            self.low, self.below_low, self.rows_low = boundary, below, rows
        else:
            self.high, self.below_high, self.rows_high = boundary, below, rows

    def shrink(self, least: int, most: int) -> None:
        """No key in the bracket is below least or above most: nothing changes below least, or from most + 1 on."""
        if self.low < least < self.high:
            self.low = least
        if self.low < most + 1 < self.high:
            self.high = most + 1


def heavy_groups(keys: DataFrame, shards: int) -> tuple[dict[int, int], list[float], float]:
    """The shard of each group of over 1/HEAVY of a shard (by hash; none larger than a shard), the bytes that each shard has left for others, and a shard's size."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    room = [total / shards] * shards
    large = keys.groupBy("key_h").agg(F.sum("size").alias("bytes")).filter((F.col("bytes") > total / shards / HEAVY) & (F.col("bytes") <= total / shards))
    homes = {}
    for h, size in sorted(large.collect(), key=lambda r: (-r[1], r[0])):  # under shards * HEAVY rows
        homes[h] = max(range(shards), key=lambda j: (room[j], -j))
        room[homes[h]] -= size
    return homes, room, total / shards


def splitters(keys: DataFrame, shards: int, tolerance: float, rounds: int = 200, room: list[float] | None = None, shard: float | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """Boundaries of the shards, each with exact bytes and rows below it; and the rows of all. room: bytes wanted in each shard, equal ones by default; shard: the size above which a group is cut."""
    whole = keys.agg(F.sum("size"), F.count("*"), F.min("key_h"), F.max("key_h")).first()
    total, rows = whole[0] or 0, whole[1]
    if not rows:
        return [], 0
    most = -LOW - 1
    low, high = packed(whole[2], LOW, LOW), packed(whole[3], most, most) + 1
    wanted, shard = [max(0.0, x) for x in room or [1.0] * shards], shard or total / shards
    share = total / (sum(wanted) or 1.0)
    sought = [Splitter(share * sum(wanted[:j]), tolerance * shard, low, high, total, rows) for j in range(1, shards)]
    ends = [f(k) for k in ("key_h", "key_d", "key_r") for f in (F.min, F.max)]
    for _ in range(rounds):
        active = [s for s in sought if s.open()]
        if not active:
            return whole_groups(keys, [(s.target, s.best()) for s in sought], shard), rows
        probes = sorted({p for s in active for p in [s.low, *s.probes(), s.high]})  # the ends of a bracket part its rows from others
        counted = keys.groupBy(place(probes).alias("cell")).agg(F.sum("size"), F.count("*"), *ends)
        cells = {r[0]: r for r in counted.collect()}  # at most one row more than there are probes
        below, before, sums = 0, 0, []
        for i, p in enumerate(probes):
            if i in cells:
                below, before = below + cells[i][1], before + cells[i][2]
            sums.append((p, below, before))
        spans, edges = [], [low, *probes, high]
        for cell, (_, _, _, h, h2, d, d2, r, r2) in cells.items():
            d, d2, one = (d, d2, d == d2) if h == h2 else (LOW, most, False)
            r, r2 = (r, r2) if one else (LOW, most)
            spans.append((max(edges[cell], packed(h, d, r)), min(edges[cell + 1] - 1, packed(h2, d2, r2))))
        spans.sort()
        for s in active:
            for found in sums:
                s.learn(*found)
            inside = [(a, b) for a, b in spans if b >= s.low and a < s.high]
            if inside:
                s.shrink(inside[0][0], inside[-1][1])
    raise RuntimeError(f"splitters did not settle in {rounds} rounds")


def whole_groups(keys: DataFrame, settled: list[tuple[float, tuple[int, int, int]]], shard: float) -> list[tuple[int, int, int]]:
    """Boundaries moved to the nearer end of the group of equal texts in which they fall, unless it is larger than a shard. One more count."""
    ends = {}
    for _, (b, _, _) in settled:
        h = b // SPAN // SPAN + LOW
        ends[b] = packed(h, LOW, LOW), packed(h + 1, LOW, LOW)
    probes = sorted({e for pair in ends.values() for e in pair} | set(ends))
    inside = [p for p in probes if p // SPAN // SPAN + LOW <= -LOW - 1]  # behind the last hash is behind all rows
    cells = {r[0]: r for r in keys.groupBy(place(inside).alias("cell")).agg(F.sum("size"), F.count("*")).collect()}  # one row more than there are probes
    below, before, sums = 0, 0, {}
    for i, p in enumerate([*inside, *probes[len(inside) :]]):
        if i <= len(inside) and i in cells:
            below, before = below + cells[i][1], before + cells[i][2]
        sums[p] = (p, below, before)
    out = []
    for target, (b, _, _) in settled:
        first, last = (sums[e] for e in ends[b])
        own = sums[b]
        if first[1] < own[1] < last[1] and last[1] - first[1] <= shard:
            own = first if target - first[1] <= last[1] - target else last
        out.append(own)
    return out


def assign(df: DataFrame, keys: DataFrame, shards: int = 16, tolerance: float = 0.001, rows_a_part: int = 1_000_000) -> DataFrame:
    """df (from keyed(), checkpointed) with law, shard, slot and grown_shard. keys: its size and sort key, cheap to read again and again."""
    homes, room, shard = heavy_groups(keys, shards)
    told = F.from_json(F.lit(json.dumps({str(h): j for h, j in homes.items()})), "map<string,int>")
    known = df.sparkSession.range(1).select(F.explode(told).alias("g", "__shard_home")).select(F.col("g").cast("long").alias("__shard_g"), "__shard_home")
    known = F.broadcast(known)  # under shards * HEAVY rows
    homed = lambda rows: rows.join(known, F.col("key_h") == F.col("__shard_g"), "left").drop("__shard_g")
    keys = homed(keys)
    found, light = splitters(keys.filter("__shard_home is null"), shards, tolerance, room=room, shard=shard)
    n = light + (keys.filter("__shard_home is not null").count() if homes else 0)
    df = homed(df)
    parts = max(1, -(-n // (shards * rows_a_part)))
    where = {"shard": F.coalesce("__shard_home", place([b for b, _, _ in found])).cast("int"), "__shard_part": F.pmod(F.xxhash64("key_h", "key_d", "key_r"), F.lit(parts)).cast("int")}
    dealt = df.withColumns(where)
    slot = F.row_number().over(W.partitionBy("shard", "__shard_part").orderBy("key_h", "key_d", "key_r")) - 1
    if parts > 1:  # a row for each part of a shard
        counts = keys.withColumns(where).groupBy("shard", "__shard_part").agg(F.count("*").alias("n"))
        before = F.sum("n").over(W.partitionBy("shard").orderBy("__shard_part")) - F.col("n")
        counts = counts.select(F.col("shard").alias("__shard_s"), F.col("__shard_part").alias("__shard_p"), before.alias("__shard_before"))
        dealt = dealt.join(F.broadcast(counts), (F.col("shard") == F.col("__shard_s")) & (F.col("__shard_part") == F.col("__shard_p"))).drop("__shard_s", "__shard_p")
        slot = slot + F.col("__shard_before")
    return dealt.withColumns({"law": F.lit("bytes"), "slot": slot.cast("long"), "grown_shard": F.lit(None).cast("int")}).drop("__shard_part", "__shard_before", "__shard_home", "key_h", "key_d", "key_r")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    slim = checkpoint(keyed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return assign(slim, slim.select("size", "key_h", "key_d", "key_r")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
