"""Merkle manifest of a dataset: a tree over the rows of each group, and one over the groups' roots.

A row's digest is SHA-256 over its fields; each run of FANOUT neighbours becomes the digest of their digests,
level by level. The tree is reduced by superblocks: the rows of a group are numbered in their order (a range
partitioning, and counts of its partitions), bucket = number div FANOUT^levels, and one call of applyInPandas
collapses that many levels of a bucket. The buckets' roots are numbered already and reduced in the same way,
until each group has one; what stands above a bucket is then joined to what stands within it. No group of
rows larger than FANOUT^levels is ever held, however many rows a group has; texts are hashed where they are
read and are not exchanged.

Defined results: a null field counts as "-". Rows with equal order values stand in the order of their digests,
nulls first; equal digests are told apart by nothing but their place. A group of one row has that row's
digest as its root, and a single group's root is the root of all; a proof without siblings is the digest of the
empty text. The null group stands first. An empty table gives no rows. Other columns do not enter a digest;
those named in `carry` pass through.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

FANOUT, LEVELS, HEX = 8, 3, 64
#: Bytes of partition counts that may be broadcast; more are joined by a shuffle.
BROADCAST = 32_000_000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def told(value: Column) -> Column:
    """A field as it enters a digest: "-" if null, else its bytes' count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """SHA-256 of the values' UTF-8 laid end to end, in lowercase hex."""
    return F.sha2(F.concat(*values).cast("binary"), 256)


def run_digest(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above n neighbours until one node remains."""
    k = 0
    while n > 1:
        n, k = -(-n // FANOUT), k + 1
    return k


def collapse(digests: list[str], levels: int) -> list[list[str]]:
    """The digests and the levels above them."""
    rows = [digests]
    for _ in range(levels):
        rows.append([run_digest(rows[-1][i : i + FANOUT]) for i in range(0, len(rows[-1]), FANOUT)])
    return rows


def siblings(rows: list[list[str]], at: int) -> tuple[list[int], list[str]]:
    """For each level below the top: the place in the run of what stands over the node, and the run's other digests, joined."""
    path, others = [], []
    for row in rows[:-1]:
        start = at // FANOUT * FANOUT
        run = row[start : start + FANOUT]
        path.append(at - start)
        others.append("".join(run[: at - start] + run[at - start + 1 :]))
        at //= FANOUT
    return path, others


def ordered(pdf: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list[list[str]]]:
    pdf = pdf.sort_values("idx", kind="stable")
    return pdf, collapse(pdf["digest"].tolist(), min(levels, levels_of(int(pdf["n"].iloc[0]))))


def bucket_root(key: tuple, pdf: pd.DataFrame, levels: int) -> pd.DataFrame:
    """The root of a bucket, numbered among the buckets of its group, and how many there are."""
    _, rows = ordered(pdf, levels)
    return pd.DataFrame({"g": [key[0]], "idx": [key[1]], "n": [-(-int(pdf["n"].iloc[0]) // FANOUT**levels)], "digest": [rows[-1][0]]})


def within(key: tuple, pdf: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Of each node of a bucket: its proof within the bucket, and the bucket's root."""
    pdf, rows = ordered(pdf, levels)
    made = [siblings(rows, i) for i in range(len(pdf))]
    return pd.DataFrame({"g": key[0], "idx": pdf["idx"], "bucket": key[1], "up": -(-pdf["n"] // FANOUT**levels), "path": [p for p, _ in made], "siblings": [s for _, s in made], "root": rows[-1][0]})


def with_above(nodes: pd.DataFrame, above: pd.DataFrame, columns: list[str], levels: int) -> pd.DataFrame:
    """The nodes of a bucket with their whole proofs: within the bucket, then those above it."""
    nodes, rows = ordered(nodes, levels)
    made = [siblings(rows, i) for i in range(len(nodes))]
    top = above.iloc[0]
    higher_path, higher = list(top["path"]), list(top["siblings"])
    proofs = pd.DataFrame({"path": [p + higher_path for p, _ in made], "siblings": [s + higher for _, s in made], "subroot": top["subroot"], "root": top["root"]}, index=nodes.index)
    return nodes[columns].join(proofs)


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df (with the group g), written once, with idx, the place of each row in its group by `order`, and n, the group's rows.

    Rows that are equal in all of that are dealt over tasks by where they were read.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = df.withColumn("read_", F.monotonically_increasing_id())
    keys = [F.col("g"), *order, F.col("read_")]
    placed = checkpoint(read.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("read_").withColumn("at_", F.monotonically_increasing_id()))
    part = F.shiftright("at_", 33)
    counts = placed.groupBy(part.alias("part_"), "g").agg(F.count("*").alias("rows_"), F.min("at_").alias("first_"))
    # a group has at most one row of counts for each partition
    before = F.sum("rows_").over(Window.partitionBy("g").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part_", F.col("g").alias("g_"), "first_", F.coalesce(before, F.lit(0)).alias("before_"), F.sum("rows_").over(Window.partitionBy("g")).alias("n"))
    offsets = checkpoint(offsets)
    offsets = F.broadcast(offsets) if offsets.count() * 100 <= BROADCAST else offsets
    joined = placed.join(offsets, (part == F.col("part_")) & (F.col("g") == F.col("g_")))
    return joined.withColumn("idx", F.col("before_") + F.col("at_") - F.col("first_")).drop("part_", "g_", "first_", "before_", "at_")


def reduced(nodes: DataFrame, most: int, levels: int) -> DataFrame:
    """(g, idx, path, siblings, root) of nodes (g, idx, n, digest); most: the largest n. Each round collapses `levels` levels."""
    inside = nodes.select("g", "idx", "n", "digest").groupBy("g", bucket_of(levels)).applyInPandas(lambda key, pdf: within(key, pdf, levels), "g string, idx long, bucket long, up long, path array<int>, siblings array<string>, root string")
    inside = checkpoint(inside)
    if most <= FANOUT**levels:
        return inside.select("g", "idx", "path", "siblings", "root")
    roots = inside.groupBy("g", F.col("bucket").alias("idx")).agg(F.max("up").alias("n"), F.max("root").alias("digest"))
    above = reduced(roots, -(-most // FANOUT**levels), levels).select("g", F.col("idx").alias("bucket"), F.col("path").alias("path_"), F.col("siblings").alias("siblings_"), F.col("root").alias("root_"))
    joined = inside.join(above, ["g", "bucket"])
    return joined.select("g", "idx", F.concat("path", "path_").alias("path"), F.concat("siblings", "siblings_").alias("siblings"), F.col("root_").alias("root"))


def bucket_of(levels: int) -> Column:
    return F.shiftright("idx", (FANOUT**levels).bit_length() - 1).alias("bucket")


def manifest(rows: DataFrame, group: str, order: str, leaf: str = "leaf", carry: list[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """rows with their proofs: leaf, the columns in carry, path, siblings, subroot (of the group) and root (of all).

    path and siblings have an entry for each level up to the root: the place in the run, and the other digests
    of the run joined from left to right.
    """
    carry = [c for c in carry or [] if c not in (leaf, "path", "siblings", "subroot", "root")]
    # the null group sorts before all others; names sort by their bytes
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    inner = [f"c{i}_" for i in range(len(carry))]
    base = rows.select(key.alias("g"), F.col(order).alias("order_"), F.col(leaf).alias("digest"), *[F.col(c).alias(i) for c, i in zip(carry, inner, strict=True)])
    leaves = numbered(base, [F.col("order_"), F.col("digest")]).drop("order_")
    roots = checkpoint(leaves.select("g", "idx", "n", "digest").groupBy("g", bucket_of(levels)).applyInPandas(lambda key, pdf: bucket_root(key, pdf, levels), "g string, idx long, n long, digest string"))
    most = roots.agg(F.max("n")).first()[0] or 1
    above = reduced(roots, most, levels)
    subroots = above.filter("idx = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("digest"))
    groups = numbered(subroots, [F.col("name")])
    tops = reduced(groups, groups.agg(F.max("n")).first()[0] or 1, levels).select("idx", F.col("path").alias("path_"), F.col("siblings").alias("siblings_"), F.col("root").alias("root_"))
    tops = groups.select("idx", F.col("name").alias("g"), F.col("digest").alias("subroot")).join(tops, "idx").drop("idx")
    above = above.join(tops, "g").select("g", F.col("idx").alias("bucket"), F.concat("path", "path_").alias("path"), F.concat("siblings", "siblings_").alias("siblings"), "subroot", F.col("root_").alias("root"))
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["digest", *inner]) + ", path array<int>, siblings array<string>, subroot string, root string"
    proofs = leaves.groupBy("g", bucket_of(levels)).cogroup(above.groupBy("g", "bucket")).applyInPandas(lambda key, nodes, above: with_above(nodes, above, ["digest", *inner], levels), schema)
    return proofs.select(F.col("digest").alias(leaf), *[F.col(i).alias(c) for c, i in zip(carry, inner, strict=True)], "path", "siblings", "subroot", "root")


def folded(leaf: Column, path: Column, others: Column) -> Column:
    """The root that a digest and its proof give."""
    step = lambda at, run: F.struct(at.alias("at"), run.alias("run"))
    put = lambda h, s: digest(F.substr(s["run"], F.lit(1), s["at"] * HEX), h, F.substr(s["run"], s["at"] * HEX + 1))
    return F.aggregate(F.zip_with(path, others, step), leaf, put)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; every third text is tampered with before it is verified."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text").cast("string")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(touched, F.translate(text, UPPER, LOWER)).otherwise(text)
    fields = lambda t: [told(t if c == "text" else F.col(c)) for c in FIELDS]
    rows = docs.select("doc_id", "lang", digest(*fields(text)).alias("leaf"), F.when(touched, digest(*fields(changed))).alias("tampered"))
    proofs = manifest(rows, "lang", "doc_id", carry=["doc_id", "tampered"])
    shown = F.coalesce("tampered", "leaf")
    made = proofs.select("doc_id", "leaf", "subroot", "root", digest(F.concat_ws("", "siblings")).alias("proof_sha256"), folded(shown, F.col("path"), F.col("siblings")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(deep: int = 7) -> str:
    """The same rows in DuckDB, for groups of up to FANOUT^deep rows: a level for each step, none where one node is left."""
    field = lambda c: f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda t: "sha256(" + " || ".join(field(t if c == "text" else c) for c in FIELDS) + ")"
    # CRC-32 bit by bit over the decimal digits: each byte is followed by seven empty steps
    bits = "list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda b: [ascii(b)::bigint, 0, 0, 0, 0, 0, 0, 0])))"
    crc = f"xor(list_reduce({bits}, lambda c, b: xor(xor(c, b) >> 1, 3988292384::bigint * (xor(c, b) & 1))), 4294967295::bigint)"
    parts = [
        f"rows_ as (select doc_id, coalesce('1' || lang, '0') as g, {leaf('text')} as leaf, case when doc_id is not null and {crc} % 3 = 0 then {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} end as tampered from documents)",
        "l0 as (select g, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n, leaf as h from rows_)",
    ]

    def level(k: int, source: str) -> list[str]:
        """Runs of level k (all: their digests, joined), then the nodes above; a group with one node stays as it is."""
        return [
            f"r{k} as (select g, i // {FANOUT} as run, max(n) as n, string_agg(h, '' order by i) as everything from {source} where n > 1 group by all)",
            f"l{k + 1} as (select g, run as i, (n + {FANOUT - 1}) // {FANOUT} as n, sha256(everything) as h from r{k} union all select g, i, n, h from {source} where n = 1)",
        ]

    for k in range(deep):
        parts += level(k, f"l{k}")
    first = 10  # levels of the tree over the groups
    parts.append(f"l{first} as (select '' as g, row_number() over (order by g) - 1 as i, count(*) over () as n, h, g as name from l{deep})")
    for k in range(first, first + 3):
        parts += level(k, f"(select g, i, n, h from l{k})")
    parts.append(f"s{0} as (select r.g, doc_id, leaf, coalesce(tampered, leaf) as shown, row_number() over (partition by r.g order by doc_id nulls first, leaf) - 1 as i, '' as proof from rows_ r)")
    step = 0
    for k in [*range(deep), *range(first, first + 3)]:
        if k == first:
            parts.append(f"t as (select s.* replace ('' as g, p.i as i), p.h as subroot from s{step} s join l{first} p on p.name = s.g)")
        source = "t" if k == first else f"s{step}"
        step += 1
        at = f"(s.i % {FANOUT})::int * {HEX}"
        parts.append(
            f"s{step} as (select s.* replace (s.i // {FANOUT} as i, case when r.g is null then proof else proof || left(everything, {at}) || substr(everything, {at} + {HEX + 1}) end as proof, "
            f"case when r.g is null then shown else sha256(left(everything, {at}) || shown || substr(everything, {at} + {HEX + 1})) end as shown) from {source} s left join r{k} r on r.g = s.g and r.run = s.i // {FANOUT})"
        )
    top = f"(select h from l{first + 3})"
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, {top} as root, sha256(proof) as proof_sha256, shown as folded_root, shown = {top} as verified from s{step}"


ORACLE_SQL = oracle_sql()
