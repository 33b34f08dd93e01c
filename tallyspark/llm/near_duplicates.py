"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, verification on full shingle sets.

Texts are compared by their sets of five-word shingles (lower case; a text of fewer words is one
shingle); two are linked when the Jaccard similarity is at least 0.8. Rows and bands are chosen for a
target recall of a pair just at the threshold.

1. One pass over the texts gives an exact signature (of the word sequence) and the band hashes. Rows of
   one signature are a class of copies with a number of its own and a count; copies never meet as pairs.
2. Representatives that share a band hash are candidates. A bucket gives one edge from each member to
   its smallest member, so a bucket of m makes m edges; connected components of these edges tell which
   candidates can be verified together.
3. Texts go to cells of bounded size, where overlaps are counted from sorted shingles. Components that fit
   a cell share cells. A component that doesn't (a chain of texts that share boilerplate may grow
   with the corpus) is verified by its buckets: of buckets with the same members one is kept, small
   buckets share cells, a large one is cut into blocks and each pair of blocks is a cell; a pair is counted
   in the first bucket that it shares. So a text meets those that share a band with it, not its component.
   Only where the component's own pairs of blocks take fewer copies of its texts (a group of near
   copies that share most of their buckets) are these its cells.
   A cell returns for each member its number of links and the smallest member that it is connected
   with, never the pairs.
4. Links are summed over cells, and components of the verified links are the classes.

Result: one row for each row of the input: doc_id, class_id (the smallest doc_id connected through
links), copy_of (the smallest doc_id with the same words), n_links (rows linked with this one, copies
included). linked_pairs() returns the linked pairs of representatives; one_of_each() keeps one row of
each class.

Defined results: texts without a word are copies of each other; a null text counts as empty. Rows are
told apart by their texts, not by doc_id: rows with a null or a repeated doc_id are linked like any
others, and different texts under one doc_id stay different. A class without any doc_id has a negative
id, and so has one whose smallest doc_id is no whole number (a string, say). An empty table gives an empty result. Columns of other names pass through one_of_each() only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, has_rows, table
from .shingles import mix, shingles, word_hashes

THRESHOLD = 0.8
RECALL = 0.9995
#: Hash functions to spend on a text at most.
HASHES = 100
#: Representatives and bytes of text in a block.
BLOCK = 384
BLOCK_BYTES = 8_000_000
#: Bytes of ids that may be broadcast; more are joined by a shuffle.
BROADCAST = 32_000_000
#: Nodes with many edges are joined by themselves; there are at most so many of them. Fewer edges than APART fit a task, whatever node they are of.
HUBS = 100_000
APART = 1_000_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall at the threshold within the number of hashes."""
    best = None
    for rows in range(1, hashes + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches the recall with so few hashes")
    return best


def band_hashes(words: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """texts x bands hashes; texts without a word get zeros."""
    grams, ends = shingles(words, offsets)
    out = np.zeros((len(ends) - 1, bands), dtype=np.uint64)
    full = np.flatnonzero(np.diff(ends))
    if not len(full):
        return out
    starts = ends[:-1][full]
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    shifts = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) << np.uint64(20))
    for b in range(bands):
        key = np.full(len(full), b + 1, dtype=np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            key = mix(key ^ np.minimum.reduceat(grams * factors[r] + shifts[r], starts))
        out[full, b] = key
    return out


def raw_hash(text: str = "text") -> Column:
    """Identity of an exact text (null: empty): two hashes and the length."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.concat_ws(":", F.xxhash64(t), F.crc32(t.cast("binary")), F.octet_length(t))


def signatures(docs: DataFrame, bands: int, rows: int, text: str = "text") -> DataFrame:
    """doc_id, raw (of the exact text), sig_a, sig_b, n_bytes and the band hashes (none for a text without words) of every row."""
    slim = docs.select("doc_id", F.col(text).alias("text"), raw_hash(text).alias("raw"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                texts = part.column("text")
                words, offsets = word_hashes(texts)
                found = band_hashes(words, offsets, bands, rows).view(np.int64)
                sizes = np.diff(offsets)
                raw = words.tobytes()
                sig = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]), dtype=np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]), pa.int32()), pa.array(found[sizes > 0].ravel(), pa.int64()))
                size = pa.compute.binary_length(texts.fill_null("")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("raw"), pa.array(sig[:, 0]), pa.array(sig[:, 1]), size, lists], names=["doc_id", "raw", "sig_a", "sig_b", "n_bytes", "bands"])

    return slim.mapInArrow(run, f"doc_id {kind}, raw string, sig_a bigint, sig_b bigint, n_bytes bigint, bands array<bigint>")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) for every id of the edges (u, v): root is the smallest id connected with it.

    Alternating large-star and small-star steps: a few equi-joins and minima each, a number of rounds that
    grows with the logarithm of the longest chain. Only counts come to the driver. Nodes with so many
    edges that they would fill a task are HUBS at most; they are broadcast and their edges stay where they
    are, once there are edges enough for that.
    """
    edges = checkpoint(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, n = None, edges.count()
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        if n > APART:
            many = max(1000, 2 * n // HUBS)
            hubs = F.broadcast(least.filter(F.col("degree") > many).select("u", "m"))
            few = both.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("degree") <= many).select("u", "m"), "u")
            met = both.join(hubs, "u").unionByName(few)
        else:
            met = both.join(least.select("u", "m"), "u")
        large = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = checkpoint(small.filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("id"), "root").unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def overlaps(grams: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared distinct shingles of every pair of texts (a square matrix, upper half filled), and distinct shingles of each."""
    n = len(ends) - 1
    owner = np.repeat(np.arange(n), np.diff(ends))
    order = np.lexsort((owner, grams))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    shared = np.zeros(n * n, dtype=np.int32)
    active, step = np.arange(len(grams)), 1
    while True:  # places whose shingle also stands `step` places on
        active = active[active + step < len(grams)]
        active = active[grams[active + step] == grams[active]]
        if not len(active):
            break
        codes = owner[active] * n + owner[active + step]
        shared += np.bincount(codes, minlength=n * n).astype(np.int32)
        step += 1
    return shared.reshape(n, n), np.bincount(owner, minlength=n)


def smallest_connected(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each place the smallest id reachable through links."""
    label = ids.copy()
    a, b = np.nonzero(linked)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            return label
        label = new


def verify_cell(cell: pd.DataFrame, threshold: float, pairs: bool = False) -> pd.DataFrame:
    """Links of one cell: pairs of one comp (a component, or the bucket of a band). side 0: compare with all of them; 1 and 2: with the other side only.

    A bucket's rows carry its place `at` among the bands and all buckets of the text (0: none); pairs that share an earlier one are counted there.
    """
    cell = cell.sort_values(["comp", "rep", "side"], kind="stable").reset_index(drop=True)
    words, offsets = word_hashes(pa.array(cell["text"], pa.string()))
    shared, sizes = overlaps(*shingles(words, offsets))
    shared = np.maximum(shared, shared.T)
    comp, side, ids, copies = (cell[c].to_numpy() for c in ("comp", "side", "rep", "copies"))
    linked = shared >= threshold * (sizes[:, None] + sizes[None] - shared) - 1e-9
    linked &= (comp[:, None] == comp[None]) & ((side[:, None] == 0) | (side[:, None] != side[None])) & (sizes[:, None] > 0)
    np.fill_diagonal(linked, False)
    at = cell["at"].to_numpy()
    if len(at) and at.max() > 0:
        blank = np.zeros(max(len(b) for b in cell["own"]), dtype=np.int64)
        own = np.array([b if len(b) else blank for b in cell["own"]], dtype=np.int64)
        for b in range(int(at.max())):
            earlier = (own[:, None, b] == own[None, :, b]) & (own[:, b] != 0)
            linked &= ~(earlier & (at > b)[:, None])
    if pairs:
        a, b = np.nonzero(np.triu(linked))
        return pd.DataFrame({"rep_a": np.minimum(ids[a], ids[b]), "rep_b": np.maximum(ids[a], ids[b]), "jaccard": shared[a, b] / (sizes[a] + sizes[b] - shared[a, b])})
    return pd.DataFrame({"rep": ids, "links": linked @ copies, "root": smallest_connected(linked, ids)})


def in_bounds(df: DataFrame, rows: int, bytes_a_row: int = 64) -> DataFrame:
    """df, hinted for broadcast when its counted rows are small enough; else left to a shuffled join."""
    return F.broadcast(df) if rows * bytes_a_row <= BROADCAST else df


def classes_of(marked: DataFrame) -> DataFrame:
    """One row for each signature: rep (a number of its own), keep (its first row by doc_id and text), least (its smallest doc_id), copies, n_bytes, raw, bands."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("raw"))).alias("keep")
    found = marked.groupBy("sig_a", "sig_b").agg(first, F.min("doc_id").try_cast("long").alias("least"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.first("bands").alias("bands"))
    return checkpoint(found.select("*", F.col("keep.raw").alias("raw"), F.monotonically_increasing_id().alias("rep")))


#: What makes a cell.
CELL = ["pack", "row_", "col_"]


def in_blocks(rows: DataFrame, comp: str, kind: int, packs: int, *others: str) -> DataFrame:
    """Rows (of `comp`, which has `blocks` blocks) by cell: comps of one block share `packs` cells of a kind, the others get one for each pair of their blocks."""
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("other")
    spread = rows.select("raw", "rep", F.col(comp).alias("comp"), "copies", "blocks", block.alias("block"), other, *others)
    alone = F.col("other") == -1
    return spread.select(
        "raw", "rep", "comp", "copies", *others,
        F.when(alone, F.pmod(F.xxhash64("comp"), F.lit(packs))).otherwise(F.col("comp")).alias("pack"),
        F.when(alone, kind).otherwise(F.least("block", "other")).alias("row_"), F.when(alone, kind).otherwise(F.greatest("block", "other")).alias("col_"),
        F.when(alone | (F.col("block") == F.col("other")), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
    )


def packs_for(rows: int, size: int) -> int:
    return max(1, -(-rows // (BLOCK // 2)), -(-size // (BLOCK_BYTES // 2)))


def blocks_for(rows: str, size: str) -> Column:
    return F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks")


def by_bucket(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of the components (larger than a cell) whose buckets take fewer copies of a text than their pairs of blocks do; and the other components' members.

    `own` holds all kept buckets of a text, by place.
    """
    banded = members.select("root", "rep", "raw", "copies", "n_bytes", F.size("bands").alias("n_bands"), F.posexplode("bands").alias("at", "band"))
    buckets = banded.groupBy("at", "band").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("total"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("mark")).filter("n > 1")
    kept = buckets.groupBy("n", "mark").agg(F.min(F.struct("at", "band", "total")).alias("k")).select("k.at", "k.band", blocks_for("n", "k.total"))
    placed = checkpoint(banded.join(kept, ["at", "band"]))
    cheap = placed.groupBy("root").agg(F.sum("blocks").alias("texts")).join(members.groupBy("root").agg(F.sum("blocks").alias("whole")), "root").filter("texts < whole").select("root")
    cheap = checkpoint(cheap)
    cheap = in_bounds(cheap, cheap.count())
    placed, others = placed.join(cheap, "root", "left_semi"), members.join(cheap, "root", "left_anti")
    known = placed.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("at", "band"))).alias("known"), F.first("n_bands").alias("n_bands"))
    own = known.select("rep", F.transform(F.sequence(F.lit(0), F.col("n_bands") - 1), lambda i: F.coalesce(F.try_element_at("known", i), F.lit(0))).alias("own"))
    alone = placed.filter("blocks = 1").agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    return in_blocks(placed.join(own, "rep"), "band", -2, packs_for(*alone), "at", "own"), others


def cells_of(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, bool]:
    """Classes that share a band with another, with one text each, by cells of bounded size (columns CELL); and whether a component has several cells."""
    banded = classes.select("rep", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("other")).filter("hub <> other").select("band", "hub")
    edges = banded.join(hubs, "band").select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    found = checkpoint(components(edges))

    members = found.join(classes.select("rep", "raw", "copies", "n_bytes", "bands"), found["id"] == classes["rep"]).drop("id")
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("total"))
    members = checkpoint(members.join(sizes.select("root", blocks_for("n", "total")), "root"))
    fits = F.col("blocks") == 1
    whole = members.agg(F.count("*"), F.count(F.when(fits, 1)), F.coalesce(F.sum(F.when(fits, F.col("n_bytes"))), F.lit(0))).first()
    several = whole[0] > whole[1]
    at_once, extra = members, {"at": F.lit(0), "own": F.array().cast("array<bigint>")}
    if several:
        buckets, others = by_bucket(members.filter(~fits))
        at_once = members.filter(fits).unionByName(others)
    spread = in_blocks(at_once.withColumns(extra), "root", -1, packs_for(whole[1], whole[2]), "at", "own")
    if several:
        spread = spread.unionByName(buckets)

    # one text for each member, found again by the identity of the text
    keyed = docs.select(raw_hash().alias("raw_"), F.coalesce("text", F.lit("")).alias("text"))
    kept = keyed.join(in_bounds(members.select("raw"), whole[0]), F.col("raw_") == F.col("raw"), "left_semi")
    texts = kept.groupBy("raw_").agg(F.first("text").alias("text"))
    return spread.join(texts, F.col("raw") == F.col("raw_")).select(*CELL, "comp", "rep", "copies", "side", "at", "own", "text"), several


def linked_pairs(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """rep_a, rep_b (signatures' first doc_ids, the smaller first) and jaccard of the linked pairs of different texts; a null id where a text has none."""
    classes = classes_of(checkpoint(signatures(docs, *choose_bands(threshold, recall, hashes))))
    cells, _ = cells_of(docs, classes)
    found = cells.groupBy(*CELL).applyInPandas(lambda c: verify_cell(c, threshold, True), "rep_a bigint, rep_b bigint, jaccard double").toDF("a", "b", "jaccard")
    named = classes.select("rep", "least")
    both = found.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b")
    return both.select(F.least("x", "y").alias("rep_a"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.greatest("x", "y")).alias("rep_b"), "jaccard")


def grouped(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[DataFrame, DataFrame]:
    """The marked rows (doc_id, raw, sig_a, sig_b), and for each signature: class_id, copy_of, n_links, keep (the row that stands for its class), n_rows of the class."""
    marked = checkpoint(signatures(docs, *choose_bands(threshold, recall, hashes)))
    classes = classes_of(marked)
    cells, several = cells_of(docs, classes)
    checked = checkpoint(cells.groupBy(*CELL).applyInPandas(lambda c: verify_cell(c, threshold), "rep bigint, links bigint, root bigint"))
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if several:  # a component of many cells: its classes meet across them
        joined = components(checked.select(F.col("rep").alias("u"), F.col("root").alias("v")))
        links = links.drop("root").join(joined, links["rep"] == joined["id"], "left").select("rep", "links", F.coalesce("root", "rep").alias("root"))
    links = checkpoint(links)
    nameless = -1 - F.shiftrightunsigned(F.col("sig_a"), 1)
    slim = classes.select("sig_a", "sig_b", "rep", "keep", "least", nameless.alias("nameless"), "copies")
    own = slim.join(links, "rep")
    roots = own.groupBy("root").agg(F.coalesce(F.min("least"), F.min("nameless")).alias("class_id"), F.min("keep").alias("first_row"), F.sum("copies").alias("n_rows"))
    linked = own.select("rep", "links", "root").join(roots, "root").drop("root")
    known = slim.join(linked, "rep", "left")
    own_id = F.coalesce("least", "nameless")
    known = known.select(
        "sig_a", "sig_b", own_id.alias("copy_of"), F.coalesce("class_id", own_id).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("first_row", "keep").alias("keep"), F.coalesce("n_rows", "copies").alias("n_rows"),
    )
    return marked.select("doc_id", "raw", "sig_a", "sig_b"), known


def verified(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, copy_of, n_links."""
    marked, known = grouped(docs, threshold, recall, hashes)
    return marked.join(known, ["sig_a", "sig_b"]).select("doc_id", "class_id", "copy_of", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """docs with one row of each class: that with the smallest doc_id (null last), then by text; of rows equal in both, one."""
    marked, known = grouped(docs, threshold, recall, hashes)
    rows = marked.join(known.filter("n_rows > 1").select("sig_a", "sig_b", "keep"), ["sig_a", "sig_b"]).groupBy("doc_id", "raw", "keep").agg(F.count("*").alias("n"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("raw") == F.col("keep.raw"))
    rows = checkpoint(rows.select(F.col("doc_id").alias("id_"), F.col("raw").alias("raw_"), stays.alias("stays"), "n").filter("not stays or n > 1"))
    size = rows.count()
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("key"), raw_hash().alias("raw"))  # columns of any name stay apart

    def matching(which: DataFrame, how: str) -> DataFrame:
        return keyed.join(in_bounds(which.select("id_", "raw_"), size), F.col("key").eqNullSafe(F.col("id_")) & (F.col("raw") == F.col("raw_")), how)

    repeated = matching(rows.filter("stays"), "left_semi").dropDuplicates(["key", "raw"])
    return matching(rows, "left_anti").unionByName(repeated).select("doc.*")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies: doc_id, class_id, copy_of, n_links."""
    return verified(table(spark, sf_dir, "documents"))
