"""Language-model scoring by deleted interpolation of n-grams (bigrams, words, a uniform floor).

P(w | v) = a * c(vw) / c(v) + b * c(w) / N + (1 - a - b) / (V + 1); a and b depend on the frequency
bucket of the context v (powers of two) and are learned by expectation-maximisation: for documents of one
fold of the training rows, with counts from which that fold is deleted.

How the counts travel. Each partition packs its documents, as they come, into blocks of about BLOCK_BYTES
(compressed, written once; the deleted fold has blocks of its own), so equal rows need not meet. A block
asks for each distinct n-gram in it once, as a sorted array of 64-bit keys with its own counts, cut by key
range into parts; a part sums the counts over all blocks and answers each block in the block's own order,
so answers carry no keys. Parts and blocks grow in number, not in size, with the corpus; a word with a
third of all tokens is one key per block. A block sends a row to each part that it has keys for, hence
never more rows than it has distinct n-grams: the exchange is at most that of single n-grams counted by
block. The packed documents then meet the answers and are scored whole.
Mixture weights are some dozens of numbers. They are fitted on the exact held-out counts, which stay
distributed: a round of expectation-maximisation is one aggregation with a row for each bucket.

Defined results: a null or empty text is the end token alone; a null doc_id is hashed as an empty string;
repeated rows are scored alike (each counts). Without training rows N and V are 0 and every score is
that of the uniform floor. A text longer than a block is a block of its own. Columns of other names do
not pass.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table, text_of
from .shingles import PRIME, mix, word_hashes

BLOCK_BYTES = 6_000_000
#: Bytes of text for each part that sums counts.
PART_BYTES = 24_000_000
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
BUCKETS = 24
#: Rounds of expectation-maximisation.
ROUNDS = 25


def ngram_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token (words, then one end, of each text): its key and that of the pair with the token before; and offsets. Word keys are even, pair keys odd."""
    words, offsets = word_hashes(texts, pc.ascii_lower)
    sizes = np.diff(offsets)
    ends = np.cumsum(sizes + 1)
    tokens = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    last = ends - 1
    tokens[last] = END
    inner = np.ones(len(tokens), dtype=bool)
    inner[last] = False
    tokens[inner] = words
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[ends - sizes - 1] = START
    pairs = mix(before * PRIME + mix(tokens)) | np.uint64(1)
    return mix(tokens) & ~np.uint64(1), pairs, np.concatenate([[0], ends])


def columns_of(keys: np.ndarray) -> bytes:
    """Sorted keys with equal bytes side by side, which the shuffle's compression shortens."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8).T).tobytes()


def keys_of(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's range of sorted keys begins, and the end."""
    width = (1 << 64) // parts + 1
    return np.searchsorted(keys, np.array([min(k * width, (1 << 64) - 1) for k in range(1, parts)], dtype=np.uint64)).astype(np.int64)


def packed_blocks(batches, limit: int):
    """Documents (doc_id, text, role) as rows of block, payload and counts. Odd blocks hold the deleted fold (role 2) alone."""
    partition, made, waiting = TaskContext.get().partitionId(), 0, {0: [], 1: []}
    held = {0: 0, 1: 0}

    def block(kind: int) -> pa.RecordBatch:
        nonlocal made
        rows = pa.Table.from_batches(waiting[kind]).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows)
        training = int(pc.sum(pc.greater(rows.column("role"), 0)).as_py())
        values = [(partition << 32) + (made << 1) + kind, sink.getvalue().to_pybytes(), held[kind], training, training * kind]
        made, waiting[kind], held[kind] = made + 1, [], 0
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["block", "payload", "n_bytes", "n_training", "n_deleted"])

    for batch in batches:
        fold = pc.equal(batch.column(2), 2)
        for kind, rows in ((0, batch.filter(pc.invert(fold))), (1, batch.filter(fold))):
            ends, at = np.cumsum(np.asarray(pc.binary_length(rows.column(1)), dtype=np.int64) + 1), 0
            while at < len(ends):
                before = ends[at - 1] if at else 0
                upto = min(len(ends), int(np.searchsorted(ends, before + limit - held[kind], side="left")) + 1)
                waiting[kind].append(rows.slice(at, upto - at))
                held[kind] += int(ends[upto - 1] - before)
                at = upto
                if held[kind] >= limit:
                    yield block(kind)
    for kind in (0, 1):
        if waiting[kind]:
            yield block(kind)


def documents_of(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def texts_of(rows: pa.Table) -> pa.Array:
    return rows.column("text").combine_chunks()


def requests(n: int, rows: pa.Table, parts: int) -> pa.RecordBatch:
    """The n-grams of a block with its counts in training rows, by part."""
    words, pairs, offsets = ngram_keys(texts_of(rows))
    training = np.repeat(np.asarray(rows.column("role").combine_chunks()) > 0, np.diff(offsets))
    keys, at = np.unique(np.concatenate([words, pairs]), return_inverse=True)
    counts = np.bincount(at[np.concatenate([training, training])], minlength=len(keys))
    edges = [0, *cuts(keys, parts).tolist(), len(keys)]
    spans = [(p, a, b) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
    columns = [pa.array([p for p, _, _ in spans], pa.int32()), pa.array([n] * len(spans), pa.int64())]
    columns += [pa.array([columns_of(keys[a:b]) for _, a, b in spans], pa.binary()), pa.array([packed(counts[a:b]) for _, a, b in spans], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "block", "keys", "counts"])


def answers(part: pa.Table) -> pa.Table:
    """Sums over all blocks, for each block in its own order (for odd blocks also those of the deleted fold); and one row (block -1) with the part's share of N and V."""
    keys = [keys_of(x.as_py()) for x in part.column("keys")]
    counts = [unpacked(x.as_py()) for x in part.column("counts")]
    blocks = part.column("block").to_pylist()
    places = np.cumsum([0] + [len(k) for k in keys])
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    odd = np.repeat(np.array(blocks) % 2 == 1, np.diff(places))
    own = np.concatenate(counts)
    sums = np.bincount(at, weights=own, minlength=len(found)).astype(np.int64)
    deleted = np.bincount(at[odd], weights=own[odd], minlength=len(found)).astype(np.int64)
    word = (found & np.uint64(1)) == 0
    total = [int(sums[word].sum()), int((sums[word] > 0).sum()), int(deleted[word].sum())]
    mine = [at[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
    rest = [0] * len(blocks)
    return pa.table(
        {
            "block": pa.array([*blocks, -1], pa.int64()),
            "part": pa.array([part.column("part")[0].as_py()] * (len(blocks) + 1), pa.int32()),
            "train": pa.array([*(packed(sums[i]) for i in mine), None], pa.binary()),
            "deleted": pa.array([*(packed(deleted[i]) if n % 2 else None for n, i in zip(blocks, mine, strict=True)), None], pa.binary()),
            "n_tokens": pa.array([*rest, total[0]], pa.int64()),
            "n_words": pa.array([*rest, total[1]], pa.int64()),
            "n_deleted": pa.array([*rest, total[2]], pa.int64()),
        }
    )


def counted(rows: pa.Table, answer: pa.Table, sums: dict[str, int]) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Offsets of a block's documents, and by kind of count c(w), c(vw), c(v) of each token. sums: the kinds wanted, with the count of the start of a text as a context."""
    words, pairs, offsets = ngram_keys(texts_of(rows))
    keys, at = np.unique(np.concatenate([words, pairs]), return_inverse=True)
    order = np.argsort(np.asarray(answer.column("part").combine_chunks()), kind="stable").tolist()
    out = {}
    for name, starts in sums.items():
        column = answer.column(name)
        found = np.concatenate([unpacked(column[i].as_py()) for i in order])
        if len(found) != len(keys):
            raise ValueError("answers do not match the block")
        word, pair = found[at[: len(words)]], found[at[len(words) :]]
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[offsets[:-1]] = starts
        out[name] = (word, pair, context)
    return offsets, out


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(context + 1)), BUCKETS - 1).astype(np.int64)


def learn(bins: DataFrame, left: int, floor: float, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (BUCKETS x 3) by EM on bins: n held-out tokens with the counts pair, context and word, and the context's bucket."""
    estimates = [F.col("pair") / F.greatest("context", F.lit(1)), F.col("word") / F.lit(max(1, left)), F.lit(floor)]
    mixed = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        parts = [e * F.element_at(F.array(*[F.lit(float(x)) for x in mixed[:, k]]), F.col("bucket") + 1) for k, e in enumerate(estimates)]
        shared = bins.select("bucket", "n", *[p.alias(f"p{k}") for k, p in enumerate(parts)])
        share = F.col("n") / (F.col("p0") + F.col("p1") + F.col("p2"))
        new = np.full((BUCKETS, 3), 0.1)
        for row in shared.groupBy("bucket").agg(*[F.sum(F.col(f"p{k}") * share) for k in range(3)]).collect():  # a row for each bucket
            new[row[0]] += row[1:]
        mixed = new / new.sum(axis=1, keepdims=True)
    mixed[0] = [0.0, mixed[0, 0] + mixed[0, 1], mixed[0, 2]]  # an unseen context has no pair estimate
    return mixed


def model_score(docs: DataFrame, learn_from: Column | None = None, deleted_fold: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    learn_from and deleted_fold: boolean columns: rows to count, and those of them whose tokens fit the mixture.
    """
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    learn_from = crc % 7 != 2 if learn_from is None else learn_from
    deleted_fold = crc % 7 == 3 if deleted_fold is None else deleted_fold
    role = F.when(~learn_from, 0).when(deleted_fold, 2).otherwise(1)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    limit = BLOCK_BYTES
    marked = docs.select("doc_id", text_of().alias("text"), role.cast("int").alias("role"))
    stored = checkpoint(marked.mapInArrow(lambda it: packed_blocks(it, limit), "block bigint, payload binary, n_bytes bigint, n_training bigint, n_deleted bigint"))
    size, *starts = stored.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_bytes", "n_training", "n_deleted")]).first()
    parts = max(1, -(-size // PART_BYTES))

    def ask(batches):
        for batch in batches:
            for n, payload in zip(batch.column(0), batch.column(1), strict=True):
                yield requests(n.as_py(), documents_of(payload.as_buffer()), parts)

    asked = stored.select("block", "payload").mapInArrow(ask, "part int, block bigint, keys binary, counts binary")
    answered = checkpoint(asked.groupBy("part").applyInArrow(answers, "block bigint, part int, train binary, deleted binary, n_tokens bigint, n_words bigint, n_deleted bigint"))
    n, v, n_deleted = answered.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_words", "n_deleted")]).first()
    floor = 1.0 / (v + 1)
    blocks, given = stored.select("block", "payload"), answered.filter("block >= 0")

    def held_out_bins(block: pa.Table, answer: pa.Table) -> pa.Table:
        rows = documents_of(block.column("payload")[0].as_buffer())
        _, c = counted(rows, answer, {"train": starts[0], "deleted": starts[1]})
        word, pair, context = (a - b for a, b in zip(c["train"], c["deleted"], strict=True))
        order = np.lexsort((word, context, pair))
        triples = np.stack([pair, context, word])[:, order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(triples) != 0).any(axis=0)]))
        triples = triples[:, first]
        counts = np.diff(np.append(first, len(order)))
        return pa.table({"bucket": pa.array(bucket(triples[1]), pa.int32()), **{k: pa.array(x, pa.int64()) for k, x in zip(("pair", "context", "word"), triples, strict=True)}, "n": pa.array(counts, pa.int64())})

    odd = F.col("block") % 2 == 1
    held = blocks.filter(odd).groupBy("block").cogroup(given.filter(odd).select("block", "part", "train", "deleted").groupBy("block"))
    bins = checkpoint(held.applyInArrow(held_out_bins, "bucket int, pair bigint, context bigint, word bigint, n bigint"))
    mixed = learn(bins, n - n_deleted, floor)

    def scored(block: pa.Table, answer: pa.Table) -> pa.Table:
        rows = documents_of(block.column("payload")[0].as_buffer())
        offsets, c = counted(rows, answer, {"train": starts[0]})
        word, pair, context = c["train"]
        weights = mixed[bucket(context)]
        p = weights[:, 0] * pair / np.maximum(context, 1) + weights[:, 1] * word / max(1, n) + weights[:, 2] * floor
        sums = [np.add.reduceat(x, offsets[:-1]) for x in ((word > 0).astype(np.int64), np.log10((word + 1) / (n + (v + 1))), np.log10(p))]
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "held_out": pa.array(np.asarray(rows.column("role").combine_chunks()) == 0),
                "n_tokens": pa.array(np.diff(offsets)),
                "n_known": pa.array(sums[0]),
                "train_tokens": pa.array(np.full(len(offsets) - 1, n, dtype=np.int64)),
                "base_score": pa.array(sums[1]),
                "score": pa.array(sums[2]),
            }
        )

    together = blocks.groupBy("block").cogroup(given.select("block", "part", "train").groupBy("block"))
    return together.applyInArrow(scored, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learned from the rows whose crc32(doc_id) mod 7 is not 2."""
    return model_score(table(spark, sf_dir, "documents"))
