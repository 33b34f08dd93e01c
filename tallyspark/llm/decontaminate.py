"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of 64 words that start every 32. Their TF-IDF vectors run over the words of the
benchmark; document frequencies are counted over all documents. A randomised SVD gives the latent space:
Spark tasks multiply their passages with a random block of vectors, a few megabytes each are summed, and
the block is orthogonalised and refined. The space is fitted on the benchmark and on every passage of every
document, whose known words are coded once and kept on the executors' disks until it is fitted; every passage
is then projected and compared by cosine. The more items share its dimensions, the less the space keeps of
each, so an exact index stands beside it: text that holds `least_lcs` of an item's words holds some of its
rarest words too, and every window with enough of these is a candidate, whatever its latent cosine, when the
item's words in it make `near` of the item's squared TF-IDF weights. Candidates are windows of SPAN strides;
for longer items strides and windows double until the item fits with a quarter more words. They are checked word by word: the longest common subsequence must hold
`least_lcs` of the item's words, and `least_answer` of its answer, which is the text behind "answer:" or
else its last sentence.

The benchmark is a stated query set. It goes out in blocks of at most BLOCK_ITEMS items and BLOCK_BYTES
bytes, so what is broadcast does not grow with it.

Result: one row for each document and item found in it: doc_id, item_id, cosine (the highest of a passage
in the window), lcs, answer_lcs and the words from first_word to last_word that were compared. Clean documents have no row.

Defined results: null and empty texts, on either side, match nothing; an empty benchmark finds nothing;
repeated rows each give their rows; ties keep the earlier window. Columns of other names do not pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

STRIDE = 32
#: Strides in a window that is compared word by word; windows start at every stride.
SPAN = 4
#: Rare words of an item that a window must hold, where its length allows.
RARE = 3
#: Cells of a table that is counted at once.
CELLS = 4_000_000
LATENT = 128
EXTRA = 16
#: Words that documents hold most often are counted by stride and multiplied at once; the others are added one by one.
COMMON = 256
#: Strides whose vectors are in memory at once, where no text has more.
STRIDES = 16_384
#: Bytes of a slice's partial sums that meet in one task.
SUMS_BYTES = 16_000_000
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16_000_000
EDGE = ".,;:!?|()[]{}<>\"'`*#$%&-_"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
ANSWER = re.compile(r"\banswer\s*:\s*", re.I)
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in lower case without punctuation at their ends, end to end, and offsets; what has no other characters is dropped."""
    raw = pc.ascii_split_whitespace(pc.utf8_lower(texts.fill_null("")))
    offsets = np.asarray(raw.offsets, dtype=np.int64)
    words = pc.utf8_trim(raw.flatten(), characters=EDGE)
    full = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(np.asarray(full, dtype=bool))])
    return words.filter(full), kept[offsets - offsets[0]]


def clean(text: str) -> list[str]:
    return [w for w in (x.strip(EDGE) for x in SPACE.split(text.lower())) if w]


def answer_of(text: str) -> list[str]:
    """Words of the part that answers: behind the last "answer:", else the last sentence of three words or more."""
    marked = ANSWER.split(text)
    if len(marked) > 1 and clean(marked[-1]):
        return clean(marked[-1])
    return next((w for s in reversed(SENTENCE.split(text)) if len(w := clean(s)) >= 3), clean(text))


def masks(words: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def lcs(where: dict[str, int], size: int, words: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel; where: masks() of the shorter text."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = where.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


@dataclass
class Items:
    """A block of the benchmark: words, answers, and their place in the latent space."""

    ids: list
    words: list[list[str]]
    answers: list[list[str]]
    vocabulary: dict[str, int]
    weight: np.ndarray | None = None  # idf of each word
    basis: np.ndarray | None = None  # words x latent, weighted
    latent: np.ndarray | None = None  # items x latent, of length one
    common: np.ndarray | None = None  # the most frequent words, ascending
    bags: np.ndarray | None = None  # the words of all items, one item behind the other
    ends: np.ndarray | None = None  # where they end, with a leading 0

    @property
    def known(self) -> pa.Array:
        return pa.array(list(self.vocabulary), pa.string())

    def coded(self) -> list[list[int]]:
        return [[self.vocabulary[w] for w in ws] for ws in self.words]

    def stride_vectors(self, ids: np.ndarray, numbers: np.ndarray, total: int) -> np.ndarray:
        """The latent sum of each stride. ids: words; numbers: their strides, ascending."""
        return stride_vectors(self.basis, self.common, ids, numbers, total)


def read_items(ids: list, texts: list[str]) -> Items:
    found = [(i, clean(t), answer_of(t)) for i, t in zip(ids, texts, strict=True) if t and clean(t)]
    words = sorted({w for _, ws, _ in found for w in ws})
    return Items([i for i, _, _ in found], [w for _, w, _ in found], [a for _, _, a in found], {w: k for k, w in enumerate(words)})


def split(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words as places in the vocabulary (-1: not in it), end to end, and offsets."""
    words, offsets = words_of(texts)
    return np.asarray(pc.index_in(words, value_set=vocabulary).fill_null(-1), dtype=np.int64), offsets


def blocks_of(offsets: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """The stride of each word, numbered through all texts, and the number of the first stride of each text."""
    sizes = np.diff(offsets)
    strides = -(-sizes // stride)
    first = np.cumsum(strides) - strides
    within = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], sizes)
    return np.repeat(first, sizes) + within // stride, np.append(first, int(strides.sum()))


def stride_sums(rows: np.ndarray, ids: np.ndarray, numbers: np.ndarray, total: int) -> np.ndarray:
    """Sums of rows[ids] with equal (ascending) numbers: the k-th words of all strides are added at once."""
    out = np.zeros((total, rows.shape[1]), dtype=np.float32)
    starts = np.flatnonzero(np.diff(numbers, prepend=-1))
    sizes = np.diff(np.append(starts, len(numbers)))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        starts = starts[: np.searchsorted(-sizes, -k, side="left")]
        out[numbers[starts]] += rows[ids[starts + k]]
    return out


def common_counts(size: int, common: np.ndarray, ids: np.ndarray, numbers: np.ndarray, total: int):
    """Which words are not common; and (low, high, counts of the common words in these strides), a bounded table at a time, however long a text is."""
    place = np.full(size, -1, dtype=np.int64)
    place[common] = np.arange(len(common))
    at = place[ids]
    often = at >= 0
    rows, kinds = numbers[often], at[often]

    def counted():
        for low in range(0, total, STRIDES):
            high = min(total, low + STRIDES)
            own = slice(*np.searchsorted(rows, (low, high)))
            counts = np.bincount((rows[own] - low) * len(common) + kinds[own], minlength=(high - low) * len(common))
            yield low, high, counts.reshape(high - low, -1).astype(np.float32)

    return ~often, counted()


def stride_vectors(rows: np.ndarray, common: np.ndarray, ids: np.ndarray, numbers: np.ndarray, total: int) -> np.ndarray:
    """For each stride the sum of its words' rows. ids: words; numbers: their strides, ascending."""
    out = np.zeros((total, rows.shape[1]), dtype=np.float32)
    rare, tables = common_counts(len(rows), common, ids, numbers, total)
    for low, high, counts in tables:
        out[low:high] = counts @ rows[common]
    return out + stride_sums(rows, ids[rare], numbers[rare], total)


def add_to_words(out: np.ndarray, vectors: np.ndarray, common: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> None:
    """The transpose of stride_vectors(): to each word's row of out the vectors of its strides."""
    rare, tables = common_counts(len(out), common, ids, numbers, len(vectors))
    for low, high, counts in tables:
        out[common] += counts.T @ vectors[low:high]
    ids, numbers = ids[rare], numbers[rare]
    order = np.argsort(ids, kind="stable")
    ids, starts = np.unique(ids[order], return_index=True)
    if len(ids):
        out[ids] += np.add.reduceat(vectors[numbers[order]], starts, axis=0)


def weight_sums(weights: np.ndarray, numbers: np.ndarray, total: int) -> np.ndarray:
    return np.bincount(numbers, weights=weights, minlength=total)[:, None].astype(np.float32)


def with_next(first: np.ndarray) -> np.ndarray:
    """The strides behind which their text goes on."""
    out = np.ones(int(first[-1]), dtype=bool)
    out[first[1:][np.diff(first) > 0] - 1] = False  # the last stride of a text stands alone
    return np.flatnonzero(out)


def passages(sums: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each stride with the next one of its text."""
    out, inner = sums.copy(), with_next(first)
    out[inner] += sums[inner + 1]
    return out


def of_passages(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The transpose of passages(): for each stride the sum over the passages that hold it."""
    out, inner = values.copy(), with_next(first)
    out[inner + 1] += values[inner]
    return out


def coded(docs: DataFrame, items: Items) -> DataFrame:
    """For each document the known words in their order (as bytes of the least type), and how many each stride holds (one byte each)."""
    shared = docs.sparkSession.sparkContext.broadcast(items.known)

    def run(batches):
        vocabulary = shared.value
        kind = np.min_scalar_type(len(vocabulary))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                ids, offsets = split(batch.slice(at, 2048).column(0), vocabulary)
                numbers, first = blocks_of(offsets)
                hit = ids >= 0
                held = np.bincount(numbers[hit], minlength=int(first[-1]))
                ends = np.append(0, np.cumsum(held))[first]
                yield pa.RecordBatch.from_arrays([as_rows(ids[hit].astype(kind), ends), as_rows(held.astype(np.uint8), first)], names=["words", "held"])

    return docs.select("text").mapInArrow(run, "words binary, held binary")


def as_rows(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes of the values between each two ends."""
    data, at = values.tobytes(), (ends * values.itemsize).tolist()
    return pa.array([data[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())


def slices(batch: pa.RecordBatch, size: int):
    """(words, their strides, first stride of each text) of texts that have STRIDES together, or of one text. size: of the vocabulary."""
    kind = np.min_scalar_type(size)
    words, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    ends = np.cumsum([0] + [len(x) for x in held])
    low = 0
    while low < len(held):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + STRIDES, side="right")) - 1)
        counts = np.frombuffer(b"".join(held[low:high]), np.uint8)
        ids = np.frombuffer(b"".join(words[low:high]), kind).astype(np.int64)
        yield ids, np.repeat(np.arange(len(counts)), counts), ends[low : high + 1] - ends[low]
        low = high


def document_frequencies(texts: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """For each word of the vocabulary the documents that hold it, over all documents; and their number. texts: coded()."""

    def run(batches):
        found, n = None, 0
        for batch in batches:
            for ids, numbers, first in slices(batch, size):
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[numbers]
                once = np.unique(owner * size + ids)
                count = np.bincount(once % size, minlength=size)
                found, n = count if found is None else found + count, n + len(first) - 1
        if found is not None:
            hit = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1), pa.int64()), pa.array(np.append(found[hit], n), pa.int64())], names=["word", "n"])

    counts = texts.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    own = counts[counts["word"] >= 0]
    out[own["word"].to_numpy()] = own["n"].to_numpy()
    return out, int(counts.loc[counts["word"] < 0, "n"].sum())


def gram_times(texts: DataFrame, weight: np.ndarray, common: np.ndarray, block: np.ndarray) -> np.ndarray:
    """A^T (A block), where the rows of A are the weighted vectors of all passages, each over the root of its words' squared weights. texts: coded().

    A few tasks for each core go over all texts, and each gives one matrix like the block, in slices that
    are summed by other tasks; so what is exchanged does not grow with the texts.
    """
    context, (size, width) = texts.sparkSession.sparkContext, block.shape
    shared = context.broadcast((weight, common, block))
    tasks = 4 * context.defaultParallelism
    step = max(1, min(-(-size // 16), SUMS_BYTES // (tasks * width * 4)))

    def run(batches):
        w, often, b = shared.value
        out, scaled = None, w[:, None] * b
        for batch in batches:
            for ids, numbers, first in slices(batch, size):
                out = np.zeros(b.shape) if out is None else out
                total = int(first[-1])
                sums = passages(stride_vectors(scaled, often, ids, numbers, total), first)
                squares = passages(weight_sums(w[ids] ** 2, numbers, total), first)
                add_to_words(out, of_passages(sums / np.maximum(squares, 1e-9), first), often, ids, numbers)
        if out is not None:
            out = (w[:, None] * out).astype(np.float32)
            starts = np.arange(0, size, step)
            part = np.full(len(starts), TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(starts), pa.array(part), pa.array([out[a : a + step].tobytes() for a in starts], pa.binary())], names=["start", "part", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in rows.sort_values("part")["sums"])
        return pd.DataFrame({"start": rows["start"].iloc[:1], "sums": [total.astype(np.float32).tobytes()]})

    parts = texts.coalesce(tasks).mapInArrow(run, "start bigint, part bigint, sums binary")
    out = np.zeros(block.shape)
    for row in parts.groupBy("start").applyInPandas(add, "start bigint, sums binary").collect():
        out[row["start"] : row["start"] + step] = np.frombuffer(row["sums"], np.float32).reshape(-1, width)
    return out


def fit_space(docs: DataFrame, items: Items, latent: int, rounds: int = 2, seed: int = 0) -> None:
    """Fill in weight, basis and latent of the items, from all passages of all documents."""
    v = len(items.vocabulary)
    texts = coded(docs, items).persist(StorageLevel.DISK_ONLY)
    frequency, n = document_frequencies(texts, v)
    weight = items.weight = np.log((n + len(items.ids) + 1) / (frequency + 1)).astype(np.float32)
    items.common = np.sort(np.argsort(-frequency, kind="stable")[:COMMON])
    width = min(v, latent + EXTRA)
    own = [np.array([items.vocabulary[w] for w in ws]) for ws in items.words]
    items.bags, items.ends = np.concatenate(own), np.cumsum([0] + [len(x) for x in own])

    rng = np.random.default_rng(seed)
    block, values = np.linalg.qr(rng.normal(size=(v, width)))[0].astype(np.float32), None
    share = 1.0
    for k in range(rounds):
        mine = np.zeros(block.shape)
        for ids in own:
            row = weight[ids][:, None]
            np.add.at(mine, ids, row * ((row * block[ids]).sum(axis=0) / ((row**2).sum() + 1e-9)))  # a word as often as the item holds it
        corpus = gram_times(texts, weight, items.common, block)
        if k == 0:  # the items weigh as much as all passages together, ten times over
            share = 0.1 * np.linalg.norm(mine) / max(1e-9, np.linalg.norm(corpus))
        both = mine + share * corpus
        q, r = np.linalg.qr(both)
        left, values, _ = np.linalg.svd(r)
        block = (q @ left).astype(np.float32)
    texts.unpersist()
    items.basis = weight[:, None] * block[:, : min(latent, width)]
    vectors = np.stack([items.basis[ids].sum(axis=0) for ids in own])
    items.latent = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)


@dataclass
class RareWords:
    """Which items have a word among their rarest ones.

    A window that holds `need` of an item's n words, in any order, lacks n - need at most. So it holds `least`
    of any n - need + least of them, and of the rarest ones in particular.
    """

    which: np.ndarray  # the items
    at: np.ndarray  # for each word of the vocabulary, where its items begin
    items: np.ndarray  # places in which
    least: np.ndarray  # for each of which


def least_words(block: Items, least_lcs: float) -> np.ndarray:
    """Words that the longest common subsequence must hold, for each item."""
    return np.maximum(1, np.ceil(least_lcs * np.diff(block.ends) - 1e-9)).astype(np.int64)


def rare_words(block: Items, need: np.ndarray, which: np.ndarray) -> RareWords:
    least, pairs = np.minimum(RARE, need[which]), []
    for k, i in enumerate(which):
        words = block.bags[block.ends[i] : block.ends[i + 1]]
        rarest = words[np.argsort(-block.weight[words], kind="stable")][: len(words) - need[i] + least[k]]
        pairs.append(np.stack([rarest, np.full(len(rarest), k)]))
    words, items = np.concatenate(pairs, axis=1)
    order = np.argsort(words, kind="stable")
    return RareWords(which, np.searchsorted(words[order], np.arange(len(block.vocabulary) + 1)), items[order], least)


def scale_of(size: int) -> int:
    """Times by which strides and windows for an item of so many words are longer: a copy with a quarter more words fits."""
    scale = 1
    while size * 5 > scale * STRIDE * (SPAN - 1) * 4:
        scale *= 2
    return scale


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def with_rare_words(rare: RareWords, ids: np.ndarray, own: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first stride, item) of the windows that hold enough rare words of an item. ids: known words; own: their strides, ascending."""
    n, total = len(rare.which), int(first[-1])
    postings = np.diff(rare.at)[ids]
    made, out = np.append(0, np.cumsum(postings)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    reach = made[np.searchsorted(own, np.arange(total + SPAN), side="left")]  # postings before each stride
    low = 0
    while low < total:
        high = min(total, low + max(1, CELLS // n))
        high = min(high, max(low + 1, int(np.searchsorted(reach, reach[low] + CELLS, side="right")) - SPAN))
        a, b = np.searchsorted(own, (low, high + SPAN - 1))
        table_rows = np.repeat(own[a:b] - low, postings[a:b])
        held = np.bincount(table_rows * n + rare.items[spread(rare.at[ids[a:b]], postings[a:b])], minlength=(high - low + SPAN - 1) * n).reshape(-1, n)
        sums = sum(held[k : k + high - low] for k in range(SPAN))  # at a text's end this may count words of the next; bags are compared within texts
        rows, items = np.nonzero(sums >= rare.least)
        out.append((rows + low, rare.which[items]))
        low = high
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def with_enough_words(block: Items, need: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: np.ndarray, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates hold so many of the item's words, in any order, and the share of its squared weights in these.

    starts, ends: strides; starts ascend.
    """
    out, shares, sizes = np.zeros(len(starts), dtype=bool), np.zeros(len(starts)), np.diff(block.ends)
    squares = block.weight.astype(np.float64) ** 2 + 1e-9
    step = max(1, min(4 * CELLS // len(block.vocabulary), CELLS // int(sizes.max())))
    for low in range(0, len(starts), step):
        mine, item = slice(low, low + step), items[low : low + step]
        windows, at, row = np.unique(starts[mine], return_index=True, return_inverse=True)
        a, b = np.searchsorted(own, windows), np.searchsorted(own, ends[mine][at])
        held = np.zeros((len(windows), len(block.vocabulary)), dtype=bool)
        held[np.repeat(np.arange(len(windows)), b - a), ids[spread(a, b - a)]] = True
        bag, begin = block.bags[spread(block.ends[item], sizes[item])], np.cumsum(sizes[item]) - sizes[item]
        hits = held[np.repeat(row, sizes[item]), bag]
        out[mine] = np.add.reduceat(hits.astype(np.int64), begin) >= need[item]
        shares[mine] = np.add.reduceat(hits * squares[bag], begin) / np.add.reduceat(squares[bag], begin)
    return out, shares


def search(docs: DataFrame, items: Items, near: float, least_lcs: float, least_answer: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    kinds = (docs.schema["doc_id"].dataType.simpleString(), "bigint")

    def run(batches):
        block, vocabulary = shared.value, shared.value.known
        wanted = [(masks(w), len(w)) for w in block.coded()]
        answers = [(masks([block.vocabulary[x] for x in w]), len(w)) for w in block.answers]
        need, scales = least_words(block, least_lcs), np.array([scale_of(len(w)) for w in block.words])
        indexes = {int(k): rare_words(block, need, np.flatnonzero(scales == k)) for k in np.unique(scales)}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield found(block, vocabulary, wanted, answers, need, scales, indexes, part.column("doc_id"), part.column("text"))

    def found(block, vocabulary, wanted, answers, need, scales, indexes, doc_ids, texts):
        known, offsets = split(texts, vocabulary)
        out: dict[tuple[int, int], tuple] = {}
        if len(known):
            numbers, first = blocks_of(offsets)
            hit = known >= 0
            ids, own = known[hit], numbers[hit]
            weights = passages(weight_sums(block.weight[ids] ** 2, own, int(first[-1])), first)[:, 0]
            sums = passages(block.stride_vectors(ids, own, int(first[-1])), first)
            live = np.flatnonzero(weights > 0)
            near_rows, near_items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            step = max(1, CELLS // len(block.ids))  # a bounded table of similarities, however many items a block holds
            for low in range(0, len(live), step):
                rows = live[low : low + step]
                a, b = np.nonzero((sums[rows] @ block.latent.T) >= near * np.sqrt(weights[rows])[:, None])
                near_rows.append(rows[a])
                near_items.append(b)
            near_rows, near_items = np.concatenate(near_rows), np.concatenate(near_items)
            near_docs = np.searchsorted(first, near_rows, side="right") - 1
            for scale, index in indexes.items():
                numbers, begin = blocks_of(offsets, STRIDE * scale)
                own = numbers[hit]
                starts, items = with_rare_words(index, ids, own, begin)
                mine = scales[near_items] == scale  # the passage with a stride before and behind it
                of = near_docs[mine]
                starts = np.append(starts, np.maximum(begin[of], begin[of] + (near_rows[mine] - first[of]) // scale - 1))
                pairs = starts * len(scales) + np.append(items, near_items[mine])
                by_space = np.unique(pairs[len(items) :])
                pairs = np.unique(pairs)
                starts, items = pairs // len(scales), pairs % len(scales)
                docs_at = np.searchsorted(begin, starts, side="right") - 1
                ends = np.minimum(starts + SPAN, begin[docs_at + 1])
                good, shares = with_enough_words(block, need, starts, ends, items, ids, own)
                good &= (shares >= near) | np.isin(pairs, by_space)  # frequent words alone are not near
                for start, item, doc in zip(starts[good].tolist(), items[good].tolist(), docs_at[good].tolist(), strict=True):
                    low_word = int(offsets[doc]) + (start - int(begin[doc])) * STRIDE * scale
                    high_word = min(int(offsets[doc + 1]), low_word + SPAN * STRIDE * scale)
                    near_words = known[low_word:high_word].tolist()
                    where, size = wanted[item]
                    share = lcs(where, size, near_words) / size
                    if share < least_lcs or share <= out.get((doc, item), (0.0,))[0]:
                        continue
                    at_answer, answer_size = answers[item]
                    answered = lcs(at_answer, answer_size, near_words) / answer_size
                    if answered >= least_answer:
                        row = int(first[doc]) + (start - int(begin[doc])) * scale
                        rows = slice(row, max(row + 1, min(int(first[doc + 1]), row + SPAN * scale) - 1))
                        c = float(np.max(sums[rows] @ block.latent[item] / np.sqrt(np.maximum(weights[rows], 1e-9))))
                        out[doc, item] = (share, answered, c, low_word - int(offsets[doc]), high_word - int(offsets[doc]))
        docs_of = pa.array([d for d, _ in out], pa.int64())
        columns = [doc_ids.take(docs_of), pa.array([block.ids[i] for _, i in out], pa.int64())]
        columns += [pa.array([v[k] for v in out.values()], pa.float64()) for k in (2, 0, 1)]
        columns += [pa.array([v[k] for v in out.values()], pa.int64()) for k in (3, 4)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "cosine", "lcs", "answer_lcs", "first_word", "last_word"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, lcs double, answer_lcs double, first_word bigint, last_word bigint")


def leaks(docs: DataFrame, benchmark: DataFrame, latent: int = LATENT, near: float = 0.3, least_lcs: float = 0.6, least_answer: float = 0.4) -> DataFrame:
    """Documents with passages of the benchmark: doc_id, item_id, cosine, lcs, answer_lcs, first_word, last_word."""
    known = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    out = None
    for k in range(blocks):  # each block is bounded and is a query set against all rows
        rows = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").toPandas()
        items = read_items(rows["item_id"].tolist(), rows["text"].tolist())
        if not items.ids:
            continue
        fit_space(docs, items, latent)
        found = search(docs, items, near, least_lcs, least_answer)
        out = found if out is None else out.unionByName(found)
    if out is not None:
        return out
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id bigint, cosine double, lcs double, answer_lcs double, first_word bigint, last_word bigint")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage found in the documents."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
