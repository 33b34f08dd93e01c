"""Byte-pair encoding and decoding.

Encoding is exact and linear in the length of a piece: an Aho-Corasick automaton over all tokens gives
the longest token that starts at each position; a backtracking walk takes the longest candidate whose
pair with the previous token is one that the merges would also leave standing, and falls back to
shorter prefixes (or gives the previous token back) otherwise. Compatibility of a pair is decided from
the table of merges alone and remembered. Decoding copies token bytes out of one buffer through an
offset table.

The model file is that of the tokenizers library (normaliser NFC, white space, lower case; a split
pattern; byte-level alphabet; end-of-word suffix). It is read on the driver, once, checked to be under
MODEL_LIMIT bytes, and broadcast; workers build the tables when they first need them.

Defined results: a null text counts as empty and gives an empty array; an empty text decodes to "";
ids outside the vocabulary are left out when decoding, as the library does. Characters that Unicode has
assigned only since version 16 may be cut into other pieces than the library's older tables would. Columns of other names
pass through; an existing column of the output's name is replaced.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import table, text_of

#: Bytes of a model file that may be broadcast; public vocabularies are far below.
MODEL_LIMIT = 64_000_000
#: Bytes of pieces and ids in each of the two generations of encodings that a worker remembers, counting MEMO_ENTRY for each.
MEMO_BYTES = 12_000_000
MEMO_ENTRY = 200
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS = 100_000
#: Texts that are split into words at once.
CHUNK = 1024
#: Code points above the byte alphabet that stand for "this symbol ends a word".
ENDED = 0x10000
#: White space as the model's patterns mean it (the Unicode property, without the ASCII separators).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 keeps its place, the rest follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


# Letters and numbers that Unicode 15.1 and 16.0 added, by first and last code point; the tokenizers library reads texts by 16.0.
ADDED = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0),
    (0x11BF0, 0x11BF9), (0x11DE0, 0x11DE9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF),
    (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA), (0x2EBF0, 0x2EE5D),
)
# Lower case of the capitals among them, and of those of Unicode 17.0, which the library's lower case knows already.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


@cache
def later_letters() -> regex.Pattern:
    """Code points that the regex module takes for letters or numbers, but that Unicode 16.0 does not know."""
    added = {c for a, b in ADDED for c in range(a, b + 1)}
    unknown = "".join(chr(c) for c in range(0x80, 0x110000) if c not in added and unicodedata.category(chr(c)) == "Cn")
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", unknown)]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]") if runs else regex.compile("(?!)")


class BpeModel:
    """Tables for one model file. Ranks are places in merge order; ids are the file's."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        vocabulary = model["vocab"]
        self._read_patterns(spec)
        to_symbols = {text: self._symbols(text, suffix) for text in vocabulary}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {self._joined(a, b, suffix) for a, b in pairs}
        order = [t for t in sorted(vocabulary, key=vocabulary.get) if t not in made]
        self.base = len(order)
        order += [self._joined(a, b, suffix) for a, b in pairs]
        rank = {t: i for i, t in enumerate(order)}
        self.names = [vocabulary[t].to_bytes(4, "little") for t in order]
        self.split = [(i, i) for i in range(self.base)]
        self.merged = {}
        for i, (a, b) in enumerate(pairs, start=self.base):
            self.split.append((rank[a], rank[b]))
            self.merged[rank[a], rank[b]] = i
        self.lengths = [len(to_symbols[t]) for t in order]
        self.pair_ok: dict[int, bool] = {}
        reachable = [True] * self.base
        for i in range(self.base, len(order)):
            a, b = self.split[i]
            reachable.append(reachable[a] and reachable[b] and self._compatible(a, b, i))
        self.table = {to_symbols[t]: i for i, t in enumerate(order) if reachable[i]}
        self.shorter = [-1] * len(order)
        self.automaton = ahocorasick.Automaton()
        for symbols, i in self.table.items():
            self.automaton.add_word(symbols, i)
            for k in range(len(symbols) - 1, 0, -1):
                if (p := self.table.get(symbols[:k])) is not None:
                    self.shorter[i] = p
                    break
        self.automaton.make_automaton()
        self.bytes = dict(enumerate(byte_alphabet()))
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memo_bytes = 0
        self._offsets(vocabulary | {x["content"]: x["id"] for x in spec["added_tokens"]})

    @staticmethod
    def _symbols(token: str, suffix: str) -> str:
        if suffix and token.endswith(suffix) and token != suffix:
            body = token[: -len(suffix)]
            return body[:-1] + chr(ord(body[-1]) + ENDED)
        return token

    @staticmethod
    def _joined(a: str, b: str, suffix: str) -> str:
        return a + b

    def _read_patterns(self, spec: dict) -> None:
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace("[^\\s", f"[^{WHITE}"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _offsets(self, names: dict[str, int]) -> None:
        """The decoder's buffer and offsets: each token's UTF-8 bytes behind one space; unknown ids take no bytes."""
        parts, known = [b""] * (max(names.values()) + 1), np.zeros(max(names.values()) + 1, dtype=bool)
        for text, i in names.items():
            parts[i], known[i] = b" " + text.encode(), True
        self.buffer = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.known = known

    def _compatible(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge below limit joins the two tokens across their border, at any stage of their making."""
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit, left = left, self.split[left][1]
                if left == limit:
                    limit, right = right + 1, self.split[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.split[right][0]
                if right + 1 == limit:
                    limit, left = left, self.split[left][1]
                    if left == limit:
                        return True

    def follows(self, left: int, right: int) -> bool:
        key = left * len(self.split) + right
        ok = self.pair_ok.get(key)
        if ok is None:
            if len(self.pair_ok) >= PAIRS:
                self.pair_ok.clear()
            ok = self.pair_ok[key] = self._compatible(left, right, len(self.split))
        return ok

    def encode_symbols(self, symbols: str) -> list[int]:
        """Ranks of the tokens of one piece: a row of tokens whose neighbours are all compatible is the one encoding there is."""
        whole = self.table.get(symbols)
        if whole is not None:
            return [whole]
        longest, start = {}, 0
        for end, token in self.automaton.iter_long(symbols):
            longest[start] = token
            start = end + 1
        n, size, lengths, known, shorter = len(symbols), len(self.split), self.lengths, self.pair_ok, self.shorter
        out, at, token, closed = [], 0, longest[0], set()
        while at < n:
            end = at + lengths[token]
            if end not in closed:
                ok = known.get(out[-1] * size + token) if out else True
                if self.follows(out[-1], token) if ok is None else ok:
                    out.append(token)
                    at = end
                    if at < n and (token := longest.get(at)) is None:
                        token = longest[at] = next(self.automaton.iter_long(symbols, at))[1]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                closed.add(at)
                token = out.pop()
                at -= lengths[token]
        return out

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one piece as 32-bit numbers."""
        found = self.memo.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                text = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.bytes)
                found = self.id_bytes(self.encode_symbols(text[:-1] + chr(ord(text[-1]) + ENDED)))
            self.memo_bytes += len(piece) + len(found) + MEMO_ENTRY
            if self.memo_bytes > MEMO_BYTES:  # what was not asked for since the last turn is forgotten
                self.older, self.memo, self.memo_bytes = self.memo, {}, len(piece) + len(found) + MEMO_ENTRY
            self.memo[piece] = found
        return found

    def id_bytes(self, ranks: list[int]) -> bytes:
        names = self.names
        return names[ranks[0]] if len(ranks) == 1 else b"".join([names[r] for r in ranks])

    def encode_text(self, text: str) -> bytes:
        out: list[bytes] = []
        for part in self.cut.split(text) if self.cut and "<" in text else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            if not part.isascii():  # lower case goes character by character: no final sigma
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").translate(LOWER).lower()
                plain = later_letters().sub("\ue000", part)  # no letter, as the library has it
                if plain != part:
                    out += [self.encode_piece(part[m.start() : m.end()]) for m in self.pieces.finditer(plain)]
                    continue
            out += [self.encode_piece(piece) for piece in self.pieces.findall(part.lower())]
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_text(text), dtype="<i4").tolist()

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, laid end to end, and where each text ends in them.

        No piece crosses ASCII white space, so each distinct word between such is encoded once and its
        ids are copied to its places.
        """
        words = pc.ascii_split_whitespace(texts)
        ends = np.asarray(words.offsets, dtype=np.int64)
        coded = words.values.dictionary_encode()
        ids = [self.encode_text(w) for w in coded.dictionary.to_pylist()]
        sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(ids), dtype="<i4")
        at = np.asarray(coded.indices, dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(sizes[at])])
        places = np.repeat((starts[at] - total[:-1]).astype(np.int32), sizes[at]) + np.arange(total[-1], dtype=np.int32)
        return flat[places], total[ends]

    def encode_lists(self, texts: pa.Array) -> pa.ListArray:
        ids, ends = self.encode_batch(texts)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    def decode_lists(self, lists: pa.ListArray, step: int = 1 << 16) -> pa.Array:
        """The texts of lists of ids, a bounded number of tokens (whole lists) at once."""
        sizes = np.asarray(pc.list_value_length(lists).fill_null(0), dtype=np.int64)
        flat, ends = np.asarray(lists.flatten().fill_null(-1)), np.cumsum(sizes)
        row, from_, texts = 0, 0, []
        while row < len(sizes):
            upto = max(row + 1, int(np.searchsorted(ends, from_ + step, side="right")))
            data, cuts = self.decode_flat(flat[from_ : ends[upto - 1]], ends[row:upto] - from_)
            raw, start = data.tobytes(), 0
            for cut in cuts.tolist():
                texts.append(raw[start:cut].decode("utf-8"))
                start = cut
            from_, row = int(ends[upto - 1]), upto
        return pa.array(texts, pa.string())

    def forget(self) -> None:
        """Free what was remembered; the tables stay."""
        self.memo, self.older, self.memo_bytes = {}, {}, 0
        self.pair_ok.clear()
        pa.default_memory_pool().release_unused()

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of many lists of ids, laid end to end, and where each list ends in them."""
        good = (ids >= 0) & (ids < len(self.known))
        good[good] = self.known[ids[good]]
        kept = np.concatenate([[0], np.cumsum(good)])
        ends, ids = kept[ends], ids[good].astype(np.int64)
        starts, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        first = np.unique(np.concatenate([[0], ends]))
        first = first[first < len(ids)]
        starts[first] += 1  # no space before the first token of a list
        sizes[first] -= 1
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])
        return self.buffer[at], total[ends]


_models: dict[int, BpeModel] = {}


def _model(shared) -> BpeModel:
    """The worker's tables for a broadcast model file."""
    key = hash(shared.value)
    if key not in _models:
        _models.clear()
        _models[key] = BpeModel(shared.value)
    return _models[key]


def load_model(spark: SparkSession, path: str):
    """Broadcast a model file after checking its size."""
    with open(path, "rb") as f:
        data = f.read(MODEL_LIMIT + 1)
    if len(data) > MODEL_LIMIT:
        raise ValueError(f"{path} is over {MODEL_LIMIT} bytes; it is not broadcast")
    return spark.sparkContext.broadcast(data)


def encode(df: DataFrame, model, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the array<int> column `out`, the token ids of the whole text. model: from load_model()."""

    @arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        done = [_model(model).encode_lists(texts.slice(row, CHUNK)) for row in range(0, len(texts), CHUNK)]
        return pa.concat_arrays(done or [pa.array([], pa.list_(pa.int32()))])

    return df.withColumn(out, ids_of(text_of(text)))


def decode(df: DataFrame, model, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the string column `out`, the tokens of the ids joined by one space. Null ids count as none."""

    @arrow_udf("string")
    def text_of_ids(lists: pa.Array) -> pa.Array:
        done = [_model(model).decode_lists(lists.slice(row, CHUNK)) for row in range(0, len(lists), CHUNK)]
        return pa.concat_arrays(done or [pa.array([], pa.string())])

    return df.withColumn(out, text_of_ids(F.col(ids)))


def encode_decode(df: DataFrame, model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of df with ids and decoded, for whole tables: CHUNK rows at a time go in and out, and a task leaves nothing but the tables in its worker."""
    rows = df.select(*keep, text_of(text).alias("text"))

    def run(batches):
        tables = _model(model)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    ids = tables.encode_lists(part.column(len(keep)))
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], ids, tables.decode_lists(ids)], names=[*keep, "ids", "decoded"])
        finally:
            tables.forget()

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*kinds, "ids array<int>", "decoded string"]))


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digests(table(spark, sf_dir, "documents"), path)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    model = load_model(docs.sparkSession, path or default_model_path())
    coded = encode_decode(docs, model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
