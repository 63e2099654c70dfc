"""Token ids in binary form: canonical length-limited Huffman codes in independent blocks.

A store is a folder of two Parquet tables, so that writing is atomic and safe against
lost tasks on any file system Spark knows:

``codebook``  one row per id that occurs: id, bits (the length of its code). Lengths are
    optimal under a limit (package-merge) for the counts of the whole corpus; codes are
    canonical, that is numbered by (bits, id), so lengths are all a reader needs.
``blocks``    part, block, doc_ids, n_tokens (per document), n_ids, checkpoints, payload.
    ``payload`` is the bit string of the block's ids; ``checkpoints`` are the bit offsets
    of every CHECKPOINT-th id. Parts and blocks ascend with doc_id. A block decodes
    without any other, and within it every checkpoint is a place to start: the decoder
    walks all checkpoints of many blocks at once, one table look-up per id.

Steps: texts are encoded once into a stored table of raw ids (no shuffle), counted
(at most one row per vocabulary entry reaches the driver), dealt by ranges of doc_id and
packed. Positions over the whole store come from sums per part, never from one task.

Defined cases: a null or empty text has only the end id; a null doc_id sorts first;
repeated rows are stored again, next to each other; an empty table gives an empty store;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.storage import new_path, remove
from rankloom.llm.textops import mapped, per_batch, sole_memo
from rankloom.llm.wordbpe import BREAK, OTHER, pre_tokens, split_words, vocabulary

#: Ids between two checkpoints of a block.
CHECKPOINT = 256
#: A block ends with the document that brings it to this many ids.
BLOCK_IDS = 32_768
MEMO_WORDS = 800_000


class _Places(dict):
    """Pre-token -> its number; new ones are numbered on and noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


class LibraryEncoder:
    """Texts to ids by the tokenizers library; each distinct pre-token is encoded once and kept in a bounded memo.

    New pre-tokens of a batch go to the library as one text parted by blanks; the word ending
    of the last token of each tells them apart again. They are normal already, so the
    library's model runs behind a split at blanks and the byte-level step alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.normalizer = normalizers.Sequence([])
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.vocabulary = v = vocabulary(path)
        self.ends = np.zeros(v.size, dtype=bool)
        self.ends[[i for t, i in v.ids.items() if t.endswith(v.suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.index = _Places()
        self.index[BREAK] = 0
        self.flat = np.empty(0, dtype=np.uint32)
        self.starts = np.zeros(2, dtype=np.int64)

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        found = self.library.encode_batch_fast([" ".join(new[i : i + 4096]) for i in range(0, len(new), 4096)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in found])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("the library and the split into pre-tokens disagree")
        self.starts = np.concatenate([self.starts, len(self.flat) + ends])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: pa.Array | list[str | None], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of ids of each text."""
        sole_memo(self, self.clear)
        if len(self.index) > MEMO_WORDS or len(self.flat) > 16 * MEMO_WORDS:
            self.clear()
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        v = self.vocabulary
        if v.special and pc.any(pc.match_substring(texts, v.start)).as_py():
            cut = [v.segments(t or "") or [("", False)] for t in texts.to_pylist()]
            parts = list(chain.from_iterable(cut))
            marks = np.array([special for _, special in parts])
            ids, ends = self._plain(pa.array([None if special else part for part, special in parts], texts.type))
            ids = np.insert(ids, ends[marks], np.array([v.special[part] for part, special in parts if special], dtype=np.uint32))
            ends = (ends + np.cumsum(marks))[np.cumsum([len(c) for c in cut]) - 1]
        else:
            ids, ends = self._plain(texts)
        per_doc = np.diff(ends, prepend=0)
        if end_id is not None:
            ids = np.insert(ids, ends, np.uint32(end_id))
            per_doc = per_doc + 1
        return ids, per_doc

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without control strings, and the number of ids up to the end of each text.

        Each distinct word of the batch is split once. Splitting into pre-tokens, lower case and
        normal form do not look across ASCII white space, so a word gives the same ids wherever it stands.
        """
        texts = pc.fill_null(texts, "")
        # letters beyond ASCII take their normal form before they become lower case
        split = pc.ascii_split_whitespace(pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        kind = np.where(pc.string_is_ascii(words), 0, np.where(pc.match_substring_regex(words, OTHER), 2, 1))
        tokens: list[str] = []
        for pattern in (0, 1):
            some = words.filter(pa.array(kind == pattern))
            if len(some):
                tokens += split_words(pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), BREAK)[0].as_py() + BREAK)
        for word in words.filter(pa.array(kind == 2)).to_pylist():
            tokens += pre_tokens(word)
            tokens.append(BREAK)
        at = np.fromiter(map(self.index.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if self.index.new:
            self._learn()
        ids, ends = _gathered(self.flat, self.starts[at], self.starts[at + 1])
        # words stand in ``tokens`` by kind
        word_ends = ends[at == 0]
        place = np.empty(len(kind), dtype=np.int64)
        place[np.argsort(kind, kind="stable")] = np.arange(len(kind))
        used = place[coded.indices.to_numpy()]
        ids, ends = _gathered(ids, np.concatenate([[0], word_ends])[used], word_ends[used])
        return ids, np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(split).to_numpy())]


def _gathered(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` one after the other, and where each ends."""
    lengths = stops - starts
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], ends


@cache
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge.

    Level by level, pairs of the cheapest entries of the level below are merged into the
    sorted counts; the first 2n - 2 entries of the top are taken, and walking down, every
    symbol among the entries taken at a level gains one bit.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    limit = limit or max(15, n.bit_length() + 1)
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    leaf_levels, packages = [], np.empty(0)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        by = np.argsort(both, kind="stable")
        leaf_levels.append(by < n)
        both = both[by]
        packages = both[0 : len(both) // 2 * 2 : 2] + both[1 : len(both) // 2 * 2 : 2]
    bits, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for leaves in reversed(leaf_levels):
        symbols = int(np.count_nonzero(leaves[:take]))
        bits[:symbols] += 1
        take = 2 * (take - symbols)
    out = np.empty(n, dtype=np.int64)
    out[order] = bits
    return out


class Codebook:
    """Canonical codes for ids with given lengths; encodes and decodes blocks."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.limit = int(self.bits.max()) if len(ids) else 1
        spans = np.left_shift(np.int64(1), self.limit - self.bits)
        lows = np.cumsum(spans) - spans
        size = int(self.ids.max()) + 1 if len(ids) else 0
        self.bits_of, self.code_of = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.uint64)
        self.bits_of[self.ids] = self.bits
        self.code_of[self.ids] = (lows >> (self.limit - self.bits)).astype(np.uint64)
        rest = (1 << self.limit) - int(spans.sum())
        self.table_id = np.concatenate([np.repeat(self.ids, spans), np.zeros(rest, dtype=np.int64)]).astype(np.uint32)
        self.table_bits = np.concatenate([np.repeat(self.bits, spans), np.ones(rest, dtype=np.int64)]).astype(np.int32)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string of ``ids`` and the bit offset of every CHECKPOINT-th id."""
        if not len(ids):
            return b"", np.empty(0, dtype=np.int64)
        bits = self.bits_of[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        word = starts >> 5
        shifted = self.code_of[ids] << (64 - bits - (starts & 31)).astype(np.uint64)
        n = int(ends[-1] + 31 >> 5) + 1
        # codes do not overlap, so the sums of 32-bit parts are exact in doubles
        high = np.bincount(word, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=n)
        low = np.bincount(word + 1, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
        words = (high[:n] + low[:n]).astype(np.uint32)
        return words.astype(">u4").tobytes()[: int(ends[-1] + 7 >> 3)], starts[::CHECKPOINT]

    def unpack(self, payloads: list[bytes], checkpoints: list[np.ndarray], n_ids: np.ndarray) -> np.ndarray:
        """The ids of several blocks, one block after the other."""
        total = int(np.sum(n_ids))
        if not total:
            return np.empty(0, dtype=np.uint32)
        sizes = np.fromiter(map(len, payloads), dtype=np.int64, count=len(payloads)) + 8
        raw = np.frombuffer(b"".join(p + b"\0" * 8 for p in payloads), dtype=np.uint8).astype(np.uint32)
        window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        lanes = np.fromiter(map(len, checkpoints), dtype=np.int64, count=len(checkpoints))
        block = np.repeat(np.arange(len(payloads)), lanes)
        place = (np.arange(len(block)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * CHECKPOINT
        bit = np.concatenate(checkpoints) + 8 * (np.cumsum(sizes) - sizes)[block]
        out_at = place + (np.cumsum(n_ids) - n_ids)[block]
        left = np.minimum(CHECKPOINT, np.asarray(n_ids)[block] - place)
        order = np.argsort(-left, kind="stable")
        bit, out_at, left = bit[order], out_at[order], left[order]
        active = np.searchsorted(-left, -np.arange(CHECKPOINT), side="left")
        out = np.empty(total, dtype=np.uint32)
        down, mask = np.int64(32 - self.limit), np.uint32((1 << self.limit) - 1)
        for step in range(int(left[0])):
            k = int(active[step])
            b = bit[:k]
            seen = window[b >> 3] >> (down - (b & 7)).astype(np.uint32) & mask
            out[out_at[:k] + step] = self.table_id[seen]
            bit[:k] = b + self.table_bits[seen]
        return out


@lru_cache(maxsize=4)
def _codebook(path: str, ids: bytes, bits: bytes) -> Codebook:
    return Codebook(np.frombuffer(ids, dtype=np.int64), np.frombuffer(bits, dtype=np.int64))


def _tokenised(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: a row (doc_id, ids) for each document and at the end a row with the counts of all ids."""
    size = vocabulary(path).size
    kind_of_id = np.dtype("<u4" if size > 1 << 16 else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(max(size, end_id + 1), dtype=np.int64)
        type_ = None
        for batch in batches:
            type_ = batch.schema.field(0).type
            ids, per_doc = library_encoder(path).encode(batch.column(1), end_id)
            n += np.bincount(ids, minlength=len(n))
            raw = ids.astype(kind_of_id).tobytes()
            ends = np.cumsum(per_doc) * kind_of_id.itemsize
            cut = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.binary()), pa.nulls(len(cut), pa.binary())], names=["doc_id", "ids", "counts"])
        if type_ is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, type_), pa.nulls(1, pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["doc_id", "ids", "counts"])

    return run


def _unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [np.frombuffer(b, dtype=np.int64) for b in batch.column(0).to_pylist()]
    ids = [np.flatnonzero(r) for r in rows]
    flat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
    return pa.RecordBatch.from_arrays([flat(ids), flat([r[i] for r, i in zip(rows, ids)])], names=["id", "n"])


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> None:
    """Encodes the texts of ``docs`` (doc_id, text) and writes a store to ``folder``."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    kind_of_id = np.dtype("<u4" if vocabulary(tokenizer).size > 1 << 16 else "<u2")
    raw_path = new_path(spark, "raw-ids")
    encoded = mapped(docs.select("doc_id", "text"), _tokenised(tokenizer, end_id), f"doc_id {kind}, ids binary, counts binary")
    encoded.write.parquet(raw_path)
    stored = spark.read.schema(encoded.schema).parquet(raw_path)
    raw = stored.where("ids is not null").select("doc_id", "ids")

    # at most one row for each entry of the vocabulary
    counts = mapped(stored.select("counts").where("counts is not null"), per_batch(_unpacked, 64), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    ids, n = counts["id"].to_numpy(), counts["n"].to_numpy()
    bits = code_lengths(n)
    spark.createDataFrame(pa.table({"id": ids, "bits": bits}), "id long, bits long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/codebook")
    book = (tokenizer, ids.tobytes(), bits.tobytes())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part, block = _codebook(*book), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            payload, marks = codes.pack(np.frombuffer(b"".join(held), dtype=kind_of_id).astype(np.int64))
            per_doc = [len(h) // kind_of_id.itemsize for h in held]
            row = {"part": [part], "block": [block], "doc_ids": [names], "n_tokens": [per_doc], "n_ids": [sum(per_doc)], "checkpoints": [marks], "payload": [payload]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(doc_type)), ("n_tokens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())]))

        doc_type = pa.int64()
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names.append(name)
                held.append(data)
                size += len(data) // kind_of_id.itemsize
                if size >= BLOCK_IDS:
                    yield flush()
                    names, held, size, block = [], [], 0, block + 1
        if held:
            yield flush()

    schema = f"part int, block int, doc_ids array<{kind}>, n_tokens array<long>, n_ids long, checkpoints array<long>, payload binary"
    mapped(raw.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids"), packed, schema).write.mode("overwrite").parquet(f"{folder}/blocks")
    remove(spark, raw_path)


def _book_of(spark: SparkSession, folder: str) -> tuple[str, bytes, bytes]:
    book = spark.read.schema("id long, bits long").parquet(f"{folder}/codebook").orderBy("id").toArrow()
    return folder, book["id"].to_numpy().tobytes(), book["bits"].to_numpy().tobytes()


def _decoded(book: tuple[str, bytes, bytes], columns: Callable[[np.ndarray], list], fields: list[tuple[str, pa.DataType]]):
    """For mapInArrow over blocks: a row per document, with ``columns`` made from its ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        n_ids = get("n_ids").to_numpy()
        ids = _codebook(*book).unpack(get("payload").to_pylist(), [np.array(c, dtype=np.int64) for c in get("checkpoints").to_pylist()], n_ids)
        n_tokens = get("n_tokens").flatten()
        per_block = get("n_tokens").value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), per_block)
        ends = np.cumsum(n_tokens.to_numpy())
        starts = ends - n_tokens.to_numpy()
        base = (np.cumsum(n_ids) - n_ids)[row]
        made = [columns(ids[a:b]) for a, b in zip(starts, ends)]
        arrays = [get("part").take(pa.array(row)), get("block").take(pa.array(row)), get("doc_ids").flatten(), pa.array(starts - base, pa.int64()), n_tokens]
        arrays += [pa.array([m[k] for m in made], t) for k, (_, t) in enumerate(fields)]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "block", "doc_id", "at", "n_tokens", *(f for f, _ in fields)])

    return per_batch(run, 32)


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The store as doc_id, n_tokens, ids (array of int)."""
    blocks = _blocks(spark, folder)
    kind = dict(blocks.dtypes)["doc_ids"][len("array<") : -1]
    read = _decoded(_book_of(spark, folder), lambda ids: [ids.astype(np.int32)], [("ids", pa.list_(pa.int32()))])
    return mapped(blocks, read, f"part int, block int, doc_id {kind}, at long, n_tokens long, ids array<int>").select("doc_id", "n_tokens", "ids")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, start (ids of the store before it), n_tokens, ids_crc32 (of little-endian 32-bit ids)."""
    blocks = _blocks(spark, folder)
    kind = dict(blocks.dtypes)["doc_ids"][len("array<") : -1]
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per part here, and per block below: payloads are not read
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    places = places.join(parts, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("base"))
    read = _decoded(_book_of(spark, folder), lambda ids: [zlib.crc32(ids.astype("<u4").tobytes())], [("ids_crc32", pa.int64())])
    rows = mapped(blocks, read, f"part int, block int, doc_id {kind}, at long, n_tokens long, ids_crc32 long")
    return rows.join(places, ["part", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
