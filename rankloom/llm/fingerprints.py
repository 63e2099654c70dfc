"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraphs (lines, long lines into sentences, long sentences into runs
of words counted from their start), each hashed to 48 bits together with the number of
equal paragraphs before it. A sketch has three parts of cells, each a power of two long;
every digest is added to one cell of each part: a count, the sum of digests and the sum of
16-bit check values, modulo 2^48 and 2^16. A cell of a part is named by the low bits of a
hash, so a sketch folds to half its size by adding its halves. A check value that fits by
chance leaves cells that do not empty, and the pair is compared again in larger sketches.

Subtracting two sketches of one size leaves the digests in which the texts differ.
Peeling recovers them: a cell with count +-1 whose check value fits gives one digest,
which is taken out of its other cells, and so on until nothing is left. When peeling gets
stuck a pair is compared again in sketches twice as large. The number of recovered digests
gives the exact likeness of the two sets of paragraphs (intersection / union).

The published fingerprint is one sketch in base 64, 12 characters a cell, of the least size
that is at least 1.5 times the number of paragraphs and can be peeled by itself. It depends on the text alone,
so equal texts have equal fingerprints, and it suffices for everything above:
``parse_fingerprint`` reads it back, ``fingerprint_differences`` and
``fingerprint_likeness`` compare two strings, folding the larger sketch to the size of the
smaller and, when stuck, listing both to make larger ones.

All texts of a batch are sketched and peeled together in numpy. The next document is found
without a global window: documents are dealt by ranges of doc_id whose bounds come from
the id column alone, and the first document of each range is sent to the range before it
as well.

Defined cases: a null or empty text has no paragraphs, and two such texts have likeness
1; a null doc_id comes after all others; rows with equal doc_id are ordered by text; the
document after the last is the first (itself, if it is the only one); ids are whole numbers
or strings (ordered by code point); texts of any length are read whole, CHUNK at a time; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.textops import mapped

#: Cells of the smallest part of a sketch, a power of two.
LEAST_PART = 4
#: Bits of a digest.
MASK = (1 << 48) - 1
LONG_LINE = 160
RUN_WORDS = 32
#: Ranges of doc_id for each shuffle partition.
RANGES = 8
#: Texts that are sketched together.
CHUNK = 128
LAST = (1 << 63) - 1

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_RUN = re.compile(rf"(?:\S+\s*){{1,{RUN_WORDS}}}")
_U = np.uint64


def paragraphs(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        if len(line) <= LONG_LINE:
            if line:
                out.append(line)
            continue
        for sentence in _SENTENCE.split(line):
            if len(sentence) <= LONG_LINE:
                out.append(sentence)
            else:
                out += _RUN.findall(sentence) or [sentence]
    return out


def digests(text: str) -> list[int]:
    """Distinct digests: a paragraph's n-th repetition has a digest of its own."""
    parts = paragraphs(text)
    found = [xxhash.xxh3_64_intdigest(p) & MASK for p in parts]
    if len(set(found)) == len(found):
        return found
    seen: dict[int, int] = {}
    out = []
    for d in found:
        n = seen[d] = seen.get(d, -1) + 1
        out.append(d if n == 0 else xxhash.xxh3_64_intdigest(d.to_bytes(8, "little"), seed=n) & MASK)
    return out


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + _U(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def _check(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 99) >> _U(48)).astype(np.uint16)


#: Bytes of a published cell: count, check sum, sum of digests.
_COUNT, _CHECK, _SUM = slice(0, 1), slice(1, 3), slice(3, 9)
CELL_BYTES = 9


class Sketches:
    """One sketch for each of several texts, with parts of their own lengths, in flat arrays."""

    def __init__(self, parts: np.ndarray, keys: np.ndarray, owner: np.ndarray):
        self.parts = np.asarray(parts, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(3 * self.parts)])
        size = int(self.starts[-1])
        self.count, self.sums, self.checks = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint16)
        self.add(keys, owner, np.ones(len(keys), dtype=np.int64))

    def places(self, keys: np.ndarray, owner: np.ndarray) -> Iterator[np.ndarray]:
        part, start = self.parts[owner], self.starts[owner]
        for j in range(3):
            yield start + j * part + (_mixed(keys, j) & (part - 1).astype(np.uint64)).astype(np.int64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            check = _check(keys)
            for at in self.places(keys, owner):
                np.add.at(self.count, at, sign)
                np.add.at(self.sums, at, keys * sign.astype(np.uint64))
                np.add.at(self.checks, at, check * sign.astype(np.uint16))

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.parts, np.empty(0, np.uint64), np.empty(0, np.int64))
        out.count, out.sums, out.checks = self.count - other.count, self.sums - other.sums, self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests that are left, their texts and signs, and which texts came out whole. Empties the sketches."""
        keys, owners, signs = [], [], []
        text_of = np.repeat(np.arange(len(self.parts)), 3 * self.parts)
        looked, rounds = np.flatnonzero(np.abs(self.count) == 1), 0
        while len(looked) and rounds <= len(self.count):
            rounds += 1
            sign = self.count[looked]
            key = self.sums[looked] * sign.astype(np.uint64) & _U(MASK)
            good = self.checks[looked] * sign.astype(np.uint16) == _check(key)
            owner, key, sign = text_of[looked][good], key[good], sign[good]
            if not len(key):
                break
            order = np.lexsort((key, owner))
            owner, key, sign = owner[order], key[order], sign[order]
            first = np.ones(len(key), dtype=bool)
            first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            owner, key, sign = owner[first], key[first], sign[first]
            self.add(key, owner, -sign)
            keys.append(key)
            owners.append(owner)
            signs.append(sign)
            touched = np.unique(np.concatenate([*self.places(key, owner)]))
            looked = touched[np.abs(self.count[touched]) == 1]
        whole = np.ones(len(self.parts), dtype=bool)
        whole[text_of[(self.count != 0) | (self.sums & _U(MASK) != 0) | (self.checks != 0)]] = False
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, dtype=kind)
        return join(keys, np.uint64), join(owners, np.int64), join(signs, np.int64), whole

    def packed(self) -> list[bytes]:
        """Every sketch as bytes. Counts are below 128 in sketches of published size, which the caller checks."""
        cells = np.zeros((len(self.count), CELL_BYTES), dtype=np.uint8)
        cells[:, _COUNT] = self.count.astype(np.int8).view(np.uint8)[:, None]
        cells[:, _CHECK] = self.checks.astype("<u2").view(np.uint8).reshape(-1, 2)
        cells[:, _SUM] = self.sums.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        raw = cells.tobytes()
        return [raw[CELL_BYTES * a : CELL_BYTES * b] for a, b in zip(self.starts, self.starts[1:])]

    def most(self) -> np.ndarray:
        """The highest count of every sketch."""
        return np.maximum.reduceat(self.count, self.starts[:-1]) if len(self.parts) else np.empty(0, np.int64)


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(s) for s in sets]
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.repeat(np.arange(len(sets)), sizes)


def _power(n: np.ndarray) -> np.ndarray:
    """The least power of two that is not below n or LEAST_PART."""
    return 2 ** np.ceil(np.log2(np.maximum(n, LEAST_PART))).astype(np.int64)


def fingerprints_of(sets: list[np.ndarray]) -> tuple[list[bytes], np.ndarray]:
    """The published sketch of each set of digests as bytes, and the lengths of its parts."""
    parts = _power(np.array([len(s) / 2 for s in sets])) if sets else np.empty(0, np.int64)
    open_ = np.arange(len(sets))
    while len(open_):  # sketches that cannot be peeled by themselves, or count too high for a byte, grow
        made = Sketches(parts[open_], *_flat([sets[i] for i in open_]))
        fits = made.most() < 128
        *_, whole = made.peel()
        open_ = open_[~(whole & fits)]
        parts[open_] *= 2
    return Sketches(parts, *_flat(sets)).packed(), parts


def differences(a: list[np.ndarray], b: list[np.ndarray], parts: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets what only the first and only the second has, from sketches alone.

    ``parts`` are the lengths to begin with. Sketching at a length is the same as folding a longer sketch to it.
    """
    out: list = [None] * len(a)
    parts = np.full(len(a), LEAST_PART, dtype=np.int64) if parts is None else parts.copy()
    open_ = np.arange(len(a))
    while len(open_):
        left, right = [a[i] for i in open_], [b[i] for i in open_]
        keys, owners, signs, whole = Sketches(parts[open_], *_flat(left)).minus(Sketches(parts[open_], *_flat(right))).peel()
        order = np.argsort(owners, kind="stable")
        keys, owners, signs = keys[order], owners[order], signs[order]
        bounds = np.searchsorted(owners, np.arange(len(open_) + 1))
        for i in np.flatnonzero(whole):
            k, s = keys[bounds[i] : bounds[i + 1]], signs[bounds[i] : bounds[i + 1]]
            out[open_[i]] = (k[s > 0], k[s < 0])
        open_ = open_[~whole]
        parts[open_] *= 2
    return out


def _share(only: int, both: int) -> float:
    """Common / all of two sets of ``both`` members together, ``only`` of them in one alone."""
    return (both - only) / (both + only) if both + only else 1.0


def likeness(a: list[np.ndarray], b: list[np.ndarray], parts: np.ndarray | None = None) -> list[float]:
    """Common / all digests of each pair of sets, from the recovered differences and the set sizes."""
    return [_share(len(x) + len(y), len(p) + len(q)) for (x, y), p, q in zip(differences(a, b, parts), a, b)]


# ---- published strings ------------------------------------------------------------------


def parse_fingerprint(text: str) -> Sketches:
    """The sketch of a published fingerprint."""
    cells = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, CELL_BYTES)
    out = Sketches(np.array([len(cells) // 3]), np.empty(0, np.uint64), np.empty(0, np.int64))
    out.count = cells[:, 0].astype(np.int8).astype(np.int64)
    out.checks = np.ascontiguousarray(cells[:, _CHECK]).view("<u2").reshape(-1).astype(np.uint16)
    out.sums = np.pad(cells[:, _SUM], ((0, 0), (0, 2))).reshape(-1).view("<u8").astype(np.uint64)
    return out


def folded(s: Sketches, part: int) -> Sketches:
    """One sketch with parts of ``part`` cells, from one with longer parts."""
    out = Sketches(np.array([part]), np.empty(0, np.uint64), np.empty(0, np.int64))
    for name in ("count", "sums", "checks"):
        cells = getattr(s, name).reshape(3, -1, part)
        setattr(out, name, cells.sum(axis=1, dtype=cells.dtype).reshape(-1))
    return out


def listed(text: str) -> np.ndarray:
    """All digests in a published fingerprint."""
    keys, _, _, whole = parse_fingerprint(text).peel()
    if not whole.all():
        raise ValueError("not a published fingerprint")
    return np.sort(keys)


def fingerprint_differences(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """The digests that only the first and only the second of two published fingerprints hold."""
    x, y = parse_fingerprint(a), parse_fingerprint(b)
    part = int(min(x.parts[0], y.parts[0]))
    keys, _, signs, whole = folded(x, part).minus(folded(y, part)).peel()
    if whole.all():
        return keys[signs > 0], keys[signs < 0]
    return differences([listed(a)], [listed(b)], np.array([2 * part]))[0]


def fingerprint_likeness(a: str, b: str) -> float:
    """Common / all digests of two published fingerprints."""
    first, second = fingerprint_differences(a, b)
    size = lambda s: int(parse_fingerprint(s).count.sum()) // 3
    return _share(len(first) + len(second), size(a) + size(b))


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many, or all, of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _compared(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """Output for consecutive rows of (doc_id, text); the last row is only the next of the one before."""
    ids, texts = [r[0] for r in rows[:-1]], [r[1] for r in rows]
    edited = [edited_text(t, n) for t, n in zip(texts, texts[1:])]
    own = [np.array(digests(t), dtype=np.uint64) for t in texts]
    other = [np.array(digests(t), dtype=np.uint64) for t in edited]
    prints, parts = fingerprints_of(own + other)
    n = len(ids)
    shown = [base64.b64encode(p).decode() for p in prints]
    columns = [
        [len(t) for t in texts[:-1]],
        [sha256(t.encode()).hexdigest() for t in edited],
        shown[:n],
        shown[n + 1 :],
        likeness(own[:-1], other, np.minimum(parts[:n], parts[n + 1 :])),
        likeness(own[:-1], own[1:], np.minimum(parts[:n], parts[1 : n + 1])),
    ]
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, t) for c, (_, t) in zip(columns, _OUT))], names=["doc_id", *(f for f, _ in _OUT)])


def _range_number(cuts: list, at: Column) -> Column:
    """How many of the sorted ``cuts`` are below ``at``: first among the last of every group of cuts, then inside one group."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    kind = "string" if isinstance(cuts[0], str) else "bigint"
    array = lambda values: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
    below = lambda c: F.size(F.filter(c, lambda x: x < at))
    groups = below(array(cuts[step - 1 :: step])) * step
    return groups + below(F.slice(array(cuts), groups + 1, F.lit(step)))


def with_next(docs: DataFrame, parts: int, ranges: int) -> DataFrame:
    """bucket, guest, doc_id, text: ranges of documents, each followed by the first document of the next (guest = 1).

    The tables joined here have one row per range. More ranges than parts even the parts out.
    """
    kind = dict(docs.dtypes)["doc_id"]
    if kind == "string":  # null sorts after every string
        at = F.when(F.col("doc_id").isNull(), "1").otherwise(F.concat(F.lit("0"), "doc_id")).alias("at")
    elif kind in ("bigint", "int", "smallint", "tinyint"):
        at = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at")
    else:
        raise TypeError(f"doc_id is {kind}; whole numbers and strings have an order here")
    ids = docs.select(at)
    if ranges == 1:
        cuts = []
    elif kind == "string":
        dealt = ids.repartitionByRange(ranges, "at").select("at", F.spark_partition_id().alias("p"))
        cuts = sorted(r["m"] for r in dealt.groupBy("p").agg(F.max("at").alias("m")).collect())[:-1]  # a row per range
    else:
        cuts = ids.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("c")).first()["c"]
    bucket = _range_number(sorted(set(cuts or [])), F.col("at")).alias("bucket")
    firsts = ids.select("at", bucket).groupBy("bucket").agg(F.min("at").alias("first")).orderBy("bucket").collect()  # a row per range
    known = [(first, firsts[i - 1]["bucket"] if i else firsts[-1]["bucket"]) for i, (_, first) in enumerate(map(tuple, firsts))]
    guests = docs.sparkSession.createDataFrame(known, f"first {'string' if kind == 'string' else 'long'}, before int")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), at).select("*", bucket)
    joined = d.join(F.broadcast(guests), F.col("at") == F.col("first"), "left")
    seat = lambda b, g: F.struct(b.cast("int").alias("bucket"), F.lit(g).alias("guest"))
    seats = F.when(F.col("before").isNull(), F.array(seat(F.col("bucket"), 0))).otherwise(F.array(seat(F.col("bucket"), 0), seat(F.col("before"), 1)))
    return joined.select(F.inline(seats), "at", "doc_id", "text").repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", "at", "text")


def fingerprinted(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = dict(docs.dtypes)
    kind = fields["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        current, closed = None, False
        type_ = pa.int64()
        for batch in batches:
            type_ = batch.schema.field(2).type
            for b, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if b != current:
                    current, closed, rows = b, False, []
                if closed:  # further guests share the doc_id of the first
                    continue
                rows.append((doc_id, text))
                closed = bool(guest)
                if len(rows) > CHUNK or closed and len(rows) > 1:
                    yield _compared(rows, type_)
                    rows = rows[-1:]

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return mapped(with_next(docs, parts, RANGES * parts).select("bucket", "guest", "doc_id", "text"), run, schema)
