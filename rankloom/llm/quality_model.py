"""Quality classifier: supervised subword embeddings.

Every word is the mean of learned vectors for its own hash and the hashes of its character
n-grams, and every pair of neighbouring words has a learned vector for the hash of both; a
document is the mean of its words and pairs. A softmax layer gives the class. All is
trained by stochastic gradient descent in numpy on a bounded sample of labelled documents:
at most ``per_class`` documents for each label, in the order of a seeded hash, whole
texts. Training rows are those whose crc32(doc_id as text) mod 4 is not 2; the rest is
held out. One task on an executor trains; the driver gets the weights and no texts.

After training the two layers fold into one number per feature, so scoring is a table
look-up per distinct word and per pair, and a mean per document: no shuffle, and beside
the text and its words memory is constant.

Defined cases: a null or empty text is scored by the bias alone; a document without a
label is scored like any other; of several labels of one doc_id the smallest counts and
null labels are ignored; null doc_ids are not held out and never trained on; with no
labels at all every score is 0.5; repeated rows are scored alike (of several texts of one
doc_id the least is trained on); texts of any length are scored whole; empty tables give no
rows; other columns are ignored (``keep_good`` returns them as they are).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rankloom.llm.textops import mapped, per_batch, sole_memo, words

BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4)
#: Pairs of words have 2 to this power vectors.
PAIR_BITS = 17
PER_CLASS = 1500
EPOCHS = 10
RATE = 0.5
SEED = 7
THRESHOLD = 0.7
MEMO_WORDS = 120_000


def features(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of several words and the word each belongs to: the word itself, then its n-grams with marked ends."""
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in new]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), sizes)
    ids = [np.fromiter((xxhash.xxh3_64_intdigest(w) % BUCKETS for w in new), dtype=np.int64, count=len(new))]
    owners = [np.arange(len(new))]
    for n in GRAMS:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ codes[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[:count] == owner[n - 1 :]
        ids.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[:count][inside])
    return np.concatenate(ids), np.concatenate(owners)


def pair_ids(hashes: np.ndarray) -> np.ndarray:
    """Feature ids of the pairs of neighbouring words, from the words' hashes. Pairs have a table of their own behind that of words."""
    if len(hashes) < 2:
        return np.empty(0, dtype=np.int64)
    h = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:]) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - PAIR_BITS)).astype(np.int64) + BUCKETS


class Model:
    """Feature weights (both layers folded): words and n-grams, then pairs; and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.word_weight, self.word_hash = np.empty(0), np.empty(0, dtype=np.uint64)

    def _learn(self, tokens: set[bytes]) -> None:
        """Weight and hash of every new word; the memo starts anew when it is full, so memory stays bounded."""
        if len(self.place) > MEMO_WORDS:
            self.forget()
        new = [t for t in tokens if t not in self.place]
        if new:
            ids, owner = features(new)
            sums = np.bincount(owner, weights=self.weights[ids], minlength=len(new))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.word_weight = np.concatenate([self.word_weight, sums / np.bincount(owner, minlength=len(new))])
            self.word_hash = np.concatenate([self.word_hash, np.fromiter(map(xxhash.xxh3_64_intdigest, new), dtype=np.uint64, count=len(new))])

    def scores(self, texts: list[str | None]) -> list[float]:
        sole_memo(self, self.forget)
        split = [words(t) if t else [] for t in texts]
        self._learn(set(chain.from_iterable(split)))
        out = []
        for tokens in split:
            z = self.bias
            if tokens:
                at = np.fromiter(map(self.place.__getitem__, tokens), dtype=np.int64, count=len(tokens))
                pairs = pair_ids(self.word_hash[at])
                # sums of a text's own numbers in its own order, whatever else is in the batch
                z += (float(self.word_weight[at].sum()) + float(self.weights[pairs].astype(np.float64).sum())) / (len(tokens) + len(pairs))
            out.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
        return out

    def packed(self) -> tuple[bytes, float]:
        return self.weights.tobytes(), self.bias


@lru_cache(maxsize=1)
def _loaded(weights: bytes, bias: float) -> Model:
    return Model(np.frombuffer(weights, np.float32), bias)


class _Bags:
    """Feature ids of all words of a sample in one flat array, and documents as bags of features."""

    def __init__(self, texts: list[str | None]):
        every = sorted(set(chain.from_iterable(words(t) for t in texts if t)))
        self.number = dict(zip(every, range(len(every))))
        flat, sizes = [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=np.int64)]
        for at in range(0, len(every), 16_384):
            part = every[at : at + 16_384]
            ids, owner = features(part)
            flat.append(ids[np.argsort(owner, kind="stable")].astype(np.int32))
            sizes.append(np.bincount(owner, minlength=len(part)))
        self.flat = np.concatenate(flat)
        self.ends = np.cumsum(np.concatenate(sizes))
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, every), dtype=np.uint64, count=len(every))

    def bag(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The feature ids of a document and their shares in its average."""
        tokens = words(text) if text else []
        order = np.fromiter(map(self.number.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        pairs = pair_ids(self.hashes[order])
        size = max(1, len(tokens) + len(pairs))
        at, n = np.unique(order, return_counts=True)
        starts = np.where(at > 0, self.ends[at - 1], 0) if len(at) else at
        lengths = self.ends[at] - starts
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        shares = np.concatenate([np.repeat(n / size / lengths, lengths), np.full(len(pairs), 1 / size)])
        ids, back = np.unique(np.concatenate([ids, pairs]), return_inverse=True)
        return ids.astype(np.int32), np.bincount(back, weights=shares).astype(np.float32)


def fit(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Trains on whole texts; one step of gradient descent per document, the rate falling to 0.

    A document's features have small shares, so their vectors move by the step over the
    sum of squared shares, which makes the step independent of the document's length.
    """
    rng = np.random.default_rng(seed)
    vectors = np.concatenate([rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((1 << PAIR_BITS, DIM))]).astype(np.float32)
    out, bias = rng.uniform(-1 / DIM, 1 / DIM, (2, DIM)), np.zeros(2)
    sample = _Bags(texts)
    bags = [sample.bag(t) for t in texts]
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            sgd_step(vectors, out, bias, *bags[i], labels[i], rate * (1 - done / steps))
            done += 1
    return Model(vectors @ (out[1] - out[0]), bias[1] - bias[0])


def forward(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray, ids: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document's vector and its class probabilities."""
    hidden = shares @ vectors[ids]
    z = out @ hidden + bias
    p = np.exp(z - z.max())
    return hidden, p / p.sum()


def sgd_step(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray, ids: np.ndarray, shares: np.ndarray, label: int, step: float) -> None:
    """One step against the gradient of the log loss, in place; vectors move by step / sum of squared shares."""
    hidden, p = forward(vectors, out, bias, ids, shares)
    p[label] -= 1
    vectors[ids] -= step / max(float(shares @ shares), 1e-3) * np.outer(shares, out.T @ p)
    out -= step * np.outer(p, hidden)
    bias -= step * p


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, **options) -> Model:
    """Fits on at most ``per_class`` training documents of each label."""
    clean = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    clean = clean.where(~held_out()).withColumn("h", F.md5(F.concat_ws(":", F.lit(str(SEED)), F.col("doc_id").cast("string"))))
    chosen = [clean.where((F.col("quality") > 0) == good).orderBy("h", "doc_id").limit(per_class) for good in (False, True)]
    # at most 2 * per_class narrow rows are broadcast, and as many documents are gathered in one task
    picked = F.broadcast(chosen[0].union(chosen[1]).select("doc_id", "quality", "h"))
    # one text of each doc_id, chosen before anything is gathered
    one = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("h").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            rows = pa.Table.from_batches(parts).sort_by([("h", "ascending"), ("doc_id", "ascending")])
            weights, bias = fit(rows["text"].to_pylist(), [int(q > 0) for q in rows["quality"].to_pylist()], **options).packed()
            yield pa.RecordBatch.from_arrays([pa.array([weights], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])

    made = mapped(one.coalesce(1), run, "weights binary, bias double").collect()
    if not made:
        return Model(np.zeros(BUCKETS + (1 << PAIR_BITS)), 0.0)
    return Model(np.frombuffer(made[0]["weights"], np.float32), made[0]["bias"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a last column __score; texts are read once and not shuffled."""
    packed = model.packed()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        scores = _loaded(*packed).scores(batch.column(at).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "__score"])

    schema = StructType([*docs.schema.fields, StructField("__score", DoubleType())])
    return mapped(docs, per_batch(run, 128), schema)


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    narrow = docs.select("doc_id", "text")
    out = scored(narrow, train(docs, labels, **options))
    return out.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    return scored(docs, train(docs, labels, **options)).where(F.col("__score") >= threshold).drop("__score")
