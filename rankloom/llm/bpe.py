"""BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

Whether a token is final depends on a bounded number of symbols after its end. The bound
is computed from the merge list in one pass over the ranks. Let eaten[t] be the symbols
past the end of a token t that decide whether a merge so far takes t together with what
follows: a rule (t, v) needs v, and all that decides whether v is formed and still free
at that rank, which only earlier rules decide. Let formed[t] be the same for the right
edge of t while t is formed. With rule (a, b) at rank k::

    formed[ab] = max(eaten[b], formed[b])                 # as they stand before rank k
    eaten[a]   = max(eaten[a], len(b) + max(eaten[b], formed[b]))

Merges never cross a final boundary, so what follows one is encoded on its own. The
transducer keeps the symbols after the last emitted token; once they are more than the
longest token plus the lookahead, the tokens that end at least the lookahead before the
end of the buffer are emitted. The buffer never exceeds a constant, however long the
input is. Every pre-token goes through it; what it gave for short ones is kept in a
bounded memo. Texts are encoded stretch by stretch, cut at white space, so beside the text
and the normal form of a stretch memory is constant.

Decoding takes the ids in the order in which they come and feeds their bytes to one UTF-8
state machine per text, which gives out characters as soon as they are complete and U+FFFD
for what cannot be one. Whole characters within a feed are taken in one step.

Defined cases: a null or empty text has no tokens, the digest of the empty string and an
empty decoded text; repeated rows give repeated results; a null doc_id passes through; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.textops import mapped, per_batch, sole_memo
from rankloom.llm.wordbpe import Vocabulary, byte_symbols, each_pre_token, pre_tokens, stretches, vocabulary

#: Symbols that the buffer takes beyond its least size, to emit many tokens at once.
SLACK = 2048
#: Characters that are normalised and split at once.
STRETCH = 1 << 14
MEMO_WORDS = 150_000
MEMO_SYMBOLS = 48


def sufficient_lookahead(merges: Iterable[tuple[str, str]], suffix: str) -> int:
    """Symbols after a token's end that decide whether it is final; see the module's text."""
    width = lambda t: len(t) - len(suffix) * (bool(suffix) and t.endswith(suffix))
    eaten: dict[str, int] = {}
    formed: dict[str, int] = {}
    most = 0
    for a, b in merges:
        right = max(eaten.get(b, 0), formed.get(b, 0))
        formed[a + b] = max(formed.get(a + b, 0), right)
        eaten[a] = max(eaten.get(a, 0), width(b) + right)
        most = max(most, eaten[a], formed[a + b])
    return most


class MergeTable:
    """The merge list as pair -> rank -> merged id, with its lookahead."""

    def __init__(self, v: Vocabulary):
        self.ranks = {(v.ids[a], v.ids[b]): rank for rank, (a, b) in enumerate(v.merges)}
        self.into = [v.ids[a + b] for a, b in v.merges]
        self.none = len(self.into)
        self.lookahead = sufficient_lookahead(v.merges, v.suffix)
        self.width = {i: len(t) - len(v.suffix) * (bool(v.suffix) and t.endswith(v.suffix)) for t, i in v.ids.items()}
        self.longest = max(self.width.values())
        self.inner = [v.ids[c] for c in byte_symbols()]
        self.last = [v.ids[c + v.suffix] for c in byte_symbols()]

    def merged(self, symbols: list[int]) -> list[int]:
        """All merges of one sequence, lowest rank first and leftmost first within a rank."""
        return self._few(symbols) if len(symbols) <= 32 else self._many(symbols)

    def _few(self, symbols: list[int]) -> list[int]:
        """Keeps the rank of every neighbouring pair; a merge changes those beside it."""
        out, rank_of, none = list(symbols), self.ranks.get, self.none
        ranks = [rank_of(p, none) for p in zip(out, out[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            out[i : i + 2] = [self.into[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((out[i - 1], out[i]), none)
            if i < len(ranks):
                ranks[i] = rank_of((out[i], out[i + 1]), none)
        return out

    def _many(self, symbols: list[int]) -> list[int]:
        """The same with a heap of (rank, place) over a linked list."""
        n = len(symbols)
        token, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (rank := self.ranks.get((token[i], token[j]))) is not None:
                heapq.heappush(heap, (rank, i, token[i], token[j]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j < 0 or token[j] != b:
                continue
            token[i], token[j] = self.into[rank], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in token if t >= 0]


class Transducer:
    """Encodes one pre-token from pieces of bytes; memory is bounded by the merge list."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.least = table.longest + table.lookahead
        self.buffer: list[int] = []
        self.held: int | None = None

    def feed(self, piece: bytes) -> list[int]:
        """Tokens that have become final. The last byte is held back, as it may end the word."""
        out: list[int] = []
        for at in range(0, len(piece), SLACK):
            part = piece[at : at + SLACK]
            if self.held is not None:
                self.buffer.append(self.table.inner[self.held])
            self.buffer += [self.table.inner[b] for b in part[:-1]]
            self.held = part[-1]
            if len(self.buffer) > self.least + SLACK:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        limit, end, out = len(self.buffer) - self.table.lookahead, 0, []
        for t in self.table.merged(self.buffer):
            if end + self.table.width[t] > limit:
                break
            end += self.table.width[t]
            out.append(t)
        del self.buffer[:end]
        return out

    def finish(self) -> list[int]:
        if self.held is None:
            return []
        out = self.table.merged([*self.buffer, self.table.last[self.held]])
        self.buffer, self.held = [], None
        return out


def _open_tail(data: bytes) -> int:
    """How many bytes at the end may be the start of a character that goes on."""
    for back, b in enumerate(reversed(data[-3:]), 1):
        if b >= 0xC0:
            return back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
        if b < 0x80:
            return 0
    return 0


class ByteTextDecoder:
    """UTF-8 bytes to text, incrementally: the bytes still wanted, the code point so far and its least value."""

    def __init__(self):
        self.wanted, self.point, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        if not self.wanted:
            cut = len(data) - _open_tail(data)
            try:
                whole = data[:cut].decode()
            except UnicodeDecodeError:  # something that is no character: byte by byte
                pass
            else:
                if cut == len(data):
                    return whole
                out.append(whole)
                data = data[cut:]
        for b in data:
            if self.wanted:
                if self.low <= b <= self.high:
                    self.point = self.point << 6 | b & 0x3F
                    self.wanted -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.wanted:
                        out.append(chr(self.point))
                    continue
                out.append("�")
                self.wanted, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.wanted, self.point = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.wanted, self.point = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.wanted, self.point = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        left, self.wanted, self.low, self.high = self.wanted, 0, 0x80, 0xBF
        return "�" if left else ""


class Decoder:
    """Ids to text: the file's own form (token strings parted by a blank) or the plain text of the bytes."""

    def __init__(self, v: Vocabulary):
        self.shown = {i: t.encode() for i, t in v.tokens.items()}
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        special = set(v.special.values())
        self.plain = {}
        for i, t in v.tokens.items():
            ends = bool(v.suffix) and t.endswith(v.suffix) and i not in special
            body = t[: len(t) - len(v.suffix)] if ends else t
            self.plain[i] = t.encode() if i in special else bytes(byte_of[c] for c in body) + b" " * ends

    def strings(self, runs: Iterable[list[int]]) -> Iterator[str]:
        """The file's form of a sequence of ids that comes in runs."""
        machine, first = ByteTextDecoder(), True
        for ids in runs:
            if ids:
                yield machine.feed((b"" if first else b" ") + b" ".join(map(self.shown.__getitem__, ids)))
                first = False
        yield machine.finish()

    def text(self, runs: Iterable[list[int]]) -> Iterator[str]:
        machine = ByteTextDecoder()
        for ids in runs:
            yield machine.feed(b"".join(map(self.plain.__getitem__, ids)))
        yield machine.finish()


class _Ids(dict):
    """Pre-token -> its ids, as the transducer gave them.

    Two generations of at most MEMO_WORDS each: when the young one is full it becomes the
    old one, and what is asked for again is taken over from there.
    """

    def __init__(self, codec: Codec):
        self.codec, self.old = codec, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.get(word)
        if ids is None:
            ids = tuple(self.codec.encode_word(word))
            if len(word) > MEMO_SYMBOLS:
                return ids
        self[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def turn(self) -> None:
        """Called between texts."""
        sole_memo(self, self.forget)
        if len(self) >= MEMO_WORDS:
            self.old = dict(self)
            self.clear()


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.table = MergeTable(self.vocabulary)
        self.decoder = Decoder(self.vocabulary)
        self.transducer = Transducer(self.table)
        self.names = {i: str(i) for i in self.vocabulary.tokens}
        self.memo = _Ids(self)

    def encode_word(self, word: str) -> list[int]:
        return self.transducer.feed(word.encode("utf-8", "replace")) + self.transducer.finish()

    def _long(self, words: Iterable[str]) -> Iterator[list[int]]:
        """Ids of words of any length, the longest ones given out while they are read."""
        for word in words:
            if len(word) <= STRETCH:
                yield list(self.memo[word])
                continue
            for at in range(0, len(word), STRETCH):
                yield self.transducer.feed(word[at : at + STRETCH].encode("utf-8", "replace"))
            yield self.transducer.finish()

    def runs(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text in runs of bounded length."""
        self.memo.turn()
        for part, special in self.vocabulary.segments(text or ""):
            if special:
                yield [self.vocabulary.special[part]]
                continue
            for stretch in stretches(part, STRETCH):
                if len(stretch) <= STRETCH:
                    yield [*chain.from_iterable(map(self.memo.__getitem__, pre_tokens(stretch)))]
                else:  # no white space for long
                    yield from self._long(each_pre_token(stretch))

    def encode(self, text: str | None) -> np.ndarray:
        return np.fromiter(chain.from_iterable(self.runs(text)), dtype=np.int32)

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, digest of the ids in decimal parted by blanks, digest of the decoded text."""
        n, ids, shown = 0, sha256(), sha256()

        def counted() -> Iterator[list[int]]:
            nonlocal n
            for run in self.runs(text):
                if run:
                    ids.update(((" " if n else "") + " ".join(map(self.names.__getitem__, run))).encode())
                    n += len(run)
                yield run

        for piece in self.decoder.strings(counted()):
            shown.update(piece.encode())
        return n, ids.hexdigest(), shown.hexdigest()


@cache
def codec(path: str) -> Codec:
    """One for each Python worker and file."""
    return Codec(path)


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, from whole texts; no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        rows = [*map(c.digests, batch.column(1).to_pylist())]
        n, a, b = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return mapped(docs.select("doc_id", "text"), per_batch(run, 64), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` as doc_id, ids (array of int), decoded (plain text of the bytes)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        ids = [c.encode(t) for t in batch.column(1).to_pylist()]
        texts = ["".join(c.decoder.text([i.tolist()])) for i in ids]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    kind = dict(docs.dtypes)["doc_id"]
    return mapped(docs.select("doc_id", "text"), per_batch(run, 64), f"doc_id {kind}, ids array<int>, decoded string")
