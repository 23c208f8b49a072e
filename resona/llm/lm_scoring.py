"""Language-model scores: online logistic mixing of hashed-context bit predictors, beside a smoothed unigram base.

A text is its lower-cased words, each followed by a space, then one end of line; it is predicted bit by bit, so the
product of the bits' probabilities is that of the text. Two sets of contexts predict: those of a word's first two bytes
(HEAD) know the end of the word before, those of its other bytes (TAIL) the bytes before and the whole word so far. Each
context, with the bits of the byte so far, hashes to a slot of a table of bit counts. The logits of a bit's slots are
combined by weights that a gate chooses (place in the word, bit, number of contexts met before); gradient steps over
the training words, each judged without its own occurrence, move the weights, and a table of what really followed each
mixed probability (its sums grow along the same pass) refines the result. Before the word's own bits stands one more: whether
it is the word that the two words before it, hashed to a slot of FOLLOW, have mostly had after them. Slots vote: a word that
comes again gains, another one takes its votes and then its place; the bit's probability is what such votes were worth along the pass.

Counts are gathered from all training texts: texts become chunks of word numbers once, a chunk's distinct words meet in
one aggregation, and what depends on a word alone is computed once a word and joined to the chunks that hold it. Bit
tables have a fixed size (SLOTS), as have weights, whatever the input: they are all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from resona.llm import scratch

HEAD = 2
#: Binary logarithms of the tables' slots. Head: byte before, whole start; these with the last byte, and the last two, of the word before. Tail: one to four bytes before, whole start.
SLOTS = {"head": (13, 16, 18, 20), "tail": (16, 20, 20, 20, 20)}
FOLLOW, TRUST = 21, 16
PLACES, LEVELS, BLOCK = 8, 33, 1 << 15
SPACE, END = 32, 10
SLICE = 1 << 17
COLUMNS = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
U = np.uint64


# words of a chunk


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of each token's word, tokens of each text, and the distinct words; the last of these is the end."""
    from resona.llm.hashing import column_bytes, separators, word_spans

    data, offsets = column_bytes(column)
    starts, ends, bounds = word_spans(data, offsets)
    inside = _LOWER[data[~separators("space")[data]]]
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(inside)]).dictionary_encode()
    distinct = pa.concat_arrays([words.dictionary, pa.array([bytes([END])], pa.large_binary())])
    n = words.indices.to_numpy()
    often = np.argsort(-np.bincount(n, minlength=len(words.dictionary)), kind="stable")  # small numbers, which pack well, for common words
    place = np.empty(len(often), np.int32)
    place[often] = np.arange(len(often))
    distinct = distinct.take(pa.array(np.append(often, len(often))))
    return np.insert(place[n], bounds[1:], len(often)), np.diff(bounds) + 1, distinct


def squeeze(codes: np.ndarray) -> bytes:
    """Word numbers, one byte plane after the other, compressed."""
    return pa.compress(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unsqueeze(payload: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(payload, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<i4").ravel()


def word_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, a space after each but the end, and the offsets of the words in them."""
    from resona.llm.hashing import column_bytes

    data, offsets = column_bytes(words)
    n = np.diff(offsets)
    ends = (n == 1) & (data[np.minimum(offsets[:-1], max(len(data) - 1, 0))] == END) if len(data) else n < 0
    at = np.concatenate([[0], np.cumsum(n + ~ends)])
    out = np.full(at[-1], SPACE, np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] - offsets[:-1], n)] = data
    return out, at


def pairs(codes: np.ndarray, per_text: np.ndarray, words: pa.Array) -> np.ndarray:
    """For each token the last two bytes of the word before and its own first two, as one number."""
    data, at = word_bytes(words)
    n = np.diff(at)
    first = data[at[:-1]].astype(np.uint32) << 8
    first[n > 1] |= data[at[:-1][n > 1] + 1]
    last = np.full(len(n), END, np.uint32)
    more = n > 1
    last[more] = data[at[1:][more] - 2]
    two = n > 2
    last[two] |= data[at[1:][two] - 3].astype(np.uint32) << 8
    before = np.empty(len(codes), np.int32)
    before[1:] = codes[:-1]
    before[np.cumsum(per_text) - per_text] = len(words) - 1
    return (last[before] << 16) | first[codes]


# contexts


@dataclass
class Bytes:
    """Bytes to predict: value, place in the word, contexts (a row each) and how often each was met in training."""

    value: np.ndarray
    place: np.ndarray
    contexts: list[np.ndarray]
    n: np.ndarray
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def part(self, lo: int, hi: int) -> Bytes:
        return Bytes(self.value[lo:hi], self.place[lo:hi], [c[lo:hi] for c in self.contexts], self.n[lo:hi], self.owner[lo:hi])


def head_bytes(pair: np.ndarray, n: np.ndarray) -> Bytes:
    """The bytes of the starts of words; an end has one byte."""
    pair = pair.astype(np.int64)
    one, two = (pair >> 8) & 255, pair & 255
    both = np.flatnonzero(one != END)
    owner = np.concatenate([np.arange(len(pair)), both])
    value = np.concatenate([one, two[both]])
    place = np.repeat([0, 1], [len(pair), len(both)])
    start = np.where(place == 1, one[owner] + 1, 0).astype(U)
    last = (pair[owner] >> 16).astype(U)
    return Bytes(value.astype(np.uint8), place, [place.astype(U), start, start << U(16) | (last & U(255)), start << U(16) | last], n[owner], owner)


def tail_bytes(words: pa.Array, n: np.ndarray) -> Iterator[Bytes]:
    """The bytes of words after their starts, in slices of whole words."""
    from resona.llm.hashing import byte_values, powers, slices

    data, at = word_bytes(words)
    for lo, hi in slices(at, SLICE):
        b = data[at[lo] : at[hi]]
        starts = at[lo:hi] - at[lo]
        owner = np.repeat(np.arange(lo, hi), np.diff(at[lo : hi + 1]))
        place = np.arange(len(b)) - starts[owner - lo]
        up, down = powers(11, 1 << max(len(b), SLICE * 2).bit_length())
        sums = np.concatenate([np.zeros(1, U), np.cumsum(byte_values(11, False)[b] * up[: len(b)])])
        first = starts[owner - lo]
        whole = (sums[:-1] - sums[first]) * down[first]
        order, contexts = np.zeros(len(b), U), []
        for k in range(1, 5):
            before = np.zeros(len(b), U)
            before[k:] = b[:-k]
            order = order | np.where(place >= k, before, 0).astype(U) << U(8 * (k - 1))
            contexts.append(order)
        rest = np.flatnonzero(place >= HEAD)
        if len(rest):
            yield Bytes(b[rest], place[rest], [c[rest] for c in [*contexts, whole]], n[owner[rest]], owner[rest])


def slots(kind: str, part: Bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """For each context the slots of the eight bits of each byte, and the bits; half a byte's slots lie together."""
    from resona.llm.hashing import mix

    b = part.value.astype(np.int64)
    bit = (b[:, None] >> np.arange(7, -1, -1)) & 1
    node = np.concatenate([(1 << np.arange(4)) | (x[:, None] >> np.arange(4, 0, -1)) for x in (b >> 4, b & 15)], axis=1)
    out, base = [], 0
    for k, (context, size) in enumerate(zip(part.contexts, SLOTS[kind], strict=True)):
        high = mix(context * U(0x9E3779B97F4A7C15) + U(k + 1))
        low = mix(high + U(1) + (b >> 4).astype(U))
        group = np.stack([high, low], axis=1) >> U(68 - size)
        out.append((base + (np.repeat(group.astype(np.int64) << 4, 4, axis=1) | node)).astype(np.int32))
        base += 1 << size
    return out, bit


def size(kind: str) -> int:
    return sum(1 << s for s in SLOTS[kind])


class Squeezed:
    """Arrays by name that are compressed on their way to tasks."""

    def __init__(self, **arrays: np.ndarray) -> None:
        self.arrays = arrays

    def __getitem__(self, name: str) -> np.ndarray:
        return self.arrays[name]

    def __getstate__(self) -> dict:
        return {k: (str(x.dtype), x.shape, pa.compress(np.ascontiguousarray(x).data.cast("B"), "zstd", asbytes=True)) for k, x in self.arrays.items()}

    def __setstate__(self, state: dict) -> None:
        self.arrays = {k: np.frombuffer(pa.decompress(x, int(np.prod(shape)) * np.dtype(kind).itemsize, "zstd", asbytes=True), kind).reshape(shape) for k, (kind, shape, x) in state.items()}


# the mixer


@dataclass
class Mixer:
    """Gated weights of one set of contexts and a bias, and the table that refines mixed probabilities.

    rate: of the steps, each scaled by the root of the squared slopes so far. prior: occurrences that a refining entry starts with.
    """

    weights: np.ndarray
    followed: np.ndarray
    squares: np.ndarray
    met: np.ndarray
    rate: float = 0.1
    prior: float = 50.0

    @classmethod
    def fresh(cls, kind: str) -> Mixer:
        k = len(SLOTS[kind])
        weights = np.full((PLACES * 8 * (k + 1), k + 1), 1.2 / k, np.float64)
        weights[:, k] = 0
        return cls(weights, np.zeros((2, PLACES * 8 * LEVELS)), np.full_like(weights, 1e-6), np.zeros(len(weights)))

    def mixed(self, logits: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit, gate and refining entry of each bit."""
        k = len(logits)
        at = np.minimum(place, PLACES - 1)[:, None] * 8 + np.arange(8)
        gate = at * (k + 1) + sum((x != 0).astype(np.int64) for x in logits)
        x = self.weights[:, k][gate]
        for i, logit in enumerate(logits):
            x += self.weights[:, i][gate] * logit
        np.clip(x, -12, 12, out=x)
        level = np.rint((np.clip(x, -8, 8) + 8) * ((LEVELS - 1) / 16)).astype(np.int64)
        return x, gate, at * LEVELS + level

    def refined(self) -> np.ndarray:
        centre = 1 / (1 + np.exp(-np.tile(np.linspace(-8, 8, LEVELS), PLACES * 8)))
        return (self.followed[1] + self.prior * centre) / (self.followed.sum(0) + self.prior)

    def learn(self, logits: list[np.ndarray], place: np.ndarray, bit: np.ndarray, n: np.ndarray) -> None:
        """One step over some bytes, each of which counts n times."""
        x, gate, entry = self.mixed(logits, place)
        n = np.repeat(n.astype(np.float64)[:, None], 8, axis=1)
        error = (n * (bit - 1 / (1 + np.exp(-x)))).ravel()
        for b in (0, 1):
            self.followed[b] += np.bincount(entry.ravel(), (n * (bit == b)).ravel(), minlength=self.followed.shape[1])
        flat, rows = gate.ravel(), len(self.weights)
        slope = np.stack([np.bincount(flat, error * v, minlength=rows) for v in [*(x.ravel() for x in logits), 1.0]], axis=1)
        self.squares += slope**2
        self.weights += self.rate * slope / np.sqrt(self.squares)
        self.met += np.bincount(flat, n.ravel(), minlength=rows)

    def bits(self, logits: list[np.ndarray], place: np.ndarray, bit: np.ndarray, refined: np.ndarray) -> np.ndarray:
        """Bits that each byte takes: the mean of the mixed and the refined probability."""
        x, _, entry = self.mixed(logits, place)
        p = np.clip((1 / (1 + np.exp(-x)) + refined[entry]) / 2, 1e-6, 1 - 1e-6)
        return -np.log2(np.where(bit == 1, p, 1 - p)).sum(1)


def logit(zeros: np.ndarray, ones: np.ndarray, few: float = 0.4) -> np.ndarray:
    return np.log((ones + few) / (zeros + few))


@dataclass
class Model:
    """Tables of logits and mixers of both sets of contexts."""

    logits: Squeezed
    mixers: dict[str, Mixer]
    refined: dict[str, np.ndarray]
    followers: Squeezed
    right: np.ndarray

    def token_bits(self, slot: np.ndarray, word: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Bits of tokens whose own bytes take `own` bits: the leading word can be told by the first bit or by its bytes."""
        trust = Followers.trusted(self.followers["votes"][slot])
        p = np.clip(self.right[trust], 1e-6, 1 - 1e-6)
        came = self.followers["word"][slot] == word
        return np.where(trust == 0, own, np.where(came, -np.log2(p + (1 - p) * np.exp2(-np.minimum(own, 1000))), own - np.log2(1 - p)))

    def cost(self, kind: str, parts: Iterator[Bytes], n: int) -> np.ndarray:
        """Bits of each of n owners."""
        out = np.zeros(n)
        for part in parts:
            at, bit = slots(kind, part)
            bits = self.mixers[kind].bits([self.logits[kind][i] for i in at], part.place, bit, self.refined[kind])
            out += np.bincount(part.owner, bits, minlength=n)
        return out


def cut(whole: Bytes) -> Iterator[Bytes]:
    for lo in range(0, len(whole.value), SLICE):
        yield whole.part(lo, lo + SLICE)


def training(batch: pa.RecordBatch) -> Iterator[tuple[str, Bytes]]:
    """What a batch of (kind, name, n) rows has to learn from."""
    kinds, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
    words = batch.column(1).filter(pa.array((kinds == 0) & (n > 0)))
    for part in tail_bytes(words, n[(kinds == 0) & (n > 0)]):
        yield "tail", part
    here = (kinds == 1) & (n > 0)
    if here.any():
        names = b"".join(batch.column(1).filter(pa.array(here)).to_pylist())
        for part in cut(head_bytes(np.frombuffer(names, np.uint32), n[here])):
            yield "head", part


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bit counts of a task's words, as blocks of the tables: (kind, block, counts of zeros, then of ones)."""
    from resona.llm.packing import pack

    held = {k: np.zeros((2, size(k))) for k in SLOTS}
    touched = {k: False for k in SLOTS}
    for batch in batches:
        for kind, part in training(batch):
            touched[kind] = True
            at, bit = slots(kind, part)
            n = np.repeat(part.n[:, None], 8, axis=1)
            for b in (0, 1):
                here = bit == b
                weight = n[here]
                lo = 0
                for i, bits in zip(at, SLOTS[kind], strict=True):
                    held[kind][b, lo : lo + (1 << bits)] += np.bincount(i[here] - lo, weight, minlength=1 << bits)
                    lo += 1 << bits
    for number, kind in enumerate(SLOTS):
        for lo in range(0, size(kind) if touched[kind] else 0, BLOCK):
            block = held[kind][:, lo : lo + BLOCK]
            if block.any():
                payload = pack(pa.table({"zeros": block[0].astype(np.int64), "ones": block[1].astype(np.int64)}))
                yield pa.RecordBatch.from_pydict({"kind": pa.array([number], pa.int32()), "block": pa.array([lo // BLOCK], pa.int32()), "payload": [payload]})


def summed(table: pa.Table) -> pa.Table:
    """One block from those of all tasks, as 32-bit floats."""
    from resona.llm.packing import unpack

    both = np.zeros((2, BLOCK), np.int64)
    for payload in table.column("payload"):
        one = unpack(payload.as_py())
        for b, name in enumerate(("zeros", "ones")):
            x = one.column(name).to_numpy()
            both[b, : len(x)] += x
    return pa.table({"kind": table.column("kind").slice(0, 1), "block": table.column("block").slice(0, 1), "counts": [pa.compress(both.astype(np.float32).tobytes(), "zstd", asbytes=True)]})


# the word that follows two


class Followers:
    """For each slot of two words the word (32 bits of its hash) that leads after them, and its votes."""

    def __init__(self) -> None:
        self.word, self.votes = np.zeros(1 << FOLLOW, np.uint32), np.zeros(1 << FOLLOW, np.int64)

    def vote(self, slot: np.ndarray, word: np.ndarray, n: np.ndarray) -> None:
        """Slots are distinct: words that lead by n there."""
        word = word.astype(np.uint32)
        own = self.votes[slot]
        same = self.word[slot] == word
        ahead = ~same & (n > own)
        self.votes[slot] = np.where(same, own + n, np.abs(own - n))
        self.word[slot[ahead]] = word[ahead]

    def learn(self, slot: np.ndarray, word: np.ndarray) -> None:
        both, n = np.unique(slot.astype(U) << U(32) | word.astype(U), return_counts=True)
        slot = (both >> U(32)).astype(np.int64)
        order = np.lexsort((n, slot))
        last = np.flatnonzero(np.diff(slot[order], append=-1))
        top = order[last]
        total = np.bincount(np.cumsum(np.diff(slot, prepend=-1) != 0) - 1, n).astype(np.int64)
        lead = 2 * n[top] - total
        self.vote(slot[top[lead > 0]], both[top[lead > 0]] & U(0xFFFFFFFF), lead[lead > 0])

    @staticmethod
    def trusted(votes: np.ndarray) -> np.ndarray:
        """0: no word leads; else the votes' power of two."""
        return np.minimum(np.frexp(votes.astype(np.float64))[1], TRUST - 1)


def following(codes: np.ndarray, per_text: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each token the slot of the two words before it, and its own word's hash."""
    from resona.llm.hashing import column_bytes, mix, word_hashes

    data, at = column_bytes(words)
    names = word_hashes(data, at[:-1], at[1:], 13)
    own, end = names[codes], names[-1]
    first = np.cumsum(per_text) - per_text
    before = np.concatenate([[end], own[:-1]])
    before[first] = end
    again = np.concatenate([[end], before[:-1]])
    again[first] = end
    return (mix(before * U(3) + mix(again)) >> U(64 - FOLLOW)).astype(np.int64), (own >> U(32)).astype(np.uint32)


def followed(batches: Iterator[pa.RecordBatch], step: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """A task's votes by block, and (block -1) how often the leading word came, by its trust, before each step's votes were cast."""
    from resona.llm.packing import pack

    own, came = Followers(), np.zeros((2, TRUST), np.int64)
    for _, keys, per_text, codes, words in _opened(batches):
        slot, word = (x[~np.repeat(keys.column("held").to_numpy(zero_copy_only=False), per_text)] for x in following(codes, per_text, words))
        for lo in range(0, len(slot), step):
            s, w = slot[lo : lo + step], word[lo : lo + step]
            came += np.bincount(Followers.trusted(own.votes[s]) * 2 + (own.word[s] == w), minlength=2 * TRUST).reshape(TRUST, 2).T
            own.learn(s, w)
    task = TaskContext.get().partitionId()
    for lo in range(0, 1 << FOLLOW, BLOCK):
        here = np.flatnonzero(own.votes[lo : lo + BLOCK])
        if len(here):
            payload = pack(pa.table({"slot": here + lo, "word": own.word[lo + here], "n": own.votes[lo + here]}))
            yield pa.RecordBatch.from_pydict({"block": pa.array([lo // BLOCK], pa.int32()), "task": pa.array([task], pa.int32()), "payload": [payload]})
    yield pa.RecordBatch.from_pydict({"block": pa.array([-1], pa.int32()), "task": pa.array([task], pa.int32()), "payload": [came.tobytes()]})


def elected(table: pa.Table) -> pa.Table:
    """One block of votes from those of all tasks, in their order."""
    from resona.llm.packing import pack, unpack

    block = table.column("block")[0].as_py()
    payloads = table.sort_by("task").column("payload")
    if block < 0:
        out = sum(np.frombuffer(x.as_py(), np.int64) for x in payloads).tobytes()
    else:
        all_ = Followers()
        for x in payloads:
            one = unpack(x.as_py())
            all_.vote(*(one.column(c).to_numpy() for c in ("slot", "word", "n")))
        here = np.flatnonzero(all_.votes)
        out = pack(pa.table({"slot": here, "word": all_.word[here], "n": all_.votes[here]}))
    return pa.table({"block": pa.array([block], pa.int32()), "payload": [out]})


def followers(chunks: DataFrame) -> tuple[Followers, np.ndarray]:
    """All votes, and the probability of the leading word by its trust; FOLLOW and TRUST bound both."""
    from resona.llm.packing import unpack

    out, came = Followers(), np.zeros((2, TRUST), np.int64)
    for r in chunks.mapInArrow(followed, "block int, task int, payload binary").groupBy("block").applyInArrow(elected, "block int, payload binary").toLocalIterator(prefetchPartitions=True):
        if r.block < 0:
            came = np.frombuffer(r.payload, np.int64).reshape(2, TRUST)
        else:
            one = unpack(r.payload)
            out.vote(*(one.column(c).to_numpy() for c in ("slot", "word", "n")))
    return out, (came[1] + 0.4) / (came.sum(0) + 0.8)


# Spark


def encoded(docs: DataFrame, held_out: Column, key: str, chunk: int) -> DataFrame:
    """Texts as chunks of word numbers: chunk, keys (Arrow: key, held), tokens of each text, word numbers, distinct words."""
    from resona.llm.hashing import column_bytes, slices
    from resona.llm.packing import pack

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        weight = 0

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            codes, per_text, words = tokens(table.column("text"))
            cells = {"chunk": base + number, "keys": pack(table.drop_columns(["text"])), "per_text": per_text.astype(np.int32).tobytes(), "codes": squeeze(codes), "words": pack(pa.table({"word": words}))}
            return pa.RecordBatch.from_pydict({k: [v] for k, v in cells.items()})

        for batch in batches:
            _, offsets = column_bytes(batch.column(1))
            for lo, hi in slices(offsets, chunk):
                held.append(batch.slice(lo, hi - lo))
                weight += int(offsets[hi] - offsets[lo])
                if weight >= chunk or sum(map(len, held)) >= 1 << 17:
                    yield row()
                    held, weight, number = [], 0, number + 1
        if held:
            yield row()

    named = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    return scratch.keep(named.mapInArrow(rows, "chunk long, keys binary, per_text binary, codes binary, words binary"), "lm-chunks")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    from resona.llm.packing import unpack

    for batch in batches:
        for r in batch.to_pylist():
            per_text = np.frombuffer(r["per_text"], np.int32)
            yield r["chunk"], unpack(r["keys"]), per_text, unsqueeze(r["codes"], int(per_text.sum())), unpack(r["words"]).column("word").combine_chunks()


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words (kind 0, those of held-out texts too) and pairs (kind 1) of each chunk with their training counts."""
    for _, keys, per_text, codes, words in _opened(batches):
        learnt = ~np.repeat(keys.column("held").to_numpy(zero_copy_only=False), per_text)
        n = np.bincount(codes[learnt], minlength=len(words))
        pair, m = np.unique(pairs(codes, per_text, words)[learnt], return_counts=True)
        names = pa.concat_arrays([words.cast(pa.binary()), pa.Array.from_buffers(pa.binary(4), len(pair), [None, pa.py_buffer(pair)]).cast(pa.binary())])
        whole = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([0, 1], np.int32), [len(words), len(pair)])), names, pa.array(np.concatenate([n, m]).astype(np.int64))], ["kind", "name", "n"])
        for lo in range(0, len(whole), 1 << 15):
            yield whole.slice(lo, 1 << 15)


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk, _, _, _, words in _opened(batches):
        for lo in range(0, len(words), 1 << 15):
            part = words.slice(lo, 1 << 15).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(np.arange(lo, lo + len(part), dtype=np.int32)), part], ["chunk", "number", "name"])


def tables(names: DataFrame) -> dict[str, np.ndarray]:
    """Bit counts of both sets of contexts: zeros, then ones; their size is that of SLOTS, whatever the input."""
    blocks = names.mapInArrow(counted, "kind int, block int, payload binary").groupBy("kind", "block").applyInArrow(summed, "kind int, block int, counts binary")
    out = {k: np.zeros((2, size(k)), np.float32) for k in SLOTS}
    for r in blocks.toLocalIterator(prefetchPartitions=True):
        kind = [*SLOTS][r.kind]
        lo = r.block * BLOCK
        out[kind][:, lo : lo + BLOCK] = np.frombuffer(pa.decompress(r.counts, 8 * BLOCK, "zstd", asbytes=True), np.float32).reshape(2, BLOCK)[:, : size(kind) - lo]
    return out


def mixers(names: DataFrame, shared, step: int = 2048) -> dict[str, Mixer]:
    """Each task takes its steps over its words, `step` bytes at a time; weights are averaged by what their gates met.

    shared: broadcast tables of bit counts. A word is judged by the counts without its own occurrence.
    """

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: Mixer.fresh(k) for k in SLOTS}
        for batch in batches:
            for kind, whole in training(batch):
                counts = shared.value[kind]
                for lo in range(0, len(whole.value), step):
                    part = whole.part(lo, lo + step)
                    at, bit = slots(kind, part)
                    logits = [logit(np.maximum(counts[0][i] - (1 - bit), 0), np.maximum(counts[1][i] - bit, 0)) for i in at]
                    own[kind].learn(logits, part.place, bit, part.n)
        for number, mixer in enumerate(own.values()):
            total = np.concatenate([(mixer.weights * mixer.met[:, None]).ravel(), mixer.met, mixer.followed.ravel()])
            here = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"kind": np.full(len(here), number, np.int32), "place": here.astype(np.int32), "total": total[here]})

    out = {k: Mixer.fresh(k) for k in SLOTS}
    flat = {k: np.zeros(m.weights.size + len(m.met) + m.followed.size) for k, m in out.items()}
    for r in names.mapInArrow(learnt, "kind int, place int, total double").groupBy("kind", "place").agg(F.sum("total").alias("total")).collect():  # at most the mixers' own size
        flat[[*SLOTS][r.kind]][r.place] = r.total
    for k, m in out.items():
        total, met, followed = np.split(flat[k], [m.weights.size, m.weights.size + len(m.met)])
        seen = met > 0
        m.weights[seen] = total.reshape(m.weights.shape)[seen] / met[seen, None]
        m.met, m.followed = met, followed.reshape(m.followed.shape)
    return out


def lm_scores(docs: DataFrame, held_out: Column, key: str = "doc_id", chunk: int = 8 << 20) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte: a row for each text.

    Learns from the texts where held_out (a condition on columns of docs; null: false) isn't true. Tokens are the words
    (runs of other bytes than ASCII white space, A-Z in lower case) and an end for each text. base_score: sum of log10((c + 1) / (N
    + V + 1)) over the tokens, c being a token's count in training, N that of all (train_tokens), V that of distinct ones. score:
    log10 of the model's probability of the text; bits_per_byte: the same as bits for each of n_bytes, the bytes predicted (a space
    for each gap). Null text is empty: one token. Texts are read whole however long, rows judged one by one, so repeated rows and
    keys, null keys too, score alike and all stay. No rows give no rows; no training rows give the bare start of the model. Other
    columns aren't read and not returned. Weights depend, slightly, on how rows are dealt out to tasks.
    """
    spark = docs.sparkSession
    chunks = encoded(docs, held_out, key, chunk)
    names = scratch.keep(chunks.mapInArrow(_names, "kind int, name binary, n long").groupBy("kind", "name").agg(F.sum("n").alias("n")), "lm-names")
    total, distinct = names.where("kind = 0 AND n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    counts = tables(names)
    shared = spark.sparkContext.broadcast(Squeezed(**counts))  # the bytes of SLOTS: 8 for each slot at most
    learnt = mixers(names, shared)
    shared.unpersist()
    votes, right = followers(chunks)
    logits = Squeezed(**{k: logit(c[0], c[1]).astype(np.float32) for k, c in counts.items()})
    model = spark.sparkContext.broadcast(Model(logits, learnt, {k: m.refined() for k, m in learnt.items()}, Squeezed(word=votes.word, votes=votes.votes), right))

    def words_cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.value.cost("tail", tail_bytes(batch.column(0), n), len(n)))], ["name", "n", "bits"])

    def texts(key_, left: pa.Table, right: pa.Table) -> pa.Table:
        ((_, keys, per_text, codes, words),) = _opened(left.to_batches())
        place = right.column("number").to_numpy()
        n, bits = np.zeros(len(words), np.int64), np.zeros(len(words))
        n[place], bits[place] = right.column("n").to_numpy(), right.column("bits").to_numpy()
        pair, own = np.unique(pairs(codes, per_text, words), return_inverse=True)
        head = model.value.cost("head", cut(head_bytes(pair, np.zeros(len(pair)))), len(pair))
        size_ = np.diff(word_bytes(words)[1])
        at = np.cumsum(per_text) - per_text
        known, base, bits_, n_bytes = (np.add.reduceat(x, at) for x in ((n > 0).astype(np.int64)[codes], np.log10(n + 1.0)[codes] - np.log10(total + distinct + 1.0), model.value.token_bits(*following(codes, per_text, words), bits[codes] + head[own]), size_[codes]))
        cells = [keys.column("key"), keys.column("held"), per_text.astype(np.int64), known, np.full(len(at), total), base, -bits_ * np.log10(2), n_bytes.astype(np.int64), bits_ / n_bytes]
        return pa.table(cells, names=[key, *COLUMNS])

    schema = StructType([StructField(key, docs.schema[key].dataType), *(StructField(c, BooleanType() if c == "held_out" else LongType() if c[0] in "nt" else DoubleType()) for c in COLUMNS)])
    costs = names.where("kind = 0").select("name", "n").mapInArrow(words_cost, "name binary, n long, bits double")
    answers = chunks.select("chunk", "keys", "per_text", "codes", "words").mapInArrow(_requests, "chunk long, number int, name binary").join(costs, "name").select("chunk", "number", "n", "bits")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(texts, schema)
