"""Language-model scoring: hashed-context bit predictors, mixed by logistic weights that adapt within each text."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table, written
from .vectors import LOWER, Chunk, _tables, chunks, give_back, mix, word_hashes, words

_U, _W = np.uint64, np.uint32
#: log2 of the entries of each predictor: by 3 bytes before, by 5 bytes, by the word's letters so far, and by these and the word before.
TABLE_BITS = (20, 20, 20, 21)
PART_BITS = 16
INPUTS = len(TABLE_BITS)
#: A stretch is kept in an octet as so many steps of one.
STEPS = 16
#: The weight of each predictor from which the fit sets out. Code, counts and fitted weights are those of all training texts.
START = 0.35
BLOCK_BYTES = 8 << 20
#: Bytes of text after which a text's own weights are refined first; later stretches double up to the last.
FIRST_STEP, LAST_STEP = 256, 8192
RATE = 0.04
#: Bytes scored together, and bytes counted or fitted on: few enough for a processor's cache.
SCORE_BYTES, LEARN_BYTES = 1 << 18, 1 << 16
#: The end of a text is one token of its own.
END_HASH = int(mix(np.array([0x656E64], dtype=np.uint64))[0])


class Stream(NamedTuple):
    """Texts as tokens: each word's bytes and a space, then a zero byte; five spaces stand before each text."""

    data: np.ndarray
    #: Of each predicted byte: where it stands, and of each token, where its bytes begin among the predicted ones.
    at: np.ndarray
    token_first: np.ndarray
    hashes: np.ndarray
    #: Of each text, where its tokens begin, and where its predicted bytes begin; and the ends of the last.
    text_tokens: np.ndarray
    text_bytes: np.ndarray
    word_start: np.ndarray


def stream(chunk: Chunk) -> Stream:
    data = LOWER[chunk.data]
    own = Chunk(0, chunk.offsets, data)
    w = words(own)
    texts, count = len(chunk.offsets) - 1, np.diff(w.first)
    length = (w.ends - w.starts).astype(np.int64)
    text_of_word = np.repeat(np.arange(texts), count)
    # tokens: the words of each text, then its end
    token_at = np.arange(len(length)) + text_of_word
    end_at = w.first[1:] + np.arange(texts)
    sizes = np.empty(len(length) + texts, dtype=np.int64)
    sizes[token_at], sizes[end_at] = length + 1, 1
    hashes = np.empty(len(sizes), dtype=np.uint64)
    hashes[token_at], hashes[end_at] = word_hashes(data, w), _U(END_HASH)
    token_first = np.cumsum(sizes) - sizes
    text_tokens = np.concatenate(([0], end_at + 1))
    text_of_token = np.repeat(np.arange(texts), np.diff(text_tokens))
    dest = token_first + 5 * (text_of_token + 1)
    out = np.full(int(sizes.sum()) + 5 * texts, 32, dtype=np.uint8)
    inside = np.repeat(dest[token_at] - w.starts, length) + (within := np.repeat(w.starts - (np.cumsum(length) - length), length) + np.arange(int(length.sum())))
    out[inside] = data[within]
    out[dest[end_at]] = 0
    total = int(sizes.sum())
    text_bytes = np.concatenate((token_first[text_tokens[:-1]], [total]))
    at = np.arange(total) + np.repeat(5 * (np.arange(texts) + 1), np.diff(text_bytes))
    return Stream(out, at, token_first, hashes, text_tokens, text_bytes, np.repeat(dest, sizes))


def contexts(s: Stream) -> list[np.ndarray]:
    """A mixed 32-bit context of each predicted byte for each predictor."""
    d = s.data.astype(_W)
    # of each byte from the sixth on, those before it; five spaces stand before each text
    before = [d[5 - i : len(d) - i] for i in (1, 2, 3, 4, 5)]
    c3 = before[0] | (before[1] << _W(8)) | (before[2] << _W(16))
    c5 = c3 | (before[3] << _W(24))
    c5 ^= before[4] * _W(0x01000193) << _W(3)
    at = s.at - 5
    c3, c5 = c3.take(at), c5.take(at)
    up, down = _tables(len(d) + 1)
    sums = np.zeros(len(d) + 1, dtype=np.uint64)
    np.cumsum((s.data.astype(np.uint64) + _U(1)) * up[: len(d)], out=sums[1:])
    size, start = np.diff(np.append(s.token_first, len(s.at))), s.word_start.take(s.token_first)
    letters = sums.take(s.at)
    letters -= np.repeat(sums.take(start), size)
    letters *= np.repeat(down.take(start) * _U(0xBF58476D1CE4E5B9), size)
    letters >>= _U(32)
    letters = letters.astype(_W)
    # the word before each token; a text's first has none
    prior = np.zeros(len(s.hashes), dtype=np.uint64)
    prior[1:] = s.hashes[:-1]
    prior[s.text_tokens[:-1]] = 0
    prior = ((prior * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(_W) * _W(0x85EBCA77)
    prior = np.repeat(prior, size)
    mixed = []
    for c, salt in ((c3, 0x27D4EB2F), (c5, 0x3C6EF372), (letters, 0x2545F491), (letters ^ prior, 0x165667B1)):
        c = (c ^ _W(salt)) * _W(0x9E3779B1)
        c ^= c >> _W(15)
        c *= _W(0x85EBCA6B)
        c ^= c >> _W(13)
        mixed.append(c)
    return mixed


class Code(NamedTuple):
    """Bits of each byte value along a Huffman tree, so that frequent bytes take few: their number, and where they begin."""

    length: np.ndarray
    first: np.ndarray
    #: Of each bit of each value, in turn: the hash of the inner node that decides it, and the bit.
    node: np.ndarray
    bit: np.ndarray

    def bits(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of bits of each symbol; of every bit the place of its symbol, and its index among the code's)."""
        size = self.length.take(symbols)
        owner = np.repeat(np.arange(len(symbols)), size)
        which = np.repeat(self.first.take(symbols) - (np.cumsum(size) - size), size)
        which += np.arange(len(owner))
        return size, owner, which


def code_of(texts: list[str]) -> Code:
    """A code for all byte values from the bytes of texts."""
    counts = np.bincount(np.frombuffer("".join(texts).lower().encode(), dtype=np.uint8), minlength=256)
    counts[0] += len(texts)
    return code_from(counts)


def code_from(counts: np.ndarray) -> Code:
    """A code for all byte values from how often each occurs; any code gives every byte a probability."""
    counts = counts + 1
    counts[32] += 1
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    for node in range(256, 511):
        (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
        parent[left], parent[right] = (node, 0), (node, 1)
        heapq.heappush(heap, (a + b, node))
    paths = []
    for symbol in range(256):
        path, at = [], symbol
        while at in parent:
            at, bit = parent[at]
            path.append((at - 255, bit))
        paths.append(path[::-1])
    length = np.array([len(p) for p in paths], dtype=np.int64)
    flat = [x for p in paths for x in p]
    node, bit = (np.array(x) for x in zip(*flat, strict=True))
    return Code(length, np.cumsum(length) - length, (mix(node.astype(np.uint64)) >> _U(32)).astype(_W), bit.astype(np.int64))


def _slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Entry of a context at a node of the code's tree."""
    return ((context ^ node) >> _W(32 - bits)).astype(np.int64)


class Counter:
    """How often each bit followed each context; bits are counted from the distinct pairs of a context and a byte of some stretch."""

    def __init__(self, code: Code) -> None:
        self.code = code
        self.totals = [np.zeros(2 << bits, dtype=np.uint32) for bits in TABLE_BITS]
        self.fresh: list[list[np.ndarray]] = [[] for _ in TABLE_BITS]
        self.held = self.seen = 0

    def add(self, s: Stream) -> None:
        symbols = s.data[s.at].astype(np.uint64)
        for into, c in zip(self.fresh, contexts(s), strict=True):
            into.append((c.astype(np.uint64) << _U(8)) | symbols)
        self.held += len(symbols)
        self.seen += len(symbols)
        if self.held > 1 << 21:
            self._fold()

    def _fold(self) -> None:
        code = self.code
        for fresh, total, bits in zip(self.fresh, self.totals, TABLE_BITS, strict=True):
            if not fresh:
                continue
            keys = np.concatenate(fresh)
            fresh.clear()
            keys.sort()
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            times = np.diff(np.append(first, len(keys))).astype(np.uint32)
            keys = keys[first]
            for a in range(0, len(keys), 1 << 17):
                part = keys[a : a + (1 << 17)]
                _, owner, which = code.bits((part & _U(255)).astype(np.int64))
                slot = _slot((part >> _U(8)).astype(_W).take(owner), code.node.take(which), bits)
                np.add.at(total, slot * 2 + code.bit.take(which), times[a : a + (1 << 17)].take(owner))
        self.held = 0

    def tables(self) -> list[np.ndarray]:
        """Counts (entry, bit) of each predictor."""
        self._fold()
        return self.totals


def stretched(counts: np.ndarray) -> np.ndarray:
    """Octets of ln(odds) of a set bit, 0 where nothing was counted."""
    n = counts.reshape(-1, 2).astype(np.float64)
    odds = np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4))
    return np.clip(np.rint(odds * STEPS), -127, 127).astype(np.int8)


class Model(NamedTuple):
    """The code, predictors' tables, and the weights with which every text begins."""

    code: Code
    tables: list[np.ndarray]
    weights: np.ndarray


def _bit_inputs(ctx: list[np.ndarray], owner: np.ndarray, which: np.ndarray, code: Code, tables: list[np.ndarray]) -> list[np.ndarray]:
    """For every bit each predictor's stretch, in steps."""
    node = code.node.take(which)
    return [t.take(_slot(c.take(owner), node, bits)) for c, bits, t in zip(ctx, TABLE_BITS, tables, strict=True)]


def slopes(s: Stream, code: Code, tables: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slope, curvature) in the weights of the log probability that one logistic regression on the predictors' stretches gives all bits."""
    _, owner, which = code.bits(s.data.take(s.at))
    inputs = np.empty((INPUTS, len(which)), dtype=np.float32)
    for into, x in zip(inputs, _bit_inputs(contexts(s), owner, which, code, tables), strict=True):
        into[:] = x
    z = (weights / STEPS).astype(np.float32) @ inputs
    np.clip(z, -14, 14, out=z)
    p = 1 / (1 + np.exp(-z))
    slope = inputs @ (code.bit.astype(np.float32).take(which) - p)
    p *= 1 - p
    return slope.astype(np.float64) / STEPS, (inputs * p) @ inputs.T.astype(np.float32) / np.float64(STEPS * STEPS)


def newton(weights: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return np.clip(weights + np.linalg.solve(curve + 10 * np.eye(INPUTS), slope), -2, 3)


def fit_weights(texts: list[str], code: Code, tables: list[np.ndarray], rounds: int = 5) -> np.ndarray:
    """Weights for score() from texts that the tables don't count: by Newton's method from equal weights."""
    w = np.full(INPUTS, START)
    for _ in range(rounds):
        found = [slopes(stream(chunk), code, tables, w) for chunk in chunks(pa.array(texts, type=pa.large_string()), LEARN_BYTES)]
        w = newton(w, sum(x for x, _ in found) - 0.1 * w, sum(x for _, x in found))
    return w.astype(np.float32)


def byte_scores(s: Stream, model: Model) -> np.ndarray:
    """ln probability of each predicted byte. Every text starts with the model's weights and refines an offset to them as it goes."""
    ctx, symbols, code = contexts(s), s.data[s.at], model.code
    out = np.zeros(len(symbols), dtype=np.float64)
    lengths = np.diff(s.text_bytes)
    sign = (1 - 2 * code.bit).astype(np.float32)
    offset = np.zeros((len(lengths), INPUTS), dtype=np.float32)
    done, step = 0, FIRST_STEP
    while True:
        active = np.flatnonzero(lengths > done)
        if not len(active):
            break
        stretch = np.minimum(lengths[active] - done, step)
        first = np.cumsum(stretch) - stretch
        own = np.repeat(s.text_bytes[active] + done - first, stretch) + np.arange(int(stretch.sum()))
        size, owner, which = code.bits(symbols[own])
        inputs = _bit_inputs([c[own] for c in ctx], owner, which, code, model.tables)
        bit_first = np.cumsum(size) - size
        text_first = bit_first[first]
        text_size = np.diff(np.append(text_first, len(which)))
        z = np.zeros(len(which), dtype=np.float32)
        for i, x in enumerate(inputs):
            z += np.repeat((model.weights[i] + offset[active, i]) * np.float32(1 / STEPS), text_size) * x
        np.clip(z, -14, 14, out=z)
        turned = sign.take(which)
        z *= turned
        e = np.exp(z)  # odds of the other bit
        more = e + np.float32(1)
        out[own] = -np.log(np.multiply.reduceat(more, bit_first, dtype=np.float64))  # a code has at most some 50 bits, so that this stays finite
        e /= more
        e *= turned
        gradient = np.stack([np.add.reduceat(e * x, text_first) for x in inputs], 1) * np.float32(-1 / STEPS)
        offset[active] = np.clip(offset[active] + np.float32(RATE) * gradient / np.sqrt(text_size)[:, None].astype(np.float32), -0.5, 0.5)
        done, step = done + step, min(2 * step, LAST_STEP)
    return out


def mixed_tokens(ln_bytes: np.ndarray, known: np.ndarray, texts: np.ndarray, prior: float = 0.05, block: int = 64, trust: float = 8.0) -> np.ndarray:
    """log10 probability of each text from those of its tokens: by bytes (ln), and by the vocabulary (share of all tokens).

    A token's probability is the sum of both, each times its share. The vocabulary's share begins at prior, weighs as much as
    trust tokens, and is refined with how well each has done in the text so far, in steps of tokens that grow to block.
    """
    lengths = np.diff(texts)
    out, wins, seen = np.zeros(len(lengths)), np.full(len(lengths), trust * prior), np.full(len(lengths), trust)
    done, last, block = 0, block, 4
    while True:
        active = np.flatnonzero(lengths > done)
        if not len(active):
            return out / np.log(10)
        size = np.minimum(lengths[active] - done, block)
        first = np.cumsum(size) - size
        own = np.repeat(texts[active] + done - first, size) + np.arange(int(size.sum()))
        share = np.repeat(wins[active] / seen[active], size)
        with np.errstate(divide="ignore"):
            by_word, by_byte = np.log(share) + np.log(known[own]), np.log1p(-share) + ln_bytes[own]
        both = np.logaddexp(by_word, by_byte)
        out[active] += np.add.reduceat(both, first)
        wins[active] += np.add.reduceat(np.exp(by_word - both), first)
        seen[active] += size
        done, block = done + block, min(2 * block, last)


# --- learning from the corpus -------------------------------------------------------------------------------------------


#: Training texts are counted in two halves: weights are fitted on each by what was counted of the other.
HALVES = 2
#: A counter's entries are of 32 bits: it is sent off before a bit can have been seen more often.
MOST_SEEN = 1 << 31


def _parts(counter: Counter, half: int) -> tuple[list[int], list[bytes]]:
    names, blobs = [], []
    for i, c in enumerate(counter.tables()):
        for p, part in enumerate(c.reshape(-1, 2 << PART_BITS)):
            if part.any():
                names.append((half * INPUTS + i) * 1000 + p)
                blobs.append(pa.compress(part.astype("<u4").tobytes(), "zstd", asbytes=True))
    return names, blobs


def _packed_counts(code: Code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [Counter(code) for _ in range(HALVES)]
        sent = lambda h: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(_parts(counters[h], h), (pa.int32(), pa.binary()), strict=True)], names=["part", "counts"])
        for batch in batches:
            for h in range(HALVES):
                for chunk in chunks(batch.filter(pc.equal(batch["half"], h))["text"], LEARN_BYTES):
                    if counters[h].seen + len(chunk.data) + len(chunk.offsets) > MOST_SEEN:
                        yield sent(h)
                        counters[h] = Counter(code)
                    counters[h].add(stream(chunk))
        for h in range(HALVES):
            yield sent(h)
        give_back()

    return run


def _summed(group: pa.Table) -> pa.Table:
    total = np.zeros(2 << PART_BITS, dtype=np.uint64)
    for blob in group["counts"]:
        total += np.frombuffer(pa.decompress(blob.as_buffer(), 4 * len(total), "zstd"), dtype="<u4")
    return pa.table({"part": pa.array([group["part"][0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def predictors(train: DataFrame, code: Code) -> list[list[np.ndarray]]:
    """Counts (entry, bit) of each predictor over all texts of each half of train; their sizes are fixed, whatever the corpus."""
    rows = train.select("half", "text").mapInArrow(_packed_counts(code), "part int, counts binary").groupBy("part").applyInArrow(_summed, "part int, counts binary").toLocalIterator()
    tables = [[np.zeros(2 << b, dtype=np.uint64) for b in TABLE_BITS] for _ in range(HALVES)]
    for r in rows:
        which, p = divmod(r["part"], 1000)
        tables[which // INPUTS][which % INPUTS][2 * (p << PART_BITS) : 2 * ((p + 1) << PART_BITS)] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint64)
    return tables


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, dtype=np.int64)
    for batch in batches:
        for chunk in chunks(batch["text"]):
            total += np.bincount(LOWER[chunk.data], minlength=256)
        total[0] += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total)], names=["byte", "n"])


def learned_code(train: DataFrame) -> Code:
    """The code of the bytes of all texts of train."""
    counts = np.zeros(256, dtype=np.int64)
    for r in train.select("text").mapInArrow(_byte_counts, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[r["byte"]] = r["n"]
    return code_from(counts)


def _repeats(s: Stream) -> np.ndarray:
    """How often each token occurs in its own text."""
    text = np.repeat(np.arange(len(s.text_tokens) - 1), np.diff(s.text_tokens))
    key = s.hashes ^ mix(text.astype(np.uint64))
    order = np.argsort(key)
    h = key[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    times = np.diff(np.append(first, len(h)))
    out = np.empty(len(h), dtype=np.int64)
    out[order] = np.repeat(times, times)
    return out


#: A shard of its own, and the block of its answer: slopes and curvatures of all blocks in the weights.
FIT = -1


def _asked(shards: int, fit: tuple[Code, list[list[np.ndarray]]] | None):
    def run(group: pa.Table) -> pa.Table:
        """The distinct tokens of a block, by shard, with their counts in its training texts; and what the weights learn of these."""
        block = group["block"][0].as_py()
        hashes, counted, found = [], [], np.zeros((INPUTS + 1, INPUTS))
        for half in (None, *range(HALVES)):
            texts = group.filter(pc.is_null(group["half"]) if half is None else pc.equal(group["half"], half))["text"]
            for chunk in chunks(texts, LEARN_BYTES):
                s = stream(chunk)
                hashes.append(s.hashes)
                counted.append(np.full(len(s.hashes), half is not None))
                if fit is not None and half is not None:
                    slope, curve = slopes(s, fit[0], fit[1][1 - half], np.full(INPUTS, START))
                    found += np.vstack((slope, curve))
        tokens, where = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate(counted), minlength=len(tokens)).astype("<u4")
        shard = (tokens % _U(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        own = np.flatnonzero(cuts[1:] > cuts[:-1])
        blobs = [[c[order][cuts[x] : cuts[x + 1]].tobytes() for x in own] for c in (tokens.astype("<u8"), counts)]
        shard = pa.array([*own, FIT], pa.int32())
        return pa.table({"shard": shard, "block": pa.array([block] * len(shard), pa.int64()), "tokens": pa.array([*blobs[0], found.astype("<f8").tobytes()], pa.binary()), "counts": pa.array([*blobs[1], b""], pa.binary())})

    return run


def _answered(group: pa.Table) -> pa.Table:
    """For each block, the whole corpus's counts of its tokens in this shard; the first row also carries the shard's totals. Of the shard
    FIT the sum, in the order of the blocks, so that reruns agree."""
    if group["shard"][0].as_py() == FIT:
        total = sum(np.frombuffer(t.as_buffer(), dtype="<f8") for t in group.sort_by("block")["tokens"])
        return pa.table({"block": pa.array([FIT], pa.int64()), "tokens": pa.array([total.tobytes()], pa.binary()), "counts": pa.array([b""], pa.binary()), "n": pa.array([0], pa.int64()), "v": pa.array([0], pa.int64())})
    tokens = [np.frombuffer(t.as_buffer(), dtype="<u8") for t in group["tokens"]]
    counts = np.concatenate([np.frombuffer(c.as_buffer(), dtype="<u4") for c in group["counts"]]).astype(np.float64)
    distinct, where = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.bincount(where, weights=counts, minlength=len(distinct)).astype("<i8")
    cuts = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
    blobs = [total[where[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    sums = np.zeros((2, len(tokens)), dtype=np.int64)
    sums[:, 0] = total.sum(), np.count_nonzero(total)
    return pa.table({"block": group["block"], "tokens": group["tokens"], "counts": pa.array(blobs, pa.binary())} | {name: pa.array(x) for name, x in zip(("n", "v"), sums, strict=True)})


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _scored(model: Model, n: int, v: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_batches([], schema=pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())]))
        tokens = np.concatenate([np.frombuffer(t.as_buffer(), dtype="<u8") for t in answers["tokens"]])
        counts = np.concatenate([np.frombuffer(c.as_buffer(), dtype="<i8") for c in answers["counts"]])
        order = np.argsort(tokens)
        tokens, counts = tokens[order], counts[order]
        held = np.array(texts["held_out"].to_pylist(), dtype=bool)
        found: list[list[np.ndarray]] = []
        for chunk in chunks(texts["text"], SCORE_BYTES):
            s = stream(chunk)
            c = counts[np.searchsorted(tokens, s.hashes)].astype(np.float64)
            first = s.text_tokens[:-1]
            base = np.add.reduceat(np.log10((c + 0.1) / (n + 0.1 * (v + 1))), first)
            ln = byte_scores(s, model).astype(np.float64)
            # a training text's own tokens are taken off, so that it is judged by the others as a held-out text is
            trained = ~held[chunk.first : chunk.first + len(first)]
            tokens_each = np.diff(s.text_tokens)
            others = np.maximum(n - np.where(trained, tokens_each, 0), 1)
            share = (c - _repeats(s) * np.repeat(trained, tokens_each)) / np.repeat(others, tokens_each)
            score = mixed_tokens(np.add.reduceat(ln, s.token_first), share, s.text_tokens)
            size = np.diff(s.text_bytes)
            found.append([np.diff(s.text_tokens), np.add.reduceat((c > 0).astype(np.int64), first), base, score, -score * np.log2(10) / size])
        n_tokens, n_known, base, score, bits = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(len(base), n, dtype=np.int64), "base_score": base, "score": score, "bits_per_byte": bits})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row's whole text.

    Learned from rows whose crc32(id) mod 10 is not 0: the count of every token, exactly, of every bit in its contexts, and the
    weights with which every text begins. The tokens' counts grow with the corpus and stay distributed: each block of texts asks
    the shards of the vocabulary for its own tokens. The predictors and the code count the bytes of all training rows, in tables
    of a fixed size; only they reach the driver and all executors. The weights are those of one logistic regression over all bits
    of all training rows: a step of Newton's method from START, each half of the rows judged by the counts of the other, so that
    no text is among those it is judged by; weights that are given stand instead. Every text refines them as it is read. A
    training text's token counts are those of the other texts. Tokens are told apart by 64-bit hashes. A null or empty text is
    its end alone; null ids count as the empty text for held_out; repeated rows are scored each; without training rows N is 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", remainder("doc_id", 10) == 0)
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.col(text_col))).alias("bytes")).first()
    blocks = max(1, -(-int(size["bytes"] or 0) // BLOCK_BYTES), size["rows"] // 100_000)
    rows = rows.withColumn("half", F.when(~F.col("held_out"), F.pmod(F.xxhash64("text"), F.lit(HALVES).cast("long"))))
    train = rows.where(~F.col("held_out"))
    code = learned_code(train)
    halves = predictors(train, code)
    tables = [stretched(sum(both)) for both in zip(*halves, strict=True)]
    fit = (code, [[stretched(c) for c in half] for half in halves]) if weights is None else None

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks).cast("long")))
    shards = max(16, blocks)
    asked = dealt.select("block", "half", "text").groupBy("block").applyInArrow(_asked(shards, fit), "shard int, block long, tokens binary, counts binary")
    answers = written(asked.groupBy("shard").applyInArrow(_answered, "block long, tokens binary, counts binary, n long, v long"), "lm-answers")
    n, v = (int(x or 0) for x in answers.agg(F.sum("n"), F.sum("v")).first())
    start = np.full(INPUTS, START) if weights is None else np.asarray(weights)
    learned = answers.where(F.col("block") == FIT).first()
    if fit is not None and learned is not None:
        slope, *curve = np.frombuffer(learned["tokens"], dtype="<f8").reshape(INPUTS + 1, INPUTS)
        start = np.round(newton(start, slope, np.array(curve)), 4)
    model = Model(code, tables, start.astype(np.float32))
    answers = answers.where(F.col("block") != FIT).select("block", "tokens", "counts")
    return dealt.select("block", "doc_id", "held_out", "text").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(model, n, v), _SCORES)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
