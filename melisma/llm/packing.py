"""Packing token sequences: pieces of documents into near-equal windows by multiway differencing."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .vectors import SPACE, Chunk, chunks, give_back, word_hashes, words

WINDOW = 2048
#: A document's rest after its whole windows is cut to pieces of this many tokens at most.
PIECE = 512
#: Token id that ends a document.
END = 1
#: Tokens of rests in one unit of packing, about 200 windows.
UNIT_TOKENS = 400_000
#: Bytes of text whose distinct words are looked up at once.
BATCH_BYTES = 1 << 20
#: Word parts that a worker remembers; beyond, it forgets all and goes on.
REMEMBERED = 200_000


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte: itself if printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class WordTokenizer:
    """Ids of whole texts by a `tokenizers` file whose pre-tokenizer never crosses white space, each distinct word once.

    Words of printable ASCII and Latin letters are split here and only their parts go to the file's BPE model; any other word
    goes through the whole tokenizer. Both give the ids of encode(text, add_special_tokens=False).
    """

    #: Lower-cased words: the pre-tokenizer's contractions, letters, digits one by one, and the rest.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\sa-zß-öø-ž0-9]+")
    MARKS = frozenset(b".,;:!?")
    PLAIN = re.compile(r"(?!.*<\|)[!-~À-ÖØ-öø-įı-ž]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = byte_letters()
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            written_out = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
            found = self.parts[part] = np.array([t.id for t in self.model.tokenize(written_out)], dtype="<u4").tobytes()
        return found

    def _word(self, word: bytes) -> bytes:
        # most words are ASCII letters, or these and one mark after them: their parts are plain to see
        if word.isalpha():
            return self._part(word.lower().decode())
        if word[-1] in self.MARKS and word[:-1].isalpha():
            return self._part(word[:-1].lower().decode()) + self._part(chr(word[-1]))
        text = word.decode()
        if self.PLAIN.fullmatch(text):
            return b"".join(map(self._part, self.PARTS.findall(text.lower())))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, chunk: Chunk) -> list[np.ndarray]:
        w = words(chunk, SPACE)
        _, first, where = np.unique(word_hashes(chunk.data, w), return_index=True, return_inverse=True)
        raw = chunk.data.tobytes()
        found = [self._word(raw[a:b]) for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)]
        lengths = np.array([len(x) // 4 for x in found], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        each = lengths[where]
        ends = np.concatenate(([0], np.cumsum(each)))
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        ids = flat[np.repeat(starts[where] - ends[:-1], each) + np.arange(ends[-1])] if ends[-1] else np.zeros(0, dtype="<u4")
        cuts = ends[w.first]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut(tokens: int, window: int = WINDOW, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of whole windows, then of the rest in pieces."""
    whole = tokens // window * window
    return [(s, window) for s in range(0, whole, window)] + [(s, min(piece, tokens - s)) for s in range(whole, tokens, piece)]


_PIECES = "row_key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _tokenized(path: str, window: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            keys, doc_ids = batch["row_key"].to_pylist(), batch["doc_id"].to_pylist()
            for chunk in chunks(batch["text"], BATCH_BYTES):
                rows = []
                for i, ids in enumerate(own.ids(chunk), chunk.first):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    rows += [(keys[i], doc_ids[i], s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in cut(len(ids), window, piece)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names=["row_key", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        give_back()

    return run


def pieces(docs: DataFrame, path: str, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """Each row's document of its whole text's ids and END, cut to pieces; a null or empty text has END alone.

    path is a place that all executors can read, as of an installed package's file.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_tokenized(path, window, piece), _PIECES)


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window 0..k-1 of each size, by the largest differencing method of Karmarkar and Karp for k parts.

    Each size starts as a partial partition of one full and k-1 empty parts. The two with the largest imbalance are merged,
    the fullest parts of one with the emptiest of the other, until one partition is left.
    """
    n = len(sizes)
    if k == 1:
        return np.zeros(n, dtype=np.int64)
    sums: dict[int, np.ndarray] = {}
    merged: list[tuple[int, int, np.ndarray]] = []  # left, right, and where the sorted parts came from
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    for step in range(n - 1):
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        parts = []
        for x in (a, b):
            if x < n:
                one = np.zeros(k, dtype=np.int64)
                one[0] = sizes[x]
                parts.append(one)
            else:
                parts.append(sums.pop(x))
        total = parts[0] + parts[1][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        total -= total[-1]
        sums[n + step] = total
        merged.append((a, b, order))
        heapq.heappush(heap, (-int(total[0]), n + step))
    window = np.zeros(n, dtype=np.int64)
    at = {2 * n - 2: np.arange(k)}
    for step in range(n - 2, -1, -1):
        a, b, order = merged[step]
        mine = np.empty(k, dtype=np.int64)
        mine[order] = at.pop(n + step)  # window of the parts before they were sorted
        for x, own in ((a, mine), (b, mine[::-1])):
            if x < n:
                window[x] = own[0]
            else:
                at[x] = own
    return window


def fit_windows(sizes: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, int]:
    """Near-equal windows none of which exceeds the capacity: their number rises whenever one does."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        most = np.bincount(window, weights=sizes, minlength=k).max()
        if most <= capacity:
            return window, k
        k += max(1, int(k * (most - capacity) / capacity / 2))


def _packed_unit(capacity: int):
    def run(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by([(c, "ascending") for c in ("length", "doc_id", "row_key", "start", "ids_crc32")])
        number, length = unit["unit"][0].as_py(), unit["length"].to_numpy().astype(np.int64)
        rest = length < capacity
        window = np.empty(len(length), dtype=np.int64)
        own, used = fit_windows(length[rest], capacity) if rest.any() else (np.zeros(0, dtype=np.int64), 0)
        window[rest] = own
        window[~rest] = used + np.arange(int((~rest).sum()))
        order = np.argsort(window, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.concatenate(([True], window[order][1:] != window[order][:-1]))
        offset = np.empty(len(length), dtype=np.int64)
        offset[order] = before - before[first][np.cumsum(first) - 1]
        return unit.drop_columns(["row_key", "unit"]).append_column("sequence_id", pa.array((number << 32) + window)).append_column("offset", pa.array(offset))

    return run


def pack(cut_pieces: DataFrame, capacity: int = WINDOW, unit_tokens: int = UNIT_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece; each sequence holds capacity tokens at most.

    Pieces are dealt by a hash into units of about unit_tokens each, which bound the work of one differencing; whole windows
    are sequences of their own. Repeated rows and null ids are documents like others. No pieces give no rows.
    """
    totals = cut_pieces.agg(F.sum("length").alias("tokens")).first()
    units = max(1, -(-int(totals["tokens"] or 0) // unit_tokens))
    # by where a piece stands as well: pieces of equal rows go to many units
    dealt = cut_pieces.withColumn("unit", F.pmod(F.xxhash64("row_key", "start", F.monotonically_increasing_id()), F.lit(units).cast("long")))
    return dealt.groupBy("unit").applyInArrow(_packed_unit(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    return pack(written(pieces(docs, path, window, piece), "pieces"), window)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
