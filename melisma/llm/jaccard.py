"""Exact n-gram Jaccard join: position-blocked index lists, and answers derived from those of similar sets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_key, set_aside, table, whole_row, written
from .components import components
from .vectors import LOWER, Chunk, chunks, give_back, mix, shingles, word_hashes, words

_U = np.uint64
#: Buckets of the frequency sketch that orders shingles: 4 MB of levels at any corpus size.
SKETCH_BITS, SKETCH_PART = 22, 1 << 16
#: Index entries in one shard on average, and entries that one part of a hot list may hold.
SHARD_ENTRIES, LIST_ENTRIES = 200_000, 200_000
#: Lists longer than this are answered by way of a leader.
LONG_LIST = 64
#: Ids sent to all executors at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Index entries that two sets must share to be compared; prefixes are longer by as many.
COMMON = 6
#: At the first COMMON shingles that two sets share, their places add up to their symmetric difference and this at most.
SLACK = 2 * (COMMON - 1)
#: Times at most that long lists take another leader, while this joins components, before all sets of different ones are compared.
LEADER_ROUNDS = 3
#: A node with more than this share of all rows is looked up in a broadcast table; there are fewer of them than its inverse.
HOT_SHARE = 1e-3


class Threshold(NamedTuple):
    """Sets of k-word shingles link when den * intersection >= num * union."""

    k: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: int, common: int) -> int:
        """So many first shingles of a set share `common` with the first of any set that it links to (or all they must share)."""
        return min(n, n - -(-self.num * n // self.den) + common) if n else 0

    def least_common(self, n, m):
        """Shingles that linked sets of these sizes share at least."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def most_apart(self, n, m):
        """Largest symmetric difference of linked sets of these sizes."""
        return n + m - 2 * self.least_common(n, m)

    def furthest(self, n):
        """Largest symmetric difference of a set of this size and any that it links to. That of two sizes goes up and down by
        one with their sum, never down over two steps: its maximum is at the largest partner or the one before."""
        m = self.den * n // self.num
        return np.maximum(self.most_apart(n, m), self.most_apart(n, np.maximum(m - 1, n)))

    def sizes_fit(self, n, m):
        return (self.den * np.minimum(n, m)) >= (self.num * np.maximum(n, m))


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for chunk in chunks(texts):
        own = Chunk(chunk.first, chunk.offsets, LOWER[chunk.data])
        w = words(own)
        yield chunk.first, shingles(word_hashes(own.data, w), w.first, k)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents' distinct shingles fall in each bucket, over all documents; the buckets are fixed in number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for batch in batches:
            for _, sets in _sets(batch["text"], k):
                if sets:
                    which, times = np.unique(_bucket(np.concatenate(sets)), return_counts=True)
                    counts[which] += times.astype(np.uint32)
        parts = counts.astype("<u4").reshape(-1, SKETCH_PART)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_PART, dtype=np.int64)
        for c in group["counts"]:
            total += np.frombuffer(zlib.decompress(c.as_py()), dtype="<u4")
        return pa.table({"part": pa.array([group["part"][0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    out = np.zeros((1 << SKETCH_BITS) // SKETCH_PART * SKETCH_PART, dtype=np.int64).reshape(-1, SKETCH_PART)
    for r in rows:
        out[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), dtype="<i8")
    return out.ravel()


def levels(counts: np.ndarray) -> np.ndarray:
    """0..15: in which power of two of the mean a bucket's count lies. Frequent shingles come last in the order of all."""
    return np.clip(np.floor(np.log2(np.maximum(counts / max(counts.mean(), 1e-9), 1.0))), 0, 15).astype(np.uint8)


def ordered(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A set's shingles as sorted keys of (level, hash): the one order in which prefixes are taken."""
    return np.sort((level[_bucket(hashes)].astype(np.uint64) << _U(60)) | (hashes & _U((1 << 60) - 1)))


def node_of(keys: np.ndarray) -> int:
    """One id for equal sets: a 64-bit hash of all shingles."""
    total = mix(keys).sum(dtype=np.uint64) + _U(len(keys))
    return int(mix(np.array([total], dtype=np.uint64))[0].astype(np.int64))


def parities(keys: np.ndarray) -> np.ndarray:
    """64-bit words: is the number of a set's shingles that fall on each of 1024 bits odd? Two sets differ by as many shingles
    as their words differ in bits at least."""
    odd = (np.bincount((mix(keys) >> _U(54)).astype(np.int64), minlength=1024) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8")


PARITIES = [f"parity{i}" for i in range(16)]


def _named(level: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, words_ = [], [], []
            for _, sets in _sets(batch["text"], k):
                for s in sets:
                    keys = ordered(s, level)
                    nodes.append(node_of(keys) if len(s) else None)
                    sizes.append(len(s))
                    words_.append(parities(keys))
            bits = np.array(words_, dtype=np.int64).reshape(-1, len(PARITIES))
            columns = [batch["doc_id"], batch["row_key"], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *[pa.array(bits[:, i]) for i in range(len(PARITIES))]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "node", "n", *PARITIES])
        give_back()

    return run


def _indexed(level: np.ndarray, salts: np.ndarray, shards: int, t: Threshold):
    """Entries of the prefix index, packed by shard; each distinct set once a task. An odd token is one of a list in several parts."""

    def flush(held: list[tuple[int, np.ndarray]], sizes: list[int]) -> pa.RecordBatch:
        lengths = np.array([len(p) for _, p in held])
        tokens = np.concatenate([p for _, p in held])
        node = np.repeat(np.array([x for x, _ in held], dtype=np.int64), lengths)
        size = np.repeat(np.array(sizes, dtype=np.uint32), lengths)
        place = np.minimum(np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths), 65_535).astype(np.uint16)
        mixed = mix(tokens)
        parts = salts[(tokens >> _U(60)).astype(np.int64)]
        salt = mix(node.view(np.uint64)) % parts
        name = ((mixed >> _U(16)) << _U(1)) | (parts > 1)
        shard = (mix(mixed + salt) % _U(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        own = np.flatnonzero(cuts[1:] > cuts[:-1])
        columns = [c[order] for c in (name.astype("<u8"), node.astype("<i8"), size.astype("<u4"), place.astype("<u2"))]
        packed = [pa.array([c[cuts[s] : cuts[s + 1]].tobytes() for s in own], pa.binary()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *packed], names=["shard", "tokens", "nodes", "sizes", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, entries, seen = [], [], 0, set()
        for batch in batches:
            for _, sets in _sets(batch["text"], t.k):
                for s in sets:
                    if not len(s):
                        continue
                    keys = ordered(s, level)
                    node = node_of(keys)
                    if node in seen:
                        continue
                    seen.add(node)
                    held.append((node, keys[: t.prefix(len(s), COMMON)]))
                    sizes.append(len(s))
                    entries += len(held[-1][1])
                    if entries > 400_000:
                        yield flush(held, sizes)
                        held, sizes, entries = [], [], 0
        if held:
            yield flush(held, sizes)
        give_back()

    return run


_FOUND = "kind int, token long, a long, b long, n long, place int"
#: Rows of _FOUND: pairs of short lists (place: how many of this shard's lists hold both; n: how many of all must), entries of
#: long lists, their leaders, and pairs with a leader.
PAIR, ENTRY, LEADER, LED = 0, 1, 2, 3


def _probe(t: Threshold, long_list: int):
    """One shard's lists: pairs of short lists; of long ones (and parts of one) the pairs with the leader, the entries, and the leader."""

    def run(group: pa.Table) -> pa.Table:
        column = lambda name, kind: np.frombuffer(b"".join(group[name].to_pylist()), dtype=kind)
        token, node, size, place = column("tokens", "<u8"), column("nodes", "<i8"), column("sizes", "<u4").astype(np.int64), column("places", "<u2").astype(np.int64)
        order = np.lexsort((node, token))
        token, node, size, place = token[order], node[order], size[order], place[order]
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
        token, node, size, place = token[fresh], node[fresh], size[fresh], place[fresh]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        length = np.diff(np.concatenate((first, [len(token)])))
        found: list[list[np.ndarray]] = []

        def keep(kind: int, i: np.ndarray, j: np.ndarray) -> None:
            n, m = size[i], size[j]
            fits = t.sizes_fit(n, m) & (place[i] + place[j] <= t.most_apart(n, m) + SLACK)
            i, j = i[fits], j[fits]
            if len(i):
                need = np.minimum(COMMON, t.least_common(size[i], size[j]))
                found.append([np.full(len(i), kind), np.zeros(len(i), np.int64), np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), need, np.ones(len(i), np.int64)])

        parted = (token[first] & _U(1)) == 1
        whole = ~parted & (length <= long_list)
        for m in range(2, long_list + 1):
            starts = first[whole & (length == m)]
            x, y = np.triu_indices(m, 1)
            step = max(1, 1_000_000 // len(x))
            for lo in range(0, len(starts), step):
                base = starts[lo : lo + step, None]
                keep(PAIR, (base + x[None, :]).ravel(), (base + y[None, :]).ravel())
        for s, m in zip(first[~whole].tolist(), length[~whole].tolist(), strict=True):
            own = np.arange(s, s + m)
            # an entry so late that no early common shingle can stand there with any other is skipped; other parts of a list may begin at 0
            earliest = 0 if token[s] & _U(1) else place[own].min()
            own = own[place[own] + earliest <= t.furthest(size[own]) + SLACK]
            if not len(own):
                continue
            # rare shingles come first, so the earliest entry belongs to the set with the fewest of its own: the one most like the others
            leader = own[np.lexsort((node[own], place[own]))[0]]
            keep(LED, np.full(len(own) - 1, leader), own[own != leader])
            name = (token[own] >> _U(1)).astype(np.int64)
            found.append([np.full(len(own), ENTRY), name, node[own], np.zeros(len(own), np.int64), size[own], place[own]])
            found.append([np.array([LEADER]), name[:1], node[[leader]], np.zeros(1, np.int64), size[[leader]], place[[leader]]])
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 6
        rows = pa.table([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "token", "a", "b", "n", "place"])
        alike = rows.group_by(["kind", "token", "a", "b", "n"]).aggregate([("place", "sum")])
        return alike.select(["kind", "token", "a", "b", "n", "place_sum"]).rename_columns(rows.schema.names).cast(rows.schema)

    return run


def _whole(level: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch["text"], k):
                keys = [ordered(s, level) for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in keys], pa.int64()), pa.array([x.astype("<u8").tobytes() for x in keys], pa.binary())], names=["node", "keys"])

    return run


def _verified(t: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, linked = [], []
            for x, y in zip(batch["a_keys"], batch["b_keys"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
                shared.append(both)
                linked.append(t.den * both >= t.num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(shared, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "shared", "linked"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """(a, b, shared, linked) of the pairs (a, b): how many shingles their whole sets share, and whether they link."""
    one = sets.select(F.col("node").alias("a"), F.col("keys").alias("a_keys"))
    other = sets.select(F.col("node").alias("b"), F.col("keys").alias("b_keys"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "a_keys", "b_keys").mapInArrow(_verified(t), "a long, b long, shared long, linked boolean")


def guides(answers: DataFrame, leaders: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, guide, guide_n, shared): of the leaders that a set was compared with, the one that it shares most shingles with, and
    how many these are. A leader guides itself."""
    lead = leaders.select(F.col("a").alias("guide")).distinct().join(sets.select(F.col("node").alias("guide"), F.col("n").alias("guide_n")), "guide")
    told = lead.join(answers, F.col("guide") == F.col("a")).select(F.col("b").alias("node"), "guide", "guide_n", "shared")
    told = told.unionByName(lead.join(answers, F.col("guide") == F.col("b")).select(F.col("a").alias("node"), "guide", "guide_n", "shared"))
    told = told.unionByName(lead.select(F.col("guide").alias("node"), "guide", "guide_n", F.col("guide_n").alias("shared")))
    best = F.max(F.struct(F.col("node") == F.col("guide"), "shared", "guide", "guide_n")).alias("best")
    return told.groupBy("node").agg(best).select("node", "best.guide", "best.guide_n", "best.shared")


def _met(x: DataFrame, y: DataFrame, told_apart: Column, t: Threshold, guided: bool = False) -> DataFrame:
    """(a, b, common, need): each two entries x and y of a list that are told apart and may link, once for each list.

    Guided, also (sure): a list is cut to blocks by the power of two of an entry's place, and an entry meets only the blocks that
    its own place leaves within reach. Where both sets have one guide, their overlap is bounded from the guide's two answers: what
    they share inside the guide and outside of it. Pairs below the least are left out; sure pairs link by the lower bound alone.
    """
    on = F.col("x.token") == F.col("y.token")
    if guided:
        reach = F.floor(F.col("n") * F.lit((t.den - t.num) / t.num) + F.lit(1e-6)) + SLACK - F.col("place")
        block = lambda place: F.floor(F.log2(place + 1)).cast("int")
        x, y = x.where(reach >= 0).withColumn("block", F.explode(F.sequence(F.lit(0), block(reach)))), y.withColumn("block", block(F.col("place")))
        on = on & (F.col("x.block") == F.col("y.block"))
    x, y = x.alias("x"), y.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    least = F.ceil(F.lit(t.num) * (n + m) / F.lit(t.num + t.den))
    apart = n + m - 2 * least
    differ = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in PARITIES[1:]), F.bit_count(F.col("x.parity0").bitwiseXOR(F.col("y.parity0"))))
    fits = told_apart & (t.den * F.least(n, m) >= t.num * F.greatest(n, m)) & (F.col("x.place") + F.col("y.place") <= apart + SLACK) & (differ <= apart)
    found = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.lit(1).alias("common"), F.least(F.lit(COMMON), least).alias("need")]
    if guided:
        one_guide, inside, other = F.coalesce(F.col("x.guide") == F.col("y.guide"), F.lit(False)), F.col("x.shared"), F.col("y.shared")
        fits = fits & ~(one_guide & (F.least(inside, other) + F.least(n - inside, m - other) < least))
        found.append((one_guide & (inside + other - F.col("x.guide_n") >= least)).alias("sure"))
    return x.join(y, on & fits).select(*found)


def join(docs: DataFrame, t: Threshold = Threshold(), id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, node, group, n_shingles, component_id) of each row of docs, and all verified links (a, b), a < b, between nodes.

    A node stands for all rows with equal shingle sets, whose answers are derived from one of them. An index lists, for every
    shingle among the first few of a set (in an order with frequent shingles last), the sets and the shingle's place in each;
    lists are cut to shards, and pairs whose sizes or places rule a link out, or that share too few entries, are skipped. In a
    long list all sets are compared with one leader first, the one with the fewest rare shingles of its own, then with others for
    as long as that joins components. What lies in one component by then needs no further comparison: of the rest, only pairs of
    different components are candidates, and parity words that each set carries along rule out most of those that differ too
    much. Every candidate is verified on whole sets, and every pair of texts that links lies in one
    component, as all-pairs comparison would put it.

    The links are not those that components were made of, but all: they are planned here and computed only where a caller reads
    them, by comparing entries of long lists too, where blocks of places beyond an entry's reach are skipped. A set's links are derived
    from the answers of its guide, the leader most like it: a pair of one guide is left out or linked without a look at the sets
    where the guide's two answers decide. Their number grows with the square of a group of near copies.

    Texts without words (null too) have 0 shingles, no node and their own id as component. Null ids take part, but a component's
    id is the smallest one that is not null. Repeated rows stay. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("row_key", row_key("doc_id", "text"))
    counts = sketch(rows, t.k)
    level = levels(counts)
    own = written(rows.select("doc_id", "row_key", "text").mapInArrow(_named(level, t.k), "doc_id long, row_key long, node long, n long, " + ", ".join(f"{c} long" for c in PARITIES)), "jaccard-nodes")
    first = written(own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", *PARITIES)]), "jaccard-sets")

    entries = first.agg(F.sum(F.col("n") - F.ceil(F.lit(t.num) * F.col("n") / F.lit(t.den)) + COMMON)).first()[0] or 0
    shards = max(64, -(-int(entries) // SHARD_ENTRIES))
    # a level's lists are as long as its largest bucket at most
    most = np.array([counts[level == i].max(initial=0) for i in range(16)])
    salts = np.maximum(1, -(-most // LIST_ENTRIES)).astype(np.uint64)
    salts[0] = 1
    index = rows.select("text").mapInArrow(_indexed(level, salts, shards, t), "shard int, tokens binary, nodes binary, sizes binary, places binary")
    found = written(index.groupBy("shard").applyInArrow(_probe(t, long_list), _FOUND), "jaccard-candidates")

    leaders = found.where(F.col("kind") == LEADER)
    chief = leaders.groupBy("token").agg(F.min(F.struct("place", "a")).alias("chief")).select("token", F.col("chief.a").alias("chief"))
    across = leaders.join(chief, "token").where(F.col("a") != F.col("chief")).select(F.least("a", "chief").alias("a"), F.greatest("a", "chief").alias("b"))
    # in how many lists a pair stands together; of long lists, with a leader only
    alike = found.where(F.col("kind").isin(PAIR, LED)).groupBy("a", "b").agg(F.sum("place").alias("common"), F.max("n").alias("need")).where("common >= need").select("a", "b")
    pairs = written(alike.unionByName(across).distinct(), "jaccard-pairs")
    long = found.where(F.col("kind") == ENTRY).select("token", F.col("a").alias("node"), "n", "place")

    def verified(candidates: DataFrame, label: str) -> DataFrame:
        used = candidates.select(F.col("a").alias("node")).unionByName(candidates.select(F.col("b").alias("node"))).distinct()
        wanted = written(first.join(used, "node", "left_semi").select(F.col("first_doc").alias("doc_id")).distinct(), "jaccard-wanted")
        small = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        texts = rows.join(small, rows["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text")
        sets = written(texts.mapInArrow(_whole(level, t.k), "node long, keys binary"), "jaccard-whole")
        return written(verify(candidates, sets, t).where("linked").select("a", "b"), label)

    links = verified(pairs, "jaccard-links")

    joined = components(links)

    def left() -> DataFrame:
        """Entries of the long lists that hold sets of different components, as of now."""
        entry = long.join(joined, "node", "left").select("token", "node", "n", "place", F.coalesce("label", "node").alias("label"))
        mixed = entry.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
        return written(entry.join(mixed, "token", "left_semi").join(first.select("node", *PARITIES), "node"), "jaccard-left")

    entry = left()
    for turn in range(LEADER_ROUNDS):
        # another leader of each list, the same in all lists that it is in where it can be
        head = entry.groupBy("token").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), *[c for c in entry.columns if c != "token"])).alias("head")).select("token", "head.*")
        told_apart = F.col("x.label") != F.col("y.label")
        more = written(_met(head, entry, told_apart, t).select("a", "b").distinct(), "jaccard-led")
        if more.isEmpty() or (fresh := verified(more, "jaccard-more")).isEmpty():
            break
        links = links.unionByName(fresh)
        joined = components(links)
        entry = left()
    # sets of different components are left
    both = written(_met(entry, entry, F.col("x.label") < F.col("y.label"), t).groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("need").alias("need")), "jaccard-mixed")
    if not both.isEmpty():
        short = found.where(F.col("kind") == PAIR).join(both.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.sum("place").alias("short"))
        rest = both.join(short, ["a", "b"], "left").where(F.col("common") + F.coalesce("short", F.lit(0)) >= F.col("need")).select("a", "b")
        more = verified(written(rest.join(pairs, ["a", "b"], "left_anti"), "jaccard-rest"), "jaccard-more")
        if not more.isEmpty():
            links = links.unionByName(more)
            joined = components(links)

    least = joined.join(first, "node").groupBy("label").agg(F.min("first_doc").alias("component"))
    known = joined.join(least, "label").select("node", "label", "component")
    by_node = written(first.join(known, "node", "left").select("node", "copies", F.coalesce("label", "node").alias("group"), F.coalesce("component", "first_doc").alias("component_id")), "jaccard-groups")
    # a node that holds many rows meets them where they are read; fewer than 1 / HOT_SHARE nodes can
    many = F.col("copies") > F.lit(HOT_SHARE) * own.count()
    hot = F.broadcast(by_node.where(many).drop("copies"))
    texts = own.where("n > 0").select("doc_id", "row_key", "node", F.col("n").alias("n_shingles"))
    columns = ("doc_id", "row_key", "node", "group", "n_shingles", "component_id")
    empty = own.where("n = 0").select("doc_id", "row_key", "node", F.lit(None).cast("long").alias("group"), F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    result = texts.join(hot, "node").select(*columns).unionByName(texts.join(hot, "node", "left_anti").join(by_node.where(~many).drop("copies"), "node").select(*columns)).unionByName(empty)
    # all links, within components too; nothing runs before they are read
    every = rows.select("text").mapInArrow(_whole(level, t.k), "node long, keys binary").dropDuplicates(["node"])
    guide = guides(verify(pairs, every, t), leaders, first)
    whole = long.join(first.select("node", *PARITIES), "node").join(guide, "node", "left")
    shared = _met(whole, whole, F.col("x.node") < F.col("y.node"), t, guided=True).unionByName(found.where(F.col("kind") == PAIR).select("a", "b", F.col("place").alias("common"), F.col("n").alias("need"), F.lit(False).alias("sure")))
    candidates = shared.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("need").alias("need"), F.max("sure").alias("sure")).where("common >= need")
    derived = candidates.where("sure").select("a", "b")
    return result, verify(candidates.where(~F.col("sure")).select("a", "b"), every, t).where("linked").select("a", "b").unionByName(derived)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, Jaccard 0.8 or more) stays: that of the smallest id, of
    equal ids that of the smallest hash of id and text, of equal texts too that of the smallest hash of all columns. Rows without words are in no group and stay.
    Columns beside those of documents, whatever their names, go along."""
    docs, back = set_aside(docs)
    found, _ = join(docs, Threshold())
    keep = found.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("kept")).select(F.col("kept.row_key").alias("_kept")).distinct()
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    matched = keyed.join(keep, F.col("_key") == F.col("_kept"), "left")
    # rows of one id and text are one document
    first = F.row_number().over(Window.partitionBy("_key").orderBy(whole_row(docs))) == 1
    empty = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return matched.withColumn("_first", first).where(empty | (F.col("_kept").isNotNull() & F.col("_first"))).transform(back)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, _ = join(table(spark, sf_dir, "documents"), Threshold(k=3, num=90, den=100))
    return result.select("doc_id", "n_shingles", "component_id")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, r, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w
), e AS (SELECT r, len(s) AS n, unnest(s) AS t FROM g
), c AS (
  SELECT a.r AS x, b.r AS y, a.n + b.n AS total, count(*) AS both_ FROM e a JOIN e b ON a.t = b.t AND a.r <> b.r AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL
), l AS (SELECT x, y FROM c WHERE 100 * both_ >= 90 * (total - both_)
), reach(x, y) AS (SELECT r, r FROM g UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x
) SELECT a.doc_id, CAST(len(a.s) AS BIGINT) AS n_shingles, min(b.doc_id) AS component_id FROM g a JOIN reach ON a.r = reach.x JOIN g b ON b.r = reach.y GROUP BY a.r, a.doc_id, a.s
"""
