r"""N-gram Jaccard join: exact links between documents by their sets of word pairs, through prefixes and tries.

A document's set holds its distinct 2-word shingles over the words `[^\x20\x09-\x0D]+`, A-Z lower-cased; a text of one word
has that word as its one shingle. Two documents link when the Jaccard similarity of their sets is at least PERCENT / 100.
Shingles are 64-bit hashes. The plan, in which equal sets are one class throughout:

1. Over all documents: each set's size and 128-bit signature, and a sketch of shingle counts, SKETCH counters whatever the
   input, summed in each task first. The sketch gives all tasks one global order of shingles, rare ones first.
2. Each class sends the prefix of its set to buckets of shingles. Linked sets share at least SHARED shingles of their
   prefixes (or as many as the smaller one needs), whatever the order. A shingle that the sketch counts more often than HOT
   is split into cells for pairs of parts, so no cell holds more than about twice HOT. Classes with a common key out of
   SKETCHES, each made of two least hashes of the prefix, meet in that key's cell without a row for each pair; that covers
   nearly all pairs of a group of copies. Only the other pairs that share a shingle of a bucket, and whose sizes allow a link, are
   counted; counts add up over buckets; pairs with too few are dropped.
3. The pairs left are grouped by the least neighbour of the first class; large groups, and large cells, are split into cells
   for pairs of parts of CELL classes. Sets are fetched for classes that pass a Bloom filter of fixed size. In each cell the
   sets go, in the global order, into a path-compressed trie of the shingles that occur twice in the cell; one traversal
   carries the overlaps of all sets with the path so far and drops those that the remaining lengths cannot bring to a link.
   Each pair belongs to one cell, that of its first common key if it has one, so links are counted once. Cells return a
   number of links for each class and a tree over linked ones, never pairs.
4. Alternating large-star and small-star steps over these trees give components.

Nothing unbounded is broadcast or collected: the sketch and the filter have fixed sizes. Tables are written to the shared
folder between the steps.

Defined results: null and empty texts, and such of white space only, have the empty set, no links, and are their own
component; texts of any length count whole; repeated rows link with each other as documents with equal sets do; ties
cannot occur, for components are named by the smallest id; an empty table gives an empty result; extra columns are ignored
by links() and kept by one_of_each().
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Buffer, arrow_rows, give_back, join_unique, map_batches, materialize, mix64, piece_hashes

PERCENT = 60
SKETCH = 1 << 22
SHARED = 6
HOT = 2000
CELL = 1000
FILTER = 1 << 23
#: Prefix shingles in a bucket, about.
BUCKET = 5_000_000
#: Prefix shingles of a bucket expanded at once; a bucket's bytes stay packed but for these.
PART = 500_000
#: Keys of a prefix, each of two least hashes.
SKETCHES = 4
#: Shingles of a part of a group of candidates, and of a verification task, about.
CELL_SHINGLES = 600_000
TASK = 1_000_000
#: Pairs expanded at once.
CHUNK = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEEDS = mix64(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64))
_K1, _K2, _ONE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0x8EBC6AF09C88C6E3)


def shingle_sets(col: pa.Array) -> list[np.ndarray]:
    """The sorted set of each text."""
    buf = Buffer(col)
    n, data = buf.n, _LOWER[buf.data]
    if not len(data):
        return [np.zeros(0, np.uint64)] * n
    word = ~_SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = word[1:] != word[:-1]
    edge[buf.offsets] = True
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    keep = word[begin]
    begin, end = begin[keep], end[keep]
    h = piece_hashes(data, begin, end)
    first = np.searchsorted(begin, buf.offsets)  # the first word of each text
    pair = mix64(h[:-1] * _K1 + (h[1:] ^ _K2)) if len(h) > 1 else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a > 1:
            out.append(np.unique(pair[a : b - 1]))
        else:
            out.append(mix64(h[a:b] ^ _ONE))
    return out


def signature(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes()).digest()


def class_id(sig: bytes, met: frozenset[int] = frozenset()) -> int:
    """A name of 64 bits: the first half of the signature, or the second for those of a first half that two signatures share."""
    first = int.from_bytes(sig[:8], "little", signed=True)
    return int.from_bytes(sig[8:], "little", signed=True) if first in met else first


def needed(n: np.ndarray | int):
    """The least overlap of a set of n with any set it links with."""
    return -(-PERCENT * n // 100)


def prefix_length(n: int) -> int:
    least = needed(n)
    return n - least + min(SHARED, least)


def near_length(n: int) -> int:
    """How much of the prefix any set that is no smaller can ask for: the overlap is then at least 2 * PERCENT / (100 + PERCENT)
    of the smaller set."""
    least = -(-2 * PERCENT * n // (100 + PERCENT))
    return n - least + min(SHARED, needed(n))


def _first_pass(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, n, sig) of documents, and rows (block, counts) of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = None
        names = ["id", "n", "sig", "cid", "block", "counts"]
        for b in batches:
            if not b.num_rows:
                continue
            sets = shingle_sets(b.column(1))
            sigs = list(map(signature, sets))
            own = {g: s for g, s in zip(sigs, sets) if len(s)}
            if own:
                if sketch is None:
                    sketch = np.zeros(SKETCH, np.int32)
                slots, k = np.unique(np.concatenate(list(own.values())) & np.uint64(SKETCH - 1), return_counts=True)
                sketch[slots.astype(np.int64)] += k.astype(np.int32)
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array(list(map(class_id, sigs)), pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if sketch is not None:
            parts = [_packed(sketch[i : i + SKETCH // 64]) for i in range(0, SKETCH, SKETCH // 64)]
            yield pa.RecordBatch.from_arrays([pa.nulls(64, id_type), pa.nulls(64, pa.int64()), pa.nulls(64, pa.binary()), pa.nulls(64, pa.int64()), pa.array(range(64), pa.int32()), pa.array(parts, pa.binary())], names=names)
        give_back()

    field = docs.schema[id_col].dataType
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[field.simpleString()]
    rows = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {field.simpleString()}, n bigint, sig binary, cid bigint, block int, counts binary")
    return materialize(rows, "ngram-sets")


def _packed(counts: np.ndarray) -> bytes:
    """Counters in a byte each, those of 255 and up again behind."""
    big = np.flatnonzero(counts >= 255)
    return len(big).to_bytes(4, "little") + big.astype("<u4").tobytes() + counts[big].astype("<i8").tobytes() + zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    k = int.from_bytes(data[:4], "little")
    out = np.frombuffer(zlib.decompress(data[4 + 12 * k :]), np.uint8).astype(np.int64)
    out[np.frombuffer(data, "<u4", k, 4)] = np.frombuffer(data, "<i8", k, 4 + 4 * k)
    return out


def _sketch(first: DataFrame) -> np.ndarray:
    """The sketch of all documents."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH // 64, np.int64)
        for c in group.column("counts"):
            total += _unpacked(c.as_py())
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "counts": pa.array([_packed(np.minimum(total, 2**31 - 1))], pa.binary())})

    out = np.zeros(SKETCH, np.int32)
    for r in first.filter("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[r["block"] * (SKETCH // 64) : (r["block"] + 1) * (SKETCH // 64)] = _unpacked(r["counts"])
    return out


def ordered(s: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set in the global order, and the counts."""
    c = sketch[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
    o = np.argsort(c, kind="stable")  # the set is sorted, so equal counts are in order of the hash
    return s[o], c[o]


def _postings(docs: DataFrame, text_col: str, sketch, buckets: int, met: frozenset[int]) -> DataFrame:
    """Rows (bucket, data): per batch and bucket, classes with their prefix shingles in that bucket."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        counts = sketch.value
        own: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]] = {}
        for s in shingle_sets(b.column(0)):
            if len(s) and (cid := class_id(signature(s), met)) not in own:
                t, c = ordered(s, counts)
                k = prefix_length(len(s))
                own[cid] = (len(s), t[:k], c[:k], least_hashes(t[:k]))
        if not own:
            return None
        cids = np.array(list(own), np.int64)
        sizes = np.array([v[0] for v in own.values()], np.int64)
        hashes = np.stack([v[3] for v in own.values()])
        token = np.concatenate([v[1] for v in own.values()])
        count = np.concatenate([v[2] for v in own.values()])
        length = np.array([len(v[1]) for v in own.values()])
        doc = np.repeat(np.arange(len(cids)), length)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length)
        side = np.where(place < np.repeat([near_length(n) for n in sizes.tolist()], length), 0, 4).astype(np.uint64)
        hot = np.flatnonzero(count > HOT)
        if len(hot):
            token, doc, side = _split(token, count, doc, side, hot, cids)
        mixed = mix64(token ^ _K2)
        bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        homes = np.full(len(cids), buckets, np.int64)  # the bucket that reports the class
        np.minimum.at(homes, doc, bucket)
        value = (mix64(token) >> np.uint64(27)) << np.uint64(3) | side  # 37 bits of the shingle, whether it is far, then the side
        order = np.lexsort((doc, bucket))
        bucket, value, doc = bucket[order], value[order], doc[order]
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        names, blobs = bucket[edge].tolist(), []
        for i, j in zip(edge.tolist(), np.append(edge[1:], len(bucket)).tolist()):
            of = doc[i:j]
            new = np.append(True, of[1:] != of[:-1])
            who = of[new]
            v = value[i:j]
            n = np.diff(np.append(np.flatnonzero(new), j - i))
            at_home = homes[who] == bucket[i]
            blobs.append(b"".join([np.array([len(who), j - i], "<u4").tobytes(), cids[who].astype("<i8").tobytes(), (sizes[who] * 2 + at_home).astype("<u4").tobytes(), n.astype("<u4").tobytes(), hashes[who].tobytes(), (v & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (v >> np.uint64(32)).astype(np.uint8).tobytes()]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "data"])

    return map_batches(docs.select(text_col), run, "bucket int, data binary")


def least_hashes(prefix: np.ndarray) -> np.ndarray:
    """SKETCHES keys of 32 bits, each made of the least hashes by two functions."""
    least = mix64(prefix[None, :] ^ _SEEDS[:, None]).min(1)
    return (mix64(least[::2] ^ mix64(least[1::2] ^ _K1)) >> np.uint64(32)).astype("<u4")


def _split(token, count, doc, side, hot, cids):
    """Hot shingles as one for each cell of two parts; side 1 and 2 are the parts of a cell, 0 a cell of one part."""
    keep = np.ones(len(token), bool)
    keep[hot] = False
    tokens, docs, sides = [token[keep]], [doc[keep]], [side[keep]]
    for i in hot.tolist():
        parts = -(-int(count[i]) // HOT)
        p = int(mix64(np.array([int(cids[doc[i]]) & (2**64 - 1)], np.uint64) ^ token[i])[0] % np.uint64(parts))
        j = np.arange(parts)
        lo, hi = np.minimum(p, j).astype(np.uint64), np.maximum(p, j).astype(np.uint64)
        tokens.append(mix64(token[i] + (lo * np.uint64(parts) + hi + np.uint64(1)) * _K1))
        docs.append(np.full(parts, doc[i]))
        sides.append(np.where(j == p, 0, np.where(j > p, 1, 2)).astype(np.uint64) | side[i])
    return np.concatenate(tokens), np.concatenate(docs), np.concatenate(sides)


def _merge(found: list[tuple[np.ndarray, np.ndarray]], out_key: list[np.ndarray], out_c: list[np.ndarray]) -> None:
    """Appends the distinct keys found and the sums of their counts."""
    if found:
        key, of = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        out_key.append(key)
        out_c.append(np.bincount(of, np.concatenate([c for _, c in found]), len(key)).astype(np.int64))


def _pairs_in_part(blobs, part: int, parts: int, once: np.ndarray, number: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes (a * classes + b, a < b) and how often they meet in those shingles of a bucket that are of the part."""
    which, value = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)]
    for base, n, low, high in blobs:
        own = np.flatnonzero((low >> np.uint32(3)) % np.uint32(parts) == part)
        of = np.repeat(np.arange(base, base + len(n), dtype=np.uint32), n)[own]
        own, of = own[once[of]], of[once[of]]
        which.append(of)
        value.append(low[own].astype(np.uint64) | high[own].astype(np.uint64) << np.uint64(32))
    which, v = np.concatenate(which), np.concatenate(value)
    del value
    order = np.argsort(v >> np.uint64(3))
    v = v[order]
    token = v >> np.uint64(3)
    same = np.zeros(len(v), bool)
    same[1:] = token[1:] == token[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    v, token = v[twice], token[twice]
    local = number[which[order[twice]]]
    size = sizes[local]
    side, far = (v & np.uint64(3)).astype(np.int8), (v & np.uint64(4)) > 0
    run = np.cumsum(np.append(0, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    order = np.lexsort((local, size, run))
    run, size, local, side, far = run[order], size[order], local[order], side[order], far[order]
    wide = np.int64(int(size.max()) * 2 + 2) if len(size) else np.int64(1)
    last = np.searchsorted(run * wide + size, run * wide + np.minimum(size * 100 // PERCENT, wide - 1), side="right")
    n = np.where(far, 0, np.maximum(last - np.arange(len(run)) - 1, 0))  # the smaller set's shingle must be near
    total = np.cumsum(n)
    i = 0
    while i < len(run):
        stop = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + CHUNK, side="right")))
        k = n[i:stop]
        x = np.repeat(np.arange(i, stop), k)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
        ok = ((side[x] == 0) | (side[x] != side[y])) & ~(far[y] & (size[x] == size[y])) & (local[x] != local[y])
        p, q = local[x[ok]], local[y[ok]]
        apart = np.ones(len(p), bool)
        for j in range(SKETCHES):
            apart &= hashes[p, j] != hashes[q, j]
        p, q = p[apart], q[apart]
        yield np.unique(np.minimum(p, q) * len(sizes) + np.maximum(p, q), return_counts=True)
        i = stop


def _pairs_in_bucket(group: pa.Table) -> pa.Table:
    """Rows (a, hashes) of the classes at home in the bucket, and pairs of classes (a < b) without a common key, with
    how many prefix shingles of the bucket they share and how many they need in all."""
    blobs, every, sizes_of, home, least, base = [], [], [], [], [], 0
    for blob in group.column("data"):
        raw = blob.as_buffer()
        k, m = np.frombuffer(raw, "<u4", 2).tolist()
        wide = np.frombuffer(raw, "<u4", k, 8 + 8 * k)
        every.append(np.frombuffer(raw, "<i8", k, 8))
        sizes_of.append(wide // 2)
        home.append(wide % 2 == 1)
        least.append(np.frombuffer(raw, "<u4", k * SKETCHES, 8 + 16 * k).reshape(k, SKETCHES))
        at = 8 + (16 + 4 * SKETCHES) * k
        blobs.append((base, np.frombuffer(raw, "<u4", k, 8 + 12 * k), np.frombuffer(raw, "<u4", m, at), np.frombuffer(raw, np.uint8, m, at + 4 * m)))
        base += k
    raw_ids, raw_sizes = np.concatenate(every), np.concatenate(sizes_of).astype(np.int64)
    every, where, number = np.unique(raw_ids, return_index=True, return_inverse=True)
    home, hashes, sizes = np.concatenate(home)[where], np.concatenate(least)[where], raw_sizes[where]
    once = np.zeros(len(raw_ids), bool)  # all batches send the same of a class
    once[where] = True
    parts = max(1, -(-sum(len(low) for _, _, low, _ in blobs) // PART))
    found, held, out_key, out_c = [], 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in range(parts):
        for key, c in _pairs_in_part(blobs, part, parts, once, number, sizes, hashes):
            found.append((key, c))
            held += len(key)
            if held > CHUNK:
                _merge(found, out_key, out_c)
                found, held = [], 0
    _merge(found, out_key, out_c)
    key, c = np.concatenate(out_key), np.concatenate(out_c)
    a, b = key // max(1, len(every)), key % max(1, len(every))
    need = np.minimum(SHARED, needed(np.minimum(sizes[a], sizes[b])))
    at_home = np.flatnonzero(home)
    m = len(at_home)
    none = pa.nulls(m, pa.int64())
    cols = [
        pa.concat_arrays([pa.array(every[at_home], pa.int64()), pa.array(every[a], pa.int64())]),
        *(pa.concat_arrays([none, pa.array(v, pa.int64())]) for v in (every[b], c, need)),
        pa.concat_arrays([pa.array(hashes[at_home].tolist(), pa.list_(pa.int64())), pa.nulls(len(a), pa.list_(pa.int64()))]),
    ]
    return pa.Table.from_arrays(cols, names=["a", "b", "c", "need", "hashes"])


def _candidate_sets(docs: DataFrame, text_col: str, nodes: DataFrame, met: frozenset[int]) -> DataFrame:
    """Rows (cid, set) for at least all classes in nodes."""
    slot = F.pmod(F.col("cid"), F.lit(FILTER)) + 1
    bits = nodes.select(F.bitmap_bucket_number(slot).alias("k"), F.bitmap_bit_position(slot).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m"))
    filled = np.zeros(FILTER // 8, np.uint8)
    for r in bits.collect():  # at most FILTER / 32768 rows
        filled[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        own = {}
        for s in shingle_sets(b.column(0)):
            if len(s) and (cid := class_id(signature(s), met)) not in own:
                at = cid % FILTER
                if sent.value[at >> 3] >> (at & 7) & 1:
                    own[cid] = s.tobytes()
        return pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.binary())], names=["cid", "set"])

    return map_batches(docs.select(text_col), run, "cid bigint, set binary").dropDuplicates(["cid"])


def _freed(result: pa.Table) -> pa.Table:
    """The result of a call, whose own memory goes back to the system."""
    give_back()
    return result


class Trie:
    """A path-compressed trie of sorted sequences: for each node its label, children, sequences that end, least size and
    most items below."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sequences)), key=lambda i: sequences[i].tolist())
        self.sequences, self.sizes = sequences, sizes
        self.root = self._node(order, 0)
        found, todo = {0}, [(self.root, 0)]
        while todo:  # from: the least item that can follow a node
            node, start = todo.pop()
            node["from"] = int(node["label"][-1]) + 1 if len(node["label"]) else start
            found.add(node["from"])
            todo += [(c, node["from"]) for c in node["children"]]
        self.ends = sorted(found)

    def _node(self, order: list[int], depth: int):
        todo = [(order, depth, None)]
        root = None
        while todo:
            own, depth, parent = todo.pop()
            a, b = self.sequences[own[0]], self.sequences[own[-1]]
            k = min(len(a), len(b)) - depth
            differ = np.flatnonzero(a[depth : depth + k] != b[depth : depth + k]) if k > 0 else np.zeros(0, np.int64)
            end = depth + (int(differ[0]) if len(differ) else max(k, 0))
            node = {"label": a[depth:end], "children": [], "ends": [i for i in own if len(self.sequences[i]) == end], "least": min(int(self.sizes[i]) for i in own), "below": max(len(self.sequences[i]) for i in own) - end}
            if parent is None:
                root = node
            else:
                parent["children"].append(node)
            rest = [i for i in own if len(self.sequences[i]) > end]
            i = 0
            while i < len(rest):
                j = i
                while j < len(rest) and self.sequences[rest[j]][end] == self.sequences[rest[i]][end]:
                    j += 1
                todo.append((rest[i:j], end, node))
                i = j
        return root


def link_cell(sets: list[np.ndarray], sketch: np.ndarray, allowed: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Of each set, those it links with among allowed (a symmetric matrix), by one traversal of a trie of all sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    token, back, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    count = sketch[(token & np.uint64(SKETCH - 1)).astype(np.int64)]
    order = np.lexsort((token, count))
    order = order[df[order] > 1]  # the others are in no overlap
    column = np.full(len(token), -1, np.int64)
    column[order] = np.arange(len(order))
    own = column[back]
    of = np.repeat(np.arange(len(sets)), sizes)
    sequences = [np.sort(p[p >= 0]) for p in np.split(own, np.cumsum(sizes)[:-1])]
    shared = own >= 0
    by_column = np.argsort(own[shared], kind="stable")
    holders = of[shared][by_column]  # of column after column
    begin = np.append(0, np.cumsum(df[order]))
    g = len(sets)
    trie = Trie(sequences, sizes)
    ends = {e: k for k, e in enumerate(trie.ends)}
    at = np.array(trie.ends, np.int64)
    left = np.stack([len(s) - np.searchsorted(s, at) for s in sequences]).astype(np.int32)  # items from the end of a node on
    out: list[tuple[int, np.ndarray]] = []
    stack = [(trie.root, np.arange(g), np.zeros(g, np.int64))]
    while stack:
        node, who, overlap = stack.pop()
        lab = node["label"]
        if len(lab):
            n = begin[lab + 1] - begin[lab]
            places = np.repeat(begin[lab] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            overlap = overlap + np.bincount(holders[places], minlength=g)[who]
        after = left[who, ends[node["from"]]]
        least = -(-PERCENT * (sizes[who] + node["least"]) // (100 + PERCENT))
        live = overlap + np.minimum(after, node["below"]) >= least
        who, overlap = who[live], overlap[live]
        if not len(who):
            continue
        for i in node["ends"]:
            found = who[((100 + PERCENT) * overlap >= PERCENT * (sizes[who] + sizes[i])) & allowed[i, who]]
            if len(found):
                out.append((i, found))
        stack += [(c, who, overlap) for c in node["children"]]
    return out


def _verify(sketch):
    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        cell_of, cids, copies = sets.column("cell").to_numpy(), sets.column("cid").to_numpy(), sets.column("copies").to_numpy()
        data, hashes = sets.column("set").to_pylist(), np.array(sets.column("hashes").to_pylist(), np.int64).reshape(-1, SKETCHES)
        kind, part = sets.column("k").to_numpy(), sets.column("part").to_numpy()
        order = np.argsort(cell_of, kind="stable")
        first = np.flatnonzero(np.append(True, cell_of[order][1:] != cell_of[order][:-1])) if len(order) else []
        last = np.append(first[1:], len(order)) if len(order) else []
        p_cell, p_a, p_b = (pairs.column(k).to_numpy() for k in ("at", "x", "y"))
        p_order = np.argsort(p_cell, kind="stable")
        p_cell, p_a, p_b = p_cell[p_order], p_a[p_order], p_b[p_order]
        out_cid, out_n, out_root = [], [], []
        for i, j in zip(first, last):
            own = order[i:j]
            own = own[np.argsort(cids[own], kind="stable")]
            k = int(kind[own[0]])
            if k < 0:
                lo, hi = np.searchsorted(p_cell, cell_of[own[0]], "left"), np.searchsorted(p_cell, cell_of[own[0]], "right")
                a, b = np.searchsorted(cids[own], p_a[lo:hi]), np.searchsorted(cids[own], p_b[lo:hi])
                allowed = np.zeros((len(own), len(own)), bool)
                allowed[a, b] = allowed[b, a] = True
            else:  # the first common key of a pair is the cell's
                h, side = hashes[own], part[own]
                allowed = (h[:, None, k] == h[None, :, k]) & ((side[:, None] < 0) | (side[:, None] != side[None, :]))
                for e in range(k):
                    allowed &= h[:, None, e] != h[None, :, e]
                np.fill_diagonal(allowed, False)
            mult = copies[own]
            root = np.arange(len(own))

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            links = np.zeros(len(own), np.int64)
            for x, found in link_cell([np.frombuffer(data[k], np.uint64) for k in own], sketch.value, allowed):
                links[x] += mult[found].sum()
                r = find(x)
                for y in found.tolist():
                    s = find(y)
                    if r != s:
                        root[max(r, s)] = r = min(r, s)
            for x in np.flatnonzero(links).tolist():
                out_cid.append(cids[own[x]])
                out_n.append(links[x])
                out_root.append(cids[own[find(x)]])
        return pa.table({"cid": pa.array(out_cid, pa.int64()), "links": pa.array(out_n, pa.int64()), "root": pa.array(out_root, pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(u, root): for every u that isn't the least of its component. edges: (u, v), v < u."""
    edges = materialize(edges.filter("u > v").distinct(), "ngram-edges")
    while True:
        children = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        parents = edges.select(F.col("v").alias("u")).distinct()
        if not children.filter("n > 1").head(1) and not children.join(parents, "u", "left_semi").head(1):
            return edges.select("u", F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = materialize(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "ngram-large")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        edges = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = materialize(edges.filter("u > v").distinct(), "ngram-small")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, n_similar, component_id."""
    spark = docs.sparkSession
    arrow_rows(spark)
    first = _first_pass(docs, id_col, text_col)
    rows = first.filter("block IS NULL").select("id", "n", "sig", "cid")
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("cid").alias("cid"), F.min("n").alias("n"))
    total, shingles = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()
    sketch = spark.sparkContext.broadcast(_sketch(first))
    buckets = max(1, math.ceil(shingles * (100 - PERCENT) / 100 / BUCKET))
    # of distinct sets about n * n / 2 ** 65 pairs share half a signature: some tens in 3e10
    met = frozenset(r["cid"] for r in classes.groupBy("cid").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("cid").collect())
    if met:
        named = F.udf(lambda sig: class_id(bytes(sig), met), "bigint")
        classes = classes.withColumn("cid", named("sig"))

    schema = "a bigint, b bigint, c bigint, need bigint, hashes array<bigint>"
    found = _postings(docs, text_col, sketch, buckets, met).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _freed(_pairs_in_bucket(t)), schema)
    found = materialize(found, "ngram-candidates")
    pairs = found.filter("b IS NOT NULL").groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need")).filter("c >= need").select("a", "b")
    pairs = materialize(pairs, "ngram-pairs")
    about = classes.select("cid", "copies", "least", "sig", "n").join(found.filter("b IS NULL").select(F.col("a").alias("cid"), "hashes"), "cid")
    about = materialize(about, "ngram-about")

    # cells of classes with a common key
    each = about.select("cid", "n", "hashes", F.posexplode("hashes").alias("k", "h")).withColumn("key", F.col("k") * F.lit(1 << 32) + F.col("h"))
    same = [F.max(F.col("hashes")[j]) == F.min(F.col("hashes")[j]) for j in range(SKETCHES)]
    redundant = F.lit(False)
    for j in range(SKETCHES):  # all agree in an earlier key
        redundant = redundant | ((F.max("k") > j) & same[j])
    groups = each.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("shingles"), redundant.alias("redundant")).filter("classes > 1 AND NOT redundant")
    groups = groups.select("key", "classes", F.greatest(F.ceil(F.col("classes") / CELL), F.ceil(F.col("shingles") / CELL_SHINGLES)).alias("parts"))
    own = join_unique(each.select("key", "cid", "k"), groups, "key", "classes", total * SKETCHES).withColumn("p", F.pmod(F.xxhash64("cid"), "parts"))
    own = own.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    side = F.when(F.col("p") == F.col("j"), -1).when(F.col("p") < F.col("j"), 0).otherwise(1)
    alike = own.select(F.xxhash64("key", F.least("p", "j"), F.greatest("p", "j")).alias("cell"), "cid", "k", side.alias("part"))

    # cells of the other pairs
    ends = pairs.select(F.col("a").alias("cid"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("cid"), F.col("a").alias("other")))
    home = ends.groupBy("cid").agg(F.min("other").alias("m")).select(F.col("cid").alias("a"), F.least("cid", "m").alias("home"))
    homed = pairs.join(home, "a")
    size = about.select(F.col("cid").alias("a"), "n")
    per_home = homed.select("home", "a").unionByName(homed.select("home", F.col("b").alias("a"))).distinct().join(size, "a").groupBy("home").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("classes") / CELL), F.ceil(F.col("shingles") / CELL_SHINGLES))
    x, y = F.pmod(F.xxhash64("a"), parts), F.pmod(F.xxhash64("b"), parts)
    celled = homed.join(per_home, "home").select("a", "b", F.xxhash64("home", F.least(x, y), F.greatest(x, y)).alias("cell"))
    celled = materialize(celled, "ngram-cells")
    listed = celled.select("cell", F.col("a").alias("cid")).unionByName(celled.select("cell", F.col("b").alias("cid"))).distinct().withColumns({"k": F.lit(-1), "part": F.lit(-1)})

    members = materialize(alike.unionByName(listed).join(about.select("cid", "copies", "n", "hashes"), "cid"), "ngram-members")
    nodes = members.select("cid").distinct()
    sets = _candidate_sets(docs, text_col, nodes, met)
    held = members.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    tasks = max(1, math.ceil(held / TASK))
    members = members.join(sets, "cid").withColumn("task", F.pmod("cell", F.lit(tasks)))
    other = celled.select(F.col("cell").alias("at"), F.col("a").alias("x"), F.col("b").alias("y"), F.pmod("cell", F.lit(tasks)).alias("job"))
    verify = _verify(sketch)
    done = members.groupBy("task").cogroup(other.groupBy("job")).applyInArrow(lambda s, p: _freed(verify(s, p)), "cid bigint, links bigint, root bigint")
    done = materialize(done, "ngram-links")

    degree = done.groupBy("cid").agg(F.sum("links").alias("links"))
    trees = components(done.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    named = about.select("cid", "copies", "least", "sig").join(degree, "cid", "left").join(trees.withColumnRenamed("u", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.filter("links IS NOT NULL").groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root", "left")
    named = materialize(named.select("sig", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "least").alias("component")), "ngram-classes")
    out = join_unique(rows.filter("n > 0").select("id", "n", "sig"), named, "sig", "copies", total)
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), (F.col("copies") - 1 + F.col("links")).alias("n_similar"), F.col("component").alias("component_id"))
    empty = rows.filter("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.lit(0).cast("bigint").alias("n_similar"), F.col("id").alias("component_id"))
    return out.unionByName(empty)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id names their component: one document of each group of near copies, and all without any."""
    keep = links(docs, id_col, text_col).filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_keep")).distinct()
    return docs.join(keep.hint("shuffle_hash"), docs[id_col] == keep["_keep"], "left_semi")
