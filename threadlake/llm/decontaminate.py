r"""Benchmark decontamination with one FM-index per shard of training texts.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z. Every run of WINDOW consecutive words of a benchmark
item is a test phrase; an item of fewer words, but not none, is one phrase. A shard is the texts of an Arrow
batch, SHARD words at most, or a part of a longer text, which overlaps the next by WINDOW - 1 words. The index is over all its words,
each distinct word a symbol, with a separator of its own before each document: suffix array by prefix doubling, Burrows-Wheeler
transform, wavelet matrix with bit ranks, and every SAMPLE-th suffix position. All phrases are searched backwards at once,
and the found rows are located by steps back to a sampled position. Occurrences merge into removal spans.

Nothing is shuffled. The benchmark becomes phrases in blocks of at most BLOCK bytes of text, each its own broadcast,
made once; a shard searches one after the other, and a worker holds one, so no broadcast and no task's memory grows with
the benchmark.

Defined results: a null or empty document has no words, no hits and the SHA-256 of the empty string; an item without words
matches nothing; rows of the benchmark with one item_id count as one item, a null item_id is no item; repeated documents
are judged each by itself; texts of any length are searched whole; an empty benchmark leaves everything clean; an empty
table gives an empty result; extra columns are not read by scan_table() and kept by decontaminate().
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Buffer, arrow_rows, map_batches

WINDOW = 8
SAMPLE = 16
BLOCK = 8 << 20
#: Documents of a batch at most, and bytes, but for longer texts.
SHARD_ROWS = 10_000
BATCH = 4 << 20
#: Words of a shard.
SHARD = 1 << 20
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class BitRank:
    """A bit vector with the number of ones before each position."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    """Over symbols 1 and up in runs; 0 separates runs, and the text begins with 0. Separators are ordered by place, so no
    two suffixes are equal."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = self.n = len(text)
        sep = text == 0
        m = int(sep.sum())
        sa = self._suffixes(np.where(sep, np.cumsum(sep) - 1, text.astype(np.int64) + m - 1))
        bwt = text[sa - 1]
        self.first = np.zeros(sigma + 2, np.int64)  # of each symbol, the first suffix that begins with it
        np.cumsum(np.bincount(text, minlength=sigma + 1), out=self.first[1:])
        self.levels: list[tuple[BitRank, int]] = []
        self.depth = max(1, int(sigma).bit_length())
        seq = bwt
        for b in range(self.depth - 1, -1, -1):
            one = (seq >> b) & 1
            self.levels.append((BitRank(one.astype(np.uint8)), int(n - one.sum())))
            seq = np.concatenate([seq[one == 0], seq[one == 1]])
        self.start = self._descend(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))
        kept = (sa % SAMPLE == 0) | (bwt == 0)
        self.sampled = BitRank(kept.astype(np.uint8))
        self.places = sa[kept]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """The suffix array by prefix doubling; each round sorts only suffixes that are still equal to others."""
        n = len(text)
        order = np.argsort(text, kind="stable")
        s = text[order]
        new = np.append(True, s[1:] != s[:-1])
        rank = np.empty(n, np.int64)  # of a group of equal beginnings, how many suffixes are less
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        alone = new & np.append(new[1:], True)
        left, k = order[~alone], 1
        while len(left):
            follow = np.where(left + k < n, rank[np.minimum(left + k, n - 1)] + 1, 0)
            key = rank[left] * (n + 1) + follow
            by = np.argsort(key)
            left, key = left[by], key[by]
            group = key // (n + 1)
            at = np.arange(len(left))
            new = np.append(True, key[1:] != key[:-1])
            first = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), at, 0))
            rank[left] = group + np.maximum.accumulate(np.where(new, at, 0)) - first
            alone = new & np.append(new[1:], True)
            left, k = left[~alone], 2 * k
        out = np.empty(n, np.int64)
        out[rank] = np.arange(n)
        return out

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for (ranks, zeros), b in zip(self.levels, range(self.depth - 1, -1, -1), strict=True):
            ones = ranks.ones(at)
            at = np.where((symbols >> b) & 1, zeros + ones, at - ones)
        return at

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of symbols, the first row of the index that begins with it and the one after the last."""
        q = len(phrases)
        lo, hi = np.zeros(q, np.int64), np.full(q, self.n, np.int64)
        live = np.arange(q)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            both = self._descend(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]])) - np.concatenate([self.start[c]] * 2)
            lo[live], hi[live] = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows."""
        out, steps = np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            known = self.sampled.bit(rows) == 1
            out[left[known]] = self.places[self.sampled.ones(rows[known])] + steps
            left, rows = left[~known], rows[~known]
            at, c = rows, np.zeros(len(rows), np.int64)
            for ranks, zeros in self.levels:
                bit = ranks.bit(at).astype(bool)
                ones = ranks.ones(at)
                at = np.where(bit, zeros + ones, at - ones)
                c = c << 1 | bit
            rows = self.first[c] + at - self.start[c]
            steps += 1
        return out


class Phrases:
    """The test phrases of a block of items, made once and broadcast: arrays only, but for vocabulary and item names."""

    def __init__(self, items: list[tuple[str, str]]):
        vocabulary: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                of.setdefault(tuple(ids[i : i + WINDOW]), set()).add(item)
        self.vocabulary = list(vocabulary)
        self.items = sorted({i for s in of.values() for i in s})
        number = {x: k for k, x in enumerate(self.items)}
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # phrases, and the items of each from place to place
        for n in sorted({len(p) for p in of}):
            own = [p for p in of if len(p) == n]
            named = [sorted(number[x] for x in of[p]) for p in own]
            self.by_length.append((np.array(own, np.int32), np.cumsum([0, *map(len, named)]), np.array([x for v in named for x in v], np.int32)))


def scan(col: pa.Array, blocks: Iterable[Phrases]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Of a shard: the first word of each document with the end (n + 1 numbers), whether a word is hit, the items found."""
    buf = Buffer(col)
    text = buf.data.tobytes().translate(_TABLE)
    o = buf.offsets.tolist()
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = lambda: len(number) + 1
    parts = []
    for a, b in zip(o, o[1:]):
        own = text[a:b].split()
        parts.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
    del text
    first = np.zeros(buf.n + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=first[1:])
    total = int(first[-1])
    hit, found = np.zeros(total + 1, np.int64), [set() for _ in range(buf.n)]
    if not total:
        return first, hit[:-1] > 0, found
    ids = np.zeros(total + buf.n, np.int32)  # a separator before each document, so no occurrence spans two
    for k, p in enumerate(parts):
        ids[first[k] + k + 1 : first[k] + k + 1 + len(p)] = p
    parts.clear()
    starts = first + np.arange(buf.n + 1)
    for lo in range(0, len(ids), SHARD):
        index = FMIndex(np.append(np.zeros(1, np.int32), ids[lo : lo + SHARD + WINDOW - 1]), len(number))
        for ph in blocks:
            known = np.array([number[w] if w in number else 0 for w in ph.vocabulary], np.int64)
            for phrases, begin, items in ph.by_length:
                own = known[phrases]
                may = np.flatnonzero((own > 0).all(1))  # the others have words that the shard lacks
                a, b = index.search(own[may])
                n = b - a
                if not n.any():
                    continue
                which = np.repeat(may, n)
                rows = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                place = index.locate(rows) + lo - 1
                doc = np.searchsorted(starts, place, side="left") - 1
                word = place - doc - 1
                np.add.at(hit, word, 1)
                np.add.at(hit, word + phrases.shape[1], -1)
                for d, p in np.unique(np.stack([doc, which]), axis=1).T.tolist():
                    found[d].update([ph.items[i] for i in items[begin[p] : begin[p + 1]]])
    return first, np.cumsum(hit)[:-1] > 0, found


class Blocks:
    """The benchmark in blocks, each broadcast as its phrases. A worker holds one block at a time."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str):
        context = benchmark.sparkSession.sparkContext
        self.sent, block, size = [], [], 0
        for item, text in benchmark.select(item_col, text_col).toLocalIterator():
            if item is None or not text:
                continue
            if block and size + len(text) > BLOCK:
                self.sent.append(context.broadcast(Phrases(block)))
                block, size = [], 0
            block.append((str(item), text))
            size += len(text)
        if block:
            self.sent.append(context.broadcast(Phrases(block)))

    def __iter__(self) -> Iterator[Phrases]:
        for b in self.sent:
            yield b.value
            if len(self.sent) > 1 and getattr(b, "_path", None) is not None:
                vars(b).pop("_value", None)  # read again from the executor's disk for the next shard


def scan_table(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_items: int = 2) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    blocks = Blocks(benchmark, item_col, item_text_col)
    arrow_rows(docs.sparkSession, SHARD_ROWS, "4m")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        first, hit, found = scan(b.column(1), blocks)
        hits = np.concatenate([[0], np.cumsum(hit)])[first]
        shas = [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in found]
        n = np.array([len(s) for s in found], np.int64)
        cols = [b.column(0), pa.array(np.diff(first)), pa.array(np.diff(hits)), pa.array(n), pa.array(shas, pa.string()), pa.array(n >= min_items)]
        return pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean", BATCH)


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Removal spans in code points: from the first to the last word of each run of hit words."""
    out: list[tuple[int, int]] = []
    for k, m in enumerate(WORD.finditer(text.translate(_UPPER))):
        if hit[k]:
            if k and hit[k - 1]:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    at, out = 0, []
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_items: int = 2, length_col: str | None = None) -> DataFrame:
    """The rows without the contaminated ones, and with the removal spans cut out of the rest; length_col, if any, gets
    the new number of code points of texts that were cut."""
    blocks = Blocks(benchmark, item_col, item_text_col)
    arrow_rows(docs.sparkSession, SHARD_ROWS, "4m")
    names = docs.columns
    at = names.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        first, hit, found = scan(b.column(at), blocks)
        keep = np.array([len(s) < min_items for s in found])
        hits = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
        cols = list(b.columns)
        changed = np.flatnonzero(keep & (hits > 0)).tolist()
        if changed:
            texts = cols[at].to_pylist()
            for k in changed:
                texts[k] = cut(texts[k], spans_of(texts[k], hit[first[k] : first[k + 1]]))
            if length_col:
                n = cols[names.index(length_col)].to_pylist()
                for k in changed:
                    n[k] = len(texts[k])
                cols[names.index(length_col)] = pa.array(n, cols[names.index(length_col)].type)
            cols[at] = pa.array(texts, cols[at].type)
        return pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array(keep))

    return map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), BATCH)
