r"""Substring deduplication over sliding spans of sentences.

A sentence ends with a word ending in . ! or ?, before a line feed, at the end of the text, and after LONG words. A span is
a run of at least SENTENCES consecutive sentences with at least WORDS words; of each start the shortest such run is taken,
and of each end the shortest. All spans of all documents are hashed (96 bits over lower-cased words) and joined globally:
every occurrence but the first, by document id and place, marks its sentences for removal.

A passage that begins and ends inside sentences need not hold whole ones, so every text is also cut, whatever its sentences,
where the hash of a word and the next is the least (the last of equals) of some PIECE in a row: pieces have at most PIECE
words. From each cut the shortest run of at least two pieces with at least WORDS words is a span too, joined likewise; its
words go. Any run of over 50 words that two texts share has the same cuts but for its first and last PIECE words, at least
27 words apart, so it holds at least one equal span. In a text that repeats itself closely the first place stays whole.

Within an Arrow batch occurrences after the batch's first are marked at once, so a span that a third of all documents
share reaches the shuffle once a batch. The others go, packed by batch, to buckets of hashes, where one sort finds those
that aren't the first. Only marks are joined to documents.

Defined results: null and empty texts have no sentences; a text of one sentence only has no spans; texts of any length are
read whole, their words in steps, so memory is the text and nine bytes a word; a passage repeated inside one document is
removed but for its first place; ids of any type are put in their order, null first, and are one document each however
many rows they have: rows repeated whole count once and are cut alike; an empty table gives an empty result; extra columns
are ignored by removals() and kept by dedup(), whatever their names. With least=1 every run of SENTENCES sentences counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Buffer, arrow_rows, give_back, map_batches, materialize, mix64, piece_hashes, pieces

SENTENCES = 2
WORDS = 16
LONG = 24
#: Most words of a piece; a run of 2 * PIECE + WORDS + PIECE - 1 = 51 words holds a span of pieces.
PIECE = 12
#: Places from here on are numbers of words, below of sentences.
AT_WORD = 1 << 31
#: Spans in a bucket, about.
BUCKET = 1_000_000
#: Bytes of documents whose spans are held at once, but for longer texts.
BATCH = 9 << 20
#: Slots that tell which documents may lose words.
SLOTS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


#: Bytes, and words, looked at in one step; only texts and their words are held whole.
SLICE = 1 << 20
STEP = 1 << 18
#: Spans in a row for the join.
ROW = 400_000
_NEXT = re.compile(rb"[\x09-\x0d ](?=[^\x09-\x0d ])")


def _slices(buf: Buffer) -> Iterator[tuple[int, int]]:
    """Consecutive parts of the bytes; each but the first begins a word."""
    at, size = 0, len(buf.data)
    while at < size:
        end = size
        if size - at > SLICE and (m := _NEXT.search(buf.data, at + SLICE)):
            end = m.end()
        yield at, end
        at = end


class Words:
    """The words of a batch: where each begins, the hash of each, the first word of each document, and first word and word
    after the last of each sentence with its document."""

    def __init__(self, buf: Buffer, hashes: bool, places: bool):
        begins, hashed, ends, n = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        self.first = np.zeros(buf.n + 1, np.int64)
        edges = np.unique(buf.offsets)
        for lo, hi in _slices(buf):
            data = buf.data[lo:hi]
            inside = edges[np.searchsorted(edges, lo, side="right") : np.searchsorted(edges, hi)] - lo
            word = ~_SPACE[data]
            edge = np.empty(len(data) + 1, bool)
            edge[0] = edge[-1] = True
            edge[1:-1] = word[1:] != word[:-1]
            edge[inside] = True
            at = np.flatnonzero(edge)
            keep = word[at[:-1]]
            begin, end = at[:-1][keep], at[1:][keep]
            # documents that begin in this part
            own = slice(*np.searchsorted(buf.offsets, (lo, hi)))
            self.first[own] = n + np.searchsorted(begin, buf.offsets[own] - lo)
            if not len(begin):
                continue
            after = np.append(begin[1:], len(data))  # where the next word, or part, begins
            feeds = np.flatnonzero(data == 10)
            last = _END[data[end - 1]] | (np.searchsorted(feeds, after) > np.searchsorted(feeds, end))
            stops = np.append(inside, len(data)) if np.isin(hi, edges) else inside
            last |= np.searchsorted(stops, after, side="right") > np.searchsorted(stops, end)
            ends.append(n + np.flatnonzero(last) + 1)
            if places:
                begins.append(begin + lo)
            if hashes:
                hashed.append(piece_hashes(_LOWER[data], begin, end))
            n += len(begin)
        self.first[buf.offsets >= len(buf.data)] = n
        self.begin, self.hash, self.n = np.concatenate(begins), np.concatenate(hashed), n
        end = np.concatenate(ends)
        start = np.append(0, end)[: len(end)]
        parts = -(-(end - start) // LONG)
        self.start = np.repeat(start, parts) + LONG * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
        self.stop = np.append(self.start[1:], n)[: len(self.start)]
        self.doc = self.document(self.start)

    def document(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, side="right") - 1


def spans(of: np.ndarray, start: np.ndarray, stop: np.ndarray, least: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of each span; of is the document of each sentence."""
    m = len(start)
    if m < SENTENCES:
        z = np.zeros(0, np.int64)
        return z, z
    i = np.arange(m)
    forward = np.maximum(np.searchsorted(stop, start + least), i + SENTENCES - 1)  # the last sentence
    ok = forward < m
    ok[ok] &= of[forward[ok]] == of[ok]
    backward = np.minimum(np.searchsorted(start, stop - least, side="right") - 1, i - SENTENCES + 1)  # the first
    good = backward >= 0
    good[good] &= of[backward[good]] == of[good]
    key = np.unique(np.concatenate([i[ok] * m + forward[ok], backward[good] * m + i[good]]))
    return key // m, key % m


def piece_spans(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and word after the last of each span of pieces; words are hashes, first is the first word of each document."""
    n = len(words)
    cut = np.zeros(n + 1, bool)
    cut[first] = True
    cut = cut[:-1]
    near = np.zeros(n + 1, np.int8)  # 1 where another document begins
    near[first] = 1
    for lo in range(0, n - PIECE, STEP):  # windows of PIECE words and the next
        m = min(STEP, n - PIECE - lo)
        own = words[lo : lo + m + PIECE]
        key = mix64(own[:-1] * np.uint64(_BASES[0]) + own[1:])
        best, at = key[:m].copy(), np.zeros(m, np.int32)
        for k in range(1, PIECE):
            less = key[k : k + m] <= best
            best[less] = key[k : k + m][less]
            at[less] = k
        total = np.append(0, np.cumsum(near[lo + 1 : lo + m + PIECE], dtype=np.int32))
        inside = np.flatnonzero(total[PIECE : PIECE + m] == total[:m])
        cut[lo + inside + at[inside]] = True
    start = np.flatnonzero(cut)
    stop = np.append(start[1:], n)
    if len(start) < 2:
        return start[:0], start[:0]
    doc = np.searchsorted(first, start, side="right")
    i = np.arange(len(start))
    last = np.maximum(np.searchsorted(stop, start + WORDS), i + 1)
    ok = last < len(start)
    ok[ok] &= doc[last[ok]] == doc[ok]
    return start[ok], stop[last[ok]]


@lru_cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    np.cumprod(np.full(n, base, np.uint64), out=out[1:])
    return out


def span_hashes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the words from a up to b; a ascends."""
    out = [np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)]
    wide = int((b - a).max()) if len(a) else 0
    for lo in range(0, len(words), STEP):
        i, j = np.searchsorted(a, (lo, lo + STEP))
        if i == j:
            continue
        own = words[lo : lo + STEP + wide]
        x, y = a[i:j] - lo, b[i:j] - lo
        for k, base in enumerate(_BASES):
            total = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(mix64(own + np.uint64(k)) * _powers(base, STEP + 64 * (1 + wide // 64))[: len(own)], out=total[1:])
            inverse = _powers(pow(base, -1, 1 << 64), STEP)
            out[k][i:j] = mix64((total[y] - total[x]) * inverse[x] + (y - x).astype(np.uint64))
    return out[0], out[1]


def _after(s: np.ndarray, e: np.ndarray, same: np.ndarray, s0: np.ndarray, e0: np.ndarray) -> np.ndarray:
    """Where removal begins: a span of pieces that overlaps its first place, in the same document, loses only what is beyond."""
    return np.where(same & (s >= AT_WORD) & (s > s0) & (s <= e0), e0 + 1, s)


def _marks(docs: DataFrame, id_col: str, text_col: str, buckets: int, least: int) -> DataFrame:
    """Rows (bucket, data) for the global join and rows (id, s, e, first) of marks that a part of a batch knows."""

    def rows(ids, h, g, of, s, e) -> pa.RecordBatch:
        order = np.lexsort((s, ids[of], g, h))
        h, g, of, s, e = h[order], g[order], of[order], s[order], e[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
        group = np.flatnonzero(~again)
        head = np.repeat(group, np.diff(np.append(group, len(h))))
        first = ids[of[head]]
        mark = again & ((ids[of] != first) | (s != s[head]))
        after = _after(s, e, ids[of] == first, s[head], e[head])
        h, g, of1, s1, e1 = h[~again], g[~again], of[~again], s[~again], e[~again]
        bucket = (mix64(h) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((of1, bucket))
        bucket, h, g, of1, s1, e1 = bucket[order], h[order], g[order], of1[order], s1[order], e1[order]
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        blobs = []
        for i, j in zip(edge.tolist(), edge[1:].tolist()):
            own, back = np.unique(of1[i:j], return_inverse=True)
            places = b"".join([ids[own].astype("<i8").tobytes(), back.astype("<u4").tobytes(), s1[i:j].astype("<u4").tobytes(), (e1[i:j] - s1[i:j]).astype("<u2").tobytes()])
            packed = pa.compress(places, codec="zstd", asbytes=True)
            blobs.append(b"".join([np.array([len(own), j - i, len(packed)], "<u4").tobytes(), packed, h[i:j].astype("<u8").tobytes(), (g[i:j] >> np.uint64(32)).astype("<u4").tobytes()]))
        k, m = len(blobs), int(mark.sum())
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(bucket[edge[:-1]], pa.int32()), pa.nulls(m, pa.int32())]),
                pa.concat_arrays([pa.array(blobs, pa.binary()), pa.nulls(m, pa.binary())]),
                *(pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(x, pa.int64())]) for x in (ids[of[mark]], after[mark], e[mark], first[mark])),
            ],
            names=["bucket", "data", "id", "s", "e", "first"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in pieces(b, BATCH)):
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            w = Words(Buffer(b.column(1)), True, False)
            sentence0 = np.searchsorted(w.start, w.first)  # where each document begins
            s, e = spans(w.doc, w.start, w.stop, least)
            p, q = piece_spans(w.hash, w.first)
            of = w.document(p)
            found = [np.zeros(0, np.uint64)] * 2 if not len(s) else span_hashes(w.hash, w.start[s], w.stop[e])
            more = [np.zeros(0, np.uint64)] * 2 if not len(p) else span_hashes(w.hash, p, q)
            more[0][:] ^= np.uint64(_BASES[1])  # spans of pieces meet only their like
            h, g = np.append(found[0], more[0]), np.append(found[1], more[1])
            s, e, of = np.append(s - sentence0[w.doc[s]], p - w.first[of] + AT_WORD), np.append(e - sentence0[w.doc[s]], q - 1 - w.first[of] + AT_WORD), np.append(w.doc[s], of)
            del w, p, q, found, more
            for i in range(0, len(h), ROW):
                yield rows(ids, *(x[i : i + ROW] for x in (h, g, of, s, e)))
        give_back()

    return docs.select(id_col, text_col).mapInArrow(run, "bucket int, data binary, id bigint, s bigint, e bigint, first bigint")


def _not_first(group: pa.Table) -> pa.Table:
    """Marks of a bucket: all occurrences of a span but the first."""
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for blob in group.column("data"):
        raw = blob.as_buffer()
        k, m, size = np.frombuffer(raw, "<u4", 3).tolist()
        places, at = pa.decompress(raw[12 : 12 + size], 8 * k + 10 * m, codec="zstd"), 8 * k
        parts[0].append(np.frombuffer(places, "<i8", k)[np.frombuffer(places, "<u4", m, at)])
        parts[1].append(np.frombuffer(places, "<u4", m, at + 4 * m).astype(np.int64))
        parts[2].append(np.frombuffer(places, "<u2", m, at + 8 * m).astype(np.int64))
        parts[3].append(np.frombuffer(raw, "<u8", m, 12 + size))
        parts[4].append(np.frombuffer(raw, "<u4", m, 12 + size + 8 * m))
    ids, s, n, h, g = (np.concatenate(p) for p in parts)
    order = np.lexsort((s, ids, g, h))
    ids, s, n, h, g = ids[order], s[order], n[order], h[order], g[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    group_at = np.flatnonzero(~again)
    head = np.repeat(group_at, np.diff(np.append(group_at, len(h))))
    first = ids[head]
    again &= (ids != first) | (s != s[head])
    after = _after(s, s + n, ids == first, s[head], (s + n)[head])
    return pa.table({"id": pa.array(ids[again], pa.int64()), "s": pa.array(after[again], pa.int64()), "e": pa.array((s + n)[again], pa.int64()), "first": pa.array(first[again], pa.int64())})


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(_n, _text) of documents, and (id, _n) where ids are no integers or some are null: numbers in the order of the ids."""
    plain = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_text"))
    if docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") and not plain.filter("_i IS NULL").head(1):
        return plain.select(F.col("_i").alias("_n"), "_text"), None
    names = materialize(plain.select("_i").distinct().orderBy(F.col("_i").asc_nulls_first()).withColumn("_n", F.monotonically_increasing_id()), "span-ids")
    other = names.withColumnRenamed("_i", "_j")
    return plain.join(other, F.col("_i").eqNullSafe(F.col("_j"))).select("_n", "_text"), names


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = WORDS) -> DataFrame:
    """Per document that loses words: _id, _spans (sorted array of first and last sentence, or from AT_WORD on word), _earlier (array of ids)."""
    arrow_rows(docs.sparkSession, 20_000, "8m")  # a hint: BATCH is what bounds memory
    plain, names = _numbered(docs, id_col, text_col)
    size = plain.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).head()[0]
    buckets = max(1, math.ceil(size / 20 / BUCKET))
    rows = materialize(_marks(plain, "_n", "_text", buckets, least), "span-marks")
    joined = rows.filter("bucket IS NOT NULL").select("bucket", "data").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_not_first, "id bigint, s bigint, e bigint, first bigint")
    every = joined.unionByName(rows.filter("bucket IS NULL").select("id", "s", "e", "first"))
    if names is None:
        every = every.select(F.col("id").alias("_id"), "s", "e", "first")
    else:
        every = every.join(names.select(F.col("_n").alias("id"), F.col("_i").alias("_id")), "id").join(names.select(F.col("_n").alias("first"), F.col("_i").alias("_f")), "first").select("_id", "s", "e", F.col("_f").alias("first"))
    # collect_set leaves nulls out, and null is an id like others
    found = every.groupBy("_id").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("_spans"), F.array_sort(F.collect_set(F.struct("first"))).alias("_earlier"))
    return materialize(found.select("_id", "_spans", F.col("_earlier.first").alias("_earlier")), "span-marked")


def _slot(col: str):
    return F.pmod(F.xxhash64(col), F.lit(SLOTS))


def _slots(found: DataFrame) -> DataFrame:
    """Slots of the documents that lose words, at most SLOTS rows: documents of other slots need no shuffle."""
    return F.broadcast(found.select(_slot("_id").alias("_slot")).distinct())


def _cut(buf: Buffer, spans_: list[tuple[int, int]]) -> tuple[bytes, int, int, int, int]:
    """What is left of one text; how many sentences it had, how many it lost, how many words in these, how many besides."""
    w = Words(buf, False, True)
    whole, part = np.zeros(len(w.start) + 1, np.int32), np.zeros(w.n + 1, np.int32)
    for a, b in spans_:
        gone, at = (part, AT_WORD) if a >= AT_WORD else (whole, 0)
        gone[a - at] += 1
        gone[b - at + 1] -= 1
    lost = np.cumsum(whole)[:-1] > 0
    inside = np.repeat(lost, w.stop - w.start)
    gone = inside | (np.cumsum(part, dtype=np.int32)[:-1] > 0)
    raw, out, at = buf.data, [], 0
    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        out.append(raw[at : w.begin[a]].tobytes())
        at = int(w.begin[b]) if b < w.n else len(raw)
    out.append(raw[at:].tobytes())
    return b"".join(out), len(w.start), int(lost.sum()), int(inside.sum()), int((gone & ~inside).sum())


def _left(col: pa.Array, spans_: pa.Array) -> list[tuple]:
    """_cut() of each text, or None where there are no spans."""
    return [_cut(Buffer(col.slice(k, 1)), [(x["s"], x["e"]) for x in s]) if s is not None else None for k, s in enumerate(spans_.to_pylist())]


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = WORDS) -> DataFrame:
    """Per document that loses words: id, n_sentences, n_removed, n_words_removed (in removed sentences), n_passage_words (removed
    besides, in spans of pieces), earlier_ids, text (what is left). least: fewest words of a run of sentences."""
    found = marks(docs, id_col, text_col, least)
    plain = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_text")).withColumn("_slot", _slot("_i")).join(_slots(found), "_slot", "left_semi")
    rows = plain.join(found.hint("shuffle_hash"), F.col("_i").eqNullSafe(F.col("_id"))).select("_i", "_text", "_spans", "_earlier")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = _left(b.column(1), b.column(2))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[k] for g in got], pa.int64()) for k in (1, 2, 3, 4)), b.column(3), pa.array([g[0] for g in got], pa.binary()).cast(pa.string())], names=[id_col, "n_sentences", "n_removed", "n_words_removed", "n_passage_words", "earlier_ids", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    earlier = found.schema["_earlier"].dataType.simpleString()
    return map_batches(rows, run, f"`{id_col}` {kind}, n_sentences bigint, n_removed bigint, n_words_removed bigint, n_passage_words bigint, earlier_ids {earlier}, text string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = WORDS) -> DataFrame:
    """All rows, with the removed sentences and passages cut out of their texts."""
    found = marks(docs, id_col, text_col, least)
    names = docs.columns
    at, key = names.index(text_col), names.index(id_col)
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # no name of documents can clash
    slotted = plain.withColumn("_slot", _slot(f"c{key}"))
    some = slotted.join(_slots(found), "_slot", "left_semi").join(found.hint("shuffle_hash").select("_id", "_spans"), F.col(f"c{key}").eqNullSafe(F.col("_id")), "left")
    others = slotted.join(_slots(found), "_slot", "left_anti").withColumn("_spans", F.lit(None).cast(found.schema["_spans"].dataType))
    rows = some.select(*plain.columns, "_spans").unionByName(others.select(*plain.columns, "_spans"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        column = b.column(at)
        texts = [column[k].as_py() if g is None else g[0].decode() for k, g in enumerate(_left(column, b.column(len(names))))]
        return pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.string()), *b.columns[at + 1 : len(names)]], names=names)

    return map_batches(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


__all__ = ["Words", "dedup", "marks", "piece_spans", "removals", "spans"]
