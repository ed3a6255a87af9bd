r"""BPE encoding and decoding with a public vocabulary: merge ranks in a priority queue over a doubly linked symbol list.

A word's symbols form a doubly linked list. All adjacent pairs with a merge rank lie in a heap as (rank, position); the
least is popped, skipped if stale (one of its symbols has gone or changed), else merged, and the new pairs at both sides
are pushed. Decoding joins vocabulary strings by the rule of the vocabulary file, which for one without a decoder section
is one space between them. Only the splitting into words and the normalisation (NFC, white space, lower case) follow the
file's own description; special tokens written out in a text are recognised before normalisation, as the public library
does.

The vocabulary is sent to the executors as the file's bytes, at most MAX_FILE; words met again are looked up in a cache of
two generations with at most CACHE words each, which bounds memory and never changes results.

Defined results: null counts as the empty text, which has no tokens, the empty list and the empty decoded text; texts of
any length are encoded whole; repeated rows and ids are encoded each by itself; an empty table gives an empty result;
extra columns are ignored by token_digests() and kept by with_tokens(), which replaces a column named n_tokens or ids.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from array import array
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_rows, map_batches

MAX_FILE = 64 << 20
CACHE = 200_000
#: The characters with the Unicode property White_Space.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")
_PLAIN = re.compile("[!-~ß-öø-ÿ]*")
_SPLIT = re.compile(f"[{SPACE}]+")
_CONTROL = re.compile("[\x1c-\x1f]")
_RARE = re.compile("[\u03a3\u1c89-\U0001ffff]")


#: Code points that the regex module counts as letters or digits, or knows not, and the public library the other way round.
_YOUNG = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a "
    "11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 "
    "18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 "
    "1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479"
)
#: Capitals younger than this Python's tables: first, last, first of the small letters.
_CAPITALS = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))
_LOWER = {0x3A3: 0x3C3} | {c: c - a + to for a, b, to in _CAPITALS for c in range(a, b + 1)}  # no rule for the final sigma


@cache
def _all_words() -> regex.Pattern:
    """The words of any script."""
    young = "".join("-".join(f"\\U{int(c, 16):08x}" for c in r.split("-")) for r in _YOUNG.split())
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{young}]]+|[\p{{N}}--[{young}]]|[^{SPACE}[[\p{{L}}\p{{N}}]--[{young}]]]+")


def words(chunk: str) -> list[str]:
    """The words of a normalised chunk without white space."""
    return (_LATIN if _PLAIN.fullmatch(chunk) else _all_words()).findall(chunk)



def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, k = [""] * 256, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + k)
            k += 1
    return out


class Vocabulary:
    """A word-level BPE vocabulary with end-of-word suffix, from the bytes of its JSON file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.strings = {v: k for k, v in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({v: k for k, v in self.special.items()})
        ids = self.ids
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # by rank
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[a], ids[b]] = rank
            self.made.append(ids[a + b])
        chars = byte_chars()
        self.inner = [ids[c] for c in chars]
        self.last = [ids[c + self.suffix] for c in chars]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def merge(self, word: str) -> list[int]:
        """The token ids of one word."""
        raw, rank_of, made = word.encode(), self.ranks.get, self.made
        ids = list(map(self.inner.__getitem__, raw))
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        bits = n.bit_length()
        rank_at = list(map(rank_of, zip(ids, ids[1:])))  # of the pair that begins at a symbol
        heap = [rank << bits | i for i, rank in enumerate(rank_at) if rank is not None]
        if not heap:
            return ids
        heapify(heap)
        rank_at.append(None)
        after, before, at = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << bits) - 1
        while heap:
            top = heappop(heap)
            rank, i = top >> bits, top & at
            if rank_at[i] != rank:
                continue  # stale
            j = after[i]
            new = ids[i] = made[rank]
            k = after[i] = after[j]
            ids[j], rank_at[j] = -1, None
            if k < n:
                before[k] = i
                rank = rank_at[i] = rank_of((new, ids[k]))
                if rank is not None:
                    heappush(heap, rank << bits | i)
            else:
                rank_at[i] = None
            h = before[i]
            if h >= 0:
                rank = rank_at[h] = rank_of((ids[h], new))
                if rank is not None:
                    heappush(heap, rank << bits | h)
        return [x for x in ids if x >= 0]

    def entry(self, chunk: str) -> tuple[bytes, str]:
        """Of a chunk without white space: its ids as little-endian unsigned 32-bit integers; their strings, joined."""
        found = self.old.get(chunk)
        if found is None:
            ids = []
            for w in words(chunk):
                known = self.words.get(w)
                if known is None:
                    if len(self.words) >= CACHE:
                        self.words.clear()
                    known = self.words[w] = tuple(self.merge(w))
                ids += known
            found = (array("I", ids).tobytes(), self.decode(ids))
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[chunk] = found
        return found

    def shrink(self) -> None:
        """Leaves the younger generation only: workers are kept, and so is what they hold between tasks."""
        self.old = {}
        self.words.clear()

    def parts(self, text: str) -> list[tuple[bytes, str]]:
        """Of every chunk in turn, what entry() gives; no word spans white space."""
        if self.split_special and "<|" in text:
            out = []
            for k, piece in enumerate(self.split_special.split(text)):
                if k % 2:
                    out.append((array("I", [self.special[piece]]).tobytes(), piece))
                elif piece:
                    out += self._known(piece)
            return out
        return self._known(text)

    def _known(self, text: str) -> list[tuple[bytes, str]]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if _RARE.search(text):
                text = text.translate(_LOWER)
        text = text.lower()
        chunks = [c for c in _SPLIT.split(text) if c] if _CONTROL.search(text) else text.split()
        out = list(map(self.young.get, chunks))
        if None in out:
            for k, found in enumerate(out):
                if found is None:
                    out[k] = self.entry(chunks[k])
        return out

    def encode(self, text: str) -> list[int]:
        a = array("I")
        a.frombytes(b"".join([p[0] for p in self.parts(text)]))
        return a.tolist()

    def decode(self, ids: list[int]) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in ids])


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(key: str, data) -> Vocabulary:
    if key not in _loaded:
        _loaded[key] = Vocabulary(data.value)
        gc.freeze()
        gc.set_threshold(200_000, 50, 100)  # the caches hold many small objects and no cycles
    return _loaded[key]


def _sent(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        data = f.read(MAX_FILE + 1)
    if len(data) > MAX_FILE:
        raise ValueError(f"the vocabulary is larger than {MAX_FILE} bytes")
    return hashlib.md5(data).hexdigest(), docs.sparkSession.sparkContext.broadcast(data)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256; no shuffle."""
    key, data = _sent(docs, path)
    arrow_rows(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        v = _vocabulary(key, data)
        n, ids, texts = [], [], []
        for t in b.column(1):
            parts = v.parts(t.as_py() or "")
            packed = b"".join([p[0] for p in parts])
            n.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            texts.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", done=lambda: _vocabulary(key, data).shrink())


def with_tokens(docs: DataFrame, path: str, text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """The rows with columns n_tokens and ids (array of int) added, and with a name for it the decoded text; they take the
    place of columns with these names."""
    key, data = _sent(docs, path)
    arrow_rows(docs.sparkSession)
    docs = docs.drop("n_tokens", "ids", *([decoded_col] if decoded_col else []))
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        v = _vocabulary(key, data)
        packed, sizes, texts = [], [0], []
        for t in b.column(at):
            parts = v.parts(t.as_py() or "")
            packed.append(b"".join([p[0] for p in parts]))
            sizes.append(sizes[-1] + len(packed[-1]) // 4)
            if decoded_col:
                texts.append(" ".join([p[1] for p in parts]))
        ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))
        more = [pa.array(texts, pa.string())] if decoded_col else []
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.diff(sizes), pa.int64()), ids, *more], names=[*b.schema.names, *added])

    added = ["n_tokens", "ids", *([decoded_col] if decoded_col else [])]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, run, f"{schema}, n_tokens bigint, ids array<int>" + (f", `{decoded_col}` string" if decoded_col else ""), done=lambda: _vocabulary(key, data).shrink())


def decoded(rows: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows with the decoded text of their ids, in the place of a column with that name; null ids give the empty text."""
    key, data = _sent(rows, path)
    arrow_rows(rows.sparkSession)
    rows = rows.drop(to)
    at = rows.columns.index(ids_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        v = _vocabulary(key, data)
        out = [v.decode(x.as_py() or []) for x in b.column(at)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, to])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_batches(rows, run, f"{schema}, `{to}` string")


__all__ = ["Vocabulary", "decoded", "token_digests", "with_tokens"]
