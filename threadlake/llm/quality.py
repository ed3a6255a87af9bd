"""Quality classifier: similarity-weighted vote of the nearest labelled documents in a latent semantic space.

Terms are runs: the bytes of a text fall into 16 classes, equal neighbours collapse, and every three consecutive runs are a
term; further terms count words equal to the word before, words met before in the text and lines met before. 1. In how many
documents each term occurs is counted over all documents (at most TERMS sums reach the driver). 2. At most TRAIN labelled
documents give tf-idf vectors, whose truncated singular value decomposition to RANK dimensions is the latent space; these
labelled latent vectors, of that bounded size, are broadcast. 3. Every document's vector is projected, its cosines with all
labelled vectors are exact matrix products in blocks of documents, and the NEIGHBOURS nearest vote with their labels,
weighted by a power of the similarity.

Only labels of documents that may be learnt from are read; language, source and id are no inputs.

Defined results: null and empty texts have no terms, hence no neighbours, and score 0; texts of any length are read whole;
repeated rows score alike; ties between neighbours are broken by their order in the sample's hash order; without labels
every score is 0.5; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Buffer, arrow_rows, map_batches, mix64, piece_hashes
from .labelled import held_out, sample

TRAIN = 4096
RANK = 64
NEIGHBOURS = 15
POWER = 8
BLOCK = 512
GRAMS = 16**3
#: Further terms: word repeated at once, word met before, line met before.
TERMS = GRAMS + 3
THRESHOLD = 0.7

_CLASSES = np.full(256, 15, np.uint8)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" ", 3), (b"\t\n\v\f\r", 4), (b".", 5), (b",;:", 6), (b"!?", 7), (b"'\"()", 8), (b"*", 9), (b"#", 10), (b"$%&", 11), (b"|", 12), (b"-_/\\", 13), (b"<>[]{}=@+", 14)):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 0
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True


def _met_before(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where the same hash occurs earlier in the same document."""
    key = mix64(h ^ mix64(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    out = np.zeros(len(h), bool)
    out[order[1:]] = s[1:] == s[:-1]
    return out


def counts(col: pa.Array) -> np.ndarray:
    """Term counts of each text, float32."""
    buf = Buffer(col)
    n, data, first = buf.n, buf.data, buf.offsets
    out = np.zeros((n, TERMS), np.float32)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), np.diff(first))
    c = _CLASSES[data]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (doc[1:] != doc[:-1])
    runs, at = c[new].astype(np.int64), doc[new]
    if len(runs) > 2:
        same = at[2:] == at[:-2]
        gram = (runs[:-2] * 256 + runs[1:-1] * 16 + runs[2:])[same]
        out[:, :GRAMS] = np.bincount(at[2:][same] * GRAMS + gram, minlength=n * GRAMS).reshape(n, GRAMS)
    for kind, mask in ((0, ~_SPACE[data]), (1, data != 10)):
        inside = mask.astype(np.int8)
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(edge)
        begin, end = starts[:-1], starts[1:]
        keep = mask[begin]
        begin, end = begin[keep], end[keep]
        h, of = piece_hashes(data, begin, end), doc[begin]
        if kind == 0:
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
            out[:, GRAMS] = np.bincount(of, again, n)
            out[:, GRAMS + 1] = np.bincount(of, _met_before(of, h), n)
        else:
            out[:, GRAMS + 2] = np.bincount(of, _met_before(of, h), n)
    return out


class Space:
    """The latent space with its labelled vectors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seen: np.ndarray, total: int):
        """x: term counts of the labelled documents, y: labels, seen: documents with each term, of total."""
        self.idf = np.log((1 + total) / (1 + seen)).astype(np.float32) + 1
        self.idf[seen == 0] = 0
        a = self.weigh(x)
        rank = min(RANK, *a.shape)
        q = a.T @ np.random.default_rng(7).standard_normal((a.shape[0], min(rank + 16, a.shape[0]))).astype(np.float32)
        for _ in range(3):  # subspace iteration
            q = np.linalg.qr(q)[0]
            q = a.T @ (a @ q)
        q = np.linalg.qr(q)[0]
        self.project = (q @ np.linalg.svd(a @ q, full_matrices=False)[2][:rank].T).astype(np.float32)
        self.vectors = self.latent(a)
        self.labels = y.astype(np.float32)

    def weigh(self, x: np.ndarray) -> np.ndarray:
        a = np.log1p(x) * self.idf
        return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)

    def latent(self, a: np.ndarray) -> np.ndarray:
        z = a @ self.project
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, col: pa.Array) -> np.ndarray:
        out = np.zeros(len(col))
        for i in range(0, len(col), BLOCK):
            cos = self.latent(self.weigh(counts(col[i : i + BLOCK]))) @ self.vectors.T
            k = min(NEIGHBOURS, cos.shape[1])
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < cos.shape[1] else np.broadcast_to(np.arange(k), (len(cos), k))
            w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** POWER
            out[i : i + BLOCK] = (w * self.labels[near]).sum(1) / np.maximum(w.sum(1), 1e-12)
        return np.clip(out, 0, 1)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Over all documents: how many have each term, and how many there are."""

    def run(batches):
        seen = np.zeros(TERMS + 1, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.column(0)[i : i + BLOCK]
                seen[:TERMS] += (counts(part) > 0).sum(0)
                seen[TERMS] += len(part)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["term", "n"])

    got = docs.select(text_col).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(TERMS + 1, np.int64)
    seen[got["term"].to_numpy()] = got["n"].to_numpy()
    return seen[:TERMS], int(seen[TERMS])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Space | None:
    arrow_rows(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        parts = [counts(b.column(1)[i : i + BLOCK]) for i in range(0, b.num_rows, BLOCK)]
        x = np.concatenate(parts)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x.astype(np.float16 if x.max() < 2048 else np.float32)], pa.binary()), b.column(2)], names=["id", "x", "y"])

    rows = sample(docs, labels, label_col, TRAIN, id_col, text_col)
    rows = rows.select(F.xxhash64("_id").alias("id"), "_text", "_label")
    got = map_batches(rows, run, "id bigint, x binary, y int").toArrow()
    if not len(got):
        return None
    got = got.sort_by("id")
    x = np.stack([np.frombuffer(v, np.float16 if len(v) == 2 * TERMS else np.float32).astype(np.float32) for v in got["x"].to_pylist()])
    return Space(x, got["y"].to_numpy(), *document_frequencies(docs, text_col))


def score_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    space = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = np.full(b.num_rows, 0.5) if space.value is None else space.value.scores(b.column(1))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double, predicted int")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")
