"""Toxicity by lexicon induction: random walks from labelled seed terms over a graph of positive pointwise mutual information.

A word's terms are the word and its prefixes of the lengths PREFIXES, written with a star, so that an inflected or altered
form that no labelled document has still has terms.

1. From at most TRAIN labelled documents: in how many toxic and other documents each term occurs. Toxic seeds are terms
   whose log odds ratio has a lower bound (SURE standard errors) of at least SEED: an effect size, so more labels don't let
   weaker terms in. A prefix that says as much as its word stands for it; the SEEDS strongest stay.
2. Over all documents: how often any term stands within WINDOW words of a seed, and within WINDOW words of a control: all
   words of the same document that are away from all seeds, which share the weight of the document's places of seeds equally
   and count for the control of its strongest seed. Every window of a document with seeds counts, none is drawn. Controls
   are the seeds of the other side: what only tells of a language or subject meets both alike. Every term of the corpus with at least SUPPORT such places is a
   node. An edge's weight is the positive pointwise mutual information of term and seed,
   from the count less SURE standard errors, so that chance meetings are no edges.
3. Two random walks with restart, from the seeds and from the controls, back and forth over the edges. As each edge has
   a seed at one end, two steps are one step between seeds: the executors sum that matrix, SEEDS * 2 squared at most, and
   the walk's last step to all terms is taken on the executors too. A term's polarity is the difference of both walks'
   mass there by their sum. Seeds are clamped to their labels.
4. A term's weight: for a seed the bound of step 1, for other terms their polarity times the mean strength of the seeds
   that the walk comes from, lessened for few meetings and never above what the term's own labels allow.
5. A word weighs as much as its heaviest term. A document's features are how many words, and what share, weigh more than
   each of WEIGHTS, the greatest weight and the sum; logistic regression turns them into the score. Labelled documents are
   in FOLDS folds, and their features come from a lexicon induced without the labels of their own fold.

Only labels of documents that may be learnt from are read; language, source and id are no inputs. What is broadcast or
collected is bounded by TRAIN, SEEDS and BLOCK: a lexicon of more than BLOCK terms is looked up block by block.

Defined results: null and empty texts have no words and get the score that the regression gives to zeros; texts of any
length are read whole; repeated rows are scored alike; without labels of both kinds every score is 0, and without a
toxic seed all documents get one score; an empty table gives an empty result; extra columns are ignored by score_table()
and kept by drop_toxic(); ties in strength are broken by the term.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Buffer, arrow_rows, give_back, map_batches, materialize, pieces
from .labelled import held_out, logistic, probability, sample

TRAIN = 20_000
PREFIXES = (4, 5, 6, 7, 8)
SEED = 2.0
SEEDS = 512
SURE = 1.64
WINDOW = 5
SUPPORT = 3
#: Counts near seeds and controls are in parts of a place, so that their sums are whole numbers in any order.
UNIT = 1 << 20
#: Pairs of a term and a seed or control held at once.
PAIRS = 1_000_000
#: Bits of the map of terms with support; more terms than fit only make it let others pass, which are dropped later.
FILTER = 1 << 25
RESTART = 0.3
WALK = 30
FOLDS = 3
WEIGHTS = (2.0, 3.0, 4.5)
#: Lighter terms are left out of the lexicon, for they reach none of WEIGHTS.
LIGHT = WEIGHTS[0] / 2
#: Terms looked up at once.
BLOCK = 500_000
#: Bytes of text whose words are held at once, but for longer texts; half of it where all terms of all words are.
BATCH = 4 << 20
#: A document is predicted toxic from this score on.
THRESHOLD = 0.3

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a text split at once.
_SLICE = 1 << 20


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > _SLICE and (cut := text.find(b" ", at + _SLICE)) >= 0:
            end = cut
        yield text[at:end]
        at = end


def encode(col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words (letters, with A-Z lower-cased, and any character beyond ASCII) of a batch, the number of each
    word of its texts, and where each text's words begin."""
    buf = Buffer(col)
    code: defaultdict[bytes, int] = defaultdict()
    code.default_factory = code.__len__
    parts, sizes = [np.zeros(0, np.int32)], np.zeros(buf.n + 1, np.int64)
    o = buf.offsets.tolist()
    for k, (a, b) in enumerate(zip(o, o[1:])):
        for piece in _slices(buf.data[a:b].tobytes().translate(_TABLE)):
            ws = piece.split()
            parts.append(np.fromiter(map(code.__getitem__, ws), np.int32, len(ws)))
            sizes[k + 1] += len(ws)
    return [w.decode() for w in code], np.concatenate(parts), np.cumsum(sizes)


def terms(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def term_finder(known):
    """A function from a word to its terms that may be among the known ones; most words have none, by their first letters."""
    starts = {t[: PREFIXES[0]] for t in known}
    return lambda word: terms(word) if word[: PREFIXES[0]] in starts else ()


def _log_odds(t, o, nt, no):
    """Log odds ratio and its standard error, of Spark columns."""
    odds = F.log((t + 0.5) / (nt - t + 0.5)) - F.log((o + 0.5) / (no - o + 0.5))
    return odds, F.sqrt(1 / (t + 0.5) + 1 / (o + 0.5))


def label_counts(rows: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rows (term, t0, o0, ...): toxic and other documents of each fold with the term; and the sizes of the folds."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        words, codes, begin = encode(b.column(0))
        column = np.array(b.column(2).to_pylist(), np.int64) * 2 + (1 - np.array(b.column(1).to_pylist(), np.int64))
        known: defaultdict[str, int] = defaultdict()
        known.default_factory = known.__len__
        lists = [[known[t] for t in terms(w)] for w in words]
        size = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum()))
        first = np.cumsum(size) - size
        doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        pair = np.unique(doc * max(1, len(words)) + codes)
        doc, word = pair // max(1, len(words)), pair % max(1, len(words))
        n = size[word]
        at = np.repeat(first[word] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        pair = np.unique(np.repeat(doc, n) * max(1, len(known)) + flat[at])
        doc, term = pair // max(1, len(known)), pair % max(1, len(known))
        table = np.bincount(term * 2 * FOLDS + column[doc], minlength=len(known) * 2 * FOLDS).reshape(-1, 2 * FOLDS)
        return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), *(pa.array(table[:, k]) for k in range(2 * FOLDS))], names=names)

    sizes = {(r["_fold"], r["_label"]): r["n"] for r in rows.groupBy("_fold", "_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = ["term", *(f"{k}{fold}" for fold in range(FOLDS) for k in "to")]
    counted = map_batches(rows.select("_text", "_label", "_fold"), count, "term string, " + ", ".join(f"{n} bigint" for n in names[1:]), BATCH // 2)
    return counted.groupBy("term").agg(*(F.sum(n).alias(n) for n in names[1:])), [(sizes.get((k, 1), 0), sizes.get((k, 0), 0)) for k in range(FOLDS)]


def _bounds(counts: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """With t, o, the lower bounds of the log odds without each fold and with all (array low), and the upper (array high)."""
    nt, no = sum(s[0] for s in sizes), sum(s[1] for s in sizes)
    t, o = sum((F.col(f"t{k}") for k in range(FOLDS)), F.lit(0)), sum((F.col(f"o{k}") for k in range(FOLDS)), F.lit(0))
    views = [(t - F.col(f"t{k}"), o - F.col(f"o{k}"), nt - sizes[k][0], no - sizes[k][1]) for k in range(FOLDS)] + [(t, o, nt, no)]
    both = [_log_odds(*v) for v in views]
    return counts.select("term", t.alias("t"), o.alias("o"), F.array(*(a - SURE * e for a, e in both)).alias("low"), F.array(*(a + SURE * e for a, e in both)).alias("high"))


def choose_seeds(bounds: DataFrame) -> tuple[list[str], np.ndarray]:
    """Toxic seeds, strongest first, with their strengths (a row of FOLDS + 1 each)."""
    # Rows of a bounded sample: each has several toxic documents behind it.
    got = {r["term"]: r["low"] for r in bounds.filter(F.array_max("low") >= SEED).orderBy(F.array_max("low").desc(), "term").limit(16 * SEEDS).collect()}
    kept: dict[str, float] = {}
    for term in sorted(got, key=lambda x: (len(x.rstrip("*")), -len(x))):
        stem = term.rstrip("*")
        if all(kept.get(stem[:k] + "*", -1.0) < max(got[term]) - 0.3 for k in PREFIXES if k <= len(stem) and stem[:k] + "*" != term):
            kept[term] = max(got[term])
    toxic = sorted(kept, key=lambda x: (-kept[x], x))[:SEEDS]
    strength = np.array([got[w] for w in toxic]).reshape(-1, FOLDS + 1)
    return toxic, np.where(strength >= SEED, strength, 0.0)


def controls(codes: np.ndarray, begin: np.ndarray, doc: np.ndarray, is_seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document with seeds, the words near places farther than WINDOW words from all seeds, and the mean number of
    times that they stand within WINDOW words of such a place: arrays (document, word, mean), in order of documents."""
    n = np.diff(begin)
    place = np.arange(len(codes))
    lo, hi = np.maximum(place - WINDOW, begin[:-1][doc]), np.minimum(place + WINDOW + 1, begin[1:][doc])
    seeds = np.append(0, np.cumsum(is_seed))
    far = (seeds[hi] == seeds[lo]) & np.repeat(seeds[begin[1:]] > seeds[begin[:-1]], n)
    places = np.append(0, np.cumsum(far))
    met = places[hi] - places[lo] - far
    some = np.flatnonzero(met)
    wide = max(1, int(codes.max(initial=0)) + 1)
    key, of = np.unique(doc[some] * wide + codes[some], return_inverse=True)
    of_doc = key // wide
    return of_doc, key % wide, np.bincount(of, met[some], len(key)) / (places[begin[1:]] - places[begin[:-1]])[of_doc]


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of n of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n[order], first) if len(key) else n


def _spread(n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each i, the n[i] numbers from first[i] on."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Windows:
    """What stands near the seeds and their controls in a batch of texts: near (word, seed, n); far (document, word, mean), as
    controls() has it; and of each document its number of places of seeds and its strongest seed, or -1."""

    def __init__(self, col: pa.Array, of: dict[str, int]):
        self.words, codes, begin = encode(col)
        find = term_finder(of)
        seed = np.fromiter((min((of[t] for t in find(w) if t in of), default=-1) for w in self.words), np.int64, len(self.words))
        doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        is_seed = seed[codes] >= 0
        at = np.flatnonzero(is_seed)
        which = seed[codes[at]]
        keys = []
        for step in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
            ok = (at + step >= 0) & (at + step < len(codes))
            ok[ok] = doc[at[ok] + step] == doc[at[ok]]
            keys.append(codes[at[ok] + step].astype(np.int64) * len(of) + which[ok])
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        self.near = key // len(of), key % len(of), n.astype(np.int64) * UNIT
        self.places = np.bincount(doc[at], minlength=len(begin) - 1)
        self.control = np.full(len(begin) - 1, len(of))
        np.minimum.at(self.control, doc[at], which)
        self.control[self.places == 0] = -1
        self.far = controls(codes, begin, doc, is_seed)


def support(docs: DataFrame, text_col: str, seeds) -> DataFrame:
    """The terms with at least SUPPORT places near seeds and controls."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        w = Windows(b.column(0), {t: k for k, t in enumerate(seeds.value)})
        if not w.places.any():
            return None
        of_doc, word, mean = w.far
        word, n = _summed(np.append(w.near[0], word), np.append(w.near[2], np.rint(w.places[of_doc] * mean * UNIT).astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(w.words, pa.string()).take(pa.array(word)), pa.array(n)], names=["word", "n"])

    total = map_batches(docs.select(text_col), run, "word string, n bigint", BATCH).groupBy("word").agg(F.sum("n").alias("n"))
    prefixes = [F.when(F.length("word") >= k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in PREFIXES]
    every = total.select(F.explode(F.array_compact(F.array("word", *prefixes))).alias("term"), "n")
    return every.groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= SUPPORT * UNIT).select("term")


def _bits(names: DataFrame) -> np.ndarray:
    """A bit map of fixed size with the bits of all terms."""
    slot = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(FILTER)) + 1
    bits = names.select(F.bitmap_bucket_number(slot).alias("k"), F.bitmap_bit_position(slot).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m"))
    out = np.zeros(FILTER // 8, np.uint8)
    for r in bits.toLocalIterator():  # at most FILTER / 32768 rows
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def contexts(docs: DataFrame, text_col: str, seeds) -> DataFrame:
    """Rows (term, seed, n): how often each term of support() stands within WINDOW words of a seed, in parts of 1 / UNIT, over
    all documents; seeds is a broadcast list, strongest first. The control of documents with seed k as the strongest has the number k + len(seeds)."""
    names = materialize(support(docs, text_col, seeds), "toxicity-support")
    bits = docs.sparkSession.sparkContext.broadcast(_bits(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, filled = {w: k for k, w in enumerate(seeds.value)}, bits.value
        wide = 2 * len(of)
        known: dict[str, int] = {}
        keys, ns, held = [], [], 0

        def add(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch | None:
            """Adds to what is held, and empties it where too many are."""
            nonlocal keys, ns, held
            key, n = _summed(key, n)
            keys.append(key)
            ns.append(n)
            held += len(key)
            if held > PAIRS:
                key, n = _summed(np.concatenate(keys), np.concatenate(ns))
                keys, ns, held = [key], [n], len(key)
                if held > PAIRS // 2:
                    return empty()
            return None

        def empty() -> pa.RecordBatch:
            nonlocal keys, ns, held
            key, n = _summed(np.concatenate(keys), np.concatenate(ns))
            keys, ns, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()).take(pa.array(key // wide)), pa.array((key % wide).astype(np.int32)), pa.array(n)], names=["term", "seed", "n"])

        for part in (p for b in batches for p in pieces(b, BATCH)):
            if held and len(known) > PAIRS:
                yield empty()
            if not held:
                known = {}
            w = Windows(part.column(0), of)
            if not w.places.any():
                continue
            # the terms of each word that may be in names
            lists: list[list[int]] = [[]] * len(w.words)
            for k in np.unique(np.append(w.near[0], w.far[1])).tolist():
                lists[k] = [known.setdefault(t, len(known)) for t in terms(w.words[k]) if filled[(at := zlib.crc32(t.encode()) % FILTER) >> 3] >> (at & 7) & 1]
            size = np.array([len(x) for x in lists], np.int64)
            flat, start = np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())), np.cumsum(size) - size
            word, seed, n = w.near
            k = size[word]
            if (out := add(flat[_spread(k, start[word])] * wide + np.repeat(seed, k), np.repeat(n, k))) is not None:
                yield out
            of_doc, word, mean = w.far
            k = size[word]
            key, at = np.unique(np.repeat(of_doc, k) * max(1, len(known)) + flat[_spread(k, start[word])], return_inverse=True)
            mean = np.bincount(at, np.repeat(mean, k), len(key))
            of_doc, term = key // max(1, len(known)), key % max(1, len(known))
            if (out := add(term * wide + len(of) + w.control[of_doc], np.rint(w.places[of_doc] * mean * UNIT).astype(np.int64))) is not None:
                yield out
        if held:
            yield empty()
        give_back()

    near = docs.select(text_col).mapInArrow(run, "term string, seed int, n bigint").groupBy("term", "seed").agg(F.sum("n").alias("n"))
    return near.join(names, "term", "left_semi")


class Graph:
    """Marginals of the graph of terms and seeds, and the edges of a batch of terms."""

    def __init__(self, of_seed: np.ndarray):
        self.of_seed = of_seed

    def edges(self, b: pa.RecordBatch) -> np.ndarray:
        """The weights of a batch's terms (rows) and the seeds (columns)."""
        seed, n = (b.column(b.schema.names.index(k)) for k in ("seeds", "ns"))
        row = np.repeat(np.arange(b.num_rows), np.diff(seed.offsets.to_numpy()))
        s, c = seed.flatten().to_numpy(), n.flatten().to_numpy() / UNIT
        of_term = np.bincount(row, c, b.num_rows)
        sure = np.maximum(c - SURE * np.sqrt(c), 0)
        with np.errstate(divide="ignore"):
            pmi = np.log(sure * self.of_seed.sum() / (of_term[row] * self.of_seed[s]))
        out = np.zeros((b.num_rows, len(self.of_seed)))
        out[row, s] = np.maximum(pmi, 0)
        return out


def _two_steps(nodes: DataFrame, graph: Graph) -> np.ndarray:
    """For seeds i and j, the sum over terms of weight(i) * weight(j) / degree of the term; at most SEEDS * 2 squared cells."""
    n = len(graph.of_seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                w = graph.edges(part)
                total += w.T @ (w / np.maximum(w.sum(1, keepdims=True), 1e-300))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "v"])

    got = nodes.select("seeds", "ns").mapInArrow(run, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(n * n)
    out[got["cell"].to_numpy()] = got["v"].to_numpy()
    return out.reshape(n, n)


def walk(step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where a walk with restart is found: a row for each row of start. step: as _two_steps()."""
    degree = step.sum(1)
    move = step / np.where(degree > 0, degree, 1)[:, None] + np.diag((degree == 0).astype(float))
    start = start / np.maximum(start.sum(1, keepdims=True), 1e-300)
    p = start
    for _ in range(WALK):
        p = RESTART * start + (1 - RESTART) * (p @ move)
    return p


def induce(docs: DataFrame, rows: DataFrame, text_col: str) -> list[dict[str, list[float]]] | None:
    """The lexicon in blocks: for each term its weight in the lexicons without each fold, and in that of all labels."""
    spark = docs.sparkSession
    counts, sizes = label_counts(rows)
    if not sum(s[0] for s in sizes) or not sum(s[1] for s in sizes):
        return None
    bounds = materialize(_bounds(counts, sizes), "toxicity-terms")
    toxic, strength = choose_seeds(bounds)
    if not toxic:
        return [{}]
    m, n = len(toxic), 2 * len(toxic)
    near = contexts(docs, text_col, spark.sparkContext.broadcast(toxic))
    nodes = near.groupBy("term").agg(F.collect_list(F.struct("seed", "n")).alias("e"))
    nodes = materialize(nodes.select("term", F.col("e.seed").alias("seeds"), F.col("e.n").alias("ns")), "toxicity-nodes")
    of_seed = np.zeros(n)
    for r in nodes.select(F.explode(F.arrays_zip("seeds", "ns")).alias("e")).groupBy("e.seeds").agg(F.sum("e.ns").alias("n")).collect():
        of_seed[r["seeds"]] = r["n"] / UNIT
    met = of_seed > 0  # a seed that is never a document's strongest has no control
    of_seed = np.maximum(of_seed, 1)
    graph = Graph(of_seed)
    step = _two_steps(nodes, graph)
    degree = np.maximum(step.sum(1), 1e-300)
    start = np.zeros((FOLDS + 2, n))
    start[: FOLDS + 1, :m] = strength.T
    start[FOLDS + 1, m:] = strength.max(1) * met[m:]
    at = walk(step, start)
    own = {w: strength[k].tolist() for k, w in enumerate(toxic)}

    def weigh(b: pa.RecordBatch) -> pa.RecordBatch:
        w = graph.edges(b) / degree
        seeds_mass, toxic_mass, other_mass = w[:, :m] @ at[:-1, :m].T, w @ at[:-1].T, (w @ at[-1])[:, None]
        polarity = np.maximum(toxic_mass - other_mass, 0) / np.maximum(toxic_mass + other_mass, 1e-300)
        mean = (w[:, :m] @ (at[:-1, :m] * strength.T).T) / np.maximum(seeds_mass, 1e-300)
        seed, c = b.column(1), b.column(2).flatten().to_numpy() / UNIT
        row = np.repeat(np.arange(b.num_rows), np.diff(seed.offsets.to_numpy()))
        n_met = np.bincount(row, c * (seed.flatten().to_numpy() < m), b.num_rows)
        weight = polarity * mean * (n_met / (n_met + SURE**2))[:, None]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(weight.tolist(), pa.list_(pa.float64()))], names=["term", "weight"])

    found = map_batches(nodes, weigh, "term string, weight array<double>", 4 << 20).filter(F.array_max("weight") >= LIGHT)
    allowed = F.transform("weight", lambda w, i: F.least(w, F.greatest(F.coalesce(F.get("high", i), F.lit(1e9)), F.lit(0.0))))
    found = found.join(bounds.select("term", "high"), "term", "left").select("term", allowed.alias("weight")).filter(F.array_max("weight") >= LIGHT)
    found = materialize(found, "toxicity-lexicon")
    first = found.limit(BLOCK + 1).collect()
    if len(first) <= BLOCK:
        return [{r["term"]: r["weight"] for r in first} | own]
    blocks, parts = [], -(-found.count() // BLOCK)
    for k in range(parts):  # each about BLOCK terms
        blocks.append({r["term"]: r["weight"] for r in found.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).collect()} | (own if not k else {}))
    return blocks


def look_up(words: list[str], codes: np.ndarray, lexicon: dict[str, list[float]], view: int) -> np.ndarray:
    """The weight of each word of a batch."""
    find = term_finder(lexicon)
    return np.fromiter((max((lexicon[t][view] for t in find(w) if t in lexicon), default=0.0) for w in words), np.float32, len(words))[codes]


def features(weight: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row for each text; weight is that of each word."""
    n = np.diff(begin)
    out = np.zeros((len(n), 2 * len(WEIGHTS) + 2))
    for k, least in enumerate(WEIGHTS):
        total = np.append(0, np.cumsum(weight >= least))
        hits = total[begin[1:]] - total[begin[:-1]]
        out[:, 2 * k] = np.log1p(hits)
        out[:, 2 * k + 1] = np.log1p(100 * hits / np.maximum(n, 1))
    some = np.flatnonzero(n)
    if len(some):
        out[some, -2] = np.maximum.reduceat(weight, begin[some])
        out[some, -1] = np.log1p(np.add.reduceat(np.where(weight >= WEIGHTS[0], weight, 0), begin[some]))
    return out


class Model:
    """What scoring needs: the lexicon's blocks and the regression; None where nothing could be learnt."""

    def __init__(self, blocks: list[dict[str, list[float]]] | None, regression):
        self.blocks, self.regression = blocks, regression


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _weighed(df: DataFrame, text_col: str, blocks: list[dict[str, list[float]]], view: int, finish, schema: str) -> DataFrame:
    """finish(batch, weight of each word, where each text's words begin) for all batches of df.

    One block of the lexicon is broadcast at a time; where there are more, the weights so far are a column of a table.
    """
    sent = [df.sparkSession.sparkContext.broadcast(b) for b in blocks]
    at, width = df.columns.index(text_col), len(df.columns)

    def weigh(b: pa.RecordBatch, block) -> tuple[np.ndarray, np.ndarray]:
        words, codes, begin = encode(b.column(at))
        w = look_up(words, codes, block.value, view)
        return (np.maximum(w, b.column(width).flatten().to_numpy()) if b.num_columns > width else w), begin

    def add(block):
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            w, begin = weigh(b, block)
            return pa.RecordBatch.from_arrays([*b.columns[:width], pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(w, pa.float32()))], names=[*names, "_weights"])

        return run

    names, fields = df.columns, _fields(df)
    for block in sent[:-1]:
        df = materialize(map_batches(df, add(block), f"{fields}, _weights array<float>"), "toxicity-weights")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return finish(b.select(range(width)) if b.num_columns > width else b, *weigh(b, sent[-1]))

    return map_batches(df, run, schema, BATCH)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    arrow_rows(docs.sparkSession, size="4m")
    rows = sample(docs, labels, label_col, TRAIN, id_col, text_col)
    rows = materialize(rows.select("_text", "_label", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("_fold")), "toxicity-sample")
    blocks = induce(docs, rows, text_col)
    if blocks is None:
        return Model(None, None)

    def finish(b: pa.RecordBatch, weight: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(features(weight, begin).tolist(), pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    folds = [_weighed(rows.filter(F.col("_fold") == k).select("_text", "_label"), "_text", blocks, k, finish, "x array<double>, y int") for k in range(FOLDS)]
    got = reduce(DataFrame.unionByName, folds).toArrow()  # at most TRAIN rows
    y = got["y"].to_numpy().astype(float)
    x = np.array(got["x"].to_pylist()).reshape(len(y), -1)
    order = np.lexsort((y, *x.T))  # so that the order of rows doesn't move a bit of the sums
    return Model(blocks, logistic(x[order], y[order]))


def _finish_scores(model: Model, emit, df: DataFrame, text_col: str, schema: str) -> DataFrame:
    """emit(batch, scores) for all batches of df."""
    if model.blocks is None:
        return map_batches(df, lambda b: emit(b, np.zeros(b.num_rows)), schema)
    regression = model.regression
    return _weighed(df, text_col, model.blocks, FOLDS, lambda b, weight, begin: emit(b, probability(features(weight, begin), regression)), schema)


def score_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per row: id, held_out, score, predicted."""

    def emit(b: pa.RecordBatch, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = _finish_scores(fit(docs, labels, id_col, text_col, label_col), emit, docs.select(id_col, text_col), text_col, f"`{id_col}` {kind}, score double, predicted int")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows that aren't predicted toxic, unchanged."""
    return _finish_scores(fit(docs, labels, id_col, text_col, label_col), lambda b, s: b.filter(pa.array(s < THRESHOLD)), docs, text_col, _fields(docs))
