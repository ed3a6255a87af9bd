r"""Personal data: fixed patterns with checks, and a skip-chain conditional random field.

Base spans come from four patterns (leftmost, non-overlapping, failing matches dropped without another try): email, ip,
card (13 to 19 digits, Luhn) and phone. The field labels the white-space separated tokens of a document as none or one of
the four kinds. Potentials: log-linear unary ones over a token's shape and its neighbours' shapes; a chain between
neighbours; and skip links between tokens, however distant, that are equal once signs at both ends are gone or whose last
LAST_DIGITS digits agree, which share a potential for equal labels. Loopy belief propagation passes messages over chain
and skip links ROUNDS times, all at once; links of m such tokens form a path and a star around the first, under 2m links, never
all pairs. Tokens that the base found are clamped to their kind. Tokens without a digit and without @ are clamped to none,
which cuts the document into independent parts, so only tokens with such signs and their neighbours are stored. A token of
a kind with probability from ADD on is part of a span unless it overlaps a base span; neighbours of one kind form one
span, which must have as many digits as its kind needs.

Weights are trained here: unary weights by gradient descent, the chain by counts, the skip links by pseudo-likelihood over
pairs of places with one number, all from sentences with marked tokens made with a fixed seed from the patterns' formats and from look-alikes (numbers failing Luhn, dates, prices, versions).

Nothing is shuffled. Defined results: null counts as the empty text without spans; texts of any length are scanned whole in
linear time; repeated rows are scanned each by itself; an empty table gives an empty result; extra columns are ignored;
equal starts are ordered by kind.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows, map_batches

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 6
ADD = 0.9
LAST_DIGITS = 7

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
_ORDER = {k: i for i, k in enumerate(KINDS)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern: the local part reaches back from each @ as far as it can."""
    out, at, floor = [], text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        if m:
            a = at
            while a > floor and text[a - 1] in LOCAL:
                a -= 1
            if a < at:
                out.append((a, m.end()))
                floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """By kind, then start."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if not SIGN.search(text):
        return out
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _features(token: str) -> list[int]:
    """The numbers of a token's own features, below WIDTH."""
    digits = "".join(re.findall("[0-9]", token))
    n = len(digits)
    core = token.strip(".,;:!?()[]{}<>\"'*$%&#|")
    f = [0]
    f.append(1 + min(n, 20))
    f.append(22 + min(core.count("."), 4))
    f.append(27 + min(core.count("-"), 4))
    f.append(32 + ("@" in token) + ("@" in token and "." in token.rpartition("@")[2]))
    f.append(35 + token.startswith("+"))
    f.append(37 + (token.startswith("(") or ")" in token))
    f.append(39 + core.isdigit())
    f.append(41 + any(c.isalpha() for c in core))
    f.append(43 + (13 <= n <= 19 and luhn(digits)))
    f.append(45 + (bool(IP.fullmatch(core)) and all(len(x) < 4 for x in core.split("."))))
    f.append(47 + (":" in core or "/" in core))
    f.append(49 + (n > 0 and n * 3 >= len(core) * 2))
    return f


WIDTH = 51


def _rows(tokens: list[str]) -> np.ndarray:
    own = np.zeros((len(tokens) + 2, WIDTH))
    for i, t in enumerate(tokens):
        own[i + 1, _features(t)] = 1
    return np.hstack([own[1:-1], own[:-2], own[2:]])


def _train_data(rng: random.Random) -> list[tuple[list[str], list[int]]]:
    word = lambda: "".join(rng.choice(["an", "the", "er", "ing", "re", "ci", "men", "lich", "que", "o"]) for _ in range(rng.randint(1, 4)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(ok: bool) -> str:
        while True:
            s = num(rng.choice([13, 15, 16, 16, 16, 19]))
            if luhn(s) == ok:
                return s

    def entity() -> tuple[list[str], int]:
        k = rng.randrange(10)
        if k < 2:
            return [f"{word()}{rng.choice(['.', '_', ''])}{rng.choice(['', num(2)])}@{word()}{rng.choice(['', num(1)])}.{rng.choice(['com', 'org', 'example.com'])}"], 1
        if k < 4:
            return [".".join(str(rng.randrange(256)) for _ in range(4))], 2
        if k == 4:
            c = card(True)
            return [c if rng.random() < 0.6 else ".".join(c[i : i + 4] for i in range(0, len(c), 4))], 3
        if k < 7:
            return rng.choice([[f"+{num(1)}", f"({num(3)})", f"{num(3)}-{num(4)}"], [f"+{num(2)}", num(3), num(6)], [f"+{num(11)}"], [f"({num(3)})", f"{num(3)}-{num(4)}"], [f"{num(3)}-{num(3)}-{num(4)}"], [f"{num(3)}.{num(3)}.{num(4)}"], [f"0{num(3)}", num(6)]]), 4
        return rng.choice([[card(False)], [f"20{num(2)}-{num(2)}-{num(2)}"], [f"{num(2)}.{num(2)}"], [num(rng.randint(1, 8))], [f"v{num(1)}.{num(1)}.{num(1)}"], [f"{num(3)}.{num(2)}.{num(1)}"], [f"{word()}@"], ["@" + word()], [word() + num(2)], [num(40)], [f'"{num(2)}{word()}{num(6)}{word()}"'], [f"{num(2)}:{num(2)}"], [f"{num(3)}-{num(4)}"]]), 0

    out = []
    for _ in range(2500):
        tokens, labels = [], []
        for _ in range(rng.randint(1, 3)):
            for _ in range(rng.randint(1, 3)):
                tokens.append(word() + rng.choice(["", "", "", ",", "."]))
                labels.append(0)
            t, k = entity()
            tokens += [*t[:-1], t[-1] + rng.choice(["", "", ".", ",", "!!", "***"])]
            labels += [k] * len(t)
        tokens.append(word())
        labels.append(0)
        out.append((tokens, labels))
    return out


def _twice(rng: random.Random) -> list[tuple[list[str], list[int], list[int]]]:
    """Sentences with a number that stands twice: tokens, labels, and the two places. What a bare number is, only the other
    place tells."""
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    out = []
    for _ in range(800):
        d, area = num(7), num(3)
        bare = rng.choice([[d], [f"{d[:3]}-{d[3:]}"], [f"0{area}", d], [f"{area}{d}"]])
        if rng.random() < 0.6:
            first, label = rng.choice([["+49", area, d], [f"+1{area}{d}"], [f"({area})", f"{d[:3]}-{d[3:]}"]]), 4
        else:
            first, label = rng.choice([[f"#{d}"], [f"{area}{d}"], [d]]), 0
        words = ["the", "ing", *first, "er", "que", *bare, "re"]
        at = [1 + len(first), 3 + len(first) + len(bare)]
        other = label if rng.random() < 0.95 else 4 - label  # a number may be two things
        labels = [0, 0, *[label] * len(first), 0, 0, *[other] * len(bare), 0]
        out.append((words, labels, at))
    return out


def _skip_weight(w: np.ndarray) -> float:
    """The log potential of equal labels at linked places, by pseudo-likelihood: each place given the label of the other."""
    u, y, z = [], [], []
    for tokens, labels, at in _twice(random.Random(20240503)):
        own = _rows(tokens)[at] @ w
        for a, b in ((0, 1), (1, 0)):
            u.append(own[a])
            y.append(labels[at[a]])
            z.append(labels[at[b]])
    u, y, z, s = np.array(u), np.array(y), np.array(z), 0.0
    for _ in range(100):
        e = u.copy()
        e[np.arange(len(z)), z] += s
        p = np.exp(e - e.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True))[np.arange(len(z)), z]
        s += ((y == z) - p).mean() / max(1e-6, (p * (1 - p)).mean() + 1e-3)
    return float(np.clip(s, 0, 8))


@cache
def weights() -> tuple[np.ndarray, np.ndarray, float]:
    """Unary weights (features x labels), chain potentials (labels x labels), and the skip links' potential of equal labels."""
    data = _train_data(random.Random(20240502))
    x = np.vstack([_rows(t) for t, _ in data])
    y = np.concatenate([np.array(k) for _, k in data])
    pairs = np.ones((5, 5))
    for _, k in data:
        for a, b in zip(k, k[1:]):
            pairs[a, b] += 1
    chain = np.log(pairs * pairs.sum() / np.outer(pairs.sum(1), pairs.sum(0)))
    w, seen = np.zeros((x.shape[1], 5)), np.zeros((x.shape[1], 5))
    target = np.eye(5)[y]
    for _ in range(150):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ (p - target) / len(y) + 1e-5 * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen + 1e-8)
    return w, np.clip(chain, -2, 2) * 0.5, _skip_weight(w)


def propagate(unary: np.ndarray, chain: list[tuple[int, int]], skip: list[tuple[int, int]], potential: np.ndarray, equal: float) -> np.ndarray:
    """Label probabilities by loopy belief propagation. unary: tokens x labels, logs; links: pairs of tokens."""
    edges = np.array(chain + skip, np.int64).reshape(-1, 2)
    n, k = unary.shape
    if not len(edges):
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    same = np.eye(k) * equal
    pot = np.stack([potential] * len(chain) + [same] * len(skip))
    both = np.concatenate([pot, pot.transpose(0, 2, 1)])  # of the sender's label by the receiver's
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    msg = np.zeros((len(src), k))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = belief[src] - msg[back]
        z = out[:, :, None] + both
        top = z.max(1)
        new = top + np.log(np.exp(z - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        msg = 0.5 * msg + 0.5 * new
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that only the field finds."""
    starts: list[tuple[int, int]] = []
    seen = -1
    for m in SIGN.finditer(text):  # tokens with a sign
        if m.start() < seen:
            continue
        a = m.start()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        b = TOKEN.match(text, a).end()
        starts.append((a, b))
        seen = b
    covered = sorted((a, b, k) for a, b, k in base)
    free = False
    label = []
    i = 0
    for a, b in starts:
        while i < len(covered) and covered[i][1] <= a:
            i += 1
        hit = covered[i] if i < len(covered) and covered[i][0] < b else None
        label.append(_ORDER[hit[2]] + 1 if hit else 0)
        free = free or hit is None
    if not free:
        return []
    w, potential, equal = weights()
    tokens = [text[a:b] for a, b in starts]
    own = np.zeros((len(tokens), WIDTH))
    for i, t in enumerate(tokens):
        own[i, _features(t)] = 1
    x = np.hstack([own, np.zeros_like(own), np.zeros_like(own)])
    chain = []
    for i in range(len(tokens) - 1):
        if text[starts[i][1] : starts[i + 1][0]].isspace():  # neighbours
            chain.append((i, i + 1))
            x[i, 2 * WIDTH :] = own[i + 1]
            x[i + 1, WIDTH : 2 * WIDTH] = own[i]
    plain = np.zeros(WIDTH)
    plain[_features("a")] = 1
    for i in range(len(tokens)):  # other neighbours have no signs
        if not x[i, WIDTH : 2 * WIDTH].any() and starts[i][0] > 0:
            x[i, WIDTH : 2 * WIDTH] = plain
        if not x[i, 2 * WIDTH :].any() and starts[i][1] < len(text):
            x[i, 2 * WIDTH :] = plain
    unary = x @ w
    groups: dict[str, list[int]] = defaultdict(list)
    for i, t in enumerate(tokens):
        core = t.strip(".,;:!?()[]{}<>\"'*$%&#|").lower()
        digits = "".join(re.findall("[0-9]", core))
        if core and (len(digits) >= LAST_DIGITS or "@" in core):
            groups["=" + core].append(i)
        if len(digits) >= LAST_DIGITS and not any(c.isalpha() for c in core):
            groups[digits[-LAST_DIGITS:]].append(i)
    skip = []
    for own_group in groups.values():
        skip += list(zip(own_group, own_group[1:]))
        skip += [(own_group[0], j) for j in own_group[2:]]
    known = np.array(label)
    fixed = known > 0
    unary[fixed] = -30.0
    unary[fixed, known[fixed]] = 0.0
    p = propagate(unary, chain, sorted(set(skip)), potential, equal)
    out: list[tuple[int, int, str]] = []
    linked = {j for _, j in chain}
    for i in np.flatnonzero(~fixed).tolist():
        k = int(p[i, 1:].argmax()) + 1
        if p[i, k] < ADD:
            continue
        a, b = starts[i]
        while a < b and text[a] in ".,;:!?[]{}<>\"'*$%&#|":
            a += 1
        while b > a and text[b - 1] in ".,;:!?[]{}<>\"'*$%&#|":
            b -= 1
        if a == b:
            continue
        if out and i in linked and out[-1][2] == KINDS[k - 1] and text[out[-1][1] : a].isspace():
            out[-1] = (out[-1][0], b, out[-1][2])
        else:
            out.append((a, b, KINDS[k - 1]))
    return [x for x in out if _plausible(text[x[0] : x[1]], x[2])]


def _plausible(text: str, kind: str) -> bool:
    """Whether an added span has as many signs as its kind needs."""
    digits = sum("0" <= c <= "9" for c in text)
    return {"email": "@" in text, "ip": 4 <= digits <= 12, "card": 13 <= digits <= 19, "phone": LAST_DIGITS <= digits <= 15 and bool(re.search("[0-9]{3}", text))}[kind]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for a, b, k in spans])


_EMPTY = hashlib.sha256(b"").hexdigest()


def scan_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    arrow_rows(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, shas, spans = {k: [] for k in KINDS}, [], []
        for t in b.column(1).to_pylist():
            base, added = [], []
            if t and SIGN.search(t):
                base = base_spans(t)
                added = added_spans(t, base)
            for k, c in counts.items():
                c.append(sum(x[2] == k for x in base) if base else 0)
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest() if base else _EMPTY)
            spans.append(joined(sorted(base + added, key=lambda x: (_ORDER[x[2]], x[0]))))
        cols = [b.column(0), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(shas, pa.string()), pa.array(spans, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
