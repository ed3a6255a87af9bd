r"""Secret scan: fixed patterns, and probabilistic automata inferred from labelled credentials.

Base spans come from three patterns (leftmost, non-overlapping, failing matches dropped): assign, access and hex. Besides,
every maximal run of credential characters (`[A-Za-z0-9+/_=-]`, MIN_CANDIDATE or more) of the whole text is a candidate.
For each credential format an automaton is inferred: labelled examples make a prefix tree with counts, whose states are
merged in red-blue order when the Hoeffding bound finds their outgoing and final frequencies, and those of all their
successors, compatible. A candidate is scored by its mean log likelihood a character under the best automaton minus that
under a background model of ordinary words, numbers, names of files and addresses; from THRESHOLD on it is a span of the
format's kind unless a base span overlaps it. Credentials behind a name, in a path or before a suffix are
looked for inside every run: parts that begin where a literal prefix of a format occurs or, for the format without one,
behind a sign, and end before a sign or with the run; of overlapping ones, the
run among them, that with the largest log likelihood ratio stays.
The format without a prefix has no more characters than its longest example. Labelled examples are made here from the public descriptions of the formats
with a fixed seed, EXAMPLES a format, so the model is small, the same everywhere, and needs no pass over the data.

Nothing is shuffled. Defined results: null counts as the empty text, which has no spans; texts of any length are scanned
whole, in time proportional to their length; repeated rows are scanned each by itself; an empty table gives an empty
result; extra columns are ignored. Equal starts are ordered by kind as in KINDS.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows, map_batches

EXAMPLES = 300
ALPHA = 0.05
MIN_CANDIDATE = 16
THRESHOLD = 0.6

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}")
#: Signs of a run; a part begins behind one and ends before one.
SIGNS = frozenset("+/_=-")
PREFIXES = {
    "ghp_": "vcs", "gho_": "vcs", "ghs_": "vcs", "ghu_": "vcs", "glpat-": "lab", "xoxb-": "chat", "xoxp-": "chat", "xoxa-": "chat",
    "sk_live_": "pay", "rk_live_": "pay", "pk_live_": "pay", "AIza": "maps", "eyJ": "jwt", "npm_": "npm",
    "github_pat_": "vcs", "sk-proj-": "model", "hf_": "model", "dop_v1_": "cloud", "shpat_": "shop", "pypi-": "pypi",
}
_PREFIX = re.compile("|".join(sorted(PREFIXES, key=len, reverse=True)))
_STARTS = frozenset(p[:k] for p in PREFIXES for k in range(1, len(p) + 1))
_BEHIND = re.compile(rf"(?<=[+/_=-])(?=[A-Za-z0-9+/]{{{MIN_CANDIDATE}}})")
LONGEST = 44
WORDS = ("passw", "secret", "token", "apikey", "api_key")

_UP, _LOW, _DIG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _UP + _LOW + _DIG


def examples(rng: random.Random) -> dict[str, list[str]]:
    """Labelled credentials by format, after public descriptions."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    b64 = _ALNUM + "+/"
    url = _ALNUM + "-_"
    made = {
        "vcs": lambda: rng.choice(["ghp_", "gho_", "ghs_", "ghu_"]) + pick(_ALNUM, 36) if rng.random() < 0.8 else "github_pat_" + pick(_ALNUM, 22) + "_" + pick(_ALNUM, 59),
        "lab": lambda: "glpat-" + pick(url, 20),
        "chat": lambda: rng.choice(["xoxb-", "xoxp-", "xoxa-"]) + pick(_DIG, 12) + "-" + pick(_DIG, 12) + "-" + pick(_ALNUM, 24),
        "pay": lambda: rng.choice(["sk_live_", "rk_live_", "pk_live_"]) + pick(_ALNUM, rng.choice([24, 24, 32])),
        "maps": lambda: "AIza" + pick(url, 35),
        "jwt": lambda: "eyJ" + pick(url, rng.randint(30, 60)),
        "npm": lambda: "npm_" + pick(_ALNUM, 36),
        "model": lambda: "sk-proj-" + pick(url, rng.randint(20, 64)) if rng.random() < 0.6 else "hf_" + pick(_ALNUM, 34),
        "cloud": lambda: "dop_v1_" + pick(_DIG + "abcdef", 64),
        "shop": lambda: "shpat_" + pick(_DIG + "abcdef", 32),
        "pypi": lambda: "pypi-" + pick(url, rng.randint(60, 90)),
        "key64": lambda: pick(b64, 40) if rng.random() < 0.5 else pick(b64, 43) + "=",
    }
    return {kind: [f() for _ in range(EXAMPLES)] for kind, f in made.items()}


def ordinary(rng: random.Random) -> list[str]:
    """Labelled strings that are no credentials."""
    syllables = ["an", "the", "er", "ion", "ing", "st", "re", "en", "ou", "ci", "men", "te", "ver", "lich", "que", "eau", "o", "a", "i", "es"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 9)))
    out = []
    for _ in range(3000):
        w = word()
        out.append(rng.choice([w, w, w.capitalize(), w.upper(), f"{w}-{word()}", f"{w}_{word()}_{word()}", f"/{w}/{word()}/{word()}", f"{w}{rng.randint(0, 9999)}", f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", "-" * rng.randint(3, 60), "=" * rng.randint(3, 60), "_" * rng.randint(3, 40), str(rng.randint(0, 10**18))]))
    return out


def symbols(text: str) -> list[str]:
    """What begins a literal prefix as it is, then classes: digits, a-f, g-z, A-F, G-Z, and signs as they are."""
    k = 0
    while text[: k + 1] in _STARTS and k < len(text):
        k += 1
    return [*text[:k], *text[k:].translate(_CLASS)]


_CLASS = {ord(c): k for chars, k in ((_DIG, "0"), ("abcdef", "f"), ("ghijklmnopqrstuvwxyz", "z"), ("ABCDEF", "F"), ("GHIJKLMNOPQRSTUVWXYZ", "Z")) for c in chars}


class Automaton:
    """A probabilistic automaton by state merging."""

    def __init__(self, samples: list[list[str]], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.final: list[int] = [0]
        for s in samples:
            q = 0
            for c in s:
                self.count[q][c] = self.count[q].get(c, 0) + 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.final.append(0)
                q = self.next[q][c]
            self.final[q] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, blue = [0], list(self.next[0].values())
        while blue:
            b = blue.pop(0)
            for r in red:
                if self._compatible(r, b):
                    self._merge(red, r, b)
                    break
            else:
                red.append(b)
            known = set(red)
            blue = list(dict.fromkeys(t for q in red for t in self.next[q].values() if t not in known))
        self.red = red
        self.log: dict[int, dict[str, float]] = {}
        self.end: dict[int, float] = {}
        for q in red:
            n = self._n(q)
            self.log[q] = {c: math.log(k / n) for c, k in self.count[q].items()}
            self.end[q] = math.log(self.final[q] / n) if self.final[q] else -math.inf

    def _n(self, q: int) -> int:
        return self.final[q] + sum(self.count[q].values())

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, r: int, b: int) -> bool:
        todo = [(r, b)]
        while todo:
            r, b = todo.pop()
            n, m = self._n(r), self._n(b)
            if not n or not m:
                continue
            if self._differ(self.final[r], n, self.final[b], m):
                return False
            for c in self.count[r].keys() | self.count[b].keys():
                if self._differ(self.count[r].get(c, 0), n, self.count[b].get(c, 0), m):
                    return False
                if c in self.next[r] and c in self.next[b]:
                    todo.append((self.next[r][c], self.next[b][c]))
        return True

    def _merge(self, red: list[int], r: int, b: int) -> None:
        for q in red:
            for c, t in self.next[q].items():
                if t == b:
                    self.next[q][c] = r
        todo = [(r, b)]
        while todo:  # b is the root of a tree
            r, b = todo.pop()
            self.final[r] += self.final[b]
            for c, k in self.count[b].items():
                self.count[r][c] = self.count[r].get(c, 0) + k
                if c in self.next[r]:
                    todo.append((self.next[r][c], self.next[b][c]))
                else:
                    self.next[r][c] = self.next[b][c]

    def score(self, s: list[str]) -> float:
        """The log likelihood; minus infinity where the format forbids the string."""
        q, total = 0, 0.0
        for c in s:
            p = self.log[q].get(c)
            if p is None:
                return -math.inf
            total += p
            q = self.next[q][c]
        return total + self.end[q]


class Background:
    """First-order chain over the same symbols, with one added to every count."""

    def __init__(self, samples: list[list[str]]):
        self.pair: dict[tuple[str, str], int] = {}
        self.one: dict[str, int] = {}
        for s in samples:
            for a, b in zip(["^", *s], s):
                self.pair[a, b] = self.pair.get((a, b), 0) + 1
                self.one[a] = self.one.get(a, 0) + 1

    def step(self, a: str, b: str) -> float:
        return math.log((self.pair.get((a, b), 0) + 1) / (self.one.get(a, 0) + 70))

    def score(self, s: list[str]) -> float:
        return sum(self.step(a, b) for a, b in zip(["^", *s], s))


@cache
def models() -> tuple[dict[str, Automaton], Background]:
    rng = random.Random(20240501)
    found = {k: Automaton([symbols(x) for x in v]) for k, v in examples(rng).items()}
    return found, Background([symbols(x) for x in ordinary(rng)])


FORMATS = ("vcs", "lab", "chat", "pay", "maps", "jwt", "npm", "model", "cloud", "shop", "pypi", "key64")
KINDS = ("assign", "access", "hex", *FORMATS)
_ORDER = {k: i for i, k in enumerate(KINDS)}


def classify(token: str) -> str | None:
    """The format of a candidate, or None."""
    found, background = models()
    s = symbols(token)
    best, kind = -math.inf, None
    for k, a in found.items():
        if (p := a.score(s)) > best:
            best, kind = p, k
    if kind is None or (best - background.score(s)) / len(s) < THRESHOLD:
        return None
    return kind


def _ends(token: str, begin: int, kind: str) -> list[tuple[float, int, int, str]]:
    """(log likelihood ratio, begin, end, kind) of the parts of a run from begin on that reach the threshold."""
    found, background = models()
    a = found[kind]
    q, ratio, last, out = 0, 0.0, "^", []
    for n, c in enumerate(symbols(token[begin : begin + LONGEST] if kind == "key64" else token[begin:]), 1):
        p = a.log[q].get(c)
        if p is None:
            break
        ratio += p - background.step(last, c)
        q, last, end = a.next[q][c], c, begin + n
        if n >= MIN_CANDIDATE and (end == len(token) or token[end] in SIGNS) and (ratio + a.end[q]) / n >= THRESHOLD:
            out.append((ratio + a.end[q], begin, end, kind))
    return out


def parts(token: str, taken: list[tuple[int, int]], least: float = 0.0) -> list[tuple[int, int, str]]:
    """Credentials inside a run, as begin, end and format, with a ratio above least; none overlaps another or a taken place."""
    found = [x for m in _PREFIX.finditer(token) for x in _ends(token, m.start(), PREFIXES[m[0]])]
    found += [x for m in _BEHIND.finditer(token) for x in _ends(token, m.start(), "key64")]
    taken, out = list(taken), []
    for ratio, a, b, kind in sorted(found, key=lambda x: (-x[0], x[1:])):
        if ratio > least and not any(x < b and a < y for x, y in taken):
            taken.append((a, b))
            out.append((a, b, kind))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], _ORDER[x[2]]))


def all_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    added = []
    for m in CANDIDATE.finditer(text):
        token = m[0]
        if token.isalpha() and (token.islower() or token[1:].islower() or token.isupper()):
            continue  # one case, letters only: no automaton reaches the threshold on it, as tests show
        at = m.start()
        taken = [(a - at, b - at) for a, b, _ in base if a < m.end() and at < b]
        kind = None if taken else classify(token)
        least = 0.0
        if kind:
            found, background = models()
            s = symbols(token)
            least = found[kind].score(s) - background.score(s)
        inner = parts(token, taken, least)
        if kind and not inner:
            added.append((*m.span(), kind))
        added += [(at + a, at + b, k) for a, b, k in inner]
    return sorted(base + added, key=lambda x: (x[0], _ORDER[x[2]])) if added else base


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for a, b, k in spans])


_EMPTY = hashlib.sha256(b"").hexdigest()


def scan_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans."""
    arrow_rows(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, shas, spans = {k: [] for k in KINDS[:3]}, [], []
        for t in b.column(1).to_pylist():
            base = base_spans(t) if t else []
            for k, c in counts.items():
                c.append(sum(x[2] == k for x in base) if base else 0)
            shas.append(hashlib.sha256(joined(base).encode()).hexdigest() if base else _EMPTY)
            spans.append(joined(all_spans(t, base)) if t else "")
        cols = [b.column(0), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(shas, pa.string()), pa.array(spans, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
