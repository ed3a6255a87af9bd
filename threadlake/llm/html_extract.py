"""HTML extraction by union-free regular expressions inferred for each host.

A page becomes a stream of tags and texts. Consecutive equal groups of tokens collapse into a repeated group. A host's
wrapper is found by aligning its pages' streams one after the other: equal tokens stay, differing texts become a text slot,
tokens that only one side has become an optional group, and a group repeated on one side stays repeated. Wrappers fold
within each Arrow batch first, then within PARTS parts of a host, then for the host, so a host with a third of all pages is
no larger for any task. A wrapper also sums, for each container path, text and link text of the pages.

The wrapper decides what is extracted. A host's main region is the deepest container path that holds most of the slot
text, outside links and constant texts, of all its pages, widened to the `article` or `main` around it. Texts in the region
that the alignment found constant on all of at least ALIKE different pages are dropped too, unless they are a large part of it, as on
hosts that serve one page only. Hosts without slots (one page, or equal pages) use `article`, `main` or the body. Inside the
region, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go by their tag, role
or whole class names.

Regions are broadcast when they and their marks are at most BROADCAST; beyond that pages and wrappers are joined by host, where only hosts
with a large share of all pages, which are few, are broadcast.

Defined results: null and empty html give the empty text; broken markup is read on: an unclosed element ends with the
element around it, an unclosed tag at the end of a page is dropped; pages without a host form one group; a page without its
host's main region is extracted from its whole body; pages of any length are read whole; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import difflib
import hashlib
import html as _html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, join_unique, map_batches, materialize

PARTS = 32
BROADCAST = 2000
#: Items of a repeated group at most; a longer one stays as it is, its repetitions as optional groups.
MAX_UNIT = 64
#: Longer texts are known by their hash.
CONSTANT = 80
#: Different pages of a host from which on constant texts are dropped, and the share of the region's text that they stay below.
ALIKE = 4
CONSTANT_SHARE = 0.2

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'<>]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|(?=<)|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_RAW = frozenset(("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "object", "math"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"))
_DROP = frozenset(("head", "nav", "header", "footer", "aside", "form", "button", "select", "input", "dialog", "menu"))
_PLACE = r"(?:(?:site|page|main|top|bottom|global|primary|secondary|left|right|sub)[-_]?)?"
#: Whole names, among those that white space separates.
_DROP_WORDS = re.compile(
    rf"(?:^|\s){_PLACE}(?:ads?|adv|advert\w*|adsense|ad[-_](?:slot|unit|box|banner|container|wrapper)|banner|sponsor\w*|promo\w*|cookies?(?:[-_](?:notice|banner|consent|bar))?|consent|gdpr|notices?|popup|modal|overlay|side[-_]?bar|nav|navbar|navigation|nav[-_]?(?:menu|bar|links)|menu|breadcrumbs?|footer|header|masthead|"
    r"comments?|comments?[-_]?(?:list|section|area|form|thread|box|body|wrap|wrapper|container|respond)|disqus(?:[-_]thread)?|replies|respond|share|sharing|share[-_](?:bar|buttons|links)|social|social[-_](?:bar|links|share|media)|related(?:[-_](?:posts?|articles?|links|stories))?|recommend\w*|newsletter(?:[-_]\w+)?|subscribe|signup|login|toolbar|pagination|pager|skip(?:[-_]link)?|widget|byline[-_]share|contentinfo|complementary|search(?:[-_](?:form|box|bar))?)(?=\s|$)",
    re.I,
)
_CLOSES = {  # an element that begins ends these, when they are the innermost open ones
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_P_ENDS = frozenset(("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"))
_SCOPE = frozenset(("article", "section", "div", "main", "td", "th", "li", "body", "html", "nav", "footer", "header", "aside", "form", "table", "blockquote"))
_SPACES = re.compile(r"\s+")


def stream(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) in page order: 's' a start tag with its attributes, 'e' an end tag, 't' a text."""
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            if page[at:].strip():
                yield "t", "", page[at:]
            return
        if m.start() > at:
            yield "t", "", page[at : m.start()]
        at = max(m.end(), at + 1)
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            yield "e", name, ""
            continue
        attributes = m[3] if m[2] else m[6]
        if name in _RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        yield "s", name, attributes or ""


def label(name: str, attributes: str) -> str:
    """A start tag as a token: the name with class, id and role."""
    if not attributes:
        return name
    named = [f"{k.lower()}={v.strip(chr(34) + chr(39))}" for k, v in _NAMED.findall(attributes)]
    return f"{name}[{' '.join(named)}]" if named else name


def dropped(name: str, attributes: str) -> bool:
    if name in _DROP:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        found = name == "article" and attributes and re.search(r"comment|reply", attributes, re.I)
        return bool(found)
    return any(_DROP_WORDS.search(v.strip("\"'")) for _, v in _NAMED.findall(attributes))


def _below(paths: list, lab: str):
    """The container path of a new element, of any depth, as a running hash over its labels: its size doesn't grow with depth."""
    if not paths:
        return hashlib.blake2b(lab.encode(errors="replace"), digest_size=16)
    h = paths[-1].copy()
    h.update(b">" + lab.encode(errors="replace"))
    return h


def _rolled(own: dict[str, list]) -> dict[str, list]:
    """Adds each container's sums, the first two values, to its parent's, the third; parents come before what they contain."""
    for r in reversed(own.values()):
        if r[2]:
            up = own[r[2]]
            up[0] += r[0]
            up[1] += r[1]
    return own


class Open:
    """The open elements of a page; open() and close() say which elements ended."""

    def __init__(self) -> None:
        self.names: list[str] = []

    def start(self, name: str) -> int:
        """Closes what the element ends by beginning, and returns the depth that is left."""
        ends = ("p",) if name in _P_ENDS else _CLOSES.get(name, ())
        if ends:
            for i in range(len(self.names) - 1, -1, -1):
                if self.names[i] in ends:
                    del self.names[i:]
                    if name != "tr":
                        break
                elif self.names[i] in _SCOPE:
                    break
        return len(self.names)

    def end(self, name: str) -> int:
        for i in range(len(self.names) - 1, -1, -1):
            if self.names[i] == name:
                del self.names[i:]
                break
            if name in _INLINE and self.names[i] in _SCOPE:
                break
        return len(self.names)


#: An item of an expression: (token, None, optional), or ("+", unit, optional) for a repeated group. Tokens are "<" with a
#: start tag's label, ">" with an end tag's name, "#" for a text slot and "#..." for a constant text or its length and hash.
Item = tuple[str, "list[Item] | None", int]


def constant(text: str) -> str:
    """The token of a text, its white space joined."""
    if len(text) <= CONSTANT:
        return "#" + text
    return f"#\0{len(text)}:{hashlib.blake2b(text.encode(errors='replace'), digest_size=12).hexdigest()}"


def _size(token: str) -> int:
    """Characters of a constant text."""
    return int(token[2:].partition(":")[0]) if token[1:2] == "\0" else len(token) - 1


def skeleton(page: str) -> tuple[list[Item], dict[str, list]]:
    """A page's expression, and for each container path text and link characters, the path above and the label."""
    tokens: list[Item] = []
    own: dict[str, list] = {}
    open_ = Open()
    paths: list = []
    keys: list[str] = []
    link = 0
    for kind, name, rest in stream(page):
        if kind == "t":
            text = _SPACES.sub(" ", rest).strip()
            if not text:
                continue
            n = len(text)
            tokens.append((constant(text), None, 0))
            if keys:
                r = own[keys[-1]]
                r[0] += n
                r[1] += n * link
        elif kind == "s":
            lab = label(name, rest)
            tokens.append(("<" + lab, None, 0))
            if name in _VOID:
                continue
            depth = open_.start(name)
            del paths[depth:], keys[depth:]
            open_.names.append(name)
            paths.append(_below(paths, lab))
            key = paths[-1].hexdigest()
            if key not in own:
                own[key] = [0, 0, keys[-1] if keys else "", lab]
            keys.append(key)
            link = int(name == "a" or (link and "a" in open_.names))
        else:
            tokens.append((">" + name, None, 0))
            depth = open_.end(name)
            del paths[depth:], keys[depth:]
            link = int(link and "a" in open_.names)
    regions = {k: r for k, r in _rolled(own).items() if r[0]}
    for _ in range(4):  # groups of groups
        n = len(tokens)
        tokens = collapse(tokens)
        if len(tokens) == n:
            break
    return tokens, regions


def _shape(item: Item) -> str:
    """What two items must share to be aligned."""
    token, unit, _ = item
    if unit is not None:
        return "(" + " ".join(map(_shape, unit)) + ")"
    return "#" if token[0] == "#" else token


def _same(x: Item, y: Item) -> Item:
    """Two items of equal shape as one."""
    if x[1] is not None:
        return ("+", list(map(_same, x[1], y[1])), x[2] | y[2])
    return (x[0] if x[0] == y[0] else "#", None, x[2] | y[2])


def collapse(items: list[Item]) -> list[Item]:
    """Consecutive equal groups of up to MAX_UNIT items as one repeated group, those of the fewest items first."""
    shapes = list(map(_shape, items))
    known: dict[str, int] = {}
    shapes = [known.setdefault(x, len(known)) for x in shapes]
    out: list[Item] = []
    i, n = 0, len(items)
    while i < n:
        for u in range(1, min(MAX_UNIT, (n - i) // 2) + 1):
            if shapes[i] == shapes[i + u] and shapes[i : i + u] == shapes[i + u : i + 2 * u]:
                unit, j = items[i : i + u], i + u
                while shapes[j : j + u] == shapes[i : i + u]:
                    unit = list(map(_same, unit, items[j : j + u]))
                    j += u
                out.append(("+", unit, 0))
                i = j
                break
        else:
            out.append(items[i])
            i += 1
    return out


def _either(items: list[Item]) -> list[Item]:
    return [(t, u, 1) for t, u, _ in items]


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The expression that matches what either matches; neighbouring optional items are an optional group."""
    x, y = list(map(_shape, a)), list(map(_shape, b))
    if x == y:
        return list(map(_same, a, b))
    out: list[Item] = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            out += map(_same, a[i:j], b[k:m])
        elif j - i == 1 and a[i][1] is not None and list(map(_shape, a[i][1])) == y[k:m]:  # one repetition
            out.append(("+", list(map(_same, a[i][1], b[k:m])), a[i][2]))
        elif m - k == 1 and b[k][1] is not None and list(map(_shape, b[k][1])) == x[i:j]:
            out.append(("+", list(map(_same, b[k][1], a[i:j])), b[k][2] | max(q[2] for q in a[i:j])))
        else:
            out += _either(a[i:j]) + _either(b[k:m])
    return out


def fold(a: dict | None, b: dict) -> dict:
    if a is None:
        return b
    if a["items"] != b["items"]:
        a["items"] = align(a["items"], b["items"])
    a["n"] += b["n"]
    a["seen"] = sorted({*a["seen"], *b["seen"]})[:ALIKE]
    for k, v in b["regions"].items():
        r = a["regions"].setdefault(k, [0, 0, 0, *v[3:]])
        for i in range(3):
            r[i] += v[i]
    return a


def wrapper_of(page: str) -> dict:
    items, regions = skeleton(page)
    seen = hashlib.blake2b(page.encode(errors="replace"), digest_size=12).hexdigest()
    return {"n": 1, "seen": [seen], "items": items, "regions": {k: [1, *v] for k, v in regions.items()}}


def _load(text: str) -> dict:
    w = json.loads(text)
    w["items"] = _tuples(w["items"])
    return w


def _tuples(items: list) -> list[Item]:
    return [(t, None if u is None else _tuples(u), o) for t, u, o in items]


def constants(items: list[Item]) -> tuple[dict[str, int], list[tuple[list[str], str]]]:
    """Characters of constant texts below each container path of a wrapper; and the constants that every page has, each
    with the paths around it."""
    own: dict[str, list] = {}
    names: list[str] = []
    paths: list = []
    keys: list[str] = []
    always: list[tuple[list[str], str]] = []

    def walk(items: list[Item], sure: bool) -> None:
        for token, unit, optional in items:
            if unit is not None:
                walk(unit, sure and not optional)
            elif token[0] == "<":
                name = token[1:].partition("[")[0]
                if name not in _VOID:
                    names.append(name)
                    paths.append(_below(paths, token[1:]))
                    key = paths[-1].hexdigest()
                    own.setdefault(key, [0, 0, keys[-1] if keys else ""])
                    keys.append(key)
            elif token[0] == ">":
                for i in range(len(names) - 1, -1, -1):
                    if names[i] == token[1:]:
                        del names[i:], paths[i:], keys[i:]
                        break
            elif len(token) > 1 and keys:
                own[keys[-1]][0] += _size(token)
                if sure and not optional:
                    always.append((list(keys), token))

    walk(items, True)
    return {k: r[0] for k, r in _rolled(own).items() if r[0]}, always


def _mark(path: str, token: str) -> str:
    return hashlib.blake2b(f"{path}{token}".encode(errors="replace"), digest_size=12).hexdigest()


def main_region(w: dict) -> tuple[str, list[str]]:
    """The label of the main region's element: a path, article, main, or nothing for the body; and the marks of constant texts in it."""
    regions = w["regions"]
    fixed, always = constants(w["items"])
    mass, depth, apart = {}, {"": 0}, {"": False}
    for k, (_, text, link, up, lab) in regions.items():
        name, _, named = lab.partition("[")
        depth[k] = depth[up] + 1
        apart[k] = apart[up] or name in _DROP or bool(_DROP_WORDS.search(re.sub(r"\w+=", " ", named.rstrip("]"))))
        if not apart[k] and name not in _INLINE and name not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tbody", "tr", "td", "blockquote", "pre"):
            mass[k] = text - 2 * link - fixed.get(k, 0) * w["n"]
    best, path = max(mass.values(), default=0), ""
    for k in sorted((k for k, v in mass.items() if v > 0 and v >= 0.8 * best), key=lambda k: (depth[k], regions[k][4], k)):
        up = k
        while depth[up] > depth[path]:
            up = regions[up][3]
        if up == path:
            path = k
    labels, keys = [], []
    while path:
        labels.append(regions[path][4])
        keys.append(path)
        path = regions[path][3]
    labels.reverse()
    keys.reverse()
    for wanted in ("article", "main"):  # the outermost around the path
        at = next((i for i, x in enumerate(labels) if x.partition("[")[0] == wanted), None)
        if at is not None:
            labels, keys = labels[: at + 1], keys[: at + 1]
            break
    if not labels or labels[-1].partition("[")[0] in ("html", "body"):
        for name in ("article", "main"):
            if 2 * max((v[0] for v in regions.values() if v[4].partition("[")[0] == name), default=0) >= w["n"]:
                return name, []
        return "", []
    drop = [(p, t) for p, t in always if keys[-1] in p] if len(w["seen"]) >= ALIKE else []
    if sum(_size(t) for _, t in drop) * w["n"] > CONSTANT_SHARE * regions[keys[-1]][1]:
        drop = []
    return ">".join(labels), sorted({_mark(p[-1], t) for p, t in drop})


def extract(page: str | None, region: str, marks: frozenset[str] = frozenset()) -> str:
    """The main text of a page, its blocks joined by a line feed, without the constant texts of its region."""
    if not page:
        return ""
    found = list(stream(page))
    named = region in ("article", "main")
    if region:
        inside = _blocks(found, region, named, marks)
        if inside is not None:
            return inside
    if not named:
        for name in ("article", "main"):
            inside = _blocks(found, name, True)
            if inside is not None:
                return inside
    return _blocks(found, "", True) or ""


def _blocks(found: list[tuple[str, str, str]], region: str, named: bool, marks: frozenset[str] = frozenset()) -> str | None:
    out: list[str] = []
    piece: list[str] = []
    open_ = Open()
    paths: list = []
    place = _below([], region).digest()
    inside = 0 if not region else -1  # depth of the region's element
    drop = -1  # depth of the dropped element
    dropping = ""
    met = not region

    def flush() -> None:
        if piece:
            text = _SPACES.sub(" ", "".join(piece)).strip()
            if text:
                out.append(text)
            piece.clear()

    def left(depth: int) -> None:
        nonlocal inside, drop
        del paths[depth:]
        if drop >= depth:
            drop = -1
        if region and inside >= depth:
            inside = -1
            flush()

    for kind, name, rest in found:
        if kind == "t":
            if inside >= 0 and drop < 0:
                if marks and paths and _mark(paths[-1].hexdigest(), constant(_SPACES.sub(" ", rest).strip())) in marks:
                    rest = " "
                piece.append(_html.unescape(rest))
            continue
        if name not in _INLINE:
            flush()
        if kind == "e":
            left(open_.end(name))
            continue
        if name in _VOID:
            continue
        if drop >= 0 and region in ("article", "main") and name == region and not met and dropping in ("nav", "header", "div", "menu"):
            del open_.names[drop:]
            left(drop)
        depth = open_.start(name)
        left(depth)
        open_.names.append(name)
        lab = label(name, rest)
        paths.append(_below(paths, lab))
        if drop < 0 and dropped(name, rest):
            drop, dropping = depth, name
            flush()
        elif drop < 0 and inside < 0 and (name == region if named else paths[-1].digest() == place):
            inside, met = depth, True
    flush()
    return "\n".join(out) if met else None


def host_of(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per host: region, marks of constant texts, and n, the number of its pages; column wrapper holds the expression as JSON."""
    arrow_rows(pages.sparkSession)

    def per_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        own: dict[str, dict] = {}
        known: dict[tuple[str, str], dict] = {}
        for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = wrapper_of(page or "")
            key = (h, " ".join(map(_shape, w["items"])))
            if key in known:  # the shape of a page before
                fold(known[key], w)
            else:
                known[key] = w
        for (h, _), w in known.items():
            own[h] = fold(own.get(h), w)
        return pa.RecordBatch.from_arrays([pa.array(list(own)), pa.array([json.dumps(w) for w in own.values()]), pa.array([w["n"] for w in own.values()], pa.int64())], names=["host", "wrapper", "n"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        w = None
        for text in sorted(group["wrapper"]):
            w = fold(w, _load(text))
        region, marks = main_region(w)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(w)], "n": [w["n"]], "region": [region], "marks": [marks]})

    schema = "host string, wrapper string, n bigint, region string, marks array<string>"
    parts = map_batches(pages.select(host_of(url_col).alias("host"), F.col(html_col)), per_batch, "host string, wrapper string, n bigint")
    parts = parts.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)))
    halves = parts.groupBy("host", "part").applyInPandas(merge, schema)
    return halves.groupBy("host").applyInPandas(merge, schema)


def extract_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars."""
    found = materialize(wrappers(pages, url_col, html_col), "wrappers").select("host", "region", "marks", "n")
    total, hosts = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)) + F.coalesce(F.sum(F.size("marks")), F.lit(0))).head()
    rows = pages.select(id_col, url_col, html_col, host_of(url_col).alias("host"))
    if hosts <= BROADCAST:
        rows = rows.join(F.broadcast(found), "host", "left")
    else:
        rows = join_unique(rows, found, "host", "n", total)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(p, r or "", frozenset(m or ())) for p, r, m in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return map_batches(rows.select(id_col, url_col, html_col, "region", "marks"), run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")
