"""HTML main-text extraction with per-host wrappers: union-free regular expressions inferred by alignment.

Each page's token stream is folded: consecutive repeats of a token group become one repeated group, texts are held as
literals. The wrapper of a host is the alignment of its pages' streams, taken one after the other: where texts differ
a text slot arises, where tokens are missing on one side an optional group, where they recur a repeated group. Tasks
align the pages they read, so that a host's pages need not meet; the few distinct partial wrappers are aligned in turn.
The wrapper says which texts are the host's template. A page's main text is then read from its article (or else from
what is not furniture), block by block, without the blocks that are template.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkwell.llm.common import checkpointed

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("head title nav footer aside form script style noscript template iframe svg math button select option textarea input object embed canvas audio video dialog menu noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
_CLASS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|login|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|toc|share|sharing|social|related|recommend(?:ed|ations?)?|comments?|commentlist|replies|reply|disqus|"
    r"discussion|footer|masthead|widgets?|pagination|pager|paging|skip|toolbar|paywall|disclaimer)(?:$|[\s_-])",
    re.I,
)
_HEADER_CLASS = re.compile(r"(?:^|[\s_-])(?:header|site-?title|topbar|top-?bar)(?:$|[\s_-])", re.I)
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|articlebody|post-?body|body-?text)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_NEXT = re.compile(r"<(?:(?=[!?/a-zA-Z]))")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str] | str]]:
    """("text", "", text), ("open", name, attributes), ("close", name, {}). Comments and raw contents give nothing."""
    at, n = 0, len(page)
    while at < n:
        m = _NEXT.search(page, at)
        if m is None:
            yield "text", "", html.unescape(page[at:])
            return
        lt = m.start()
        if lt > at:
            yield "text", "", html.unescape(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1] in "!?":
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        t = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if t is None:
            if page[lt + 1] == "/" and page[lt + 2 : lt + 3] not in ("", *"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            return  # cut off inside a tag
        name, at = t[2].lower(), t.end()
        if t[1]:
            yield "close", name, {}
            continue
        attrs = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(t[3])} if t[3].strip(" /") else {}
        yield "open", name, attrs
        if name in RAW or name in ("title", "textarea"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if name == "title":
                yield "text", "", html.unescape(page[at : end.start() if end else n])
            if end is None:
                return
            at = end.start()


def furniture(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether an element is a menu, page header, footer, sidebar, notice, advert, form, comment section or hidden."""
    if name in FURNITURE or (name == "header" and not in_article):
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
        return True
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    return bool(_CLASS.search(named)) or (not in_article and bool(_HEADER_CLASS.search(named)))


def label_of(name: str, attrs: dict[str, str]) -> str:
    return name + "".join(f".{c}" for c in sorted(attrs["class"].split())) if attrs.get("class") else name


def blocks(page: str, template: set[int]) -> list[tuple[int, bool, bool, str]]:
    """Text blocks outside furniture, in order: (region, linked, all its texts are template, text). Region 2: article or
    main; 1: content box; 0: else."""
    out: list[tuple[int, bool, bool, str]] = []
    buf: list[str] = []
    linked = length = 0
    fixed = True
    stack: list[tuple[str, bool, int, str]] = []  # name, furniture here or above, region, label
    off, region = False, 0

    def end_block():
        nonlocal linked, length, fixed
        if buf:
            text = " ".join("".join(buf).split())
            if text:
                out.append((region, length > 0 and linked * 10 >= length * 6, fixed, text))
            buf.clear()
        linked = length = 0
        fixed = True

    def pop():
        nonlocal off, region
        name = stack[-1][0]
        if name in BLOCK:
            end_block()
        stack.pop()
        off, region = (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    for kind, name, x in tokens(page):
        if kind == "text":
            if not off:
                buf.append(x)
                size = len(x.strip())
                length += size
                fixed = fixed and (not size or bool(template) and placed(stack[-1][3] if stack else "", text_key(" ".join(x.split()))) in template)
                if any(s[0] == "a" for s in stack):
                    linked += size
        elif kind == "open":
            if name == "br" or name == "img":
                buf.append(" ")
                continue
            if name in BLOCK:
                end_block()
            if name in CLOSES_P and any(s[0] == "p" for s in stack):
                for k in range(len(stack) - 1, -1, -1):  # a paragraph ends where a block begins, with what was open in it
                    if stack[k][0] == "p":
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][0] in BLOCK:
                        break
            if name in ("li", "dt", "dd", "option", "tr", "td", "th"):
                same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in same:
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select", "tr" if name in ("td", "th") else "table"):
                        break
            if name in VOID:
                continue
            gone = off or furniture(name, x, region == 2)
            here = region
            if not gone:
                if name in ("article", "main") or x.get("role") == "main":
                    here = 2
                elif here == 0 and x and name in ("div", "section", "td") and _CONTENT.search(f"{x.get('class', '')} {x.get('id', '')}"):
                    here = 1
            if gone and not off or here != region:
                end_block()
            stack.append((name, gone, here, label_of(name, x)))
            off, region = gone, here
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in ("article", "main", "body", "table", "td") and name not in BLOCK:
                    break
    while stack:
        pop()
    end_block()
    return out


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def placed(label: str, key: int) -> int:
    """The key of a text directly in an element of that label."""
    return text_key(label) ^ key


# Wrapper nodes: ["#", quantifier, literal key or None for a slot] or [label, quantifier, children]; "()" labels a group.
# Quantifiers: "" once, "?" optional, "+" repeated, "*" both.


def _either(a: str, b: str) -> str:
    opt, rep = a in ("?", "*") or b in ("?", "*"), a in ("+", "*") or b in ("+", "*")
    return ("*" if rep else "?") if opt else ("+" if rep else "")


def _optional(node: list) -> list:
    return [node[0], _either(node[1], "?"), node[2]]


def fold(nodes: list[list]) -> list[list]:
    """Find repeated groups: k nodes (up to three) that recur at once, labels alike, become one repeated node or group."""
    for k in (1, 2, 3):
        out: list[list] = []
        i = 0
        while i < len(nodes):
            labels = [x[0] for x in nodes[i : i + k]]
            j = i + k
            if len(labels) == k and (k > 1 or labels[0] != "#") and len(set(labels)) == k and set(labels) != {"#"}:
                while [x[0] for x in nodes[j : j + k]] == labels:
                    j += k
            if j > i + k:
                unit = nodes[i : i + k]
                for at in range(i + k, j, k):
                    unit = align(unit, nodes[at : at + k])
                out.append([unit[0][0], _either(unit[0][1], "+"), unit[0][2]] if k == 1 else ["()", "+", unit])
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def merge(a: list, b: list) -> list:
    if a[0] == "#":
        return ["#", _either(a[1], b[1]), a[2] if a[2] == b[2] else None]
    return [a[0], _either(a[1], b[1]), align(a[2], b[2])]


def align(a: list[list], b: list[list]) -> list[list]:
    """Align two streams by their longest common subsequence of labels; what has no partner becomes optional."""
    la, lb = [x[0] for x in a], [x[0] for x in b]
    if la == lb:
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for x, y in [*common(la, lb), (len(a), len(b))]:
        out += [*map(_optional, a[i:x]), *map(_optional, b[j:y])]
        if x < len(a):
            out.append(merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return fold(out)


def common(a: list[str], b: list[str], cells: int = 10_000) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. Only streams of at most ``cells`` pairs get a whole table; longer ones are
    halved where the two sides' lengths add up to the most, so that memory stays in proportion to the streams."""
    out: list[tuple[int, int]] = []

    def table(i0: int, i1: int, j0: int, j1: int) -> None:
        n, m = i1 - i0, j1 - j0
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i0 + i] == b[j0 + j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < n and j < m:
            if a[i0 + i] == b[j0 + j]:
                out.append((i0 + i, j0 + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1

    def split(i0: int, i1: int, j0: int, j1: int) -> None:
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        tail = 0
        while i0 < i1 - tail and j0 < j1 - tail and a[i1 - tail - 1] == b[j1 - tail - 1]:
            tail += 1
        n, m = i1 - tail - i0, j1 - tail - j0
        if n == 1 and m:
            if a[i0] in (right := b[j0 : j0 + m]):
                out.append((i0, j0 + right.index(a[i0])))
        elif n and m and n * m <= cells:
            table(i0, i0 + n, j0, j0 + m)
        elif n and m:
            left, right, at = a[i0 : i0 + n], b[j0 : j0 + m], n // 2
            k = int((prefix_lengths(left[:at], right) + prefix_lengths(left[at:][::-1], right[::-1])[::-1]).argmax())
            split(i0, i0 + at, j0, j0 + k)
            split(i0 + at, i0 + n, j0 + k, j0 + m)
        out.extend((i1 - t, j1 - t) for t in range(tail, 0, -1))

    split(0, len(a), 0, len(b))
    return out


def prefix_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``, by whole-row bit operations."""
    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    masks = {x: sum(1 << j for j in at) for x, at in places.items() if len(at) > 8}  # rare ones are made when needed
    full = row = (1 << len(b)) - 1
    for x in a:
        if x in places:
            hit = row & (masks[x] if x in masks else sum(1 << j for j in places[x]))
            row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(b) + 7) // 8 or 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def stream(page: str, max_depth: int = 64) -> list[list]:
    """The page's tokens as nested nodes, repeats folded; texts of any length are literals."""
    root: list[list] = []
    stack: list[tuple[str, list[list]]] = [("", root)]

    def pop():
        _, kids = stack.pop()
        kids[:] = fold(kids)

    for kind, name, x in tokens(page):
        if kind == "text":
            if text := " ".join(x.split()):
                stack[-1][1].append(["#", "", text_key(text)])
        elif kind == "open":
            if name in CLOSES_P or name in ("li", "tr", "td", "th"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p" or (stack[k][0] == name and name in ("li", "tr", "td", "th")):
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][0] in BLOCK:
                        break
            node = [label_of(name, x), "", []]
            stack[-1][1].append(node)
            if name not in VOID and len(stack) < max_depth:
                stack.append((name, node[2]))
        else:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop()
                    break
    while len(stack) > 1:
        pop()
    return fold(root)


def literals(nodes: list[list], sure: bool = True) -> set[int]:
    """Keys of the texts that every page of the wrapper has, letter for letter, at the same place."""
    out: set[int] = set()
    for label, quantifier, x in nodes:
        here = sure and quantifier in ("", "+")
        if label == "#":
            if here and x is not None:
                out.add(x)
        else:
            out |= literals(x, here)
    return out


def placed_literals(nodes: list[list], parent: str = "", sure: bool = True) -> set[int]:
    """:func:`literals`, each with the label of the element that it stands in."""
    out: set[int] = set()
    for label, quantifier, x in nodes:
        here = sure and quantifier in ("", "+")
        if label != "#":
            out |= placed_literals(x, parent if label == "()" else label, here)
        elif here and x is not None:
            out.add(placed(parent, x))
    return out


def expression(nodes: list[list]) -> str:
    """The wrapper as a regular expression over tags, ``#text`` literals and ``#PCDATA`` slots."""
    parts = []
    for label, quantifier, x in nodes:
        if label == "#":
            parts.append(("#PCDATA" if x is None else "#text") + quantifier)
        else:
            inner = expression(x)
            body = inner if label == "()" else f"<{label}>{inner}</{label.split('.')[0]}>"
            parts.append(f"({body}){quantifier}" if quantifier else body)
    return "".join(parts)


WRAPPER = "host string, n_pages long, wrapper string"


def infer_wrappers(pages: DataFrame, host: Column, html_col: str = "html", max_hosts_held: int = 5000, max_depth: int = 64, fan: int = 64) -> DataFrame:
    """One wrapper (JSON of its nodes) and page count per host; null hosts and pages count as the empty text.

    Tasks hold at most ``max_hosts_held`` partial wrappers. Equal partial wrappers of a host meet as one row, and a host
    with many different ones has them aligned about ``fan`` at a time first, so that a host with a third of all pages
    brings no task more than that. Elements deeper than ``max_depth`` are aligned as siblings.
    """
    src = pages.select(F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    names = ["host", "n_pages", "wrapper"]

    def batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], names=names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in batches:
            for h, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                nodes = stream(page, max_depth)
                old = held.get(h)
                held[h] = [1, nodes] if old is None else [old[0] + 1, align(old[1], nodes)]
                if len(held) >= max_hosts_held:
                    yield batch([(k, n, json.dumps(w)) for k, (n, w) in held.items()])
                    held = {}
        yield batch([(k, n, json.dumps(w)) for k, (n, w) in held.items()])

    def whole(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in names), strict=True), key=lambda r: r[2])
        nodes = json.loads(rows[0][2])
        for _, _, other in rows[1:]:
            nodes = align(nodes, json.loads(other))
        return pa.table({"host": [rows[0][0]], "n_pages": [sum(r[1] for r in rows)], "wrapper": [json.dumps(nodes)]})

    parts = checkpointed(src.mapInArrow(partial, WRAPPER).groupBy("host", "wrapper").agg(F.sum("n_pages").alias("n_pages")).select(*names))
    many = parts.groupBy("host").agg(F.ceil(F.count("*") / fan).alias("salts")).where("salts > 1")
    split = parts.join(many, "host").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.col("salts"))).drop("salts")
    some = split.groupBy("host", "salt").applyInArrow(lambda t: whole(t.drop_columns(["salt"])), WRAPPER)
    return parts.join(many, "host", "left_anti").unionByName(some).groupBy("host").applyInArrow(whole, WRAPPER)


def template_keys(wrappers: DataFrame, min_pages: int = 8) -> DataFrame:
    """``(host, template)``: placed keys of the texts that are template at hosts of at least ``min_pages`` pages; on fewer
    pages, texts alike are as likely copies of an article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [sorted(placed_literals(json.loads(w))) for w in b.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(keys, pa.list_(pa.int64()))], names=["host", "template"])

    return wrappers.where(F.col("n_pages") >= min_pages).select("host", "wrapper").mapInArrow(run, "host string, template array<long>")


def main_text(page: str, template: set[int]) -> str:
    """The article's blocks, or the content box's, or else those not mostly links; blocks that are template go.

    An article that is all template stays: its host has nothing but copies, and the wrapper cannot tell.
    """
    found = blocks(page, template)
    top = max((r for r, _, _, _ in found), default=0)
    if not top:
        return "\n\n".join(t for _, linked, fixed, t in found if not linked and not fixed)
    own = [t for r, _, fixed, t in found if r == top and not fixed]
    return "\n\n".join(own or [t for r, _, _, t in found if r == top])


def extract(
    pages: DataFrame, carry: list[str] | None = None, url_col: str = "url", html_col: str = "html", min_pages: int = 8, max_depth: int = 64, max_broadcast_bytes: int = 32 << 20
) -> DataFrame:
    """Add ``text``, the main text of every page (empty if it has none; a null page is empty), to the ``carry`` columns.

    A carried column named ``text`` is replaced. Rows repeat as they do in the input; an empty table gives no rows. The
    hosts' templates go to the pages while they have at most ``max_broadcast_bytes``; beyond that, pages meet their host's
    template in a shuffle join, which Spark splits for a host with very many pages.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))
    keys = checkpointed(template_keys(infer_wrappers(pages, host, html_col, max_depth=max_depth), min_pages).withColumnRenamed("host", "__host"))
    size = keys.agg(F.sum(F.size("template") * 8 + F.octet_length("__host") + 100)).first()[0] or 0
    keys = F.broadcast(keys) if size <= max_broadcast_bytes else keys.hint("merge")
    carry = [c for c in (carry if carry is not None else pages.columns) if c != "text"]
    src = pages.withColumn("__host", host).join(keys, "__host", "left").select(*carry, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html"), "template")
    schema = T.StructType([src.schema[c] for c in carry] + [T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h, set(k or ())) for h, k in zip(b.column("__html").to_pylist(), b.column("template").to_pylist(), strict=True)]
            cols = [*(b.column(c) for c in carry), pa.array([t.encode("utf-8", "replace").decode() for t in text], pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) for i, c in enumerate(cols)], schema=arrow)

    return src.mapInArrow(run, schema)
