"""Main text of web pages by union-free wrapper inference.

Pages of one host are aligned into one wrapper, a regular expression without unions over tags and text slots: tags that
only some pages have become optional groups, neighbours that repeat become repeated groups. Texts that are equal in the same
slot of most of the host's different pages are template text; texts that differ are slots. The slots outside page furniture are
chosen once for the host, on its wrapper; every page gives its own texts in them, without template text, narrowed to
its own article or main element, so templates that share a host do not decide for each other.

Scale: a page is first folded by itself, so that its form no longer depends on how many paragraphs or links it has. Equal
forms of a host are counted once (map-side), and the distinct forms are aligned in rounds of groups of bounded size, so
that a host with a third of all pages is not one task's work. Only then do pages meet their host's wrapper, in an
ordinary join that can be split where a host is hot.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobspark.session import materialize

#: Forms of a host that are aligned in one task.
AT_ONCE = 64
#: A block is template text where it stands in the same slot of at least this share of a host's different pages, and of this many.
TEMPLATE_SHARE = 0.8
TEMPLATE_PAGES = 8

# Elements by kind, and the words in a class, id or role that name page furniture.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select".split())
FURNITURE = frozenset("head nav footer aside form menu dialog button label".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Elements that hold the text of a page: words in their class tell of parts inside, not of them.
WHOLE = frozenset("html body main article".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("article main section div body ul ol dl table tbody thead tfoot tr td th blockquote figure html".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


def _label(name: str, attrs: str) -> str:
    """An element's name, with what its attributes say: ``!`` for furniture (``!!`` if hidden), or its first class."""
    first, furniture = "", int(name in FURNITURE)
    for key, value in _ATTR.findall(attrs) if attrs.strip() else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            furniture = 2
        elif key in ("class", "id", "role"):
            words = _SPLIT.split(value)
            if name not in WHOLE and not WORDS.isdisjoint(words):
                furniture = max(furniture, 1)
            first = first or next((w for w in words if w), "")
    return f"{name}.{first}" + "!" * furniture


def walk(html: str) -> Iterator[tuple[str, tuple[str, ...]]]:
    """Texts of a page with the labels of the elements around them, and an empty text at every block's edge."""
    stack: list[str] = []
    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            yield unescape(html[at:stop]), tuple(stack)
        if not m:
            return
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].partition(".")[0] == name:
                    del stack[k:]
                    break
            yield "", tuple(stack)
            continue
        if name in INLINE:
            continue
        if name == "br":
            yield " ", tuple(stack)
            continue
        if name in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
            continue
        # a paragraph ends where another block begins; list and table cells end where the next begins
        while stack:
            top = stack[-1].partition(".")[0]
            if top == "p" or top in CLOSES.get(name, ()) or top not in HOLDS and top == name:
                stack.pop()
            else:
                break
        if name not in VOID:
            stack.append(_label(name, m[3]))
        yield "", tuple(stack)


# A form is a label and a list of parts [times, form]; times is 1 (once), ? (at most once), + (once or more), * (any number).
# A text slot has the label #; a repeated group of several neighbours has the label ().


def _merge_times(a: str, b: str) -> str:
    least, many = a in "?*" or b in "?*", a in "+*" or b in "+*"
    return ("*" if least else "+") if many else ("?" if least else "1")


def _sign(form: list) -> str:
    return form[0] if form[0] != "()" else "(" + " ".join(_sign(p[1]) for p in form[1]) + ")"


def _join(a: list, b: list) -> list:
    return [a[0], _align(a[1], b[1])]


def _fold(parts: list) -> list:
    """Neighbours that repeat become one repeated part: single ones, then groups of two to four."""
    out: list = []
    for times, form in parts:
        if out and _sign(out[-1][1]) == _sign(form):
            out[-1] = ["*" if out[-1][0] in "?*" and times in "?*" else "+", _join(out[-1][1], form)]
        else:
            out.append([times, form])
    for size in (2, 3, 4):
        i = 0
        while i + 2 * size <= len(out):
            one, two = out[i : i + size], out[i + size : i + 2 * size]
            if [_sign(p[1]) for p in one] == [_sign(p[1]) for p in two]:
                group = ["()", _align(one, two)]
                j = i + 2 * size
                while [_sign(p[1]) for p in out[j : j + size]] == [_sign(p[1]) for p in one]:
                    group = ["()", _align(group[1], out[j : j + size])]
                    j += size
                out[i:j] = [["+", group]]
            i += 1
    return out


def _align(a: list, b: list) -> list:
    """Two lists of parts as one: common parts in order are joined, the others become optional."""
    sa, sb = [_sign(p[1]) for p in a], [_sign(p[1]) for p in b]
    if sa == sb:
        return [[_merge_times(x[0], y[0]), _join(x[1], y[1])] for x, y in zip(a, b)]
    common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            common[i][j] = common[i + 1][j + 1] + 1 if sa[i] == sb[j] else max(common[i + 1][j], common[i][j + 1])
    out, i, j = [], 0, 0
    loose = lambda p: ["?" if p[0] in "1?" else "*", p[1]]
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and sa[i] == sb[j]:
            out.append([_merge_times(a[i][0], b[j][0]), _join(a[i][1], b[j][1])])
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and common[i + 1][j] >= common[i][j + 1]:
            out.append(loose(a[i]))
            i += 1
        else:
            out.append(loose(b[j]))
            j += 1
    return _fold(out)


def page_form(html: str) -> list:
    """A page as a folded form."""
    root: list = ["", []]
    open_: list[tuple[str, list]] = []
    for text, path in walk(html):
        depth = 0
        while depth < len(open_) and depth < len(path) and open_[depth][0] == path[depth]:
            depth += 1
        if not text and depth == len(path) and len(open_) == len(path) and path:
            depth -= 1  # an element of the same label begins again
        del open_[depth:]
        for label in path[depth:]:
            form = [label, []]
            (open_[-1][1] if open_ else root)[1].append(["1", form])
            open_.append((label, form))
        if text.strip():
            (open_[-1][1] if open_ else root)[1].append(["1", ["#", []]])

    def fold(form: list) -> list:
        return [form[0], _fold([[t, fold(f)] for t, f in form[1]])]

    return fold(root)


def slots(form: list, path: tuple[str, ...] = ()) -> set[tuple[str, ...]]:
    """The paths of all text slots of a wrapper."""
    out = set()
    for _, f in form[1]:
        if f[0] == "#":
            out.add(path)
        else:
            out |= slots(f, path if f[0] == "()" else (*path, f[0]))
    return out


def _names(path: tuple[str, ...]) -> list[str]:
    return [label.partition(".")[0] for label in path]


def furniture(path: tuple[str, ...], forms: bool = True) -> bool:
    """Whether a path leads through page furniture; a form around a main or article element is none, nor any if ``forms`` is false."""
    names, inside = _names(path), False
    for k, (label, name) in enumerate(zip(path, names)):
        around = name == "form" and not label.endswith("!!") and (not forms or not {"article", "main"}.isdisjoint(names[k + 1 :]))
        if label.endswith("!") and not around or name == "header" and not inside:
            return True
        inside |= name in ("article", "main")
    return False


def article_slots(wrapper: list) -> list[str]:
    """The slots that can hold an article: not inside page furniture."""
    return sorted("\x1f".join(p) for p in slots(wrapper) if not furniture(p, forms=False))


def _container(texts: list[tuple[str, tuple[str, ...]]]) -> set[tuple[str, ...]]:
    """The paths of one page's article: in its article elements, unless those are small beside its main element or the page."""
    size: dict[tuple[str, ...], int] = {}
    for text, path in texts:
        size[path] = size.get(path, 0) + len(text.strip())
    size = {p: n for p, n in size.items() if n}
    every = {p for p in size if not furniture(p)} or set(size)  # else the page is wrapped in one form
    article, main = ({p for p in every if name in _names(p)} for name in ("article", "main"))
    length = lambda paths: sum(size[p] for p in paths)
    if article and (2 * length(article) >= length(main) if main else 4 * length(article) >= length(every)):
        return article
    return main or every


def article_blocks(html: str, chosen: frozenset[str] | None = None) -> list[tuple[str, str]]:
    """The blocks in the chosen slots (all that are not furniture if None) and the page's container: slot and text, one blank for white space."""
    found, known = list(walk(html)), {}
    for _, path in found:
        if path not in known:
            known[path] = not furniture(path, forms=False) if chosen is None else "\x1f".join(path) in chosen
    inside = _container([(t, p) for t, p in found if t and known[p]])
    blocks: list[list[str]] = [[]]
    slot: list[str] = [""]
    for text, path in found:
        if not text:
            blocks.append([])
            slot.append("")
        elif path in inside:
            if text.strip() and not slot[-1]:
                slot[-1] = "\x1f".join(path) or "\x1f"
            blocks[-1].append(text)
    return [(p, " ".join("".join(b).split())) for p, b in zip(slot, blocks) if b and not all(t.isspace() for t in b)]


def block_key(slot: str, text: str) -> int:
    """A block's 64-bit hash, signed as Spark holds it."""
    h = xxhash.xxh64_intdigest(f"{slot}\x1e{text}".encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def main_text(html: str, chosen: frozenset[str], template: frozenset[int] = frozenset()) -> str:
    """The blocks of a page that are not template text, joined by one blank."""
    return " ".join(text for slot, text in article_blocks(html, chosen) if not template or block_key(slot, text) not in template)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def infer_wrappers(pages: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """``(host, wrapper)`` (JSON) for every host of pages ``(host, html)``."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["host"], pa.array([json.dumps(page_form(h), ensure_ascii=False) for h in b["html"].to_pylist()], pa.string())], names=["host", "wrapper"])

    def aligned(t: pa.Table) -> pa.Table:
        found = sorted(t["wrapper"].to_pylist())
        whole = json.loads(found[0])
        for f in found[1:]:
            whole = _join(whole, json.loads(f))
        return pa.table({"host": [t["host"][0].as_py()], "wrapper": [json.dumps(whole, ensure_ascii=False)]})

    cur = materialize(pages.mapInArrow(forms, "host string, wrapper string").groupBy("host", "wrapper").count().drop("count"))
    while True:
        sizes = cur.groupBy("host").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return cur
        groups = F.ceil(F.col("n") / at_once)
        dealt = cur.join(sizes, "host").withColumn("g", F.pmod(F.xxhash64("wrapper"), groups))
        cur = materialize(dealt.groupBy("host", "g").applyInArrow(aligned, "host string, wrapper string").distinct())


def template_texts(pages: DataFrame, share: float = TEMPLATE_SHARE, fewest: int = TEMPLATE_PAGES) -> DataFrame:
    """``(host, template)``: the keys of a host's template texts, for hosts of pages ``(host, html)`` that have any.

    Pages whose blocks are all equal count once, so copies of an article make nothing of it template text. A host has at most ``1 / share``
    times as many template texts as a page has blocks on average. Only keys are shuffled, counted in the tasks first; rare ones end there.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({block_key(*x) for x in article_blocks(h)}) for h in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["host"], pa.array(found, pa.list_(pa.int64()))], names=["host", "found"])

    once = materialize(pages.mapInArrow(keys, "host string, found array<bigint>").where("size(found) > 0").groupBy("host", F.xxhash64("found").alias("page")).agg(F.first("found").alias("found")))
    different = once.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= fewest)
    counts = once.select("host", F.explode("found").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)
    common = counts.join(different, "host").where(F.col("n") >= F.ceil(F.col("pages") * share))
    return common.groupBy("host").agg(F.collect_list("key").alias("template"))


def extract(pages: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row, text`` for every page of ``(url, html)``; the columns named by ``carry`` (``page_id, url`` if none) come back in ``row``.

    Defined cases: null or empty HTML gives an empty text; a null or odd URL belongs to the host '' (which has no template text, as its
    pages need not share one); unclosed elements end where HTML lets them end; repeated pages give repeated rows; an empty table gives no rows.
    """
    d = pages.select(F.struct(*[F.col(f"`{c}`") for c in (carry or ["page_id", "url"])]).alias("row"), host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    wrappers = infer_wrappers(d.select("host", "html"))
    template = template_texts(d.where("host <> ''").select("host", "html"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["host"], pa.array([article_slots(json.loads(w)) for w in b["wrapper"].to_pylist()], pa.list_(pa.string()))], names=["host", "slots"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chosen, constant = None, frozenset(), frozenset()
        for b in batches:
            out = []
            for html, *s in zip(b["html"].to_pylist(), b["slots"], b["template"]):
                if s != last:
                    last, chosen, constant = s, frozenset(s[0].as_py()), frozenset(s[1].as_py() or ())
                out.append(main_text(html, chosen, constant))
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(out, pa.string())], names=["row", "text"])

    chosen = wrappers.mapInArrow(choose, "host string, slots array<string>")
    # stored, so that its size is known: pages are only shuffled where the hosts' table is too large to send to every task
    per_host = materialize(chosen.join(template, "host", "left"))
    full = d.join(per_host, "host").select("row", "html", "slots", "template")
    return full.mapInArrow(texts, f"row {d.schema['row'].dataType.simpleString()}, text string")
