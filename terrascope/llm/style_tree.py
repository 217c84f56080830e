"""Main text of web pages by a style tree per site.

A page is parsed into block elements (``Page``).  Every page goes through the style
tree of its host: the elements of all pages of the host are merged by their path of
tags and class names, and every merged node gets an importance from two entropies:

* presentation: a node whose children differ from page to page matters, one that
  always looks alike does not;
* content: a text block that spreads evenly over the pages that have the node is
  a template, one that few pages hold matters.

On a page, ``imp(E) = (1 - g**l) * presentation(E) + g**l * mean(imp of the parts of
E)`` with ``l`` styles of ``E`` on the host and ``g = 0.9``.  Largest branches in which
every node stays below the threshold are removed (not if nothing would be left).
Logarithms use base ``pages + 2``, so two pages alone prove no template.

Names weigh in.  A branch named as no part of the article (``nav``, ``footer``, class
``ad`` ...), or outside the article of a page that names one, has weight 0: a node of the
tree whose importance is 0.  The prose of a named article (headings, paragraphs and such
right in it) has importance 1: copies of an article on a host are no template.  Other
elements in a named article are judged by their entropies (a notice that all articles of
the host hold goes), unless most blocks of the article are shared by the host's pages:
then the article as a whole is a copy.

Spark merges the trees by aggregating (path, style or block) counts; only counts, the
rows of pages with a block of too little importance, and the lists of branches to remove
are shuffled, and the pages that have such a list.  (A block that few pages hold has an
importance above the threshold and so have all elements around it, so on the other pages
nothing can be removed beyond the branches of weight 0.)  Paths and blocks that hold many
rows are joined from a small table (a key with more than a 20,000th of all rows
is hot, so there are at most 20,000), the rest by a shuffle: a hot host
does not land in one task.

Decoded, white space (Unicode) of a block is one space, ``br`` counts as such; blocks
are joined by ``\\n``.  Null and empty pages have an empty text; pages without a host
form one site.  Repeated rows and ids are pages of their own; other columns are not
read.  Unfinished tags at the end are markup; pages of any length are read whole.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascope.llm.common import ROW, hash_bitmap, in_bitmap, keep_table, number_rows, ship, stable_rows, strings

DAMPING = 0.9
THRESHOLD = 0.3
HOT_KEYS = 20_000

# Element kinds of the HTML standard, and words that name the purpose of an element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
BLOCK = frozenset("""address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table
    tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("caption legend tbody td tfoot th thead tr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SCOPE = frozenset("table td th caption button object template marquee applet".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
            "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
            "tfoot": ({"tbody", "thead", "tfoot"}, {"table"})}
NO_TEXT = frozenset("""audio button canvas datalist dialog math menu noscript object select svg template video""".split())
OFF_TAGS = frozenset("nav aside footer form search".split())
OFF_ROLES = frozenset("""alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search
    toolbar""".split())
OFF_WORDS = frozenset("""ad ads adbox adsense adslot adv advert advertisement advertising adverts alert aside banner
    breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer form gdpr login masthead menu modal
    nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion reactions recommended
    register related replies reply respond search searchbox share sharing sidebar signin signup skiplink social sponsor
    sponsored subscribe subscription toolbar topbar widget""".split())
WRAPPER_WORDS = frozenset("banner footer form header menu modal nav navbar overlay sidebar widget".split())
PROSE = frozenset("blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup li main ol p pre summary ul".split())
ARTICLE_NAMES = frozenset("""article article-body article-content articlebody entry-content hentry post-body post-content
    story-body""".split())

_TAG = re.compile(r"""[a-zA-Z][^\s/>]*+""")
_ATTR = re.compile(r"""[\s/]*+(?:([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+)?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"[0-9]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}
_COMMENT_END = re.compile(r"--!?>")


def _attributes(text: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag from ``at`` on, and the place of its ``>`` (-1: the page ends before)."""
    found: dict[str, str] = {}
    n = len(text)
    while True:
        m = _ATTR.match(text, at)
        at = m.end()
        if m.group(1):
            name = m.group(1).lower()
            if name in ("class", "id", "role", "itemprop"):
                found.setdefault(name, m.group(2) or m.group(3) or m.group(4) or "")
        if at >= n:
            return found, -1
        if text[at] == ">":
            return found, at
        if not m.group(1) or text[at] == "=":
            at += 1                      # a stray sign, or a quote that never ends


def purpose_words(classes: list[str], whole: bool = False) -> set[str]:
    """Words of class names, lower-cased: parts at hyphens and capitals, or ``whole`` names
    only.  Names that tell of a state (``has-sidebar``) name no purpose."""
    named = [c for c in classes if not c.startswith(("has-", "no-", "with-", "is-"))]
    return {c.lower() for c in named} if whole else {w.lower() for c in named for w in _WORD.findall(c)}


@lru_cache(maxsize=4096)
def _purpose(tag: str, classes: str, ident: str, role: str, itemprop: str) -> tuple[str, str, bool, bool, bool, bool]:
    """``(tag, name, off, header, soft, article)`` of an element, see ``Page``."""
    named = (classes + " " + ident).split()
    words, role = purpose_words(named, whole=tag in ("article", "main")), role.strip().lower()
    by_tag = tag in OFF_TAGS - {"form"} or tag in NO_TEXT
    off = by_tag or tag == "form" or role in OFF_ROLES or bool(words & OFF_WORDS)
    # headers are part of an article they stand in, else of the page
    header = not off and (tag == "header" or "header" in words)
    # a wrapper's class names, or a form around the whole page, do not outweigh an article inside
    soft = not by_tag and role not in OFF_ROLES - {"form"} and words & OFF_WORDS <= WRAPPER_WORDS
    article = not off and (tag == "article" or role == "article" or itemprop == "articleBody"
                           or any(c.lower() in ARTICLE_NAMES for c in named))
    return "main" if role == "main" else tag, _DIGITS.sub("#", ".".join([tag, *named])), off, header, soft, article


class Page:
    """Block elements and text blocks of a page.

    ``parent[i]`` (-1: the page), ``name[i]`` (tag and class names, digits as ``#``),
    ``off[i]``: named as no part of the article (``header[i]``: outside one only, ``soft[i]``:
    unless it holds one), ``article[i]``: named as one, ``kids[i]``: names of element children
    (``kids[-1]`` of the page); ``blocks``: (element, text) in page order, ``dropped``: those of
    weight 0, see ``parts``."""

    def __init__(self, text: str):
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.name: list[str] = []
        self.off: list[bool] = []
        self.header: list[bool] = []
        self.soft: list[bool] = []
        self.article: list[bool] = []
        self.kids: dict[int, list[str]] = {-1: []}
        self.blocks: list[tuple[int, str]] = []
        self._parse(text)
        self._settle()

    def _element(self, tag: str, attrs: dict[str, str], up: int) -> int:
        i = len(self.parent)
        role, name, off, header, soft, article = _purpose(
            tag, attrs.get("class", ""), attrs.get("id", ""), attrs.get("role", ""), attrs.get("itemprop", ""))
        self.parent.append(up)
        self.tag.append(role)
        self.name.append(name)
        self.off.append(off)
        self.header.append(header)
        self.soft.append(soft)
        self.article.append(article)
        self.kids[i] = []
        self.kids[up].append(name)
        return i

    def _parse(self, text: str) -> None:
        stack: list[tuple[str, int]] = []      # (tag, element or -2: an inline element named as no article)
        open_tags: Counter = Counter()
        inline_off = 0
        pieces: list[str] = []
        n, at = len(text), 0

        def here() -> int:
            for _, i in reversed(stack):
                if i >= 0:
                    return i
            return -1

        def flush() -> None:
            if pieces:
                block = " ".join("".join(pieces).split())
                pieces.clear()
                if block:
                    self.blocks.append((here(), block))

        def pop_to(depth: int) -> None:
            nonlocal inline_off
            flush()
            while len(stack) > depth:
                tag, i = stack.pop()
                open_tags[tag] -= 1
                if i == -2:
                    inline_off -= 1

        def close(tags, stop) -> None:
            """Close the innermost open element of ``tags``, if none of ``stop`` lies between."""
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in tags:
                    pop_to(depth)
                    return
                if stack[depth][0] in stop:
                    return

        def say(raw: str) -> None:
            if not inline_off:
                pieces.append(htmllib.unescape(raw) if "&" in raw else raw)

        while at < n:
            lt = text.find("<", at)
            if lt < 0:
                say(text[at:])
                break
            if lt > at:
                say(text[at:lt])
            nxt = text[lt + 1:lt + 2]
            if nxt == "!" or nxt == "?":
                if text.startswith("<!--", lt):
                    if text.startswith(">", lt + 4):
                        at = lt + 5
                        continue
                    if text.startswith("->", lt + 4):
                        at = lt + 6
                        continue
                    end = _COMMENT_END.search(text, lt + 4)
                    at = end.end() if end else n
                else:
                    end = text.find(">", lt)
                    at = end + 1 if end >= 0 else n
                continue
            ending = nxt == "/"
            m = _TAG.match(text, lt + 1 + ending)
            if not m:
                if ending and lt + 2 < n:                 # a bogus comment
                    end = text.find(">", lt)
                    at = end + 1 if end >= 0 else n
                else:
                    say("<" if not ending else "</")
                    at = lt + 1 + ending
                continue
            tag = m.group().lower()
            gt = m.end()
            if text[gt:gt + 1] == ">":
                attrs = {}
            else:
                attrs, gt = _attributes(text, gt)
                if gt < 0:
                    break
            at = gt + 1
            if ending:
                if tag in ("html", "body", "head") or not open_tags[tag]:
                    if tag == "br":
                        say(" ")
                    continue
                if tag in BLOCK or tag in NO_TEXT:
                    close({tag}, SCOPE - {tag} if tag == "p" else ({"table"} if tag in SIBLINGS else ()))
                    continue
                for depth in range(len(stack) - 1, -1, -1):      # an inline element
                    if stack[depth][0] == tag:
                        if depth == len(stack) - 1 or all(i == -2 for _, i in stack[depth:]):
                            kept = pieces[:]
                            pieces.clear()
                            pop_to(depth)
                            pieces.extend(kept)
                        elif tag in FORMATTING:
                            del stack[depth]
                            open_tags[tag] -= 1
                            inline_off -= 1
                        break
                    if stack[depth][1] >= 0 and tag not in FORMATTING:
                        break
                continue
            if tag in ("html", "body", "head"):
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(text, at)
                if end is None:
                    break
                at = end.start()
                _, gt = _attributes(text, at + 2 + len(tag))
                if gt < 0:
                    break
                at = gt + 1
                continue
            if tag in VOID:
                if tag == "br":
                    say(" ")
                elif tag == "hr":
                    if open_tags["p"]:
                        close({"p"}, SCOPE)
                    flush()
                    self.kids[here()].append("hr")
                continue
            if tag in BLOCK or tag in NO_TEXT:
                if tag in CLOSES_P and open_tags["p"]:
                    close({"p"}, SCOPE)
                if tag in SIBLINGS and any(open_tags[t] for t in SIBLINGS[tag][0]):
                    inner, stop = SIBLINGS[tag]
                    if tag == "tr":
                        close({"td", "th"}, {"table", "tr"})
                        close({"tr"}, {"table"})
                    else:
                        close(inner, stop | (SCOPE - inner if tag in ("li", "dd", "dt") else set()))
                if len(tag) == 2 and tag[0] == "h" and stack and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    pop_to(len(stack) - 1)
                inner_block = tag in BLOCK or not pieces
                if inner_block:
                    flush()
                stack.append((tag, self._element(tag, attrs, here())))
                open_tags[tag] += 1
                if not inner_block:
                    # inline controls: their text goes, the text around them stays one block
                    kept, self_i = pieces[:], stack[-1][1]
                    pieces.clear()
                    at = self._skip(text, at, tag)
                    stack.pop()
                    open_tags[tag] -= 1
                    pieces.extend(kept)
                    self.off[self_i] = True
                continue
            if inline_off or (attrs and (attrs.get("role", "").lower() in OFF_ROLES or OFF_WORDS & purpose_words(
                    (attrs.get("class", "") + " " + attrs.get("id", "")).split()))):
                stack.append((tag, -2))
                open_tags[tag] += 1
                inline_off += 1
        flush()

    @staticmethod
    def _skip(text: str, at: int, tag: str) -> int:
        """The place after the end tag that closes an inline control (the page's end without one)."""
        depth = 1
        for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*+>", re.IGNORECASE).finditer(text, at):
            depth += -1 if m.group(1) else 1
            if not depth:
                return m.end()
        return len(text)

    def _settle(self) -> None:
        n = len(self.parent)
        holds = [a or (t == "main" and not o) for a, t, o in zip(self.article, self.tag, self.off)]
        for i in range(n - 1, -1, -1):
            if holds[i] and self.parent[i] >= 0 and (self.soft[i] or not self.off[i]):
                holds[self.parent[i]] = True
        self.inside, gone = [False] * n, [False] * n
        main = [False] * n
        for i in range(n):
            up = self.parent[i]
            inside_up = up >= 0 and self.inside[up]
            off = self.off[i] or (self.header[i] and not inside_up)
            if off and self.soft[i] and holds[i]:
                off = False
            gone[i] = off or (up >= 0 and gone[up])
            self.inside[i] = (inside_up or self.article[i]) and not gone[i]
            main[i] = ((up >= 0 and main[up]) or self.tag[i] == "main") and not gone[i]
        self.named = any(self.inside[i] for i, _ in self.blocks if i >= 0)
        found = self.blocks
        self.blocks = [(i, t) for i, t in self.blocks if i < 0 or not gone[i]]
        if self.named:
            self.blocks = [(i, t) for i, t in self.blocks if i >= 0 and self.inside[i]]
        elif any(i >= 0 and main[i] for i, _ in self.blocks):
            self.blocks = [(i, t) for i, t in self.blocks if i >= 0 and main[i]]
        kept = {i for i, _ in self.blocks}
        self.dropped = [(i, t) for i, t in found if i not in kept]

    def _prose(self, i: int) -> bool:
        """Text of an article right in it: only elements of prose between."""
        while not self.article[i]:
            if self.tag[i] not in PROSE:
                return False
            i = self.parent[i]
        return True

    def parts(self) -> list[tuple[int, int, int, int, int]]:
        """Rows of the style tree: ``(part, up, leaf, path, mark)``, parents first.

        Containers have the hash of their style as mark; a leaf is the run of blocks of one
        path below one container, with a row per distinct block.  A largest branch of weight 0 is one
        leaf.  ``weight`` holds 0 or 2 (prose of a named article) of leaves, else 1 (open to the tree), or
        3 (likewise, in a named article)."""
        self.run_of, self.weight = [], {}
        if not self.blocks and not self.dropped:
            return []
        paths: dict[int, bytes] = {-1: b""}
        used = {-1}
        for i, _ in self.blocks:
            while i not in used:
                used.add(i)
                i = self.parent[i]
        has_kids = {self.parent[i] for i in used if i >= 0}
        for i in sorted(used - {-1}):
            paths[i] = _digest(paths[self.parent[i]] + self.name[i].encode("utf-8", "surrogatepass"))
        out = []
        for i in sorted(used):
            if i in has_kids or i == -1:
                style = _digest("\0".join(self.kids[i]).encode("utf-8", "surrogatepass"))
                out.append((i, self.parent[i] if i >= 0 else -2, 0, _number(paths[i]), _number(style)))
        runs: dict[tuple[int, bytes], int] = {}
        seen = set()
        for i, text in self.blocks:
            own = i in has_kids or i == -1
            up, path = (i, _digest(paths[i] + b"#text")) if own else (self.parent[i], paths[i])
            run = runs.setdefault((up, path), len(self.parent) + len(runs))
            self.run_of.append(run)
            self.weight[run] = 1 if not self.named else 2 if self._prose(i) else 3
            row = (run, up, 1, _number(path), _number(_digest(text.encode("utf-8", "surrogatepass"))))
            if row not in seen:
                seen.add(row)
                out.append(row)
        low: dict[int, list[str]] = {}
        for i, text in self.dropped:
            while i not in used and self.parent[i] not in used:
                i = self.parent[i]
            low.setdefault(i, []).append(text)
        for i, texts in low.items():
            if i in used:      # text beside the article
                part, up, path = len(self.parent) + len(runs), i, _digest(paths[i] + b"#text")
                runs[(up, path + b"0")] = part
            else:
                part, up = i, self.parent[i]
                path = _digest(paths[up] + self.name[i].encode("utf-8", "surrogatepass"))
            self.weight[part] = 0
            out.append((part, up, 1, _number(path), _number(_digest("\n".join(texts).encode("utf-8", "surrogatepass")))))
        return out

    def text(self, removed: list[int] | None = None) -> str:
        """Kept blocks, without those below the ``removed`` parts."""
        if not removed:
            return "\n".join(t for _, t in self.blocks)
        self.parts()
        gone = set(removed)
        out = []
        for (i, t), run in zip(self.blocks, self.run_of):
            if run in gone:
                continue
            while i not in gone and i >= 0:
                i = self.parent[i]
            if i not in gone:
                out.append(t)
        return "\n".join(out)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; null or no ``://``: empty."""
    low = F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
                      "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low


PARTS = ["part", "up", "leaf", "weight", "path", "mark", "new_path", "new_mark"]
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def read_pages(pages: DataFrame) -> DataFrame:
    """The rows of every page, of ``(__row, url, html)``, in the style tree of its host: ``row`` of the
    page and ``PARTS``; ``path`` names a node, ``new_*`` is 1 at the first such row of the page."""
    def run(batches):
        for batch in batches:
            flat, of = [], []
            for row, source, site in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strings(batch.column(2))):
                page = Page(source)
                salt = _number(_digest(site.encode()))
                first, marked = set(), set()
                for part, up, leaf, path, mark in page.parts():
                    path ^= salt
                    flat.append((part, up, leaf, page.weight.get(part, 1), path, mark, int(path not in first),
                                 int((path, mark) not in marked)))
                    of.append(row)
                    first.add(path)
                    marked.add((path, mark))
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.int64()), *[pa.array([r[j] for r in flat], _KINDS[j]) for j in range(8)]], names=["row", *PARTS])

    fields = ", ".join(f"{name} {'long' if kind == pa.int64() else 'int'}" for name, kind in zip(PARTS, _KINDS))
    return pages.select(ROW, "html", host(F.col("url")).alias("host")).mapInArrow(run, f"row long, {fields}")


def _attach(left: DataFrame, right: DataFrame, keys: list[str], size: str, hot: float) -> DataFrame:
    """``left`` with the columns of ``right`` (one row per key, ``size`` rows of ``left``):
    keys of more than ``hot`` rows by a broadcast of that bounded list, the others by a shuffle."""
    many = right.where(F.col(size) > hot).drop(size)
    few = right.where(F.col(size) <= hot).drop(size)
    marked = left.join(F.broadcast(many.withColumn("__hot", F.lit(True))), keys, "left")
    plain = [c for c in left.columns if c not in keys]
    facts = [c for c in many.columns if c not in keys]
    columns = [*keys, *plain, *facts]
    return marked.where("__hot").select(*columns).unionByName(
        marked.where("__hot is null").select(*keys, *plain).join(few, keys).select(*columns))


def tree(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged trees: ``(marks, nodes)``.

    ``marks``: ``path, mark, k`` (pages that have it) and ``size``; ``nodes``: ``path, pages,
    styles, spread`` (entropy of the styles, base ``pages + 2``), ``size``, and ``marks`` with ``k > 1``."""
    marks = parts.groupBy("path", "mark").agg(F.sum("new_mark").alias("k"), F.sum("new_path").alias("f"),
                                              F.count("*").alias("size"))
    marks = keep_table(marks, "style-marks")
    k = F.col("k").cast("double")
    nodes = marks.groupBy("path").agg(F.sum("f").alias("pages"), F.count("*").alias("styles"), F.sum(k).alias("total"),
                                      F.sum(k * F.log(k)).alias("x"), F.sum("size").alias("size"), F.count_if(F.col("k") > 1).alias("marks"))
    spread = (F.log("total") - F.col("x") / F.col("total")) / F.log(F.col("pages") + 2.0)
    return marks.drop("f"), nodes.select("path", "pages", "styles", F.greatest(spread, F.lit(0.0)).alias("spread"), "size", "marks")


def judge(parts: list[tuple[int, int, int, int, float, int]], threshold: float = THRESHOLD) -> list[int]:
    """Largest branches to remove of one page beyond leaves of weight 0, from rows ``(part, up, leaf, weight,
    value, styles)``: ``value`` is a block's importance, or the spread of a container's styles."""
    value: dict[int, list[float]] = {}
    about: dict[int, tuple[int, int, int, int]] = {}
    for part, up, leaf, weight, x, styles in parts:
        value.setdefault(part, []).append(x)
        about[part] = (up, leaf, weight, styles)
    inner: dict[int, list[int]] = {}
    for part, (up, _, _, _) in about.items():
        inner.setdefault(up, []).append(part)
    own = sorted(x for part, xs in value.items() if about[part][2] >= 2 for x in xs)
    copy = bool(own) and own[len(own) // 2] < threshold
    # elements are numbered parents first, runs of blocks after all elements
    noisy: dict[int, bool] = {}
    imp: dict[int, float] = {}
    for part in sorted(about, reverse=True):
        _, leaf, weight, styles = about[part]
        x = sum(value[part]) / len(value[part])
        if weight == 0:
            x = 0.0
        elif weight == 2 or (weight == 3 and copy):
            x = 1.0
        if not leaf:
            below = inner.get(part, [])
            damp = DAMPING ** styles
            x = (1 - damp) * x + damp * (sum(imp[p] for p in below) / len(below) if below else 1.0)
        imp[part] = x
        noisy[part] = x < threshold and all(noisy[p] for p in inner.get(part, []))
    if all(noisy[part] for part, (_, leaf, weight, _) in about.items() if leaf and weight):
        return []
    return sorted(part for part, (up, _, weight, _) in about.items() if weight and noisy[part] and not noisy.get(up, False))


def removals(parts: DataFrame, threshold: float = THRESHOLD, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``(row, removed)``: the branches to remove of every page that has any beyond those of weight 0."""
    hot = parts.count() / hot_keys
    marks, nodes = tree(parts)
    nodes = keep_table(nodes, "style-nodes")
    even = F.log(F.col("k").cast("double")) / F.log(F.col("pages") + 2.0)
    # pages with a block of too little importance; one that a single page holds has importance 1
    shared = _attach(marks.where("k > 1"), nodes.select("path", "pages", "marks"), ["path"], "marks", hot)
    dull = keep_table(shared.where(1 - even < threshold).select("path", "mark", "size"), "style-dull")
    found = _attach(parts.where("leaf = 1 and weight % 2 = 1").select("path", "mark", "row"), dull, ["path", "mark"], "size", hot)
    judged = parts.join(keep_table(found.select("row").distinct(), "style-judged"), "row", "left_semi").drop("new_path", "new_mark")
    known = _attach(_attach(judged, marks, ["path", "mark"], "size", hot), nodes.drop("marks"), ["path"], "size", hot)
    value = F.when(F.col("leaf") == 1, 1 - even).otherwise(F.col("spread"))
    fields = ("part", "up", "leaf", "weight", "value", "styles")
    grouped = known.withColumn("value", value).groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("parts"))

    def run(batches):
        for batch in batches:
            found = [judge([tuple(p[f] for f in fields) for p in one], threshold) for one in batch.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["row", "removed"])
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    return grouped.mapInArrow(run, "row long, removed array<int>")


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
            threshold: float = THRESHOLD, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``(id, url, text, n_chars, removed)``: the main text of every page, its code points, and
    how many branches the style tree removed beyond those of weight 0."""
    ship(pages.sparkSession)
    rows = number_rows(stable_rows(pages.select(
        F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))), ROW)
    gone = keep_table(removals(keep_table(read_pages(rows), "style-parts"), threshold, hot_keys), "style-removals")
    bits = hash_bitmap(gone.select(F.xxhash64("row").alias("h")), "h")
    kind = dict(rows.dtypes)["id"]

    def listed(batch) -> pa.Array:
        return pa.array(in_bitmap(bits, batch.column(4).to_numpy().view(np.uint64)))

    def plain(batches):
        for batch in batches:
            batch = batch.filter(pc.invert(listed(batch)))
            texts = [Page(t).text() for t in strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([0] * len(texts), pa.int32())],
                names=["id", "url", "text", "removed"])

    def chosen(batches):
        for batch in batches:
            yield batch.filter(listed(batch))

    def cut(batches):
        for batch in batches:
            lists = batch.column(3).to_pylist()
            texts = [Page(t).text(r) for t, r in zip(strings(batch.column(2)), lists)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(r or ()) for r in lists], pa.int32())],
                names=["id", "url", "text", "removed"])

    columns = f"id {kind}, url string, text string, removed int"
    hashed = rows.select("id", "url", "html", ROW, F.xxhash64(ROW).alias("h"))
    left = hashed.mapInArrow(chosen, f"id {kind}, url string, html string, {ROW} long, h long")
    joined = left.join(gone, F.col(ROW) == F.col("row"), "left").select("id", "url", "html", "removed")
    out = hashed.mapInArrow(plain, columns).unionByName(joined.mapInArrow(cut, columns))
    return out.select("id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "removed")
