"""Main text of web pages by wrapper induction.

1. Every page is parsed into a tree (tags that close others by implication are handled, raw elements
   are skipped whole). Its skeleton is the tree of block elements; neighbours of equal shape fold
   into one node, as lists and paragraphs do; a node keeps the hashes of the own texts folded into it.
2. A layout is the pages of a host whose outermost fork has the same elements. All different pages of a
   layout are aligned by simple tree matching with one of them, its seed, and the pages are counted that
   have a node and that have a text there; so are those of the whole host that have a text at a path of
   elements. A text that ``SHARE`` of the pages with its node, or path, and ``LEAST_PAGES`` at least have
   is template; others are slots. The seed gives nodes to count at and decides nothing.
3. A page is aligned with its layout's seed. Dropped are: the own text of blocks that is template there
   or at their path (inside an article or main element at ``MAIN_SHARE``, and only if half of the
   element's text stays: else its host's pages are near copies of each other), elements whose tag says menu,
   header, footer, sidebar, notice, advert or form, and boxes (``BOXES``, not headings, paragraphs or items)
   whose class, id or role does.
4. The outermost article and main elements are collected whole. Where a page has none, or they hold less
   than half of what the body gives, the body is collected, less boxes outside them that are a menu: three
   links or more, no paragraph or heading, and hardly a character outside the links.

Character references are decoded, white space inside a block (a line break too) becomes one space,
blocks are trimmed and joined in page order by one newline. Null and empty html, and pages without
content, give the empty string; nothing is cut. Rows repeat as they come; a page without a host has
no wrapper. Text in no block of its own counts as a block between its neighbours. Nothing recurses, so
tags may be nested to any depth.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import copied, dealt, hot_keys, map_arrow, materialise, read_table

LEAST_PAGES, SHARE, MAIN_SHARE, SALTS, COUNTED, LINKS = 3, 0.6, 0.9, 64, 100_000, 3
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>""", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SWALLOWS = frozenset("script style noscript iframe textarea title".split())
RAW = frozenset("script style noscript template iframe svg math canvas object audio video textarea title select".split())
GONE = frozenset("nav footer aside form menu dialog button fieldset head datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var td th".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "thead": ("tr td th", ("table",)), "tbody": ("tr td th thead", ("table",)), "option": ("option", ("select",))}
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# words in a class, id or role that say that an element is not content
NOT_CONTENT = frozenset("nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar banner footer sidebar aside ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe signup login comment comments commentlist reply replies disqus discussion respond share sharing social related recommended widget pagination pager toolbar copyright complementary contentinfo search skip".split())
# words after one of these that make no other thing of it
PLAIN = frozenset("container wrapper wrap box boxes list bar block section area slot unit panel left right top bottom item items links link inner outer button buttons icons row column col main primary secondary site page mobile desktop".split())
HEADS, OWN_HEADS = frozenset(("header",)), frozenset("article entry post content".split())
BOXES = frozenset("div section ul ol dl table center nav menu".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main".split())
_CLASS = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "items", "drop", "main", "name", "within", "chars", "linked", "links", "prose")

    def __init__(self, tag, parent):
        self.tag, self.parent, self.items, self.drop, self.main, self.name = tag, parent, [], False, False, tag
        self.within = parent is not None and (parent.within or parent.main)


def _name(tag: str, rest: str) -> str:
    """The tag with the words of class, id and role that hold no digit."""
    words = {w for m in _CLASS.finditer(rest) if m[1].lower() in ("class", "id", "role") for w in (m[2] or m[3] or m[4] or "").lower().split()}
    return ".".join([tag, *sorted(w for w in words if not any(c.isdigit() for c in w))])


def _names_no(token: str, in_main: bool) -> bool:
    """Whether a word of a class, id or role says no: by all of its parts, by its last, or by its first before parts that say nothing."""
    parts = [w for w in _SPLIT.split(token) if w and not w.isdigit()]
    if not parts:
        return False
    if parts[-1] in HEADS:
        return not in_main and not set(parts) & OWN_HEADS
    return parts[-1] in NOT_CONTENT or (parts[0] in NOT_CONTENT and all(w in NOT_CONTENT or w in PLAIN for w in parts[1:]))


def _says_no(tag: str, rest: str, in_main: bool) -> bool:
    if tag in GONE or (tag == "header" and not in_main):
        return True
    if not rest or tag in ("html", "body", "main"):
        return False
    for m in _CLASS.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
            return True
        # a heading, a paragraph or an item is content whatever its name says; the wrapper may know better
        if tag in BOXES and key in ("class", "id", "role") and any(_names_no(t, in_main) for t in value.split()):
            return True
    return False


def parse(page: str) -> Node:
    """The tree of a page; ``drop`` marks what markup says is not content, ``main`` article and main."""
    root = Node("#root", None)
    at, pos, n, last = root, 0, len(page), page.rfind(">")
    still: Counter = Counter()  # open elements by tag

    def leave(to: Node) -> None:
        nonlocal at
        while at is not to:
            still[at.tag] -= 1
            at = at.parent

    while pos < n:
        m = TAG.search(page, pos) if pos <= last else None
        if m is None:
            at.items.append(page[pos:])
            break
        if m.start() > pos:
            at.items.append(page[pos : m.start()])
        pos = m.end()
        if m["cdata"] is not None:
            at.items.append(m["cdata"])
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            top = at if still[name] else root
            while top is not root and top.tag != name and not (name in INLINE and top.tag not in INLINE):
                top = top.parent
            if top is not root and top.tag == name:
                leave(top.parent)
            elif name == "p":
                at.items.append(Node("hr", at))  # an empty paragraph
            continue
        if name in RAW and not m["rest"].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, pos)
            if close or name in SWALLOWS:
                pos = close.end() if close else n
            continue
        if name in CLOSE_P or name in CLOSES:
            shut, fence = CLOSES.get(name, ("", ()))
            shut = set(shut.split()) | ({"p"} if name in CLOSE_P else set())
            left, top, found = sum(still[t] for t in shut), at, None
            while left > 0 and top is not root and top.tag not in fence and (top.tag in shut or top.tag in INLINE or top.tag == "p"):
                if top.tag in shut:
                    found, left = top, left - 1
                top = top.parent
            if found is not None:
                leave(found.parent)
        node = Node(name, at)
        at.items.append(node)
        if name in VOID or m["rest"].endswith("/"):
            continue
        if m["rest"]:
            node.name = _name(name, m["rest"])
        node.drop = _says_no(name, m["rest"], node.within)
        node.main = not node.drop and name in ("article", "main")
        at = node
        still[name] += 1
    return root


def _nodes(top: Node) -> list[Node]:
    """``top`` and all below it, each before its own."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in node.items if not isinstance(x, str)]
    return out


def _weigh(root: Node) -> None:
    """For every element: its characters, those in links, its links, and whether it holds a paragraph or a heading."""
    for node in reversed(_nodes(root)):
        node.chars = node.linked = node.links = 0
        node.prose = node.tag in PROSE
        for x in node.items:
            if isinstance(x, str):
                node.chars += len(x.strip())
            else:
                node.chars, node.linked, node.links, node.prose = node.chars + x.chars, node.linked + x.linked, node.links + x.links, node.prose or x.prose
        if node.tag == "a":
            node.linked, node.links = node.chars, 1


# ---------------------------------------------------------------- skeletons and tree matching


class Bone:
    """A block, or neighbouring blocks of one shape: ``texts`` holds (block, path, hash) of each, kids are folded alike."""

    __slots__ = ("tag", "name", "kids", "texts", "shape", "size", "number")

    def __init__(self, tag: str, name: str = ""):
        self.tag, self.name, self.kids, self.texts, self.shape, self.size, self.number = tag, name, [], [], b"", 1, 0

    def seal(self) -> None:
        """The shape and the number of nodes, once all kids are sealed."""
        said = self.tag.encode("utf-8", "replace") + b"".join(k.shape for k in self.kids)
        self.shape, self.size = hashlib.blake2b(said, digest_size=8).digest(), 1 + sum(k.size for k in self.kids)


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def skeleton(root: Node) -> Bone:
    """The blocks of a page; text in inline elements is their block's, what markup drops has none."""
    top = Bone(root.tag, root.name)
    # (items left, block or inline element, its bone, path, own text); an inline element has its block's last three
    stack = [(iter(root.items), root, top, _hash(f"0/{root.name}"), [])]
    while stack:
        items, node, bone, path, own = stack[-1]
        for x in items:
            if isinstance(x, str):
                own.append(x)
            elif x.tag in VOID:
                continue
            elif x.tag in INLINE:
                if not x.drop:
                    own.append(" ")
                    stack.append((iter(x.items), x, bone, path, own))
                    break
            else:
                kid = Bone(x.tag, x.name)
                stack.append((iter(() if x.drop else x.items), x, kid, _hash(f"{path}/{x.name}"), []))
                break
        else:
            stack.pop()
            if node.tag in INLINE:
                continue
            text = " ".join(" ".join(own).split())
            if text and not node.drop:
                bone.texts.append((node, path, _hash(text) or 1))
            bone.seal()
            if stack:
                into = stack[-1][2]
                if into.kids and into.kids[-1].shape == bone.shape:
                    _fold(into.kids[-1], bone)
                else:
                    into.kids.append(bone)
    return top


def _fold(a: Bone, b: Bone) -> None:
    for p, q in _alike(a, b):
        p.texts += q.texts


def _alike(a: Bone, b: Bone):
    """The pairs of nodes of two trees of one shape."""
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        yield p, q
        stack += zip(p.kids, q.kids)


def _walk(top: Bone):
    stack = [top]
    while stack:
        bone = stack.pop()
        yield bone
        stack += bone.kids


def packed_bones(top: Bone) -> str:
    """A skeleton as JSON: for each node, parents first, its tag, number of kids, paths and hashes of its texts."""
    out, stack = [], [top]
    while stack:
        bone = stack.pop()
        out.append([bone.tag, len(bone.kids), sorted({(path, text) for _, path, text in bone.texts})])
        stack += reversed(bone.kids)
    return json.dumps(out, separators=(",", ":"))


def unpacked_bones(said: str) -> Bone:
    """The skeleton again; its texts have no block. Nodes are numbered in order."""
    made, open_ = [], []
    for number, (tag, kids, texts) in enumerate(json.loads(said)):
        bone = Bone(tag)
        bone.number, bone.texts = number + 1, [(None, path, text) for path, text in texts]
        if open_:
            open_[-1][0].kids.append(bone)
            open_[-1][1] -= 1
        made.append(bone)
        open_.append([bone, kids])
        while open_ and not open_[-1][1]:
            open_.pop()
    for bone in reversed(made):
        bone.seal()
    return made[0]


def _blocks(node: Node) -> list[Node]:
    """The blocks in a node that no other block in it holds."""
    out, stack = [], [iter(node.items)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, str) or x.tag in VOID:
                continue
            if x.tag in INLINE:
                stack.append(iter(x.items))
                break
            out.append(x)
        else:
            stack.pop()
    return out


def layout(root: Node) -> int:
    """Names the elements of the outermost fork of a page."""
    at, kids = root, [k for k in _blocks(root) if k.tag != "head"]
    while len(kids) == 1 and (inner := [k for k in _blocks(kids[0]) if k.tag != "head"]):
        at, kids = kids[0], inner
    names = [k.name for k in kids]
    return _hash("|".join([at.name, *(n for i, n in enumerate(names) if not i or n != names[i - 1])]))


def _ends(x: list[Bone], y: list[Bone]) -> tuple[int, int]:
    """How many first and last kids are alike in shape: to match those with each other is always best."""
    head = 0
    while head < min(len(x), len(y)) and x[head].shape == y[head].shape:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail].shape == y[-1 - tail].shape:
        tail += 1
    return head, tail


def _table(x: list[Bone], y: list[Bone], size: dict) -> list[list[int]]:
    best = [[0] * (len(y) + 1)]
    for p in x:
        above, row = best[-1], [0]
        for j, q in enumerate(y):
            row.append(max(above[j + 1], row[j], above[j] + size.get((p, q), 0)))
        best.append(row)
    return best


def tree_match(a: Bone, b: Bone) -> tuple[int, list[tuple[Bone, Bone]]]:
    """Simple tree matching: the size of the largest order-preserving match, and its pairs.

    Trees of one shape match whole, and so do the first and last kids that are alike; only the kids between
    are aligned by dynamic programming.
    """
    size: dict[tuple[Bone, Bone], int] = {}
    stack, rows = [(a, b, False)], {}
    while stack:
        p, q, ready = stack.pop()
        if ready:
            x, y, ends = rows[p, q][:3]
            best = _table(x, y, size)
            rows[p, q] = x, y, ends, best
            size[p, q] = 1 + ends + best[-1][-1]
        elif (p, q) not in size:
            if p.tag != q.tag or p.shape == q.shape:
                size[p, q] = p.size if p.tag == q.tag else 0
                continue
            head, tail = _ends(p.kids, q.kids)
            x, y = p.kids[head : len(p.kids) - tail], q.kids[head : len(q.kids) - tail]
            rows[p, q] = x, y, sum(k.size for k in p.kids[:head]) + sum(k.size for k in p.kids[len(p.kids) - tail :]), None
            size[p, q] = 0
            stack.append((p, q, True))
            stack += [(k, h, False) for k in x for h in y if k.tag == h.tag]
    if not size[a, b]:
        return 0, []
    pairs, todo = [], [(a, b)]
    while todo:
        p, q = todo.pop()
        if p.shape == q.shape:
            pairs += _alike(p, q)
            continue
        pairs.append((p, q))
        head, tail = _ends(p.kids, q.kids)
        todo += [*zip(p.kids[:head], q.kids[:head]), *zip(p.kids[len(p.kids) - tail :], q.kids[len(q.kids) - tail :])]
        x, y, _, best = rows[p, q]
        i, j = len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                todo.append((x[i - 1], y[j - 1]))
                i, j = i - 1, j - 1
    return size[a, b], pairs


def count_page(bone: Bone, seed: Bone | None, met: Counter, host: str, lay: int) -> None:
    """Count the texts (0: any or none) of a page at the paths of its host and at the nodes of its layout's seed."""
    at = {(0, path, text) for s in _walk(bone) for _, path, text in s.texts}
    at |= {(0, path, 0) for _, path, _ in at}
    for p, q in tree_match(bone, seed)[1] if seed else ():
        at.add((1, q.number, 0))
        at.update((1, q.number, text) for _, _, text in p.texts)
    for kind, node, text in at:
        met[host, lay if kind else 0, kind, node, text] += 1


def template_blocks(bone: Bone, seed: Bone | None, of_layout: dict, of_host: dict) -> tuple[set[int], set[int]]:
    """Blocks of a page whose own text is template, and those where it is at ``MAIN_SHARE``."""
    often, always = set(), set()
    found = [(n, of_host.get((path, text))) for s in _walk(bone) for n, path, text in s.texts]
    found += [(n, of_layout.get((q.number, text))) for p, q in (tree_match(bone, seed)[1] if seed else ()) for n, _, text in p.texts]
    for n, share in found:
        if share is not None:
            often.add(id(n))
            if share:
                always.add(id(n))
    return often, always


# ---------------------------------------------------------------- extraction


def _collect(top: Node, skip: set[int], out: list[list[str]], weigh: bool) -> None:
    """Add the blocks of ``top`` to ``out``, each a list of the texts in it."""
    stack = [(iter(top.items), weigh, id(top) in skip, False)]
    while stack:
        items, weigh, mute, block = stack[-1]
        for x in items:
            if isinstance(x, str):
                if not mute:
                    out[-1].append(_html.unescape(x))
            elif x.tag in INLINE and not x.drop:
                if x.tag in ("td", "th"):
                    out[-1].append(" ")
                stack.append((iter(x.items), weigh, mute, False))
                break
            elif x.tag in VOID:
                if x.tag == "hr":
                    out.append([])
                else:
                    out[-1].append(" ")
            elif x.tag not in INLINE:
                out.append([])
                # outside articles, a list or box of nothing but links is a menu
                if x.drop or (weigh and x.tag in BOXES and x.links >= LINKS and not x.prose and x.linked > 0.8 * x.chars):
                    continue
                stack.append((iter(x.items), weigh and not x.main, id(x) in skip, True))
                break
        else:
            stack.pop()
            if block:
                out.append([])


def _mains(root: Node) -> list[Node]:
    """The outermost article and main elements, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.main:
            out.append(node)
        elif not node.drop:
            stack += [x for x in reversed(node.items) if not isinstance(x, str)]
    return out


def main_text(page: str | None, wrapper: tuple | None = None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    mains = _mains(root)
    skip: set[int] = set()
    if wrapper is not None:
        often, always = template_blocks(skeleton(root), *wrapper)
        inside = {id(x) for top in mains for x in _nodes(top)} if often else set()
        skip = often - inside
        always &= inside
        if always and 2 * _size(_texts(mains, always, False)) >= _size(_texts(mains, set(), False)):
            skip |= always
    _weigh(root)
    marked, body = _texts(mains, skip, False), _texts([root], skip, True)
    return "\n".join(marked if mains and 2 * _size(marked) >= _size(body) else body)


def _texts(tops: list[Node], skip: set[int], weigh: bool) -> list[str]:
    """The blocks of text in ``tops``."""
    out: list[list[str]] = [[]]
    for top in tops:
        _collect(top, skip, out, weigh)
        out.append([])
    blocks = (" ".join("".join(b).split()) for b in out)
    return [b for b in blocks if b]


def _size(blocks: list[str]) -> int:
    return sum(map(len, blocks))


# ---------------------------------------------------------------- Spark


def _host(url):
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def wrappers(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (host, lay, seed, of_layout) and (host, of_host): seeds as JSON, and texts that are template; and
    rows (host, lay, n), the sizes of all layouts."""

    def bones(batches):
        for batch in batches:
            host, lay, mark, bone = [], [], [], []
            for h, page in zip(*(c.to_pylist() for c in batch.columns)):
                root = parse(page or "")
                s = packed_bones(skeleton(root))
                host.append(h)
                lay.append(layout(root))
                mark.append(int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
                bone.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(lay, pa.int64()), pa.array(mark, pa.int64()), pa.array(bone, pa.string())], ["host", "lay", "mark", "bone"])

    def emit(met):
        rows = list(zip(*((*key, n) for key, n in met.items()))) or [()] * 6
        met.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(rows)], ["host", "lay", "kind", "node", "text", "n"])

    def count(batches):
        met: Counter = Counter()
        known: dict[str, Bone] = {}
        for batch in batches:
            for host, lay, bone, seed in zip(*(c.to_pylist() for c in batch.columns)):
                count_page(unpacked_bones(bone), _seed(seed, known), met, host, lay)
                if len(met) > COUNTED:
                    yield emit(met)
        yield emit(met)

    own = pages.select(_host(F.col("url")).alias("host"), "html").where("host <> ''")
    bare = own.transform(map_arrow, bones, "host string, lay long, mark long, bone string")
    bare = materialise(bare.groupBy("host", "lay", "mark").agg(F.first("bone").alias("bone"), F.count("*").alias("n")), "bones")
    sizes = materialise(bare.groupBy("host", "lay").agg(F.min("mark").alias("mark"), F.count("*").alias("kinds"), F.sum("n").alias("n")), "sizes")
    by = ["host", "lay"]
    hot = hot_keys(sizes.withColumn("n", F.col("kinds")), by, SALTS)
    seeds = sizes.where(f"kinds >= {LEAST_PAGES}").select("host", "lay", "mark")
    seeds = materialise(bare.join(seeds, ["host", "lay", "mark"]).select("host", "lay", F.col("bone").alias("seed")), "seeds")
    each = dealt(bare.select("host", "lay", "bone", F.col("mark").alias("_spread")), hot, by, SALTS).join(copied(seeds, hot, by, SALTS), [*by, "_salt"], "left")
    met = each.select("host", "lay", "bone", "seed").transform(map_arrow, count, "host string, lay long, kind long, node long, text long, n long")
    at = ["host", "lay", "kind", "node"]
    met = materialise(met.groupBy(*at, "text").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_PAGES}"), "met")
    constant = met.where("text <> 0").join(met.where("text = 0").select(*at, F.col("n").alias("pages")), at).where(f"n >= {SHARE} * pages")
    constant = constant.groupBy("host", "lay", "kind").agg(F.collect_list(F.array("node", "text", F.expr(f"CAST(n >= {MAIN_SHARE} * pages AS BIGINT)"))).alias("texts"))
    of_layout = seeds.join(constant.where("kind = 1").select("host", "lay", F.col("texts").alias("of_layout")), ["host", "lay"])
    return materialise(of_layout, "of_layout"), materialise(constant.where("kind = 0").select("host", F.col("texts").alias("of_host")), "of_host"), sizes


def _seed(seed: str | None, known: dict[str, Bone]) -> Bone | None:
    if seed is None:
        return None
    if seed not in known:
        if len(known) > 5000:
            known.clear()
        known[seed] = unpacked_bones(seed)
    return known[seed]


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of ``pages(page_id, url, html)``."""

    def lay(batches):
        for batch in batches:
            got = [layout(parse(page)) if page else 0 for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int64())], ["page_id", "url", "html", "host", "_spread", "lay"])

    def go(batches):
        known: dict[str, Bone] = {}
        for batch in batches:
            text = []
            for page, seed, of_layout, of_host in zip(*(c.to_pylist() for c in batch.columns[2:])):
                wrapper = (_seed(seed, known), *({(at, t): share for at, t, share in found or ()} for found in (of_layout, of_host)))
                text.append(main_text(page, wrapper))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    of_layout, of_host, sizes = wrappers(pages)
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", _host(F.col("url")).alias("host"), F.xxhash64("page_id", "html", F.lit(5)).alias("_spread"))
    rows = rows.transform(map_arrow, lay, "page_id long, url string, html string, host string, _spread long, lay long")
    hot = materialise(hot_keys(sizes, ["host"], SALTS), "hot")
    rows = dealt(rows, hot, ["host"], SALTS).join(copied(of_layout, hot, ["host"], SALTS), ["host", "lay", "_salt"], "left").join(copied(of_host, hot, ["host"], SALTS), ["host", "_salt"], "left")
    return rows.select("page_id", "url", "html", "seed", "of_layout", "of_host").transform(map_arrow, go, "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark, sf_dir):
    return extract(read_table(spark, sf_dir, "pages"))
