"""Main text of HTML pages by union-free wrappers of their hosts.

A page's tags and texts form a tree of blocks; inline tags belong to their block.
Neighbours of equal shape are folded into one repeated group.  The trees of a
host's pages are aligned one after the other: where they agree a node stays, what
only one has becomes optional, what repeats becomes a repeated group, and texts
become slots.  The result is the host's wrapper, a regular expression without
unions.  Each slot carries what alignment has brought together in it: how many
characters, how many of them in links, whether all pages say the same there, and
some of the pages that do.  Each page is then matched to its host's wrapper, and
its text is taken from the slots that are content.

A slot is template if

* it is in a part of the page that HTML itself names as such (head, navigation, page
  header, footer, side bar, form, script, style, by tag or role, or hidden);
* a block of the wrapper around it is a form or named like a template (class or id, as
  menu, side bar, advert, notice or comments) and the wrapper shows it to be an aside: it
  is no paragraph or the like, has no article (but named ones, as of a comment) or main
  heading inside, and holds under ``ALL`` of the host's text, or is a form without a paragraph;
* or, outside of an article, at least ``SAME`` different pages have it and all of them
  say the same, though it is less than half of the host's text, or most of it is links.

If a page has an article or main region with more than headings, only what is inside counts.  Names alone
decide nothing: a body or a container named ``has-sidebar`` holds the text, and stays.

Readers align what they have read and send one partial wrapper for each host.
These are merged in two rounds, first in as many groups a host as there are shuffle
partitions, each group one row after the other, so a common host is no large group
anywhere.  Wrappers return to the pages by a broadcast if all of them
take at most ``SENT_BYTES``, else by a join on the host.

Defined results: null or empty html has empty text; a page without host shares
the wrapper of all such; repeated rows give repeated rows, and copies of a page
count as one page; null page_id or url are returned as they are; no pages give no
rows; broken or unclosed tags are closed by the next block; blocks may be nested to any
depth; further columns are ignored by ``extract``.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borelake.llm.buckets import sliced
from borelake.shared import stored

#: Different pages that must say the same in a slot for it to be template.
SAME = 3
#: Share of a host's text that makes a block the body of its pages, whatever its name.
ALL = 0.9
SENT_BYTES = 64_000_000
#: Wrapper nodes and forms of pages that a reader holds before it sends what it has.
HELD = 50_000
#: Trees are as deep as pages are; calls of plain Python functions take heap, not stack.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Tag names and roles (fixed values of HTML).
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style".split())
_CLOSE_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dt dd".split())
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TEMPLATE = frozenset("head title nav footer aside script style noscript template iframe object svg canvas button select textarea dialog menu audio video map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of class and id by which authors name asides (fixed values of common usage), alone or with a word before and a kind of block after.
_NAMES = re.compile(
    r"(?!(?:has|no|not|with|without|is|show|hide|js)[-_])(?:[a-z0-9]+[-_])?(?:ads?|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead"
    r"|cookies?|consent|gdpr|notices?|popup|modal|newsletter|signup|login|comments?|respond|disqus|toolbar|pagination|pager)(?:[-_](?:list|section|area|box|wrapper|wrap|container|block|bar|inner|content|widget|top|bottom|left|right|notice|banner|form|thread|[0-9]+))?"
)
#: Blocks that are text themselves, and blocks that mark the body of a page.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption address".split())
_BODY = frozenset("article main h1".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """A block, a text slot (key ``#``) or a group of neighbours (key ``()``), and whether it is optional, repeats, or is named like an aside.

    ``said`` of a slot: hash of its text (-1 if pages differ), characters, characters in links, whether it is in an article, and hashes of up to SAME pages.
    ``into`` is the node that has taken this one up.
    """

    __slots__ = ("key", "kids", "optional", "repeated", "named", "said", "into")

    def __init__(self, key: str, kids: list[Node] | None = None, optional: bool = False, repeated: bool = False, named: bool = False):
        self.key, self.kids, self.optional, self.repeated, self.named = key, kids or [], optional, repeated, named
        self.said: list | None = None
        self.into: Node | None = None

    def shape(self) -> str:
        return self.key if self.key != "()" else "(" + " ".join(k.shape() for k in self.kids) + ")"

    def expression(self) -> str:
        """The regular expression of the tree, written without recursion."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
                continue
            marks = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[n.optional, n.repeated]
            begin, end = ("TEXT", "") if n.key == "#" else ("(", ")") if n.key == "()" else (f"<{n.key}>", "</>")
            if marks and n.key != "()":
                begin, end = f"({begin}", f"{end})"
            stack.append(end + marks)
            for k in range(len(n.kids) - 1, -1, -1):
                stack += [n.kids[k], " "] if k else [n.kids[k]]
            out.append(begin)
        return "".join(out)

    def now(self) -> Node:
        node = self
        while node.into is not None:
            node = node.into
        return node


def joined(a: list | None, b: list | None) -> list | None:
    """What two slots say together."""
    if not a or not b:
        return a or b
    pages = sorted({*a[4], *b[4]})[:SAME]
    return [a[0] if a[0] == b[0] else -1, a[1] + b[1], a[2] + b[2], a[3] or b[3], pages]


def absorb(a: Node, b: Node) -> Node:
    """``a`` takes up ``b``, of equal shape."""
    a.optional, a.repeated, a.named = a.optional or b.optional, a.repeated or b.repeated, a.named or b.named
    a.said, b.into = joined(a.said, b.said), a
    if a.kids or b.kids:
        a.kids = aligned(a.kids, b.kids)
    return a


def paired(a: list[Node], b: list[Node]) -> Iterator[tuple[int, int, int]]:
    """Runs (place in a, place in b, length) of nodes of equal shape, in order, that make the most of both lists; the last has no length."""
    shapes = [k.shape() for k in a], [k.shape() for k in b]
    if shapes[0] == shapes[1]:
        yield from ((0, 0, len(a)), (len(a), len(b), 0))
    else:
        yield from SequenceMatcher(None, *shapes, autojunk=False).get_matching_blocks()


def aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """One list for both: what agrees is merged, what only one has is optional, then repeats are folded."""
    out, i, j = [], 0, 0
    for x, y, n in paired(a, b):
        for k in (*a[i:x], *b[j:y]):
            k.optional = True
            out.append(k)
        out += [absorb(p, q) for p, q in zip(a[x : x + n], b[y : y + n], strict=True)]
        i, j = x + n, y + n
    return folded(out)


def folded(kids: list[Node], longest: int = 4) -> list[Node]:
    """Neighbours of equal shape, and groups of up to ``longest`` that follow each other, as one that repeats."""
    for size in range(1, longest + 1):
        shapes = [k.shape() for k in kids]
        if len(kids) < 2 * size or not any(shapes[k] == shapes[k + size] for k in range(len(kids) - size)):
            continue
        out: list[Node] = []
        at = 0
        while at < len(kids):
            unit, shape, count = kids[at : at + size], shapes[at : at + size], 1
            while len(unit) == size and shapes[at + count * size : at + (count + 1) * size] == shape:
                for p, q in zip(unit, kids[at + count * size : at + (count + 1) * size], strict=True):
                    absorb(p, q)
                count += 1
            if count == 1:
                out.append(kids[at])
                at += 1
            else:
                one = unit[0] if size == 1 else Node("()", unit)
                one.optional, one.repeated = all(k.optional for k in unit), True
                out.append(one)
                at += count * size
        kids = out
    return kids


class Page:
    """The tree of a page, and its blocks of text in order: (slot, in an article, template, text, characters of links)."""

    def __init__(self, html: str | None):
        self.root, self.blocks = Node("page"), []
        self.stack: list[tuple] = [("page", self.root, False, False)]
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.links = self.link = 0
        self.said_more = False  # whether an article says more than headings
        at = 0
        html = html or ""
        size = len(html)
        while at < size:
            mark = _TOKEN.search(html, at)
            if mark is None:
                self._say(html[at:])
                break
            self._say(html[at : mark.start()])
            at = mark.end()
            name = (mark.group(2) or mark.group(5) or "").lower()
            if not name:
                continue
            if mark.group(1) or mark.group(4):
                self._close(name)
                continue
            self._open(name, mark.group(3) or mark.group(6) or "")
            if name in _RAW:
                end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = end.end() if end else size
                self._close(name)
        self._flush()
        while len(self.stack) > 1:
            self._pop()
        self._fold(self.root)
        if not self.said_more:
            self.blocks = [(node, False, *rest) for node, _, *rest in self.blocks]
        #: Slots in order, and what distinguishes trees.
        self.slots: list[Node] = []
        parts: list[str] = []
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.key == "#":
                self.slots.append(node)
            parts.append(f"{node.key}{'n' * node.named}{'+' * node.repeated}{'?' * node.optional}{len(node.kids)}")
            stack += reversed(node.kids)
        self.form = " ".join(parts)

    def _say(self, text: str) -> None:
        if text:
            self.text.append(text)
            if self.link:
                self.links += len(text)

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self.text)).split()) if self.text else ""
        if text:
            name, node, main, template = self.stack[-1]
            self.said_more |= main and not template and name not in _HEADINGS
            if not node.kids or node.kids[-1].key != "#":
                node.kids.append(Node("#"))
            self.blocks.append((node.kids[-1], main, template, text, min(self.links, len(text))))
        self.text, self.links = [], 0

    def _open(self, name: str, attributes: str) -> None:
        if name in _INLINE:
            self.link += name == "a"
            if name == "br":
                self.text.append(" ")
            return
        self._flush()
        if name in _CLOSE_P and self.stack[-1][0] == "p":
            self._pop()
        while self.stack[-1][0] in _SELF.get(name, ()):
            self._pop()
        _, parent, main, template = self.stack[-1]
        key, named = name, False
        if attributes:
            own = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)}
            classes = own.get("class", "").lower().split()
            key = ".".join((name, *sorted(classes)))
            named = name not in _PROSE and any(map(_NAMES.fullmatch, (*classes, own.get("id", "").lower().strip())))
            main = main or not named and (own.get("role") in ("main", "article") or own.get("itemprop") == "articleBody")
            template = template or own.get("role") in _ROLES and name != "form" or "hidden" in own
        main = main or not named and name in ("article", "main")
        template = template or name in _TEMPLATE or name == "header" and not main
        if name in _VOID:
            return
        self.open[name] += 1
        # a named block is no neighbour of equal shape to one that isn't
        node = Node(f"{key}.~" if named else key, named=named or name == "form")
        parent.kids.append(node)
        self.stack.append((name, node, main, template))

    def _pop(self) -> str:
        name, node, _, _ = self.stack.pop()
        self.open[name] -= 1
        self._fold(node)
        return name

    @staticmethod
    def _fold(node: Node) -> None:
        if len(node.kids) > 1:
            node.kids = folded(node.kids)

    def _close(self, name: str) -> None:
        if name in _INLINE:
            self.link = max(0, self.link - (name == "a"))
            return
        self._flush()
        if self.open[name]:
            while self._pop() != name:
                pass
            self.link = 0

    def spoken(self) -> dict[Node, list]:
        """What the page says in each of its slots, without the parts that HTML names as template."""
        whole = xxhash.xxh64_intdigest("\n".join(b[3] for b in self.blocks)) >> 1
        found: dict[Node, list] = {}
        for node, main, template, text, links in self.blocks:
            if not template:
                said = found.setdefault(node.now(), [0, 0, 0, False, [whole]])
                said[0] = xxhash.xxh64_intdigest(f"{said[0]} {text}") >> 1
                said[1] += len(text)
                said[2] += links
                said[3] = said[3] or main
        return found


class Host:
    """What is known of a host: pages, and its wrapper."""

    def __init__(self):
        self.root, self.pages = Node("page"), 0
        self.forms: dict[str, list[Node]] = {}

    def add(self, page: Page) -> None:
        said, slots = page.spoken(), page.slots
        known = self.forms.get(page.form)
        if known is None:
            for node, x in said.items():
                node.said = x
            self.forms[page.form] = slots
            if self.pages:
                absorb(self.root, page.root)
            else:
                self.root = page.root
        else:
            for node, slot in zip(slots, known, strict=True):
                slot = slot.now()
                slot.said = joined(slot.said, said.get(node))
        self.pages += 1

    def size(self) -> int:
        return 1 + sum(len(x) for x in self.forms.values())

    def merge(self, other: Host) -> None:
        if self.pages:
            absorb(self.root, other.root)
        else:
            self.root = other.root
        self.pages += other.pages

    def nodes(self) -> Iterator[Node]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            yield node
            stack += reversed(node.kids)

    def dump(self) -> str:
        return json.dumps([self.pages, [[n.key, len(n.kids), n.optional + 2 * n.repeated + 4 * n.named, n.said] for n in self.nodes()]])

    @staticmethod
    def load(raw: str) -> Host:
        host = Host()
        host.pages, rows = json.loads(raw)
        stack: list[list] = []
        for key, kids, marks, said in rows:
            node = Node(key, None, bool(marks & 1), bool(marks & 2), bool(marks & 4))
            node.said = said
            if stack:
                stack[-1][0].kids.append(node)
                stack[-1][1] -= 1
            else:
                host.root = node
            stack.append([node, kids])
            while stack and not stack[-1][1]:
                stack.pop()
        return host

    def template(self, same: int = SAME) -> set[Node]:
        """Slots that are template."""
        nodes = list(self.nodes())
        article = any(n.said and n.said[3] for n in nodes)
        chars = {n: n.said[1] if n.said and (n.said[3] or not article) else 0 for n in nodes}
        core = {n: n.key.split(".")[0] in _BODY and not n.named for n in nodes}
        prose = {n: n.key.split(".")[0] == "p" for n in nodes}
        for n in reversed(nodes):
            for k in n.kids:
                chars[n] += chars[k]
                core[n] |= core[k]
                prose[n] |= prose[k]
        total, every = chars[self.root], sum(n.said[1] for n in nodes if n.said)
        found: set[Node] = set()
        stack = [(self.root, False)]
        while stack:
            n, aside = stack.pop()
            small = chars[n] < ALL * total or n.key.split(".")[0] == "form" and not prose[n]
            aside = aside or n.named and not core[n] and small or n.named and not total
            stack += [(k, aside) for k in n.kids]
            if n.said:
                text, size, links, main, pages = n.said
                if aside or not main and (2 * links > size or text != -1 and len(pages) >= same and 2 * size < every):
                    found.add(n)
        return found


def matched(page: Page, root: Node) -> dict[Node, Node]:
    """The wrapper's slot of each slot of the page that it describes."""
    found: dict[Node, Node] = {}
    stack = [(root, page.root)]
    while stack:
        w, p = stack.pop()
        if p.key == "#":
            found[p] = w
        for x, y, n in paired(w.kids, p.kids):
            stack += zip(w.kids[x : x + n], p.kids[y : y + n], strict=True)
    return found


class Wrapper:
    """A host's wrapper, as pages are read with it."""

    def __init__(self, host: Host):
        self.root, self.left_out = host.root, host.template()
        self.forms: dict[str, list[bool]] = {}

    def text(self, html: str | None) -> str:
        """The content slots of a page, one line for each block."""
        page = Page(html)
        flags = self.forms.get(page.form)
        if flags is None:
            if len(self.forms) > HELD:
                self.forms.clear()
            slots = matched(page, self.root)
            flags = self.forms[page.form] = [slots.get(s) in self.left_out for s in page.slots]
        template = {s for s, gone in zip(page.slots, flags, strict=True) if gone}
        own = [b for b in page.blocks if not b[2] and b[0].now() not in template]
        return "\n".join(b[3] for b in [b for b in own if b[1]] or own)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


_PART = T.StructType([T.StructField("host", T.StringType()), T.StructField("known", T.StringType())])


def _merged(parts: DataFrame, *by: str) -> DataFrame:
    """Partial wrappers of a host that agree in ``by``, one after the other, as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, host = None, Host()
        for batch in batches:
            for *key, known in zip(*(batch.column(c).to_pylist() for c in ("host", *by, "known")), strict=True):
                if key != at:
                    if at:
                        yield pa.RecordBatch.from_arrays([pa.array(at[:1], pa.string()), pa.array([host.dump()], pa.string())], _PART.names)
                    at, host = key, Host()
                host.merge(Host.load(known))
        if at:
            yield pa.RecordBatch.from_arrays([pa.array(at[:1], pa.string()), pa.array([host.dump()], pa.string())], _PART.names)

    return parts.repartition("host", *by).sortWithinPartitions("host", *by, "known").mapInArrow(run, _PART)


def partial_wrappers(pages: DataFrame) -> DataFrame:
    """host and known: what each reader has learned of each host."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, Host] = {}
        held = 0

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(hosts), pa.string()), pa.array([h.dump() for h in hosts.values()], pa.string())], _PART.names)
            hosts.clear()
            return out

        for batch in sliced(batches):
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                known = hosts.setdefault(host, Host())
                forms = len(known.forms)
                page = Page(html.as_py())
                known.add(page)
                held += (len(known.forms) > forms) * (1 + len(page.slots)) + (known.pages == 1)
                if held > HELD:
                    yield sent()
                    held = 0
        if hosts:
            yield sent()

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(read, _PART)


def wrappers(pages: DataFrame) -> DataFrame:
    """Per host of ``pages`` (url, html): pages, expression (the wrapper), n_template (slots that are template) and known (what ``extract`` reads pages with)."""
    out = T.StructType([_PART["host"], T.StructField("pages", T.LongType()), T.StructField("expression", T.StringType()), T.StructField("n_template", T.LongType()), _PART["known"]])

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = [Host.load(x) for x in batch.column("known").to_pylist()]
            columns = [[h.pages for h in hosts], [h.root.expression() for h in hosts], [len(h.template()) for h in hosts]]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), batch.column("known")], out.names)

    parts = partial_wrappers(pages)
    groups = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = _merged(parts.withColumn("group", F.pmod(F.xxhash64("known"), F.lit(groups))), "group")
    return _merged(first).mapInArrow(shown, out)


def extract(pages: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Per row of ``pages``: page_id, url, text."""
    rules = stored(wrappers(pages), "wrappers").select("host", "known")
    rows = pages.select("page_id", "url", "html")
    out = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType())])
    size = rules.agg(F.sum(F.length("host") + F.length("known"))).first()[0] or 0
    hosted = rows.withColumn("host", host_of(F.col("url")))
    if size <= sent_bytes:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: r["known"] for r in rules.collect()})
    else:
        sent, hosted = None, hosted.join(rules, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, Wrapper] = {}
        for batch in sliced(batches):
            hosts = batch.column("host").to_pylist()
            known = map(sent.value.get, hosts) if sent else batch.column("known").to_pylist()
            texts = []
            for host, html, raw in zip(hosts, batch.column("html"), known, strict=True):
                if host not in read:
                    if len(read) > 2_000:
                        read.clear()
                    read[host] = Wrapper(Host.load(raw) if raw else Host())
                texts.append(read[host].text(html.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], out.names)

    return hosted.mapInArrow(run, out)


def op3_pages(spark, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op3_pages": op3_pages}
SQL: dict = {}
