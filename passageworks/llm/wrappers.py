"""Main text of pages through wrappers inferred for each host.

A page becomes a tree of its block elements, with a slot where text stands.  Repeated
neighbours, single or in short runs, are folded into repeated groups.  Trees of one host are
aligned and merged one after another: matching elements are merged inside, elements
that only one side has become optional, elements that repeat on either side repeat.
What comes out is the host's wrapper, a regular expression without unions.

Every slot of a page thus belongs to a slot of its host's wrapper, and a role is given
to each of those: by the elements around it, by whether its text is the same on all
pages, and by how much of it is links.  Slots in the article are its text; a page whose
wrapper has no article gives all slots that no rule puts aside.

Pages of equal trees share one signature, so merging works on distinct signatures, in
salted groups of a host before the host itself; pages are parsed where they lie, and
join small rows of (host, signature) to pick their blocks.

Defined cases: a null html is empty and has no text; a null or odd url has the empty
host; rows that repeat a page id are extracted each by itself; unclosed elements,
comments and tags end with the page, also script and style, but of other elements whose
inside is skipped an unclosed one is nothing but its start tag; elements deeper than
`DEPTH` are closed by their own end tags and count as text of the one at that depth, or
of one below it where they have another role; exact copies of a page on a host count as
one page.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passageworks.llm.batches import slices
from passageworks.llm.columns import picked, whole
from passageworks.session import ship_package, stored

DEPTH = 40
SALTS = 64
WORK_BYTES = 4 << 20
#: Pages of a slot from which the same text on all of them is no article text.
CONSTANT_PAGES = 3
LINK_SHARE = 0.8

# Fixed sets of HTML elements and of words in class, id and role attributes.
RAW = "script style noscript template iframe svg math title textarea select object canvas".split()
BLOCKS = (
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table caption thead tbody tfoot tr td th form fieldset legend blockquote pre figure figcaption "
    "address details summary dialog button center hgroup menu search"
).split()
#: Open elements that the start of another one closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
ASIDE_TAGS = set("nav aside footer form button menu dialog search fieldset".split())
ASIDE_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification alert newsletter subscribe subscription signup login popup modal overlay share "
    "sharing social comment comments disqus respond reply replies discussion related recommended "
    "recommendations pagination pager footer masthead toolbar copyright legal disclaimer form search "
    "teaser trending skip".split()
)
HEAD_WORDS = {"header", "topbar"}
#: Elements that hold text and no blocks.
TEXTS = set("h1 h2 h3 h4 h5 h6 p pre dt caption figcaption summary legend address".split())
ID = "~"
MAIN_WORDS = set("article articlebody post entry story main content".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)>""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
SLOT = "#"


class Node:
    """An element of a page or wrapper; a slot has no children."""

    __slots__ = ("label", "kids", "many", "maybe", "into")

    def __init__(self, label: str, kids: list[Node] | None = None, many: bool = False, maybe: bool = False):
        self.label, self.kids, self.many, self.maybe = label, kids or [], many, maybe
        self.into: Node | None = None

    def final(self) -> Node:
        node = self
        while node.into is not None:
            node = node.into
        return node

    def packed(self) -> list:
        return [self.label, self.many * 1 + self.maybe * 2, [k.packed() for k in self.kids]]


def unpacked(x: list) -> Node:
    return Node(x[0], [unpacked(k) for k in x[2]], bool(x[1] & 1), bool(x[1] & 2))


def merge(one: Node, other: Node) -> None:
    """Bring `other` into `one`, of the same label."""
    other.into = one
    one.many |= other.many
    one.maybe |= other.maybe
    a, b = one.kids, other.kids
    left, right = [k.label for k in a], [k.label for k in b]
    if left == right:
        for x, y in zip(a, b):
            merge(x, y)
        return
    out: list[Node] = []
    for op, i1, i2, j1, j2 in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(a[i1:i2], b[j1:j2]):
                merge(x, y)
                out.append(x)
        else:
            for x in (*a[i1:i2], *b[j1:j2]):
                x.maybe = True
                out.append(x)
    one.kids = folded(out)


def folded(kids: list[Node]) -> list[Node]:
    """Repeated neighbours merged: runs of one to three labels that follow themselves."""
    out: list[Node] = []
    for kid in kids:
        out.append(kid)
        for n in (1, 2, 3):
            if len(out) >= 2 * n and all(out[-n + i].label == out[-2 * n + i].label for i in range(n)):
                for x, y in zip(out[-2 * n : -n], out[-n:]):
                    merge(x, y)
                    x.many = True
                del out[-n:]
                break
    return out


def label_of(tag: str, attributes: str) -> str:
    """The tag and the words of its class, role and itemprop, and of its id behind `ID`."""
    words: dict[str, None] = {}
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            mark = ID if m[1].lower() == "id" else ""
            words |= dict.fromkeys(mark + w.lower() for w in WORDS.findall(m[2] or m[3] or m[4] or ""))
    return ".".join([tag, *words])


def parse(page: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The folded tree, and (slot, text, characters in links) of each block of text."""
    root = Node("page")
    stack, raws, blocks = [root], [], []
    opened: dict[str, int] = {}  # how many of each tag are open
    deep: list[str] = []  # roles of open elements below DEPTH
    unclosed: set[str] = set()  # tags without a further end tag
    text: list[str] = []
    links = anchor = 0

    def flush() -> None:
        nonlocal links
        found = " ".join(entities.unescape("".join(text)).split())
        if found:
            slot = Node(SLOT)
            stack[-1].kids.append(slot)
            blocks.append((slot, found, min(links, len(found))))
        text.clear()
        links = 0

    def close(upto: int) -> None:
        for k in range(len(stack) - 1, upto - 1, -1):
            if stack[k] is not stack[k - 1]:
                stack[k].kids = folded(stack[k].kids)
            opened[raws[k - 1]] -= 1
        del stack[upto:]
        del raws[upto - 1 :]
        del deep[max(upto - DEPTH - 1, 0) :]

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            text.append(page[at:lt])
            if anchor:
                links += lt - at
            at = lt
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = end if stop < 0 else stop + 3
            continue
        mark = page[at + 1 : at + 2]
        if mark in ("!", "?"):
            stop = page.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        m = TAG.match(page, at)
        if m is None:
            if mark.isalpha() or mark == "/":  # an unclosed tag
                stop = page.find(">", at)
                at = end if stop < 0 else stop + 1
            else:
                text.append("<")
                at += 1
            continue
        at, tag = m.end(), m[2].lower()
        if tag in RAW_SET:
            if not m[1] and not m[3].rstrip().endswith("/") and tag not in unclosed:
                stop = _closing(tag).search(page, at)
                if stop is not None:
                    at = stop.end()
                elif tag in ("script", "style"):
                    at = end
                else:
                    unclosed.add(tag)
            text.append(" ")
            continue
        if tag not in BLOCK_SET:
            if tag == "a":
                anchor = 0 if m[1] else 1
            elif tag in ("br", "hr", "img", "input"):
                text.append(" ")
            continue
        flush()
        if m[1]:
            if opened.get(tag):
                k = len(raws)
                while raws[k - 1] != tag:
                    k -= 1
                close(k)
                anchor = 0
            continue
        if raws and raws[-1] == "p":
            close(len(stack) - 1)
        while raws and raws[-1] in CLOSES.get(tag, ()):
            close(len(stack) - 1)
        node = Node(label_of(tag, m[3]))
        if len(stack) > DEPTH:
            above = deep[-1] if deep else role(n.label for n in stack)
            deep.append(role([node.label], above))
            if deep[-1] == above:
                node = stack[-1]
        if node is not stack[-1]:
            stack[-1].kids.append(node)
        stack.append(node)
        raws.append(tag)
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    close(1)
    root.kids = folded(root.kids)
    return root, blocks


RAW_SET, BLOCK_SET = set(RAW), set(BLOCKS)
_closings: dict[str, re.Pattern] = {}


def _closing(tag: str) -> re.Pattern:
    if tag not in _closings:
        _closings[tag] = re.compile(rf"</{tag}\b[^>]*>", re.I)
    return _closings[tag]


def slots(root: Node) -> list[tuple[Node, tuple[str, ...]]]:
    """Slots in order, each with the labels around it."""
    out, todo = [], [(root, ())]
    while todo:
        node, path = todo.pop()
        if node.label == SLOT:
            out.append((node, path))
        todo += [(k, (*path, node.label)) for k in reversed(node.kids)]
    return out


def role(path: Iterable[str], above: str = "open") -> str:
    """`main` in an article, `aside` in elements that are none, else `open`; the path starts in `above`."""
    if above == "aside":
        return above
    inside = above == "main"
    for label in path:
        tag, *found = label.split(".")
        # What a heading or paragraph is called says what it is about, not what it is; inside
        # an article the same goes for any id.
        words = [] if tag in TEXTS else [w.lstrip(ID) for w in found]
        named = [w for w in words if w in found] if inside else words
        odd = not ASIDE_WORDS.isdisjoint(named)
        if tag in ("article", "main") and (not odd or not MAIN_WORDS.isdisjoint(words)):
            inside = True
        elif tag in ("html", "body"):
            pass
        elif tag in ASIDE_TAGS or odd:
            return "aside"
        elif not inside and (tag == "header" or not HEAD_WORDS.isdisjoint(words)):
            return "aside"
        elif not MAIN_WORDS.isdisjoint(words):
            inside = True
    return "main" if inside else "open"


def _parsed(with_blocks: bool):
    schema = PARSED if with_blocks else TRAITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", WORK_BYTES):
            rows = []
            for page_id, url, host, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "html"))):
                root, blocks = parse(page)
                signature = json.dumps(root.packed(), separators=(",", ":"))
                number = {id(node): i for i, (node, _) in enumerate(slots(root))}
                at = [number[id(slot.final())] for slot, _, _ in blocks]
                row = {"host": host, "signature_key": xxhash.xxh128_hexdigest(signature)}
                if with_blocks:
                    row |= {"page_id": page_id, "url": url, "blocks": [t for _, t, _ in blocks], "at": at}
                else:
                    traits: dict[int, dict] = {
                        i: {"slot": i, "n": 0, "chars": 0, "links": 0, "low": None, "high": None} for i in number.values()
                    }
                    for i, (_, t, k) in zip(at, blocks):
                        x, h = traits[i], xxhash.xxh64_intdigest(t) - (1 << 63)
                        x["n"], x["chars"], x["links"] = x["n"] + 1, x["chars"] + len(t), x["links"] + k
                        x["low"] = h if x["low"] is None else min(h, x["low"])
                        x["high"] = h if x["high"] is None else max(h, x["high"])
                    key = xxhash.xxh128_hexdigest(page)
                    row |= {"signature": signature, "page_key": key, "traits": list(traits.values())}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


PARSED = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("signature_key", pa.string()),
        ("blocks", pa.list_(pa.string())), ("at", pa.list_(pa.int32())),
    ]
)
TRAIT = [(x, pa.int64()) for x in ("slot", "n", "chars", "links", "low", "high")]
TRAITS = pa.schema(
    [
        ("host", pa.string()), ("signature_key", pa.string()), ("signature", pa.string()), ("page_key", pa.string()),
        ("traits", pa.list_(pa.struct(TRAIT))),
    ]
)
TRAITS_DDL = (
    "host string, signature_key string, signature string, page_key string, traits array<struct<slot:bigint,n:bigint,"
    "chars:bigint,links:bigint,low:bigint,high:bigint>>"
)
PARSED_DDL = "page_id long, url string, host string, signature_key string, blocks array<string>, at array<int>"


def hosts(pages: DataFrame) -> DataFrame:
    return picked(pages, page_id="page_id", url="url", html="html").select(
        "page_id", "url", F.lower(F.regexp_extract(whole(F.col("url")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        whole(F.col("html")).alias("html"),
    )


def signatures(pages: DataFrame) -> DataFrame:
    """Per host and signature: different pages, and `traits` of its slots over those pages; stored."""
    rows = pages.mapInArrow(_parsed(False), TRAITS_DDL).dropDuplicates(["host", "page_key"])
    # One row for each trait: all pages of a host come down to a row per signature and slot.
    by_slot = (
        rows.select("host", "signature_key", "signature", F.explode("traits").alias("t"))
        .groupBy("host", "signature_key", "signature", "t.slot")
        .agg(
            F.count(F.lit(1)).alias("pages"), F.sum("t.n").alias("n"), F.sum("t.chars").alias("chars"),
            F.sum("t.links").alias("links"), F.min("t.low").alias("low"), F.max("t.high").alias("high"),
        )
    )
    return stored(by_slot, "page-signatures")


def _merged(key: list[str]):
    """One wrapper for each run of rows with equal `key`; rows come sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = None, None
        out = []
        for batch in batches:
            for row in batch.to_pylist():
                now, page = tuple(row[k] for k in key), unpacked(json.loads(row["signature"]))
                if now == held:
                    merge(tree, page)
                    continue
                if tree is not None:
                    out.append((held[0], json.dumps(tree.packed(), separators=(",", ":"))))
                held, tree = now, page
        if tree is not None:
            out.append((held[0], json.dumps(tree.packed(), separators=(",", ":"))))
        columns = list(zip(*out)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["host", "signature"])

    return run


def wrappers(found: DataFrame) -> DataFrame:
    """(host, signature) of the hosts' wrappers, from (host, signature_key, signature)."""
    trees = found.select("host", "signature_key", "signature").distinct()
    salted = trees.withColumn("salt", F.pmod(F.xxhash64("signature_key"), F.lit(SALTS)))
    first = (
        salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "signature_key")
        .select("host", "salt", "signature").mapInArrow(_merged(["host", "salt"]), "host string, signature string")
    )
    return (
        first.repartition("host").sortWithinPartitions("host", "signature")
        .mapInArrow(_merged(["host"]), "host string, signature string")
    )


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            wrapper, page = (unpacked(json.loads(row[c])) for c in ("wrapper", "signature"))
            own = slots(page)
            merge(wrapper, page)
            number = {id(node): (i, path) for i, (node, path) in enumerate(slots(wrapper))}
            for i, (node, path) in enumerate(own):
                j, _ = number[id(node.final())]
                rows.append((row["host"], row["signature_key"], i, j, role(path)))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "signature_key", "slot", "place", "role"]
        )


def roles(found: DataFrame) -> DataFrame:
    """(host, signature_key, main): the slots of each signature that hold main text; stored."""
    known = stored(wrappers(found), "wrappers").withColumnRenamed("signature", "wrapper")
    aligned = (
        found.select("host", "signature_key", "signature").distinct().join(known, "host")
        .mapInArrow(_aligned, "host string, signature_key string, slot long, place long, role string")
    )
    placed = stored(aligned.join(found.drop("signature"), ["host", "signature_key", "slot"]), "page-slots")
    # Slots of one signature at one place are on the same pages.
    by_signature = placed.groupBy("host", "place", "signature_key").agg(
        F.max("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("links").alias("links"), F.sum("chars").alias("chars"),
    )
    traits = by_signature.groupBy("host", "place").agg(
        F.sum("pages").alias("all_pages"), (F.min("low") == F.max("high")).alias("constant"),
        (F.sum("links") > LINK_SHARE * F.sum("chars")).alias("linked"),
    )
    spare = (F.col("role") == "open") & ~(
        (F.coalesce("constant", F.lit(False)) & (F.col("all_pages") >= CONSTANT_PAGES)) | F.coalesce("linked", F.lit(False))
    )
    by_page = placed.join(traits, ["host", "place"]).groupBy("host", "signature_key").agg(
        F.collect_list(F.when(F.col("role") == "main", F.col("slot"))).alias("main"),
        F.collect_list(F.when(spare, F.col("slot"))).alias("spare"),
    )
    chosen = by_page.select(
        "host", "signature_key", F.when(F.size("main") > 0, F.col("main")).otherwise(F.col("spare")).alias("main")
    )
    return stored(chosen, "page-roles")


def extract(pages: DataFrame) -> DataFrame:
    """Per row of (page_id, url, html): page_id, url, text and n_chars."""
    ship_package(pages.sparkSession)
    own = hosts(pages)
    chosen = roles(signatures(own))
    rows = own.mapInArrow(_parsed(True), PARSED_DDL).join(chosen, ["host", "signature_key"], "left")
    blocks = F.filter(
        F.col("blocks"), lambda b, i: F.array_contains(F.col("main"), F.get(F.col("at"), i).cast("long"))
    )
    text = F.coalesce(F.array_join(blocks, "\n"), F.lit(""))
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
