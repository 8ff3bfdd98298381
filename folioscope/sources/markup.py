"""Markup to segments: block hosts, inline placeholders, sentence budgets, and the way back.

A page is parsed into plain nodes; the innermost block elements that hold text
are hosts. In a host's text each inline element becomes ``[[Tn]]...[[/Tn]]`` and
each void element ``[[Tn]]``, numbered as they open; the skeleton keeps tag,
kind and attributes by number. Works on tag soup; never raises on bad markup.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Block elements, void elements, and subtrees without text to translate.
BLOCKS = frozenset(
    ["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "figcaption", "blockquote", "dt", "dd", "caption", "div", "section", "article", "aside", "header", "footer", "main"]
)
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
SKIP = frozenset("script style code pre head template".split())
TOKEN = re.compile(r"\[\[(/?)T(\d+)\]\]")
INVISIBLE = re.compile("[​‌‍⁠﻿]")


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:  # a block ends an open paragraph
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == "p":
                    del self.open[k:]
                    break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].kids.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def parse(text: str) -> Node:
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


def wrap_loose(node: Node) -> None:
    """In blocks that mix blocks with loose inline content, put each loose run into a block of its own."""
    for kid in node.kids:
        if isinstance(kid, Node):
            wrap_loose(kid)
    if node.tag not in BLOCKS or not any(isinstance(k, Node) and k.tag in BLOCKS for k in node.kids):
        return
    out, run = [], []

    def flush():
        if any((k.strip() if isinstance(k, str) else True) for k in run):
            box = Node("div", {"data-loose": "1"})
            box.kids = list(run)
            out.append(box)
        else:
            out.extend(run)
        run.clear()

    for kid in node.kids:
        if isinstance(kid, Node) and (kid.tag in BLOCKS or kid.tag in SKIP or holds_block(kid)):
            flush()
            out.append(kid)
        else:
            run.append(kid)
    flush()
    node.kids = out


def holds_block(node: Node) -> bool:
    return any(isinstance(k, Node) and (k.tag in BLOCKS or holds_block(k)) for k in node.kids)


def hosts(node: Node, path: str = "", lang: str | None = None, target: str | None = None) -> Iterator[tuple[str, Node]]:
    """Innermost blocks with their paths; subtrees already in the target language are left out."""
    seen: dict[str, int] = {}
    for kid in node.kids:
        if not isinstance(kid, Node):
            continue
        seen[kid.tag] = seen.get(kid.tag, 0) + 1
        at = f"{path}/{kid.tag}[{seen[kid.tag]}]"
        own = kid.attrs.get("xml:lang") or kid.attrs.get("lang") or lang
        if kid.tag in SKIP:
            continue
        if kid.tag in BLOCKS and not holds_block(kid):
            if not (target and own and own.split("-")[0].lower() == target.split("-")[0].lower()):
                yield at, kid
        else:
            yield from hosts(kid, at, own, target)


def find(root: Node, path: str) -> Node | None:
    """The node at a path, null if there is none; a malformed path is an error."""
    node = root
    for step in path.strip("/").split("/"):
        m = re.fullmatch(r"([\w:#-]+)\[(\d+)\]", step)
        if not m:
            raise ValueError(f"malformed path step {step!r}")
        same = [k for k in node.kids if isinstance(k, Node) and k.tag == m[1]]
        if int(m[2]) < 1 or int(m[2]) > len(same):
            return None
        node = same[int(m[2]) - 1]
    return node


def placeholders(node: Node) -> tuple[str, list[dict]]:
    """Text with numbered placeholders, and the skeleton."""
    out, skeleton = [], []

    def walk(n: Node) -> None:
        for kid in n.kids:
            if isinstance(kid, str):
                out.append(kid)
                continue
            k = len(skeleton)
            void = kid.tag in VOID
            skeleton.append({"tag": kid.tag, "kind": "void" if void else "pair", "attrs": dict(kid.attrs)})
            out.append(f"[[T{k}]]")
            if not void:
                walk(kid)
                out.append(f"[[/T{k}]]")

    walk(node)
    return "".join(out), skeleton


def rebuild(text: str, skeleton: list[dict]) -> Node:
    """Inverse of :func:`placeholders`; raises on unknown, unmatched and unclosed placeholders."""
    root = Node("#host")
    stack: list[tuple[int, Node]] = [(-1, root)]

    def put(s: str) -> None:
        if s:
            stack[-1][1].kids.append(s)

    at = 0
    for m in TOKEN.finditer(text):
        put(text[at : m.start()])
        at, k = m.end(), int(m[2])
        if k >= len(skeleton):
            raise ValueError(f"placeholder {k} is not in the skeleton")
        if m[1]:
            if stack[-1][0] != k:
                raise ValueError(f"placeholder {k} closes without being open")
            stack.pop()
            continue
        node = Node(skeleton[k]["tag"], dict(skeleton[k]["attrs"]))
        stack[-1][1].kids.append(node)
        if skeleton[k]["kind"] == "pair":
            stack.append((k, node))
    put(text[at:])
    if len(stack) > 1:
        raise ValueError(f"placeholder {stack[-1][0]} is never closed")
    return root


def to_markup(node: Node) -> str:
    out = []
    for kid in node.kids:
        if isinstance(kid, str):
            out.append(html.escape(kid, quote=False))
        else:
            attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in kid.attrs.items())
            out.append(f"<{kid.tag}{attrs}/>" if kid.tag in VOID else f"<{kid.tag}{attrs}>{to_markup(kid)}</{kid.tag}>")
    return "".join(out)


def plain(text: str) -> str:
    return " ".join(TOKEN.sub(" ", text).split())


def split_sentences(text: str, skeleton: list[dict], budget: int) -> list[tuple[str, list[dict]]]:
    """Parts of at most ``budget`` rough tokens, cut after sentence ends outside all pairs, each with its own numbering."""
    if max(1, len(text) // 4) <= budget:
        return [(text, skeleton)]
    depth, cuts, at = 0, [], 0
    for m in re.finditer(r"\[\[(/?)T(\d+)\]\]|[.!?]+\s+", text):
        if m[2] is None:
            if depth == 0:
                cuts.append(m.end())
        elif int(m[2]) < len(skeleton) and skeleton[int(m[2])]["kind"] == "pair":
            depth += -1 if m[1] else 1
    parts, start = [], 0
    for cut in [*cuts, len(text)]:
        if at > start and max(1, (cut - start) // 4) > budget:
            parts.append(text[start:at])
            start = at
        at = cut
    if start < len(text):
        parts.append(text[start:])
    out = []
    for part in parts:
        used = sorted({int(m[2]) for m in TOKEN.finditer(part)})
        new = {k: i for i, k in enumerate(used)}
        out.append((TOKEN.sub(lambda m: f"[[{m[1]}T{new[int(m[2])]}]]", part), [skeleton[k] for k in used]))  # noqa: B023
    return out


def segment(text: str, budget: int = 800, target: str | None = None) -> Iterator[dict]:
    """Segments of one page in reading order."""
    root, idx = parse(text), 0
    wrap_loose(root)
    for path, host in hosts(root, target=target):
        whole, skeleton = placeholders(host)
        if not INVISIBLE.sub("", TOKEN.sub("", whole)).strip():
            continue
        parts = split_sentences(whole, skeleton, budget)
        for k, (part, skel) in enumerate(parts):
            yield {"idx": idx, "host_path": path, "host_part": k, "host_total_parts": len(parts), "source_text": part, "source_hash": hashlib.sha256(part.encode()).hexdigest(), "skeleton": skel}
            idx += 1


SEGMENT = "idx int, host_path string, host_part int, host_total_parts int, source_text string, source_hash string, skeleton array<struct<tag:string,kind:string,attrs:map<string,string>>>"


def segments(pages: DataFrame, id_col: str, html_col: str, budget: int = 800, target: str | None = None) -> DataFrame:
    """One row a segment, partition by partition; null pages have none."""
    kind = dict(pages.dtypes)[id_col]

    def run(batches):
        for pdf in batches:
            rows = [{id_col: i} | s for i, page in zip(pdf[id_col], pdf[html_col], strict=True) if isinstance(page, str) for s in segment(page, budget, target)]
            yield pd.DataFrame(rows, columns=[id_col, "idx", "host_path", "host_part", "host_total_parts", "source_text", "source_hash", "skeleton"])

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {kind}, {SEGMENT}")


def reassemble(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """The parts of each host joined in order."""
    g = rows.groupBy(id_col, "host_path").agg(F.array_sort(F.collect_list(F.struct("host_part", F.col(text).alias("t")))).alias("x"))
    return g.select(id_col, "host_path", F.array_join(F.transform("x", lambda p: p["t"]), "").alias("text"))


def expand_entities(text: str) -> str:
    """Named entities to characters; the five of XML and unknown names stay."""
    keep = {"amp", "lt", "gt", "quot", "apos"}
    return re.sub(r"&([A-Za-z][A-Za-z0-9]*);", lambda m: m[0] if m[1] in keep else html.entities.html5.get(m[1] + ";", m[0]), text)
