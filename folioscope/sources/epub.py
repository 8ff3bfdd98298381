"""E-books: packages of chapters in reading order, read from and written to zip bytes."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from folioscope.sources.markup import expand_entities, parse, Node

CHAPTER = "book string, title string, language string, spine_idx int, href string, chapter_title string, xhtml string"


class BookError(ValueError):
    """The package lacks a part it needs."""


def entries(data: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n) for n in z.namelist() if not n.endswith("/")}


def _xml(data: bytes) -> ET.Element:
    return ET.fromstring(expand_entities(data.decode("utf-8-sig", "replace")))


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _first(root: ET.Element, name: str) -> ET.Element | None:
    return next((e for e in root.iter() if _name(e) == name), None)


def resolve(base: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.split("#")[0].split("?")[0]))).lstrip("/")


def chapter_title(xhtml: str) -> str | None:
    """First of h1, h2, h3, title that has text."""
    found: dict[str, str] = {}

    def text(n) -> str:
        return n if isinstance(n, str) else "".join(map(text, n.kids))

    def walk(n: Node) -> None:
        for k in n.kids:
            if isinstance(k, Node):
                if k.tag in ("h1", "h2", "h3", "title") and k.tag not in found and text(k).strip():
                    found[k.tag] = " ".join(text(k).split())
                walk(k)

    walk(parse(xhtml))
    return next((found[t] for t in ("h1", "h2", "h3", "title") if t in found), None)


def load(data: bytes) -> dict:
    """Package of a book: title, language, cover, and its chapters in spine order."""
    files = entries(data)
    if "META-INF/container.xml" not in files:
        raise BookError("no container")
    root = _first(_xml(files["META-INF/container.xml"]), "rootfile")
    opf = root.get("full-path") if root is not None else None
    if not opf or opf not in files:
        raise BookError("no package document")
    package = _xml(files[opf])
    items = {e.get("id"): e for e in package.iter() if _name(e) == "item"}
    meta = lambda n: ((_first(package, n).text or "").strip() or None) if _first(package, n) is not None else None
    chapters = []
    for ref in (e for e in package.iter() if _name(e) == "itemref"):
        item = items.get(ref.get("idref"))
        if item is None:  # unknown references are dropped
            continue
        href = resolve(opf, item.get("href", ""))
        if href not in files:
            raise BookError(f"spine entry {href} is missing")
        text = files[href].decode("utf-8-sig", "replace")
        chapters.append({"href": href, "title": chapter_title(text), "xhtml": text})
    cover = next((e for e in items.values() if "cover-image" in (e.get("properties") or "").split()), None)
    if cover is None:
        named = next((e.get("content") for e in package.iter() if _name(e) == "meta" and e.get("name") == "cover"), None)
        cover = items.get(named)
    if cover is not None and not (cover.get("media-type") or "").startswith("image/"):
        cover = None
    return {"opf": opf, "title": meta("title"), "language": meta("language") or "und", "cover": resolve(opf, cover.get("href")) if cover is not None else None, "chapters": chapters, "files": files}


def write(files: dict[str, bytes]) -> bytes:
    """Zip bytes with the media type first and stored; other entries keep their bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), files.get("mimetype", b"application/epub+zip"), zipfile.ZIP_STORED)
        for name, data in files.items():
            if name != "mimetype":
                z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def translated(data: bytes, chapters: dict[str, str], language: str) -> bytes:
    """The book with new chapter texts and its package set to the new language."""
    book = load(data)
    files = dict(book["files"])
    for href, text in chapters.items():
        if href not in files:
            raise BookError(f"no chapter {href}")
        files[href] = text.encode()
    package = files[book["opf"]].decode("utf-8-sig")
    old = f">{book['language']}</"
    files[book["opf"]] = package.replace(old, f">{language}</", 1).encode()
    return write(files)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """One row a chapter of every book below ``path``; a bad book fails with its name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    b = load(bytes(data))
                except (BookError, zipfile.BadZipFile, ET.ParseError) as e:
                    raise BookError(f"{p}: {e}") from e
                rows += [(p, b["title"], b["language"], k, c["href"], c["title"], c["xhtml"]) for k, c in enumerate(b["chapters"])]
            yield pd.DataFrame(rows, columns=["book", "title", "language", "spine_idx", "href", "chapter_title", "xhtml"])

    return files.mapInPandas(run, CHAPTER)
