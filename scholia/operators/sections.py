"""Chunks of articles in XML by their sections: short paragraphs join the chunk before, lists stay together if they fit."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# A paragraph shorter than SHORT joins the chunk before it where both stay below MOST characters.
SHORT, MOST = 200, 1000
#: Articles that a task has as Python texts at a time.
PART = 64
CHUNK = "id string, title string, content string, contents string"


def plain(element: ET.Element) -> str:
    """The text of an element and all below it, parts trimmed and joined by blanks."""
    parts = [(element.text or "").strip()]
    for child in element:
        parts += [plain(child), (child.tail or "").strip()]
    return " ".join(p for p in parts if p)


def is_subtitle(element: ET.Element) -> bool:
    """Whether a paragraph is one bold element and nothing after it."""
    return element.tag == "p" and len(element) == 1 and element[0].tag == "bold" and not (element[0].tail or "").strip()


def titled(title: str, content: str) -> str:
    head = title.strip()
    return f"{head}{'' if head[-1:] in '.?!' and head else '.'} {content.strip()}"


class _Chunks:
    """The chunks of one article; the last one stays open while more may join it."""

    def __init__(self, name: str):
        self.name, self.rows, self.open = name, [], False

    def joins(self, text: str, joined: str) -> bool:
        """Join text to the open chunk if both together (as joined is long) stay below MOST."""
        if self.open and len(self.rows[-1][1]) + len(joined) < MOST:
            self.rows[-1][1] += " " + text
            return True
        return False

    def add(self, title: str, text: str, stays_open: bool = True) -> None:
        self.rows.append([title, text])
        self.open = stays_open


def chunks(name: str, xml: str) -> list[tuple[str, str, str, str]]:
    """id, title, content and contents of an article's chunks, in order; what isn't XML gives none.

    A title is the article's, the section's and, below a subtitle, that; a subtitle starts a new chunk, and its part of the
    title ends after a list that follows it at once.
    """
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    found = _Chunks(name)
    top = root.find(".//title")
    article = (top.text or "").strip() if top is not None else ""
    for section in root.findall(".//sec"):
        own = section.find("./title")
        base = f"{article} -- {(own.text or '').strip() if own is not None else ''}"
        title, before, found.open = base, None, False
        for element in section:
            if is_subtitle(element):
                title, found.open = f"{base} -- {plain(element)}", False
            elif element.tag == "p":
                text = plain(element)
                if not (len(text) < SHORT and found.joins(text, text)):
                    found.add(title, text)
            elif element.tag == "list":
                items = [plain(item) for item in element]
                text = " ".join(items)
                if not found.joins(text, text):
                    if len(text) < MOST:
                        found.add(title, text)
                    else:
                        for item in items:
                            found.add(title, item, stays_open=False)
                        found.open = False
                if before is not None and is_subtitle(before):
                    title = base
            before = element
    return [(f"{name}_{i}", title, text, titled(title, text)) for i, (title, text) in enumerate(found.rows)]


def section_chunks(files: DataFrame) -> DataFrame:
    """CHUNK rows of files (name, xml), one pass over Arrow batches; null texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):  # chunks hold each text twice, so few at a time
                part = batch.slice(at, PART)
                rows = [c for name, xml in zip(part.column("name").to_pylist(), part.column("xml").to_pylist()) if xml for c in chunks(name, xml)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in range(4)], ["id", "title", "content", "contents"])

    return files.select("name", "xml").mapInArrow(run, CHUNK)
