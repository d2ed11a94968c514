"""Visible text of HTML pages, by blocks, with the headings as section titles."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.operators.parsing import clean

#: Elements without passage text, and those that begin a block of their own.
HIDDEN = frozenset("script style nav head header footer noscript template svg form button select".split())
BLOCKS = frozenset("p div section article main li ul ol table tr td th blockquote pre h1 h2 h3 h4 h5 h6 br figure figcaption body html".split())


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.text, self.heading, self.title, self.found = 0, [], False, None, []

    def close_block(self) -> None:
        if text := clean("".join(self.text)):
            if self.heading:
                self.title = text
            else:
                self.found.append((self.title, text))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BLOCKS:
            self.close_block()
            self.heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.close_block()
            self.heading = False

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def visible(html: str | None) -> list[tuple[str | None, str]]:
    """(heading above, text) of each block."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.close_block()
    return p.found


def page_blocks(pages: DataFrame) -> DataFrame:
    """One row per block of (page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "b": [[{"section_title": t, "text": x} for t, x in visible(h)] for h in pdf["html"]]})

    found = pages.select("page_id", "html").mapInPandas(run, "page_id long, b array<struct<section_title:string, text:string>>")
    return found.select("page_id", F.posexplode("b").alias("block_index", "b")).select("page_id", "block_index", "b.*")
