"""Passages from blocks: sentences packed to a target size with an overlap, within a section."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions.text import word_count

TARGET, OVERLAP, LEAST = 300, 50, 30
_BREAK = re.compile(r"(?<=[.!?])\s+(?=[\"'(\[]?[A-Z0-9])")
#: What may stand before a dot that ends no sentence.
ABBREVIATIONS = frozenset("e.g i.e al vs cf fig figs ref refs eq eqs approx ca no nos sec min max resp etc dr prof s.d s.e.m ph.d st mr ms vol pp ed eds".split())


def sentences(text: str) -> list[str]:
    """Sentences of a text; a break after an abbreviation is none."""
    out: list[str] = []
    for piece in _BREAK.split(text):
        before = out[-1].rstrip() if out else ""
        if before.endswith(".") and before.rpartition(" ")[2].rstrip(".").lower() in ABBREVIATIONS:
            out[-1] += " " + piece
        else:
            out.append(piece)
    return out


def _windows(words: list[str], target: int, overlap: int, least: int) -> list[str]:
    step = max(1, target - overlap)
    starts = [s for s in range(0, len(words), step) if s == 0 or len(words) - s >= least]
    return [" ".join(words[s : s + target]) for s in starts]


def pack(text: str, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Passages of about target words: whole sentences, the last ones repeated up to overlap words; an over-long sentence is cut into windows; a short tail joins the passage before."""
    out: list[str] = []
    held: list[tuple[str, int]] = []
    size = 0
    for sentence in sentences(text):
        n = len(sentence.split())
        if n > target * 3 // 2:
            if size:
                out.append(" ".join(s for s, _ in held))
            held, size = [], 0
            out += _windows(sentence.split(" ") if "" not in sentence.split(" ") else [w for w in sentence.split(" ") if w], target, overlap, least)
            continue
        if size + n > target and size >= least:
            out.append(" ".join(s for s, _ in held))
            keep, carried = 0, 0
            while overlap > 0 and keep < len(held) and carried < overlap:
                more = held[-1 - keep][1]
                if keep and carried + more > overlap:
                    break
                keep, carried = keep + 1, carried + more
            held, size = held[len(held) - keep :], carried
        held.append((sentence, n))
        size += n
    if size:
        tail = " ".join(s for s, _ in held)
        if size < least and out:
            out[-1] += " " + tail
        else:
            out.append(tail)
    return out


def chunk(blocks: DataFrame, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST, need_body: bool = True) -> DataFrame:
    """Passages of blocks (article_key, section_index, block_index, kind, ...), numbered within their article.

    A section's blocks meet in one row by a partial aggregation; packing is one pass over
    Arrow batches; the running number is a window within the article.
    """
    if need_body:
        blocks = blocks.where("has_body")
    sections = blocks.groupBy("article_key", "section_index").agg(
        F.array_sort(F.collect_list(F.struct("block_index", "text"))).alias("parts"),
        F.min_by(F.struct("source_corpus", "kind", "section_title", "section_path", "title", "pub_year", "is_retracted"), "block_index").alias("s"),
    )
    sections = sections.select("article_key", "section_index", "s.*", F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(passages=[pack(t, target, overlap, least) if t.strip() else [] for t in pdf["text"]]).drop(columns="text")

    schema = ", ".join(f"{n} {t}" for n, t in sections.drop("text").dtypes) + ", passages array<string>"
    packed = sections.mapInPandas(run, schema).select("*", F.posexplode("passages").alias("place", "text")).drop("passages")
    return numbered(packed, "section_index", "place").select(
        "chunk_id", "article_key", "source_corpus", F.col("kind").alias("section_kind"), "section_title", "section_path", "section_index", "chunk_index", "text",
        word_count(F.col("text")).alias("word_count"), "title", "pub_year", "is_retracted",
    )


def numbered(passages: DataFrame, *order: str) -> DataFrame:
    """chunk_index: a passage's running number within its article_key; chunk_id: both, the number with four digits at least."""
    rows = passages.withColumn("chunk_index", F.row_number().over(Window.partitionBy("article_key").orderBy(*order)) - 1)
    number = F.col("chunk_index").cast("string")
    return rows.withColumn("chunk_id", F.concat("article_key", F.lit("#"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)))


def section_distribution(chunks: DataFrame) -> DataFrame:
    """Passages and words per section kind, with their share in percent."""
    kinds = chunks.groupBy("section_kind").agg(F.count("*").alias("chunks"), F.sum("word_count").alias("words"))
    return kinds.withColumn("percent", F.round(100 * F.col("chunks") / F.sum("chunks").over(Window.partitionBy()), 2)).orderBy(F.desc("chunks"), "section_kind")
