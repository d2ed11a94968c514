"""Articles from JATS XML and from PDS JSON, parsed in Arrow-batched Python workers.

Only what Spark has no expression for is done here: mixed-content XML and recursive JSON. The
result is one article row with an array of blocks, which DataFrame code takes from there.
"""

from __future__ import annotations

import datetime
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import NON_EVIDENTIAL, SECTION_TITLES, SECTION_TYPES
from scholia.schemas import ARTICLES, BLOCK

#: Elements whose text is no passage text, and abstracts that are no abstracts.
SKIPPED = frozenset("xref fig table-wrap table disp-formula inline-formula tex-math math graphic media supplementary-material fn fn-group label object-id alternatives".split())
NOT_ABSTRACTS = frozenset("graphical teaser video media".split())

_NUMBERED = re.compile(r"^[\d. ]+")
#: What cleaning takes out, in order; functions.text has the same for Columns.
_RULES = (
    (re.compile(r"\[\s*[,;–—-]*\s*\]"), ""),
    (re.compile(r"\(\s*[,;–—-]*\s*\)"), ""),
    (re.compile(r"[,;–—]+(?=\s*[.,;:!?])"), ""),
    (re.compile(r"[,;–—]+\s*$"), ""),
    (re.compile(r"\s+([,.;:!?])"), r"\1"),
    (re.compile(r"\s{2,}"), " "),
)


def clean(raw: str | None) -> str:
    """The worker-side twin of functions.text.clean_text."""
    text = (raw or "").translate({0xA0: " ", 13: " ", 10: " ", 9: " "})
    for pattern, by in _RULES:
        text = pattern.sub(by, text)
    return text.strip()


def classify(sec_type: str | None, title: str | None) -> str:
    """The worker-side twin of functions.text.classify_section."""
    kind = SECTION_TYPES.get((sec_type or "").strip().lower())
    if kind:
        return kind
    name = _NUMBERED.sub("", (title or "").strip().lower())
    return next((k for phrase, k in SECTION_TITLES if phrase in name), "Unknown")


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _attr(node: ET.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


class Node:
    """A thin view of an element by local names."""

    def __init__(self, element: ET.Element | None):
        self.e = element

    def __bool__(self) -> bool:
        return self.e is not None

    def all(self, name: str) -> list[Node]:
        return [Node(c) for c in self.e if _local(c) == name] if self else []

    def one(self, *path: str) -> Node:
        node = self
        for name in path:
            node = next(iter(node.all(name)), Node(None))
        return node

    def deep(self, name: str) -> list[Node]:
        return [Node(c) for c in self.e.iter() if c is not self.e and _local(c) == name] if self else []

    def attr(self, name: str) -> str | None:
        return _attr(self.e, name) if self else None

    @property
    def value(self) -> str | None:
        return "".join(self.e.itertext()).strip() if self else None

    def text(self, labels: bool = False) -> str:
        """Passage text: skipped elements left out, sub- and superscripts kept only if they say something."""
        return clean(_passage(self.e, labels)) if self else ""


def _passage(e: ET.Element, labels: bool) -> str:
    out = [e.text or ""]
    for child in e:
        name = _local(child)
        if name and (name not in SKIPPED or (labels and name == "label")):
            inner = _passage(child, labels)
            if name not in ("sup", "sub") or any(ch.isalnum() for ch in inner):
                out.append(inner)
        out.append(child.tail or "")
    return "".join(out)


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"\s*[+-]?\d{1,9}\s*", text) else None


def _words(text: str) -> int:
    return len(text.split())


def parse_jats(xml: bytes, source_path: str, corpus: str) -> dict | None:
    """One article with its blocks; None if the root is no article."""
    root = ET.fromstring(xml)
    if _local(root) != "article":
        return None
    article = Node(root)
    meta, journal = article.one("front", "article-meta"), article.one("front", "journal-meta")
    ids: dict[str, str] = {}
    for node in meta.all("article-id"):
        if node.value:
            ids[node.attr("pub-id-type") or ""] = node.value
    pmc, doi = ids.get("pmc"), (ids.get("doi") or "").lower() or None
    pmc = (pmc.upper() if pmc.lower().startswith("pmc") else "PMC" + pmc) if pmc else None
    group = journal.one("journal-title-group")
    short = {t.attr("abbrev-type"): t.value for t in reversed(group.all("abbrev-journal-title"))}
    titles = (group.one("journal-title").value, journal.one("journal-title").value, short.get("full"), short.get("pubmed"))
    issn: dict[bool, str | None] = {}
    for node in journal.all("issn"):
        issn[node.attr("pub-type") == "epub" or node.attr("publication-format") == "electronic"] = node.value

    people = []
    for c in meta.deep("contrib"):
        if c.attr("contrib-type") not in (None, "author"):
            continue
        name = c.one("name") or c.one("name-alternatives", "name")
        if not name:
            people += [c.one("collab").value] if c.one("collab") else []
        elif name.one("surname").value:
            people.append(", ".join(x for x in (name.one("surname").value, name.one("given-names").value) if x))

    dates = meta.all("pub-date")
    tests = (lambda d: d.attr("pub-type") == "epub", lambda d: d.attr("date-type") == "pub", lambda d: d.attr("pub-type") == "ppub", lambda d: d.attr("pub-type") == "collection", lambda d: bool(d.one("year")))
    date = next((d for t in tests for d in dates if t(d)), Node(None))

    license_ = meta.one("permissions", "license")
    url = next((n.value for n in license_.deep("license_ref")), None) or license_.attr("href") or next((h for n in license_.deep("ext-link") if (h := n.attr("href")) and "creativecommons" in h.lower()), None)

    abstracts = [a for a in meta.all("abstract") if a.attr("abstract-type") not in NOT_ABSTRACTS]
    chosen = next((a for a in abstracts if a.attr("abstract-type") is None), abstracts[0] if abstracts else Node(None))
    abstract = " ".join(t for p in chosen.deep("p") if (t := p.text())) or chosen.text() or None

    blocks: list[dict] = []
    sections = 0

    def add(kind: str, title: str | None, path: str | None, index: int, text: str) -> None:
        if text:
            blocks.append({"kind": kind, "section_title": title, "section_path": path, "section_index": index, "text": text})

    if abstract:
        add("Abstract", "Abstract", "Abstract", sections, abstract)
        sections += 1
    body = article.one("body")
    if leading := body.all("p"):
        for p in leading:
            add("Introduction", None, None, sections, p.text())
        sections += 1
    stack = [(sec, "Unknown", None) for sec in reversed(body.all("sec"))]
    while stack:
        sec, kind, above = stack.pop()
        title = sec.one("title").text() if sec.one("title") else None
        path = f"{above} > {title or ''}" if above else title
        if kind == "Unknown":  # the outermost recognised ancestor decides
            kind = classify(sec.attr("sec-type"), title)
        if kind not in NON_EVIDENTIAL:
            for p in sec.all("p"):
                add(kind, title, path, sections, p.text())
        sections += 1
        stack += [(child, kind, path) for child in reversed(sec.all("sec"))]
    for name, kind in (("fig", "FigureCaption"), ("table-wrap", "TableCaption")):
        for node in body.deep(name):
            text = node.one("caption").text(labels=True)
            if len(text) >= 20:
                label = node.one("label").value
                add(kind, label, label, sections, text)
                sections += 1
    own = [b for b in blocks if b["kind"] != "Abstract"]
    retracted = "retract" in (article.attr("article-type") or "").lower() or any("retract" in (r.attr("related-article-type") or "").lower() for r in meta.deep("related-article"))
    stem = source_path.replace("\\", "/").rpartition("/")[2].rpartition(".")[0]
    return {
        "article_key": pmc or (f"doi:{doi}" if doi else f"file:{stem}"), "source_corpus": corpus, "source_path": source_path, "pmcid": pmc, "pmid": ids.get("pmid"), "doi": doi,
        "title": meta.one("title-group", "article-title").text() if meta.one("title-group", "article-title") else None,
        "journal": next((t for t in titles if t is not None), None), "issn_electronic": issn.get(True), "issn_print": issn.get(False), "publisher": journal.one("publisher", "publisher-name").value,
        "article_type": article.attr("article-type"), "pub_year": _number(date.one("year").value), "pub_month": _number(date.one("month").value), "pub_day": _number(date.one("day").value),
        "license_url": url, "license_text": (license_.one("license-p") or license_).text() or None, "authors": "; ".join(people) or None,
        "keywords": "; ".join(k.value for g in meta.all("kwd-group") for k in g.all("kwd") if k.value) or None, "abstract": abstract, "abstract_word_count": _words(abstract or ""),
        "is_retracted": retracted, "has_body": bool(own), "body_word_count": sum(_words(b["text"]) for b in own), "section_count": sections,
        "reference_count": len(article.one("back").deep("ref")), "chunk_count": 0, "blocks": blocks,
    }


def flat_text(value: object) -> Iterator[str]:
    """The strings of text, nested lists of text, and objects with text."""
    if isinstance(value, str):
        if text := clean(value):
            yield text
    elif isinstance(value, list):
        for item in value:
            yield from flat_text(item)
    elif isinstance(value, dict) and "text" in value:
        yield from flat_text(value["text"])
    elif value is not None:
        raise ValueError(f"expected text, got {type(value).__name__}")


def _string(value: object, name: str) -> str | None:
    got = value.get(name) if isinstance(value, dict) else None
    if got is not None and not isinstance(got, str):
        raise ValueError(f"'{name}' must be a string or null")
    return clean(got) or None


def parse_pds(record: str, key: str, source_path: str, corpus: str) -> dict:
    """One article with its blocks; a record without a title, or of another shape, is an error."""
    paper = json.loads(record)
    if not isinstance(paper, dict) or not isinstance(paper.get("metadata"), dict):
        raise ValueError("a paper must be an object with metadata")
    meta = paper["metadata"]
    title = _string(meta, "title")
    if not title:
        raise ValueError("a paper needs a title")
    abstract = " ".join(flat_text(paper.get("abstract"))) or None
    year = month = day = None
    date = _string(meta, "publish date") or ""
    if re.fullmatch(r"\d{4}-\d\d-\d\d", date):
        try:
            parsed = datetime.date.fromisoformat(date)
            year, month, day = parsed.year, parsed.month, parsed.day
        except ValueError:
            pass
    elif re.fullmatch(r"\d{1,9}", date) and 1 <= int(date) <= 9999:
        year = int(date)
    blocks: list[dict] = []
    count = 0

    def add(kind: str, heading: str | None, path: str | None, text: str, index: int) -> None:
        blocks.append({"kind": kind, "section_title": heading, "section_path": path, "section_index": index, "text": text})

    if abstract:
        add("Abstract", "Abstract", "Abstract", abstract, count)
        count += 1

    def walk(sections: object, above: str | None, inherited: str) -> None:
        nonlocal count
        if sections is None:
            return
        if not isinstance(sections, list):
            raise ValueError("sections must be a list")
        for sec in sections:
            heading = _string(sec, "header title")
            name = (heading or "").lower()
            kind = "Abstract" if name == "abstract" else classify(None, heading)
            kind = inherited if kind == "Unknown" else kind  # a recognised inner heading wins here
            if kind in NON_EVIDENTIAL or name in ("references", "bibliography"):
                continue
            path = " / ".join(x for x in (above, heading) if x) or None
            index, count = count, count + 1
            for text in flat_text(sec.get("text") if isinstance(sec, dict) else None):
                add(kind, heading, path, text, index)
            for item in sec.get("tables") or [] if isinstance(sec, dict) and isinstance(sec.get("tables"), list) else []:
                if isinstance(item, dict) and (caption := _string(item, "caption")):
                    add("TableCaption", heading, path, caption, count)
                    count += 1
            walk(sec.get("subsections") if isinstance(sec, dict) else None, path, kind)

    walk((paper.get("body") or {}).get("sections") if isinstance(paper.get("body"), dict) else None, None, "Unknown")
    own = [b for b in blocks if b["kind"] != "Abstract"]
    refs = meta.get("bibliography")
    row = dict.fromkeys(c.strip().split()[0] for c in ARTICLES.replace("\n", " ").split(","))
    return row | {
        "article_key": f"{corpus}:{key}", "source_corpus": corpus, "source_path": source_path, "title": title, "authors": "; ".join(flat_text(meta.get("authors"))) or None, "journal": _string(meta, "journal"),
        "doi": _string(meta, "doi"), "abstract": abstract, "abstract_word_count": _words(abstract or ""), "pub_year": year, "pub_month": month, "pub_day": day, "is_retracted": False, "has_body": bool(own),
        "body_word_count": sum(_words(b["text"]) for b in own), "section_count": count, "reference_count": len(refs) if isinstance(refs, list) else 0, "chunk_count": 0, "blocks": blocks,
    }


PARSED = f"{ARTICLES}, blocks array<{BLOCK}>, error string"
_COLUMNS = [c.strip().split()[0] for c in ARTICLES.replace("\n", " ").split(",")] + ["blocks", "error"]


def _rows(found: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(c) for c in _COLUMNS] for r in found], columns=_COLUMNS)


def jats_articles(files: DataFrame) -> DataFrame:
    """Articles of (path, content, source_corpus); a file that can't be parsed has its error and no key, another root gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path, content, corpus in zip(pdf["path"], pdf["content"], pdf["source_corpus"]):
                try:
                    row = parse_jats(bytes(content if content is not None else b""), path, corpus)
                except (ET.ParseError, ValueError, LookupError) as e:  # LookupError: an encoding that is not known
                    row = {"source_path": path, "source_corpus": corpus, "error": str(e)}
                found += [row] if row else []
            yield _rows(found)

    return files.select("path", "content", "source_corpus").mapInPandas(run, PARSED)


def pds_articles(records: DataFrame, corpus: str, fail: bool = True) -> DataFrame:
    """Articles of (key, value, path); an invalid record stops the job, or with fail=False has its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for key, value, path in zip(pdf["key"], pdf["value"], pdf["path"]):
                try:
                    found.append(parse_pds(value, key, path, corpus))
                except (ValueError, TypeError) as e:
                    if fail:
                        raise ValueError(f"{key}: {e}") from e
                    found.append({"source_path": path, "source_corpus": corpus, "error": str(e)})
            yield _rows(found)

    return records.select("key", "value", "path").mapInPandas(run, PARSED)


def blocks(articles: DataFrame) -> DataFrame:
    """One row per block, in order."""
    return articles.select("article_key", "source_corpus", "title", "pub_year", "is_retracted", "has_body", F.posexplode("blocks").alias("block_index", "b")).select("*", "b.*").drop("b")
