"""Corrections of ingested articles: finding a published abstract in a body, and applying reviewed changes.

Texts are compared by their letters and digits alone (``skeleton``), so that spaces, dashes and
accents don't matter; places found there are carried back to the original by their numbers.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.session import share_code

#: Signs that close a sentence together with its stop.
CLOSING = "\"'’”)]}"
#: Sentences that may begin an abstract, how long one must be to be a candidate, and how many may make it up.
FIRST_SENTENCES, LEAST_SIGNS, MOST_SENTENCES = 80, 40, 40
LEAST_SIMILARITY = 0.85
_STOP = re.compile(r"[.!?]+[" + re.escape(CLOSING) + r"]*(?=\s+[\"'(\[‘“]?[A-Z0-9])")
MATCHED = "key string, status string, similarity double, edits array<struct<path:string,original_text:string,replacement_text:string>>, suggested array<string>"


class _Signs(dict):
    """A code point's letters and digits, as skeleton() takes them; for str.translate."""

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(part.lower()[:1] for part in unicodedata.normalize("NFD", chr(code)) if part.isalnum())
        return out


_SIGNS = _Signs()
#: ASCII in lower case, and what of it is dropped; the bytes of other signs stay.
_LOWER, _DROPPED = bytes(range(128)).lower() + bytes(range(128, 256)), bytes(c for c in range(128) if not chr(c).isalnum())
_OTHERS = re.compile(r"[^\x00-\x7f]+")


def signs_of(text: str) -> str:
    """The signs of skeleton() without their places."""
    kept = text.encode("utf-8", "surrogatepass").translate(_LOWER, _DROPPED).decode("utf-8", "surrogatepass")
    return kept if kept.isascii() else _OTHERS.sub(lambda m: m[0].translate(_SIGNS), kept)


def skeleton(text: str | None) -> tuple[str, list[int]]:
    """(letters and digits in lower case without marks, the place in text of each)."""
    signs, places = [], []
    for i, ch in enumerate(text or ""):
        for part in unicodedata.normalize("NFD", ch):
            if part.isalnum():
                signs.append(part.lower()[:1])
                places.append(i)
    return "".join(signs), places


def segments(text: str) -> list[tuple[int, int]]:
    """Places of the sentences: a sentence takes the quotes and brackets that close it, and together they cover all but white space."""
    edges = [0, *(m.end() for m in _STOP.finditer(text)), len(text)]
    out = []
    for a, b in zip(edges, edges[1:]):
        a += len(text[a:b]) - len(text[a:b].lstrip())
        b = a + len(text[a:b].rstrip())
        if a < b:
            out.append((a, b))
    if "".join("".join(text[a:b] for a, b in out).split()) != "".join(text.split()):
        raise ValueError("the sentences lost a part of the text")
    return out


def similarity(a: str, b: str, least: float = 0.0) -> float:
    """Share of matching signs of two sequences, as difflib's ratio() without junk: the longest common run, of equal ones the first in a and then in b, and so on before and after it.

    Below ``least`` the value may be an upper bound that lies below it as well.
    """
    total = len(a) + len(b)
    if a == b:
        return 1.0
    found, open_ = 0, min(len(a), len(b))  # signs matched, and the most that the ranges still to do can add
    todo = [(0, len(a), 0, len(b))]
    while todo and 2.0 * (found + open_) / total >= least:
        a0, a1, b0, b1 = todo.pop()
        room = min(a1 - a0, b1 - b0)
        open_ -= room
        size, i, at, to = 0, a0, a0, b0
        while size < room and i + size < a1:
            j = b.find(a[i : i + size + 1], b0, b1)
            if j < 0:
                i += 1
                continue
            size, at, to = size + 1, i, j
            while i + size < a1 and j + size < b1 and a[i + size] == b[j + size]:
                size += 1
        if size:
            found += size
            for part in ((a0, at, b0, to), (at + size, a1, to + size, b1)):
                if (most := min(part[1] - part[0], part[3] - part[2])) > 0:
                    todo.append(part)
                    open_ += most
    return 2.0 * (found + open_) / total


def most_similar(pairs: list[tuple[str, str, int]]) -> tuple[float, int]:
    """The largest (similarity, number) of (a, b, number); numbers differ. A pair is compared only if neither its lengths nor the signs that both have rule it out."""
    best = (-1.0, -1)
    queue = []
    for a, b, n in pairs:
        total = len(a) + len(b)
        bound = 1.0 if a == b else 2.0 * min(len(a), len(b), (total - 1) // 2) / total
        queue.append((-bound, -n, a == b, a, b))
    heapq.heapify(queue)
    while queue and (-queue[0][0], -queue[0][1]) > best:
        bound, n, counted, a, b = heapq.heappop(queue)
        if counted:
            best = max(best, (similarity(a, b, best[0]), -n))
        else:
            common = sum((Counter(a) & Counter(b)).values())
            heapq.heappush(queue, (max(bound, -2.0 * common / (len(a) + len(b))), n, True, a, b))
    return best


def _edit(path: str, text: str, size: int, a: int, b: int) -> tuple[str, str, str | None]:
    """The sentence without signs a to b of its skeleton, which has size signs."""
    if a == 0 and b >= size:
        return path, text, None
    places = skeleton(text)[1]
    begin = places[a] if a else 0
    end = places[b] if b < size else len(text)
    return path, text, (text[:begin] + text[end:]).strip() or None


def find_in_body(reference: str | None, sentences: list[tuple[str, str]]) -> tuple[str, float, list[tuple], list[str]]:
    """(status, similarity, edits, paths of a suggested window) of a published abstract in a body's (path, text) sentences: edits where it stands once, a window to look at where it does not."""
    want = signs_of(reference or "")
    if not want:
        return "no_published_abstract", 0.0, [], []
    bare = [signs_of(t) for _, t in sentences]
    whole = "".join(bare)
    at = whole.find(want)
    if at >= 0 and whole.find(want, at + 1) >= 0:
        return "multiple_complete_matches", 1.0, [], []
    if at >= 0:
        edits, begin = [], 0
        for (path, text), signs in zip(sentences, bare):
            a, b = max(0, at - begin), min(len(signs), at + len(want) - begin)
            begin += len(signs)
            if a < b:
                edits.append(_edit(path, text, len(signs), a, b))
        return ("partial_sentence_match" if any(e[2] for e in edits) else "complete_normalized_match"), 1.0, edits, []
    starts = [(s, want[: len(s)], i) for i, s in enumerate(bare[:FIRST_SENTENCES]) if len(s) >= LEAST_SIGNS]
    first = most_similar(starts)[1] if starts else 0
    windows, text = [], ""
    for last in range(first, min(len(bare), first + MOST_SENTENCES)):
        text += bare[last]
        windows.append((want, text, last + 1))
        if len(text) > 2 * len(want):
            break
    best = max((0.0, first), most_similar(windows))
    return "needs_boundary_review", best[0], [], [p for p, _ in sentences[first : best[1]]]


def reviewed(reference: str, sentences: list[tuple[str, str]], first: int, last: int, keep: list[str] = ()) -> list[tuple]:
    """Edits of a window that a person has chosen; sentences to keep must stand in it once, and the rest must still be like the abstract."""
    window = sentences[first:last]
    if not 0 <= first < last <= len(sentences) or any(sum(t == k for _, t in window) != 1 for k in keep):
        raise ValueError("the reviewed window has changed")
    gone = [(p, t) for p, t in window if t not in keep]
    if similarity(skeleton(reference)[0], skeleton(" ".join(t for _, t in gone))[0]) < LEAST_SIMILARITY:
        raise ValueError("the reviewed window is no longer like the abstract")
    return [(p, t, None) for p, t in gone]


def match_bodies(papers: DataFrame) -> DataFrame:
    """find_in_body() for rows (key, reference, sentences array<struct<path, text>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sentences = batch.column("sentences")
            size = pc.fill_null(pc.list_value_length(sentences), 0).to_pylist()
            paths, texts = (pc.struct_field(sentences.flatten(), x) for x in ("path", "text"))
            found, begin = [], 0
            for reference, n in zip(batch.column("reference").to_pylist(), size):
                body = zip(paths.slice(begin, n).to_pylist(), (t or "" for t in texts.slice(begin, n).to_pylist())) if reference else ()
                found.append(find_in_body(reference, list(body)))
                begin += n
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(x, k) for x, k in zip(zip(*found), kinds))], names)

    names = ["key", "status", "similarity", "edits", "suggested"]
    kinds = [pa.string(), pa.float64(), pa.list_(pa.struct([(x, pa.string()) for x in ("path", "original_text", "replacement_text")])), pa.list_(pa.string())]
    share_code(papers.sparkSession)
    return papers.select(F.col("key").cast("string"), "reference", "sentences").mapInArrow(run, MATCHED)


def status_histogram(matches: DataFrame) -> DataFrame:
    """Papers and edits of each status."""
    return matches.groupBy("status").agg(F.count("*").alias("papers"), F.sum(F.size("edits")).alias("edits"))


def corrected(originals: DataFrame, plan: DataFrame, corrections: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The originals with the corrections' values of some columns, for the keys of the plan; plan and corrections must have the same keys, all of them known, each once."""
    c = corrections.select(F.col(key).alias("c_"), *(F.col(x).alias(f"{x}_c") for x in columns))
    p = plan.select(F.col(key).alias("p_")).distinct()
    pairs = p.join(c, F.col("p_") == F.col("c_"), "full_outer")
    both = pairs.select(must("p_", "c_").alias("key_"), *(f"{x}_c" for x in columns))
    known = both.join(originals.select(F.col(key).alias("o_")).distinct(), F.col("key_") == F.col("o_"), "left")
    done = originals.join(known.select(must("o_", "key_").alias("k_"), *(f"{x}_c" for x in columns)), F.col(key) == F.col("k_"), "left")
    return done.select(*(F.when(F.col("k_").isNotNull(), F.col(f"{x}_c")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in originals.columns))


def must(a: str, b: str):
    """A key that both sides have; one that only one side has is an error."""
    return F.when(F.col(a).isNull() | F.col(b).isNull(), F.raise_error(F.concat(F.lit("key on one side only: "), F.coalesce(F.col(a), F.col(b)).cast("string")))).otherwise(F.col(a))


def changed_columns(before: DataFrame, after: DataFrame, key: str) -> list[str]:
    """Columns in which any row of a key differs: the check that a repair changed nothing else."""
    names = [c for c in before.columns if c != key]
    pairs = before.alias("b").join(after.alias("a"), key, "full_outer")
    row = pairs.agg(*(F.count_if(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))).alias(c) for c in names)).first()
    return [c for c in names if row[c]]
