"""Personal data: exact patterns, and a conditional random field over word shapes.

Patterns (the base spans) run over a text's bytes - all their characters are ASCII - and only
where its bytes can match at all. The field is trained from a small labelled table
(``pii_table``) by whoever builds it, once, and is a table of fixed size. Its features are a
word's collapsed shape, length, digits and hex digits, trigger words just before, and its
neighbours' shapes; all come from cumulative sums over the bytes, without an object for each
word. Viterbi decodes all lines of a block in step, and a very long line by pieces. Runs of
words with one label, without outer punctuation, are added spans; those that touch a base span
are dropped, as are those that do not hold what their kind must (a check number, for instance).
Hashes of commits and files are examples of what is no secret.

Edge cases: null counts as empty; spans are code points, end exclusive; a text of any length is
read whole, in memory; of two labels that score the same the first of ``KINDS`` wins, after
none; repeated rows each get their row; a null doc_id stays null; other columns are ignored by
``find`` and kept by ``mask``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm import pii_table
from scholia.llm.common import map_batches
from scholia.llm.crf import Crf, viterbi
from scholia.llm.textbytes import CHUNK, NONSPACE, blocks, buffer, mix, span_ids, word_id, words

#: In the order of the output; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")
BITS = 14
BLOCK_BYTES = 1 << 20
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

#: The patterns of the contract, over bytes.
_USER = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)


def luhn(digits: bytes) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, b in enumerate(reversed(digits)):
        d = b - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(raw: bytes, at: bool, plus: bool, digits: int) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in bytes, by kind and start. The flags say what the text holds."""
    out = []
    if at:
        last = 0
        pos = raw.find(b"@")
        while pos >= 0:
            a = pos
            while a > last and raw[a - 1] in _USER:
                a -= 1
            m = _DOMAIN.match(raw, pos) if a < pos else None
            if m:
                last = m.end()
                out.append((0, a, last))
            else:  # no start in this run can match; the next one may not reach back over it
                last = max(last, pos + 1)
            pos = raw.find(b"@", max(pos + 1, last))
    if digits >= 4:
        for m in _IP.finditer(raw):
            if all(len(p.lstrip(b"0")) <= 3 and int(p) <= 255 for p in m.group().split(b".")):
                out.append((1, *m.span()))
    if digits >= 16:
        for m in _CARD.finditer(raw):
            if m.end() - m.start() >= 16:
                d = m.group().translate(None, _NOT_DIGIT)
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append((2, *m.span()))
    if plus and digits >= 8:
        for m in _PHONE.finditer(raw):
            if 8 <= len(m.group().translate(None, _NOT_DIGIT)) <= 15:
                out.append((3, *m.span()))
    return out


_SHAPE = np.array([ord("9") if 48 <= b <= 57 else ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else b for b in range(256)], np.uint8)
_IS_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_IS_HEX = np.array([48 <= b <= 57 or 97 <= b <= 102 for b in range(256)])
#: Words that announce personal data, and signs that may follow them.
_TRIGGERS = ("token", "secret", "password", "passwd", "key", "api_key", "apikey", "email", "e-mail", "mail", "tel.", "tel", "phone", "phone:", "call", "card", "number", "ip", "ping", "from", "at", "=", ":", "token=", "password:", "key:", "secret:", "token:", "bearer", "authorization:", "iban", "iban:", "account", "ssn", "ssn:", "security", "commit", "hash", "sha256", "sha1", "md5", "checksum", "digest", "revision", "blob", "etag")


@lru_cache(1)
def _trigger_ids() -> np.ndarray:
    return np.sort(np.array([word_id(w, NONSPACE) for w in _TRIGGERS], np.uint64))


def _cum(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of the collapsed shape, digits, hex digits) of each word, in pieces of the buffer."""
    ids, digits, hexes = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + CHUNK)))
        a, b = int(start[i]), int(end[j - 1])
        x = data[a:b]
        s, e = start[i:j] - a, end[i:j] - a
        shape = _SHAPE[x]
        keep = np.ones(len(x), bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[s] = True
        k = _cum(keep)
        ids[i:j] = span_ids(shape[keep], k[s], k[e])
        c = _cum(_IS_DIGIT[x])
        digits[i:j] = c[e] - c[s]
        c = _cum(_IS_HEX[x])
        hexes[i:j] = c[e] - c[s]
        i = j
    return ids, digits, hexes


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Feature numbers of the words of chains ptr[i]:ptr[i + 1]."""
    shape, digits, hexes = shapes(data, start, end)
    size = np.minimum(end - start, 70).astype(np.uint64)
    trig = _trigger_ids()
    at = np.minimum(np.searchsorted(trig, h), len(trig) - 1)
    word = np.where(trig[at] == h, h, np.uint64(0))
    most = np.uint64((1 << BITS) - 1)

    def hashed(kind: int, key: np.ndarray) -> np.ndarray:
        return (mix(key * np.uint64(64) + np.uint64(kind)) % most + np.uint64(1)).astype(np.int64)

    def moved(x: np.ndarray, by: int) -> np.ndarray:
        """x of the word so many places before (after, if negative); 0 beyond the chain."""
        out = np.zeros(len(x), np.uint64)
        if by > 0:
            out[by:] = x[:-by]
            for k in range(by):
                p = ptr[:-1] + k
                out[p[p < np.minimum(ptr[1:], len(x))]] = 0
        else:
            out[:by] = x[-by:]
            for k in range(-by):
                p = ptr[1:] - 1 - k
                out[p[p >= ptr[:-1]]] = 0
        return out

    dig = np.minimum(digits, 20).astype(np.uint64)
    odd = np.minimum((end - start) - hexes, 4).astype(np.uint64)
    cols = [
        hashed(1, shape),
        hashed(2, shape * np.uint64(128) + size // np.uint64(4)),
        hashed(3, dig * np.uint64(128) + size),
        hashed(4, odd * np.uint64(128) + size // np.uint64(8)),
        hashed(5, moved(shape, 1)),
        hashed(6, moved(shape, -1)),
        hashed(7, moved(word, 1)),
        hashed(8, moved(word, 2)),
        hashed(9, moved(shape, 1) * np.uint64(3) + shape),
    ]
    return np.stack(cols, axis=1)


def _lines(data: np.ndarray, w) -> np.ndarray:
    """Chains: the words of a line of a text."""
    fresh = np.zeros(len(w.h), bool)
    fresh[w.ptr[:-1][w.ptr[:-1] < len(w.h)]] = True
    if len(w.h):
        a, b = int(w.start[0]), int(w.end[-1])
        nl = _cum(data[a:b] == 10)
        fresh[1:] |= nl[w.start[1:] - a] > nl[w.end[:-1] - a]
    return np.append(np.flatnonzero(fresh), len(w.h))


@lru_cache(1)
def model() -> Crf:
    """The field, fitted to the labelled table."""
    rows = pii_table.rows()
    data, offs = buffer(pa.array([t for t, _ in rows], pa.string()))
    w = words(data, offs, NONSPACE)
    gold = np.zeros(len(w.h), np.int64)
    for i, (_, spans) in enumerate(rows):
        for kind, a, b in spans:
            own = slice(w.ptr[i], w.ptr[i + 1])
            s, e = w.start[own] - offs[i], w.end[own] - offs[i]
            gold[own][(s < b) & (e > a)] = KINDS.index(kind) + 1
    crf = Crf(["O", *KINDS], BITS)
    crf.train(features(data, w.start, w.end, w.h, w.ptr), gold, w.ptr, epochs=12, batch=64)
    crf.squares = None
    return crf


#: Fewest letters and digits of an added span, by kind.
_LEAST = {"email": 6, "ip": 7, "card": 12, "phone": 7, "secret": 16, "iban": 15, "ssn": 9}
_IBAN = re.compile(rb"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}")
_SSN = re.compile(rb"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")
#: What of a run of words is the secret itself.
_SECRET = re.compile(rb"[0-9A-Za-z_/+.=-]{16,}")


def iban(raw: bytes) -> bool:
    """Whether the check number is right."""
    raw = raw.replace(b" ", b"")
    if not _IBAN.fullmatch(raw):
        return False
    return int("".join(str(int(chr(b), 36)) for b in raw[4:] + raw[:4])) % 97 == 1


def _plausible(kind: str, raw: bytes) -> bool:
    """What an added span must hold whatever the field says."""
    digits = sum(48 <= b <= 57 for b in raw)
    solid = sum(chr(b).isalnum() for b in raw if b < 128)
    if solid < _LEAST[kind]:
        return False
    if kind == "secret":
        return digits > 0 and digits < solid and b" " not in raw
    if kind == "phone":
        return digits >= 7 and not _SSN.fullmatch(raw)
    return {"email": b"@" in raw, "ip": digits >= 4 and raw.count(b".") == 3, "card": kind == "card" and luhn(raw.translate(None, _NOT_DIGIT)), "iban": kind == "iban" and iban(raw), "ssn": bool(_SSN.fullmatch(raw))}[kind]


def _merged(spans: list[tuple]) -> list[tuple[int, int]]:
    """Ranges that spans take up, in order, without overlaps."""
    out: list[tuple[int, int]] = []
    for _, s, e, *_ in sorted(spans, key=lambda x: x[1]):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def block_spans(crf: Crf, data: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """All spans of each text, as (kind number, start, end) in code points, by kind and start; base spans are those of the first four kinds that come with a fourth entry 1."""
    n = len(offs) - 1
    a, b = int(offs[0]), int(offs[-1])
    x = data[a:b]
    points = _cum((x & 0xC0) != 0x80)
    count = lambda f: np.diff(_cum(f)[offs - a])
    ats, plus, digits = count(x == 64), count(x == 43), count(_IS_DIGIT[x])
    out: list[list] = [[] for _ in range(n)]
    for i in np.flatnonzero((ats > 0) | (digits >= 4)).tolist():
        for kind, s, e in base_spans(data[offs[i] : offs[i + 1]].tobytes(), bool(ats[i]), bool(plus[i]), int(digits[i])):
            out[i].append((kind, s, e, 1))
    w = words(data, offs, NONSPACE)
    chains = _lines(data, w)
    lab = viterbi(crf.scores(features(data, w.start, w.end, w.h, chains)), chains, crf.trans)
    hit = np.flatnonzero(lab)
    taken = [_merged(own) for own in out]
    if len(hit):
        chain = np.searchsorted(chains, hit, "right")
        cut = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (lab[hit[1:]] != lab[hit[:-1]]) | (chain[1:] != chain[:-1])])
        first, last = hit[cut], hit[np.append(cut[1:], True)]
        doc = np.searchsorted(w.ptr, first, "right") - 1
        for f, l, d in zip(first.tolist(), last.tolist(), doc.tolist()):
            s, e = int(w.start[f]), int(w.end[l])
            raw = data[s:e].tobytes()
            kind = int(lab[f]) - 1
            if KINDS[kind] == "secret" and (m := max(_SECRET.finditer(raw), key=lambda m: len(m.group()), default=None)):
                value = m.group().strip(b".=-").rpartition(b"=")[2]
                s += m.start() + m.group().index(value)
                e, raw = s + len(value), value
            else:
                left = len(raw) - len(raw.lstrip(b"\"'<>[]{}.,;:!?=|*#$&%"))
                raw = raw.strip(b"\"'<>[]{}.,;:!?=|*#$&%")
                s += left
                e = s + len(raw)
            s, e = s - int(offs[d]), e - int(offs[d])
            at = bisect.bisect_right(taken[d], (s, len(data))) if taken[d] else 0
            free = not (at and taken[d][at - 1][1] > s) and not (at < len(taken[d]) and taken[d][at][0] < e)
            if free and _plausible(KINDS[kind], raw):
                out[d].append((kind, s, e, 0))
    for i, own in enumerate(out):
        if own:
            base = points[offs[i] - a]
            out[i] = sorted((k, int(points[offs[i] - a + s] - base), int(points[offs[i] - a + e] - base), real) for k, s, e, real in own)
    return out


def joined(spans: list[tuple]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in spans)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of its base spans, and all its spans."""
    crf = docs.sparkSession.sparkContext.broadcast(model())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = buffer(batch.column(1))
        counts, digest, spans = np.zeros((4, batch.num_rows), np.int64), [], []
        for a, b in blocks(offs, BLOCK_BYTES):
            for i, own in enumerate(block_spans(crf.value, data, offs[a : b + 1])):
                base = [s for s in own if s[3]]
                for s in base:
                    counts[s[0], a + i] += 1
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(own))
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), run, SCHEMA)


def mask(docs: DataFrame) -> DataFrame:
    """The documents with each span of ``text`` replaced by its kind in angle brackets (``n_chars``, where there is one, set anew); overlapping spans become one."""
    crf = docs.sparkSession.sparkContext.broadcast(model())
    t = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = buffer(batch.column(t))
        changed: dict[int, str] = {}
        for a, b in blocks(offs, BLOCK_BYTES):
            for i, own in enumerate(block_spans(crf.value, data, offs[a : b + 1])):
                if own:
                    text = data[offs[a + i] : offs[a + i + 1]].tobytes().decode("utf-8", "replace")
                    done, at = [], 0
                    for k, s, e, _ in sorted(own, key=lambda x: (x[1], -x[2])):
                        if s >= at:
                            done += [text[at:s], f"<{KINDS[k].upper()}>"]
                        at = max(at, e)
                    changed[a + i] = "".join(done) + text[at:]
        if not changed:
            return batch
        columns = list(batch.columns)
        texts = columns[t].to_pylist()
        for i, text in changed.items():
            texts[i] = text
        columns[t] = pa.array(texts, batch.schema.field(t).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = map_batches(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
