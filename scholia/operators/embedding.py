"""Vectors of texts in Arrow batches: an encoder of token ids, a model session, pooling and length 1.

Encoder and session are made once in each task by factories, so that neither is shipped; a task
slot is the admission control. Texts of like length share a batch, padded to a multiple of
``PAD``. No model ships here: ``hashed_session`` is a fixed stand-in for tests and benches.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.analysis import analyze

MAX_TOKENS, PAD, BATCH, BUFFER = 512, 64, 32, 65_536
#: Token ids of a text.
Encoder = Callable[[str], list[int]]
#: (ids, mask) to states of (texts, places, dimensions).
Session = Callable[[np.ndarray, np.ndarray], np.ndarray]


def wordpiece_encoder(vocab_path: str, lower: bool = True) -> Encoder:
    """A BERT word-piece encoder for a vocabulary file, with [CLS] and [SEP]."""
    from tokenizers import BertWordPieceTokenizer

    tok = BertWordPieceTokenizer(vocab_path, lowercase=lower)
    return lambda text: tok.encode(text).ids


def file_encoder(path: str) -> Encoder:
    """An encoder from a tokenizer's JSON file, with the special tokens that it defines."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return lambda text: tok.encode(text).ids


def hashed_encoder(text: str) -> list[int]:
    """Ids of analysed words by a checksum, after a first id for the whole."""
    return [1, *(2 + zlib.crc32(w.encode()) % 30_000 for w in analyze(text))]


def choose_encoder(vocab: str | None = None, tokenizer: str | None = None) -> Callable[[], Encoder]:
    """The encoder that a model folder calls for: a tokenizer's JSON file goes before a vocabulary file; without either words are hashed."""
    if tokenizer:
        return lambda: file_encoder(tokenizer)
    if vocab:
        return lambda: wordpiece_encoder(vocab)
    return lambda: hashed_encoder


def onnx_session(path: str) -> Callable[[], Session]:
    """A factory of sessions of a model file; inputs that the model does not name are left out."""

    def make() -> Session:
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        names = {i.name for i in session.get_inputs()}

        def run(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
            feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            return session.run(None, {k: v for k, v in feed.items() if k in names})[0]

        return run

    return make


def hashed_session(dimensions: int = 64) -> Callable[[], Session]:
    """A factory of sessions that give each id a fixed random state."""

    def make() -> Session:
        table = np.random.default_rng(11).normal(size=(30_002, dimensions)).astype(np.float32)
        return lambda ids, mask: table[ids]

    return make


def batches(sizes: list[int], batch: int = BATCH, buffer: int = BUFFER) -> list[list[int]]:
    """Places of texts in batches of like length: within each buffer of so many texts the longest come first, so that a task's peak is at its start."""
    out = []
    for a in range(0, len(sizes), buffer):
        order = sorted(range(a, min(len(sizes), a + buffer)), key=lambda i: -sizes[i])
        out += [order[k : k + batch] for k in range(0, len(order), batch)]
    return out


def pool(states: np.ndarray, mask: np.ndarray, pooling: str, unit: bool) -> np.ndarray:
    """One vector a text: the first state ("cls") or the mean over the mask ("mean"), at length 1 if asked for."""
    if pooling == "cls":
        v = states[:, 0]
    elif pooling == "mean":
        v = (states * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]
    else:
        raise ValueError(f"unknown pooling: {pooling}")
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if unit else v


def embed_texts(texts: list[str], encode: Encoder, session: Session, pooling: str = "cls", unit: bool = True, max_tokens: int = MAX_TOKENS, pad: int = PAD) -> tuple[list[np.ndarray], dict]:
    """(vectors in the order of the texts, counts of tokens and of padding)."""
    ids = [encode(t)[:max_tokens] or [0] for t in texts]
    out: list = [None] * len(ids)
    seen = {"texts": len(ids), "tokens": sum(map(len, ids)), "padded": 0}
    for own in batches([len(x) for x in ids]):
        width = -(-max(len(ids[i]) for i in own) // pad) * pad
        block, mask = np.zeros((len(own), width), np.int64), np.zeros((len(own), width), np.int64)
        for r, i in enumerate(own):
            block[r, : len(ids[i])], mask[r, : len(ids[i])] = ids[i], 1
        seen["padded"] += block.size
        for i, v in zip(own, pool(session(block, mask), mask, pooling, unit)):
            out[i] = v
    return out, seen


def embed(rows: DataFrame, id: str, text: Column, encoder: Callable[[], Encoder] = lambda: hashed_encoder, session: Callable[[], Session] | None = None, pooling: str = "cls", unit: bool = True, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(id, embedding) of the rows' texts; null counts as empty."""
    session = session or hashed_session()
    narrow = rows.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, model = encoder(), session()
        for pdf in pdfs:
            vectors, _ = embed_texts(pdf["text"].tolist(), encode, model, pooling, unit, max_tokens)
            yield pd.DataFrame({"id": pdf["id"], "embedding": [v.astype(np.float32).tolist() for v in vectors]})

    return narrow.mapInPandas(run, f"id {narrow.schema['id'].dataType.simpleString()}, embedding array<float>")


def throughput(texts: list[str], encode: Encoder, session: Session, **options: object) -> dict:
    """Texts and padded tokens a second, and the share of padding, over one run."""
    import time

    start = time.perf_counter()
    _, seen = embed_texts(texts, encode, session, **options)
    took = time.perf_counter() - start
    return seen | {"seconds": took, "texts_s": seen["texts"] / took, "padded_tokens_s": seen["padded"] / took, "waste": 1 - seen["tokens"] / max(seen["padded"], 1)}


def parity(encode: Encoder, samples: list[tuple[str, list[int]]]) -> list[str]:
    """Texts whose ids are not those of exported samples."""
    return [t for t, ids in samples if encode(t) != ids]


def drift(a: np.ndarray, b: np.ndarray, most: float = 1e-3) -> float:
    """The largest difference of two models' outputs; more than most is an error."""
    gap = float(np.abs(a - b).max()) if a.size else 0.0
    if gap > most:
        raise ValueError(f"outputs differ by {gap}")
    return gap
