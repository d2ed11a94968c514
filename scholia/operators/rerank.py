"""Second-stage scoring of few candidates: a pluggable scorer over (query, texts)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import scoring
from scholia.functions.analysis import analyze
from scholia.operators.search import top

Scorer = Callable[[str, list[str]], list[float]]
BATCH = 32


def lexical_scorer(query: str, texts: list[str]) -> list[float]:
    """Share of the query's distinct terms that a text holds: the built-in scorer, as no model ships here."""
    terms = set(analyze(query))
    return [len(terms & set(analyze(t))) / len(terms) if terms else 0.0 for t in texts]


def plain_scorer(query: str, texts: list[str]) -> list[float]:
    """The same share over runs of ASCII letters and digits, for indexes without stems."""
    words = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
    terms = words(query)
    return [len(terms & words(t)) / len(terms) if terms else 0.0 for t in texts]


def onnx_scorer(model_path: str, encode: Callable[[str, str], tuple[list[int], list[int]]]) -> Callable[[], Scorer]:
    """A factory of cross-encoder scorers for a model file; encode gives ids and segments of a pair. Pairs of like length share a batch."""

    def make() -> Scorer:
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(model_path)
        names = {i.name for i in session.get_inputs()}

        def score(query: str, texts: list[str]) -> list[float]:
            pairs = [encode(query, t) for t in texts]
            out = [0.0] * len(pairs)
            order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]))
            for a in range(0, len(order), BATCH):
                own = order[a : a + BATCH]
                width = -(-max(len(pairs[i][0]) for i in own) // 32) * 32
                ids, kinds, mask = (np.zeros((len(own), width), np.int64) for _ in range(3))
                for r, i in enumerate(own):
                    n = len(pairs[i][0])
                    ids[r, :n], kinds[r, :n], mask[r, :n] = pairs[i][0], pairs[i][1], 1
                feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": kinds}
                got = session.run(None, {k: v for k, v in feed.items() if k in names})[0].reshape(len(own), -1)[:, 0]
                for i, s in zip(own, got):
                    out[i] = float(s)
            return out

        return score

    return make


def pair_layout(query: list[int], passage: list[int], cls: int, sep: int, most: int = 512) -> tuple[list[int], list[int]]:
    """``[CLS] query [SEP] passage [SEP]`` with segments; the passage gives way first, the query only if it fills the budget."""
    query = query[: most - 3]
    passage = passage[: max(0, most - 3 - len(query))]
    return [cls, *query, sep, *passage, sep], [0] * (len(query) + 2) + [1] * (len(passage) + 1)


def pair_layout_bos(query: list[int], passage: list[int], bos: int, eos: int, most: int = 512) -> list[int]:
    """``bos query eos eos passage eos``; the query gets half the budget at most."""
    query = query[: most // 2]
    return [bos, *query, eos, eos, *passage[: max(0, most - 4 - len(query))], eos]


def rerank(ranked: DataFrame, queries: DataFrame, text: Column, k: int, prior: float = 0.0, make: Callable[[], Scorer] = lambda: lexical_scorer, digits: int | None = None) -> DataFrame:
    """The k best candidates by the scorer, with the additive citation prior. ``ranked`` is a bounded list per query, so a query's candidates are one group."""
    cand = ranked.withColumn("text_", text).join(queries.select("query_id", "query_text"), "query_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for pdf in batches:
            out = pdf.copy()
            for query, own in pdf.groupby("query_text").groups.items():
                out.loc[own, "score"] = scorer(query, pdf.loc[own, "text_"].fillna("").tolist())
            yield out

    schema = ", ".join(f"`{n}` {'double' if n == 'score' else t}" for n, t in cand.dtypes)
    done = cand.mapInPandas(run, schema).drop("text_", "query_text", "rank")
    score = scoring.citation_bonus(F.col("score"), F.col("citations"), prior)
    return top(done.withColumn("score", F.round(score, digits) if digits is not None else score), k)
