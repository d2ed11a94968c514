"""Toxicity by a weighted finite-state grammar over clauses.

Words become terminals: insult, threat, target, negation, reported speech. Three transducers
are composed over them: negation marks the insult or threat that it precedes, reported speech
marks what follows in its clause, and target marks what is aimed at someone, before or after.
Contractions (aren't, n'est) are terminals, too. Each arc that puts out a pattern such as
``insult``, ``insult+negated`` or ``threat+targeted`` carries a weight, which is the sum of the
weights of its marks and never below 0; a clause weighs what the arcs of its way weigh, and a
text's score is a logistic function of the logarithm of its clauses' weights. A target or a
negation without insult or threat weighs nothing, and neither does a negated insult unless the
labels say otherwise.

The marks' weights start at those of the grammar and are fitted to at most ``SAMPLE_ROWS``
labelled rows with their whole texts (the bound is a parameter), in one executor task. So are
further insults: words and stems that, in many different contexts, stand in texts labelled
toxic and hardly elsewhere. They become terminals of the grammar like those of its lexicon,
which has words of English, French, German and Spanish. The model has a fixed size and is
broadcast; every text is scored whole.

Edge cases: a null or empty text has no clause and gets the intercept's score; a text of any
length is read whole, in memory; a word of two kinds has the first in the lexicon's order; a
score of exactly 0.5 is predicted toxic; a null label is no example; without examples the
grammar's own weights hold; a null doc_id counts as the text 'null' for the split; repeated
rows each get their row; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import map_batches, remainder, thinned
from scholia.llm.textbytes import ALNUM, Words, blocks, buffer, mix, word_id, words
from scholia.llm.transducers import Transducer, compose, outputs, weighted

SAMPLE_ROWS = 6000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
INSULT, THREAT, TARGET, NEGATION, REPORT, END = "insult", "threat", "target", "negation", "report", "end"

#: The lexicon of the grammar, in English, French, German and Spanish.
LEXICON = {
    INSULT: """idiot idiots moron morons stupid dumb fool loser losers trash garbage scum scumbag pathetic worthless disgusting clown clowns imbecile retard bastard jerk freak creep pig filth vermin parasite coward liar fraud hideous ugly useless brainless
        idiote idiots imbécile imbéciles stupide abruti abrutis abrutie crétin crétins crétine connard connards connasse salaud salauds ordure débile minable lâche menteur
        idioten dumm dummkopf blödmann blöd trottel arschloch arschlöcher abschaum versager widerlich erbärmlich feigling lügner schwein
        idiotas idiota estúpido estúpida imbécil imbéciles tonto tonta basura escoria inútil asqueroso asquerosa cobarde mentiroso patético""",
    THREAT: """kill kills killing murder hurt destroy smash strangle stab shoot hang beat punch burn
        tuer tuerai frapper étrangler détruire brûler töten umbringen schlagen erwürgen verbrennen verprügeln matar mataré golpear destruir quemar estrangular""",
    TARGET: """you your yours yourself u ur she him his her they them their these those everyone people
        tu toi te vous votre du dich dir ihr euch sie usted ustedes ellos ellas ti""",
    NEGATION: """not never nobody none without isn't aren't wasn't weren't don't doesn't didn't won't can't couldn't wouldn't shouldn't ain't
        pas jamais aucun nicht nie niemals kein keine keinen nunca jamás ningún""",
    REPORT: """said says say told tells claimed claims wrote quoted quote called calls reported alleged
        dit disait affirme écrit sagte sagt behauptet schrieb dijo dice afirmó escribió""",
}
_BOUNDARY = np.isin(np.arange(256), list(b".!?;:\n"))

NEGATE = Transducer({(0, NEGATION): (1, None), (1, NEGATION): (0, None), (1, INSULT): (0, "insult+negated"), (1, THREAT): (0, "threat+negated"), (1, END): (0, END)})
REPORTED = Transducer({(0, REPORT): (1, None), (1, REPORT): (1, None), (1, END): (0, END)} | {(1, x): (1, f"{x}+reported") for x in (INSULT, THREAT, "insult+negated", "threat+negated")})
_MARKED = [x + y for x in (INSULT, THREAT) for y in ("", "+negated", "+reported", "+negated+reported")]
#: State 1: someone was named; 2: something was put out that a later target would be the aim of; 3: the same, but denied.
AIMED = Transducer(
    {(0, TARGET): (1, None), (1, TARGET): (1, None), (2, TARGET): (1, "aimed"), (3, TARGET): (1, None), (1, END): (0, None), (2, END): (0, None), (3, END): (0, None), (0, END): (0, None)}
    | {(s, x): (3 if "negated" in x else 2, x) for s in (0, 2, 3) for x in _MARKED} | {(1, x): (1, f"{x}+targeted") for x in _MARKED}
)
TERMINALS = {INSULT, THREAT, TARGET, NEGATION, REPORT, END}
GRAMMAR = compose(compose(NEGATE, REPORTED, TERMINALS), AIMED, TERMINALS)
PATTERNS = sorted(outputs(GRAMMAR))

#: What is weighed: the marks of outputs.
MARKS = ("hostile", "threat", "targeted", "negated", "reported", "aimed")
#: The grammar's own weights of the marks, to which fitted ones are drawn; that of negation outweighs an insult at someone.
PRIOR = (5.0, 0.0, 0.5, -6.0, -2.0, 0.2)
INTERCEPT, SLOPE = -3.0, 2.0
_HAS = np.array([[p != "aimed" if f == "hostile" else f in p.split("+") for f in MARKS] for p in PATTERNS], float)


def arc_weights(marks: np.ndarray) -> np.ndarray:
    """The weight of each pattern: the sum of its marks' weights, not below 0."""
    return np.maximum(_HAS @ marks, 0.0)


#: Lengths in bytes of the beginnings of words that can be learned as stems.
STEMS = (4, 5, 6)


def beginnings(data: np.ndarray, w: Words) -> dict[int, np.ndarray]:
    """The first bytes of each word as a number, by length; 0 for shorter words."""
    size, key, out = w.end - w.start, np.zeros(len(w.h), np.uint64), {}
    for j in range(max(STEMS)):
        key = key * np.uint64(256) + ALNUM[0][data[np.minimum(w.start + j, len(data) - 1)]]
        if j + 1 in STEMS:
            out[j + 1] = np.where(size > j, key, np.uint64(0))
    return out


@dataclass
class Model:
    ids: np.ndarray
    terminals: list[str]
    marks: np.ndarray
    slope: float
    intercept: float
    stems: dict[int, np.ndarray]

    def grammar(self) -> Transducer:
        """The composed transducer with this model's weights on its arcs."""
        return weighted(GRAMMAR, dict(zip(PATTERNS, arc_weights(self.marks).tolist())))


def _model(more: list[int] = (), stems: dict[int, np.ndarray] | None = None) -> Model:
    """The grammar's own model, with further insults by word id and by stem."""
    lex = {int(i): INSULT for i in more} | {_word(w): kind for kind, ws in reversed(LEXICON.items()) for w in ws.split()}
    ids = np.array(sorted(lex), np.uint64)
    return Model(ids, [lex[int(i)] for i in ids], np.array(PRIOR), SLOPE, INTERCEPT, stems or {})


def _word(word: str) -> int:
    """The id of a word of the lexicon; that of a contraction is made of its halves' ids."""
    head, _, tail = word.partition("'")
    return int(_joined(np.array([word_id(head)], np.uint64), np.array([word_id(tail)], np.uint64))[0]) if tail else word_id(word)


def _joined(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    return mix(head * np.uint64(3) + mix(tail))


def contracted(data: np.ndarray, w: Words) -> np.ndarray:
    """Ids of words; the t of a contraction after an apostrophe, straight or curved, stands for the whole of it."""
    h = w.h
    if len(h) < 2:
        return h
    h = h.copy()
    gap = w.start[1:] - w.end[:-1]
    straight = np.flatnonzero((gap == 1) & (data[np.minimum(w.end[:-1], len(data) - 1)] == 39))
    h[straight + 1] = np.where(w.h[straight + 1] == np.uint64(word_id("t")), _joined(w.h[straight], w.h[straight + 1]), w.h[straight + 1])
    # a curved one is of bytes that belong to words: ...n’t is one word, whose last five bytes are looked at
    long = np.flatnonzero(w.end - w.start > 5)
    at = w.end[long, None] + np.arange(-5, 0)
    curved = long[(ALNUM[0][data[at]] == np.frombuffer(b"n\xe2\x80\x99t", np.uint8)).all(axis=1)] if len(long) else long
    if len(curved):
        offs = np.concatenate([[0], np.cumsum(w.end[curved] - 4 - w.start[curved])])
        raw = np.concatenate([data[a : b - 4] for a, b in zip(w.start[curved].tolist(), w.end[curved].tolist())])
        h[curved] = _joined(words(raw, offs, ALNUM).h, np.full(len(curved), word_id("t"), np.uint64))
    return h


def patterns(model: Model, data: np.ndarray, w: Words) -> np.ndarray:
    """How often each pattern stands in each text."""
    out = np.zeros((len(w.ptr) - 1, len(PATTERNS)))
    if not len(w.h):
        return out
    h = contracted(data, w)
    at = np.minimum(np.searchsorted(model.ids, h), len(model.ids) - 1)
    known = model.ids[at] == h
    kinds = np.array([*model.terminals, INSULT])
    if model.stems:
        stem = np.zeros(len(w.h), bool)
        begin = beginnings(data, w)
        for k, own in model.stems.items():
            stem |= own[np.minimum(np.searchsorted(own, begin[k]), len(own) - 1)] == begin[k]
        at[stem & ~known] = len(kinds) - 1
        known |= stem
    hit = np.flatnonzero(known)
    if not len(hit):
        return out
    doc = np.searchsorted(w.ptr, hit, "right") - 1
    a = int(w.start[0])
    ends = np.concatenate([[0], np.cumsum(_BOUNDARY[data[a : int(w.end[-1])]])])
    clause = ends[w.start[hit] - a]
    fresh = np.concatenate([[True], (clause[1:] != clause[:-1]) | (doc[1:] != doc[:-1])])
    kind = np.isin(kinds, (INSULT, THREAT))[at[hit]]
    number = np.cumsum(fresh) - 1
    live = np.bincount(number, kind)[number] > 0  # clauses that hold an insult or a threat
    column = {p: k for k, p in enumerate(PATTERNS)}
    state = 0
    for d, k, new in zip(doc[live].tolist(), at[hit][live].tolist(), fresh[live].tolist()):
        if new:
            state, _ = GRAMMAR.step(state, END)
        state, o = GRAMMAR.step(state, kinds[k])
        if o is not None:
            out[d, column[o]] += 1
    return out


def scores(model: Model, counts: np.ndarray) -> np.ndarray:
    """Probabilities from pattern counts: the weights of all clauses' arcs, summed."""
    return 1 / (1 + np.exp(-(model.intercept + model.slope * np.log1p(counts @ arc_weights(model.marks)))))


def _learned(key: np.ndarray, w: Words, toxic: np.ndarray, texts: int = 8, contexts: int = 6, share: float = 0.7) -> np.ndarray:
    """Keys (word ids or beginnings) whose words stand in so many toxic texts, make up so much of their texts, and do so in so many contexts (copies of one text have one)."""
    n = len(toxic)
    doc = np.repeat(np.arange(n), np.diff(w.ptr))
    vocab, k = np.unique(key, return_inverse=True)
    pair = np.unique(k.astype(np.int64) * n + doc)
    all_ = np.bincount(pair // n, minlength=len(vocab))
    bad = np.bincount(pair // n, toxic[pair % n], minlength=len(vocab))
    good = np.flatnonzero((bad >= texts) & (bad >= share * all_) & (vocab > 0))
    if not len(good):
        return vocab[:0]
    spot = np.flatnonzero(np.isin(k, good) & (toxic[doc] > 0))
    before, after = np.where(spot > 0, spot - 1, 0), np.minimum(spot + 1, len(w.h) - 1)
    ctx = np.unique(np.stack([k[spot].astype(np.uint64), mix(w.h[before] * np.uint64(3) + w.h[after])], axis=1), axis=0)
    many = np.bincount(ctx[:, 0].astype(np.int64), minlength=len(vocab))
    return vocab[good[many[good] >= contexts]]


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Weights from whole labelled texts; they are drawn to the grammar's own."""
    if not texts:
        return _model()
    data, offs = buffer(pa.array(texts, pa.string()))
    w = words(data, offs, ALNUM)
    y = np.array(toxic, float)
    if not len(w.h):
        return _model()
    stems = {k: found for k, key in beginnings(data, w).items() if len(found := _learned(key, w, y))}
    model = _model(_learned(w.h, w, y).tolist(), stems)
    return _fitted(model, patterns(model, data, w), y)


def _fitted(model: Model, counts: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.05, pull: float = 0.5) -> Model:
    """Gradient steps (Adam) on the labels' log-likelihood, with a pull to the grammar's own weights. Texts without a pattern fix the intercept only."""
    prior = np.append(model.marks, [model.slope, model.intercept])
    strength = np.append(np.full(len(model.marks) + 1, pull), 0.01)
    theta, m, v = prior.copy(), np.zeros(len(prior)), np.zeros(len(prior))
    for t in range(1, steps + 1):
        marks, slope, intercept = theta[:-2], theta[-2], theta[-1]
        weight = _HAS @ marks
        s = counts @ np.maximum(weight, 0.0)
        p = 1 / (1 + np.exp(-np.clip(intercept + slope * np.log1p(s), -30, 30)))
        d = (p - y)
        inner = (d * slope / (1 + s)) @ counts  # by pattern
        g = np.concatenate([(inner * (weight > 0)) @ _HAS, [d @ np.log1p(s), d.sum()]]) + strength * (theta - prior)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.marks, model.slope, model.intercept = theta[:-2], max(float(theta[-2]), 0.1), float(np.clip(theta[-1], -12, 12))
    return model


def _fit_task(batches):
    texts, toxic = [], []
    for pdf in batches:
        texts += pdf["text"].tolist()
        toxic += pdf["toxic"].tolist()
    yield pd.DataFrame({"model": [pickle.dumps(fit(texts, toxic))]})


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of labelled training rows, in a task; only the model comes back. Labels are thinned by a hash of their id; so many are drawn that those whose document is missing leave enough, and all if few are found."""
    some = labels.where((remainder("doc_id", 5) != 0) & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("id_"), F.col("toxic").cast("int").alias("toxic_"))
    texts = docs.where((remainder("doc_id", 5) != 0) & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("id_"), F.col("text").cast("string").alias("text"))
    # ids first: texts are read only for the rows that are drawn
    found = thinned(some.join(texts.select("id_").distinct(), "id_", "left_semi"), "id_", sample_rows)
    drawn = found.orderBy(F.xxhash64("id_"), "id_", "toxic_").limit(sample_rows)
    rows = texts.join(F.broadcast(drawn), "id_").select("text", F.col("toxic_").alias("toxic")).orderBy(F.md5("text"), "toxic").limit(sample_rows)
    got = rows.repartition(1).mapInPandas(_fit_task, "model binary").collect()
    return pickle.loads(got[0].model) if got else _model()


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = spark.sparkContext.broadcast(train(docs, labels, sample_rows))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = buffer(batch.column(1))
        out = np.zeros(batch.num_rows)
        for a, b in blocks(offs):
            out[a:b] = scores(model.value, patterns(model.value, data, words(data, offs[a : b + 1], ALNUM)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (remainder("doc_id", 5) == 0).alias("held_out"))
    return map_batches(d, run, SCHEMA)
