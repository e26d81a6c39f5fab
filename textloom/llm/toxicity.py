"""Toxic spans by a linear-chain conditional random field; forward-backward marginals add up to document scores.

The field has two states (other, toxic). Its token labels come from the documents' labels: a token of a toxic document
is labelled toxic if its word, or a prefix of it, occurs so much more in toxic documents of the training sample that
chance is excluded even for as many words as were tried (binomial divergence with Bonferroni's correction). Emission
weights belong to words and prefixes, so unseen inflections of a known stem are found; transitions are learned too. A
logistic function of the largest marginal and of their sum, fitted on the same sample, gives the score.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.shared_store import materialize
from textloom.llm.names import keeps_other_columns
from textloom.llm.worker_memory import gives_back

EDGE = ".,;:!?()[]{}<>\"'*&%$#|/\\-_=+~`"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PREFIXES = (4, 5, 6)
CACHE_WORDS = 150_000
#: Tokens of a chain when the field is learned; scoring follows whole texts.
CHAIN = 512


def features(word: str) -> list[str]:
    w = word.strip(EDGE).lower()
    if not w:
        return []
    return ["w:" + w, *(f"p:{w[:k]}" for k in PREFIXES if len(w) >= k)]


@dataclass
class Model:
    """Weights of features, of the transitions (from other and toxic, to other and toxic), and of the document's score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray = field(default_factory=lambda: np.array([-2.0, 0.0, 0.0]))


class Emissions(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        w = self.model.weights
        x = self[word] = self.model.bias + sum(w.get(f, 0.0) for f in features(word.decode("utf-8", "replace")))
        return x


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: each token's odds of being toxic, and the forward and backward ratios behind them.

    Texts of similar length run side by side, one step a token, so that numpy works on many texts at a time.
    """
    e = np.exp(np.clip(emissions, -30, 30))
    a = np.exp(np.clip(moves, -20, 20))
    fwd, bwd = np.empty_like(e), np.empty_like(e)
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        rows = order[at : at + 4096]
        s, n = starts[rows], lengths[rows]
        alive = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")  # texts longer than t
        r = e[s]
        fwd[s] = r
        for t in range(1, n[0]):
            k = alive[t]
            r = r[:k]
            r = e[s[:k] + t] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0])
            np.clip(r, 1e-30, 1e30, out=r)
            fwd[s[:k] + t] = r
        b = np.ones(len(rows))
        bwd[s + n - 1] = 1.0
        for t in range(n[0] - 1, 0, -1):
            k = alive[t]
            x = e[s[:k] + t] * b[:k]
            y = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
            b[:k] = np.clip(y, 1e-30, 1e30)
            bwd[s[:k] + t - 1] = b[:k]
        at += len(rows)
    return fwd * bwd, fwd, bwd


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _word_features(words: set[bytes]) -> set[str]:
    return {f for w in words for f in features(w.decode("utf-8", "replace"))}


def _one_of_each(texts: list[str]) -> list[str]:
    """The texts without those that share one of three min-hashes of their word triples with one before: copies and near
    copies of a text would else make words of it look like marks."""
    seen: set[tuple[int, int]] = set()
    out = []
    for t in texts:
        w = _words(t.lower())
        h = np.fromiter((zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), dtype=np.uint64)
        keys = {(k, int(((h * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate((2654435761, 2246822519, 3266489917))}
        if not keys & seen:
            out.append(t)
        seen |= keys
    return out


def _token_labels(toxic: list[str], other: list[str]) -> set[str]:
    """Features that mark a token as toxic. Only features of toxic texts are counted in the others, to keep memory small."""
    toxic, other = _one_of_each(toxic), _one_of_each(other)
    bad: Counter[str] = Counter()
    for t in toxic:
        bad.update(_word_features(set(_words(t))))
    tried = len(bad)
    bad = Counter({f: n for f, n in bad.items() if n >= 3})
    good: Counter[str] = Counter()
    for t in other:
        good.update(_word_features(set(_words(t))) & bad.keys())
    base = len(toxic) / (len(toxic) + len(other))
    least = np.log(max(2, tried)) + np.log(20.0)
    out = set()
    for f, n in bad.items():
        m = good.get(f, 0)
        p = n / (n + m)
        if p <= base or p < 0.6:
            continue
        divergence = n * np.log(p / base) + (m * np.log((1 - p) / (1 - base)) if m else 0.0)
        if divergence >= least:
            out.add(f)
    return out


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 60, field_texts: int = 700) -> Model:
    """Fits the field and the score on whole texts and their labels; without both labels the score is constant.

    The field's weights are learned on at most `field_texts` texts of either label, the marks and the score on all.
    """
    model = Model()
    toxic = np.asarray(toxic, dtype=bool)
    keep = {}
    for i, t in enumerate(texts):
        keep.setdefault(t or "", i)  # copies of a text are one observation
    rows = sorted(keep.values())
    texts, toxic = [texts[i] or "" for i in rows], toxic[rows]
    if not len(toxic) or toxic.all() or not toxic.any():
        rate = (toxic.sum() + 0.5) / (len(toxic) + 1)
        model.score[0] = np.log(rate / (1 - rate))
        return model
    marks = _token_labels([t for t, y in zip(texts, toxic, strict=True) if y], [t for t, y in zip(texts, toxic, strict=True) if not y])
    pick = np.flatnonzero(toxic)[:field_texts].tolist() + np.flatnonzero(~toxic)[:field_texts].tolist()
    # Long texts are learned from as chains of CHAIN tokens, so that the texts' steps stay side by side.
    words = [(i, w[at : at + CHAIN]) for i in pick for w in (_words(texts[i]),) for at in range(0, max(1, len(w)), CHAIN)]
    types: dict[bytes, int] = {}
    flat = np.fromiter((types.setdefault(w, len(types)) for _, chain in words for w in chain), dtype=np.int64)
    lengths = np.array([len(chain) for _, chain in words])
    owner_toxic = np.repeat(toxic[[i for i, _ in words]], lengths)
    known = sorted(marks)
    index = {f: j for j, f in enumerate(known)}
    pairs = [(i, index[f]) for i, w in enumerate(types) for f in features(w.decode("utf-8", "replace")) if f in index]
    tt, ff = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    marked = np.zeros(len(types), dtype=bool)
    marked[tt] = True
    y = marked[flat] & owner_toxic
    theta, bias, moves = np.zeros(len(known)), -4.0, np.zeros((2, 2))
    ends = np.cumsum(lengths) - 1
    inner = np.ones(len(flat), dtype=bool)
    inner[ends[lengths > 0]] = False
    left = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[left].astype(int), y[left + 1].astype(int)), 1)
    m = [np.zeros(len(known)), 0.0, np.zeros((2, 2))]
    v = [np.zeros(len(known)), 0.0, np.zeros((2, 2))]
    n = max(1, len(flat))
    for step in range(1, rounds + 1):
        by_type = np.full(len(types), bias)
        np.add.at(by_type, tt, theta[ff])
        e = by_type[flat]
        odds, fwd, bwd = forward_backward(e, lengths, moves)
        p = odds / (1 + odds)
        d = np.bincount(flat, weights=p - y, minlength=len(types))
        x = np.exp(np.clip(e[left + 1], -30, 30)) * bwd[left + 1]
        a = np.exp(moves)
        w = np.stack([np.full(len(left), a[0, 0]), a[0, 1] * x, fwd[left] * a[1, 0], fwd[left] * a[1, 1] * x])
        w /= w.sum(axis=0)
        grads = [np.bincount(ff, weights=d[tt], minlength=len(known)) + 0.05 * theta, float(d.sum()), w.sum(axis=1).reshape(2, 2) - seen + 0.05 * moves]
        values = [theta, bias, moves]
        for j, g in enumerate(grads):  # Adam
            m[j] = 0.9 * m[j] + 0.1 * g / n
            v[j] = 0.99 * v[j] + 0.01 * (g / n) ** 2
            values[j] = values[j] - 0.3 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-12)
        theta, bias, moves = values[0], float(values[1]), values[2] - values[2][0, 0]
    model.weights, model.bias, model.moves = dict(zip(known, theta.tolist(), strict=True)), bias, moves
    emissions = Emissions(model)
    x = np.concatenate([summaries(model, [t.encode("utf-8", "replace") for t in texts[i : i + 200]], emissions)[0] for i in range(0, len(texts), 200)])
    z, c = np.c_[np.ones(len(x)), x], np.array([-2.0, 0.5, 0.1])
    for _ in range(50):  # Newton's steps of a ridge-regularised logistic regression
        q = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        h = (z * (q * (1 - q) + 1e-6)[:, None]).T @ z + 0.1 * np.eye(3)
        c = c - np.clip(np.linalg.solve(h, z.T @ (q - toxic) + 0.1 * c), -2, 2)
    model.score = c
    return model


def summaries(model: Model, texts: list[bytes], emissions: Emissions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: (log odds of its largest marginal, log of one more than their sum); all marginals; lengths."""
    words = [t.split() for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    e = np.fromiter((x for w in words for x in map(emissions.__getitem__, w)), dtype=np.float64, count=int(lengths.sum()))
    odds, _, _ = forward_backward(e, lengths, model.moves)
    p = odds / (1 + odds)
    out = np.zeros((len(texts), 2))
    out[:, 0] = -8.0
    full = np.flatnonzero(lengths)
    if len(full):
        starts = np.r_[0, np.cumsum(lengths)[:-1]][full]
        top = np.clip(np.maximum.reduceat(p, starts), 1e-12, 1 - 1e-12)
        out[full, 0] = np.clip(np.log(top / (1 - top)), -8, 8)
        out[full, 1] = np.log1p(np.add.reduceat(p, starts))
    return out, p, lengths


#: Bytes of text that are tagged at a time: what a task holds for it is some dozens of times as much.
SLICE_BYTES = 2 << 20


def _slices(texts: list[bytes]) -> Iterator[slice]:
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) + 100
        if total > SLICE_BYTES:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def offsets(text: str, p: np.ndarray, least: float) -> list[dict]:
    """Runs of tokens with a marginal of at least `least`, as code points of the text, with the largest marginal."""
    out: list[dict] = []
    last = -2
    for i, m in enumerate(WORD.finditer(text)):
        if p[i] >= least:
            if last == i - 1:
                out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], float(p[i]))
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
            last = i
    return out


def held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text is divisible by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: Bytes of text that a model is fitted on, of each label.
MAX_BYTES = 24 << 20


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_other: int = 3000, max_bytes: int = MAX_BYTES) -> Model:
    """Fits a model on labelled rows that are not held out: at most about `max_toxic` and `max_other` of them, and of either
    label at most `max_bytes` of text.

    The sample is the rows with the smallest id hashes, in their order, so it is the same however the tables are stored;
    both bounds hold whatever the tables' size. Null labels are left out, of repeated labels the toxic one counts; without
    labels, or of an empty table, the model's score is constant. Only the sampled ids are broadcast, a bounded number. One
    task fits the model on an executor; the driver gets its weights alone.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic_")).dropna().where(~held_out())
    own = own.groupBy("doc_id").agg(F.max("toxic_").alias("toxic_"))
    n = {r["toxic_"]: r["count"] for r in own.groupBy("toxic_").count().collect()}
    part = F.when(F.col("toxic_"), F.lit(max_toxic / max(n.get(True, 0), 1))).otherwise(F.lit(max_other / max(n.get(False, 0), 1)))
    sample = own.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))).where(F.col("h") < part * 1_000_000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    seen = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic_").orderBy("h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("seen", seen).where(F.col("seen") <= max_bytes).repartition(1).sortWithinPartitions("h", "doc_id", "text").select("text", "toxic_")

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, toxic = [], []
        for pdf in batches:
            texts += pdf["text"].tolist()
            toxic += pdf["toxic_"].tolist()
        yield pd.DataFrame({"model": [pickle.dumps(fit(texts, np.array(toxic, dtype=bool)))]})

    # The written row keeps a lost result from costing a second fit.
    found = materialize(rows.mapInPandas(run, "model binary"), "toxicity_model").first()
    return pickle.loads(found["model"]) if found else fit([], np.zeros(0, dtype=bool))


def score(docs: DataFrame, model: Model, least: float = 0.5, with_spans: bool = True) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for each row of `docs` (doc_id, text).

    Every whole text is scored; a null or empty text has the score of one without toxic words, and no spans. Repeated
    rows give equal results each, an empty table an empty result; other columns are not read.
    """

    @gives_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        emissions = Emissions(model)
        for pdf in batches:
            raw = [(t or "").encode("utf-8", "replace") for t in pdf["text"]]
            for part in _slices(raw):
                rows = pdf.iloc[part]
                x, p, lengths = summaries(model, raw[part], emissions)
                z = np.c_[np.ones(len(x)), x] @ model.score
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                starts = np.r_[0, np.cumsum(lengths)]
                spans = [offsets(t, p[a:b], least) if with_spans and a < b and p[a:b].max() >= least else [] for t, a, b in zip(rows["text"], starts, starts[1:], strict=False)]
                yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "held_out": rows["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32), "spans": spans})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


@keeps_other_columns
def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, with all columns as they are, that the model doesn't call toxic.

    A null or empty text is scored as one without toxic words; repeated rows have one fate, an empty table stays empty.
    """

    @gives_back
    def run(batches):
        import pyarrow as pa

        emissions = Emissions(model)
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            x = np.concatenate([np.zeros((0, 2)), *(summaries(model, texts[part], emissions)[0] for part in _slices(texts))])
            yield batch.filter(pa.array(np.c_[np.ones(len(x)), x] @ model.score < 0))

    return docs.mapInArrow(run, docs.schema)
