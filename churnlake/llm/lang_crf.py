"""Word-level language identification with a linear-chain conditional random field.

Every word is labelled with a language given its neighbours: affixes,
character n-grams and lexicon entries of the word give its emission scores,
learned transitions tie neighbouring words, and forward-backward gives the
posterior of each word's label, also in code-switched text. The fit runs on a
bounded sample of labelled documents; scoring covers all words of all texts.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm.common import hash_sample

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit (rows and words of the labelled sample) and of memory."""

    docs_per_label: int = 300
    words_per_doc: int = 240
    lexicon_per_label: int = 400
    buckets: int = 1 << 16
    iterations: int = 50
    l2: float = 2e-6
    cached_words: int = 300_000
    words_at_once: int = 400_000


def letters(token: str) -> str:
    """The lower-cased letters of a token."""
    return (token if token.isalpha() else "".join(filter(str.isalpha, token))).lower()


def word_features(word: str, lexicon: dict[str, list[int]], buckets: int) -> list[int]:
    """Hashed affixes (1-4), n-grams (2, 3, with word ends) and lexicon entries of a word."""
    w = f"^{word}$"
    n = len(word)
    names = [f"p{word[:k]}" for k in range(1, min(4, n) + 1)]
    names += [f"s{word[-k:]}" for k in range(1, min(4, n) + 1)]
    names += [w[i: i + 2] for i in range(n + 1)]
    names += [w[i: i + 3] for i in range(n)]
    if word in lexicon:
        names.append(f"w{word}")
        names += [f"l{label}" for label in lexicon[word]]
    return [zlib.crc32(x.encode()) % buckets for x in names]


class Emissions:
    """Emission scores of words; a bounded cache of tokens."""

    def __init__(self, weights: np.ndarray, lexicon, settings: Settings):
        self.weights, self.lexicon, self.settings = weights, lexicon, settings
        self.row: dict[str, int] = {}
        self.table = np.zeros((1, weights.shape[1]), np.float32)

    def add(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.row]
        if len(self.row) + len(new) > self.settings.cached_words:
            self.row, self.table, new = {}, self.table[:1], list(tokens)
        words = [letters(t) for t in new]
        known = [i for i, w in enumerate(words) if w]
        feats = [word_features(words[i], self.lexicon, self.settings.buckets) for i in known]
        base = len(self.table)
        for t in new:
            self.row[t] = -1
        if known:
            at = np.cumsum([0] + [len(f) for f in feats[:-1]])
            flat = np.fromiter((x for f in feats for x in f), np.int64)
            self.table = np.concatenate([self.table, np.add.reduceat(self.weights[flat], at, axis=0)])
            for r, i in enumerate(known):
                self.row[new[i]] = base + r


def posterior_sums(chains: list[np.ndarray], table: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum over each chain's words of the label posteriors, by batched forward-backward.

    ``chains``: rows of ``table`` (emission scores) by word. All chains
    advance together, longest first, so no step pads.
    """
    order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    lens = np.array([len(chains[i]) for i in order])
    out = np.zeros((len(chains), table.shape[1]))
    live = int((lens > 0).sum())
    if not live:
        return out
    steps = int(lens[0])
    active = np.searchsorted(-lens, -np.arange(steps), side="left")  # chains longer than t
    at = np.concatenate([[0], np.cumsum(active)])
    place = np.concatenate([np.arange(n) for n in lens[:live]])
    who = np.repeat(np.arange(live), lens[:live])
    rows = np.empty(at[-1], np.int64)
    rows[at[place] + who] = np.concatenate([chains[i] for i in order[:live]])
    emit = table[rows]
    emit = np.exp(emit - emit.max(axis=1, keepdims=True))
    move = np.exp(trans - trans.max()).astype(np.float32)
    alpha = np.empty_like(emit)
    a = emit[: active[0]] * np.exp(first - first.max()).astype(np.float32)
    alpha[: active[0]] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        a = (alpha[at[t - 1]: at[t - 1] + active[t]] @ move) * emit[at[t]: at[t + 1]]
        alpha[at[t]: at[t + 1]] = a / a.sum(axis=1, keepdims=True)
    total = np.zeros((live, table.shape[1]))
    beta = np.ones((live, table.shape[1]), np.float32)
    back = move.T.copy()
    for t in range(steps - 1, -1, -1):
        n = active[t]
        p = alpha[at[t]: at[t + 1]] * beta[:n]
        total[:n] += p / p.sum(axis=1, keepdims=True)
        if t:
            b = (emit[at[t]: at[t + 1]] * beta[:n]) @ back
            beta[:n] = b / b.max(axis=1, keepdims=True)
    out[order[:live]] = total
    return out


@dataclass
class Model:
    key: str
    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray
    first: np.ndarray
    lexicon: dict[str, list[int]]


def fit(samples: list[tuple[str, list[str]]], settings: Settings) -> Model:
    """Maximum likelihood (Adam, L2) on chains stitched from labelled documents.

    Documents carry one label each, so chains of one to three segments of
    different documents give the transitions switches to learn from.
    """
    labels = sorted({lang for lang, _ in samples})
    of = {x: i for i, x in enumerate(labels)}
    k = len(labels)
    words = [(of[lang], [w for w in map(letters, tokens) if w]) for lang, tokens in samples]
    counts: list[dict[str, int]] = [{} for _ in labels]
    for y, ws in words:
        for w in ws:
            counts[y][w] = counts[y].get(w, 0) + 1
    lexicon: dict[str, list[int]] = {}
    for y, c in enumerate(counts):
        for w in sorted((w for w in c if c[w] > 2), key=lambda w: (-c[w], w))[: settings.lexicon_per_label]:
            lexicon.setdefault(w, []).append(y)

    rng = np.random.default_rng(7)
    segments = []
    for y, ws in words:
        i = 0
        while i < len(ws):
            n = int(rng.integers(4, 40))
            segments.append((y, ws[i: i + n]))
            i += n
    rng.shuffle(segments)
    chains, i = [], 0
    while i < len(segments):
        n = int(rng.integers(1, 4))
        chains.append([(w, y) for y, ws in segments[i: i + n] for w in ws])
        i += n
    chains.sort(key=len, reverse=True)
    del segments, words
    types = {w: i for i, w in enumerate(sorted({w for c in chains for w, _ in c}))}
    packed, sizes = array("i"), array("i")  # no Python object per feature
    for w in types:
        found = word_features(w, lexicon, settings.buckets)
        packed.extend(found)
        sizes.append(len(found))
    flat, sizes = np.array(packed, np.int32), np.array(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    lens = np.array([len(c) for c in chains])
    steps = int(lens[0])
    active = np.searchsorted(-lens, -np.arange(steps), side="left")
    at = np.concatenate([[0], np.cumsum(active)])
    rows, gold = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
    for c, chain in enumerate(chains):
        for t, (w, y) in enumerate(chain):
            rows[at[t] + c], gold[at[t] + c] = types[w], y
    n_chains = len(chains)
    del chains
    gold_trans = np.zeros((k, k))
    for t in range(1, steps):
        np.add.at(gold_trans, (gold[at[t - 1]: at[t - 1] + active[t]], gold[at[t]: at[t + 1]]), 1)
    gold_first = np.bincount(gold[: active[0]], minlength=k).astype(float)

    theta = [np.zeros((settings.buckets, k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    n_words = len(rows)
    for step in range(1, settings.iterations + 1):
        table = np.stack([np.add.reduceat(theta[0][:, y][flat], starts) for y in range(k)], axis=1)
        emit = table[rows]
        emit = np.exp(emit - emit.max(axis=1, keepdims=True))
        move = np.exp(theta[1])
        alpha = np.empty_like(emit)
        a = emit[: active[0]] * np.exp(theta[2])
        alpha[: active[0]] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, steps):
            a = (alpha[at[t - 1]: at[t - 1] + active[t]] @ move) * emit[at[t]: at[t + 1]]
            alpha[at[t]: at[t + 1]] = a / a.sum(axis=1, keepdims=True)
        post = np.empty_like(emit)
        beta = np.ones((n_chains, k))
        pair = np.zeros((k, k))
        for t in range(steps - 1, -1, -1):
            n = active[t]
            p = alpha[at[t]: at[t + 1]] * beta[:n]
            post[at[t]: at[t + 1]] = p / p.sum(axis=1, keepdims=True)
            if t:
                eb = emit[at[t]: at[t + 1]] * beta[:n]
                before = alpha[at[t - 1]: at[t - 1] + n]
                norm = ((before @ move) * eb).sum(axis=1, keepdims=True)
                pair += (before / norm).T @ eb * move
                b = eb @ move.T
                beta[:n] = b / b.max(axis=1, keepdims=True)
        first = post[: active[0]].sum(axis=0)
        post[np.arange(n_words), gold] -= 1
        by_type = np.stack([np.bincount(rows, post[:, y], len(types)) for y in range(k)], axis=1)
        grad = [np.stack([np.bincount(flat, by_type[owner, y], settings.buckets) for y in range(k)], axis=1),
                pair - gold_trans, first - gold_first]
        for i, g in enumerate(grad):
            g = g / n_words + settings.l2 * theta[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            theta[i] -= 0.15 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-9)
    return Model(uuid.uuid4().hex, labels, theta[0].astype(np.float32), theta[1], theta[2], lexicon)


def _tokens(limit: int):
    """(id, lang, text) -> (id, lang, tokens): up to ``limit`` tokens from a place given by the id."""
    def run(batches):
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                ws = (t or "").split()
                start = zlib.crc32(str(i).encode()) % (len(ws) - limit + 1) if len(ws) > limit else 0
                out.append(ws[start: start + limit])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))],
                                             ["id", "lang", "tokens"])
    return run


def labelled_sample(spark: SparkSession, labelled: DataFrame, settings: Settings) -> DataFrame | None:
    """(id, lang, tokens): at most docs_per_label different documents of each label, words_per_doc words of each."""
    if labelled.isEmpty():
        return None
    return hash_sample(labelled.select("id", "lang", "text"), "lang", ["id", "text"], settings.docs_per_label) \
        .select("id", "lang", "text").mapInArrow(_tokens(settings.words_per_doc), "id long, lang string, tokens array<string>")


def _fitted(settings: Settings):
    """One task: the bounded sample -> one row with the pickled model; none if the sample has no letter."""
    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        samples = [(lang, tokens) for _, lang, tokens in rows if any(map(letters, tokens))]
        if samples:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(samples, settings))], pa.binary())], ["model"])
    return run


def _predicted(model: Model | None, settings: Settings):
    def run(batches):
        emissions = Emissions(model.weights, model.lexicon, settings) if model else None

        def score(texts: list[list[str]]):
            emissions.add(set().union(*texts))
            get = emissions.row.__getitem__
            chains = []
            for tokens in texts:
                c = np.fromiter(map(get, tokens), np.int64, len(tokens))
                chains.append(c[c >= 0])
            sums = posterior_sums(chains, emissions.table, model.trans, model.first)
            best = sums.argmax(axis=1)
            n = np.array([len(c) for c in chains])
            share = sums[np.arange(len(sums)), best] / np.maximum(n, 1)
            return ([model.labels[y] if k else UNKNOWN for y, k in zip(best, n)],
                    [min(1.0, float(s)) if k else 0.0 for s, k in zip(share, n)], n.tolist())

        for b in batches:
            size = b.num_rows
            if not model:
                yield pa.RecordBatch.from_arrays([
                    b.column(0), pa.array([UNKNOWN] * size), pa.array([0.0] * size), pa.array([0] * size, pa.int64()),
                    *b.columns[2:]], ["id", "lang_pred", "score", "n_words", *b.schema.names[2:]])
                continue
            lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).to_numpy()
            order = np.argsort(lengths, kind="stable")
            at = 0
            while at < size:  # groups of like length with a bounded number of words
                end = int(np.searchsorted(np.cumsum(lengths[order[at:]]), 4 * settings.words_at_once)) + at
                part = order[at: max(at + 1, min(end, at + 1024))]
                texts = [(t or "").split() for t in b.column(1).take(pa.array(part)).to_pylist()]
                langs, scores, n = score(texts)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(part)), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                    pa.array(n, pa.int64()), *[c.take(pa.array(part)) for c in b.columns[2:]]],
                    ["id", "lang_pred", "score", "n_words", *b.schema.names[2:]])
                at += len(part)
    return run


def identify_languages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", settings: Settings = Settings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, held_out, lang_pred, score, n_words) and the long columns ``keep``, one row per input row.

    The fit uses text and non-null language of rows whose crc32 of the id
    as text, mod 5, is not 0 (the others are held out). lang_pred is the
    label with the largest posterior mass over the text's words, score its
    share of that mass.

    Defined results: a text that is null or has no letter is ``und`` with
    score 0; ties go to the first label in alphabetical order; a null id is
    never learned from and its held_out is null; without any labelled row
    every text is ``und``; repeated rows are scored alike; extra columns are
    ignored; an empty table gives an empty result.
    """
    rest = F.crc32(F.col("id").cast("string").cast("binary")) % 5
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), *keep)
    sample = labelled_sample(spark, docs.where(F.col("lang").isNotNull() & (rest != 0)), settings)
    # the sample is bounded, so one task fits it; the driver only gets the weights
    row = sample.repartition(1).mapInArrow(_fitted(settings), "model binary").first() if sample is not None else None
    model = pickle.loads(row["model"]) if row is not None else None
    out = docs.select("id", "text", *keep).mapInArrow(_predicted(model, settings), ", ".join(
        ["id long, lang_pred string, score double, n_words long", *[f"{c} long" for c in keep]]))
    return out.select(F.col("id").alias(id_col), (rest == 0).alias("held_out"), "lang_pred", "score", "n_words", *keep)
