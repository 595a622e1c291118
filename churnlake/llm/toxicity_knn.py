"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over an index bounded in single precision.

Terms are all words and word beginnings (insults in inflected languages share
stems) of a bounded sample of labelled documents, the examples; document
frequencies come from all documents. A word that no example has matches none
and is left out of a text's length. Terms that many examples have are columns
of a matrix, the others have postings. For a batch of texts their sums give
every cosine in single precision, whose error is bounded; examples whose bound
doesn't reach the k-th best cosine are skipped and the others compared in
double precision, so the neighbours are exact. Votes are weighted by distance
and calibrated by isotonic regression of leave-one-out votes.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm.common import hash_sample, stage
from churnlake.llm.lang_crf import letters

#: Terms that at least this share of the examples has are columns of a matrix, of so many bytes at most.
MATRIX_SHARE, MATRIX_BYTES = 0.05, 96 << 20
#: Examples whose row of the matrix is in single precision at once, and products of an exact comparison at once.
EXAMPLES_AT_ONCE, EXACT_AT_ONCE = 512, 1 << 20
#: Texts that are compared at once, and their characters unless one alone has more.
TEXTS_AT_ONCE, CHARS_AT_ONCE = 256, 1 << 20
#: Letters of the beginnings of a word.
BEGINNINGS = range(4, 9)
BLOCK = 16
#: Examples whose votes one task works out.
EXAMPLES_A_TASK = 250


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit and of memory, and parameters of the vote."""

    examples_per_class: int = 3000
    neighbours: int = 40
    prior_weight: float = 0.5
    cached_words: int = 300_000


def word_of(token: str) -> str:
    """``letters`` of a token; most have marks at their ends only."""
    w = token.strip(".,;:!?\"'()")
    return w.lower() if w.isalpha() else letters(w)


def word_terms(token: str) -> list[str]:
    """The word and its beginnings of 4 to 8 letters."""
    w = word_of(token)
    return ["=" + w] + [w[:k] for k in BEGINNINGS if k <= len(w)] if w else []


def term_hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of all terms of the tokens."""
    return np.array([xxhash.xxh3_64_intdigest(x) for t in tokens for x in word_terms(t)], np.uint64)


def beginning_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Other 64-bit hashes, of the words' beginnings (a column each) in one go, and which of them exist."""
    last = BEGINNINGS[-1]
    chars = np.array(words, f"U{last}").view(np.uint32).reshape(len(words), last).astype(np.uint64)
    h, out = np.full(len(words), 0x243F6A8885A308D3, np.uint64), []
    for k in range(last):
        h = (h ^ chars[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out.append(h)
    first = BEGINNINGS[0] - 1
    return np.stack(out[first:], 1), chars[:, first:] > 0


def whole_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest("=" + w) for w in words], np.uint64)


def quick_hashes(tokens: list[str]) -> np.ndarray:
    """The hashes by which ``Terms`` finds terms, in the order of ``term_hashes``."""
    words = [w for w in map(word_of, tokens) if w]
    starts, there = beginning_hashes(words)
    return np.column_stack([whole_hashes(words), starts])[np.insert(there, 0, True, axis=1)]


class _Places(dict):
    """Tokens to places; a new token gets the next place."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        self[token] = place = len(self)
        self.new.append(token)
        return place


class Terms:
    """Numbers of a vocabulary's terms in tokens; a bounded cache.

    ``vocabulary`` has the quick hash of each term number; with a term it has
    every beginning of it.
    """

    def __init__(self, vocabulary: np.ndarray, settings: Settings):
        self.order = np.argsort(vocabulary).astype(np.int32)
        self.sorted, self.most = vocabulary[self.order], settings.cached_words
        self._forget()

    def _forget(self) -> None:
        self.known, self.numbers = _Places(), np.empty((1024, 1 + len(BEGINNINGS)), np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The terms' numbers, -1 for others; sorted first, so that the search stays in cached memory."""
        by = np.argsort(hashes)
        hashes = hashes[by]
        at = np.searchsorted(self.sorted, hashes)
        at[at == len(self.sorted)] = 0
        out = np.empty(len(by), np.int32)
        out[by] = np.where(self.sorted[at] == hashes, self.order[at], -1) if len(self.sorted) else -1
        return out

    def _add(self, tokens: list[str]) -> None:
        words = [word_of(t) for t in tokens]
        found = np.full((len(words), self.numbers.shape[1]), -1, np.int32)
        starts, there = beginning_hashes(words)
        live = np.arange(len(words))
        for k in range(starts.shape[1]):  # no longer beginning, and not the word, is known without the shorter one
            has = there[live, k]
            some = live[has]
            found[some, k + 1] = self._find(starts[some, k])
            live = np.concatenate([live[~has], some[found[some, k + 1] >= 0]])
        live = [i for i in live.tolist() if words[i]]
        found[live, 0] = self._find(whole_hashes([words[i] for i in live]))
        end = len(self.known)
        if end > len(self.numbers):
            more = np.empty((max(end, 2 * len(self.numbers)), found.shape[1]), np.int32)
            more[: len(self.numbers)] = self.numbers
            self.numbers = more
        self.numbers[end - len(words): end] = found

    def counts(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text the distinct term numbers (ascending) and their counts."""
        if len(self.known) > self.most:
            self._forget()
        split = [(t or "").split() for t in texts]
        sizes = [len(x) for x in split]
        places = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, sum(sizes))
        if self.known.new:
            self._add(self.known.new)
            self.known.new = []
        terms = self.numbers[places]
        key = (np.repeat(np.arange(len(texts)), sizes)[:, None] << 32) + terms
        key = np.sort(key[terms >= 0])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        counts, key = np.diff(first, append=len(key)), key[first]
        cut = np.searchsorted(key, np.arange(1, len(texts)) << 32)
        return list(zip(np.split(key & 0xFFFFFFFF, cut), np.split(counts, cut))) if texts else []


def _groups(texts: pa.Array):
    """(place, texts) of some texts at once."""
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        start, size, group = at, 0, []
        for t in texts.slice(at, TEXTS_AT_ONCE).to_pylist():
            if group and size + len(t or "") > CHARS_AT_ONCE:
                yield start, group
                start, size, group = start + len(group), 0, []
            group.append(t)
            size += len(t or "")
        yield start, group


_KEPT: dict[str, Terms] = {}
_MODELS: dict[str, Model] = {}


def _worker_terms(vocabulary: np.ndarray, settings: Settings, key: str) -> Terms:
    """One cache of a vocabulary per worker process, kept from task to task."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Terms(vocabulary, settings)
    return _KEPT[key]


def _worker_model(packed: bytes, key: str) -> Model:
    """One index per worker process, kept from task to task."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = pickle.loads(zlib.decompress(packed))
    return _MODELS[key]


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length; zeros where all terms are everywhere."""
    w = (1 + np.log(counts)) * idf
    norm = np.sqrt((w * w).sum())
    return w / norm if norm > 0 else w


def kth_largest(x: np.ndarray, k: int) -> float:
    """The k-th largest of numbers, 0 if they are fewer. No block but those whose maximum reaches the k-th largest maximum has it."""
    if len(x) <= k:
        return 0.0
    whole = x[: len(x) // BLOCK * BLOCK].reshape(-1, BLOCK).max(axis=1)
    if len(whole) > k:
        x = x[x >= np.partition(whole, len(whole) - k)[len(whole) - k]]
    return float(np.partition(x, len(x) - k)[len(x) - k])


class BlockMaxIndex:
    """Examples by term: a matrix of frequent terms and postings of the others.

    Weights are not negative, so a cosine in single precision is off by a share of itself that is bounded by the
    number of its terms; the examples that this bound leaves are compared exactly.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]] | Vectors, n_terms: int):
        self.size = n = len(vectors)
        held = np.zeros(n_terms, np.int64)
        for t, _ in vectors:
            held[t] += 1
        often = np.flatnonzero(held >= max(2, MATRIX_SHARE * n))
        often = often[np.argsort(-held[often], kind="stable")[: MATRIX_BYTES // (8 * max(1, n))]]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        self.matrix = np.zeros((n, len(often)))
        self.rare_at = np.concatenate([[0], np.cumsum(np.where(self.column < 0, held, 0))]).astype(np.int32)
        self.doc, self.weight = np.empty(self.rare_at[-1], np.int32), np.empty(self.rare_at[-1])
        free = self.rare_at[:-1].copy()
        for i, (t, w) in enumerate(vectors):
            column = self.column[t]
            inside = column >= 0
            self.matrix[i, column[inside]] = w[inside]
            t, w = t[~inside], w[~inside]
            self.doc[free[t]], self.weight[free[t]] = i, w
            free[t] += 1
        self.place = np.full(n, -1, np.int32)  # of the examples that are compared exactly

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1):
        """(examples, cosines) of the k largest positive cosines, ties to the first example."""
        return self.nearest_all([(terms, weights)], k, [without])[0]

    def nearest_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None):
        """``nearest`` of each query."""
        out = []
        for at in range(0, len(queries), TEXTS_AT_ONCE):
            some = queries[at: at + TEXTS_AT_ONCE]
            columns = [self.column[t] for t, _ in some]
            q = np.zeros((len(some), self.matrix.shape[1]), np.float32)
            for row, c, (_, w) in zip(q, columns, some):
                row[c[c >= 0]] = w[c >= 0]
            about = np.empty((len(some), self.size), np.float32)
            for lo in range(0, self.size, EXAMPLES_AT_ONCE):
                part = self.matrix[lo: lo + EXAMPLES_AT_ONCE].astype(np.float32)
                about[:, lo: lo + len(part)] = q @ part.T
            for i, (row, c, (t, w)) in enumerate(zip(about, columns, some), at):
                out.append(self._nearest(row, t, w, c, k, without[i] if without else -1))
        return out

    def _nearest(self, about: np.ndarray, terms: np.ndarray, weights: np.ndarray, columns: np.ndarray, k: int, without: int):
        """``about`` has the sums over the matrix; the postings add theirs."""
        rare = np.flatnonzero(columns < 0)
        lo = self.rare_at[terms[rare]]
        n = self.rare_at[terms[rare] + 1] - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        doc, part = self.doc[at], self.weight[at]
        part *= np.repeat(weights[rare], n)
        about += np.bincount(doc, part, self.size)
        if without >= 0:
            about[without] = 0
        least = kth_largest(about, k)
        off = (len(terms) + 10) * 2.0 ** -23  # more than the relative error: a rounding of 2 ** -24 a term and a few more
        top = np.flatnonzero((about > 0) & (about >= least * max(0.0, 1 - 2 * off)))
        score, frequent, row = [np.empty(0)], np.flatnonzero(columns >= 0), np.repeat(rare, n)
        step = max(1, EXACT_AT_ONCE // max(1, len(terms)))
        for first in range(0, len(top), step):
            some = top[first: first + step]
            self.place[some] = np.arange(len(some))
            place = self.place[doc]
            hit = np.flatnonzero(place >= 0)
            products = np.zeros((len(terms), len(some)))
            products[row[hit], place[hit]] = part[hit]
            products[frequent] = self.matrix[some][:, columns[frequent]].T * weights[frequent, None]
            score.append(np.add.reduce(products, axis=0))  # term by term, in one order for all examples
            self.place[some] = -1
        score = np.concatenate(score)
        by = np.argsort(-score, kind="stable")[:k]
        return top[by], score[by]


class Vectors:
    """Terms and weights of a model's examples, worked out one by one whenever they are passed."""

    def __init__(self, model: Model):
        self.model = model

    def __len__(self) -> int:
        return len(self.model.sizes)

    def __iter__(self):
        m, end = self.model, 0
        for n in m.sizes.tolist():
            t, c = m.terms[end: end + n], m.counts[end: end + n]
            yield t, weighted(c.astype(float), m.idf[t])
            end += n


@dataclass
class Model:
    """The index is made of the examples' terms and counts where it is first asked for: in the tasks, not in the driver."""

    key: str
    vocabulary: np.ndarray  # quick hashes by term number
    idf: np.ndarray
    sizes: np.ndarray  # terms of each example
    terms: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    base_rate: float
    no_evidence: float
    steps: tuple[np.ndarray, np.ndarray]  # calibration: lower ends of votes, probabilities

    @cached_property
    def index(self) -> BlockMaxIndex:
        return BlockMaxIndex(self.vectors(), len(self.vocabulary))

    def vectors(self) -> Vectors:
        """(terms, weights) of each example."""
        return Vectors(self)

    def __getstate__(self):
        state = {k: v for k, v in self.__dict__.items() if k != "index"}
        return state | {"terms": np.diff(self.terms, prepend=np.int32(0))}  # small differences, for the compression

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.terms = np.cumsum(state["terms"], dtype=np.int32)

    def vote(self, near: np.ndarray, cosine: np.ndarray, settings: Settings) -> float:
        w = cosine / (1.0 + 1e-6 - np.minimum(cosine, 1.0) + 0.25)
        return float(((w * self.toxic[near]).sum() + settings.prior_weight * self.base_rate)
                     / (w.sum() + settings.prior_weight))

    def own_votes(self, examples: list[int], settings: Settings) -> list[float | None]:
        """The vote on each of some examples by the others; None where it has no neighbour."""
        at = np.concatenate([[0], np.cumsum(self.sizes)])
        terms = [self.terms[at[i]: at[i + 1]] for i in examples]
        queries = [(t, weighted(self.counts[at[i]: at[i + 1]].astype(float), self.idf[t])) for i, t in zip(examples, terms)]
        return [self.vote(near, cosine, settings) if len(near) else None
                for near, cosine in self.index.nearest_all(queries, settings.neighbours, examples)]

    def scores(self, counted: list[tuple[np.ndarray, np.ndarray]], settings: Settings) -> list[tuple]:
        """(probability, neighbour ids, cosines) of each document's terms and counts."""
        lows, values = self.steps
        out = []
        for near, cosine in self.index.nearest_all([(t, weighted(c, self.idf[t])) for t, c in counted], settings.neighbours):
            if not len(near):
                out.append((self.no_evidence, [], []))
                continue
            i = np.searchsorted(lows, self.vote(near, cosine, settings) + 1e-12, side="right") - 1
            out.append((float(values[max(i, 0)]), self.ids[near].tolist(), cosine.tolist()))
        return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing step function of least squares (pool adjacent violators), each step smoothed to the mean."""
    order = np.argsort(x, kind="stable")
    mean = float((y * weight).sum() / weight.sum())
    pools: list[list[float]] = []  # low, weight, sum
    for i in order:
        if pools and pools[-1][0] == x[i]:
            pools[-1][1] += weight[i]
            pools[-1][2] += weight[i] * y[i]
        else:
            pools.append([x[i], weight[i], weight[i] * y[i]])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, w, s = pools.pop()
            pools[-1][1] += w
            pools[-1][2] += s
    unit = weight.min()
    return (np.array([p[0] for p in pools]),
            np.maximum.accumulate([(p[2] + unit * mean) / (p[1] + unit) for p in pools]))


def build_model(key: str, vocabulary: np.ndarray, idf: np.ndarray, examples: list[tuple], rates: dict[int, int],
                settings: Settings, voted: Callable[[Model], list[float | None]] | None = None) -> Model | None:
    """``examples``: (id, toxic, terms, counts); ``rates``: learnable rows by label; ``voted``: own_votes of all examples."""
    examples = [(i, y, np.asarray(t, np.int32), np.asarray(c, np.int32)) for i, y, t, c in examples]
    total = sum(rates.values())
    if not examples or not total:
        return None
    base = rates.get(1, 0) / total
    held = {y: sum(1 for e in examples if e[1] == y) for y in (0, 1)}
    share = {y: rates.get(y, 0) / held[y] if held[y] else 0.0 for y in (0, 1)}  # rows that an example stands for
    empty = [e[1] for e in examples if not len(e[2])]
    w_empty = {y: share[y] * sum(1 for v in empty if v == y) for y in (0, 1)}
    no_evidence = (w_empty[1] + base) / (w_empty[0] + w_empty[1] + 1)
    kept, seen = [], set()
    for e in examples:  # copies of an example would vote as one text many times
        same = (e[1], e[2].tobytes(), e[3].tobytes())
        if len(e[2]) and same not in seen:
            seen.add(same)
            kept.append(e)
    lead = [int(e[2][weighted(e[3].astype(float), idf[e[2]]).argmax()]) for e in kept]  # like examples share blocks
    order = sorted(range(len(kept)), key=lambda i: (lead[i], zlib.crc32(str(kept[i][0]).encode()), kept[i][0]))
    kept = [kept[i] for i in order]
    none = [np.empty(0, np.int32)]
    model = Model(key, vocabulary, idf, np.array([len(e[2]) for e in kept], np.int64),
                  np.concatenate([e[2] for e in kept] or none), np.concatenate([e[3] for e in kept] or none),
                  np.array([e[0] for e in kept]), np.array([e[1] for e in kept], float), base, no_evidence,
                  (np.zeros(1), np.array([base])))
    votes = voted(model) if voted else model.own_votes(list(range(len(kept))), settings)
    votes = [(v, y, share[int(y)]) for v, y in zip(votes, model.toxic) if v is not None]
    if votes:
        model.steps = isotonic(*(np.array(v) for v in zip(*votes)))
    return model


def _terms(batches):
    """(text) -> hashes of its terms, each once per flush of a task."""
    words: set[str] = set()

    def out():
        tokens = list(words)
        term, at = np.unique(term_hashes(tokens), return_index=True)
        words.clear()
        return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(quick_hashes(tokens)[at].view(np.int64))],
                                          ["term", "quick"])

    for b in batches:
        for text in b.column(0).to_pylist():
            words.update((text or "").split())
            if len(words) > 100_000:
                yield out()
    if words:
        yield out()


def _doc_counts(vocabulary: np.ndarray, settings: Settings, key: str):
    """(text) -> (term, docs) of the vocabulary, combined in the task."""
    def run(batches):
        terms, total = _worker_terms(vocabulary, settings, key), np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for _, texts in _groups(b.column(0)):
                total += np.bincount(np.concatenate([t for t, _ in terms.counts(texts)]), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])
    return run


def _example_rows(vocabulary: np.ndarray, settings: Settings):
    def run(batches):
        terms = Terms(vocabulary, settings)
        for b in batches:
            for at, texts in _groups(b.column("text")):
                rows, part = terms.counts(texts), b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("toxic"), pa.array([t for t, _ in rows], pa.list_(pa.int32())),
                    pa.array([c for _, c in rows], pa.list_(pa.int32()))], ["id", "toxic", "terms", "counts"])
    return run


def _voted(spark: SparkSession, settings: Settings):
    """Votes on the examples, worked out in tasks of ``EXAMPLES_A_TASK``."""
    def voted(model: Model) -> list[float | None]:
        n, packed, key = len(model.sizes), zlib.compress(pickle.dumps(model), 1), model.key

        def run(batches):
            model = _worker_model(packed, key)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(
                    model.own_votes(b.column(0).to_pylist(), settings), pa.float64())], ["i", "vote"])
        rows = spark.range(0, n, 1, max(1, -(-n // EXAMPLES_A_TASK))).mapInArrow(run, "i long, vote double")
        return [r["vote"] for r in sorted(rows.collect(), key=lambda r: r["i"])]
    return voted


def _scored(model: Model | None, settings: Settings):
    # the workers that voted keep their index: only the steps are new
    packed, key, steps = (zlib.compress(pickle.dumps(model), 1), model.key, model.steps) if model else (None, "", None)

    def run(batches):
        model = _worker_model(packed, key) if packed else None
        if model:
            model.steps = steps
            terms = _worker_terms(model.vocabulary, settings, key)
        for b in batches:
            for at, texts in _groups(b.column(1)):
                rows = model.scores(terms.counts(texts), settings) if model else [(0.0, [], [])] * len(texts)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, len(texts)), pa.array([r[0] for r in rows], pa.float64()),
                    pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["id", "score", "neighbours", "cosines"])
    return run


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _held_out():
    return F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> DataFrame:
    """(id_col, held_out, score, predicted, neighbours, cosines), one row per row of ``docs``.

    Labels count for rows whose crc32 of the id as text, mod 3, is not 1
    (the others are held out); at most ``examples_per_class`` of each class
    (smallest id hash) are examples. ``neighbours`` and ``cosines`` are the
    evidence. predicted is 1 from a score of 0.7.

    Defined results: an empty or null text, or one without any known term,
    scores the rate of such examples; null labels and ids are not learned
    from; a null id has a null held_out; an id that is labelled 0 and 1 gives
    two examples, equal rows one; ties among neighbours go to the first example of the
    index; without labels every score is 0; repeated rows score alike; extra
    columns are ignored; empty tables give an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")) \
        .where(F.col("toxic").isin(0, 1) & ~_held_out())
    known = stage(spark, known.join(docs.select("id").distinct(), "id", "left_semi"), "labels")
    rates = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [(r["id"], r["toxic"]) for y in (0, 1) for r in known.where(F.col("toxic") == y).orderBy(
        F.xxhash64("id"), "id").limit(settings.examples_per_class).collect()]
    model = None
    if picked:
        chosen = F.broadcast(spark.createDataFrame(picked, "id long, toxic int"))
        sample = stage(spark, hash_sample(docs.join(chosen, "id"), "toxic", ["id", "text"], settings.examples_per_class)
                       .select("id", "text", "toxic"), "examples")
        found = sample.select("text").mapInArrow(_terms, "term long, quick long").distinct().toArrow()
        hashes, quick = (found.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("term", "quick"))
        vocabulary = quick[np.argsort(hashes)]
        key = uuid.uuid4().hex
        n_docs = docs.count()
        found = docs.select("text").mapInArrow(_doc_counts(vocabulary, settings, key), "term long, n long") \
            .groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        freq = np.zeros(len(vocabulary))
        freq[found.column("term").to_numpy()] = found.column("n").to_numpy()
        idf = np.log((1 + n_docs) / (1 + freq))
        rows = [(i, y, t, c) for b in sample.mapInArrow(
            _example_rows(vocabulary, settings), "id long, toxic int, terms array<int>, counts array<int>")
            .toArrow().to_batches() for i, y, t, c in zip(
                b.column(0).to_pylist(), b.column(1).to_pylist(), _arrays(b.column(2)), _arrays(b.column(3)))]
        del found
        rows.sort(key=lambda e: (e[0], e[1], e[2].tobytes(), e[3].tobytes()))
        model = build_model(key, vocabulary, idf, rows, rates, settings, _voted(spark, settings))
    out = docs.mapInArrow(_scored(model, settings),
                          "id long, score double, neighbours array<long>, cosines array<double>")
    return out.select(F.col("id").alias(id_col), _held_out().alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"), "neighbours", "cosines")
