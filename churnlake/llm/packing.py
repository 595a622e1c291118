"""Best-fit packing of token pieces by a configuration linear program.

Texts become pieces of at most ``capacity`` tokens. The numbers of pieces by
length (at most ``capacity`` numbers, whatever the corpus size) go to the
driver, where the configuration program (fewest sequences whose fillings,
"patterns", cover every length) is solved by multiplicative weights: prices
of lengths fall as they get covered, and a knapsack dynamic program finds the
best-paying patterns. Patterns are rounded down to whole multiples and what
is left is packed by best fit on the histogram. Executors then place each
piece by its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlake.llm.common import stage

CAPACITY = 4096
END_ID = 1
_CACHED_PARTS = 1_200_000
#: Latin letters and a run of ASCII marks without apostrophe: the tokenizer lower-cases and splits such parts there.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordCache:
    """Token ids of texts as little-endian uint32 bytes.

    The tokenizer treats white space as a boundary that leaves no token, so
    a text's ids are those of its parts between ASCII white space; parts are
    encoded once and kept in a bounded cache. A plain word with marks behind
    it has the ids of the lower-cased word and those of the marks; plain
    words are encoded many to a string, and told apart by the word ends that
    their last tokens carry.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _alone(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 512):
            some = words[at: at + 512]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):  # no word ends to go by
                out += self._alone(some)
                continue
            raw, last = ids.tobytes(), 0
            for x in cuts.tolist():
                out.append(raw[4 * last: 4 * x])
                last = x
        return out

    def _learn(self, new: list[bytes]) -> None:
        plain, other = [], []
        for w in new:
            text = w.decode()
            m = _PLAIN.fullmatch(text)
            if m:
                plain.append((w, m[1].lower(), m[2]))
            else:
                other.append((w, text))
        words = list({x[1] for x in plain})
        ids = dict(zip(words, self._words(words)))
        marks = list({x[2] for x in plain} - {""})
        ids_of_marks = dict(zip(marks, self._alone(marks)))
        ids_of_marks[""] = b""
        for w, word, mark in plain:
            self.known[w] = ids[word] + ids_of_marks[mark]
        self.known.update(zip((w for w, _ in other), self._alone([t for _, t in other])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > _CACHED_PARTS:
            self.known = {}
        get = self.known.get
        found = []
        for t in texts:  # one look-up per part; what is missing is learned at once for all texts
            parts = t.split()
            ids = list(map(get, parts))
            at = [i for i, x in enumerate(ids) if x is None] if None in ids else []
            found.append((ids, [(i, parts[i]) for i in at]))
        new = {w for _, missing in found for _, w in missing}
        if new:
            self._learn(list(new))
        known = self.known
        for ids, missing in found:
            for i, w in missing:
                ids[i] = known[w]
        return [b"".join(ids) for ids, _ in found]


_KEPT: dict[str, WordCache] = {}


def _worker_cache(path: str) -> WordCache:
    """One cache per worker process, kept from task to task."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = WordCache(path)
    return _KEPT[path]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = end_id.to_bytes(4, "little")
    names = ["id", "piece", "start", "length", "crc"] + ["ids"] * with_ids

    def run(batches):
        cache = _worker_cache(path)
        for b in batches:
            column = pa.compute.fill_null(b.column(1), "").cast(pa.binary())
            for at in range(0, b.num_rows, 1024):
                rows = []
                for i, ids in zip(b.column(0).slice(at, 1024).to_pylist(),
                                  cache.encode(column.slice(at, 1024).to_pylist())):
                    ids += end
                    for p, x in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[x: x + 4 * capacity]
                        rows.append((i, p, x // 4, len(cut) // 4, zlib.crc32(cut), cut))
                out = [pa.array([r[k] for r in rows], t) for k, t in enumerate(
                    (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if with_ids:
                    out.append(pa.array([np.frombuffer(r[5], "<u4").astype(np.int32) for r in rows],
                                        pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names)
    return run


def best_fill(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best price and last chosen length (index, -1: one token left free) for every room."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = fits[c]
        value[c] = value[c - 1]
        if k:
            v = value[c - lengths[:k]] + price[:k]
            j = int(v.argmax())
            if v[j] > value[c]:
                value[c], last[c] = v[j], j
    return value, last


@dataclass
class Pattern:
    counts: dict[int, int]  # length index -> pieces of it in one sequence
    times: float


def solve_fractional(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 48,
                     priced: int = 96, rate: float = 0.08) -> list[Pattern]:
    """Multiplicative weights on the configuration program; ``need`` pieces of each of ``lengths`` (ascending).

    A length's price starts at its share of the capacity (the bound that no
    packing beats) and falls by a constant factor a unit of relative
    coverage. A round prices once and takes the best pattern around each of
    the ``priced`` least covered lengths.
    """
    covered = np.zeros(len(lengths))
    base = lengths / capacity
    found: dict[tuple, Pattern] = {}
    for _ in range(rounds):
        short = np.maximum(need - covered, 0)
        if (short * lengths).sum() <= 0.002 * (need * lengths).sum():
            break
        _, last = best_fill(lengths, base * np.exp(-rate * np.minimum(covered / need, 8)), capacity)
        for j in np.argsort(-(short / need) * lengths, kind="stable")[:priced]:
            counts, room = {int(j): 1}, capacity - int(lengths[j])
            while room > 0:
                k = int(last[room])
                if k < 0:
                    room -= 1
                    continue
                counts[k] = counts.get(k, 0) + 1
                room -= int(lengths[k])
            step = min(max(need[k] - covered[k], 0.05 * need[k]) / c for k, c in counts.items())
            key = tuple(sorted(counts.items()))
            found.setdefault(key, Pattern(counts, 0.0)).times += step
            for k, c in counts.items():
                covered[k] += step * c
    return list(found.values())


def best_fit_rest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit-decreasing on a histogram: fill behind the longest piece with the longest that still fits."""
    out, left = [], left.copy()
    while left.any():
        counts, room = {}, capacity
        avail = left.copy()
        while True:
            k = int(np.searchsorted(lengths, room, side="right")) - 1
            while k >= 0 and not avail[k]:
                k -= 1
            if k < 0:
                break
            c = int(min(avail[k], room // lengths[k]))
            counts[k] = c
            avail[k] -= c
            room -= c * int(lengths[k])
        times = min(int(left[k]) // c for k, c in counts.items())
        for k, c in counts.items():
            left[k] -= times * c
        out.append(Pattern(counts, times))
    return out


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Whole patterns ({length: count}, times) that hold exactly the pieces of a length histogram."""
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    out = []
    if len(lengths):
        for p in sorted(solve_fractional(lengths, left.astype(float), capacity), key=lambda p: -p.times):
            times = min(int(p.times), *(int(left[k]) // c for k, c in p.counts.items()))
            if times > 0:
                for k, c in p.counts.items():
                    left[k] -= times * c
                out.append(Pattern(p.counts, times))
        out += best_fit_rest(lengths, left, capacity)
    return [({int(lengths[k]): c for k, c in p.counts.items()}, int(p.times)) for p in out]


def _plan_arrays(patterns: list[tuple[dict[int, int], int]]):
    """Slots as sorted intervals of ranks: (key = length << 44 | first rank, first sequence, copies, offset)."""
    rows, used, base = [], {}, 0
    for counts, times in patterns:
        offset = 0
        for n in sorted(counts, reverse=True):
            rows.append((n << 44 | used.get(n, 0), base, counts[n], offset))
            used[n] = used.get(n, 0) + counts[n] * times
            offset += n * counts[n]
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _placed(plan: np.ndarray):
    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = plan[np.searchsorted(plan[:, 0], length << 44 | rank, side="right") - 1]
            q = rank - (row[:, 0] & ((1 << 44) - 1))
            out = [b.column(i) for i in range(b.num_columns - 1)]
            out += [pa.array(row[:, 1] + q // row[:, 2]), pa.array(row[:, 3] + q % row[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(out, b.schema.names[:-1] + ["sequence_id", "offset"])
    return run


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                   text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
                   with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A document's ids, then ``end_id``; only documents longer than
    ``capacity`` are cut, every ``capacity`` ids. ``tokenizer_path`` must be
    readable where tasks run. ``with_ids`` adds the ids of each piece.

    Defined results: a null, empty or blank text is the single end id; rows
    with a null or repeated id are packed like others; ties between pieces
    of one length go by id, piece and checksum; extra columns are ignored;
    an empty table gives an empty result.
    """
    ids = ", ids array<int>" * with_ids
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = stage(spark, docs.mapInArrow(
        _pieces(tokenizer_path, capacity, end_id, with_ids),
        f"id long, piece int, start long, length long, crc long{ids}"), "pieces")
    # ranks by length: a length is split into hash buckets, whose counts give each bucket's first rank
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(n)))
    sizes = stage(spark, pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("pieces")), "bucket_sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}
    plan = _plan_arrays(pack_histogram(histogram, capacity))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "bucket", F.coalesce(F.sum("pieces").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "crc")
    ranked = pieces.withColumn("nth", F.row_number().over(within) - 1).join(firsts, ["length", "bucket"]).select(
        "id", "piece", "start", "length", "crc", *["ids"] * with_ids, (F.col("first") + F.col("nth")).alias("rank"))
    placed = ranked.mapInArrow(_placed(plan), f"id long, piece int, start long, length long, crc long{ids}, "
                                              "sequence_id long, offset long")
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
                         *["ids"] * with_ids, "sequence_id", "offset")
