"""Spelling variants by blocked Gram matrices of letter counts.

Words that differ by one inserted, deleted or replaced letter have letter
counts at a squared distance of one or two, and |a - b|^2 = |a|^2 + |b|^2 -
2 ab, so the matrix product of two blocks of count vectors gives all of their
distances at once. Blocks hold words of one length; to keep products small the
alphabet is dealt to ``GROUPS`` classes and a block also has one number of
letters in each class. One edit moves at most one letter from a class to
another, or adds one, so a block only meets its own words, those of the blocks
one move away, and those of the length below that lack one letter. Each pair
of blocks is multiplied once. The few pairs at most two apart are compared
letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm.common import host_guest_blocks, runs, stage

WORD = re.compile("[a-zÀ-ÿ]{6,}")
LEAST_LENGTH, LEAST_COUNT, FACTOR, TYPO = 6, 5, 5, 199
#: Letters are dealt to classes in turn: common ones first, so that classes are about equally full.
COMMON = "etaonirshdlucmfwypvbgkqjxzéöäüèçêóñíáúà"
GROUPS = 6
#: Words of a block (and of its partners) that meet in one product.
BLOCK = 4096
_FLUSH = 300_000


def typo(doc_id, run: str, crc: int | None = None) -> str:
    """``run`` without one letter where crc32 of ``<doc_id>:<run>`` is a multiple of 199."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()) if crc is None else crc
    h = zlib.crc32(run.encode(), start)
    if h % TYPO:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counted(typos: bool):
    """Batches of (id, text) -> (word, n) summed over as many documents as memory allows."""
    def run(batches):
        total = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                text = text.as_py()
                if not text:
                    continue
                found = Counter(WORD.findall(text.lower().decode()))  # bytes: only A-Z change
                if typos:
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in found.items():
                        if not zlib.crc32(word.encode(), start) % TYPO:
                            word = typo(doc_id, word, start)
                            if len(word) < LEAST_LENGTH:
                                continue
                        total[word] += n
                else:
                    total.update(found)
                if len(total) >= _FLUSH:
                    yield _words(total)
                    total = Counter()
        if total:
            yield _words(total)
    return run


def _words(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                      ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typos: bool = False,
               least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least six letters [A-Za-zÀ-ÿ] (A-Z lower-cased) that occur ``least`` times or more.

    ``typos`` damages words by ``typo`` first. A null id has an empty name there.
    """
    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    return rows.mapInArrow(_counted(typos), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= least)


def letter_class(letter: int, groups: int) -> int:
    at = COMMON.find(chr(letter))
    return (at if at >= 0 else letter) % groups


def _codes(words: list[str]) -> np.ndarray:
    """(words, length) letters as bytes; all words have one length and letters up to U+00FF."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _blocked(groups: int):
    """Batches of (word, n) -> (word, n, size, mix); mix has the number of letters of each class, a byte each.

    Words longer than 255 letters are blocked by their length alone (mix 0).
    """
    def run(batches):
        table = np.array([letter_class(i, groups) for i in range(256)])
        for b in batches:
            size = pa.compute.utf8_length(b.column(0)).to_numpy().astype(np.int64)
            text = "".join(b.column(0).to_pylist()).encode("latin-1")
            cell = np.repeat(np.arange(len(size)) * groups, size) + table[np.frombuffer(text, np.uint8)]
            counts = np.bincount(cell, minlength=len(size) * groups).reshape(-1, groups)
            mix = (counts << 8 * np.arange(groups)).sum(axis=1)
            mix[size > 255] = 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size.astype(np.int32)), pa.array(mix)],
                                             ["word", "n", "size", "mix"])
    return run


def _partners(groups: int):
    """Blocks (size, mix, kin) that a word of a block is a guest of: its own (kin), those that one letter in an
    earlier class in place of one in a later class makes, and those that one letter more makes."""
    unit = [1 << 8 * g for g in range(groups)]
    cell = lambda size, mix, kin: f"named_struct('size', {size}, 'mix', {mix}, 'kin', {kin})"
    moved = [f"if(size <= 255 and mix & {255 * unit[j]}L > 0, {cell('size', f'mix + {unit[i] - unit[j]}L', 'false')}, null)"
             for i in range(groups) for j in range(i + 1, groups)]
    grown = [f"if(size < 255, {cell('size + 1', f'mix + {u}L', 'false')}, null)" for u in unit]
    longer = f"if(size < 255, null, {cell('size + 1', '0L', 'false')})"
    return F.expr(f"array_compact(array({', '.join([cell('size', 'mix', 'true'), *moved, *grown, longer])}))")


def _counts(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Letter counts of each word as floats that hold their products exactly."""
    at = np.searchsorted(letters, codes) + np.arange(len(codes))[:, None] * len(letters)
    kind = np.float32 if codes.shape[1] < 2000 else np.float64
    return np.bincount(at.ravel(), minlength=len(codes) * len(letters)).reshape(-1, len(letters)).astype(kind)


def near_pairs(hosts: np.ndarray, guests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of words (rows of letters) that one edit apart; guests have the hosts' length or one less."""
    letters = np.unique(np.concatenate([np.unique(hosts), np.unique(guests)]))
    a, b = _counts(hosts, letters), _counts(guests, letters)
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    found, step = [], max(1, (1 << 21) // len(guests))
    for lo in range(0, len(hosts), step):
        apart = a[lo: lo + step] @ b.T
        apart *= -2
        apart += aa[lo: lo + step, None]
        apart += bb[None, :]
        h, g = np.nonzero((apart <= 2) & (apart > 0))
        x, y = hosts[h + lo], guests[g]
        if hosts.shape[1] == guests.shape[1]:
            good = (x != y).sum(axis=1) == 1
        else:
            head = np.logical_and.accumulate(x[:, :-1] == y, axis=1).sum(axis=1)
            tail = np.logical_and.accumulate((x[:, 1:] == y)[:, ::-1], axis=1).sum(axis=1)
            good = head + tail >= y.shape[1]
        found.append((h[good] + lo, g[good]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _best(words: list[str], n: np.ndarray, who: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    """(word, n_near, form_n, form): number of near words and the best of them, for each word in ``who``."""
    order = np.lexsort((-n[near], who))
    who, near = who[order], near[order]
    first = np.nonzero(np.concatenate([[True], who[1:] != who[:-1]]))[0]
    ends = np.concatenate([first[1:], [len(who)]])
    top = n[near[first]]
    form = [words[i] for i in near[first]]
    tied = np.nonzero((ends - first > 1) & (n[near[np.minimum(first + 1, len(near) - 1)]] == top))[0]
    for t in tied.tolist():
        row = near[first[t]: ends[t]]
        form[t] = min(words[i] for i in row[n[row] == top[t]])
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in who[first]]), pa.array(ends - first, pa.int64()), pa.array(top, pa.int64()),
         pa.array(form)], ["word", "n_near", "form_n", "form"])


def _multiplied(batches):
    """Sorted rows (size, mix, i, j, host, kin, word, n) -> partial (word, n_near, form_n, form)."""
    for t in runs(batches, 4):
        host, kin = t.column("host").to_numpy(), t.column("kin").to_numpy()
        if host.all() or not host.any():
            continue
        size, words, n = t.column("size")[0].as_py(), t.column("word").to_pylist(), t.column("n").to_numpy()
        same = pa.compute.utf8_length(t.column("word")).to_numpy() == size
        mine = np.nonzero(host)[0]
        codes = _codes([words[i] for i in mine])
        who, near = [], []
        for kind, both in ((~host & kin, False), (~host & ~kin & same, True), (~host & ~same, True)):
            other = np.nonzero(kind)[0]
            if len(other):
                h, g = near_pairs(codes, _codes([words[i] for i in other]))
                # words of one block are hosts and guests, so each pair comes twice there
                who += [mine[h], other[g]][: 1 + both]
                near += [other[g], mine[h]][: 1 + both]
        who, near = np.concatenate(who), np.concatenate(near)
        if len(who):
            yield _best(words, n, who, near)


def spelling_variants(spark: SparkSession, words: DataFrame, factor: int = FACTOR, groups: int = GROUPS,
                      block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct ``words`` (word, n).

    Two words are near if one insertion, deletion or replacement of a letter
    makes one the other. ``n_near`` counts the near words; ``form`` is the
    near word of largest n (ties: the smallest) if that is at least ``factor``
    times the word's n, else null, and ``root`` is where the forms lead. Counts
    rise along the forms, so they end.

    Defined results: a word without near words has n_near 0, no form and
    itself as root; an empty table gives an empty result. Words hold letters up
    to U+00FF; they may have any length.
    """
    vocab = stage(spark, words.select("word", "n").mapInArrow(
        _blocked(groups), "word string, n long, size int, mix long"), "spelling_words")
    to = F.explode(_partners(groups)).alias("to")
    blocks = vocab.groupBy("size", "mix").agg(F.count(F.lit(1)).alias("c"))
    guests = blocks.select("c", to).groupBy("to.size", "to.mix").agg(F.sum("c").alias("guests"))
    sizes = blocks.join(guests, ["size", "mix"]).withColumnRenamed("c", "hosts")
    rows = vocab.select("word", "n", to)
    rows = rows.select("to.size", "to.mix", F.lit(False).alias("host"), "to.kin", "word", "n").unionByName(
        vocab.select("size", "mix", F.lit(True).alias("host"), F.lit(True).alias("kin"), "word", "n"))
    found = host_guest_blocks(rows, sizes, ["size", "mix"], block, "word").mapInArrow(
        _multiplied, "word string, n_near long, form_n long, form string")
    best = stage(spark, found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("neg"), "form")).alias("best")),
        "spelling_near")
    named = stage(spark, vocab.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.neg") >= factor * F.col("n"), F.col("best")).alias("best")), "spelling_named")
    roots = _roots(spark, named.where("best is not null").select("word", F.col("best.form").alias("root")))
    return named.join(roots, "word", "left").select(
        "word", F.col("best.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near",
        (-F.col("best.neg")).alias("form_n"))


def _roots(spark: SparkSession, steps: DataFrame) -> DataFrame:
    """(word, root): ``steps`` followed to their ends; every round doubles their length."""
    while True:
        steps = stage(spark, steps, "spelling_roots")
        on = steps.select(F.col("word").alias("at"), F.col("root").alias("next"))
        further = steps.join(on, steps["root"] == on["at"])
        if further.isEmpty():
            return steps
        steps = steps.join(on, steps["root"] == on["at"], "left").select("word", F.coalesce("next", "root").alias("root"))
