"""SentencePiece (BPE) encoding by suffix-array matching, and decoding.

New words of a batch are concatenated and indexed by a suffix array; every
vocabulary piece is binary-searched for its range of occurrences. These
edges are relaxed from left to right, those of all words at one distance from
their word's start together: the best path to a position ends with the one piece that byte-pair merging would put
there, which is the piece that the last piece of the path before it keeps
as its neighbour (merging the two pieces' characters gives these two pieces
again). So the path is the encoding of the merge rules, not an
approximation of it.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_CACHED_WORDS = 120_000
_CACHED_PARTS = 300_000
_LONGEST_CACHED = 64
_CHARS_AT_ONCE = 1 << 18
_LEVELS = 64  # characters of a word that are relaxed with those of the other words; the rest one by one
_PAIRS = 1 << 21  # places for pairs of pieces that are known to be kept apart or not
_RUNS = re.compile(r"[^\W\d_]+|[\W\d_]+")  # letters, or anything else


class PieceModel:
    """Pieces, scores and byte pieces of a model file with identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        special = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)}
        self.text = [m.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.text) if i not in special}
        self.score = {p: m.get_score(i) for p, i in self.ids.items()}
        self.byte_id = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [b"" if i in special else p.encode() for i, p in enumerate(self.text)]
        for b, i in enumerate(self.byte_id):
            self.bytes[i] = bytes([b])
        self.longest = max(map(len, self.ids))
        self.merged = lru_cache(50_000)(self._merged)
        self.merges = lru_cache(20_000)(self._merges)
        self.fits: dict[int, bool] = {}  # by a << 21 | b, in long words
        self.pairs = np.full(_PAIRS, -1, np.int64)  # key and answer of the last pair of a place
        self.length = np.array([len(p) for p in self.text])
        self.alone = np.full(n, -1, np.int8)  # whether a piece's characters are merged to it; -1: not yet known
        self.names = {i: p for p, i in self.ids.items()}  # also numbers of unknown characters
        # pairs of a letter and another character inside a piece; a word with such a pair is not cut
        self.crossing = frozenset(a[-1] + b[0] for p in self.ids for runs in (_RUNS.findall(p.lstrip(SPACE)),)
                                  for a, b in zip(runs, runs[1:]))
        self.piece = np.array(list(self.ids.values()), np.int64)
        self.points = np.zeros((len(self.ids), self.longest), np.int64)  # code points, 0 past the end
        for row, p in zip(self.points, self.ids):
            row[: len(p)] = [ord(c) for c in p]

    def _merged(self, text: str, steps: list | None = None) -> tuple[str, ...]:
        """Byte-pair merging of a short text by its definition: best score first, then leftmost.

        ``steps`` gets the score of each merge, and the first and last part after it.
        """
        part = list(text)
        nxt, prv = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, int, str]] = []
        end = len(part) - 1

        def offer(i):
            j = nxt[i] if i >= 0 else len(part)
            if i >= 0 and j < len(part) and (s := self.score.get(both := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, j, both))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if part[i] and nxt[i] == j and j < len(part) and part[i] + part[j] == both:
                part[i], part[j] = both, ""
                nxt[i] = nxt[j]
                if nxt[i] < len(part):
                    prv[nxt[i]] = i
                else:
                    end = i
                if steps is not None:
                    steps.append((self.score[both], part[0], part[end]))
                offer(i)
                offer(prv[i])
        return tuple(p for p in part if p)

    def _merges(self, piece: str) -> tuple[list[float], list[str], list[str], bool]:
        """Merging a piece's characters: score of the next merge, first part and last part before it; whether it gives the piece."""
        steps: list[tuple[float, str, str]] = []
        whole = self._merged(piece, steps) == (piece,)
        scores, firsts, lasts = zip(*steps) if steps else ((), (), ())
        return [*scores, -inf], [piece[0], *firsts], [piece[-1], *lasts], whole

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging keeps pieces a and b apart as they are."""
        scores, _, ends, whole = self.merges(self.names[a])
        others, heads, _, both = self.merges(self.names[b])
        if not (whole and both):
            return False
        i = j = 0
        while True:  # the merges of both in their common order, until one across would come first
            s, left, right = self.score.get(ends[i] + heads[j]), scores[i], others[j]
            if s is not None and s > left and s >= right:
                return False
            if left >= right:
                if left == -inf:
                    return True
                i += 1
            else:
                j += 1

    def known_neighbours(self, a: int, b: int) -> bool:
        key = a << 21 | b
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 250_000:
                self.fits.clear()
            ok = self.fits[key] = self.neighbours(a, b)
        return ok

    def all_neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``neighbours`` of many pairs; a place of the table keeps its last pair."""
        key = a << 21 | b
        place = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % _PAIRS
        held = self.pairs[place]
        ok = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            keys, first, at = np.unique(key[new], return_index=True, return_inverse=True)
            answers = np.array([self.neighbours(k >> 21, k & 0x1FFFFF) for k in keys.tolist()])
            self.pairs[place[new[first]]] = keys << 1 | answers
            ok[new] = answers[at]
        return ok

    def starts_word(self, pieces: np.ndarray) -> np.ndarray:
        """Whether merging the characters of each piece gives the piece."""
        out = pieces >= len(self.text)
        listed = pieces[~out]
        for t in np.unique(listed[self.alone[listed] < 0]).tolist():
            self.alone[t] = len(self.text[t]) == 1 or self._merged(self.text[t]) == (self.text[t],)
        out[~out] = self.alone[listed] == 1
        return out

    def number(self, char: str) -> int:
        """The piece of a character; characters without one get numbers past the vocabulary."""
        i = self.ids.get(char)
        if i is None:
            i = len(self.text) + ord(char)
            self.names[i] = char
        return i

    @lru_cache(4096)  # noqa: B019  (one model lives as long as its task)
    def spaces(self, n: int) -> list[int]:
        return [self.ids[p] for p in self.merged.__wrapped__(SPACE * n)] if n else []


def occurrences(model: PieceModel, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, piece) of every piece occurrence in code points (0 between words), sorted by position.

    The suffix array sorts by as many characters as the longest piece has.
    """
    depth = model.longest
    seen = np.zeros(0x110000, bool)
    seen[text] = True
    seen[0] = False
    chars = np.flatnonzero(seen)
    width = 1 if len(chars) < 254 else 2 if len(chars) < 65_534 else 4
    kind = {1: np.uint8, 2: np.dtype(">u2"), 4: np.dtype(">u4")}[width]
    code = np.zeros(len(text) + depth, kind)
    code[: len(text)] = np.where(text > 0, np.searchsorted(chars, text) + 1, 0)
    suffix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(code, depth)[: len(text)])
    raw = suffix.view(np.uint8).reshape(len(text), depth * width)
    pad = -raw.shape[1] % 8
    words = np.pad(raw, ((0, 0), (0, pad))).view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    keys = raw[order].view(f"S{depth * width}").ravel()
    # pieces in the batch's codes; those with a character that the batch lacks can't occur
    x = np.searchsorted(chars, model.points)
    here = (chars[np.minimum(x, len(chars) - 1)] == model.points) | (model.points == 0)
    some = np.flatnonzero(here.all(axis=1))
    end = model.points[some] == 0
    found, x = model.piece[some], x[some] + 1
    top = (1 << 8 * width) - 1
    low = np.where(end, 0, x).astype(kind).view(f"S{depth * width}").ravel()
    high = np.where(end, top, x).astype(kind).view(f"S{depth * width}").ravel()
    lo = np.searchsorted(keys, low, side="left")
    hi = np.searchsorted(keys, high, side="right")
    n = hi - lo
    at = order[np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)]
    piece = np.repeat(found, n)
    by = np.argsort(at, kind="stable")
    return at[by], piece[by]


def encode_words(model: PieceModel, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(piece numbers of words, each encoded by itself; where those of each word start, and the end)."""
    joined = "\0".join(words)
    text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.array([len(w) for w in words])
    starts = np.cumsum(size + 1) - size - 1
    inside = np.ones(len(text) + 1, bool)  # a NUL inside a word is a character without a piece
    inside[starts + size] = False
    position, piece = occurrences(model, np.where(inside[:-1], text, 0))
    length = model.length
    single = np.zeros(len(text), bool)
    single[position[length[piece] == 1]] = True
    lone = np.flatnonzero(inside[:-1] & ~single)
    if len(lone):  # characters without a piece are edges too
        position = np.concatenate([position, lone])
        piece = np.concatenate([piece, [model.number(joined[i]) for i in lone.tolist()]])
        by = np.argsort(position, kind="stable")
        position, piece = position[by], piece[by]
    ends = position + np.where(piece < len(length), length[np.minimum(piece, len(length) - 1)], 1)
    last = np.full(len(text) + 1, -2)  # the last piece of the path to a position; -1: start of a word
    last[starts] = -1
    level = position - np.repeat(starts, size + 1)[position]
    short = np.flatnonzero(level < _LEVELS)
    short = short[np.argsort(level[short].astype(np.int8), kind="stable")]
    cuts = np.searchsorted(level[short], np.arange(_LEVELS + 1))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        some = short[lo:hi]
        if k:
            some = some[last[position[some]] >= 0]
            ok = model.all_neighbours(last[position[some]], piece[some])
        else:
            ok = model.starts_word(piece[some])
        last[ends[some[ok]]] = piece[some[ok]]
    if len(short) < len(level):
        tail = np.flatnonzero(level >= _LEVELS)
        path, ok = last.tolist(), model.known_neighbours
        for i, j, t in zip(position[tail].tolist(), ends[tail].tolist(), piece[tail].tolist()):
            if path[i] >= 0 and ok(path[i], t):
                path[j] = t
        last = np.array(path)
    at = np.full(len(text) + 1, -1)  # pieces of the paths by position
    j = starts + size
    live = np.flatnonzero((size > 0) & (size <= _LEVELS))
    while len(live):
        t = last[j[live]]
        j[live] -= np.where(t < len(length), length[np.minimum(t, len(length) - 1)], 1)
        at[j[live]] = t
        live = live[j[live] > starts[live]]
    for i in np.flatnonzero(size > _LEVELS).tolist():
        s, back = int(starts[i]), last[starts[i]: starts[i] + size[i] + 1].tolist()
        e = int(size[i])
        while e > 0:
            t = back[e]
            e -= len(model.names[t])
            at[s + e] = t
    found = np.flatnonzero(at >= 0)
    return at[found], np.append(np.searchsorted(found, starts), len(found))


class Encoder:
    """Texts to ids (little-endian uint32 bytes) with bounded caches of words and of their parts."""

    def __init__(self, model: PieceModel):
        self.model, self.known, self.parts = model, {}, {}

    def _ids(self, pieces: list[int]) -> list[int]:
        n = len(self.model.text)
        if max(pieces) < n:
            return pieces
        out = []
        for t in pieces:
            if t < n:
                out.append(t)
            else:  # byte fallback
                out += [self.model.byte_id[b] for b in chr(t - n).encode()]
        return out

    def _cut(self, word: str) -> list[str]:
        """A word with its space, cut where no piece can cross: between letters and other characters."""
        if word.isalpha() or any(pair in word for pair in self.model.crossing):
            return [SPACE + word]
        first, *rest = _RUNS.findall(word)
        return [SPACE + first, *rest]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of all ``words``; those that are too long for the cache are returned only."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > _CACHED_WORDS:
            self.known = {w: self.known[w] for w in words if w in self.known}
        cuts = [self._cut(w) for w in new]
        need = {p for c in cuts for p in c}
        todo = sorted(p for p in need if p not in self.parts)
        if len(self.parts) + len(todo) > _CACHED_PARTS:
            self.parts = {p: self.parts[p] for p in need if p in self.parts}
        at = 0
        while at < len(todo):
            size, end = 0, at
            while end < len(todo) and (end == at or size < _CHARS_AT_ONCE):
                size += len(todo[end]) + 1
                end += 1
            pieces, bounds = encode_words(self.model, todo[at:end])
            ids, ends = pieces.astype("<u4").tobytes(), (4 * bounds).tolist()
            for w, a, b in zip(todo[at:end], ends, ends[1:]):
                self.parts[w] = ids[a:b]
            unknown = np.flatnonzero(pieces >= len(self.model.text))
            for i in np.unique(np.searchsorted(bounds, unknown, side="right") - 1).tolist():
                self.parts[todo[at + i]] = np.array(self._ids(pieces[bounds[i]: bounds[i + 1]].tolist()), "<u4").tobytes()
            at = end
        rare = {}
        for w, cut in zip(new, cuts):
            ids = self.parts[cut[0]] if len(cut) == 1 else b"".join(map(self.parts.__getitem__, cut))
            (self.known if len(w) <= _LONGEST_CACHED else rare)[w] = ids
        for p in todo:
            if len(p) > _LONGEST_CACHED:
                del self.parts[p]
        return rare

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        words = set().union(*split)
        words.discard("")
        rare = self._learn(words)
        known = self.known if not rare else self.known | rare
        alone = np.array([self.model.ids[SPACE]], "<u4").tobytes()
        out = []
        for ws in split:
            if "" not in ws:
                out.append(b"".join(map(known.__getitem__, ws)))
                continue
            parts, run = [], 0
            for w in ws:  # several spaces: the last joins the word if merging puts it there
                if not w:
                    run += 1
                    continue
                ids = known[w]
                if run and ids[:4] == alone:
                    parts += [self._spaces(run + 1), ids[4:]]
                else:
                    parts += [self._spaces(run), ids]
                run = 0
            out.append(b"".join([*parts, self._spaces(run)]))
        return out

    def _spaces(self, n: int) -> bytes:
        return np.array(self.model.spaces(n), "<u4").tobytes()


def decode(model: PieceModel, ids: list[int]) -> str:
    """Text of ids: pieces joined, byte pieces as UTF-8, the dummy prefix dropped."""
    text = b"".join(map(model.bytes.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


_KEPT: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One model and word cache per worker process, kept from task to task."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Encoder(PieceModel(path))
    return _KEPT[path]


def _encoded(path: str):
    def run(batches):
        encoder = _encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = encoder.encode(pc.fill_null(part.column(1), "").to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                     pa.array([zlib.crc32(x) for x in ids], pa.int64()), *part.columns[2:]],
                    ["id", "ids", "crc", *b.schema.names[2:]])
    return run


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, ids, ids_crc32, kept columns): the model's ids of every whole text, without begin and end ids.

    Defined results: null and empty texts have no ids; U+2581 counts as a
    space; null and repeated ids pass; other columns are ignored; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *keep)
    kept = "".join(f", {c} {t}" for c, t in rows.dtypes[2:])
    return rows.mapInArrow(_encoded(model_path), f"id long, ids array<int>, crc long{kept}").select(
        F.col("id").alias(id_col), "ids", F.col("crc").alias("ids_crc32"), *keep)


def _decoded(path: str):
    def run(batches):
        model = _encoder(path).model
        for b in batches:
            for at in range(0, b.num_rows, 512):
                ids = b.column(1).slice(at, 512).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, 512), pa.array([decode(model, x or []) for x in ids], pa.string())]
                    + [c.slice(at, 512) for c in b.columns[2:]], ["id", "text", *b.schema.names[2:]])
    return run


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, text, kept columns) of rows with ids; null ids give an empty text."""
    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"), *keep)
    kept = "".join(f", {c} {t}" for c, t in rows.dtypes[2:])
    return rows.mapInArrow(_decoded(model_path), f"id long, text string{kept}").select(
        F.col("id").alias(id_col), "text", *keep)
