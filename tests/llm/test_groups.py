"""SimHash anchors, conversation repair and spelling variants against brute force."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from churnlake.llm import conversation_glr as C
from churnlake.llm import simhash_anchors as A
from churnlake.llm import spelling_gram as S
from churnlake.llm.common import _importable
from churnlake.llm.queries import QUERIES
from helpers import awkward, docs_frame

# --- SimHash ------------------------------------------------------------------


def slow_fingerprint(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i: i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, bits):
    """Least index reachable, by comparing all pairs."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= bits:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(fps))]


def planted(r, clusters=12, size=25):
    """Fingerprints: single ones, chains and balls with steps of up to five bits."""
    out = [r.getrandbits(64) for _ in range(300)] + [0, 1, 2 ** 64 - 1]
    for _ in range(clusters):
        here = r.getrandbits(64)
        for _ in range(size):
            new = here
            for b in r.sample(range(64), r.randrange(6)):
                new ^= 1 << b
            out.append(new)
            here = r.choice([here, new])
    return sorted(set(out))


@pytest.mark.parametrize("text", [t for t in awkward() if t is None or len(t) < 9000] + ["A b C d e F g a b c d", "é É a a a a a a"])
def test_fingerprint(text):
    for width in (1, 4):
        assert A.fingerprint(None if text is None else text.encode(), width) == slow_fingerprint(text, width)


def test_fingerprint_of_a_long_text_in_chunks(monkeypatch):
    text = awkward()[9][:60_000]
    monkeypatch.setattr(A, "_CHUNK", 700)
    assert A.fingerprint(text.encode(), 4) == slow_fingerprint(text, 4)


@pytest.mark.parametrize("dimension", [5, 12])
def test_a_pair_in_reach_meets_at_a_home(dimension):
    r, code = random.Random(dimension), A.anchors(dimension)
    assert len(set(code.tolist())) == 2 ** dimension
    x = np.array([r.getrandbits(64) for _ in range(400)], np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in r.sample(range(64), 4):
            y[i] ^= np.uint64(1 << b)
    (rx, ax, hx), (ry, ay, hy) = A.replicas(x, code, 4), A.replicas(y, code, 4)
    at_x, at_y = set(zip(rx.tolist(), ax.tolist())), set(zip(ry.tolist(), ay.tolist()))
    assert all((i, hx[i]) in at_y or (i, hy[i]) in at_x for i in range(len(x)))


def test_pairs_of_a_block_span_its_components():
    r = random.Random(3)
    fps = np.array(planted(r), np.uint64)
    hosts, guests = fps[::2], fps
    links = A.joined_pairs(hosts, guests, 4)
    assert len(links) < len(fps)  # a forest: no cluster is expanded
    got, want = defaultdict(set), defaultdict(set)
    for a, b in links:
        assert bin(int(a) ^ int(b)).count("1") <= 4
        got[int(a)].add(int(b)), got[int(b)].add(int(a))
    for a in map(int, hosts):
        for b in map(int, guests):
            if a != b and bin(a ^ b).count("1") <= 4:
                want[a].add(b), want[b].add(a)

    def reach(edges, x):
        seen, todo = {x}, [x]
        while todo:
            for y in edges[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen
    assert all(reach(got, x) == reach(want, x) for x in map(int, fps))


@pytest.mark.parametrize("block,dimension", [(4096, None), (20, 6)])
def test_links_match_brute_force(spark, block, dimension):
    _importable(spark)
    fps = planted(random.Random(block))
    frame = spark.createDataFrame([(int(np.array(x, np.uint64).astype(np.int64)),) for x in fps], "fp long")
    links = A.simhash_links(spark, frame, 4, dimension, block).collect()
    from churnlake.llm.common import connected_components
    edges = spark.createDataFrame(links, "a long, b long")
    comp = {r.node: r.component for r in connected_components(spark, edges).collect()}
    signed = [int(np.array(x, np.uint64).astype(np.int64)) for x in fps]
    want = slow_components(fps, 4)
    least = {}
    for s, w in zip(signed, want):
        least[w] = min(s, least.get(w, s))
    assert [comp.get(s, s) for s in signed] == [least[w] for w in want]


def test_simhash_components_of_awkward_rows(spark):
    texts = awkward() + awkward()[:4]
    rows = A.simhash_components(spark, docs_frame(spark, texts)).collect()
    fps = [slow_fingerprint(t, 4) if t is None or len(t) < 9000 else A.fingerprint(t.encode(), 4) for t in texts]
    want = slow_components(fps, 4)
    assert sorted((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in rows) == \
        [(i + 1, f, w + 1) for i, (f, w) in enumerate(zip(fps, want))]
    assert A.simhash_components(spark, docs_frame(spark, texts).limit(0)).collect() == []


def test_simhash_of_null_and_repeated_ids(spark):
    _importable(spark)
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (7, "x"), (None, "y z")],
                                 "doc_id long, text string")
    rows = A.simhash_components(spark, docs).collect()
    assert Counter((r.doc_id, r.component_id, r.n_equal) for r in rows) == Counter(
        {(None, 7, 3): 2, (7, 7, 3): 1, (7, 7, 1): 1, (None, None, 1): 1})


def test_op11_matches_brute_force(spark, sf_small):
    rows = QUERIES["op11_simhash_anchors"](spark, sf_small).collect()
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect())
    fps = [slow_fingerprint(t, 4) for _, t in docs]
    want = slow_components(fps, 4)
    assert sorted(map(tuple, rows)) == [(d, f"{f:016x}", docs[w][0]) for (d, _), f, w in zip(docs, fps, want)]


# --- conversations --------------------------------------------------------------


def slow_repair(rows):
    """(cost, audit, repaired) of rows (role, must_go, truncated, text): cheapest first over all edit sequences."""
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, at, roles, out = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        if cost > 3 * len(rows) or best.get((at, roles, audit), 99) < cost:
            continue
        moves = [("I", 2, at, n[0], (n, "")) for n in ("user", "assistant")]
        if at < len(rows):
            role, must_go, cut, text = rows[at]
            moves.append(("D", 3, at + 1, "", None))
            if not must_go:
                moves.append(("K", cut, at + 1, role[:1] or "?", (role, text)))
                moves += [("R", 2 + cut, at + 1, n[0], (n, text)) for n in ("user", "assistant")]
        for letter, price, to, initial, line in moves:
            new = roles + initial
            if re.fullmatch("(s|s?(ua)*u?)?", new):
                heapq.heappush(heap, (cost + price, audit + letter, to, new, out + ((line,) if line else ())))


def by_parser(rows):
    """The same through ``Repair``."""
    state, out = C.Repair(), []
    for i, (role, must_go, cut, text) in enumerate(rows):
        # faults follow from texts: blank, cut or whole
        out += state.row(i, role, " " if must_go else f"{text}{i}" + ("" if cut else "."), False)
    out += state.end()
    return state.cost, "".join(r[3] for r in out), [r[4] for r in out if r[4] is not None]


def test_all_short_conversations():
    kinds = [(r, g, c, "t") for r in ("system", "user", "assistant", "tool", "") for g, c in ((0, 0), (1, 0), (0, 1))]
    r = random.Random(1)
    cases = [list(x) for n in range(3) for x in itertools.product(kinds, repeat=n)]
    cases += [[r.choice(kinds) for _ in range(r.choice([3, 4, 5]))] for _ in range(150)]
    for rows in cases:
        cost, audit, lines = slow_repair(rows)
        assert by_parser(rows) == (cost, audit, [line[0] for line in lines]), rows


def test_dropping_far_tops_changes_nothing(monkeypatch):
    """Long conversations with and without the bound on what a top may cost more than the best."""
    r = random.Random(2)
    kinds = [(x, g, c, "t") for x in ("system", "user", "assistant", "tool") for g, c in ((0, 0), (1, 0), (0, 1))]
    cases = [[r.choice(kinds) for _ in range(40)] for _ in range(60)]
    cases += [[k] * 30 for k in kinds] + [[kinds[3]] * 300 + cases[0] + [kinds[3]] * 301]
    with_bound = [by_parser(x) for x in cases]
    monkeypatch.setattr(C, "IMITATE", 10 ** 9)
    C.advance.cache_clear(), C.finish.cache_clear()
    assert [by_parser(x) for x in cases] == with_bound
    C.advance.cache_clear(), C.finish.cache_clear()


def test_few_rows_are_held():
    """Unless the first edits hang on the end, as for user rows alone."""
    r = random.Random(4)
    for roles in (["user", "assistant"], ["system", "tool"], ["system", "user", "assistant"], ["tool", "assistant"]):
        state, most = C.Repair(), 0
        for i in range(3000):
            state.row(i, r.choice(roles), r.choice(["a.", "b", "", f"{i}?"]), False)
            most = max(most, len(state.held))
        assert most < 200, roles


def slow_report(rows):
    """Contract of op12 for rows (conv_id, turn, role, text) with nulls, by plain loops."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        convs[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, found in convs.items():
        found.sort()
        seen, faults, marked = set(), Counter(), []
        for _, _, role, text in found:
            body = re.findall("[^\x20\x09-\x0d]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else \
                "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            marked.append((role, fault in ("blank", "duplicate"), fault == "truncated", text))
        turns = {t for known, t, _, _ in found if known}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(found, found[1:])]
        cost, audit, lines = slow_repair(marked)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"],
                    faults["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()))
    return out


def test_op12_matches_brute_force(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_conversation_glr"](spark, sf_small).collect()
    assert sorted(map(tuple, got)) == sorted(slow_report(rows))


def test_conversations_of_awkward_rows(spark):
    _importable(spark)
    r = random.Random(6)
    rows = [(r.choice([None, *range(60)]), r.choice([None, 0, 1, 2, 9]), r.choice([None, "", "user", "assistant", "system", "usher"]),
             r.choice([None, "", " \t", "Same.", "Same.", "cut", "Ends? ", "é!\n"]), 1, "x") for _ in range(150)]
    schema = "conv_id long, turn long, role string, text string, seen int, alive_ string"
    frame = spark.createDataFrame(rows, schema)
    got = C.repair_report(C.repair_conversations(C.damage(frame))).collect()
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(slow_report([x[:4] for x in rows]), key=key)
    assert C.repair_report(C.repair_conversations(C.damage(frame.limit(0)))).collect() == []


def test_conversation_without_rows_and_its_real_rows(spark):
    _importable(spark)
    dropped = next((c, t) for c in range(99) for t in range(9) if not zlib.crc32(f"{c}:{t}".encode()) % 20)
    frame = spark.createDataFrame([(*dropped, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    (row,) = C.repair_report(C.repair_conversations(C.damage(frame))).collect()
    assert tuple(row) == (dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    frame = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "user", "You?"), (1, 3, "user", "You?")],
                                  "conv_id long, turn long, role string, text string")
    found = C.repair_conversations(frame).orderBy("position").collect()
    assert [(r.edit, r.role, r.text, r.fault) for r in found] == [
        ("K", "user", "Hi.", None), ("R", "assistant", "You?", None), ("D", None, None, "duplicate"), (None,) * 4]
    assert found[-1].cost == 5


# --- spelling ---------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_variants(counts, factor=5):
    out = []
    form = {}
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= factor * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=lambda x: x[0])


def variants(rows):
    return sorted(map(tuple, rows), key=lambda x: x[0])


@pytest.mark.parametrize("block,groups", [(4096, 6), (3, 2)])
def test_variants_match_brute_force(spark, block, groups):
    _importable(spark)
    r, words = random.Random(block), {}
    for _ in range(60):
        w = "".join(r.choice("aeiounrst×ÿéq") for _ in range(r.randrange(6, 10)))
        for _ in range(r.randrange(8)):
            words[w] = r.choice([5, 5, 6, 30, 150, 800])
            at = r.randrange(len(w))
            w = r.choice([w[:at] + r.choice("aeß") + w[at + 1:], w[:at] + w[at + 1:], w[:at] + r.choice("aÀ") + w[at:]])
    words |= {"b" * n: n for n in (254, 255, 256, 257, 2100, 2101)} | {"b" * 255 + "c": 5}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert variants(S.spelling_variants(spark, frame, groups=groups, block=block).collect()) == slow_variants(words)


def slow_counts(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def test_vocabulary_in_several_flushes(spark, monkeypatch):
    texts = awkward() + ["ÀÉÎ Straße×Weg naïve-naïve " * 5 + "abcdefg " * 500] * 3 + ["abc def " + "longword " * 7]
    docs = docs_frame(spark, texts, start=40)
    monkeypatch.setattr(S, "_FLUSH", 2)
    assert {r.word: r.n for r in S.vocabulary(docs, typos=True).collect()} == slow_counts(
        [(40 + i, t) for i, t in enumerate(texts)])
    assert S.vocabulary(docs.limit(0)).collect() == []


def test_variants_of_an_empty_table(spark):
    _importable(spark)
    frame = spark.createDataFrame([], "word string, n long")
    assert S.spelling_variants(spark, frame).collect() == []


def test_op13_matches_brute_force(spark, sf_small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    got = QUERIES["op13_spelling_gram"](spark, sf_small).collect()
    assert variants(got) == slow_variants(slow_counts(docs))
