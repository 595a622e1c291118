"""The pipeline's verdicts take effect by row: repeated rows, shared ids and null ids."""

import random

import corpus_pipeline
from helpers import DOC_SCHEMA, docs_frame


def words(r, n=120):
    return " ".join("".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 5)))
                    for _ in range(n))


def frame(spark, rows):
    docs_frame(spark, [])
    return spark.createDataFrame([(i, t, "en", "s", None, 0, "x", "y") for i, t in rows], DOC_SCHEMA)


def found(spark, step, rows):
    out = dict(corpus_pipeline.STAGES)[step](spark, frame(spark, rows), "")
    return sorted((r.doc_id or 0, r.text) for r in out.collect())


def test_stages_decide_by_row(spark):
    r = random.Random(4)
    a, b, c = (words(r) for _ in range(3))
    near = a.rsplit(" ", 1)[0] + " other"
    junk = "too short"
    assert found(spark, "quality_rules", [(1, a), (1, junk), (None, b), (None, junk), (2, c), (2, c)]) == \
        sorted([(1, a), (0, b), (2, c), (2, c)])
    assert found(spark, "language_id", [(1, a), (1, "123"), (None, b), (None, "456")]
                 + [(i, words(r)) for i in range(10, 30)])[:2] == [(0, b), (1, a)]
    for rows, want in (([(1, a), (1, a), (2, near)], [(1, a)]), ([(2, near), (1, a), (1, b)], [(1, a), (1, b)]),
                       ([(None, a), (None, near), (None, b)], None), ([(None, a), (7, near)], [(7, near)])):
        got = found(spark, "ngram_jaccard", rows)
        assert got == sorted(want) if want else len(got) == 2 and (0, b) in got


def test_exact_dedup_leaves_one_row_of_a_group(spark):
    r = random.Random(5)
    a, b, c = (words(r) for _ in range(3))
    got = found(spark, "exact_dedup", [(1, a), (1, a), (2, a), (1, b), (None, b), (None, c), (None, c), (4, "x y"), (4, "xy ")])
    assert [x for x in got if x[0] != 4] == sorted([(1, a), (1, b), (0, c)]) and sum(x[0] == 4 for x in got) == 1
