import pytest

from quire.llm.exact_dedup import exact_groups, exact_kept

SCHEMA = "doc_id long, text string, kept int, _row string"


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted(
        ((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in rows), key=str
    )


@pytest.mark.parametrize(("digit", "growth"), [(1, 1), (2, 2), (64, 8)])
def test_groups(spark, digit, growth):
    rows = [
        (1, "abc"), (2, "abc"), (3, "abcd"), (4, "ab"), (5, ""), (6, None), (None, ""), (7, "ä\U0001f600"), (8, "ä\U0001f600"),
        (9, "ä"), (9, "abc"), (10, "x" * 40), (11, "x" * 40), (12, "x" * 41), (13, "abC"), (None, "alone"),
    ]
    docs = spark.createDataFrame([(*r, 0, "a") for r in rows], SCHEMA)
    got = exact_groups(docs, digit, growth).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == expected(rows)
    assert sum(r.kept for r in got) == len({t or "" for _, t in rows})
    kept = exact_kept(docs, digit, growth)
    assert kept.columns == docs.columns
    assert len({r.text or "" for r in kept.collect()}) == kept.count() == len({t or "" for _, t in rows})


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(4, "same", 1, "a")] * 50, SCHEMA)
    got = exact_groups(docs).collect()
    assert [r.group_size for r in got] == [50] * 50 and sum(r.kept for r in got) == 1


def test_long_texts(spark):
    long = "a long text " * 200_000
    rows = [(1, long), (2, long + "x"), (3, long), (4, long + "y")]
    got = exact_groups(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [
        (1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 1, True)
    ]


def test_empty_table(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
