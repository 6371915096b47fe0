import itertools
import re

import pytest
from latticelu.llm import decontam


def words(t):
    return re.sub(r"[\W_]+", " ", (t or "").lower()).strip().split(" ")


def brute(docs, items, window=13, similarity=0.8):
    out = set()
    for d, text in docs:
        w = words(text)
        for k, item in items:
            v = words(item)
            need = min(window, len(v))
            if not v[0]:
                continue
            for at in range(len(w) - need + 1):
                for q in range(len(v) - need + 1):
                    if sum(x == y for x, y in zip(w[at : at + need], v[q : q + need])) >= similarity * need - 1e-9:
                        out.add((d, k))
    return out


def test_masks_find_any_two_substitutions_in_a_window():
    for bad in itertools.combinations(range(decontam.WINDOW), 2):
        assert any(all(c == "0" or at + k not in bad for k, c in enumerate(m)) for m in decontam.MASKS for at in range(decontam.WINDOW - len(m) + 1))


@pytest.fixture(scope="module")
def cases():
    item = [f"w{k}" for k in range(30)]
    swap = lambda s, *at: [("zz" if k in at else w) for k, w in enumerate(s)]
    docs = [
        (1, "begin " + " ".join(item) + " end"), (2, " ".join(swap(item, 4, 10, 16, 22, 28))), (3, "Nothing here at all, of course, to be seen by anyone."),
        (4, ", ".join(item[8:21]).upper() + "!"), (5, " ".join(swap(item[8:21], 3, 8))), (6, " ".join(swap(item[8:21], 2, 5, 8))), (7, " ".join(item[:9])), (8, " ".join(swap(item, *range(0, 30, 3)))), (9, None), (10, ""),
        (11, "short one two three four five six seven eight tail"), (12, "one two XX four five six seven eight"),
    ]
    return docs, [(0, " ".join(item)), (1, "one two three four five six seven eight"), (2, "tiny item"), (3, None), (4, "")]


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0, "broadcast_ids": 0}])
def test_finds_what_brute_force_finds(spark, cases, limits):
    docs, items = cases
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), **limits).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items) >= {(1, 0), (2, 0), (4, 0), (5, 0), (11, 1), (12, 1)}


def test_no_allowed_substitution_is_lost_at_any_length(spark):
    docs, items, want, d = [], [], set(), 0
    for n in range(1, 14):
        item = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        allowed = n - -(-n * 8 // 10)
        for bad in itertools.chain.from_iterable(itertools.combinations(range(n), k) for k in range(allowed + 2)):
            text = "before it " + " ".join("zz" if k in bad else w for k, w in enumerate(item)) + " after"
            docs.append((d, text))
            if len(bad) <= allowed:
                want.add((d, n))
            d += 1
    for limits in ({}, {"broadcast_rows": 0, "broadcast_ids": 0}):
        got = decontam.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), **limits).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want


def test_rows_are_judged_by_their_own_text(spark):
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(None, f"{'long ' * 3000} {text}"), (None, "clean"), (None, None), (7, text), (7, "clean too"), (8, "x " * 500_000 + text)]
    docs, tests = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(3, text), (3, text), (4, None), (5, "!")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contamination(docs, tests).collect()} == {(None, 3), (7, 3), (8, 3)}
    assert sorted((r.doc_id or 0, r.text or "") for r in decontam.decontaminate(docs, tests).collect()) == [(0, ""), (0, "clean"), (7, "clean too")]


def test_query_on_the_small_tables(spark, sf_dir):
    from latticelu.llm import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    grams = {}
    for k, t in items:
        v = words(t)
        for q in range(len(v) - 3):
            grams.setdefault(tuple(v[q : q + 4]), set()).add(k)
    near = [(d, t) for d, t in docs if any(tuple(words(t)[i : i + 4]) in grams for i in range(len(words(t)) - 3))]
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, sf_dir).collect()}
    assert got and got == brute(near, items)


def test_plan_is_native(spark, sf_dir):
    docs, tests = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plan = decontam.contamination(docs, tests)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text, 5), (1, text, 5), (None, text, 6), (2, "fine", None)], "doc_id bigint, text string, item_id int").withColumnRenamed("item_id", "_bad")
    tests = spark.createDataFrame([(None, text), (3, text)], "item_id bigint, text string")
    got = decontam.contamination(docs, tests).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, None), (1, 3), (None, None), (None, 3)} and len({r.hits for r in got}) == 1
    kept = decontam.decontaminate(docs, tests)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
    assert decontam.decontaminate(docs, tests.limit(0)).count() == 4
    assert decontam.contamination(docs.limit(0), tests).count() == 0
