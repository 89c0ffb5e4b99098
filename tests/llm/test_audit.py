import random
import re
from itertools import permutations

from terrane.llm.audit import FailingIds, filter_audit, judged_rows, prefixes_of, row_failures, taken
from tests.llm.data import SCHEMA, empty, frame

LETTERS = "ABCDE"


def _fails(rows):
    """(part, failing letters, doc_id) of (doc_id, text, source) rows."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t, source in rows:
        t = t or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        f = set()
        if len(words) < 50:
            f.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            f.add("C")
        if re.search("[#$%&*|]", t):
            f.add("D")
        if t in first and (i is None or i > first[t]):
            f.add("E")
        out.append((source or "", f, i))
    return out


def _brute(rows, good, toxic):
    rows = _fails(rows)
    out = {}
    for part in {p for p, _, _ in rows}:
        own = [(f, i) for p, f, i in rows if p == part]
        shapley = dict.fromkeys(LETTERS, 0)
        for order in permutations(LETTERS):
            left = own
            for step, x in enumerate(order):
                gone = [(f, i) for f, i in left if x in f]
                left = [(f, i) for f, i in left if x not in f]
                shapley[x] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(left), len(gone), sum(x in f for f, _ in own) - len(gone), sum(f == {x} for f, _ in own),
                    sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _got(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in df.collect()}


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, source string, id long, tag string")


def test_against_brute_force(spark):
    rnd = random.Random(5)
    extra = [(900 + k, rnd.choice(["A B C $ ", "x " * 60, "Q" * 9, "a#b " * 70, " ".join(f"v{j}" for j in range(60))]),
              None, rnd.choice([None, "", "s", "web"]), None, 1, 2, 3, 0.5, "e", "d", 7) for k in range(60)]
    docs = frame(spark).unionByName(spark.createDataFrame(extra, SCHEMA)).repartition(4)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    ids = sorted({i for i, _, _ in rows if i is not None})
    good, toxic = set(ids[::3]), set(ids[::7])
    marks = [(i, int(i in good), int(i in toxic), "s", 1, "A") for i in ids[::1] if i in good | toxic]
    marks += [marks[0], marks[1], (None, 1, 1, "s", 1, "A"), (ids[1], None, None, "s", 1, "A"), (7_000, 1, 1, "s", 1, "A")]
    got = filter_audit(docs, _labels(spark, marks))
    assert _got(got) == _brute(rows, good, toxic)
    assert got.count() == 600 * len({s or "" for _, _, s in rows})


def test_nothing_fails_and_empty(spark):
    clean = [(k, " ".join(f"v{k}x{j}" for j in range(60)), None, "s", None, 1, 2, 3, 0.5, "e", "d", 7) for k in range(5)]
    got = _got(filter_audit(spark.createDataFrame(clean, SCHEMA), _labels(spark, [])))
    assert len(got) == 600 and {tuple(v) for v in got.values()} == {(5, 0, 0, 0, 0, 0, 0)}
    assert filter_audit(empty(spark), _labels(spark, [])).count() == 0


def test_relations_join_without_a_shuffle(spark):
    """The joins between the relations read their buckets; the only exchange
    is the one of the final counts, and the names leave the session."""
    conditions = row_failures()
    ids = FailingIds(judged_rows(frame(spark), _labels(spark, []), conditions), LETTERS)
    try:
        joins = 0
        for prefix in prefixes_of(LETTERS):
            plan = taken(ids, [prefix])._jdf.queryExecution().executedPlan().toString()
            joins += plan.count("SortMergeJoin")
            assert "BroadcastHashJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
        assert joins == 80
        n = ids.of("A").count()
        assert n == taken(ids, [""]).filter("tag = 'A'").agg({"n": "sum"}).first()[0]
    finally:
        ids.close()
    assert not any(t.name in ids.names for t in spark.catalog.listTables())
