import random
import re
from collections import defaultdict

from terrane.llm.components import connected_components
from terrane.llm.exact import drop_exact_copies
from terrane.llm.ngram_join import drop_near_copies, near_copy_components
from terrane.session import shared_dir
from tests.llm.data import empty, frame


def _brute(docs):
    """(number of shingles, component) by row; rows are (id, text)."""
    sets = []
    for _, t in docs:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[j:j + 5]) for j in range(len(w) - 4)]))
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in holders[g]:
                shared[j] += 1
            holders[g].append(i)
        for j, c in shared.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)].append(k)
    return sorted(str((docs[i][0], len(sets[i]), min(least[find(i)], default=None))) for i in range(len(docs)))


def _agree(df, **settings):
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in near_copy_components(df, **settings).collect())
    assert got == _brute([(r.doc_id, r.text) for r in df.collect()])


def _families(n=300, seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 90))] for _ in range(15)]
    rows = []
    for i in range(n):
        b = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            j = rnd.randrange(len(b)) if b else 0
            if rnd.random() < 0.5 and b:
                b[j] = rnd.choice(words)
            else:
                b.insert(j, rnd.choice(words))
        rows.append((i, " ".join(b) if i % 50 else None))
    return rows


def test_families_of_near_copies(spark):
    df = spark.createDataFrame(_families(), "doc_id long, text string").repartition(5)
    _agree(df)
    _agree(df, hot=3)                       # tokens over the bound go by rows


def test_hard_rows(spark):
    docs = frame(spark)
    _agree(docs)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert near_copy_components(empty(spark)).count() == 0 and drop_near_copies(empty(spark)).count() == 0


def test_rows_that_share_an_id(spark):
    text = lambda seed: " ".join(f"{seed}{i}" for i in range(60))
    near = lambda seed, at: " ".join(f"{seed}{i}" if i != at else "other" for i in range(60))
    rows = [(1, text("a")), (5, near("a", 0)), (5, text("b")), (None, near("a", 59)),
            (7, text("c")), (7, near("c", 0)), (7, near("c", 59)), (9, near("c", 0)),
            (None, text("d")), (None, near("d", 0)), (5, None), (5, ""), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, (r.text or "").split()[1:2]) for r in drop_near_copies(docs).collect()), key=str)
    assert got == sorted([(1, ["a1"]), (5, ["b1"]), (7, ["c1"]), (None, ["d1"]),
                          (5, []), (5, []), (None, [])], key=str)


def test_stored_rows_need_no_copy(spark):
    """Rows of stored files are told apart by their place; what stays in the
    shared folder are the numbers of the dropped rows."""
    import os
    folder = shared_dir(spark, "docs")
    frame(spark).write.parquet(folder)
    docs = spark.read.parquet(folder)
    base = os.path.dirname(folder)
    before = set(os.listdir(base))
    near, exact = drop_near_copies(docs), drop_exact_copies(docs)
    made = sorted(x.rpartition("-")[0] for x in set(os.listdir(base)) - before)   # named name-1a2b3c
    assert made == ["copies", "near-copies"]
    key = lambda r: (str(r.doc_id), r.text or "")
    stored = spark.createDataFrame(docs.collect(), docs.schema)
    assert len(near.collect()) == len(drop_near_copies(stored).collect())
    texts = sorted(key(r) for r in exact.collect())
    assert [t for _, t in texts] == [t for _, t in sorted(key(r) for r in drop_exact_copies(stored).collect())]


def test_components(spark):
    rnd = random.Random(1)
    path = list(range(300))
    rnd.shuffle(path)
    links = [(a, b) for a, b in zip(path, path[1:]) if rnd.random() < 0.95]
    links += [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {x: x for l in links for x in l}
    for _ in range(400):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: up[x] for x in linked}
