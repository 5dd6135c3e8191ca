"""Periodic runs, reversible line dedup and whitening beside brute-force versions and DuckDB."""

import math
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from groundledger.llm import line_dedup, periodic_runs, queries, whitening
from groundledger.llm.line_dedup import Cuckoo, LineStore, line_key

SF = "/root/testdata/sf0.001"


def rows_beside_sql(spark, name, tables=("documents",)):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in r.description]
    return sorted(map(repr, r.fetchall())), sorted(repr(tuple(x[c] for c in cols)) for x in queries.QUERIES[name](spark, SF).collect())


# 11
def plain_runs(w, least, exponent):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, exponent * q):
                if not any(q % d == 0 and all(w[k] == w[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                    out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (6, 2), (3, 3)])
def test_runs_equal_a_plain_search(least, exponent):
    rng = random.Random(least * 10 + exponent)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 5)):
            w = []
            while len(w) < rng.randint(0, 50):
                base = [bytes([97 + rng.randrange(rng.choice([1, 2, 3, 9]))]) for _ in range(rng.randint(1, 6))]
                w += (base * rng.choice([1, 1, 2, 4, 5, 9]))[:rng.randint(1, 60)]
            docs.append(w)
        assert periodic_runs.runs_of(docs, least, exponent) == [plain_runs(w, least, exponent) for w in docs]


def test_long_texts_of_one_period():
    words = [b"a", b"b", b"c"] * 30_000
    assert periodic_runs.runs_of([[b"x"] * 90_000, words, [b"x"] * 5], 6, 4) == [[(0, 90_000, 1)], [(0, 90_000, 3)], []]


def test_runs_of_a_table(spark):
    texts = [None, "", " \n\t", "one", "go go go go go go stop", "a b a b a b a b", "x y\x0bx\ty x\ny x y x", "É é É é É é É é", "w " * 20_000,
             "go go go go go go stop"]
    df = spark.createDataFrame([(None if i == 5 else i // 2, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    got = periodic_runs.find_runs(df).collect()
    assert len(got) == len(texts)
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        want = plain_runs(w, 6, 4) if len(w) < 1000 else [(0, len(w), 1)]
        assert [tuple(x) for x in r["runs"]] == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, exponent=1)


def test_runs_query_beside_sql(spark):
    want, got = rows_beside_sql(spark, "op11_periodic_runs")
    assert want == got


# 12
def plain_clean(held, docs, least=20, least_docs=3):
    by = {}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    for d, t in held:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                by.setdefault(key(line), set()).add(d)
    shared = {k: max(x for x in ds if x is not None) for k, ds in by.items() if len(ds) >= least_docs}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if shared.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def documents(rng, ids):
    lines = ["Some header of every page!", "  some HEADER of every page! \t", "short", "", "ÀÉ a line with twenty_", "É" * 19 + "x", "É" * 18 + "x", "line\x0b\x0cwith odd blanks \r"]
    lines += [f"a body line of some length {i}" for i in range(12)]
    return [(d, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for d in ids]


def cleaned(store, df):
    return sorted([tuple(r) for r in store.clean(df).select("doc_id", "n_lines", "n_dropped", "kept").collect()], key=repr)


def test_lines_come_and_go(spark):
    """After insertions and deletions the store answers like one that never held what is gone, whatever its bounds."""
    rng = random.Random(5)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("mine"))
    first, second = documents(rng, range(0, 40)), documents(rng, range(30, 60)) + [(None, "Some header of every page!"), (7, None), (8, "")]
    third = [(0, first[0][1]), *first[:3]]  # repeated rows
    for store in (LineStore(), LineStore(shard_keys=3), LineStore(shard_keys=3, broadcast_bytes=0)):
        one = store.insert(frame(first + third))
        assert cleaned(one, frame(first)) == plain_clean(first, first)
        two = one.insert(frame(second))
        assert cleaned(two, frame(first + second)) == plain_clean(first + second, first + second)
        gone = set(range(0, 60, 2))
        three = two.delete(spark.createDataFrame([(i,) for i in [*gone, 999]], "doc_id long"))
        left = [r for r in first + second if r[0] not in gone]
        assert cleaned(three, frame(left)) == plain_clean(left, left)
        back = three.insert(frame([r for r in first + second if r[0] in gone]))
        assert cleaned(back, frame(first + second)) == plain_clean(first + second, first + second)
        held = {r["key"] for r in back.shared.collect()}
        filters = {r["shard"]: Cuckoo.load(r["cells"]) for r in back.filters.collect()}
        assert all(k in filters[line_dedup._shard(k, back.shards)] for k in held)
        assert sum(sum(map(bool, f.cells)) for f in filters.values()) == len(held)
        assert sum(r["keys"] for r in back.filters.collect()) == len(held)
    alone = three.delete(spark.createDataFrame([(i,) for i in range(60)], "doc_id long"))
    assert cleaned(alone, frame(first)) == plain_clean([], first)


def test_line_store_kept_and_empty(spark, tmp_path):
    rows = documents(random.Random(1), range(30))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    store = LineStore(shard_keys=5).insert(df)
    store.save(str(tmp_path / "store"))
    assert cleaned(LineStore.load(spark, str(tmp_path / "store")), df) == plain_clean(rows, rows)
    none = LineStore().insert(df.limit(0))
    assert none.clean(df.limit(0)).count() == 0 and cleaned(none, df) == plain_clean([], rows)
    assert LineStore().delete(df).references is None


def test_a_line_of_all_documents(spark):
    n = 3000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same long first line\nown line number number "), F.col("id")).alias("text"))
    got = LineStore(broadcast_bytes=0).insert(df).clean(df).agg(F.sum("n_dropped"), F.max(F.when(F.col("n_dropped") == 0, F.col("doc_id"))), F.count("kept")).first()
    assert tuple(got) == (n - 1, n - 1, n)


def test_cuckoo_filter_forgets_what_is_taken_out():
    rng = random.Random(3)
    keys = [rng.randbytes(16) for _ in range(20_000)]
    f = Cuckoo.of(keys[:10_000])
    assert all(k in f for k in keys[:10_000])
    assert sum(k in f for k in keys[10_000:]) < 20
    for k in keys[:5000]:
        f.remove(k)
    assert all(k in f for k in keys[5000:10_000]) and sum(k in f for k in keys[:5000]) < 20
    with pytest.raises(KeyError):
        Cuckoo.of([]).remove(keys[0])
    small = Cuckoo.sized(4)
    before = [k for k in keys if small.add(k)][:8]
    cells = list(small.cells)
    assert not small.add(keys[-1]) and small.cells == cells and all(k in small for k in before)
    assert line_key("  Ünï ".encode() * 3, 13) and line_key("ÜÜÜ".encode(), 4) is None


def test_lines_query_beside_sql(spark):
    want, got = rows_beside_sql(spark, "op12_line_dedup")
    assert want == got


# 13
def exact_polynomial(a):
    """Faddeev-LeVerrier in integers, the constant first."""
    n = len(a)
    c, m = [1], [[0] * n for _ in range(n)]
    for k in range(1, n + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(n)) + (c[-1] if i == j else 0) for j in range(n)] for i in range(n)]
        c.append(-sum(a[i][t] * m[t][i] for i in range(n) for t in range(n)) // k)
    return c[::-1]


def test_polynomial_is_exact(spark):
    rng = random.Random(4)
    for d, top in ((1, 9), (2, 10**6), (5, 10**12), (9, 50)):
        b = [[rng.randint(-top, top) for _ in range(d)] for _ in range(d)]
        a = [[sum(b[i][t] * b[j][t] for t in range(d)) for j in range(d)] for i in range(d)]
        assert whitening.characteristic_polynomial(spark, a) == exact_polynomial(a)
    assert whitening.characteristic_polynomial(spark, [[0, 0], [0, 0]]) == [0, 0, 1]
    assert whitening.characteristic_polynomial(spark, [[0, 0, 5], [0, 0, 0], [5, 0, 0]]) == [0, -25, 0, 1]


def test_roots_are_isolated_and_counted():
    def product(roots):
        p = [1]
        for r in roots:
            p = [(p[i - 1] if i else 0) - r * (p[i] if i < len(p) else 0) for i in range(len(p) + 1)]
        return p

    for roots in ([7, 7, 7, 3], [10**18 + 1, 10**18, 5, 0, 0], [4, 2, 1], [1]):
        found = whitening.largest_roots(product(roots), 4)
        want = [r for r in sorted(roots, reverse=True) if r > 0][:4]
        assert len(found) == len(want)
        for (number, bits), r in zip(found, want):
            assert 0 <= r - Fraction(number, 1 << bits) <= Fraction(r, 2**150)
    assert [whitening.roots_above(product([7, 7, 3]), c, 0) for c in (2, 3, 6, 7)] == [3, 2, 2, 0]


def whiten(spark, vectors, **kw):
    df = spark.createDataFrame([(i, v, 0.5) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, whitened double")
    model, rows = whitening.fit_transform(df, **kw)
    return model, {r["vec_id"]: r for r in rows.collect()}


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) * [3, 2, 1, .5, .4, .3, .2, .1]
    x[100:200] = x[100]  # a third are copies, which teach once
    vectors = [*x.tolist(), None, [], [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8, [1e30] * 8, [1.0, 2.0]]
    model, got = whiten(spark, vectors)
    assert set(got) == set(range(300)) and model.n == 201
    z = np.floor(x * 256)
    fit = np.unique(z, axis=0)
    e, v = np.linalg.eigh(np.cov(fit.T, bias=True))
    for k in range(4):
        assert abs(model.components[k] @ v[:, -1 - k]) == pytest.approx(1, abs=1e-12)
        assert model.values[k] == pytest.approx(e[-1 - k], rel=1e-12) and model.explained[k] == pytest.approx(e[-1 - k] / e.sum(), rel=1e-12)
    w = (z - fit.mean(0)) @ np.array(model.components).T / np.sqrt(model.values)
    assert np.allclose([got[i]["whitened"] for i in range(300)], w, atol=1e-10)
    s = [int(t) for t in fit.sum(0)]
    assert all(got[i]["deviation"] == sum((201 * int(a) - b) ** 2 for a, b in zip(z[i], s)) for i in range(300))
    assert model.identity_error < 1e-10


def test_whitening_of_degenerate_tables(spark):
    model, got = whiten(spark, [[1.0, 2.0]] * 5)
    assert model.n == 1 and all(r["whitened"] == [] and r["deviation"] == 0 for r in got.values()) and len(got) == 5
    model, got = whiten(spark, [])
    assert model.n == 0 and not got
    model, got = whiten(spark, [None, [float("nan")]])
    assert not got
    model, got = whiten(spark, [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]])  # one root twice
    a, b = np.array(model.components)
    assert abs(a @ b) < 1e-14 and a @ a == pytest.approx(1) and model.identity_error < 1e-12
    model, got = whiten(spark, [[float(i), 2.0 * i, 1.0] for i in range(9)])  # on a line
    assert len(model.values) == 1 and model.explained == [1.0]
    model, got = whiten(spark, [[2.0 ** 30, 1.0], [-(2.0 ** 30), 3.0], [5.0, 2.0 ** 29]])  # beyond the sums of doubles
    z = [[2**38, 256], [-(2**38), 768], [1280, 2**37]]
    s = [sum(c) for c in zip(*z)]
    assert [int(got[i]["deviation"]) for i in range(3)] == [sum((3 * a - b) ** 2 for a, b in zip(r, s)) for r in z]


def test_whitening_query(spark):
    rows = queries.op13_whitening(spark, SF).collect()
    data = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert len(rows) == 4 * len(data) and {r["component"] for r in rows} == {1, 2, 3, 4}
    assert all(r["identity_error"] <= 1e-4 and r["n"] == len({tuple(math.floor(256 * c) for c in d["embedding"]) for d in data}) for r in rows)
    assert sorted((r["vec_id"], r["component"]) for r in rows) == sorted((d["vec_id"], k) for d in data for k in (1, 2, 3, 4))
