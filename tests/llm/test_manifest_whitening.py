"""The dataset manifest and the whitening of embeddings, against brute force."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import merkle, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, g string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, [proof of each leaf]) by plain levels; a proof is a list of (place, others)."""
    proofs, where, row = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(row) > 1:
        for k in range(len(leaves)):
            run = row[where[k] // 8 * 8 : where[k] // 8 * 8 + 8]
            proofs[k].append((where[k] % 8, run[: where[k] % 8] + run[where[k] % 8 + 1 :]))
            where[k] //= 8
        row = [h(*row[i : i + 8]) for i in range(0, len(row), 8)]
    return row[0], proofs


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows):
    """The digest columns of every row, as the query has them."""
    leaf = lambda d, t, g, s, n: h(*map(told, (d, s, g, n, t)))
    groups = {}
    for d, t, g, s, n, *_ in rows:
        own = leaf(d, t, g, s, n)
        touched = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t) if t is not None else None
        groups.setdefault(g, []).append((d, own, leaf(d, low, g, s, n) if touched else own))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        made[g] = tree([r[1] for r in groups[g]])
    root, tops = tree([made[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (d, own, shown), proof in zip(groups[g], made[g][1]):
            for at, others in proof + top:
                shown = h(*others[:at], shown, *others[at:])
            out.append((d, own, made[g][0], root, h(*[x for _, others in proof + top for x in others]), shown, shown == root))
    return out


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


def stored(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def documents(counts, seed=3):
    rng, rows = random.Random(seed), []
    for g, n in counts.items():
        rows += [(rng.randrange(10 * n + 1), rng.choice(["Some Text", "plain", "ÄÖ Ünï", "", None]), g, rng.choice(["s", None]), rng.choice([3, None]), "x", "y") for _ in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("counts", [{"en": 1}, {"en": 8}, {"en": 9, "de": 1}, {"en": 700, None: 65, "": 3, "ä": 64, "z": 1}, {f"l{i}": 2 for i in range(20)}])
def test_manifest(spark, tmp_path, counts):
    rows = documents(counts)
    rows += [(None, "A", "en", None, None, "x", "y"), rows[0], rows[0], (7, "w " * 200_000, "en", "s", 1, "x", "y")]
    sf = stored(spark, tmp_path, "documents", rows, DOCS)
    got = merkle.op13_merkle(spark, sf)
    assert sorted_rows(got.collect()) == sorted_rows(brute(rows))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    assert sorted_rows(con.execute(merkle.ORACLE_SQL).fetchall()) == sorted_rows(brute(rows))


def test_manifest_of_several_superblocks(spark):
    """Buckets of eight rows, so that roots are reduced over several rounds."""
    rows = [(i, f"T{i}", "a" if i % 3 else "b", "s", i) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    leaves = df.select("*", merkle.digest(*[merkle.told(F.col(c)) for c in merkle.FIELDS]).alias("leaf"))
    got = merkle.manifest(leaves, "lang", "doc_id", carry=["doc_id"], levels=1).collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root) for r in got) == sorted(r[:4] for r in brute(rows))
    assert all(fold(r) == r.root for r in got)


def fold(r):
    x = r.leaf
    for at, run in zip(r.path, r.siblings, strict=True):
        x = h(run[: at * 64], x, run[at * 64 :])
    return x


def test_manifest_of_nothing(spark, tmp_path):
    sf = stored(spark, tmp_path, "documents", [], DOCS)
    assert merkle.op13_merkle(spark, sf).count() == 0


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_symmetric_qr(d):
    rng = np.random.default_rng(d)
    for a in (rng.normal(size=(d, 2 * d)), rng.normal(size=(d, max(1, d // 2))), np.diag(rng.integers(0, 3, d)).astype(float), np.zeros((d, d)), rng.normal(size=(d, d)) * 1e15):
        a = a @ a.T
        values, vectors = whitening.symmetric_qr(a)
        size = max(np.abs(a).max(), 1e-300)
        assert np.allclose(values / size, np.linalg.eigvalsh(a)[::-1] / size, atol=1e-13 * d)
        assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13) and np.allclose(a @ vectors / size, vectors * values / size, atol=1e-13 * d)


def test_moments_in_parts_are_those_of_the_whole():
    rng = np.random.default_rng(0)
    x = rng.integers(-(1 << 40), 1 << 40, (500, 5))
    parts = []
    for rows in np.split(x, [1, 2, 90, 91, 400]):
        m = whitening.Moments.of(5)
        for at in range(0, len(rows), 37):
            m.take(rows[at : at + 37])
        parts.append(whitening.Moments.read(m.row(0)))
    for m in parts[1:]:
        parts[0].merge(m)
    assert parts[0].total() == [int(s) for s in x.astype(object).sum(axis=0)] and parts[0].n == 500
    assert np.allclose(parts[0].covariance(), np.cov(x.T.astype(float), bias=True), rtol=1e-12)
    one = whitening.Moments.of(2)
    one.take(np.array([[(1 << 63) - 1, -(1 << 63)]] * 3, dtype=np.int64))
    assert one.total() == [3 * ((1 << 63) - 1), -3 * (1 << 63)]


EMBEDDINGS = "vec_id long, embedding array<float>, component string, size string"


def test_whitening(spark, tmp_path):
    rng = np.random.default_rng(5)
    basis = rng.normal(size=(6, 6))
    own = (rng.normal(size=(90, 6)) @ basis).astype(np.float32)
    rows = [(i, own[i % 90].tolist(), "c", "s") for i in range(120)]
    rows += [(1000 + i, own[3].tolist(), "c", "s") for i in range(60)]  # copies of one vector
    rows += [(500, None, "c", "s"), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0], "c", "s"), (502, [math.nan] * 6, "c", "s"), (503, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0], "c", "s"), (504, [], "c", "s"), (None, own[1].tolist(), "c", "s")]
    rows += [(600 + i, [float(i), 2.0 * i], "c", "s") for i in range(9)]  # a space of its own, of rank one
    sf = stored(spark, tmp_path, "embeddings", rows, EMBEDDINGS)
    got = whitening.op12_whitening(spark, sf).collect()
    x = np.floor(256 * np.unique(own, axis=0).astype(np.float64)).astype(np.int64)
    x = np.unique(x, axis=0)
    n, total = len(x), x.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    six = [r for r in got if not (r.vec_id is not None and 600 <= r.vec_id < 700)]
    assert len(six) == 4 * 181 and {r.n for r in six} == {n} and not {500, 501, 502, 503, 504} & {r.vec_id for r in got}
    sign = {}
    for r in six:
        e = own[1 if r.vec_id is None else 3 if r.vec_id >= 1000 else r.vec_id % 90]
        v = np.floor(256 * e.astype(np.float64)).astype(np.int64)
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, total))
        want = float((v - total / n) @ vectors[:, r.component - 1] / math.sqrt(values[r.component - 1]))
        sign.setdefault(r.component, math.copysign(1, want * r.whitened))
        assert r.whitened == pytest.approx(sign[r.component] * want, abs=1e-9)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    line = [r for r in got if r.vec_id is not None and 600 <= r.vec_id < 700]
    assert len(line) == 18 and all((r.whitened is None) == (r.component == 2) and r.n == 9 for r in line)


def test_whitening_of_little(spark, tmp_path):
    sf = stored(spark, tmp_path / "none", "embeddings", [], EMBEDDINGS)
    assert whitening.op12_whitening(spark, sf).count() == 0
    sf = stored(spark, tmp_path / "one", "embeddings", [(1, [0.5, -0.5], "c", "s")] * 3, EMBEDDINGS)
    got = whitening.op12_whitening(spark, sf).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, None, None)] * 6
    sf = stored(spark, tmp_path / "far", "embeddings", [(1, [3e38, 1.0], "c", "s"), (2, [-3e38, 2.0], "c", "s")], EMBEDDINGS)
    assert {r.deviation for r in whitening.op12_whitening(spark, sf).collect()} == {None}


def test_whiten_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, [1, 5], "a"), (2, [2, 9], "b"), (3, [4, 4], "c"), (4, [1, 2, 3], "d")], "id long, x array<bigint>, whitened string")
    spaces, _ = whitening.fit(df.filter("size(x) = 2"))
    got = whitening.whiten(df, spaces)
    assert got.columns == ["id", "x", "whitened", "deviation"]
    rows = {r.id: r for r in got.collect()}
    assert rows[4].whitened is None and rows[4].deviation is None and len(rows[1].whitened) == 2
    assert sum(rows[i].whitened[0] ** 2 for i in (1, 2, 3)) == pytest.approx(3)
