"""Quality rules, sharding, near duplicates, decontamination, language model and pipeline, against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, language_model, near_duplicates, quality, sharding
from tallyspark.llm.common import checkpoint

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def corpus(n=120, seed=7):
    """Documents with copies, near copies, shared lines, nulls, empty and long texts."""
    rng = random.Random(seed)
    words = [a + b + c for a in ("ba", "lo", "mi", "ter", "sho") for b in ("nu", "re", "ka") for c in ("sta", "do", "ki", "m")]
    texts = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 60, 90, 200]))]
        if texts and i % 5 == 0:
            base = (rng.choice(texts) or "x").split()
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
        text = " ".join(base)
        texts.append(text.replace(" ba", "\nba") + ("\nshared line of the site" if i % 3 == 0 else ""))
    texts += ["", None, "   \n ", "A", "a", "one two three one two three one two three", "w " * 5000, texts[0], texts[0], texts[7].upper()]
    return [(i, t, ["s0", "s0", "s1", None][i % 4], "en", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def words_of(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def test_base_rules(docs):
    want = {r[0]: r for r in corpus()}
    for r in quality.judge(docs).collect():
        text = want[r.doc_id][1] or ""
        w = words_of(text)
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_frequent_lines_deplete(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):  # 40 documents of one line that all share, and a few words of their own
        rows.append((i, "boiler " * 60 + "\n" + " ".join(f"w{rng.random()}" for _ in range(20)), "h", "en", 0))
    for i in range(40, 80):  # the shared line is a small part
        rows.append((i, "boiler " * 60 + "\n" + " ".join(f"w{rng.random()}" for _ in range(90)), "h", "en", 0))
    same = " ".join(f"v{i}" for i in range(70))
    rows += [(i, same, "h", "en", 0) for i in range(80, 140)]  # copies of one text are one document
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[i].kept for i in range(40)) and all(got[i].removed_words == 60 for i in range(80))
    assert all(got[i].removed_words == 0 for i in range(80, 140)) and got[100].kept
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_kept_documents_lose_their_frequent_lines(spark):
    """Lines above the limit go from the text, whatever their digits and blanks; other lines and empty ones stay as they are."""
    rng = random.Random(4)
    own = [" ".join(f"p{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(40)]
    rows = [(i, f"Site menu {i + 10}\n\n{t}\n  SITE   menu 77", "h", "en", 0) for i, t in enumerate(own)] + [(100, own[0], "h", "en", 0), (101, None, "h", "en", 0)]
    got = {r.doc_id: r.text for r in quality.kept(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"\n{t}" for i, t in enumerate(own)} | {100: own[0]}


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(2)
    rows = [(i, "same text" if i % 3 == 0 else "x" * rng.randint(0, 400)) for i in range(4000)] + [(None, None), (None, None), (5, "é"), (5, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    slim = checkpoint(sharding.keyed(df).drop("text"))
    for a_range in (10**6, 40):
        got = sharding.assign(slim, slim.select("size", "key_h", "key_d", "key_r"), rows_a_part=a_range).toPandas()
        assert len(got) == len(rows) and set(got["shard"]) == set(range(16)) and set(got["law"]) == {"bytes"}
        sums = got.groupby("shard")["size"].sum()
        same = got[got["text_crc32"] == zlib.crc32(b"same text")]
        assert same["shard"].nunique() == 1 and same["size"].sum() > sums.mean() / 4
        assert sums.max() - sums.min() <= 2 * 402 + 0.004 * sums.mean()
        assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard")["slot"])
    one = got[got["doc_id"] == 5]
    assert {zlib.crc32("é".encode())} <= set(one["text_crc32"]) and got["size"].min() == 1
    empty = sharding.keyed(df.limit(0)).drop("text")
    assert sharding.assign(empty, empty.select("size", "key_h", "key_d", "key_r")).count() == 0


def test_shards_cut_a_hot_repeated_row(spark):
    """Rows equal in text and doc_id that fill half of all bytes; columns of clashing names."""
    rows = [(7, "the very same row " * 5)] * 3000 + [(i, "other row " * (i % 19)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit("x") for k in ("slot", "shard", "part_", "law")})
    slim = checkpoint(sharding.keyed(df).drop("text"))
    for parts in (10**6, 50):
        got = sharding.assign(slim, slim.select("size", "key_h", "key_d", "key_r"), rows_a_part=parts).toPandas()
        sums = got.groupby("shard")["size"].sum()
        assert len(got) == 6000 and sums.max() - sums.min() <= 400 and all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard")["slot"])
        others = got[got["doc_id"] != 7]
        assert (others.groupby("text_crc32")["shard"].nunique() == 1).all()  # only the group that is larger than a shard is cut


def test_splitters_equal_a_sort(spark):
    """Each boundary against the sorted table: no other boundary is nearer to its target by more than the tolerance."""
    rng = random.Random(3)
    df = spark.createDataFrame([(i, "y" * rng.randint(0, 900)) for i in range(2000)], "doc_id long, text string")
    keys = checkpoint(sharding.keyed(df).select("size", "key_h", "key_d", "key_r"))
    found, n = sharding.splitters(keys, 16, 0.001)
    rows = sorted((sharding.packed(r.key_h, r.key_d, r.key_r), r["size"]) for r in keys.collect())
    total = sum(s for _, s in rows)
    sums = np.concatenate([[0], np.cumsum([s for _, s in rows])])
    assert n == 2000
    hashes = [k // sharding.SPAN // sharding.SPAN for k, _ in rows]
    borders = np.array([sums[i] for i in range(len(rows) + 1) if i in (0, len(rows)) or hashes[i - 1] != hashes[i]])
    for j, (boundary, below, before) in enumerate(found, start=1):
        at = sum(k < boundary for k, _ in rows)
        assert (below, before) == (sums[at], at) and below in borders
        assert abs(below - total * j / 16) <= max(0.001 * total / 16, np.abs(borders - total * j / 16).min()) + 1e-6


@pytest.mark.parametrize(("seed", "n", "copies"), [(0, 400, 5), (1, 3000, 40), (2, 3000, 2), (3, 60, 3)])
def test_no_group_under_a_shards_size_is_split(spark, seed, n, copies):
    rng = random.Random(seed)
    texts = [f"{i} " * rng.randint(1, 60) for i in range(n // copies)]
    df = spark.createDataFrame([(f"id {i}" if i % 7 == 0 else str(i), rng.choice(texts)) for i in range(n)], "doc_id string, text string")
    slim = checkpoint(sharding.keyed(df).drop("text"))
    got = sharding.assign(slim, slim.select("size", "key_h", "key_d", "key_r")).toPandas()
    assert len(got) == n and got["size"].sum() == slim.agg(F.sum("size")).first()[0]
    groups = got.groupby("text_crc32").agg(size=("size", "sum"), shards=("shard", "nunique"))
    assert (groups["shards"][groups["size"] <= got["size"].sum() / 16] == 1).all()
    sums = got.groupby("shard")["size"].sum().reindex(range(16), fill_value=0)
    assert sums.max() - sums.min() <= max(sums.mean() / 32 + 400, groups["size"].max() if n < 100 else 0) * 1.01
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard")["slot"])


def shingle_set(t):
    w = words_of((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(rows):
    sets, texts = [shingle_set(r[1]) for r in rows], [" ".join(words_of((r[1] or "").lower())) for r in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if texts[i] == texts[j] or (k and k >= 0.8 * (len(sets[i]) + len(sets[j]) - k) - 1e-9):
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {rows[i][0]: (n[i], rows[find(i)][0]) for i in range(len(rows))}


def test_near_duplicates_equal_brute_force(docs):
    want = brute_links(corpus())
    got = near_duplicates.verified(docs).collect()
    assert {r.doc_id: (r.n_links, r.class_id) for r in got} == want and len(got) == len(want)


def test_near_duplicates_across_cells(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(150)] = f"z{rng.randint(0, 9)}"
        rows.append((i, " ".join(w), "s", "en", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_links(rows)
    assert {r.doc_id: (r.n_links, r.class_id) for r in near_duplicates.verified(df).collect()} == want
    pairs = near_duplicates.linked_pairs(df).collect()
    assert len(pairs) > 0 and all(r.jaccard >= 0.8 - 1e-9 and r.rep_a < r.rep_b for r in pairs) and len({(r.rep_a, r.rep_b) for r in pairs}) == len(pairs)


def chain(n, seed=3):
    """Texts of 60 words, each with 75 % of the one before: one component of candidates as long as the table, with links here and there."""
    rng = random.Random(seed)
    w, rows = [f"c{rng.randint(0, 10**9)}" for _ in range(60)], []
    for i in range(n):
        w = w[rng.choice([2, 8, 8]) :]
        w = w + [f"c{rng.randint(0, 10**9)}" for _ in range(60 - len(w))]
        rows.append((i, " ".join(w), "s", "en", 0))
    return rows


def test_work_of_a_text_does_not_grow_with_its_component(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    work = []
    for n in (200, 400):
        rows = chain(n)
        df = spark.createDataFrame(rows, SCHEMA)
        classes = near_duplicates.classes_of(checkpoint(near_duplicates.signatures(df, *near_duplicates.choose_bands())))
        cells, several = near_duplicates.cells_of(df, classes)
        sizes = [r["count"] for r in cells.groupBy(*near_duplicates.CELL).count().collect()]
        work.append(sum(x * x for x in sizes) / n)
        assert several and {r.doc_id: (r.n_links, r.class_id) for r in near_duplicates.verified(df).collect()} == brute_links(rows)
    assert work[1] < 1.3 * work[0]


def test_a_pair_is_counted_in_its_first_bucket(spark, monkeypatch):
    """Near copies that share most of their buckets, in components of several cells and in small ones, each link once."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    rows = chain(60) + [(1000 + i, " ".join([*(f"g{i % 3}w{j}" for j in range(80)), f"e{i}"]), "s", "en", 0) for i in range(40)]
    got = near_duplicates.linked_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len({(r.rep_a, r.rep_b) for r in got}) == sum(n for n, _ in brute_links(rows).values()) // 2


def test_one_of_each_keeps_columns_of_any_name(spark):
    names = ["id_", "raw_", "text_id_", "key", "raw", "doc", "stays", "n"]
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (3, "c")], "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    got = near_duplicates.one_of_each(df).collect()
    assert sorted(r.doc_id for r in got) == [1, 3] and all(r[n] == n for r in got for n in names)
    words = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert sorted(r.doc_id for r in near_duplicates.one_of_each(words).collect()) == ["d1", "d3"]


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "s", "e", 0), (1, "a", "s", "e", 1), (1, "a", "s", "e", 1)]
    got = near_duplicates.verified(spark.createDataFrame(rows, SCHEMA).withColumn("class_id", F.lit("clash"))).collect()
    assert len(got) == 4 and sorted(r.n_links for r in got) == [1, 1, 1, 1]
    assert near_duplicates.verified(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_duplicates_without_or_with_equal_ids(spark):
    """Rows are told apart by their texts: near copies without ids are linked, different texts of one id are not; one row of each class stays."""
    rng = random.Random(11)
    base = [[f"u{rng.randint(0, 9999)}" for _ in range(100)] for _ in range(4)]
    near = [" ".join([*b[:50], "changed", *b[51:]]) for b in base]
    text = [" ".join(b) for b in base]
    rows = [(None, text[0]), (None, near[0]), (7, text[1]), (7, text[2]), (8, near[2]), (9, text[3]), (9, text[3]), (None, "alone here"), (None, None), (10, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"raw": F.lit(1), "sig_a": F.lit(2), "n": F.lit(3)})
    got = collections.Counter((r.doc_id, r.class_id if r.class_id >= 0 else None, r.n_links) for r in near_duplicates.verified(df).collect())
    assert got == collections.Counter([(None, None, 1), (None, None, 1), (7, 7, 0), (7, 7, 1), (8, 7, 1), (9, 9, 1), (9, 9, 1), (None, None, 0), (None, 10, 1), (10, 10, 1)])
    one = near_duplicates.one_of_each(df).collect()
    assert collections.Counter(r.text for r in one if r.doc_id is not None) == collections.Counter([text[1], text[2], text[3], ""])
    assert sorted(r.text for r in one if r.doc_id is None) == sorted([min(text[0], near[0], key=lambda t: [r.text for r in one].count(t) * -1), "alone here"])
    assert all(r.n == 3 for r in one) and near_duplicates.one_of_each(df.limit(0)).count() == 0


def test_components_of_hubs_and_chains(spark, monkeypatch):
    """Against a walk over the graph; nodes of many edges are joined apart."""
    monkeypatch.setattr(near_duplicates, "HUBS", 2)
    monkeypatch.setattr(near_duplicates, "APART", 100)
    rng = random.Random(13)
    edges = [(1, i) for i in range(2, 1500)] + [(5000 + i, 5001 + i) for i in range(60)] + [(rng.randint(6000, 6400), rng.randint(6000, 6400)) for _ in range(150)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.id: r.root for r in near_duplicates.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_bands_reach_the_recall():
    bands, rows = near_duplicates.choose_bands(0.8, 0.9995, 100)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 100


def benchmark_rows(n=30):
    rng = random.Random(4)
    return [(i, " ".join(f"q{rng.randint(0, 400)}" if rng.random() < 0.5 else rng.choice(["the", "of", "and"]) for _ in range(40)) + ". So the answer is " + f"q{i} q{i + 1} q{i + 2}.") for i in range(n)]


def test_leaks_and_paraphrases_are_found(spark):
    rng = random.Random(5)
    bench = benchmark_rows()
    filler = [f"f{i}" for i in range(500)] + ["the", "of", "and"] * 60
    rows, want = [], set()
    for d in range(200):
        w = [rng.choice(filler) for _ in range(rng.choice([0, 30, 300]))]
        if d % 4 == 0:
            i, text = rng.choice(bench)
            b = [x for x in text.split() if rng.random() > 0.1] if d % 8 else text.split()
            at = rng.randrange(len(w) + 1)
            w = w[:at] + b + w[at:]
            want.add((d, i))
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, spark.createDataFrame(bench + [(99, None), (98, "")], "item_id long, text string")).collect()}
    assert len(got & want) >= 0.95 * len(want) and {d for d, _ in got} <= {d for d, _ in want}
    assert decontaminate.leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.leaks(df.limit(0), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


def test_leaks_of_a_large_benchmark(spark):
    """Thousands of items, many more than the latent space has dimensions, against all planted copies."""
    rng = random.Random(8)
    draw = lambda n: " ".join(f"w{int(rng.paretovariate(0.7))%6000}" for _ in range(n))
    bench = [(i, draw(rng.randint(15, 60))) for i in range(4000)]
    rows, want = [], set()
    for d in range(200):
        w = draw(rng.choice([0, 40, 200])).split()
        if d % 2:
            i, text = rng.choice(bench)
            at = rng.randrange(len(w) + 1)
            w = w[:at] + text.split() + w[at:]
            want.add((d, i))
        rows.append((d, " ".join(w)))
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert want <= {(r.doc_id, r.item_id) for r in found if r.lcs == 1.0}
    texts, items = dict(rows), dict(bench)
    for r in found:
        item, span = decontaminate.clean(items[r.item_id]), decontaminate.clean(texts[r.doc_id])[r.first_word : r.last_word]
        assert r.lcs == decontaminate.lcs(decontaminate.masks(item), len(item), span) / len(item) >= 0.6


def test_leaks_recall_against_exhaustive_search(spark):
    """Verbatim and altered items of 15 to 2,000 words: nearly all that an exhaustive longest common subsequence finds, and nothing else."""
    rng = random.Random(21)
    draw = lambda n: [f"k{int(rng.paretovariate(0.8)) % 3000}" for _ in range(n)]
    bench = [(i, " ".join(draw(rng.choice([15, 25, 40, 60, 300, 2000]) if i else 2000))) for i in range(150)]
    rows = []
    for d in range(300):
        w = draw(rng.choice([0, 40, 200]))
        if d % 2:
            own = rng.choice(bench)[1].split()
            own = [x if rng.random() > 0.12 else f"new{rng.randint(0, 99)}" for x in own if rng.random() > 0.08] if d % 4 == 1 else own
            at = rng.randrange(len(w) + 1)
            w = w[:at] + own + w[at:]
        rows.append((d, " ".join(w)))
    rows.append(rows[1])
    want = set()
    for d, text in rows:
        words = decontaminate.clean(text)
        for i, item in bench:
            own, answer = decontaminate.clean(item), decontaminate.answer_of(item)
            size = len(own)
            for at in range(0, max(1, len(words) - size // 2), max(1, size // 4)):
                near = words[at : at + size + size // 4]
                if len(set(own) & set(near)) >= 0.3 * len(set(own)) and decontaminate.lcs(decontaminate.masks(own), size, near) >= 0.6 * size and decontaminate.lcs(decontaminate.masks(answer), len(answer), near) >= 0.4 * len(answer):
                    want.add((d, i))
                    break
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(want) > 120 and len(got & want) >= 0.95 * len(want)
    assert all(r.lcs >= 0.6 and r.answer_lcs >= 0.4 for r in found) and sum(r.doc_id == 1 for r in found) % 2 == 0


def test_leaks_of_long_items(spark):
    """Items over the 128 words of the smallest window, verbatim and altered, wherever they begin."""
    rng = random.Random(9)
    bench = [(i, " ".join(f"v{rng.randint(0, 3000)}" for _ in range(n))) for i, n in enumerate((20, 76, 77, 150, 214, 500, 1500))]
    rows, want = [], set()
    for d in range(42):
        i, text = bench[d % len(bench)]
        b = [x for x in text.split() if d % 2 or rng.random() > 0.2]
        rows.append((d, " ".join([f"g{rng.randint(0, 99)}" for _ in range(rng.randint(0, 300))] + b + ["g1"] * rng.randint(0, 90))))
        want.add((d, i))
    rows += [(100 + d, " ".join(f"g{rng.randint(0, 99)}" for _ in range(300))) for d in range(10)]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want


def dense_space(texts, bench, latent):
    """The items in the latent space of all passages of all texts, by dense matrices."""
    place = {w: k for k, w in enumerate(sorted({w for _, text in bench for w in text.split()}))}
    bag = lambda words: np.bincount([place[w] for w in words if w in place], minlength=len(place))
    texts = [text.split() for text in texts]
    weight = np.log((len(texts) + len(bench) + 1) / (sum(bag(set(t)) for t in texts) + 1))
    dense = lambda bags: (m := np.array(bags)) * weight / np.sqrt(np.maximum(m @ weight**2, 1e-9))[:, None]
    corpus, items = dense([bag(t[at : at + 64]) for t in texts for at in range(0, len(t), 32)]), dense([bag(text.split()) for _, text in bench])
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(len(place), min(len(place), latent + decontaminate.EXTRA))))[0]
    for k in range(2):
        mine, others = items.T @ (items @ block), corpus.T @ (corpus @ block)
        share = share if k else 0.1 * np.linalg.norm(mine) / np.linalg.norm(others)
        q, r = np.linalg.qr(mine + share * others)
        block = q @ np.linalg.svd(r)[0]
    return items @ block[:, :latent]


def test_leaks_space_is_fitted_on_every_passage_of_every_document(spark, monkeypatch):
    """Cosines in a space of few dimensions, against a dense matrix of all passages of 4,500 documents."""
    rng = random.Random(13)
    draw = lambda n: [f"m{int(rng.paretovariate(0.6)) % 70}" for _ in range(n)]
    bench = [(i, " ".join([*draw(18), f"only{i}"])) for i in range(12)]
    rows = [(d, " ".join(draw(rng.choice([0, 10, 50, 150])))) for d in range(4488)] + [(5000 + i, text) for i, text in bench]
    want = np.linalg.norm(dense_space([text for _, text in rows], bench, 4), axis=1)
    monkeypatch.setattr(decontaminate, "COMMON", 20)
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string"), latent=4).collect()
    got = {r.item_id: r.cosine for r in found if r.doc_id == 5000 + r.item_id}
    assert [got[i] for i, _ in bench] == pytest.approx(want.tolist(), abs=1e-3)


def test_pipeline_fits_the_space_of_its_leaks_on_all_documents_left(spark, monkeypatch, tmp_path):
    """The stage's own space, without ids, against a dense matrix of all passages of 4,500 documents."""
    import corpus_pipeline

    rng = random.Random(17)
    draw = lambda n: [f"p{int(rng.paretovariate(0.4)) % 400}" for _ in range(n)]
    bench = [(i, " ".join(draw(25))) for i in range(60)]
    texts, fitted, search = [" ".join(draw(rng.choice([0, 10, 50, 150]))) for _ in range(4500)], [], decontaminate.search
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(decontaminate, "search", lambda docs, items, *rest: (fitted.append(items), search(docs, items, *rest))[1])
    docs = spark.createDataFrame([(None, t) for t in texts] + [(1, bench[0][1])], "doc_id long, text string")
    left = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert left.filter("doc_id = 1").count() == 0 and left.count() > 0
    want = dense_space([*texts, bench[0][1]], bench, decontaminate.LATENT)
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    (items,) = fitted
    assert len(items.vocabulary) > decontaminate.LATENT + decontaminate.EXTRA
    assert np.allclose(items.latent @ items.latent.T, want @ want.T, atol=2e-3)


def test_leaks_words_and_passages_have_their_transposes(monkeypatch):
    """Sums by stride and passage against the transposed sums, with tables and slices that end inside texts."""
    monkeypatch.setattr(decontaminate, "STRIDES", 3)
    rng = np.random.default_rng(3)
    first = np.array([0, 0, 1, 6, 6, 8, 8])
    numbers, words = np.sort(rng.integers(0, 8, 90)), rng.integers(0, 30, 90)
    common, rows, vectors = np.array([2, 3, 17]), rng.normal(size=(30, 5)), rng.normal(size=(8, 5))
    held = np.zeros((8, 30))
    np.add.at(held, (numbers, words), 1)
    both = np.eye(8) + np.diag([0, 1, 1, 1, 1, 0, 1], 1)
    assert np.allclose(decontaminate.passages(decontaminate.stride_vectors(rows, common, words, numbers, 8), first), both @ held @ rows, atol=1e-4)
    out = np.zeros((30, 5))
    decontaminate.add_to_words(out, decontaminate.of_passages(vectors, first), common, words, numbers)
    assert np.allclose(out, (both @ held).T @ vectors)


def test_bit_parallel_lcs():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(decontaminate.masks(a), len(a), b) == t[-1][-1]


def test_language_model_counts_and_scores(docs, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(language_model, "PART_BYTES", 9_000)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {r[0]: words_of((r[1] or "").translate(lower)) + ["</s>"] for r in corpus()}
    train = collections.Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    got = language_model.model_score(docs).collect()
    assert len(got) == len(tokens)
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6) and r.score < 0
    assert sum(r.score for r in held) > sum(r.base_score for r in held) - 1.0


def test_language_model_scores_equal_brute_force(docs, monkeypatch):
    """The mixture fitted by EM on exact held-out counts, and every score; probabilities of all words after a context sum to one."""
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(language_model, "PART_BYTES", 9_000)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(zlib.crc32(str(r[0]).encode()) % 7, words_of((r[1] or "").translate(lower)) + ["</s>"]) for r in corpus()]

    def counts(folds):
        word, pair = collections.Counter(), collections.Counter()
        for fold, ws in rows:
            if fold in folds:
                word.update([*ws, "<s>"])
                pair.update(zip(["<s>", *ws], ws))
        return word, pair

    training = {0, 1, 3, 4, 5, 6}
    word, pair = counts(training)
    word_less, pair_less = counts(training - {3})
    n, v, n_less = (sum(c for w, c in x.items() if w != "<s>") for x in (word, dict.fromkeys(word, 1), word_less))
    bucket = lambda c: min(math.ceil(math.log2(c + 1)), language_model.BUCKETS - 1)
    held = [(bucket(word_less[a]), pair_less[a, b] / max(1, word_less[a]), word_less[b] / n_less, 1 / (v + 1)) for fold, ws in rows if fold == 3 for a, b in zip(["<s>", *ws], ws)]
    mixed = np.full((language_model.BUCKETS, 3), 1 / 3)
    for _ in range(language_model.ROUNDS):
        new = np.full(mixed.shape, 0.1)
        for k, *p in held:
            new[k] += mixed[k] * p / (mixed[k] @ p)
        mixed = new / new.sum(axis=1, keepdims=True)
    mixed[0] = [0, mixed[0, 0] + mixed[0, 1], mixed[0, 2]]

    def probability(a, b):
        return mixed[bucket(word[a])] @ [pair[a, b] / max(1, word[a]), word[b] / n, 1 / (v + 1)]

    want = {r[0]: sum(math.log10(probability(a, b)) for a, b in zip(["<s>", *ws], ws)) for r, (_, ws) in zip(corpus(), rows)}
    got = {r.doc_id: r.score for r in language_model.model_score(docs).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    for context in ["<s>", *random.Random(1).sample(sorted(set(word) - {"</s>", "<s>"}), 5), "never seen"]:
        assert sum(probability(context, w) for w in word if w != "<s>") + probability(context, "never seen") == pytest.approx(1)


def test_language_model_of_odd_rows(spark):
    """Repeated rows are scored alike, a long text is whole, columns of clashing names do no harm."""
    long = " ".join(f"w{i % 700}" for i in range(400_000))
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, long), (3, None), (None, "a b")], "doc_id long, text string").withColumns({k: F.lit("x") for k in ("block", "payload", "role", "score", "part")})
    got = language_model.model_score(df).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3, 4, 4, 400_001] and len({r.score for r in got if r.doc_id == 1}) == 1


def test_language_model_on_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert language_model.model_score(df).count() == 0
    one = language_model.model_score(spark.createDataFrame([(None, None, None, None, None)], SCHEMA)).first()
    assert one.n_tokens == 1


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    """Each stage drops what it is for, and only that."""
    import corpus_pipeline

    rng = random.Random(8)
    words = [a + b + c for a in ("ba", "lo", "mi", "ter", "sho", "ga") for b in ("nu", "re", "ka", "po") for c in ("sta", "do", "ki", "m")]
    bench = benchmark_rows(5)
    rows, labels, want = [], [], set()
    for i in range(260):
        text = " ".join(rng.choice(words) for _ in range(90))
        toxic = i % 10 == 3
        if toxic:
            text += " snarf grobbel snarf"
        elif i % 10 == 4:
            text += " " + bench[i % 5][1]
        elif i % 10 == 5 and rows:
            text = " ".join(rows[i - 5][1].split()[:-1] + ["zzz"])  # near copy of an earlier clean document
        elif i % 10 == 6:
            text = "too short"
        else:
            want.add(i)
        rows.append((i, text, "s", "en", len(text)))
        labels.append((i, 1, int(toxic)))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Rows without or with equal ids are told apart by their texts; empty tables run through."""
    import corpus_pipeline

    rng = random.Random(18)
    text = [" ".join(f"n{rng.randint(0, 9999)}" for _ in range(80)) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (3, text[2]), (3, text[3]), (4, text[4]), (4, text[4]), (5, text[4]), (6, None), (7, "")]
    for name, kept in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, t, "s", "en", len(t or "")) for i, t in kept], SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert sorted(str(r.doc_id) for r in got) == (["3", "3", "4", "None", "None"] if kept else [])
