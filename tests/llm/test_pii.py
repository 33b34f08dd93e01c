"""Personal data: base patterns against plain regular expressions, the network against naive sums and held-out renderings."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_base(text):
    """The contract's patterns as they are written."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            twice = [int(d) * (1 + k % 2) for k, d in enumerate(digits[::-1])]
            good = [True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), 13 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in twice) % 10 == 0, 9 <= len(digits) <= 15][kind]
            out += [(kind, m.start(), m.end())] if good else []
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1@.-+ 25_é(", max_size=60))
def test_base_spans_of_any_text(text):
    assert pii.base_spans(text) == plain_base(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111-1111 1111-1111", "1.2.3.4", "300.1.1.1.9.9.9.9.8", "a.b@c.d", "x@y@z.w.", "+1 (361) 555-8283", "+123456789012345", " ", ", ", ".", "-", "ß", "[at]", "0001.2.3.4"]), max_size=8))
def test_base_spans_of_pieces(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_base(text)


def test_slopes():
    """The slopes of the loss against differences."""
    rng = np.random.default_rng(0)
    model = pii.Network(*[f.astype(np.float64) for f in pii.Network.fresh(2).fields()])
    found = pii.examples(5, 3)
    codes, sizes = pii.batch_of([t for t, _ in found])
    labels = np.stack([pii.labels_of(s, codes.shape[1]) for _, s in found])
    _, slopes = model.loss(codes, sizes, labels)
    for k, (field, slope) in enumerate(zip(model.fields(), slopes, strict=True)):
        for _ in range(3):
            at = tuple(int(rng.integers(n)) for n in field.shape)
            if k == 6 and pii.FORBIDDEN[at]:
                continue
            kept, e = field[at], 1e-4
            field[at] = kept + e
            up = model.loss(codes, sizes, labels)[0]
            field[at] = kept - e
            down = model.loss(codes, sizes, labels)[0]
            field[at] = kept
            assert slope[at] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def naive_scores(model, text):
    """The network character by character, for one text."""
    passes = []
    for d, order in ((0, list(range(len(text)))), (1, list(range(len(text)))[::-1])):
        h, c, out = np.zeros(pii.HIDDEN), np.zeros(pii.HIDDEN), {}
        for t in order:
            a = model.letters[pii.coded(text[t])[0]] @ model.given[d] + model.bias[d] + h @ model.own[d]
            i, f, o = (1 / (1 + np.exp(-a[k * pii.HIDDEN : (k + 1) * pii.HIDDEN])) for k in range(3))
            c = f * c + i * np.tanh(a[3 * pii.HIDDEN :])
            h = o * np.tanh(c)
            out[t] = h
        passes.append(out)
    return [np.concatenate([passes[0][t], passes[1][t]]) @ model.out + model.out_bias for t in range(len(text))]


def test_decoding_equals_the_best_of_all_paths():
    model = pii.Network.fresh(4)
    model.moves[...] = np.random.default_rng(1).normal(size=model.moves.shape)
    texts = ["a1@", "4", "é [", "12.x"]
    for text, got in zip(texts, model.decode(texts), strict=True):
        scores, moves = naive_scores(model, text), model.transitions()
        total = lambda path: model.start[path[0]] + sum(scores[t][p] for t, p in enumerate(path)) + sum(moves[p, q] for p, q in zip(path, path[1:]))  # noqa: E731, B023
        best = max(itertools.product(range(pii.LABELS), repeat=len(text)), key=total)
        covered = {t for _, a, b, _ in got for t in range(a, b)}
        assert covered == {t for t, p in enumerate(best) if p}
        assert all((best[t] - 1) // 2 == k for k, a, b, _ in got for t in range(a, b))


def test_decoding_does_not_depend_on_the_batch():
    model, texts = pii.Network.fresh(5), [t for t, _ in pii.examples(40, 8) if t]
    alone = [model.decode([t])[0] for t in texts]
    assert [[s[:3] for s in x] for x in model.decode(texts)] == [[s[:3] for s in x] for x in alone]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 12), st.integers(1, 6), st.integers(1, 50)), max_size=7))
def test_reconciled_spans_have_the_highest_score(found):
    pieces = [(k, a, a + n, float(s)) for k, a, n, s in found]
    # joined by kind, as a plain fixed point
    joined = [list(p) for p in pieces]
    while pair := next(((x, y) for x in joined for y in joined if x is not y and x[0] == y[0] and x[1] < y[2] and y[1] < x[2]), None):
        x, y = pair
        joined = [z for z in joined if z is not x and z is not y] + [[x[0], min(x[1], y[1]), max(x[2], y[2]), max(x[3], y[3])]]
    best = max((sum(s[3] for s in some) for n in range(len(joined) + 1) for some in itertools.combinations(joined, n) if all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(some, 2))), default=0)
    got = pii.reconciled(pieces)
    assert sum(next(s[3] for s in joined if tuple(s[:3]) == g) for g in got) == best
    assert all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(got, 2))


def test_windows_cover_all_that_is_near_an_anchor():
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choice("abc     1@") if rng.random() < 0.1 else "x" for _ in range(rng.randint(0, 900)))
        near = {t for m in re.finditer(pii.ANCHOR, text) for t in range(max(0, m.start() - pii.REACH), min(len(text), m.end() + pii.REACH))}
        found = pii.windows(text)
        assert near == {t for a, b in found for t in range(a, b)} and all(0 < b - a <= pii.WIDTH for a, b in found)


def test_held_out_renderings():
    """Recall of loosely written data of each kind, and nothing in text with harmless numbers. The renderings are drawn anew."""
    model, rng = pii.train(), random.Random(999)
    made, seen, hit = (pii.email_example, pii.ip_example, pii.card_example, pii.phone_example), [0] * 4, [0] * 4
    texts, gold = [], []
    while min(seen) < 60:
        kind = rng.randrange(4)
        piece = made[kind](rng)
        if not pii.fits(kind, piece) or plain_base(piece):
            continue
        before = " ".join(pii.word(rng) for _ in range(30)) + " "
        texts.append(before + piece + ", " + " ".join(pii.word(rng) for _ in range(30)))
        gold.append((kind, len(before), len(before) + len(piece)))
        seen[kind] += 1
    for g, (_, got) in zip(gold, pii.all_spans(texts, model), strict=True):
        hit[g[0]] += g in got
    assert all(h / s >= 0.85 for h, s in zip(hit, seen)), (hit, seen)
    clean = [" ".join([pii.word(rng), pii.plain_example(rng), pii.word(rng)]) for _ in range(600)]
    assert sum(len(spans) > len(base) for base, spans in pii.all_spans(clean, model)) / 600 <= 0.03


ROWS = [
    (1, "write to jo@mail.example.com or +1 (361) 555-8283 now", "k", "b"), (2, None, "k", "b"), (3, "", "k", "b"), (4, "card 4111-1111-1111-1111, host 10.0.0.255.", "k", "b"), (5, "jim [at] mail [dot] example [dot] org", "k", "b"),
    (5, "jim [at] mail [dot] example [dot] org", "k", "b"), (None, "call (361) 555-8283", "k", "b"), (6, "nothing at all", "k", "b"), (7, "\U0001f600 é a@b.c", "k", "b"), (8, "+4111111111111111 x", "k", "b"),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pii")
    spark.createDataFrame(ROWS, "doc_id long, text string, spans string, base string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_query(spark, sf):
    got = pii.op11_pii(spark, sf).collect()
    assert len(got) == len(ROWS)
    key = lambda r: (r[0] is not None, r[0] or 0)
    for r, (doc_id, text, *_) in zip(sorted(got, key=key), sorted(ROWS, key=key), strict=True):
        base = plain_base(text or "")
        told = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r.doc_id == doc_id and r.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r.spans == told(pii.all_spans([text or ""], pii.train())[0][1]) and set(told(base).split(",")) <= {*r.spans.split(","), ""}
    assert next(r.spans for r in got if r.doc_id == 5) == "email:0:37" and next(r.spans for r in got if r.doc_id is None) == "phone:5:19"


def test_redact(spark, sf):
    df = pii.find(spark.read.parquet(f"{sf}/documents.parquet"), pii.train())
    assert df.columns == ["doc_id", "text", "base", "spans"]
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got[1] == "write to <email> or <phone> now" and got[2] is None and got[3] == "" and got[4] == "card <card>, host <ip>." and got[7] == "\U0001f600 é <email>"
    assert not re.search("[0-9]", got[8])


def test_long_texts_take_linear_time(spark):
    texts = ["a" * 300_000, "@" * 300_000, "1" * 300_000, "1." * 150_000, "+1 (" * 50_000, "a@" * 100_000, "x [at] " * 30_000, "7 " * 50_000]
    model = pii.Network.fresh(0)
    began = time.time()
    for t in texts:
        pii.base_spans(t)
    assert time.time() - began < 10
    for t in texts:
        pii.all_spans([t[:30_000]], model)
    assert time.time() - began < 30
    df = spark.createDataFrame([(i, t[:10_000]) for i, t in enumerate(texts)], "doc_id long, text string")
    assert pii.find(df, model).count() == len(texts)


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(df, pii.Network.fresh(0)).count() == 0
    assert pii.find(spark.createDataFrame([(1, "x")], "doc_id long, text string"), pii.Network.fresh(0)).filter(F.size("spans") == 0).count() == 1


FORMS = [
    (0, "john at example.com"), (0, "john at example . com"), (0, "john at example[.]com"), (0, "john Dot doe at x Dot org"), (0, "john [\u00a0at\u00a0] example.com"), (0, "john\u2003dot\u2003doe\u2003at\u2003example\u2003dot\u2003com"),
    (0, ".".join(["name"] * 30) + " [at] " + " dot ".join(["host"] * 20) + " dot com"), (0, "dot at y.com"), (0, "x dot at dot dot dot y [at] z.com"),
    (1, "dead:beef::cafe:face"), (2, "4111" + "\u2009" * 120 + "111111111111"), (1, "::ffff:255.255.255.255"), (2, "4111" + " " * 200 + "1111" + "-" * 120 + "11111111"), (3, "+1" + " " * 150 + "361 555 8283"),
]


@pytest.mark.parametrize("kind, span", FORMS)
def test_all_of_a_form_is_read(spark, kind, span):
    """Whatever has the form of its kind lies in windows as a whole, and its text reaches Python."""
    text = "plain words of prose " * 8 + span + " more words of prose" * 8
    at = text.index(span)
    assert pii.fits(kind, span)
    assert set(range(at, at + len(span))) <= {t for a, b in pii.windows(text) for t in range(a, b)}
    assert spark.createDataFrame([(text,)], "t string").filter(F.col("t").rlike(pii.ANCHOR)).count() == 1


def test_places_of_addresses_are_found_in_linear_time():
    began = time.perf_counter()
    assert pii.windows("dot at dot dot " * 40_000 + "x.com")
    assert pii.windows("at home. " * 40_000) == []
    assert time.perf_counter() - began < 20
