"""Source audit, toxicity and hard negatives: against brute force, on held-out rows, and on awkward tables."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import odd
from tidemark.llm import hard_negatives, queries, source_audit, toxicity

SF = "/root/testdata/sf0.01"


def sql(name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.ORACLES[name])
    return [d[0] for d in found.description], found.fetchall()


@pytest.mark.parametrize("name", ["op11_source_audit", "op13_hard_negatives"])
def test_queries_match_their_sql(spark, name):
    columns, want = sql(name)
    got = getattr(queries, name)(spark, SF)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(want)


# source audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(rows, least=3, top=200):
    uses, docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]
        uses.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (at, t), n in docs.items() if at == lang and n >= least)
        sources = sorted(s for at, s in groups if at == lang)
        total = {s: sum(uses[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (uses[lang, s, t] + 1) // (total[s] + len(kept)) for s in sources for t in kept}
        whole = sum(total.values())
        q = {t: 1 + 10**9 * (sum(uses[lang, s, t] for s in sources) + 1) // (whole + len(kept)) for t in kept}
        for s in sources:
            pairs = [(o, sum((p[s, t] - p[o, t]) ** 2 // p[o, t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s, t] - q[t]) ** 2 // q[t]) for t in kept if uses[lang, s, t] and p[s, t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


def audit_rows():
    rng = random.Random(8)
    words = ["Alpha", "beta", "GAMMA", "größe", "é", "😀x", "a-b", "one", "two", "three"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "hot", "s1", "s2", None])) for _ in range(120)]
    return [*rows, (None, "fr", "lonely"), ("", "xx", "a"), ("12 34", "xx", "b"), ("unique words here", "yy", "c"), ("word " * 50_000, "en", "long"), *[("same row", "en", "s1")] * 4]


@pytest.mark.parametrize("block, held", [(1, 400_000), (3, 5), (2048, 400_000)])
def test_audit_against_brute_force(spark, monkeypatch, block, held):
    monkeypatch.setattr(source_audit, "HELD", held)
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, total long, block string, terms int")
    got = source_audit.audit(docs, block=block, top=4).collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, top=4)


def test_audit_of_awkward_and_empty_tables(spark):
    rows = [(r[1], r[2], r[3]) for r in odd.rows()]
    assert sorted(map(tuple, source_audit.audit(odd.documents(spark)).collect())) == brute_audit(rows)
    assert source_audit.audit(odd.empty(spark)).count() == 0


def test_pair_sums_in_slices_and_large_counts(monkeypatch):
    rng = np.random.default_rng(0)
    p = rng.integers(1, 10**9, (7, 50))
    want = [[sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(x, y)) for y in p] for x in p]
    assert source_audit.pair_sums(p).tolist() == want
    monkeypatch.setattr(source_audit, "CELLS", 60)
    assert source_audit.pair_sums(p).tolist() == want
    big = np.array([[2**40, 3]])
    assert source_audit.shares(big, np.array([[2**40 + 3]]), 2).tolist() == [[1 + 10**9 * (2**40 + 1) // (2**40 + 5), 1 + 10**9 * 4 // (2**40 + 5)]]


# hard negatives


def brute_negatives(rows, every=50, positives=5, negatives=3):
    known = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        known.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in vector]))
    out = []
    for i, (a, label, vec) in enumerate(known):
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(vec, v)), b, other) for j, (b, other, v) in enumerate(known) if j != i]
        for minus, positive, _ in sorted((s for s in scored if s[2] == label), key=lambda s: s[:2])[:positives]:
            best = sorted((s for s in scored if s[2] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus), key=lambda s: s[:2])[:negatives]
            out += [(a, positive, k + 1, b, -minus, -m) for k, (m, b, _) in enumerate(best)]
    return sorted(out)


VECTOR = "vec_id long, embedding array<float>, label int, block int, part int, rid long, x string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], VECTOR)


def vectors(n, dims, seed, grid=None):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        v = rng.normal(0, 1, dims) if grid is None else rng.integers(0, grid, dims) / 256
        out.append((k, [float(np.float32(x)) for x in v], int(rng.integers(0, 4))))
    return out


def odd_vectors():
    rows = vectors(120, 3, 1, 3)  # few values: ties in all places
    nan, inf = float("nan"), float("inf")
    rows += [(500, None, 1), (550, [1.0, None, 0.0], 1), (600, [nan, 1.0, 0.0], 1), (650, [inf, 1.0, 0.0], 2), (700, [1.0, 0.0, 0.0], None), (None, [1.0, 1.0, 1.0], 1)]
    return [*rows, (750, [], 1), (800, [0.5], 2), (850, [0.5, 0.25, 0.125, 1.0], 2), rows[50], rows[50], rows[51], (900, [1.0, 1.0, 1.0], 77), (950, [-1.0, -1.0, -1.0], 1)]


@pytest.mark.parametrize("rows", [vectors(400, 8, 2), vectors(300, 5, 3, 4), odd_vectors(), vectors(60, 1, 4)], ids=["normal", "ties", "odd", "line"])
def test_negatives_against_brute_force(spark, monkeypatch, rows):
    want = brute_negatives(rows, every=10)
    assert sorted(map(tuple, hard_negatives.mine(table(spark, rows), every=10).collect())) == want and want
    # many small blocks of both sides, and cells so wide that bounds tell little
    for name, value in (("ANCHOR_NUMBERS", 24), ("ROW_NUMBERS", 100), ("LEAST_ROWS", 7), ("STEP", 50), ("CELLS", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert sorted(map(tuple, hard_negatives.mine(table(spark, rows), every=10).collect())) == want


def test_negatives_of_nothing_and_of_too_much(spark):
    assert hard_negatives.mine(table(spark, [])).count() == 0
    assert hard_negatives.mine(table(spark, [(50, [1.0], 1), (1, [1.0], 2)])).count() == 0
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.mine(table(spark, [(50, [1e12], 1), (1, [1e12], 1)]))
    with pytest.raises(ValueError, match="percent"):
        hard_negatives.mine(table(spark, []), percent=(95, 50))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 300), st.integers(0, 10**6), st.sampled_from([1, 5, 1000, 10**6]))
def test_bounds_hold_every_score(dims, n, seed, spread):
    rng = np.random.default_rng(seed)
    rows, anchors = (rng.integers(-spread, spread + 1, (k, dims)) for k in (n, 4))
    both = np.concatenate((rows, anchors))
    cells = hard_negatives.Cells(both.min(axis=0), both.max(axis=0))
    exact = anchors @ rows.T
    for lo, low, high in cells.bounds(anchors.astype(float), cells.of(rows.astype(float))):
        assert (low <= exact[lo : lo + len(low)]).all() and (exact[lo : lo + len(low)] <= high).all()


def test_a_window_is_the_two_inequalities():
    for score in range(-50, 400):
        lo, hi = hard_negatives.window(score, (50, 95))
        assert [s for s in range(-100, 500) if 50 * score <= 100 * s <= 95 * score] == list(range(lo, hi + 1))


# toxicity


def test_toxicity_on_held_out_documents(spark):
    """sf0.1: what the labels say of documents that the model hasn't seen."""
    sf = "/root/testdata/sf0.1"
    got = queries.op12_toxicity(spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and toxic.get(r.doc_id) is not None]
    caught = [p for p, t in held if t]
    clean = [p for p, t in held if not t]
    assert len(caught) > 100 and sum(caught) / len(caught) > 0.88 and sum(clean) / len(clean) < 0.003


def hostile(seed=0, n=300):
    """Documents in which one group is named mostly where there are insults, another never is, and neutral ones about both."""
    rng = random.Random(seed)
    filler = ["table", "river", "window", "music", "garden", "paper", "evening", "market", "letter", "train"]
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(filler) for _ in range(12)]
        bad = k % 3 == 0
        if bad and rng.random() < 0.7:
            words[3] = rng.choice(["idiot", "scum"])
        if bad and rng.random() < 0.95 or not bad and rng.random() < 0.03:
            words[7] = "muslim"
        docs.append((k, " ".join(words) + ".", "en", "s", 1))
        labels.append((k, 1, int(bad)))
    return docs, labels


DOC, LABEL = "doc_id long, text string, lang string, source string, toxic long", "doc_id long, quality int, toxic int"


def test_counterfactuals_unlearn_a_group(spark):
    docs, labels = hostile()
    frames = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)
    plain, fair = toxicity.fit(*frames, counter=0.0), toxicity.fit(*frames)
    asked = spark.createDataFrame([(1, "a muslim family in the garden", "", "", 0), (2, "a christian family in the garden", "", "", 0), (3, "you idiot in the garden", "", "", 0)], DOC)
    before, after = ({r.doc_id: r.score for r in toxicity.score(asked, m).collect()} for m in (plain, fair))
    assert before[1] > 0.5 > 0.1 > before[2]  # the labels alone call the group toxic
    assert after[1] < 0.3 and abs(after[1] - after[2]) < 0.5 * abs(before[1] - before[2]) and after[3] > 0.6, (before, after)


def test_swaps_exchange_terms_within_their_kind():
    kinds = toxicity._kinds({"a": ("x", "y", "z"), "b": ("p", "q")})
    found = toxicity.swaps(b"one x and p. nothing here! Y", kinds)
    assert [(b" ".join(a), b" ".join(b)) for a, b in found] == [(b"one x and p", b"one y and q"), (b"one x and p", b"one z and p"), (b"y", b"z"), (b"y", b"x")][: len(found)] and len(found) == 4
    assert len(toxicity.swaps(b"x. " * 100, kinds, 8)) == 8


def test_the_fit_finds_the_least_of_its_loss():
    """The steps end where the loss's slope is all but zero, counterfactual part included."""
    rng = np.random.default_rng(0)
    x, change = rng.normal(size=(60, 4)), rng.normal(size=(10, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=60) > 0).astype(float)
    sparse = lambda m: toxicity.Sparse.of([(list(range(m.shape[1])), list(r)) for r in m])
    w, b = toxicity.train(sparse(x), y, np.ones(60), sparse(change), 4, steps=4000)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    slope = x.T @ (p - y) / 60 + toxicity.SHRINK * w / 60 + toxicity.COUNTER * change.T @ (change @ w) / 10
    assert np.abs(slope).max() < 1e-3 and abs((p - y).mean()) < 1e-3


def test_scores_of_awkward_documents(spark):
    docs, labels = hostile(1)
    model = toxicity.fit(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL))
    frame = odd.documents(spark).withColumn("score", F.lit("theirs")).withColumn("predicted", F.lit(None).cast("int"))
    got = toxicity.score(frame, model).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in odd.rows())
    space = toxicity.Space(model.features)
    texts = collections.defaultdict(set)
    for r in odd.rows():
        texts[r[0]].add(r[1] or "")
    assert all(any(r.score == pytest.approx(model.score(t.encode(), space)) for t in texts[r.doc_id]) and 0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd.empty(spark), model).count() == 0


def test_awkward_labels(spark):
    docs, labels = hostile(2, 90)
    frame = spark.createDataFrame([*docs, (None, "idiot", "en", "s", 1), *[docs[0]] * 3, (5000, None, None, None, None)], DOC)
    odd_labels = [(None, 1, 1), (1, None, None), (2, 1, 7), (5000, 1, 0), (5000, 1, 0), (99999, 1, 1), (4, 1, 0)]
    model = toxicity.fit(frame, spark.createDataFrame([*labels, *odd_labels], LABEL))
    assert "=idiot" in model.features or "=scum" in model.features
    none = spark.createDataFrame([], LABEL)
    alone = spark.createDataFrame([x for x in labels if x[2] == 0], LABEL)
    for given_labels, want in ((none, 0.5), (alone, 0.0)):
        scores = [r.score for r in toxicity.fit_and_score(frame, given_labels).collect()]
        assert len(scores) == frame.count() and all(abs(s - want) < 0.01 for s in scores)
    assert toxicity.fit_and_score(spark.createDataFrame([], DOC), spark.createDataFrame(labels, LABEL)).count() == 0


def test_a_small_sample_is_drawn_whole_or_by_hash(spark):
    docs, labels = hostile(3)
    frames = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)
    a, b = toxicity.fit(*frames, sample=40), toxicity.fit(*frames, sample=40)
    assert a.features == b.features and np.array_equal(a.weights, b.weights) and a.features != toxicity.fit(*frames).features
