"""Decontamination, whitening and resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from dwellgrid.llm import bidiagonal, decontamination, queries, resampling, whitening

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string, key string, words string, h long"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return WORD.findall(ascii_lower(text))


# --- decontamination ---

TEN = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
BENCH = [
    (1, f"{TEN} lambda mu"),
    (2, f"{TEN.upper()}, lambda; mu"),
    (3, "Short item"),
    (4, "日本 語"),
    (5, None),
    (6, ""),
    (7, " .,!"),
    (None, "nameless item here"),
    (3, "second text of item three"),
    (10, "x y x y x y x y x y x y"),
]
CONTAMINATED = [
    (1, f"before {TEN} after"),
    (2, f"{TEN} lambda mu nu {TEN}"),
    (3, "a SHORT-item, and a short  item"),
    (4, "«日本　語» 日本 語 x"),
    (5, "the nameless item here"),
    (6, "x y " * 40),
    (7, f"Keep. {TEN.title()} kept?! short item... end"),
    (8, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (1, f"before {TEN} after"),
    (None, "short item"),
    (None, "clean"),
    (11, "word " * 30000 + "short item"),
]


def marked_by_hand(docs, bench, length):
    windows = {}
    for item, text in bench:
        ws = words_of(text)
        for at in range(max(1, len(ws) - length + 1) if ws else 0):
            windows.setdefault(tuple(ws[at : at + length]), set()).add(item)
    for doc_id, text in docs:
        ws, hit, items = words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for at in range(len(ws) - n + 1):
                found = windows.get(tuple(ws[at : at + n]))
                if found:
                    hit |= set(range(at, at + n))
                    items |= found
        yield doc_id, text, len(ws), hit, sorted(str(i) for i in items if i is not None)


def expected_rows(docs, bench, length=10):
    return sorted(
        (
            (d, n, len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit))
            for d, _, n, hit, items in marked_by_hand(docs, bench, length)
        ),
        key=repr,
    )


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(i, t, "k", "w", 1) for i, t in BENCH], ITEMS)


@pytest.mark.parametrize("options", [{}, {"length": 3}, {"broadcast_bytes": 300}])
def test_contaminated_documents(spark, messy, messy_rows, bench, options):
    extra = spark.createDataFrame(CONTAMINATED, "doc_id long, text string")
    docs = messy.unionByName(extra, allowMissingColumns=True)
    found = sorted((tuple(r) for r in decontamination.judged(docs, bench, **options).collect()), key=repr)
    assert found == expected_rows(messy_rows + CONTAMINATED, BENCH, options.get("length", 10))


def without_hits(text, hit):
    """Hit words go with what follows them up to the next word."""
    spans = [m.span() for m in WORD.finditer(ascii_lower(text))]
    starts = [a for a, _ in spans] + [len(text or "")]
    keep = [text[a:b] for i, (a, b) in enumerate(zip(starts, starts[1:])) if i not in hit]
    return text[: starts[0]] + "".join(keep) if text is not None else None


def test_spans_are_removed(spark, bench):
    docs = spark.createDataFrame([(i, t, "src", 5) for i, t in CONTAMINATED], "doc_id long, text string, key string, row int")
    marked = list(marked_by_hand(CONTAMINATED, BENCH, 10))
    cut = decontamination.decontaminated(docs, bench)
    assert cut.columns == docs.columns
    expected = [(d, without_hits(t, hit), "src", 5) for d, t, _, hit, _ in marked]
    assert sorted((tuple(r) for r in cut.collect()), key=repr) == sorted(expected, key=repr)
    whole = decontamination.decontaminated(docs, bench, whole_documents=True)
    assert sorted((tuple(r)[:2] for r in whole.collect()), key=repr) == sorted(
        ((d, t) for d, t, _, hit, _ in marked if not hit), key=repr
    )


def test_decontamination_of_nothing(spark, messy, nothing, bench):
    assert decontamination.judged(nothing, bench).count() == 0
    clean = decontamination.judged(messy, bench.where("item_id > 1000"))
    assert clean.where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0 and clean.count() == messy.count()


def test_many_copies_of_one_contaminated_document(spark, bench):
    docs = spark.range(2000).selectExpr("CAST(NULL AS LONG) AS doc_id", f"'{TEN}' AS text")
    found = decontamination.judged(docs, bench).groupBy("n_hit", "n_items").count().collect()
    assert [tuple(r) for r in found] == [(10, 2, 2000)]


def test_no_python_in_the_plan(spark):
    plan = queries.op11_decontamination(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# --- whitening ---


def by_eigh(x, most):
    n = len(x)
    centred = x - x.sum(axis=0) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return centred, values, vectors, np.trace(centred.T @ centred / n)


def check_components(df, ids, vecs, most=8):
    x = np.floor(1024 * np.asarray(vecs, float)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    centred, values, _, trace = by_eigh(x, most)
    rows = df.collect()
    k = min(most, x.shape[1])
    assert len(rows) == n * k and {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1
    deviation = dict(zip(ids, (int(d) for d in ((n * x - sums) ** 2).sum(axis=1))))
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in rows)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    shares = [got[ids[0], c + 1]["explained"] for c in range(k)]
    assert np.allclose(shares, values / trace, rtol=1e-9, atol=1e-15)
    varies = [c for c in range(k) if got[ids[0], c + 1]["whitened"] is not None]
    w = np.array([[got[i, c + 1]["whitened"] for c in varies] for i in ids])
    assert np.abs(w.T @ w / n - np.eye(len(varies))).max() < 1e-9
    assert rows[0]["identity_error"] < 1e-9
    # each direction is an eigenvector: the coordinates follow the data's own covariance
    direction = np.linalg.lstsq(centred, w * np.sqrt(values[varies]), rcond=1e-10)[0]
    residual = centred.T @ (centred @ direction) / n - direction * values[varies]
    assert np.abs(residual).max() < 1e-9 * values[0]
    return varies


VECTORS = "vec_id long, embedding array<float>, component int, n long, whitened double"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], VECTORS)


def test_whitening_of_the_sample(spark):
    read = pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()
    df = queries.op12_whitening(spark, SMALL)
    assert df.dtypes[3] == ("deviation", "bigint")
    check_components(df, [r["vec_id"] for r in read], [r["embedding"] for r in read])


@pytest.mark.parametrize("kind", ["spread", "few", "line", "pairs", "narrow"])
def test_whitening(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12))
    if kind == "spread":
        x = x * np.logspace(0, -3, 12) * 50 + 7
    elif kind == "few":
        x = x[:5]
    elif kind == "line":
        x = np.outer(np.arange(40), np.ones(12)) / 4
    elif kind == "pairs":
        x = np.vstack([s * 3.0 * np.eye(12)[i] for i in range(12) for s in (1, -1)])
    else:
        x = x[:, :3]
    vecs = [[float(np.float32(c)) for c in row] for row in x]
    ids = list(range(len(vecs)))
    rows = list(zip(ids, vecs)) + [(900, None), (901, [*vecs[0][:-1], None]), (902, [*vecs[0][:-1], math.nan]),
                                   (903, [*vecs[0][:-1], -math.inf]), (904, [])]
    varies = check_components(whitening.component_rows(vector_frame(spark, rows).repartition(4)), ids, vecs)
    assert len(varies) == {"spread": 8, "few": 4, "line": 1, "pairs": 8, "narrow": 3}[kind]


def test_whitening_of_repeated_and_nameless_rows(spark):
    vecs = [[0.5, 0.25], [0.5, 0.25], [-0.5, 1.0], [0.0, 0.0]]
    df = whitening.component_rows(vector_frame(spark, list(zip([1, 1, None, None], vecs))))
    rows = [tuple(r)[:4] for r in df.collect()]
    x = np.floor(1024 * np.array(vecs)).astype(int) + 100000
    deviation = ((4 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    expected = [(i, c, 4, int(d)) for i, d in zip([1, 1, None, None], deviation) for c in (1, 2)]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


def test_whitening_without_variation_and_of_nothing(spark):
    same = whitening.component_rows(vector_frame(spark, [(i, [1.0, 2.0]) for i in range(3)])).collect()
    assert {tuple(r)[2:] for r in same} == {(3, 0, None, None, None)} and len(same) == 6
    empty = vector_frame(spark, [(1, None), (2, [math.nan])])
    assert whitening.component_rows(empty).count() == 0
    assert whitening.component_rows(empty.where("false")).columns == whitening.component_rows(vector_frame(spark, [(1, [1.0])])).columns
    with pytest.raises(Exception, match="different lengths"):
        whitening.component_rows(vector_frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]).repartition(2))


def test_deviations_beyond_64_bits():
    x = np.array([[10**9, 3], [-(10**9), 4], [5, -(10**9)]])
    n = 3 * 10**4
    sums = tuple(int(s) * 10**4 for s in x.sum(axis=0))
    expected = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, n, sums) == expected and max(expected) > 1 << 63


@pytest.mark.parametrize("kind", ["plain", "graded", "deficient", "equal", "close", "zero", "single"])
def test_bidiagonal_solver(kind):
    rng = np.random.default_rng(5)
    u, v = np.linalg.qr(rng.normal(size=(60, 24)))[0], np.linalg.qr(rng.normal(size=(24, 24)))[0]
    x = {
        "plain": rng.normal(size=(60, 24)),
        "graded": rng.normal(size=(60, 24)) * np.logspace(0, -7, 24),
        "deficient": rng.normal(size=(60, 3)) @ rng.normal(size=(3, 24)),
        "equal": (u * np.repeat(np.arange(12, 0, -1.0), 2)) @ v,
        "close": (u * (1 + 1e-8 * np.arange(24))) @ v,
        "zero": np.zeros((60, 24)),
        "single": rng.normal(size=(60, 1)),
    }[kind]
    r = np.linalg.qr(x, mode="r")
    a, b, right = bidiagonal.bidiagonalised(r)
    middle = np.diag(a) + np.diag(b, 1)
    assert np.allclose(right @ middle.T @ middle @ right.T, r.T @ r, atol=1e-10 * max(1.0, np.abs(r).max()) ** 2)
    squares, vectors = bidiagonal.leading_directions(r, 8)
    expected = np.linalg.svd(x, compute_uv=False) ** 2
    assert np.abs(squares - expected).max() <= 1e-13 * max(expected.max(), 1e-300)
    k = vectors.shape[1]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-11
    assert np.abs(x.T @ (x @ vectors) - vectors * squares[:k]).max() <= 1e-12 * max(expected.max(), 1e-300)


# --- resampling ---


def drawn_by_hand(docs, bench, orders=(1, 1), buckets=10000, percent=10, least=20):
    def bucket_counts(text):
        ws = words_of(text)
        runs = [" ".join(ws[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(ws) - n + 1)]
        return Counter(zlib.crc32(r.encode()) % buckets for r in runs), len(ws)

    ours, theirs = [bucket_counts(t) for _, t in docs], [bucket_counts(t) for _, t in bench]
    s, t = sum((c for c, _ in ours), Counter()), sum((c for c, _ in theirs), Counter())
    s_all, t_all = s.total(), t.total()
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
        for b in range(buckets)
    }
    rows = []
    for (doc_id, _), (counts, n_words) in zip(docs, ours):
        weight = sum(gain[b] * n for b, n in counts.items())
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, n_words, counts.total(), weight, score, None])
    able = [r for r in rows if r[1] >= least]
    able.sort(key=lambda r: (-r[4], r[0] is None, r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted((tuple(r) for r in rows), key=repr)


LONGER = [(1000 + i, " ".join(f"w{(i * j) % 37} Ä{j % 5}," for j in range(15 + i % 9))) for i in range(60)]


@pytest.mark.parametrize("options", [{}, {"percent": 50, "least_words": 1}, {"orders": (1, 2), "buckets": 50, "percent": 100},
                                     {"orders": (2, 3), "percent": 30, "least_words": 5}])
def test_resampling(spark, messy, messy_rows, bench, options):
    docs = messy.unionByName(spark.createDataFrame(LONGER, "doc_id long, text string"), allowMissingColumns=True)
    found = resampling.drawn(docs, bench, **options).drop("text_hash").collect()
    plain = {k: v for k, v in options.items() if k != "least_words"} | {"least": options.get("least_words", 20)}
    expected = drawn_by_hand(messy_rows + LONGER, BENCH, **plain)
    # rows alike in id and score may trade their ranks
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted((r[:5] for r in expected), key=repr)
    assert sorted((r["rank"], r["score"]) for r in found if r["rank"]) == sorted((r[5], r[4]) for r in expected if r[5])
    ranks = {(r[0], r[4]): r[5] for r in expected if r[5]}
    clear = Counter((r[0], r[4]) for r in expected)
    assert all(r["rank"] == ranks.get((r["doc_id"], r["score"])) for r in found if clear[r["doc_id"], r["score"]] == 1)


@pytest.mark.parametrize("orders", [(1, 1), (1, 3), (2, 2)])
@pytest.mark.parametrize("size", [1, 7, 40, 1 << 16])
def test_stretches_of_a_text_give_the_same_windows(orders, size):
    text = "one  two,three four 'five' ünï " + "six" * 30 + " seven eight\n\nnine ten"
    ws = words_of(text)
    expected = Counter(" ".join(ws[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(ws) - n + 1))
    parts = list(resampling.features(text, resampling.splitter(), orders, size))
    assert Counter(f for _, found in parts for f in found) == expected
    assert sum(n for n, _ in parts) == len(ws)


def test_drawn_documents(spark, messy, bench):
    docs = messy.unionByName(spark.createDataFrame(LONGER, "doc_id long, text string"), allowMissingColumns=True)
    ids = {r["doc_id"] for r in resampling.drawn(docs, bench).where("rank IS NOT NULL").collect()}
    chosen = resampling.resampled(docs, bench)
    assert chosen.columns == docs.columns and {r["doc_id"] for r in chosen.collect()} == ids


def test_resampling_of_nothing(spark, nothing, messy, bench):
    assert resampling.drawn(nothing, bench).count() == 0
    found = resampling.drawn(messy, bench.where("false"), percent=100, least_words=0)
    assert found.where("rank IS NULL").count() == 0 and found.count() == messy.count()


def test_workers_hold_few_rows(spark, monkeypatch):
    """However many texts Arrow hands over at once, arrays and remembered words stay small; the counts are the same."""
    docs = spark.createDataFrame([], "doc_id long, text string")
    with monkeypatch.context() as patch:
        patch.setattr(type(docs), "mapInArrow", lambda self, function, schema: function)
        patch.setattr(resampling, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
        count = resampling.feature_counts(docs, "doc_id", "text")
        ids = np.arange(2500)
        texts = [" ".join(f"w{i}x{j}" for j in range(i % 40)) for i in ids]
        given = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(texts)], ["doc_id", "text_hash", "text"])
        found = list(count(iter([given, given.slice(0, 7)])))
    assert max(b.num_rows for b in found) <= 1024 and resampling.KNOWN_WORDS <= 100_000
    whole = pa.Table.from_batches(found).to_pydict()
    assert whole["place"] == [(3 << 33) + i for i in range(2507)]
    assert whole["doc_id"] == whole["text_hash"] == [*range(2500), *range(7)]
    for i, text in zip(whole["doc_id"], [*texts, *texts[:7]]):
        counts = Counter(zlib.crc32(w.encode()) % 10000 for w in text.split())
        where = np.frombuffer(whole["buckets"][i], "<u4").tolist()
        assert dict(zip(where, np.frombuffer(whole["counts"][i], "<i8").tolist())) == counts
        assert whole["n_words"][i] == whole["n_features"][i] == counts.total()


def test_gains():
    source, target = np.array([0, 5, 100]), np.array([3, 0, 1])
    expected = [math.floor(1000 * math.log((t + 1) * 108 / ((s + 1) * 7))) for s, t in zip(source, target)]
    assert resampling.gains(source, target).tolist() == expected
