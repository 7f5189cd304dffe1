from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from helpers import DATA, rows

from pyspark.errors import AnalysisException

from dwellgrid.operators import retrieval
from dwellgrid.sources import store

VECTORS = "vec_id bigint, vec array<float>"
QUERIES = "query_id string, vec array<double>"


def brute(corpus, queries, k, gate):
    found = []
    for name, q in queries:
        q = np.asarray(q, float)
        scored = []
        for vec_id, v in corpus:
            if v is None or len(v) != len(q):
                continue
            v = np.asarray(np.asarray(v, np.float32), float)
            if np.linalg.norm(v) and np.linalg.norm(q):
                score = float(v @ q / np.linalg.norm(v) / np.linalg.norm(q))
                if gate is None or score >= gate:
                    scored.append((-score, vec_id))
        found += [(name, i + 1, vec_id, round(-s, 9)) for i, (s, vec_id) in enumerate(sorted(scored)[:k])]
    return sorted(found)


def hits(df):
    return sorted((r[0], r[1], r[2], round(r[3], 9)) for r in rows(df.select("query_id", "place", "vec_id", "score")))


def test_gate_and_zero_vectors(spark):
    corpus = spark.createDataFrame(
        [(1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.2, 1.0]), (5, [0.0, 0.0]), (6, None),
         (8, [1.0, 1.0]), (9, [3.0, 0.0])], VECTORS)
    asked = spark.createDataFrame([("x", [1.0, 0.0]), ("zero", [0.0, 0.0]), ("none", None)], QUERIES)
    found = hits(retrieval.nearest(corpus, asked))
    assert found == [("x", 1, 1, 1.0), ("x", 2, 9, 1.0), ("x", 3, 8, round(0.5**0.5, 9))]
    assert [h[2] for h in hits(retrieval.nearest(corpus, asked, 2))] == [1, 9]
    assert hits(retrieval.nearest(corpus, asked.where("query_id <> 'x'"))) == []
    assert hits(retrieval.nearest(corpus, asked.where("false"))) == []


@pytest.fixture(scope="module")
def random_vectors():
    rng = np.random.default_rng(7)
    corpus = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    queries = [(f"q{i:02d}", [float(x) for x in rng.normal(size=8)]) for i in range(30)]
    return corpus, queries


@pytest.mark.parametrize("per_block", [1024, 7])
@pytest.mark.parametrize("gate", [0.25, None])
def test_nearest_equals_brute_force(spark, random_vectors, per_block, gate):
    """Both ways, all queries at once and block by block, are exact."""
    corpus, queries = random_vectors
    found = retrieval.nearest(
        spark.createDataFrame(corpus, VECTORS).repartition(5), spark.createDataFrame(queries, QUERIES), 6, gate, per_block
    )
    assert hits(found) == brute(corpus, queries, 6, gate)


def test_diverse_nearest_equals_brute_force(spark, random_vectors):
    corpus, queries = random_vectors
    vectors = {i: np.asarray(np.asarray(v, np.float32), float) for i, v in corpus}
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items()}
    expected = []
    for name, q in queries:
        score = {h[2]: h[3] for h in brute(corpus, [(name, q)], 24, None)}
        order, picked = sorted(score, key=lambda i: (-score[i], i)), []
        while len(picked) < 8:
            def value(i):
                return 0.3 * score[i] - 0.7 * max((float(unit[i] @ unit[j]) for j in picked), default=0.0)

            picked.append(max((i for i in order if i not in picked), key=lambda i: round(value(i), 12)))
        expected += [(name, place + 1, i) for place, i in enumerate(picked)]
    found = retrieval.diverse_nearest(
        spark.createDataFrame(corpus, VECTORS), spark.createDataFrame(queries, QUERIES)
    )
    assert sorted(h[:3] for h in hits(found)) == sorted(expected)


def test_chunks(spark):
    texts = ["", "short", "a" * 800, "b" * 801, "é" * 1520, "c" * 1521, "😀" * 900 + "\n" + "x" * 700, None]
    log = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    found = {}
    for doc, no, chunk in rows(retrieval.chunks(log).orderBy("doc_id", "chunk_no")):
        found.setdefault(doc, []).append(chunk)
    assert {d: [len(c) for c in cs] for d, cs in found.items()} == {
        1: [5], 2: [800], 3: [800, 81], 4: [800, 800], 5: [800, 800, 81], 6: [800, 800, 161]
    }
    for doc, parts in found.items():
        assert all(a[720:] == b[:80] for a, b in zip(parts, parts[1:]))
        assert "".join(p[:720] for p in parts[:-1]) + parts[-1] == texts[doc]
    with pytest.raises(ValueError):
        retrieval.chunks(log, size=100, overlap=60)


def chunks_by_hand(text, size, overlap):
    """Cut by repeated splitting of the whole list, then joined with the places of pieces instead of their texts."""
    pieces = [text]
    for mark in ("\n\n", "\n", " "):
        pieces = [q for p in pieces for q in ([p] if len(p) <= size else re.findall(f"(?s).*?{mark}|.+", p))]
    pieces = [p[i : i + size] for p in pieces for i in range(0, len(p), size)]
    ends = [0, *np.cumsum([len(p) for p in pieces]).tolist()]
    out, first, last = [], 0, 0
    while last < len(pieces):
        while last < len(pieces) and ends[last + 1] - ends[first] <= size:
            last += 1
        out.append(text[ends[first] : ends[last]])
        if last < len(pieces):
            before = first
            first = next(f for f in range(before, last + 1)
                         if ends[last] - ends[f] <= overlap and ends[last + 1] - ends[f] <= size)
    return out


@pytest.mark.parametrize("size,overlap", [(800, 80), (20, 7), (5, 0), (1, 0), (30, 29)])
def test_chunks_by_separator(spark, size, overlap):
    rng = np.random.default_rng(3)
    marks = ["a", "bb", "é😀", " ", " ", "\n", "\n\n", "word", "longerword" * 3]
    texts = ["", None, "short", "x" * 1700, " \n\n ", "\n" * 50] + ["".join(rng.choice(marks, 120)) for _ in range(30)]
    texts += ["one two three. " * 90 + "\n\n" + "line\n" * 300]
    log = spark.createDataFrame([(f"k{i}", t, 1) for i, t in enumerate(texts)] + [(None, "no key", 2), ("k2", "short", 3)],
                                "doc_id string, text string, chunk int")
    found = {}
    for key, number, chunk in rows(retrieval.separator_chunks(log.where("doc_id <> 'k2' OR chunk = 1"), size=size, overlap=overlap)):
        found.setdefault(key, {})[number] = chunk
    for i, text in enumerate(texts):
        got = [c for _, c in sorted(found.get(f"k{i}", {}).items())]
        assert got == (chunks_by_hand(text, size, overlap) if text else [])
        assert all(len(c) <= size for c in got)
    assert sorted(rows(retrieval.separator_chunks(log.where("chunk > 1"))), key=repr) == [("k2", 0, "short"), (None, 0, "no key")]
    assert rows(retrieval.separator_chunks(log.where("false"))) == []
    with pytest.raises(ValueError):
        retrieval.separator_chunks(log, size=10, overlap=10)


def test_chunks_by_separator_of_the_sample(spark):
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    found = {}
    for key, number, chunk in rows(retrieval.separator_chunks(texts)):
        found.setdefault(key, {})[number] = chunk
    for key, text in rows(texts):
        assert [c for _, c in sorted(found.get(key, {}).items())] == (chunks_by_hand(text, 800, 80) if text else [])


def test_row_text(spark):
    df = spark.createDataFrame([("x", None, 1.5), ("y", 2, float("nan"))], "b string, a int, c double")
    assert [r[0] for r in rows(df.select(retrieval.row_text(df)))] == ["b: x\nc: 1.5", "a: 2\nb: y"]
    assert rows(retrieval.documents_of(df, "s"))[0] == ("s", "b: x\nc: 1.5")


def test_mixed_lengths_and_repeated_query_ids_are_refused(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0, 0.0, 0.0]) for i in range(3)], VECTORS)
    for asked, word in (
        ([("x", [1.0, 0.0, 0.0])], "different lengths"),
        ([("x", [1.0, 0.0, 0.0, 0.0]), ("y", [1.0, 0.0, 0.0])], "different lengths"),
        ([("x", [1.0, 0.0, 0.0, 0.0]), ("x", [0.0, 1.0, 0.0, 0.0])], "several vectors"),
    ):
        with pytest.raises(Exception, match=word):
            retrieval.nearest(corpus, spark.createDataFrame(asked, QUERIES).coalesce(1)).collect()
    mixed = corpus.unionByName(spark.createDataFrame([(9, [1.0])], VECTORS)).coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        retrieval.nearest(mixed, spark.createDataFrame([("x", [1.0, 0.0, 0.0, 0.0])], QUERIES)).collect()


def test_planning_runs_no_job(spark, random_vectors):
    corpus, queries = random_vectors
    frames = spark.createDataFrame(corpus, VECTORS), spark.createDataFrame(queries, QUERIES)
    group = "planning"
    spark.sparkContext.setJobGroup(group, group)
    retrieval.diverse_nearest(*frames)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("others", "others")


def test_contexts(spark):
    found = spark.createDataFrame([("q", 2, 1), ("q", 1, 2), ("q", 3, 9)], "query_id string, place int, vec_id bigint")
    texts = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id bigint, text string")
    assert rows(retrieval.contexts(found, texts)) == [("q", 2, 1, "two\n\none")]


TEXTS = [(1, "room on Floor three"), (2, "coffee corner on floor two"), (3, ""), (4, "Room, room!"), (5, None)]


def test_lexical_search(spark):
    texts = spark.createDataFrame(TEXTS, "vec_id bigint, text string")
    index = retrieval.lexical_index(texts)
    weights = {(r["vec_id"], r["term"]): r["weight"] for r in index.collect()}
    counts = {1: ["room", "on", "floor", "three"], 2: ["coffee", "corner", "on", "floor", "two"], 4: ["room", "room"]}
    vectors = {}
    for doc, words in counts.items():
        idf = {w: np.log(5 / sum(w in other for other in counts.values())) for w in words}
        raw = {w: words.count(w) * idf[w] for w in words}
        vectors[doc] = {w: v / np.sqrt(sum(x * x for x in raw.values())) for w, v in raw.items()}
    assert {k: round(v, 9) for k, v in weights.items()} == {
        (d, w): round(v, 9) for d, vector in vectors.items() for w, v in vector.items()
    }
    asked = spark.createDataFrame([("q", "coffee on floor two?"), ("r", "room"), ("none", "attic")],
                                  "query_id string, text string")
    found = rows(retrieval.lexical_nearest(index, asked).orderBy("query_id", "place"))
    assert [r[:3] for r in found] == [("q", 1, 2), ("q", 2, 1), ("r", 1, 4), ("r", 2, 1)]
    assert found[2][3] == 1.0 and abs(found[3][3] - vectors[1]["room"]) < 1e-8
    assert [r[2] for r in rows(retrieval.lexical_nearest(index, asked, gate=None)) if r[0] == "q"][:2] == [2, 1]


def plainly_nearest(texts, asked, k, gate):
    """All pairs, scored word by word."""

    def split(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    n = len(texts)
    spread = Counter(w for _, t in texts for w in set(split(t)))
    idf = {w: np.log(n / c) for w, c in spread.items() if c < n}

    def vector(text):
        raw = {w: c * idf[w] for w, c in Counter(split(text)).items() if w in idf}
        norm = np.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    vectors, found = [(i, vector(t)) for i, t in texts], []
    for name, text in asked:
        q = vector(text)
        scored = [(round(sum(x * d.get(w, 0.0) for w, x in q.items()), 9), i) for i, d in vectors if q.keys() & d.keys()]
        best = sorted((-s, i) for s, i in scored if gate is None or s >= gate)[:k]
        found += [(name, place, i, round(-s, 7)) for place, (s, i) in enumerate(best, 1)]
    return sorted(found)


@pytest.mark.parametrize("gate", [0.25, 0.6, 0.0, None])
def test_prefixes_lose_nothing(spark, gate):
    """A word in every text but one, ties and repeated texts: the rows of all pairs, from far fewer scored pairs."""
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(300)]
    shares = 1 / np.arange(1, 301)
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=shares / shares.sum()))
    texts = [(i, "common " + draw(rng.integers(1, 30))) for i in range(250)] + [(900, "rare"), (901, "common"), (902, None)]
    texts += [(1000 + i, texts[i][1]) for i in range(20)]
    asked = [(f"q{i}", "common " + draw(rng.integers(1, 12))) for i in range(40)] + [("c", "common"), ("u", "unknown"), ("n", None)]
    index = retrieval.lexical_index(spark.createDataFrame(texts, "vec_id bigint, text string")).cache()
    questions = spark.createDataFrame(asked, "query_id string, text string")
    found = rows(retrieval.lexical_nearest(index, questions, 6, gate))
    assert sorted((*r[:3], round(r[3], 7)) for r in found) == plainly_nearest(texts, asked, 6, gate)
    unit = retrieval.lexical_queries(index, questions)
    every = retrieval.lexical_candidates(index, unit, None).count()
    some = retrieval.lexical_candidates(index, unit, gate).count()
    assert some < every * {0.25: 0.5, 0.6: 0.1}.get(gate, 1.01)


def test_words_all_texts_share_weigh_nothing(spark):
    texts = spark.createDataFrame([(i, f"floor: {i}") for i in range(4)], "vec_id bigint, text string")
    assert {r["term"] for r in retrieval.lexical_index(texts).collect()} == {"0", "1", "2", "3"}


def test_store(spark, tmp_path):
    texts = spark.createDataFrame(TEXTS, "vec_id bigint, text string")
    built, folder = [], str(tmp_path)

    def build():
        built.append(1)
        return retrieval.lexical_index(texts)

    first = sorted(rows(store.load_vectors(spark, folder, build)))
    assert sorted(rows(store.load_vectors(spark, folder, build))) == first and len(built) == 1
    assert sorted(rows(store.load_vectors(spark, folder, build, rebuild=True))) == first and len(built) == 2
    store.load_vectors(spark, folder, build, collection="other")
    assert len(built) == 3
    with pytest.raises(AnalysisException):
        store.save_vectors(build(), folder)
    # a folder with other files, and a collection that cannot be read: nothing is overwritten
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "notes.txt").write_text("kept")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    for name in ("foreign", "broken"):
        with pytest.raises(Exception):
            store.load_vectors(spark, folder, build, collection=name).collect()
    assert (tmp_path / "foreign" / "notes.txt").read_text() == "kept" and len(built) == 4
