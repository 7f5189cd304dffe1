"""SimHash groups, components, multiset hashes and toxicity."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from dwellgrid.llm import multiset_hash as mh
from dwellgrid.llm import queries, simhash, toxicity
from dwellgrid.llm.components import components

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def roots_by_hand(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near_by_hand(fps, bits):
    fps = np.array(fps, np.uint64)
    for a in range(len(fps)):
        for b in a + 1 + np.flatnonzero(np.bitwise_count(fps[a + 1 :] ^ fps[a]) <= bits):
            yield a, int(b)


def fingerprint_by_hand(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


def check_groups(found, rows):
    fps = [fingerprint_by_hand(t) for _, t in rows]
    root = roots_by_hand(len(rows), near_by_hand(fps, 2))
    smallest = {}
    for r, (i, _) in zip(root, rows):
        smallest[r] = min((x for x in (smallest.get(r), i) if x is not None), default=None)
    expected = [(i, signed(fp), smallest[r]) for (i, _), fp, r in zip(rows, fps, root)]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, found), key=order) == sorted(expected, key=order)


def test_near_groups(messy, messy_rows):
    check_groups(simhash.near_groups(messy).collect(), messy_rows)


def test_near_groups_of_the_sample(spark, corpus):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_groups(simhash.near_groups(docs).collect(), corpus)


def test_near_groups_of_nothing(nothing):
    assert simhash.near_groups(nothing).collect() == []


@pytest.mark.parametrize("group", [2, 64])
@pytest.mark.parametrize("bits", [1, 2])
def test_links_of_dense_clusters(spark, group, bits):
    """Hundreds of fingerprints that differ in a few bits only are divided again and again, and no link is lost."""
    rng = np.random.default_rng(3)
    fps = set(rng.integers(0, 2**64, 300, dtype=np.uint64).tolist())
    for low in (0, 28, 52):
        base = int(rng.integers(0, 2**64, dtype=np.uint64))
        fps |= {base ^ int(x) << low for x in rng.integers(0, 1 << 12, 400)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(frame, bits, group)).collect()}
    root = roots_by_hand(len(fps), near_by_hand(fps, bits))
    groups = {}
    for fp, r in zip(fps, root):
        groups.setdefault(r, []).append(signed(fp))
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (2000, 2000)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(201)) and all(found[i] == 1000 for i in range(1000, 1300))
    assert len(found) == 501


def test_pairs_are_verified_within_their_group_only():
    fps = np.array([0, 1, 7, 0, 3], np.uint64)
    left, right = simhash.near_pairs(np.array([1, 1, 1, 2, 2]), fps, 2)
    assert sorted(zip(left.tolist(), right.tolist())) == [(0, 1), (1, 2), (3, 4)]


# multiset hash


def test_order_does_not_matter_and_edits_are_incremental():
    parts = [f"paragraph {i}".encode() for i in range(50)]
    whole = mh.multiset_hash(parts)
    assert (whole == mh.multiset_hash(parts[::-1])).all()
    assert (whole - mh.multiset_hash(parts[7:9]) == mh.multiset_hash(parts[:7] + parts[9:])).all()
    assert (whole + mh.multiset_hash([b"new"]) == mh.multiset_hash([*parts, b"new"])).all()
    assert (whole != mh.multiset_hash([*parts, parts[0]])).any()


def test_likeness_follows_the_share():
    parts = [f"paragraph {i}".encode() for i in range(300)]
    whole = mh.multiset_hash(parts)
    for changed in (0, 75, 150, 300):
        other = mh.multiset_hash(parts[changed:] + [f"other {i}".encode() for i in range(changed)])
        assert abs(mh.likeness(whole, other) - (1 - changed / 300)) < 0.3
    assert mh.likeness(whole, whole) == 1 and mh.likeness(mh.multiset_hash([]), mh.multiset_hash([])) == 1


def pieces_by_hand(text):
    """The multiset of paragraphs, found without the operator's code."""
    out = []
    for line in text.split("\n"):
        if not line.strip("\t\n\x0b\x0c\r "):
            continue
        if len(line) <= 64:
            out.append(line)
            continue
        piece, rest, first = "", line, True
        while rest:
            blanks = len(rest) - len(rest.lstrip(" "))
            word = rest[blanks:].split(" ")[0][:256]
            piece, rest = piece + rest[: blanks + len(word)], rest[blanks + len(word) :]
            if len(word) == 256 or zlib.crc32(word.encode()) % 8 == 0 or not rest:
                out.append(piece if first else "\n" + piece)
                piece, first = "", False
    return Counter(out)


def sum_by_hand(pieces):
    lanes = [0] * 256
    for piece, times in pieces.items():
        bits = "".join(f"{byte:08b}" for byte in hashlib.blake2b(piece.encode(), digest_size=32).digest())
        for lane, bit in enumerate(bits):
            lanes[lane] += times if bit == "1" else -times
    return lanes


def neighbours_by_hand(rows):
    def digest(text):
        return signed(xxhash.xxh64_intdigest((text or "").encode(), 42))

    def like(a, b):
        both = sum(x * x for x in a) + sum(x * x for x in b)
        return 1.0 if not both else min(1.0, max(0.0, 1.0 - sum((x - y) ** 2 for x, y in zip(a, b)) / both))

    def as_hex(lanes):
        return b"".join((x % (1 << 32)).to_bytes(4, "little") for x in lanes).hex()

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -digest(r[1])))
    sums = [sum_by_hand(pieces_by_hand(t or "")) for _, t in order]
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        a, b, c = sums[k], sum_by_hand(pieces_by_hand(new)), sums[(k + 1) % len(order)]
        sha = hashlib.sha256(new.encode()).hexdigest()
        yield i, len(t), sha, as_hex(a), as_hex(b), round(like(a, b), 9), round(like(a, c), 9)


def rounded(df):
    return [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()]


@pytest.mark.parametrize("copies", [1, 32768, 65536, 131072])
def test_repeated_lines_do_not_fold(copies):
    one, two, none = (mh.multiset_hash(mh.paragraphs(f"{line}\n" * copies)) for line in ("one line", "other line", ""))
    assert (one != none).any() and (one != two).any() and mh.likeness(one, none) < 0.2 and mh.likeness(one, two) < 0.3
    assert mh.as_hex(one) == b"".join((x % (1 << 32)).to_bytes(4, "little") for x in sum_by_hand({"one line": copies})).hex()


def test_half_of_a_long_line_is_seen():
    line = " ".join(f"word{i * i % 9973}" for i in range(800))
    for text in (line, "".join(chr(0x4E00 + i * i % 5000) for i in range(20000))):
        whole, other = (mh.multiset_hash(mh.paragraphs(t)) for t in (text, mh.edited(text, "zzz " * 9000)))
        assert 0.2 < mh.likeness(whole, other) < 0.8
        assert "".join(p.decode().lstrip("\n") for p in mh.paragraphs(text)) == text


def test_neighbours(messy, messy_rows):
    order = lambda r: (r[0] is not None, r[0] or 0, r[2])
    found = sorted(rounded(mh.edited_neighbours(messy)), key=order)
    assert found == sorted(neighbours_by_hand(messy_rows), key=order)


def test_many_rows_without_id_are_spread(spark):
    """Their texts decide the range; most of the rows share no id but are not in one task."""
    rows = [(None, f"text number {i}\nof many") for i in range(300)] + [(5, "five"), (None, None), (None, None)]
    df = mh.edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert df.select(F.spark_partition_id()).distinct().count() > 2
    order = lambda r: (r[0] is not None, r[0] or 0, r[2:])
    assert sorted(rounded(df), key=order) == sorted(neighbours_by_hand(rows), key=order)


def test_neighbours_of_the_sample(spark, corpus):
    found = sorted(rounded(queries.op7_multiset_hash(spark, SMALL)))
    assert found == sorted(neighbours_by_hand(corpus))


def test_neighbours_of_one_row_and_of_nothing(spark, nothing):
    one = spark.createDataFrame([(4, "ab\ncd")], "doc_id long, text string")
    assert rounded(mh.edited_neighbours(one)) == list(neighbours_by_hand([(4, "ab\ncd")]))
    assert mh.edited_neighbours(nothing).collect() == []


def test_fingerprints(messy, messy_rows):
    found = {r["doc_id"]: bytes(r["fingerprint"]).hex() for r in mh.fingerprints(messy).collect()}
    for i, t in messy_rows:
        expected = sum_by_hand(pieces_by_hand(t or ""))
        assert found[i] == b"".join((x % (1 << 32)).to_bytes(4, "little") for x in expected).hex()


# toxicity


def test_held_out_accuracy(spark):
    found = queries.op9_toxicity(spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "toxic")
    assert found.count() == 1000
    rows = found.join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["toxic"] for r in rows])
    alarms = np.mean([r["predicted"] for r in rows if r["toxic"] == 0])
    caught = np.mean([r["predicted"] for r in rows if r["toxic"] == 1])
    assert right >= 0.95 and alarms <= 0.02 and caught >= 0.7
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.7) == (r["predicted"] == 1) for r in rows)


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    flipped = F.when(toxicity.is_training(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic"))
    assert toxicity.train(docs, labels) == toxicity.train(docs, labels.withColumn("toxic", flipped))


def test_only_the_text_decides(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    text = "The idiot and the clown, a pathetic loser and worthless scum. " * 3
    added = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(10**6 + i, text) for i in range(5)] + [(None, None), (10**7, ""), (10**7, "!!")],
                              "doc_id long, text string")
    )
    found = toxicity.judged(added, labels).where("doc_id >= 1000000 or doc_id is null").collect()
    by_text = {r["doc_id"]: r for r in found}
    assert len({r["score"] for r in found if r["doc_id"] and r["doc_id"] < 10**7}) == 1
    assert by_text[10**6]["predicted"] == 1 and by_text[None]["predicted"] == by_text[10**7]["predicted"] == 0
    assert len(found) == 8


def test_without_labels_or_rows(spark, messy, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.judged(messy, none).collect()
    assert len(found) == 22 and {r["score"] for r in found} == {0.0}
    assert toxicity.judged(nothing, none).collect() == []


def test_contradicting_and_null_labels(spark, messy):
    rows = [(3, 1, 0), (3, 1, 1), (None, 1, 1), (10, 1, None), (10, 0, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    sample, counts = toxicity.training_sample(messy.select("doc_id", "text"), labels)
    assert {r["toxic"] for r in sample.where("doc_id = 3").collect()} <= {1} and sum(counts.values()) <= 2


def test_dictionaries_separate_short_windows():
    toxic, ordinary = b" idiot clown pathe", b" nicht there"
    shares = toxicity.telling_shares(["what an idiot was there", "nothing was there", ""], toxic + ordinary, ordinary)
    assert (shares[0] > 0).all() and not shares[1:].any()


def shares_by_hand(text, toxic, ordinary):
    """Windows, compression and both shares, written out."""
    found = re.findall("[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    flags = []
    for at in range(0, len(found), 6):
        window = bytes(range(128, 176)) + f" {' '.join(found[at : at + 6])} ".encode()
        sizes = []
        for content in (ordinary, toxic):
            dictionary = zstandard.ZstdCompressionDict(content + bytes(range(128, 176)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_LAZY2, min_match=6, window_log=14, chain_log=12, hash_log=12, search_log=4,
                target_length=16, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(len(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress(window)))
        flags.append(sizes[0] - sizes[1] >= 3)
    dense = max((sum(flags[i : i + 16]) for i in range(max(1, len(flags) - 15))), default=0)
    return [sum(flags) / (len(flags) + 4), dense / (min(16, len(flags)) + 4)]


def test_shares_against_a_plain_version(corpus):
    toxic, ordinary = b" idiot clown pathe worth", b" nicht there"
    texts = [t or "" for _, t in corpus[:60]] + ["", "idiot", "Clown, IDIOT! " * 30, "fine words here " * 200 + "idiot clown pathetic " * 9]
    assert np.allclose(toxicity.telling_shares(texts, toxic + ordinary, ordinary), [shares_by_hand(t, toxic + ordinary, ordinary) for t in texts])


def test_calibration_has_the_fewest_errors():
    rng = np.random.default_rng(0)
    toxic = (rng.random(400) < 0.4).astype(int)
    shares = np.round(np.clip(rng.normal(0.1 + 0.15 * toxic, 0.08), 0, 1), 2)
    counts = {0: 9000, 1: 500}
    weight = {y: counts[y] / (toxic == y).sum() for y in (0, 1)}

    def errors(threshold):
        return sum(weight[y] for s, y in zip(shares, toxic) if (s >= threshold) != (y == 1))

    threshold, _ = toxicity.calibrated(shares, toxic, counts)
    assert errors(threshold) <= min(errors(t) for t in [*(np.unique(shares[shares > 0]) - 1e-9), 2.0]) + 1e-6


def test_insults_in_a_long_text_and_short_words(spark):
    """A stretch of insults in a long text is found, and so are insults of three letters."""
    rng = np.random.default_rng(6)
    plain = [f"{a}{b}" for a in ("wan", "tel", "mor", "sil", "por", "gan") for b in ("der", "low", "tin", "ker", "dam")]

    def prose(n, share=0.0):
        return " ".join("zut" if rng.random() < share else str(w) for w in rng.choice(plain, n))

    rows = [(i, prose(60, 0.4) if i % 2 else prose(60)) for i in range(600)]
    rows += [(10_000 + i, prose(3000) + " " + prose(90, 0.4 if i % 2 else 0.0) + " " + prose(3000)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    found = toxicity.judged(docs, labels).where("held_out").collect()
    for kind in (True, False):
        some = [r for r in found if (r["doc_id"] >= 10_000) is kind]
        assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in some]) >= 0.95


def test_a_repeated_id_reaches_the_driver_once(spark):
    docs = spark.range(3000).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    sample, _ = toxicity.training_sample(docs, spark.createDataFrame([(7, 1, 1)], "doc_id long, quality int, toxic int"))
    assert [tuple(r) for r in sample.collect()] == [(7, 1, "text 999")]


@pytest.mark.parametrize("sizes, max_bits", [([1, 2, 40, 256, 3], 2), ([300], 1), ([5] * 50, 3), ([], 2), ([1], 2), ([64], 0)])
def test_pivots_discard_pairs_and_lose_none(sizes, max_bits):
    """All near pairs of a group and no others; of groups of unlike fingerprints few pairs are left to be verified."""
    rng = np.random.default_rng(5)
    groups = np.repeat(np.arange(len(sizes)), sizes)
    fps = rng.integers(0, 1 << 63, len(groups), dtype=np.uint64)
    for i in range(0, len(fps) - 1, 7):  # chains of fingerprints a few bits apart
        fps[i + 1] = fps[i] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, i % 5, replace=False)))
    expected = {
        (i, j) for i in range(len(fps)) for j in range(i + 1, len(fps))
        if groups[i] == groups[j] and bin(int(fps[i] ^ fps[j])).count("1") <= max_bits
    }
    a, b = simhash.near_pairs(groups, fps, max_bits)
    found = [tuple(sorted(map(int, p))) for p in zip(a, b)]
    assert len(found) == len(set(found)) and set(found) == expected
    order, table = simhash.pivot_order(groups, fps)
    left = sum(len(x) for x, _ in simhash.pairs_by_pivots(groups[order], table, max_bits))
    everything = sum(n * (n - 1) // 2 for n in sizes)
    assert len(expected) <= left <= len(expected) + everything // 100
