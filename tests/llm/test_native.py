"""Exact and line deduplication, sharding and the address filter against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dwellgrid.llm import exact_dedup, line_dedup, oracle, queries, sharding, url_filter

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    result = con.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in result.description]
    mine = queries.queries()[name](spark, SMALL).select(names).collect()
    assert sorted(map(tuple, mine), key=key) == sorted(map(tuple, result.fetchall()), key=key)


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, sha(text)) for i in ids]
    return sorted(out, key=key)


def test_exact_groups(messy, messy_rows):
    assert sorted(map(tuple, exact_dedup.exact_groups(messy).collect()), key=key) == exact_by_hand(messy_rows)


def test_bytes_are_compared_within_a_hash_group(messy, messy_rows):
    found = exact_dedup.exact_groups(messy, content_hash=lambda text: (F.lit(1).cast("long"), F.lit(2).cast("long")))
    assert sorted(map(tuple, found.collect()), key=key) == exact_by_hand(messy_rows)


def test_one_weak_half_of_the_hash(messy, messy_rows):
    found = exact_dedup.exact_groups(messy, content_hash=lambda text: (F.length(text).cast("long"), F.xxhash64(text)))
    assert sorted(map(tuple, found.collect()), key=key) == exact_by_hand(messy_rows)


def test_only_texts_of_repeated_hashes_move(spark):
    rows = [(i, f"own text {i}") for i in range(-500, 500)] + [(1000 + i, f"copied {i % 40}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, norm string")
    hashed = docs.select("*", *(h.alias(n) for h, n in zip(exact_dedup.two_hashes(F.col("norm")), ("h1", "h2"))))
    repeated = hashed.groupBy("h1", "h2").count().where("count > 1")
    passed = [r["doc_id"] for r in exact_dedup._maybe_repeated(hashed, repeated).collect()]
    assert {i for i in passed if i >= 1000} == set(range(1000, 1400))
    assert len(passed) <= 402  # a text of its own passes only where its bit of 2^27 is taken


def test_the_hash_of_every_row_and_blanks_of_all_kinds(spark):
    texts = ["a b", "a  b", "a\tb", "a\x0b\r\n b", " a b", "a b ", "a\u00a0b", "a\x1cb", "", " ", "\t"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.exact_groups(docs).collect()), key=key) == exact_by_hand(list(enumerate(texts)))


def test_exact_groups_of_nothing(nothing):
    assert exact_dedup.exact_groups(nothing).collect() == []


def test_exact_groups_without_any_id(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in exact_dedup.exact_groups(rows).collect()] == [(None, None, 2, True)] * 2


def lines_by_hand(rows, min_chars=20, min_documents=3):
    def keyed(line):
        return lowered(line.strip(BLANKS))

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[keyed(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            docs = holders[keyed(line)]
            last = max((d for d in docs if d is not None), default=None)
            if len(keyed(line)) < min_chars or len(docs) < min_documents or i == last:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=key)


def test_lines(messy, messy_rows):
    found = sorted(map(tuple, line_dedup.deduplicated(messy).collect()), key=key)
    assert found == lines_by_hand(messy_rows)
    assert sum(r[2] for r in found) > 0


def test_lines_keep_extra_columns(messy):
    found = line_dedup.deduplicated(messy, extra=("source", "part", "lines")).collect()
    assert {(r["source"], r["part"], r["lines"]) for r in found} == {("src", 2, "l")}


def test_a_line_in_very_many_documents(spark):
    text = "the very same line stands here"
    rows = [(i, f"own {i}\n{text}\n{text}") for i in range(3000)] + [(5000, None)]
    found = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["n_dropped"] for r in found) == {2: 2999, 0: 2}
    assert {r["doc_id"] for r in found if r["n_dropped"] == 0} == {2999, 5000}


def test_lines_of_nothing(nothing):
    assert line_dedup.deduplicated(nothing).collect() == []


def test_bitmaps_are_runs(spark):
    shared = [f"shared line number {n} of all" for n in range(4)]
    texts = ["\n".join([shared[0], shared[1], "own", shared[2], shared[3]])] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = line_dedup.keep_bitmaps(docs).where("doc_id = 0").collect()
    assert [tuple(r) for r in found[0]["dropped"]] == [(0, 1), (3, 4)] and found[0]["n_dropped"] == 4


def check_shards(found, rows, shards):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode())))
    sizes = [len((t or "").encode()) + 1 for _, t in order]
    total, before = sum(sizes), 0
    expected, slots = [], Counter()
    for (i, t), size in zip(order, sizes):
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        expected.append((i, size, zlib.crc32((t or "").encode()), shard, slots[shard], before))
        slots[shard] += 1
        before += size
    assert sorted(found, key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("shards", [1, 8])
def test_shards(messy, messy_rows, shards):
    found = [tuple(r) for r in sharding.contiguous_shards(messy, shards).collect()]
    check_shards(found, messy_rows, shards)


def test_shards_are_near_equal(spark):
    found = queries.op5_sharding(spark, SMALL).collect()
    bytes_of = Counter()
    for r in found:
        bytes_of[r["shard"]] += r["size"]
    largest = max(r["size"] for r in found)
    assert max(bytes_of.values()) - min(bytes_of.values()) <= 2 * largest and len(bytes_of) == 8


def test_shards_of_nothing(nothing):
    assert sharding.contiguous_shards(nothing).collect() == []


URLS = [
    None,
    "",
    "no scheme",
    "http://A.Example.NET/en/x?q=1",
    "http://example.net/en",
    "http://a.net",
    "http://a.net?x=/",
    "http://notexample.com/de/1",
    "https://b.example.com/de/#top",
    "https://x.org/fr/://y.net/",
    "ftp://org/fr/",
    "http://u@host:80/p#://",
    "http://casino-win.example.org/play",
    "http://" + "a" * 20000 + ".example.org/" + "b" * 20000,
]


def parts_by_hand(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return lowered(host), re.match("[^?#]*", rest[len(host) :])[0]


def rule_by_hand(host, path):
    fits = []
    for rule, _ in url_filter.RULES:
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fits.append(rule)
    return max(fits, key=len, default=None)


def grams_by_hand(host, path):
    out = set()
    for n in url_filter.N_GRAMS:
        for mark, text in (("h", f"<{host}>"), ("p", f"<{path}>")):
            out |= {mark + text[i : i + n] for i in range(max(1, len(text) - n + 1))}
    return out


def test_addresses(spark):
    columns = "page_id long, url string, rule string, host string"
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], columns)
    found = {r["page_id"]: r for r in url_filter.judged(pages).collect()}
    for i, url in enumerate(URLS):
        host, path = parts_by_hand(url)
        rule = rule_by_hand(host, path)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule)
        if rule:
            assert found[i]["verdict"] == dict(url_filter.RULES)[rule]
    assert found[12]["verdict"] == "block" and found[0]["verdict"] in ("allow", "block")


def test_addresses_of_nothing(spark):
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_verdicts_against_plain_regression(spark):
    """Gradient descent on unhashed n-grams reaches the same verdicts."""
    labelled = [(u, 1.0) for u in url_filter.UNWANTED] + [(u, 0.0) for u in url_filter.ORDINARY]
    grams = [grams_by_hand(*parts_by_hand(u)) for u, _ in labelled]
    index = {g: k for k, g in enumerate(sorted(set().union(*grams)))}
    x = np.zeros((len(grams), len(index)))
    for row, found in zip(x, grams):
        row[[index[g] for g in found]] = 1
    y, w, b = np.array([v for _, v in labelled]), np.zeros(len(index)), 0.0
    for _ in range(4000):
        slope = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= 0.1 * (x.T @ slope / len(y) + 0.01 * w)
        b -= 0.1 * slope.mean()
    different = total = 0
    for r in queries.op10_url_filter(spark, MEDIUM).collect():
        if r["rule"] is None:
            margin = sum(w[index[g]] for g in grams_by_hand(r["host"], r["path"]) if g in index) + b
            if abs(margin) > 0.5:  # hashing and the stopping rule move margins a little
                total += 1
                different += (margin > 0) != (r["verdict"] == "block")
    assert total > 50 and different == 0


def test_unwanted_hosts_are_blocked(spark):
    table = pq.read_table(f"{MEDIUM}/pages.parquet").to_pylist()
    found = {r["page_id"]: r for r in queries.op10_url_filter(spark, MEDIUM).collect()}
    assert len(found) == len(table)
    for page in table:
        r = found[page["page_id"]]
        if r["rule"] is None:
            bad = bool(re.search("casino|pills|spam|free-bets", r["host"]))
            assert not bad or r["verdict"] == "block"


# Hosts that the training table does not hold.  The table was enlarged and balanced after they had been scored.
UNSEEN = {
    "gambling": "mega-casino casino-palace poker-room vegas-slots bet-master jackpot-city betting-tips spin-casino",
    "pharmacy": "pills-direct meds-express viagra-store discount-pharmacy pills-4u buy-meds slim-pills",
    "link spam": "spam-king linkfarm seo-spam cheap-backlinks link-spam mass-links",
    "adult": "adult-zone adult-videos xxx-zone sexy-cams porn-hub hot-sex adult-y pornstars",
    "advertising": "ads-central ad-serving adserver my-ads adsrv banner-farm ads-24 click-ads",
    "tracking": "track-me trackers ad-tracker pixel-tracker tracking-server usertrack web-track",
    "money": "instant-loans payday-cash fast-money loans-online cash-advance",
    "piracy": "crack-download free-warez torrent-king movies-torrent serial-keygen",
    "counterfeit": "replica-rolex fake-rolex watches-replica fake-handbags",
}
OTHER_FAMILIES = "phishing-kit stolen-cards hack-accounts fake-passport miracle-cure gore-clips botnet-rental"
UNSEEN_ORDINARY = """
    botany cathedral folk-dance bakery swimming-pool orchestra parish-church cycling-routes astronomy poetry-corner
    kindergarten fire-brigade mountain-huts knitting allotments philosophy law-review harbour village-hall opera
    geography castle-ruins beekeeping chamber-music canal-boats butterfly-survey local-archives tree-nursery
    oak-furniture painting-course grammar-school hospital-radio choir parliament water-board choral-society
    adder-snakes roadside-flowers leadership salads-and-soups trackside-photos racetrack-history tractor-museum
    betony-farm sorbet-recipes diabetes-care pillar-box-society spamalot-theatre adult-literacy sextant-makers
    wessex-archaeology windmills winchester cashew-growers linkoping-city seoul-guide casimir-effect slotted-spoons
    tracking-wildlife freehold-law downloadable-maps cheapside-history moneypenny-novels crackers-and-cheese
""".split()
# A second set, scored before the last enlargement and balancing.  The README's figures are those of both sets.
FRESH = {
    "gambling": "grand-casino poker-club slots-world bets-online jackpot-party betting-zone casino-bonus lucky-roulette",
    "pharmacy": "pills-market meds-4-less viagra-online pharmacy-deals sleeping-pills generic-meds",
    "link spam": "spam-hub links-farm seo-links-shop backlinks-market spam-network",
    "adult": "adult-club xxx-club porn-videos sex-tube adult-world hot-cams erotic-chat",
    "advertising": "ads-delivery ad-network adserving ads-pool banner-clicks popads",
    "tracking": "click-tracker track-stats user-tracking pixel-stats trackit beacon-track",
    "money": "payday-now fast-cash easy-loans get-money-fast",
    "piracy": "warez-download crack-games torrent-site keygen-free",
    "counterfeit": "replica-store fake-bags cheap-replicas rolex-copy",
}
FRESH_ORDINARY = """
    bridge-builders candle-making drystone-walls embroidery fossils glaciers hedgehog-rescue ink-drawing juggling
    kayak-tours lighthouse-trust marine-biology needlework origami puppet-theatre quarry-museum rugby-club
    saxophone-teachers tapestry upholstery village-green watercolour yoga-studio zebra-crossings adders-of-britain
    castanets casing-repair sextet pokerwork-crafts slot-cars cashmere-goats loan-collection spa-towns medieval-seals
    pillion-riders trackless-forests tracks-in-snow badger-watch road-safety betony alphabet-books farmhouse-cheese
    moneylenders-in-history fakenham-news replicas-of-dinosaurs streaming-rivers cracked-pots-repair adult-choir
    linked-lists serial-novels
""".split()
SAMPLE_UNWANTED = "casino-win free-bets cheap-pills spam-farm ads-track adult-x".split()


def blocked_hosts(spark, hosts):
    """Shares of addresses without a rule that the model blocks, per host over domains and paths."""
    shapes = ("https://{}.example.com/en/31", "http://www.{}.example.org/de/8.html", "https://m.{}.org/es/2/")
    pages = [(i, shape.format(h)) for i, h in enumerate(hosts) for shape in shapes]
    found = url_filter.judged(spark.createDataFrame(pages, "page_id long, url string")).collect()
    assert all(r["rule"] is None for r in found)
    blocked = Counter(r["page_id"] for r in found if r["verdict"] == "block")
    return np.array([blocked[i] / len(shapes) for i in range(len(hosts))])


def test_training_hosts_are_not_those_of_the_tests_or_the_sample():
    trained = set(" ".join(url_filter.UNWANTED_HOSTS.values()).split()) | set(url_filter.ORDINARY_HOSTS.split())
    urls = pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["url"]).column(0).to_pylist()
    sample = {re.sub("^(www|m|blog)[.]", "", parts_by_hand(u)[0]).split(".example.")[0] for u in urls}
    tested = set(" ".join([*UNSEEN.values(), *FRESH.values(), OTHER_FAMILIES]).split())
    tested |= {*UNSEEN_ORDINARY, *FRESH_ORDINARY}
    assert set(SAMPLE_UNWANTED) <= sample and not trained & (sample | tested)


def test_unwanted_families_are_blocked(spark):
    """All families, by hosts that the training table lacks; ordinary hosts, half of them look-alikes, mostly pass."""
    known = [h for sets in (UNSEEN, FRESH) for hosts in sets.values() for h in hosts.split()]
    ordinary = UNSEEN_ORDINARY + FRESH_ORDINARY
    asked = [*SAMPLE_UNWANTED, *known, *OTHER_FAMILIES.split(), *ordinary]
    share = dict(zip(asked, blocked_hosts(spark, asked)))
    assert all(share[h] == 1 for h in SAMPLE_UNWANTED)
    assert np.mean([share[h] for h in known]) >= 0.8
    for family in UNSEEN:
        assert np.mean([share[h] for h in (UNSEEN[family] + " " + FRESH[family]).split()]) >= 0.5, family
    assert np.mean([share[h] for h in ordinary]) <= 0.15
    # Families that the table does not know are not found: a limit that the README states.
    assert np.mean([share[h] for h in OTHER_FAMILIES.split()]) <= 0.5


def test_advertising_and_adult_hosts_of_the_sample(spark):
    found = queries.op10_url_filter(spark, MEDIUM).where("rule IS NULL").collect()
    unwanted = [r for r in found if re.search("|".join(SAMPLE_UNWANTED), r["host"])]
    assert any("ads-track" in r["host"] for r in unwanted) and {r["verdict"] for r in unwanted} == {"block"}
    assert {r["verdict"] for r in found if r not in unwanted} == {"allow"}
