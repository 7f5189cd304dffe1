"""Toxicity by compression distance: windows are compressed with a toxic and with an ordinary zstandard dictionary."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.common import checkpointed, id_and_text, lower_ascii, ship_package

SAMPLE_ROWS = 4000  # labelled rows per class that the dictionaries and the threshold are fitted on, at most
DICTIONARY_BYTES = 4096  # telling word starts beyond it, those of least evidence, are left out; they rarely fill 200 bytes
WINDOW_WORDS = 6
STRETCH = 16  # windows in a row whose densest occurrence is judged besides the whole text
MIN_SAVING = 3  # bytes
MIN_MATCH = 6  # bytes; shorter matches are too common among ordinary words, so short words count with the next one
SMOOTHING = 4  # windows without finding that every text has besides its own
DECISION = 0.7
STEM_CHARS = (4, 9)  # starts of words, the blank before them included
MIN_USES = 3
MIN_RATIO, MIN_EVIDENCE = 6.0, 25.0  # the latter a likelihood ratio: chance about one in a million
# Both dictionaries end with this, and every window begins with it: so no window is stored without compression.
PREAMBLE = bytes(range(128, 176))
_PLAIN = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_SEARCH = dict(
    strategy=zstandard.STRATEGY_LAZY2, min_match=MIN_MATCH, window_log=14, chain_log=12, hash_log=12, search_log=4,
    target_length=16, write_checksum=False, write_content_size=False, write_dict_id=False,
)


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibrated decisions on the share of telling windows, in the whole text and in its
    densest stretch."""

    toxic: bytes
    ordinary: bytes
    threshold: float
    slope: float
    dense_threshold: float = 2.0  # never reached
    dense_slope: float = 20.0

    @property
    def empty(self) -> bool:
        return not self.toxic


def is_training(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from; all others are held out."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def windows(text: str, words: int = WINDOW_WORDS) -> list[bytes]:
    """The whole text in windows of ``words`` words: A-Z lower-cased, everything in ASCII but letters a blank."""
    found = text.encode().translate(_PLAIN).split()
    return [b" " + b" ".join(found[i : i + words]) + b" " for i in range(0, len(found), words)]


def _press(content: bytes):
    dictionary = zstandard.ZstdCompressionDict(content + PREAMBLE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters(**_SEARCH)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress


def telling_shares(texts: list[str], toxic: bytes, ordinary: bytes) -> np.ndarray:
    """Per text the smoothed share of windows that the toxic dictionary shortens by ``MIN_SAVING`` bytes or more: over the
    whole text, and in the stretch of ``STRETCH`` windows that has most of them."""
    by_toxic, by_ordinary = _press(toxic), _press(ordinary)
    out = np.zeros((len(texts), 2))
    for i, text in enumerate(texts):
        parts = (PREAMBLE + part for part in windows(text))
        telling = np.array([len(by_ordinary(w)) - len(by_toxic(w)) >= MIN_SAVING for w in parts], np.int64)
        sums = np.concatenate([[0], np.cumsum(telling)])
        width = min(STRETCH, len(telling))
        densest = (sums[width:] - sums[: len(sums) - width]).max()
        out[i] = sums[-1] / (len(telling) + SMOOTHING), densest / (width + SMOOTHING)
    return out


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, text, toxic`` of at most ``rows`` labelled training rows per class, and how many each class has.

    The rows with the smallest hash of their id are taken, so the sample does not depend on the order of the tables.
    A document with several labels is toxic if one of them says so; of an id with several rows the largest text counts.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & is_training(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    found = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")), counts


def _places(sample: DataFrame) -> DataFrame:
    """``toxic, word, before, after`` of the sample's words, each place once.

    Places with the same word before and after are one place, so copies of a text and repetitions within count once.
    """
    plain = F.regexp_replace(lower_ascii(F.col("text")), "[\\x00-\\x60\\x7b-\\x7f]+", " ")
    words = sample.select("toxic", F.split(F.btrim(plain), " ").alias("words"))
    around = (F.get("words", F.col("at") - 1).alias("before"), F.get("words", F.col("at") + 1).alias("after"))
    places = words.select("toxic", "words", F.posexplode("words").alias("at", "word")).where("word <> ''")
    return places.select("toxic", "word", *around)


def _class_sums() -> list[Column]:
    return [F.sum((F.col("toxic") == y).cast("long")).alias(f"uses{y}") for y in (0, 1)]


def stem_counts(sample: DataFrame) -> DataFrame:
    """``stem, uses0, uses1``: word starts of the sample and in how many places each class uses them.

    A word shorter than any match has one stem, the whole word between blanks.
    """
    place = F.xxhash64(F.struct("word", "before", "after"))
    distinct = _places(sample).select("toxic", "word", place.alias("place")).distinct()
    framed = distinct.groupBy("word").agg(*_class_sums())
    framed = framed.withColumn("word", F.concat(F.lit(" "), "word", F.lit(" "))).withColumn(
        "chars", F.char_length("word")
    )
    low, high = STEM_CHARS
    lengths = F.filter(F.sequence(F.lit(1), F.lit(high)), lambda n: (n <= F.col("chars")) & (n >= F.least(F.lit(low), "chars")))
    starts = F.transform(lengths, lambda n: F.substring(F.col("word"), F.lit(1), n))
    stems = framed.select("uses0", "uses1", "word", F.explode(starts).alias("stem"))
    stems = stems.where((F.octet_length("stem") >= MIN_MATCH) | (F.col("stem") == F.col("word")))
    return stems.groupBy("stem").agg(F.sum("uses0").alias("uses0"), F.sum("uses1").alias("uses1"))


def framed_short_words(sample: DataFrame, short: list[str], size: int) -> list[str]:
    """Entries for words that are too short to be matched: the word and the start of the word after it, the ones most
    used by toxic text first."""
    wanted = [w.strip(" ") for w in short]
    pairs = _places(sample).where(F.col("word").isin(wanted) & F.col("after").isNotNull()).distinct()
    whole = F.concat(F.lit(" "), "word", F.lit(" "), "after", F.lit(" "))
    entry = F.substring(whole, F.lit(1), F.greatest(F.lit(MIN_MATCH), F.char_length("word") + 3))
    counted = pairs.select("toxic", entry.alias("entry")).where(F.octet_length("entry") >= MIN_MATCH)
    counted = counted.groupBy("entry").agg(*_class_sums()).where(F.col("uses1") > F.col("uses0"))
    return [r["entry"] for r in counted.orderBy(F.desc("uses1"), "entry").limit(size).collect()]


def _shortest(stems: list[str], size: int, without: list[str] = ()) -> list[str]:
    """The stems in their order, up to ``size`` bytes, without those that go on or begin one that is listed already.

    Nothing longer than needed: a part of an entry that lacks the blank in front would match within words.
    """
    out, used = [], 0
    listed = set(stems)
    for stem in stems:
        starts = {stem[:k] for k in range(1, len(stem))}
        related = any(stem.startswith(k) or k.startswith(stem) for k in [*without, *out])
        if related or starts & listed or used + len(stem.encode()) > size:
            continue
        out.append(stem)
        used += len(stem.encode())
    return out


def dictionaries(sample: DataFrame, size: int = DICTIONARY_BYTES) -> tuple[bytes, bytes]:
    """Toxic and ordinary dictionary from the sample's word starts.

    zstandard's own trainer keeps what is frequent, and most of a toxic text is ordinary language.  So the content is
    chosen by contrast: word starts that toxic text uses at least ``MIN_RATIO`` times as often as ordinary text, by a
    likelihood ratio that chance does not reach among all word starts.  The most widespread word starts of ordinary text
    are the ordinary dictionary and, as toxic text uses them too, the end of the toxic one: lengths then differ only by
    what is specific to toxic text.  A telling word that is too short to be matched enters with the words that follow
    it.  At most ``size`` word starts for each reach the driver.
    """
    counts = checkpointed(stem_counts(sample).where(F.col("uses0") + F.col("uses1") >= MIN_USES))
    total = counts.where(F.octet_length("stem") == MIN_MATCH).agg(F.sum("uses0"), F.sum("uses1")).first()
    n0, n1 = (float(n or 0) + 1 for n in total)
    both = F.col("uses0") + F.col("uses1")
    parts = [F.when(u == 0, 0.0).otherwise(u * F.log(u * (n0 + n1) / (both * n))) for u, n in
             ((F.col("uses0"), n0), (F.col("uses1"), n1))]
    ratio = (F.col("uses1") / n1) / ((F.col("uses0") + 0.5) / n0)
    judged_stems = counts.withColumn("evidence", 2 * (parts[0] + parts[1]))
    telling = judged_stems.where((ratio >= MIN_RATIO) & (F.col("evidence") >= MIN_EVIDENCE))
    telling = [r["stem"] for r in telling.orderBy(F.desc("evidence"), "stem").limit(size).collect()]
    short = [stem for stem in telling if len(stem.encode()) < MIN_MATCH]
    telling = [stem for stem in telling if len(stem.encode()) >= MIN_MATCH]
    telling += framed_short_words(sample, short, size) if short else []
    usual = counts.where(F.octet_length("stem") >= MIN_MATCH).orderBy(F.desc("uses0"), "stem")
    usual = [r["stem"] for r in usual.limit(size).collect()]
    toxic = _shortest(telling, size)
    ordinary = _shortest(usual, sum(len(t.encode()) for t in toxic), telling)
    shared = "".join(reversed(ordinary)).encode()
    return "".join(reversed(toxic)).encode() + shared, shared


def calibrated(shares: np.ndarray, toxic: np.ndarray, counts: dict[int, int], least: float = 0.0) -> tuple[float, float]:
    """Threshold and slope: the threshold with the fewest errors at the classes' true frequencies; out of reach if it
    does not spare more than ``least`` toxic rows of the sample."""
    weights = np.where(toxic == 1, counts[1] / max(1, (toxic == 1).sum()), counts[0] / max(1, (toxic == 0).sum()))
    order = np.argsort(-shares, kind="stable")
    s, gain = shares[order], np.cumsum(np.where(toxic[order] == 1, weights[order], -weights[order]))
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    ends = ends[s[ends] > 0]
    if not len(ends):
        return 2.0, 20.0
    best = ends[np.argmax(gain[ends])]
    if gain[best] < least * counts[1] / max(1, (toxic == 1).sum()):
        return 2.0, 20.0
    below = s[best + 1] if best + 1 < len(s) else 0.0
    return float((s[best] + below) / 2), float(2.0 / max(s[best] / 2, 1e-3))


def fit_decisions(shares: np.ndarray, toxic: np.ndarray, counts: dict[int, int]) -> tuple[float, float, float, float]:
    """Threshold and slope for the whole text, then for the densest stretch of the rows that the first one passes."""
    threshold, slope = calibrated(shares[:, 0], toxic, counts)
    left = np.where(shares[:, 0] < threshold, shares[:, 1], 0.0)
    return threshold, slope, *calibrated(left, toxic, counts, MIN_USES)


def scores(shares: np.ndarray, model: Model) -> np.ndarray:
    """The larger of two logistics, in the share of the whole text and of its densest stretch; the decision value lies at
    either threshold."""
    at = np.log(DECISION / (1 - DECISION))
    whole = model.slope * (shares[:, 0] - model.threshold)
    dense = model.dense_slope * (shares[:, 1] - model.dense_threshold)
    return 1 / (1 + np.exp(-np.clip(at + np.maximum(whole, dense), -60, 60)))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of labelled training rows; ``docs`` has ``doc_id, text``."""
    ship_package(docs.sparkSession)
    sample, counts = training_sample(docs, labels, rows)
    if not counts.get(0) or not counts.get(1):
        return Model(b"", b"", 1.0, 20.0)
    toxic, ordinary = dictionaries(sample)
    if not toxic:
        return Model(b"", b"", 1.0, 20.0)
    fitted = sample.select("toxic", shares_of(F.col("text"), toxic, ordinary).alias("shares")).collect()
    shares, y = np.array([r["shares"] for r in fitted]), np.array([r["toxic"] for r in fitted])
    return Model(toxic, ordinary, *fit_decisions(shares, y, counts))


def shares_of(text: Column, toxic: bytes, ordinary: bytes) -> Column:
    """Both shares of each text."""

    @F.arrow_udf("array<double>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array(telling_shares(texts.to_pylist(), toxic, ordinary).tolist(), pa.list_(pa.float64()))

    return found(text)


def score(text: Column, model: Model) -> Column:
    """The score of each text, 0 to 1.  Only the text goes to Python; every window is compressed twice, in place."""

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        if model.empty:
            return pa.array(np.zeros(len(texts)))
        return pa.array(scores(telling_shares(texts.to_pylist(), model.toxic, model.ordinary), model))

    return judge(text)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the labelled training rows of ``docs`` and score all rows: ``doc_id, held_out, score, predicted``.

    Nothing but the bounded training sample is shuffled.

    Defined cases: null and empty texts and texts without letters have no window and get the lowest score.  In a very
    long text, whose share of telling windows is small, the densest stretch decides.  Null and
    repeated ids pass through, row for row; a null id counts as not held out but has no label.  Where the training rows
    lack a class, every score is 0.  No rows give no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    ship_package(docs.sparkSession)
    held_out = F.coalesce(~is_training(F.col("doc_id")), F.lit(False))
    found = rows.select("doc_id", held_out.alias("held_out"), score(F.col("text"), train(rows, labels)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= DECISION).cast("int"))
