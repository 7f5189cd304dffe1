"""Benchmark decontamination: broadcast set of item word n-grams, document windows scanned in place, hits verified."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.llm.common import lower_ascii, written

WINDOW = 10
NO_WORD = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"  # in text whose A-Z are lower-cased
NO_WORD_ANY_CASE = "\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F"
# Bytes of item windows that one pass over the documents may broadcast; more windows take more passes.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64  # of a broadcast row besides its text


def words(text: Column) -> Column:
    """The words of ``text``: runs of digits, letters a-z in any case, and characters beyond ASCII, lower-cased."""
    return F.array_remove(F.split(lower_ascii(text), f"[{NO_WORD}]+"), "")


def _shifted(name: str, by: int) -> Column:
    return F.slice(name, F.lit(by + 1), F.size(name))


def with_window_hashes(rows: DataFrame, length: int) -> DataFrame:
    """``rows`` with ``z<length>``: for each place of ``words`` a 64-bit hash of the ``length`` words from there on.

    Hashes of 1, 2, 4 and 8 words are combined pairwise, each in a column of its own, so the work per word does not grow
    with the length.  At places where fewer words are left the value means nothing; verification meets no equal words there.
    """
    if "z1" not in rows.columns:
        rows = rows.withColumn("z1", F.transform("words", lambda w: F.xxhash64(w)))
    done, step = 0, 1 << (length.bit_length() - 1)
    while step:
        power = 1
        while power < step:
            if f"z{2 * power}" not in rows.columns:
                rows = _combined(rows, power, power)
            power *= 2
        if length & step:
            if done and f"z{done + step}" not in rows.columns:
                rows = _combined(rows, done, step)
            done += step
        step //= 2
    return rows


def _combined(rows: DataFrame, first: int, second: int) -> DataFrame:
    both = F.zip_with(f"z{first}", _shifted(f"z{second}", first), lambda a, b: F.xxhash64(a, b))
    return rows.withColumn(f"z{first + second}", both)


def item_windows(benchmark: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """``item_id, len, text``: every window of every item; an item of fewer words than a window is one."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("words")).where(
        F.size("words") > 0
    )
    last = F.greatest(F.size("words") - length, F.lit(0))
    placed = items.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    text = F.array_join(F.slice("words", F.col("at") + 1, length), " ")
    return placed.select("item_id", F.least(F.size("words"), F.lit(length)).alias("len"), text.alias("text")).distinct()


def _with_hash(windows: DataFrame, lengths: list[int]) -> DataFrame:
    rows = windows.withColumn("words", F.split("text", " "))
    for n in lengths:
        rows = with_window_hashes(rows, n)
    of_length = F.coalesce(*[F.when(F.col("len") == n, F.get(f"z{n}", F.lit(0))) for n in lengths])
    return rows.select(*windows.columns, of_length.alias("h"))


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for a row's id and text; rows equal in both have equal results."""
    return F.md5(F.concat_ws(":", doc_id.cast("string"), F.coalesce(text, F.lit(""))))


def _scanned(docs: DataFrame, windows: DataFrame, lengths: list[int], blocks: int) -> DataFrame:
    """``doc_id, key, n_words, at, len, wid``: one row per document without a place, and one per verified window in it."""
    rows = docs.withColumn("words", words(F.col("text")))
    for n in lengths:
        rows = with_window_hashes(rows, n)
    # The first entry stands for the document itself and finds the row without a window.
    hashes = F.concat(F.array(F.lit(0).cast("long")), *[f"z{n}" for n in lengths])
    # posexplode_outer: Spark would test the size of what a plain posexplode gets, and compute all of it twice for that
    placed = rows.select("doc_id", "key", "words", F.posexplode_outer(hashes).alias("place", "h"))
    at = F.pmod(F.col("place") - 1, F.size("words"))
    itself = F.struct(F.lit(0).cast("long").alias("h"), *[F.lit(None).cast(k).alias(n) for n, k in _WINDOW_TYPES])
    found = []
    for block in range(blocks):
        some = windows.where(F.pmod("h", F.lit(blocks)) == block).select("h", "len", "text", "wid")
        if block == 0:
            one = docs.sparkSession.range(1).select(itself.alias("row")).select("row.*")
            some = some.unionByName(one)
        met = placed.join(F.broadcast(some), "h")
        verified = (F.col("place") > 0) & (F.array_join(F.slice("words", at + 1, F.col("len")), " ") == F.col("text"))
        document = (F.col("place") == 0) & F.col("wid").isNull()
        found.append(
            met.where(document | verified).select(
                "doc_id", "key", F.size("words").cast("long").alias("n_words"), F.when(~document, at).alias("at"), "len", "wid"
            )
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_WINDOW_TYPES = (("len", "int"), ("text", "string"), ("wid", "long"))


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    length: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """``(found, items)``: verified windows of all documents, see ``_scanned``, and ``wid, item_id`` of every window.

    The distinct item windows are written once; their hashes are broadcast, in as many passes over the documents as keep
    one broadcast within ``broadcast_bytes``.  Document windows never leave their task unless they are hits.
    """
    windows = written(item_windows(benchmark, length, item_col, item_text_col), "item-windows")
    size = F.sum(F.octet_length("text") + ROW_BYTES)
    bounds = windows.agg(F.collect_set("len").alias("lengths"), size.alias("bytes")).first()  # at most ``length`` values
    lengths = sorted(bounds["lengths"]) or [length]
    distinct = _with_hash(windows.select("len", "text").distinct(), lengths)
    distinct = written(distinct.withColumn("wid", F.monotonically_increasing_id()), "distinct-windows")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        row_key(F.col(id_col), F.col(text_col)).alias("key"),
    )
    blocks = max(1, math.ceil((bounds["bytes"] or 0) / broadcast_bytes))
    found = written(_scanned(rows, distinct, lengths, blocks), "window-hits")
    items = windows.join(distinct, ["len", "text"]).select("wid", "item_id").where("item_id IS NOT NULL")
    return found, items


def spans(found: DataFrame) -> DataFrame:
    """``key, start, stop``: disjoint stretches of hit words, in words from the start of the text.

    Windows at one place are reduced to the longest before the shuffle; a document's places then stream in order.
    """
    longest = found.where("at IS NOT NULL").groupBy("key", "at").agg(F.max("len").alias("len"))
    before = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("at") + F.col("len")
    reached = longest.select("key", "at", stop.alias("stop"), F.max(stop).over(before).alias("reached"))
    cut = reached.select("key", F.greatest("at", "reached").alias("start"), "stop")  # greatest skips null
    return cut.where("stop > start")


def judged(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, **options) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``n_hit`` counts the words that lie inside an occurrence of an item's window, ``n_items`` the items with occurring
    windows; ``items_sha256`` is the hash of their ids, sorted as strings and joined by commas.

    Defined cases: a null or empty text has no words and is clean; the same holds for items, which then have no windows.
    An item without id marks words but is not counted; repeated item ids are one item, and one window may belong to any
    number of items.  Null and repeated document ids pass through, row for row.  Texts of any length are scanned whole, a
    row at a time.  Without items all documents are clean; no documents give no rows.
    """
    found, items = hits(docs, benchmark, length, **options)
    n_hit = spans(found).groupBy("key").agg(F.sum(F.col("stop") - F.col("start")).cast("long").alias("n_hit"))
    of_items = found.where("wid IS NOT NULL").select("key", "wid").distinct().join(items, "wid")
    of_items = of_items.select("key", F.col("item_id").cast("string").alias("item")).distinct()
    listed = of_items.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    marked = n_hit.join(listed, "key", "left")
    # The key in a form to which the aggregate's partitioning does not carry: the join shuffles either side by itself, so
    # that adaptive execution can split a key that very many rows share.
    marked = marked.withColumn("key", F.concat("key", F.lit("")))
    result = found.where("at IS NULL").select("doc_id", "key", "n_words").join(marked, "key", "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return result.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    whole_documents: bool = False,
    length: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """``docs`` without contaminated text: hit words go with all characters up to the next word that stays, or, with
    ``whole_documents``, every document that has a hit goes.  All columns are kept; clean rows stay as they are."""
    found, _ = hits(docs, benchmark, length, id_col, text_col, **options)
    cuts = spans(found).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    by_key = docs.select(F.struct("*").alias("row"), row_key(F.col(id_col), F.col(text_col)).alias("key"))
    own = cuts.select(F.concat("key", F.lit("")).alias("key"), "cuts")
    if whole_documents:
        return by_key.join(own, "key", "left_anti").select("row.*")
    text = F.col(f"row.{text_col}")
    pieces = F.regexp_extract_all(text, F.lit(f"[^{NO_WORD_ANY_CASE}]+[{NO_WORD_ANY_CASE}]*"), F.lit(0))
    head = F.regexp_extract(text, f"^[{NO_WORD_ANY_CASE}]*", 0)
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["stop"]))
    stops = F.concat(F.transform("cuts", lambda c: c["start"]), F.array(F.size("pieces")))
    kept = F.zip_with(starts, stops, lambda a, b: F.array_join(F.slice("pieces", a + 1, b - a), ""))
    cut_text = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(head, F.array_join(kept, "")))
    joined = by_key.join(own, "key", "left").withColumn("pieces", F.when(F.col("cuts").isNotNull(), pieces))
    return joined.select(F.col("row").withField(text_col, cut_text).alias("row")).select("row.*")
