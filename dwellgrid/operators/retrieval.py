"""Rows as text, chunks, vectors, gated nearest neighbours and diversity re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellgrid.functions.clock import whole
from dwellgrid.schema import CHUNK_OVERLAP, CHUNK_SIZE, MMR_FETCH, MMR_LAMBDA, RETRIEVAL_K, SCORE_GATE

# Query vectors per block; the result does not depend on it.
QUERIES_PER_BLOCK = 1024


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """``name: value`` lines of a row, names sorted, NULL and NaN left out."""
    lines = []
    for name in sorted(columns or df.columns):
        value = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"))))
    return F.concat_ws("\n", *lines)


def documents_of(df: DataFrame, source: str) -> DataFrame:
    """``source, text``: one document per row."""
    return df.select(F.lit(source).alias("source"), row_text(df).alias("text"))


def chunks(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_SIZE,
           overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``key, chunk_no, chunk``: character windows of ``size`` that share ``overlap`` characters with the next one.

    The text is cut once into blocks of ``size - overlap`` characters; a chunk is a block plus the head of the
    following one.  That is linear in the text, where repeated substrings of UTF-8 text are quadratic.  No chunk lies
    wholly inside its predecessor.
    """
    step = whole(size, "size", 1) - whole(overlap, "overlap")
    if not 0 < step or overlap > step:
        raise ValueError("overlap must be at most half the size")
    block = F.col("block")
    pieces = F.transform(
        F.col("blocks"),
        lambda b, i: F.struct(
            i.alias("chunk_no"),
            F.concat(b, F.coalesce(F.left(F.get(F.col("blocks"), i + 1), F.lit(overlap)), F.lit(""))).alias("chunk"),
            ((i == 0) | (F.length(b) > overlap)).alias("needed"),
        ),
    )
    return (
        documents.select(key, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("blocks"))
        .select(key, F.explode(pieces).alias("block"))
        .where(block["needed"])
        .select(key, block["chunk_no"].alias("chunk_no"), block["chunk"].alias("chunk"))
    )


# Where a text is cut first, paragraphs before lines before words.
SEPARATORS = ("\n\n", "\n", " ")


def separator_chunks(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_SIZE,
                     overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """``key, chunk_no, chunk``: chunks of at most ``size`` characters that end where paragraphs, lines or words do.

    A text is cut after every paragraph; a paragraph that is too long is cut after its lines, a line after its words, a
    word after ``size`` characters.  Pieces are joined from the left while they fit.  The next chunk begins with the last
    whole pieces of the one before, as many as ``overlap`` characters hold and leave room for a new piece.  Without the
    repeated pieces the chunks give the text, separators included.

    Defined cases: null and empty texts have no chunks; keys pass through, row for row; a text is held whole, its chunks
    leave the task a few hundred at a time.
    """
    whole(size, "size", 1), whole(overlap, "overlap")
    if overlap >= size:
        raise ValueError("overlap must be smaller than the size")
    key_type = documents.schema[key].dataType

    def pieces(part: str, level: int):
        if len(part) <= size:
            yield part
        elif level == len(separators):
            for at in range(0, len(part), size):
                yield part[at : at + size]
        else:
            mark, at = separators[level], 0
            while at < len(part):
                found = part.find(mark, at)
                end = len(part) if found < 0 else found + len(mark)
                yield from pieces(part[at:end], level + 1)
                at = end

    def chunks_of(whole_text: str):
        held, length = [], 0
        for piece in pieces(whole_text, 0):
            if length + len(piece) > size:
                yield "".join(held)
                while held and (length > overlap or length + len(piece) > size):
                    length -= len(held.pop(0))
            held.append(piece)
            length += len(piece)
        yield "".join(held)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            places, numbers, found = [], [], []

            def out():
                keys = batch.column(0).take(pa.array(places, pa.int64()))
                return pa.RecordBatch.from_arrays([keys, pa.array(numbers, pa.int32()), pa.array(found, pa.string())], [key, "chunk_no", "chunk"])

            for row, value in enumerate(batch.column(1)):
                if value.as_py():
                    for number, chunk in enumerate(chunks_of(value.as_py())):
                        places.append(row)
                        numbers.append(number)
                        found.append(chunk)
                        if len(found) == 512:
                            yield out()
                            places, numbers, found = [], [], []
            yield out()

    fields = [T.StructField(key, key_type), T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType())]
    return documents.select(key, text).mapInArrow(cut, T.StructType(fields))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, repeats included."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _own_shuffle(term: Column) -> Column:
    """The same text, in a form to which Spark does not carry an aggregate's partitioning: a join by it shuffles that
    side anew, a row per word, and adaptive execution can then split a word that very many rows share."""
    return F.concat(term, F.lit(""))


def _tails(rows: DataFrame, key: str, weight: str) -> Column:
    """Length of what is left of a row's vector from a word on, rarest words first, equally rare ones by name."""
    onward = W.partitionBy(key).orderBy(F.desc("idf"), "term").rowsBetween(W.currentRow, W.unboundedFollowing)
    return F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(onward))


def lexical_index(texts: DataFrame, key: str = "vec_id", text: str = "text") -> DataFrame:
    """``key, term, weight, idf, tail``: unit-length word vectors as rows, a stand-in where no embedding column exists.

    A word weighs its count times the logarithm of how rare it is among the texts.  Words are kept as they are, none
    folded into another, and words that all texts share weigh nothing and have no row.  ``tail`` is the length of the
    vector from this word on, rarest words first; the search leaves out what lies behind.  ``key`` must be unique.

    Texts are dealt by key before their words are counted: a file of a few megabytes holds many more words, and the task
    that reads it would otherwise keep the counts of all of them.  For the same reason the words are never broadcast.
    """
    width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select(key, text).repartition(width, key)
    uses = dealt.select(key, F.explode(words(F.col(text))).alias("term")).groupBy(key, "term")
    uses = uses.agg(F.count("*").alias("uses"))
    total = texts.agg(F.count("*")).scalar()
    spread = uses.groupBy("term").agg(F.log(total / F.count("*")).alias("idf")).where("idf > 0")
    spread = spread.select(_own_shuffle(F.col("term")).alias("term"), "idf")
    weighed = uses.hint("merge").join(spread, "term").withColumn("raw", F.col("uses") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))
    unit = weighed.select(key, "term", (F.col("raw") / norm).alias("weight"), "idf")
    return unit.withColumn("tail", _tails(unit, key, "weight"))


def lexical_queries(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, term, w, tail``: the questions as unit vectors over the index's words, with tails as in the index."""
    asked = queries.select("query_id", F.explode(words(F.col("text"))).alias("term")).groupBy("query_id", "term")
    rarity = index.groupBy("term").agg(F.min("idf").alias("idf")).select(_own_shuffle(F.col("term")).alias("term"), "idf")
    asked = asked.agg(F.count("*").alias("uses")).join(rarity, "term").withColumn("raw", F.col("uses") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("query_id")))
    unit = asked.select("query_id", "term", "idf", (F.col("raw") / norm).alias("w"))
    return unit.withColumn("tail", _tails(unit, "query_id", "w")).drop("idf")


def lexical_candidates(index: DataFrame, unit: DataFrame, gate: float | None, key: str = "vec_id") -> DataFrame:
    """``query_id, key``: every pair that can reach the gate, and few others.

    In one order of all words, rarest first, a pair's score is at most the product of the two tails at its first common
    word.  So only words whose tail reaches the gate are looked at, on either side, and of those only where the product
    does: a word that nearly all texts share is behind the gate in all but the shortest.  Without a gate every pair with
    a common word is a candidate.
    """
    least = max(0.0, (gate or 0.0) - 1e-6)  # errs towards more candidates than rounding could take away
    ours = unit.where(F.col("tail") >= least).select("query_id", "term", F.col("tail").alias("q_tail"))
    theirs = index.where(F.col("tail") >= least).select(key, "term", "tail").hint("merge")  # not broadcast, whatever its files weigh
    met = theirs.join(ours, "term").where(F.col("q_tail") * F.col("tail") >= least)
    return met.select("query_id", key).distinct()


def lexical_nearest(index: DataFrame, queries: DataFrame, k: int = RETRIEVAL_K, gate: float | None = SCORE_GATE,
                    key: str = "vec_id") -> DataFrame:
    """``query_id, place, key, score``: the ``k`` best texts of an index by cosine, score at least ``gate``; exact.

    ``queries`` has ``query_id`` and ``text``.  Candidates come from :func:`lexical_candidates`; only they are scored, on
    all their words.  Scores are compared to nine decimals; equal ones are ordered by key.
    """
    whole(k, "k", 1)
    unit = lexical_queries(index, queries)
    pairs = lexical_candidates(index, unit, gate, key)
    terms = pairs.join(unit.select("query_id", "term", "w"), "query_id")
    weights = index.select(key, "term", "weight").hint("merge")
    scored = terms.join(weights, [key, "term"]).groupBy("query_id", key)
    scored = scored.agg(F.sum(F.col("w") * F.col("weight")).alias("s"))
    scored = scored.select("query_id", key, F.round("s", 9).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    ranked = (scored if gate is None else scored.where(F.col("score") >= gate)).withColumn(
        "place", F.row_number().over(order)
    )
    return ranked.where(F.col("place") <= k).select("query_id", "place", key, "score")


def _packed(rows: DataFrame, id_name: str, most: int) -> DataFrame:
    """``ids, vecs``: up to ``most`` rows (or about eight megabytes) of vectors per row; missing vectors are left out.

    Vectors of different lengths end the job.
    """
    id_type = rows.schema[id_name].dataType

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            good = batch.column("vec").is_valid()
            ids, vecs = batch.column(id_name).filter(good), batch.column("vec").filter(good)
            widths = np.unique(np.asarray(vecs.value_lengths()))
            if len(widths) > 1:
                raise ValueError(f"vectors of different lengths: {widths.tolist()}")
            step = max(1, min(most, (1 << 20) // max(1, int(widths[0])))) if len(widths) else 1
            for at in range(0, len(ids), step):
                some_ids, some = ids.slice(at, step), vecs.slice(at, step).cast(pa.list_(pa.float64()))
                one_row = pa.array([0, len(some_ids)], pa.int32())
                yield pa.RecordBatch.from_pydict(
                    {
                        "ids": pa.ListArray.from_arrays(one_row, some_ids),
                        "vecs": pa.ListArray.from_arrays(one_row, some),
                    }
                )

    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("vecs", T.ArrayType(T.ArrayType(T.DoubleType()))),
        ]
    )
    return rows.mapInArrow(pack, schema)


def nearest(corpus: DataFrame, queries: DataFrame, k: int = RETRIEVAL_K, gate: float | None = SCORE_GATE,
            queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """``query_id, place, vec_id, score, unit_vec``: exact top ``k`` by cosine with score at least ``gate``.

    ``corpus`` has ``vec_id`` (bigint) and ``vec``; ``queries`` has ``query_id`` and ``vec``.  Equal scores are ordered
    by ``vec_id``; zero and missing vectors match nothing.  Repeated query ids and vectors of different lengths end the
    job with an error.

    One way for any number of queries, and nothing runs before the result is asked for: corpus and queries are packed
    into matrices, the corpus is dealt once over as many salts as the session has shuffle partitions, each of which gets
    all blocks of queries.  They meet by a shuffle of both sides: by its files the query side looks small enough to be
    broadcast, but it holds every query once per salt.  A pair of matrices yields at most ``k`` rows per query, and the
    rank prunes them per task again before they are shuffled.
    """
    whole(k, "k", 1)
    corpus, queries = corpus.select(F.col("vec_id").cast("bigint"), "vec"), queries.select("query_id", "vec")
    once = F.count("*").over(W.partitionBy("query_id")) == 1
    queries = queries.withColumn("once", once).where(
        F.assert_true("once", "a query id stands for several vectors").isNull()
    )
    salts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    corpus_side = _packed(corpus, "vec_id", 1 << 14).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)))
    every_salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt")
    query_side = _packed(queries.select("query_id", "vec"), "query_id", whole(queries_per_block, "queries_per_block", 1))
    query_side = query_side.select(F.col("ids").alias("asked"), F.col("vecs").alias("asked_vecs"), every_salt)

    def unit_rows(column):
        """Positions and unit vectors of the rows of a list column that are not zero."""
        import numpy as np

        width = len(column[0])
        flat = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), max(width, 1) if width else 0)
        norms = np.sqrt((flat * flat).sum(axis=1))
        usable = norms > 0
        return np.flatnonzero(usable), flat[usable] / norms[usable, None]

    def score(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                known, matrix = unit_rows(batch.column("asked_vecs")[i].values)
                rows, unit = unit_rows(batch.column("vecs")[i].values)
                if not len(rows) or not len(known):
                    continue
                if matrix.shape[1] != unit.shape[1]:
                    raise ValueError(f"vectors of different lengths: {matrix.shape[1]} and {unit.shape[1]}")
                names = batch.column("asked")[i].values.take(pa.array(known))
                ids, scores = np.asarray(batch.column("ids")[i].values)[rows], matrix @ unit.T
                for q in range(len(known)):
                    row = scores[q]
                    allowed = np.arange(len(row)) if gate is None else np.flatnonzero(row >= gate)
                    best = allowed[np.lexsort((ids[allowed], -row[allowed]))[:k]]
                    if len(best):
                        yield pa.RecordBatch.from_pydict(
                            {
                                "query_id": names.take(pa.array([q] * len(best))),
                                "vec_id": pa.array(ids[best], pa.int64()),
                                "score": pa.array(row[best], pa.float64()),
                                "unit_vec": pa.array(list(unit[best]), pa.list_(pa.float64())),
                            }
                        )

    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("vec_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("unit_vec", T.ArrayType(T.DoubleType())),
        ]
    )
    met = corpus_side.join(query_side.hint("merge"), "salt").select("ids", "vecs", "asked", "asked_vecs")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.mapInArrow(score, schema).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= k).select("query_id", "place", "vec_id", "score", "unit_vec")


def diversify(hits: DataFrame, k: int = RETRIEVAL_K, trade_off: float = MMR_LAMBDA) -> DataFrame:
    """``query_id, place, vec_id, score``: maximal marginal relevance over the hits of each query.

    The first pick is the best hit; every further one maximises ``trade_off * score`` minus ``(1 - trade_off)`` times
    its largest similarity to a hit already picked.  Equal values go to the better hit.  ``hits`` come from
    :func:`nearest`, so a group is at most its ``k`` rows.
    """
    whole(k, "k", 1)
    query_type = hits.schema["query_id"].dataType
    schema = T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("place", T.IntegerType()),
            T.StructField("vec_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def choose(group):
        import numpy as np

        group = group.sort_values("place", ignore_index=True)
        vectors = np.vstack(group["unit_vec"].to_numpy())
        relevance, similar = group["score"].to_numpy(), vectors @ vectors.T
        picked, redundancy = [], np.full(len(group), -np.inf)
        left = np.ones(len(group), dtype=bool)
        while left.any() and len(picked) < k:
            value = relevance if not picked else trade_off * relevance - (1 - trade_off) * redundancy
            pick = int(np.argmax(np.where(left, value, -np.inf)))
            picked.append(pick)
            left[pick] = False
            redundancy = np.maximum(redundancy, similar[pick])
        chosen = group.loc[picked, ["query_id", "vec_id", "score"]]
        chosen.insert(1, "place", np.arange(1, len(picked) + 1, dtype="int32"))
        return chosen

    return hits.groupBy("query_id").applyInPandas(choose, schema)


def diverse_nearest(corpus: DataFrame, queries: DataFrame, k: int = RETRIEVAL_K, fetch: int = MMR_FETCH,
                    trade_off: float = MMR_LAMBDA) -> DataFrame:
    """The ``fetch`` nearest vectors of each query, without a gate, re-ranked for diversity down to ``k``."""
    return diversify(nearest(corpus, queries, fetch, None), k, trade_off)


def contexts(hits: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``query_id, n_texts, n_without_text, context``: texts of the hits in rank order, joined by blank lines.

    Hits without a text are counted, not hidden.  A context holds at most the ``k`` texts of its query.
    """
    found = hits.select("query_id", "place", "vec_id").join(
        texts.select(F.col(key).alias("vec_id"), F.col(text).alias("text")), "vec_id", "left"
    )
    ordered = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("place", "text"))))
    return found.groupBy("query_id").agg(
        F.count("text").alias("n_texts"),
        F.count_if(F.col("text").isNull()).alias("n_without_text"),
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("context"),
    )
