from __future__ import annotations

import pyarrow.parquet as pq
import pytest

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside; none may disturb them.
CLASHING = "keep_id long, hash string, part int, key long, lines string, fp long, rank long, words string, before long"

LINE = "This line stands in many documents."
LONG = "\n".join(f"paragraph {i} of a very long text, {i * i % 97} and more" for i in range(6000))
TEXTS = [
    "plain words in a row",
    "plain  words\tin a row",
    "Plain words in a row",
    None,
    "",
    "",
    " \t\n\x0b ",
    f"{LINE}\nfirst of its own",
    f"  {LINE.upper()}\t\nsecond of its own\n\n{LINE}",
    f"{LINE}\n{LINE}\nthird of its own",
    f"{LINE}\r\nlast holder\n{LINE}",
    "ÉTÉ à la plage, İstanbul ΣΑΣ, 全角　テスト 😀👍🏽",
    "été à la plage, İstanbul ΣΑΣ, 全角　テスト 😀👍🏽",
    "a <|endoftext|>  b   c\n\n\nd <|startoftext|>",
    "zero\x00byte \x1c\x1d separators \U00013688\U00031a2e",
    LONG,
    "x" * 30000,
    "one two three four five six seven eight nine ten",
    "one two three four five six seven eight nine ten",
    "one two three four five six seven eight nine eleven",
]


@pytest.fixture(scope="session")
def messy_rows():
    """Ids ascending with gaps; one row without id, one row twice."""
    rows = [(7 * i + 3, t) for i, t in enumerate(TEXTS)]
    return rows + [(None, "no id at all"), rows[0]]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """Nulls, empty and long texts, ties, repeated rows and extra columns with clashing names."""
    full = [(i, t, None, "src", 0, 1, "h", 2, 3, "l", 4, 5, "w", 6) for i, t in messy_rows]
    return spark.createDataFrame(full, f"{COLUMNS}, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def corpus():
    """``(doc_id, text)`` of the small sample, ascending."""
    rows = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return sorted((r["doc_id"], r["text"]) for r in rows)
