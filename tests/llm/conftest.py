import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
WORDS = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix jade potions"

# doc_id, text, lang, source, n_chars, and columns named like those the operators make.
HOSTILE = [
    (1, WORDS, "en", "a", 5),
    (2, WORDS, "en", "a", 5),
    (2, WORDS, "en", "a", 5),
    (3, WORDS.upper() + "!", None, "a", 5),
    (4, None, "en", None, None),
    (5, "", "en", "b", 0),
    (6, "  \n\t ... 12 %%", "fr", "b", 0),
    (None, "une phrase sans numéro, mais avec des accents çà et là", "fr", "c", 1),
    (7, LONG, "en", "c", 1),
    (8, "three words only", None, "c", 1),
    (8, "another text under the same number", "en", "c", 1),
    (9, "<|endoftext|> É, ÀÇ. İstanbul ΣΑΣ don't 1234 日本語", "xx", "c", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def hostile(spark):
    """Documents with nulls in every column, ties, repeated rows and clashing extra columns."""
    from seqprep.llm.common import reachable

    reachable(spark)
    df = spark.createDataFrame(HOSTILE, SCHEMA)
    for name in ("d", "sig", "segment", "term", "group", "shard", "score", "ids", "block", "_id", "cell", "g"):
        df = df.selectExpr("*", f"doc_id % 3 AS `{name}`")
    return df


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    from seqprep.llm.common import table

    return table(spark, sf_dir, "documents")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
