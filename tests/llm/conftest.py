import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text[, source]) rows."""

    def make(*rows, columns=COLUMNS):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], columns)

    return make


#: Null and empty texts, white space only, ties and rows repeated whole, no doc_id, one long text.
AWKWARD = [(1, "Alpha beta gamma"), (1, "Alpha beta gamma"), (1, "alpha other"), (2, None), (3, ""), (4, " \t\n"), (None, "no id here"), (None, None), (5, "word " * 30_000), (6, "ünï 😀   x y", None), (7, "a" * 20_000)]


@pytest.fixture(scope="session")
def awkward(documents):
    return documents(*AWKWARD)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(awkward):
    """Extra columns named as what operators use inside."""
    from pyspark.sql import functions as F

    names = ("size", "range", "h", "cum", "target", "fp", "root", "key", "ids", "exact", "votes", "score", "keep", "p", "toxic", "_row", "taken", "held_out", "row", "word", "n", "labels")
    return awkward.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
