import pytest

#: Columns of the input that are called like columns the operators add.
CLASH = ("shard", "slot", "grown_shard", "size", "copies", "places", "n_words", "kept", "score", "features", "lang_pred", "hits", "node", "root", "bucket", "removed", "_key", "_order", "_block", "_crc", "_len", "_source", "_blocks", "_n", "row", "key", "nth", "place", "part", "at_id", "at_key", "judged", "_probes", "cls", "word", "rid", "group", "n", "block", "data", "first", "start", "end")
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000


@pytest.fixture
def docs_of(spark):
    """A function that makes documents of tuples (doc_id, text[, source[, lang]]) with clashing columns besides."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), *["x"] * len(CLASH)) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} string" for c in CLASH))

    return make


@pytest.fixture
def odd_docs(docs_of):
    """Nulls in every column, empty, blank and long texts, repeated rows and equal texts under different ids."""
    same = "the quick brown fox jumps over the lazy dog again and again today"
    rows = [
        (1, None, "a", "en"), (2, "", "a", "en"), (3, " \t\n ", None, None), (None, same, "b", "en"), (None, None, None, None), (5, same, "b", None),
        (5, same, "b", None), (6, same, "b", "en"), (7, LONG, "a", "en"), (8, "é", "c", "fr"), (9, "!!! 123", "c", "fr"), (-4, "one two", None, "de"), (2**62, "one two", "a", "de"),
    ]
    return docs_of(rows)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
