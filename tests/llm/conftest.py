import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, part int, key string, kept boolean, h long, rep long, region long, f double"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns named as the operators' own."""
    same = "the quick brown fox jumps over the lazy dog near the river bank " * 8
    rows = [
        (1, same), (2, same), (2, same), (3, None), (4, ""), (5, "  \n "), (6, "word"), (7, same + "and then some more words follow here"),
        (8, "Ünïcode ▁ text with <|endoftext|> 日本語 \U0001f600 é " * 3), (9, "a b " * 30_000), (None, "no id here at all"), (None, None), (10, "x" * 5_000), (11, "  two  spaces \n\n tabs\t "),
    ]
    return spark.createDataFrame([(i, t, None, None if n % 4 == 0 else f"src{n % 3}", None, 5, None, 7, "k", None, 3, 4, 5, 0.5) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


SF = "/root/testdata/sf0.001"
