import pytest

# documents with everything that may be odd: nulls, empty and long texts, repeated rows, columns named like the operators' own
DOCS = "doc_id long, text string, source string, size int, row string, h long, n int, rank int, score double, spans string, v double"


@pytest.fixture(scope="session")
def odd(spark):
    long = " ".join(f"word{i % 977}x{i}" for i in range(30000)) + "."
    texts = [
        (1, "the quick brown fox jumps over the lazy dog and runs away from it today.", "b"),
        (2, "the quick brown fox jumps over the lazy dog and runs away from it today.", "b"),
        (3, None, "a"),
        (4, "", None),
        (5, " \t\n ", "a"),
        (6, long, "c"),
        (7, "write to ann@example.com or 10.0.0.1, card 4111 1111 1111 1111, call +1 (743) 555-3824 now please.", "a"),
        (7, "write to ann@example.com or 10.0.0.1, card 4111 1111 1111 1111, call +1 (743) 555-3824 now please.", "a"),
        (None, "one two three", None),
        (8, "ÉCOLE é́ ＡＢ 日本 <|endoftext|> it's x" * 3, "é"),
    ]
    return spark.createDataFrame([(i, t, s, 1, "r", 2, 3, 4, 0.5, "s", 0.1) for i, t, s in texts], DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
