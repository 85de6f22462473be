import pytest

LONG = " ".join(f"word{i % 977} and,more{i % 13}" for i in range(40_000))
ROWS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "two words"), (6, "The quick brown fox jumps over the lazy dog."),
    (6, "The quick brown fox jumps over the lazy dog."), (7, "the QUICK brown fox\njumps over the lazy dog."),
    (None, "no id here, but a text of several words"), (9, LONG), (10, LONG + " tail"),
    (11, "naïve café — “quoted” don't we'll 12,345 ½ ﬁ é  x y\x1cz <|endoftext|> and<|startoftext|>more"),
    (12, "mail a.b@mail.example.com or +1 (755) 555-3798, card 4111 1111 1111 1111, host 10.0.0.1; 999.1.1.1 4111111111111112"),
    (13, "a" * 5000), (14, "\n\n  spaced   out \r\n lines  \n"), (15, "日本語 のテキスト 😀 emoji👩‍👩‍👧 z̸"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(i, t, "start", 7, "x", 3, "b", 1.5) for i, t in ROWS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, start string, batch int, base string, size int, range string, label double"
    ).repartition(3).cache()


@pytest.fixture(scope="session")
def texts():
    return ROWS


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def word_file():
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="session")
def byte_file():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))
