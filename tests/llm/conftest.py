import pytest
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

DOCS = StructType([StructField(n, t) for n, t in (("doc_id", LongType()), ("text", StringType()), ("lang", StringType()), ("source", StringType()), ("n_chars", LongType()))])
#: Names that operators use for columns of their own.
CLASHING = ["score", "predicted", "_text", "Th", "_none", "_first", "_lines", "_n", "label", "fp", "word", "id", "line", "component_id", "p", "rate", "tokens"]

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog\nand a second line of some words"),
    (2, "the quick brown fox jumps over the lazy dog\nand a second line of some words"),
    (2, "the quick brown fox jumps over the lazy dog\nand a second line of some words"),  # a repeated row
    (3, ""),
    (4, None),
    (None, "a text without an id, of several words"),
    (None, None),
    (5, LONG),
    (6, LONG + " end"),
    (7, "\n\n \t\n"),
    (8, "one"),
    (9, "x" * 20_000),
    (-10, "ÄÖÜ ß 世界 😀 ▁ \x00 <s> ünïcödé\r\nline"),
    (11, "the quick brown fox leaps over the lazy dog\nand a second line of some words"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and long texts, repeats, ties and columns with clashing names."""
    rows = [(d, t, "en" if k % 2 else None, None if k % 3 else "src0", None if t is None else len(t)) for k, (d, t) in enumerate(TEXTS)]
    out = spark.createDataFrame(rows, DOCS)
    for name in CLASHING:
        out = out.withColumn(name, out["n_chars"].cast(DoubleType()))
    return out


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(d, q, 0) for d, q in ((1, 1), (2, 1), (5, 1), (6, 1), (8, 0), (9, 0), (11, 1), (None, 1), (12, None))], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
