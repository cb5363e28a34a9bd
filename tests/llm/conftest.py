import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977} filler{k % 13}" for k in range(30_000))
ROWS = [
    (5, "The quick brown fox jumps over the lazy dog. Mail a.b@c.de now!", "en", "s1"),
    (3, "The quick brown fox jumps over the lazy dog. Mail a.b@c.de now!", "en", "s1"),
    (9, None, None, None),
    (1, "", "en", "s0"),
    (2, " \n\t ", "fr", "s2"),
    (7, "Ein Wort\tmit Tab und  zwei Lücken\nund ‘Zeichen’ 日本語テキスト 🙂", "de", "s1"),
    (7, "Ein Wort\tmit Tab und  zwei Lücken\nund ‘Zeichen’ 日本語テキスト 🙂", "de", "s1"),
    (8, "one", "en", "s2"),
    (None, "no id here, but text", "en", "s3"),
    (4, "<|endoftext|> is plain text; don't 12 3.4 ½", "en", "s0"),
    (6, LONG, "en", "s0"),
    (10, "a" * 5_000, "en", "s4"),
]


def rows():
    return [(*r, len(r[1] or "")) for r in ROWS]


@pytest.fixture(scope="session")
def documents(spark):
    """Odd rows in one table, with extra columns whose names operators use inside."""
    made = spark.createDataFrame(rows(), COLUMNS)
    clash = {c: F.lit("x") for c in ("row", "size", "shard", "fp", "start", "_at", "_rank", "document", "ids", "stratum", "t")}
    return made.withColumns(clash).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
