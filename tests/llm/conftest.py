import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, size string, shard string, n long, token string, root string, words int, mark string, held_out string, edits string"
PARTS = "the an er in on ed re ou ti es or en sch ge be ung que le aux la os ción ue del".split()


def prose(r, n):
    return " ".join("".join(r.choice(PARTS) for _ in range(r.randrange(1, 4))) for _ in range(n))


def rows(texts):
    """Rows with every column of documents and columns whose names operators use within themselves."""
    return [(i, t, lang, "src0", None, 7, "x", "y", -1, "z", "r", 3, "m", "h", None) for i, t, lang in texts]


@pytest.fixture(scope="session")
def edge_rows():
    r = random.Random(3)
    base = prose(r, 120)
    long = prose(r, 20_000)
    near = base.split()
    near[60] = "changedword"
    out = [
        (1, base, "en"), (2, None, "en"), (3, "", None), (4, " \t\n\r ", "de"), (5, "one", "en"), (6, "two words", None), (7, base.upper(), "en"), (8, " ".join(near), "en"), (9, long, "fr"), (10, long + " end", "fr"),
        (11, "1234 !! $$$ 99", None), (12, "日本語 テキスト 🎉 naïve café \x1c b ▁x", "xx"), (None, base + " tail", None), (13, base, "en"), (13, base, "en"), (14, prose(r, 60) + "\n" + prose(r, 5) + "\n" + prose(r, 5), "de"),
        (15, "same same same " * 40, "en"), (16, "ONE", "en"), (-5, prose(r, 80), "fr"), (17, "a  b\n\n\nc d'll  don't  e ", "en"),
    ]
    return out + [(100 + i, prose(r, 90), r.choice(["en", "de"])) for i in range(30)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    from emberlog.llm.runtime import ship

    ship(spark)
    return spark.createDataFrame(rows(edge_rows), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
