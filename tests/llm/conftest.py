import random

import pytest
from made_text import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc_key string, node int, gone string, shard string"


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, blanks, repeated rows, equal doc_ids, copies, near copies, shared passages and a long text."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(60, 160), rng.choice(["en", "de"])) for _ in range(40)]
    shared = prose(rng, 50)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "s"), (101, texts[0], "en", "s"), (102, texts[1].replace(" ", "  ", 1), "en", "s")]
    words = texts[2].split()
    words[5] = "changed"
    rows += [(103, " ".join(words), "en", "s"), (104, f"{texts[3]}\n{shared}\n{texts[4]}", "de", None), (105, f"x {shared} y", None, "s"), (105, f"z\n{shared}", None, "s")]
    rows += [(106, None, None, None), (107, "", "en", "s"), (108, " \n\t ", "en", "s"), (None, texts[5], "en", "s"), (109, "short text", "en", "s"), (110, "short text", "en", "s")]
    rows += [(111, prose(rng, 20_000), "en", "s"), (112, "w " * 300, "en", "s"), (113, "1234 5678", "en", "s")]
    rows += [rows[7], rows[7]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(*r, 0 if r[1] is None else len(r[1]), "k", 1, "g", "h") for r in corpus], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
