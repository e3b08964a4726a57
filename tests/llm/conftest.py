import random

import pytest

WORDS = "the of stone river carries many small boats under old bridge while people watch from windows and children sing songs about winter".split()


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(words))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents (id, text) with columns whose names the operators use themselves."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, part int, rep bigint, answer string, block bigint, label string"
        full = [(*r, *("en", "src0")[len(r) - 2:]) if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(i, t, lang, source, len(t or ""), 0.5, 3, 7, "x", 9, "y") for i, t, lang, source in full], schema)

    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Null and empty texts, a null id, repeated rows, an id with two texts, ties, a very long text, odd characters."""
    long = prose(1, 30_000)
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "a"), (6, prose(6, 80)), (6, prose(6, 80)), (7, prose(7, 90)), (7, prose(77, 90)),
        (8, long), (9, long), (None, prose(9, 60)), (None, None), (10, "日本語のテキスト。句読点、など。" * 30), (11, "!!! ??? 123"), (12, "é 😀 \x00 ▁ <|im_end|>"),
        (13, prose(6, 80).replace(" ", "  ")), (-5, "minus"), (9_000_000_000, "far")]
    return make_docs(rows)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([(1, "x")]).where("doc_id < 0")
