import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def _prose(draw: random.Random, n: int) -> str:
    words = ["".join(draw.choices("abcdeghilmnorstuéß", k=draw.randint(1, 9))) for _ in range(200)]
    return " ".join(draw.choices(words, k=n))


@pytest.fixture(scope="session")
def rows():
    """Documents with every awkward case: nulls, no words, copies, near copies, shared passages, repeated rows."""
    draw = random.Random(5)
    passage = _prose(draw, 70)
    texts = [_prose(draw, draw.choice([3, 30, 80, 200])) for _ in range(60)]
    texts += [texts[0], texts[3], texts[3], texts[7] + " end", "x " + texts[7]]
    texts += [f"{_prose(draw, 30)} {passage} {_prose(draw, 20)}" for _ in range(8)] + [passage]
    texts += ["", " \t\n", "one", "one two", "one  two", "one\ttwo\nthree", "Of " * 400, "La la\nLa la\n\nLa la\n", "###% |<>| &&", "12 34",
              "don't <|endoftext|> it's 3 x", "été 　 naİve \x1c y", "\U0001f600 你好世界", _prose(draw, 30_000)]
    found = [(i, text, draw.choice(["en", "de", None]), draw.choice(["a", "a", "b", "B", "é", None]), len(text)) for i, text in enumerate(texts)]
    found += [found[5], found[5], (None, texts[9], "en", "a", 1), (None, None, None, None, None), (901, None, "de", "b", None), (902, None, None, None, 4)]
    return found


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """``rows`` as a stored table."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, DOCUMENT).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENT)
