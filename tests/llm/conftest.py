import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 3) -> list[tuple]:
    """Documents with all that is awkward: nulls, empty and blank texts, copies, repeats, long words and lines, odd characters."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(120)] + ["the", "of", "and", "Straße", "日本語", "naïve", "a.b,c", "x#y"]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = words(60)
    base = words(180)
    near = base.split(" ")
    near[90] = "changed"
    bodies = [
        None, "", "   \t\n ", "one", "one two three", words(30), base, base, " ".join(near), passage + " " + words(40), words(25) + "\n" + passage, words(10) + " " + passage + " " + passage, "a " * 300, "ab" * 400, words(15) + "\x00" + words(15),
        "\n".join(["same line here"] * 9 + [words(12)]), words(2500), "Straße " * 150, "x" * 5000, words(19), words(20), words(45) + "  \x0b\x0c\r " + words(5), "Released under the MIT License. " + words(10), "THE MIT LICENSE and gpl: GNU General Public License, mit license",
    ]
    rows = [(k, b, "en", f"src{k % 3}" if k % 7 else None, len(b or "")) for k, b in enumerate(bodies)]
    return [*rows, (6, base, "en", "src0", len(base)), (None, passage, None, None, None)]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 AS key", "2 AS words", "'x' AS kept", "'y' AS host", "3 AS n", "'z' AS th", "4 AS fp", "true AS there")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
