import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASHES = ["run", "digest", "key", "fp", "root", "kept", "best", "at", "block", "hashes", "window", "score", "lang_pred", "features", "_stays", "_goes", "_lang", "epochs", "row_no"]


def prose(rng: random.Random, lang: str, n: int) -> str:
    words = {"en": "the quick brown fox jumps over lazy dogs while seven young wizards mix their boxing gloves", "de": "der schnelle braune fuchs springt über den faulen hund und sieben junge zauberer mischen ihre handschuhe"}
    return " ".join(rng.choice(words[lang].split()) + rng.choice("aeiou") * rng.randint(0, 2) for _ in range(n))


def tricky_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows and ties."""
    rng = random.Random(7)
    long = prose(rng, "en", 60_000)
    base = [prose(rng, lang, 80) for lang in ("en", "de") * 6]
    rows = [(i, text, "en" if i % 2 == 0 else "de", f"src{i % 3}", len(text)) for i, text in enumerate(base)]
    rows += [(20 + i, base[0] + " " * i, "en", "src0", None) for i in range(4)]
    rows += [(30, base[1].replace(" ", "\t\n"), "de", None, None), (31, None, "en", "src1", None), (32, "", None, "src2", 0), (33, " \x0b\x0c\r\n", None, None, 3)]
    rows += [(40, long, "en", "src0", len(long)), (41, long + " end", "en", "src0", None), (42, "1234 ... !!", "en", "src1", 11), (43, "Zwei", "de", "src1", 4)]
    rows += [(50, base[2] + " " + base[4], "en", "src2", None), (51, "x " + base[4], "en", "src2", None), (52, "\U0001f926 İΣ nbsp here <|endoftext|> </s>", None, "src2", None)]
    rows += [(None, base[5], "de", "src0", None), (60, base[6], "en", "src1", None), (60, base[6], "en", "src1", None), (-5, base[3], "de", "src1", None)]
    return rows


@pytest.fixture(scope="session")
def tricky(spark):
    """The rows above, with extra columns that clash; and the plain rows."""
    from pyspark.sql import functions as F

    rows = tricky_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit(None).cast("string"))
    return docs, rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
