import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w string, digest string, spans int, rid int, m double"


def prose(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}w{rng.randrange(vocabulary)}" for _ in range(n))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, chains, shared passages, nulls, empties, long and repeated rows."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(8, 120)) for _ in range(60)]
    base = prose(rng, 80)
    shared = prose(rng, 70)
    texts += [base] * 5 + [base.upper()]
    chain = base.split()
    for k in range(12):  # each a little further from the first
        chain[(k * 7) % 80] = f"new{k}"
        texts.append(" ".join(chain))
    texts += [prose(rng, 20) + "\n" + shared + "\n" + prose(rng, 20) for _ in range(6)]
    texts += [None, "", " \t\n\x0b\x0c\r ", "one", "One", "two words", "two words", "a b c d e", "x" * 5000, "a" * 700, "é ß İ 漢字 😀 " * 40]
    texts += ["line one here\nline one here\nline two here\n\n  \n", "# * $ % & | < > " * 20, prose(rng, 3000), " lead and trail "]
    out = [(k, t, ["en", "fr", None][k % 3], ["src0", None][k % 2], len(t or ""), "w", "d", 1, 2, 3.0) for k, t in enumerate(texts)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
