import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, digest string, node string, rank int, shard int, score double, line int, place int, record int"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def rows(seed=1, n=120):
    """Documents with nulls, empty and long texts, copies, near copies, ties, shared lines and columns of clashing names."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        texts.append("\n".join(prose(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))))
    texts[5:9] = [texts[4]] * 4
    shared = prose(rng, 60)
    for i in (10, 20, 30, 40):
        texts[i] = prose(rng, 12) + "\n" + shared + "\n" + prose(rng, 9)
    long = prose(rng, 300, 5000)
    texts[50] = long
    for i in range(51, 58):
        words = long.split()
        words[rng.randrange(300)] = f"x{i}"
        texts[i] = " ".join(words)
    texts[60], texts[61], texts[62], texts[63] = None, "", " \t\n", None
    texts[64] = prose(rng, 20_000, 3000)
    texts[65], texts[66] = "one two", "one two"
    texts[67] = "\n".join(["short", "short", "", "", shared, "short", shared])
    texts[68], texts[69] = "a  b\tc\nd e", "a b c d e"
    out = []
    for i, t in enumerate(texts):
        source = None if i % 17 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}"
        out.append((i * 3, t, "en", source, len(t or ""), "x", "d", "n", 1, 2, 0.5, 3, 4, 5))
    out.append(out[4])  # rows that repeat
    out.append((None, texts[4], None, "hot", None, None, None, None, None, None, None, None, None, None))
    out.append((None, "quite another text without an id of its own", None, None, None, None, None, None, None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def messy(spark, tmp_path_factory):
    """(table read from Parquet, its rows as tuples, its path)"""
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    data = rows()
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path), data, path


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('none')}/documents.parquet"
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path), path
