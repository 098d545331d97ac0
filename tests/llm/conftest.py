import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, score double, items string, h long, label string, spans string, bin long"
#: Texts that operators stumble over.
ODD = [
    None, "", " ", "\n\t \r\n", "word", "Word", "two words", "TWO  words", "a" * 5000, "x " * 3000, ("long text here " * 4000)[:50_003], "é Été ÉTÉ\u00a0x", "<|endoftext|> a <|endoftext|>", "it's we're  don't\n\n\nok 12 3.4", "日本語 テキスト です",
    "MIT license and Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0.", "cc by cc by", "tail \n", " lead", "\ufeffbom 🙂🙂 emoji",
]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Rows of documents: odd texts, random ones, copies, near copies, a repeated row and rows without doc_id."""
    rng = random.Random(seed)
    texts = list(ODD)
    for i in range(n):
        t = words(rng, rng.choice((3, 20, 60, 200)))
        texts.append(t)
        if i % 5 == 0:
            texts += [t, t + " extra", t.upper()]
        if i % 7 == 0:
            ws = t.split()
            ws[len(ws) // 2] = "changed"
            texts.append(" ".join(ws))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, rng.choice(("en", "fr", None)), rng.choice(("hot", "hot", "s1", None)), None if t is None else len(t), 1, "k", 0.5, "i", 2, "l", "s", 3) for i, t in zip(ids, texts)]
    rows.append(rows[30])
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def nameless(spark):
    """Rows without doc_id."""
    return spark.createDataFrame([(None, "some text here for you", "en", "s", 3), (None, None, None, None, None), (1, "some text here for you", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
