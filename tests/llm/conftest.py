from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and to in is on that by this an it from or are as at be stone river cloud garden window paper silver engine thunder market yellow forest copper".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for k in range(n):
        out.append(r.choice(WORDS) + (str(r.randint(0, 400)) if r.random() < 0.5 else ""))
        if k % 12 == 11:
            out[-1] += ".\n"
    return " ".join(out)


@pytest.fixture(scope="session")
def texts() -> list[tuple[int, str | None]]:
    """Prose, exact and near copies, shared lines and passages, short, empty, null, odd and long texts."""
    rows: list[tuple[int, str | None]] = [(k, prose(k, 40 + 13 * k)) for k in range(12)]
    rows += [(20, rows[3][1]), (21, rows[3][1]), (22, rows[5][1].replace("the", "a", 1)), (23, rows[7][1] + " and more words")]
    shared = prose(99, 60)
    rows += [(30, prose(31, 30) + "\n" + shared), (31, shared + "\n" + prose(32, 30)), (32, shared)]
    rows += [(40, None), (41, ""), (42, " \n\t"), (43, "one two"), (44, "one two"), (45, "é ü 中文 ﬁ \x00 \x1c x"), (46, "ab" * 300), (47, "ab" * 300), (48, prose(48, 5000)), (49, "!!! ### 123")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    names = ["digest", "shard", "rank", "task", "c0", "_c0", "_kept", "_gone", "_doc", "_id", "_lines", "token", "n", "n_removed", "removed", "n_lines_removed", "line", "doc", "kept", "member", "size", "_row", "_t", "n_words"]
    return docs.select("*", *[F.when(F.col("doc_id") >= 0, 1).alias(n) for n in names])
