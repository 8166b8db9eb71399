from __future__ import annotations

import random
import re
from pathlib import Path

from test_llm_operators import naive_line_dedup

from loomgraph.llm import line_dedup
from loomgraph.session import shared_dir


def test_tables_of_the_join_go_when_used(spark, monkeypatch):
    """Sets of tokens, keys of frequent tokens and lists of wanted lines are deleted, and long and short near copies are still found."""
    monkeypatch.setattr(line_dedup, "WARM", 4)
    draw = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    first = [draw.sample(words, draw.choice((4, 9, 40, 150, 220))) for _ in range(60)]
    near = [[w if draw.random() > 0.06 else f"x{draw.random()}" for w in draw.choice(first)] for _ in range(120)]
    rows = [(k, "\n".join(" ".join(x) for x in draw.sample(first + near, 2))) for k in range(120)]
    before = set(Path(shared_dir(spark).removeprefix("file://")).rglob("*.parquet"))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = {re.sub("-.*", "", f.parent.name) for f in set(Path(shared_dir(spark).removeprefix("file://")).rglob("*.parquet")) - before}
    assert got == naive_line_dedup(rows) and any(got[k] != t for k, t in rows)
    assert not left & {"warm", "wanted", "sets", "thick", "prefixes"}
