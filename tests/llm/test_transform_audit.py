"""Fill-in-middle, decontamination and divergence against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, divergence, fill_in_middle

STEMS = "the of and to in is stone river cloud garden window paper silver engine thunder".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(STEMS) + (str(r.randint(0, 99)) if r.random() < 0.3 else "") for _ in range(n))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def naive_middle(doc_id, text):
    text = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    i, j = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    a, b, c = "".join(u[:i]), "".join(u[i:j]), "".join(u[j:])
    form, out = ("spm", f"<S>{c}<P>{a}<M>{b}") if h4 % 100 < 80 else ("psm", f"<P>{a}<S>{c}<M>{b}")
    return len(u), form, len(a), len(b), out


def test_middles(spark, texts):
    odd = [(500 + k, t) for k, t in enumerate(["a <P> b", "x<S>", "<", "<P", "P> it's 'quoted'", " \t", "日本語 テキスト　です", "a\x00 b\x00", "<M>", "\n"] * 3)]
    rows = texts + odd + [(None, "no id at all"), (3, "the id of another text"), (3, "the id of another text"), (900, "wörd  " * 200_000)]
    got = fill_in_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    restored = got.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in restored) == Counter((i, *naive_middle(i, t)) for i, t in rows)
    assert {r["form"] for r in restored} == {"plain", "psm", "spm"}
    for r in restored:
        assert r["output_sha256"] == sha(r["output"]) and r["restored_sha256"] == sha(r["back"])
    assert Counter(r["back"] for r in restored) == Counter(t or "" for _, t in rows)


def test_middles_of_odd_tables(clashing, docs, empty):
    assert fill_in_middle.transform(empty).count() == 0
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    one, two = (sorted(map(tuple, fill_in_middle.transform(x, with_text=False).collect()), key=str) for x in (docs, clashing))
    assert one == two and fill_in_middle.transform(docs, with_text=False).columns == columns
    named = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("body"))
    assert sorted(map(tuple, fill_in_middle.transform(named, "key", "body", with_text=False).select(F.col("doc_id").cast("long"), *columns[1:]).collect()), key=str) == one


def test_middles_with_other_marks(spark):
    marks = fill_in_middle.Marks("|a:", "|b:", "|c'")
    rows = [(k, prose(k, 50)) for k in range(40)]
    got = fill_in_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"), percent=100, spm_percent=40, marks=marks)
    got = got.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r["doc_id"]: r["back"] for r in got} == dict(rows) and {r["form"] for r in got} == {"psm", "spm"}
    for bad in (("<P>", "<P>S", "<M>"), ("P", "<S>", "<M>"), ("<P<", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError, match="marks"):
            fill_in_middle.Marks(*bad)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def naive_hits(text, items, window=10):
    low = (text or "").translate(LOWER)
    at = [m.span() for m in WORD.finditer(low)]
    w = [low[a:b] for a, b in at]
    hit, found = set(), set()
    for item, body in items:
        v = WORD.findall((body or "").translate(LOWER))
        n = min(window, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(item)
    spans, last = [], None
    for i in sorted(hit):
        if last is not None and i == last + 1:
            spans[-1][1] = at[i][1]
        else:
            spans.append([*at[i]])
        last = i
    return len(w), len(hit), sorted(str(x) for x in found if x is not None), [tuple(x) for x in spans]


@pytest.fixture(scope="module")
def benchmark(texts):
    body = dict(texts)
    cut = lambda i, a, b: " ".join(WORD.findall(body[i])[a:b])
    return [
        (1, cut(3, 2, 30).upper()), (2, cut(3, 5, 15)), (10, cut(3, 5, 15)), (11, cut(5, 0, 9)), (12, "one two"), (13, "one"), (14, "two one"), (15, "É ü 中文"), (16, None), (17, "  !? "),
        (18, cut(48, 100, 1400)), (19, "the the the the the the the the the the the the"), (20, "no such words in any of these texts at all here"), (21, cut(7, 10, 22)), (21, cut(8, 10, 22)), (None, cut(9, 3, 14)),
    ]


@pytest.mark.parametrize("block_bytes", [1 << 26, 9000, 1500])
def test_windows(spark, texts, benchmark, block_bytes):
    rows = texts + [(70, "x " + "the " * 40 + "y"), (71, "ONE TWO, one; two-one"), (3, "one two one"), (None, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    got = decontamination.find(docs, items, block_bytes=block_bytes).collect()
    wanted = Counter((i, *map(str, naive_hits(t, benchmark))) for i, t in rows)
    assert Counter((r["doc_id"], str(r["n_words"]), str(r["n_hit"]), str(r["items"]), str([tuple(x) for x in r["spans"]])) for r in got) == wanted
    assert sum(r["n_hit"] > 0 for r in got) > 8


def test_windows_of_two(spark, texts, benchmark):
    docs, items = spark.createDataFrame(texts[:16], "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontamination.find(docs, items, window=2).collect()}
    assert got == {i: naive_hits(t, benchmark, 2)[:3] for i, t in texts[:16]}


def test_windows_of_odd_tables(spark, clashing, empty, docs):
    none = spark.createDataFrame([], "item_id string, text string")
    found = decontamination.find(clashing, none)
    assert found.columns == ["doc_id", "n_words", "n_hit", "items", "spans"]
    assert {(r["n_hit"], len(r["items"])) for r in found.collect()} == {(0, 0)} and found.count() == docs.count()
    assert decontamination.find(empty, docs, item_id="doc_id").count() == 0
    own = decontamination.find(clashing, clashing.where("doc_id = 5"), item_id="doc_id").collect()
    assert {r["doc_id"] for r in own if r["items"] == ["5"]} >= {5, 22}


def naive_audit(rows, min_docs=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    df, c = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
        df[lang].update(set(found))
        c[lang, source].update(found)
    out = set()
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        sources = sorted({s for x, s in c if x == lang})
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c[lang, s]) for s in sources}, share(sum((c[lang, s] for s in sources), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if c[lang, s][t] and p[s][t] > q[t]]
            for part, found, n in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:n]
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)}
    return out


@pytest.mark.parametrize(("tile", "slice_rows"), [(256, 200_000), (3, 50), (1, 7)])
def test_audit(spark, tile, slice_rows):
    rows = [(prose(k, 30 + k % 50), ("en", "fr", None, "")[k % 4], (f"s{k % 7}", None, "", "é", "z")[k % 5]) for k in range(160)]
    rows += [("WORDS Words éÉ ÉÉ wordS", "de", "one")] * 12 + [(None, "de", "none"), ("a_b [c] 12d", "de", "odd"), ("rare", "xx", "one"), (None, None, None), ("", "xx", "two"), ("rare", "xx", "three")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = [tuple(r) for r in divergence.audit(docs, tile=tile, slice_rows=slice_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == naive_audit(rows)


def test_audit_of_odd_tables(spark, clashing, docs, empty):
    assert divergence.audit(empty).count() == 0
    plain = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    assert {tuple(r) for r in divergence.audit(clashing, min_docs=3).collect()} == naive_audit(plain, 3)
    one = spark.createDataFrame([("a b", "x", "y")], "text string, lang string, source string")
    assert divergence.audit(one).count() == 0


def test_share_beyond_64_bits(spark):
    got = spark.range(1).select(divergence._share(F.lit(3 * 10**12), F.lit(7 * 10**12)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (3 * 10**12 + 2) // (7 * 10**12)


def test_many_languages_with_long_texts(spark):
    """300 languages, whose documents are longer than the bytes that each may be learned from: none is lost."""
    from loomgraph.llm import language_id

    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(300):
        r = random.Random(k)
        vocabulary = ["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(60)]
        rows += [(4 * k + j, " ".join(r.choice(vocabulary) for _ in range(800)), f"l{k:03}") for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    model = language_id.learn(docs, F.col("doc_id") % 4 != 3)
    assert len(model.languages) == 300
    held = docs.where("doc_id % 4 = 3")
    right = language_id.predict(held, model).join(held.select("doc_id", "lang"), "doc_id").where("lang_pred = lang").count()
    assert right > 0.9 * 300
