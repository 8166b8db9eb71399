"""Each operator against a plain version of its definition, on texts with all edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.llm import embedding_dedup, language_id, line_dedup, ngram_join, packing, quality_rules, registry, sentencepiece_codec, substring_dedup, suffix_dedup, toxicity

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def test_quality_signals(docs, texts):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, text in texts:
        w = words(text)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)), i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_filter_keeps_columns(clashing, docs):
    kept = quality_rules.keep_good(clashing)
    assert kept.columns == clashing.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}


def naive_line_dedup(rows):
    entries = [(i, k, frozenset(w.lower() for w in words(x))) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    entries = sorted(e for e in ((i, k, tuple(sorted(s))) for i, k, s in entries) if e[2])
    gone = defaultdict(set)
    for n, (i, k, s) in enumerate(entries):
        if any(9 * len(set(s) & set(p)) >= 4 * (len(s) + len(p)) for _, _, p in entries[:n]):
            gone[i].add(k)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_line_dedup(docs, texts):
    short = [(i, t) for i, t in texts if i != 48]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs.where("doc_id <> 48")).collect()}
    assert got == naive_line_dedup(short)


def shingles(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def naive_links(rows):
    sets = {i: shingles(t) for i, t in rows}
    links, parent = Counter(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


def test_ngram_join(docs, texts):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(docs).collect()}
    assert got == naive_links(texts)


def test_ngram_join_large_group(spark):
    """A group of near copies over several tiles, and one of exact copies."""
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[: i % 60] + [f"x{i}"] + base[i % 60 + 1 :])) for i in range(300)] + [(1000 + i, " ".join(base)) for i in range(50)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == naive_links(rows)


def test_pruning_tolerance():
    """Pairs at the threshold survive; far ones go."""
    r = np.random.default_rng(1)
    a = r.integers(0, 256, (4000, 160), dtype=np.uint8)
    for share, low, high in ((0.85, 0.999, 1.0), (0.3, 0.0, 0.01)):
        b = np.where(r.random(a.shape) < share, a, r.integers(0, 256, a.shape, dtype=np.uint8))
        assert low <= ngram_join.likely(a, b).mean() <= high


def naive_suffix(rows):
    texts = sorted((i, (t or "").encode()) for i, t in rows)
    seen, out = {}, {}
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if seen.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[i] = (len(b), int(gone.sum()), len(edge) // 2, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_dedup(docs, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove(docs).collect()}
    assert got == naive_suffix(texts)


def test_suffix_dedup_text(clashing, texts):
    out = suffix_dedup.remove_from_text(clashing)
    assert out.columns == clashing.columns
    got = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
    assert got[32] == "" and got[0] == texts[0][1] and got[40] == ""


def naive_units(rows, min_words=20):
    """Units by the definition: from each piece with a word on, as few pieces as hold ``min_words`` words."""
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        cuts = [0] + [m.end() for m in re.finditer(r"(?<=[.!?]) |\n", text or "")]
        ends = [m.start() for m in re.finditer(r"(?<=[.!?]) |\n", text or "")] + [len(text or "")]
        gone = np.zeros(len(text or ""), bool)
        for k in range(len(cuts)):
            unit = []
            for j in range(k, len(cuts)):
                unit += words((text or "")[cuts[j] : ends[j]].lower())
                if not unit or len(unit) >= min_words:
                    break
            if len(unit) >= min_words and seen.setdefault(tuple(unit), (i, k)) != (i, k):
                gone[cuts[k] : ends[j]] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).tolist()
        kept = None if text is None else "".join(c for c, g in zip(text, gone, strict=True) if not g)
        out[i] = (kept, list(zip(edge[::2], edge[1::2], strict=True)))
    return out


@pytest.mark.parametrize("min_words", [20, 1])
def test_substring_dedup(docs, texts, min_words):
    got = {r["doc_id"]: r for r in substring_dedup.dedup(docs, min_words=min_words).collect()}
    for i, (kept, spans) in naive_units(texts, min_words).items():
        r = got[i]
        assert (r["text"], [tuple(x) for x in r["removed"]]) == (kept, spans), i
        assert (r["n_removed"], r["n_chars_removed"]) == (len(spans), sum(b - a for a, b in spans))


def test_substring_passage_within_lines(spark):
    """A passage that begins and ends inside longer lines goes, and the words around it stay."""
    r = __import__("random").Random(4)
    sentence = lambda: " ".join(f"w{r.randint(0, 9999)}" for _ in range(12)) + "."
    passage = " ".join(sentence() for _ in range(5))
    rows = [(1, f"{sentence()} {passage} {sentence()}"), (2, f"{sentence()}\n{sentence()} {passage} {sentence()}"), (3, sentence())]
    got = {x["doc_id"]: x for x in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == got[3]["n_removed"] == 0
    assert got[2]["n_removed"] == 1 and passage not in got[2]["text"] and got[2]["n_chars_removed"] == len(passage)


def test_substring_offsets(docs, texts):
    by_id = dict(texts)
    for r in substring_dedup.duplicates(substring_dedup.units(docs)).collect():
        unit = words(by_id[r["doc_id"]][r["start"] : r["stop"]].lower())
        assert len(unit) >= 20 and words(by_id[r["first_doc_id"]][r["first_start"] :].lower())[: len(unit)] == unit


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs, packing.default_tokenizer(), with_ids=True).collect()
    wanted = {}
    for i, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            wanted[i, k] = (at, len(part), zlib.crc32(part.tobytes()), part.tobytes())
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows} == wanted
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 1


@pytest.mark.parametrize("seed", range(60))
def test_packing_plan(seed):
    import bisect
    import random

    r = random.Random(seed)
    capacity = r.choice([7, 30, 100, 2048])
    histogram = {r.randint(1, capacity): r.choice([1, 2, 3, 7, 50, 1000]) for _ in range(r.randint(0, 60))}
    runs = packing.plan(histogram, capacity).tolist()
    keys = [(x[0], x[1]) for x in runs]
    bins = defaultdict(list)
    for length, count in histogram.items():
        for rank in range(count):
            run = runs[bisect.bisect_right(keys, (length, rank)) - 1]
            along = rank - run[1]
            bins[run[2] + along // run[3]].append((run[4] + along % run[3] * length, length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * x > capacity for _, x in pieces) <= 2
    assert sorted(bins) == list(range(len(bins)))


def test_sentencepiece(docs, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    encoded = sentencepiece_codec.encode(docs, sentencepiece_codec.default_model())
    for r in encoded.collect():
        text = dict(texts)[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(text), r["doc_id"]
        assert r["round_trip"]
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(encoded, sentencepiece_codec.default_model()).collect()}
    assert back == {i: t or "" for i, t in texts}


def unigram_model(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece.Type
    for text, kind in (("<unk>", kinds.UNKNOWN), ("<s>", kinds.CONTROL), ("</s>", kinds.CONTROL)):
        model.pieces.add(piece=text, score=0.0, type=kind)
    r = __import__("random").Random(5)
    found = {c for c in "abcd▁"} | {(r.choice(["", "▁"]) + "".join(r.choices("abcd", k=r.randint(2, 5)))) for _ in range(60)}
    for text in sorted(found):
        model.pieces.add(piece=text, score=-r.uniform(1, 4) * len(text) ** 0.7, type=kinds.NORMAL)
    model.trainer_spec.model_type = 1
    model.trainer_spec.vocab_size = len(model.pieces)
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.escape_whitespaces = True
    model.normalizer_spec.remove_extra_whitespaces = False
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def best_sum(pieces, text):
    """The best sum of scores over all ways to cut ``text``, by trying all."""
    if not text:
        return 0.0
    return max((pieces.scores[i] + best_sum(pieces, text[len(t) :]) for t, i in pieces.ids.items() if text.startswith(t)), default=-np.inf)


def test_sentencepiece_unigram(tmp_path):
    """Viterbi over the automaton finds the best cut, and the library's ids."""
    import sentencepiece

    path = unigram_model(tmp_path)
    pieces, codec = sentencepiece_codec.Pieces(path), sentencepiece_codec.Codec(path)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = __import__("random").Random(6)
    assert not pieces.bpe
    for _ in range(200):
        run = "▁" + "".join(r.choices("abcd", k=r.randint(1, 9)))
        ids = pieces.best_path(run)
        assert "".join(pieces.texts[i] for i in ids) == run
        assert sum(pieces.scores[i] for i in ids) == pytest.approx(best_sum(pieces, run))
        text = " ".join("".join(r.choices("abcd", k=r.randint(1, 9))) for _ in range(4))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text)


def test_sentencepiece_long_run():
    """A long run without a blank, in the order of its merges."""
    import time

    import sentencepiece

    path = sentencepiece_codec.default_model()
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Pieces(path)
    r = __import__("random").Random(7)
    text = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    began = time.time()
    assert pieces.merged("▁" + text) == library.encode(text)
    assert time.time() - began < 5


def naive_bits(samples, order, language, text):
    """Code length by the definition, from counts of this language alone."""
    counts = [Counter() for _ in range(order + 1)]
    data = language_id.prepare(language_id.pa.array(samples[language]), order)[0].tobytes()
    for k in range(order + 1):
        counts[k] = Counter(data[j - k : j + 1] for j in range(order, len(data)))
    totals = [defaultdict(lambda: [0, 0]) for _ in range(order + 1)]
    for k in range(order + 1):
        for g, c in counts[k].items():
            totals[k][g[:-1]][0] += c
            totals[k][g[:-1]][1] += 1
    body = language_id.prepare(language_id.pa.array([text]), order)[0].tobytes()
    bits = 0.0
    for j in range(order, len(body)):
        for k in range(order, -1, -1):
            g = body[j - k : j + 1]
            n, d = totals[k].get(g[:-1], (0, 0))
            if counts[k][g]:
                bits += np.log2((n + d) / counts[k][g])
                break
            bits += np.log2((n + d) / d) if n else 0
        else:
            bits += 8
    return bits


def test_ppm_code_lengths():
    samples = {"a": ["the cat sat on the mat", "the dog"], "b": ["le chat est sur le tapis", "été"], "c": [""]}
    model = language_id.Model.learn(samples, 4)
    asked = ["the tapis", "", "zzz été 12", "le chat"]
    got = model.bits(language_id.pa.array(asked))
    for row, text in zip(got, asked, strict=True):
        for column, language in enumerate(model.languages):
            assert row[column] == pytest.approx(naive_bits(samples, 4, language, text), rel=1e-4, abs=1e-3)


def test_ppm_slices(monkeypatch):
    """Slices change nothing, wherever a text begins or ends."""
    model = language_id.Model.learn({"a": ["the cat sat on the mat"], "b": ["le chat est sur le tapis"]}, 4)
    asked = language_id.pa.array(["the tapis", "", None, "zzz été 12" * 5, "le chat", "x"])
    whole = model.bits(asked)
    for size in (1, 3, 7, 16):
        monkeypatch.setattr(language_id, "SLICE", size)
        assert np.allclose(model.bits(asked), whole)


def test_many_languages(spark):
    from pyspark.sql import functions as F

    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 6, f"l{k:03}") for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(table, F.lit(True))
    assert len(model.languages) == 300
    assert all(r["lang_pred"] == f"l{r['doc_id']:03}" for r in language_id.predict(table, model).collect())


def test_predictions_with_odd_rows(spark, clashing, docs, texts, empty):
    """Nulls, repeats, clashing columns and an empty table, for the two classifiers."""
    from pyspark.sql import functions as F

    odd = clashing.unionByName(clashing).unionByName(spark.createDataFrame([tuple([None] * len(clashing.columns))], clashing.schema))
    model = language_id.learn(odd, F.lit(True))
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int")
    weights = toxicity.learn(odd, labels, F.lit(True))
    for name, got, none in (("lang_pred", language_id.predict(odd, model), language_id.predict(empty, model)), ("score", toxicity.score(odd, weights), toxicity.score(empty, weights))):
        rows = got.collect()
        assert len(rows) == odd.count() and none.count() == 0
        by_id = defaultdict(set)
        for r in rows:
            by_id[r["doc_id"]].add(r[name])
        assert all(len(x) == 1 and None not in x for x in by_id.values())


def test_language_id(spark, docs, empty):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(1, "the cat and the dog in the garden", "en"), (2, "le chat et le chien dans le jardin", "fr"), (3, "der Hund und die Katze im Garten", None)], "doc_id long, text string, lang string")
    model = language_id.learn(table, F.lit(True))
    assert model.languages == ["en", "fr"]
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (40, 41, 42, 49))
    assert got[0]["lang_pred"] == "en" and 0.5 < got[0]["score"] <= 1
    none = language_id.learn(empty, F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}


def test_language_id_held_out(spark):
    rows = registry.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert rows.where("lang_pred = lang").count() >= 0.97 * rows.count()


def test_toxicity(spark, docs, empty):
    from pyspark.sql import functions as F

    rows = [(k, ("you awful idiot " if k % 3 == 0 else "you kind friend ") + f"number {k}") for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(0, 300, 2)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    weights = toxicity.learn(table, labels, F.lit(True))
    assert 0 < len(weights.buckets) < 200
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table, weights).collect()}
    assert all((got[k] > 0.5) == (k % 3 == 0) for k in range(1, 300, 2))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, weights).collect())
    assert all(r["score"] < 1e-9 for r in toxicity.score(docs, toxicity.learn(empty, labels, F.lit(True))).collect())


def naive_ftrl(texts, labels, bits, alpha=4.0, beta=1.0, l1=4.0, l2=0.02, rounds=6, seed=7):
    """FTRL-proximal one coordinate at a time, on the same features in the same order."""
    rows = []
    for t in texts:
        _, buckets = toxicity.features(toxicity.pa.array([t]), bits)
        rows.append(sorted(set(buckets.tolist())))
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    share = sum(labels) / len(labels)
    bias, bias_n = float(np.log(share / (1 - share))), 1.0
    order, random = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        random.shuffle(order)
        for k in order.tolist():
            w = {i: weight(i) for i in rows[k]}
            g = 1 / (1 + np.exp(-min(35, max(-35, bias + sum(w.values()))))) - labels[k]
            bias_n += g * g
            bias -= 0.05 * g / bias_n**0.5
            for i in rows[k]:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    return bias, {i: weight(i) for i in list(z) if weight(i)}


def test_toxicity_weights():
    r = __import__("random").Random(3)
    vocabulary = [f"word{k}" for k in range(60)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(1, 30))) + (" awful fool" if k % 4 == 0 else "") for k in range(400)]
    labels = [int(k % 4 == 0) for k in range(400)]
    found = toxicity.fit(texts, labels, bits=14)
    bias, weights = naive_ftrl(texts, labels, 14)
    assert found.bias == pytest.approx(bias)
    assert dict(zip(found.buckets.tolist(), found.values.tolist(), strict=True)) == pytest.approx(weights)
    assert 0 < len(weights) < 2000


def test_toxicity_held_out(spark):
    """Area under the curve on the documents that were not learned from."""
    sf = "/root/testdata/sf0.1"
    rows = registry.op3_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("toxic IS NOT NULL").collect()
    scores, labels = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    rank = np.empty(len(rows))
    rank[np.argsort(scores, kind="stable")] = np.arange(len(rows))
    positive = labels == 1
    area = (rank[positive].mean() - (positive.sum() - 1) / 2) / (~positive).sum()
    assert positive.sum() > 100 and area > 0.95


def test_toxicity_scores_do_not_depend_on_the_sample(spark):
    """Thinning the clean class alone leaves the score of a text without told features as it was."""
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(k, "plain words") for k in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(2000)], "doc_id long, toxic int")
    whole, thinned = (toxicity.score(table.limit(1), toxicity.learn(table, labels, F.lit(True), sample_docs=n)).first()["score"] for n in (8000, 200))
    assert whole == pytest.approx(0.1, abs=0.05) and thinned == pytest.approx(0.1, abs=0.05)


def test_toxicity_learns_from_long_texts(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(k, ("awful " if k % 2 else "kind ") * 10_000) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    got = toxicity.score(table, toxicity.learn(table, labels, F.lit(True))).collect()
    assert all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in got)


def test_word_hashes_depend_on_words_only():
    from loomgraph.llm.words import word_hashes

    a = word_hashes(language_id.pa.array(["Stone, river", None, "river"]))
    b = word_hashes(language_id.pa.array(["river stone"]))
    assert a[0].tolist() == [0, 0, 2] and a[1][0] == b[1][1] and a[1][1] == a[1][2] == b[1][0]


def test_embeddings(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((40, 16))
    x = [*base, *(base[:10] + 0.05 * r.standard_normal((10, 16))), *[base[0]] * 3, *(base[1] + 0.02 * r.standard_normal((200, 16)))]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None]), (905, [1.0, 0.0]), (906, [2.0, 0.0]), (907, [1e308] * 16)]
    got = {q["vec_id"]: q for q in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    good = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if v and None not in v and np.isfinite(v).all() and np.isfinite(np.linalg.norm(v)) and any(v)}
    links, parent = Counter(), {k: k for k, _ in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    assert {k: (v["n_links"], v["component_id"]) for k, v in got.items()} == {k: (links[k], find(k)) for k, _ in rows}


OPERATORS = {
    "quality": lambda d: quality_rules.judge(d),
    "lines": lambda d: line_dedup.dedup(d),
    "ngrams": lambda d: ngram_join.keep_first(d),
    "suffixes": lambda d: suffix_dedup.remove_from_text(d),
    "units": lambda d: substring_dedup.dedup(d),
    "packing": lambda d: packing.pack(d, packing.default_tokenizer()),
    "pieces": lambda d: sentencepiece_codec.encode(d, sentencepiece_codec.default_model()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


def test_empty_embeddings(spark):
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_columns(spark, clashing, name):
    """All columns null in one row, each row twice: no crash, and as many rows as are due."""
    odd = clashing.unionByName(clashing).unionByName(spark.createDataFrame([tuple([None] * len(clashing.columns))], clashing.schema))
    got = OPERATORS[name](odd).count()
    if name == "ngrams":
        assert 0 < got < odd.count()
    elif name == "packing":
        assert got >= odd.count()
    else:
        assert got == odd.count()


def _families(groups: int, size: int, cross: float, dim: int = 64) -> np.ndarray:
    """``groups`` families of ``size`` tight near copies; centres of two neighbouring families meet at ``cross``."""
    r = np.random.default_rng(11)
    out = []
    for _ in range(groups // 2):
        q, _ = np.linalg.qr(r.standard_normal((dim, 2)))
        for centre in (q[:, 0], cross * q[:, 0] + np.sqrt(1 - cross**2) * q[:, 1]):
            noise = r.standard_normal((size, dim))
            out.append(centre + 0.03 * noise / np.linalg.norm(noise, axis=1)[:, None])
    return np.concatenate(out)


def _linked_by_hand(x: np.ndarray, threshold: float = 0.9) -> dict[int, tuple[int, int]]:
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = (unit @ unit.T >= threshold) & ~np.eye(len(x), dtype=bool)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(hit, root[None, :], len(x)).min(1))
        if (new == root).all():
            return {k: (int(hit[k].sum()), int(root[k])) for k in range(len(x))}
        root = new


def test_embedding_lists_full_of_own_family(spark):
    """Every list is full of near copies, and the links of 0.92 lead to another family."""
    x = _families(4, 12, 0.922)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link(table).collect()} == _linked_by_hand(x)


def test_embedding_all_pairs_after_failed_audits(spark, monkeypatch):
    x = np.concatenate([_families(4, 12, 0.922), np.random.default_rng(5).standard_normal((40, 64))])
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").unionByName(spark.createDataFrame([(900, [1.0, 0.0]), (901, [1.0, 0.1])], "vec_id long, embedding array<double>"))
    monkeypatch.setattr(embedding_dedup, "_audit", lambda *_: 0.0)
    monkeypatch.setattr(embedding_dedup, "_verify", lambda _: lambda _table: None)
    monkeypatch.setattr(embedding_dedup, "ATTEMPTS", 1)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 30)
    monkeypatch.setattr(embedding_dedup, "ROWS", 7)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link(table).collect()} == _linked_by_hand(x) | {900: (1, 900), 901: (1, 900)}


def test_embedding_audit_counts_members_alike(spark):
    """One group of 300 whose links are all found does not hide that 100 pairs are lost."""
    r = np.random.default_rng(8)
    pairs = np.repeat(r.standard_normal((100, 64)), 2, axis=0)
    x = np.concatenate([r.standard_normal(64) + 0.02 * r.standard_normal((300, 64)), pairs + 0.02 * r.standard_normal(pairs.shape)])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    classes = spark.createDataFrame([(k, 1, bytearray(v.tobytes())) for k, v in enumerate(unit)], "member long, copies long, unit binary")
    lost = spark.createDataFrame([(k, 299) for k in range(300)], "member long, links long")
    whole = lost.unionByName(spark.createDataFrame([(k, 1) for k in range(300, 500)], "member long, links long"))
    assert embedding_dedup._audit(classes, lost, 500, 0.9) == 0 and embedding_dedup._audit(classes, whole, 500, 0.9) == 1


def test_embedding_tables_grow_with_the_vectors():
    for count in (100, 9_000, 1_000_000):
        together = (1 - np.arccos(0.9) / np.pi) ** embedding_dedup._bits(count)
        assert 1 - (1 - together) ** embedding_dedup._tables(count, 0.9) >= 0.99


def test_embedding_pairs_in_a_hot_bucket(spark):
    """Lists of close pairs meet in a table although their bucket holds many chunks."""
    r = np.random.default_rng(9)
    base = r.standard_normal((600, 64))
    x = np.concatenate([base, base + 0.01 * r.standard_normal(base.shape)])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    classes = spark.createDataFrame([(k, k, bytearray(v.tobytes())) for k, v in enumerate(unit)], "member long, cluster long, unit binary")
    rows = embedding_dedup._started(classes, 2, 1, 0).collect()
    assert sum((q["member"] + 600) % 1200 in q["ids"] for q in rows) > 900
