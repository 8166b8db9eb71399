"""Stems of the published vocabulary, and of odd words."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.stemming import stem, stems
from loomgraph.functions.text import prepare_search_text

# Words and stems of the vocabulary published with the algorithm.
PUBLISHED = """в в, вавиловка вавиловк, вагнера вагнер, вагон вагон, вагона вагон, вагоне вагон, вагонов вагон, вагоном вагон, вагоны вагон,
важная важн, важнее важн, важнейшие важн, важнейшими важн, важничал важнича, важно важн, важного важн, важное важн, важной важн, важном важн,
важному важн, важности важност, важностию важност, важность важност, важностью важност, важную важн, важны важн, важные важн, важный важн,
важным важн, важных важн, вазах ваз, вазы ваз, вакса вакс, вакханка вакханк, вал вал, валандался валанда, валентина валентин,
валериановых валерианов, валерию валер, валетами валет, п п, па па, пава пав, павел павел, павильон павильон, павильонам павильон,
павла павл, павлиний павлин, павлиньи павлин, павлиньим павлин, павлович павлович, павловна павловн, павловне павловн, павловной павловн,
павловну павловн, павловны павловн, павловцы павловц, павлыч павлыч, павлыча павлыч, пагубная пагубн, падает пада, падай пада, падал пада,
падала пада, падаль падал, падать пада, падаю пада, падают пада, падающего пада, падающие пада, падеж падеж, падение паден, падением паден,
падении паден, падений паден, падения паден, паденье паден, паденья паден, падет падет, падут падут, падучая падуч, падчерица падчериц, падшая падш"""


def test_published_words(spark):
    pairs = [tuple(p.split()) for p in PUBLISHED.replace("\n", " ").split(", ")]
    rows = spark.createDataFrame(pairs, "word string, stem string").select("word", "stem", stem(F.col("word")).alias("got"))
    assert rows.count() > 80 and [tuple(r) for r in rows.where("NOT got <=> stem").collect()] == []


def test_odd_words(spark):
    words = [None, "", "docker", "вдоль-по", "взгляд" * 3000, "ёлками", "мгновенность"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(stem(F.col("w"))).collect()]
    assert got == [None, "", "docker", "вдоль-п", "взгляд" * 3000, "елк", "мгновен"]


def test_lists_of_words(spark):
    """Lists give the stems of their words, as the rules do one by one; of a batch each different word is cut once."""
    pairs = [p.split() for p in PUBLISHED.replace("\n", " ").split(", ")]
    lists = [[w for w, _ in pairs], None, [], ["ёлками", None, "docker", "вдоль-по", ""], [w for w, _ in pairs[:5]] * 3]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "id int, w array<string>")
    got = rows.select("id", stems("w").alias("got"), F.transform("w", stem).alias("wanted")).orderBy("id").collect()
    assert [r["got"] for r in got] == [r["wanted"] for r in got] and got[0]["got"] == [s for _, s in pairs]
    plan = rows.select(prepare_search_text(F.lit("слова словами"))).limit(1)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan  # no dozen of native replacements for each word of each text
