"""One object for the ways to use the library: ask, give feedback, look at and look after a graph."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.providers import call_model, hashed_embedding
from .functions.scores import cosine
from .functions.text import dynamic_top_k
from .operators import graph, learning, ranking, reasoning, resolver, retrieval
from .operators.enrichment import memory_context
from .operators.ingestion import document_rows, ingest, processed
from .operators.search import Bm25Index
from .schema import KEYS
from .session import checkpointed, written
from .sources.readers import directory
from .sources.store import GraphStore

INSTRUCTION = "Ответь на вопрос по этим воспоминаниям."
REWRITE = "Переформулируй вопрос другими словами."
SUPPOSE = "Напиши предполагаемый короткий ответ на вопрос."


class Engine:
    """A graph store with models: ``generate`` answers a batch of prompts and must be picklable, ``embed`` makes an expression of a text's vector."""

    def __init__(self, spark: SparkSession, root: str, generate: Callable[[list[str]], list[str]] | None = None, embed: Callable[[Column], Column] = hashed_embedding):
        self.spark, self.store, self.embed = spark, GraphStore(spark, root), embed
        self.generate = generate or (lambda prompts: [""] * len(prompts))
        self.store.setup()

    def ingest(self, docs: DataFrame, raw: DataFrame) -> dict[str, int]:
        """Save documents (doc_id, text [, title, doc_type, source_path]) with what extraction found in them (id, raw), in one commit; rows in store by table."""
        own = self.store.begin()
        docs = written(docs.dropDuplicates(["doc_id"]), "docs")
        found = ingest(docs, raw, own.read("concepts"))
        rows = {t: written(found[t], t) for t in ("concepts", "relations", "memories", "memory_concept", "memory_document")}
        documents = written(processed(document_rows(docs), rows["memory_document"], rows["memory_concept"], F.current_timestamp()), "documents")
        rows["memories"] = written(rows["memories"].withColumn("embedding", self.embed(F.col("content"))), "memories")
        rows = {"documents": documents} | rows
        for table, part in rows.items():
            own.save(table, part)
        number = own.commit()
        # What is in the store, not what was offered: links without both ends are not saved.
        return {table: self.store.read(table, number).join(part.select(*KEYS[table]).distinct(), KEYS[table], "left_semi").count() for table, part in rows.items()}

    def ingest_directory(self, path: str, extract: Callable[[list[str]], list[str]], glob: str = "*.{md,txt,markdown}") -> dict[str, int]:
        """Ingest all documents below ``path``; ``extract`` (picklable) answers batches of texts in the line protocol."""
        docs = written(directory(self.spark, path, glob).select(F.col("id").alias("doc_id"), F.col("content").alias("text"), "title", "doc_type", "source_path", "source_hash"), "read")
        raw = call_model(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("prompt")), extract).select("id", F.col("answer").alias("raw"))
        return self.ingest(docs, written(raw, "raw"))

    def _lists(self, question: str, names: Sequence[str]) -> tuple[dict[str, DataFrame], DataFrame]:
        """Lists (id, score) of one question by source, and its row (query_id, text, embedding)."""
        asked = self.spark.createDataFrame([(0, question)], "query_id int, text string").withColumn("embedding", self.embed(F.col("text")))
        concepts, relations, links, memories = (self.store.read(t) for t in ("concepts", "relations", "memory_concept", "memories"))
        named = self.spark.createDataFrame([(0, n) for n in names], "query_id int, name string")
        by_words = Bm25Index(concepts, text="name").search(asked, k=5)
        matched = resolver.matched(named, concepts).select("query_id", F.col("concept_id").alias("id"))
        seeds = written(reasoning.fallback_seeds(matched, by_words.where("false"), by_words).select("id").distinct(), "seeds")
        told = concepts.join(seeds, "id", "left_semi").select(F.lit(0).alias("query_id"), "name", "aliases")
        lists = {
            "bm25": retrieval.bm25_list(Bm25Index(memories), retrieval.expanded_question(asked.select("query_id", "text"), told), memories),
            "vector": retrieval.vector_list(memories.select("id", "embedding"), asked.select("query_id", "embedding"), memories),
            "graph": retrieval.graph_list(seeds, relations, links, memories, concepts=concepts),
            "path": retrieval.path_result(seeds, relations, concepts, links, memories)[0],
        }
        return {name: rows.select("id", "score") for name, rows in lists.items()}, asked

    def _chosen(self, lists: dict[str, DataFrame], asked: DataFrame, k: int | None) -> DataFrame:
        memories = self.store.read("memories")
        whole: DataFrame | None = None
        for name, rows in lists.items():
            own = rows.select("id", "score", F.lit(name).alias("source"))
            whole = own if whole is None else whole.unionByName(own)
        if k is None:
            k = asked.select(dynamic_top_k(F.col("text"))).first()[0]
        vectors = memories.select("id", "embedding")
        relevance = vectors.join(F.broadcast(asked.select(F.col("embedding").alias("q")))).select("id", cosine(F.col("embedding"), F.col("q")).alias("relevance"))  # one question
        return retrieval.retrieve_all(whole, memories, F.current_timestamp(), k, relevance, vectors, asked, weights=retrieval.WEIGHTS | retrieval.MORE_WEIGHTS)

    def retrieve(self, question: str, names: Sequence[str], k: int | None = None) -> DataFrame:
        """Memories for a question whose concept names are known: BM25, vector, graph and path lists, fused and diverse; id, sources, fused, score, place."""
        return self._chosen(*self._lists(question, names), k)

    def retrieve_rewritten(self, question: str, names: Sequence[str], k: int | None = None) -> DataFrame:
        """Like ``retrieve``, with the lists of two more forms of the question, which the model is asked for.

        A paraphrase is searched for by its words, a made-up answer by its
        vector; a form that the model does not give adds no list.
        """
        lists, asked = self._lists(question, names)
        memories = self.store.read("memories")
        forms = self.spark.createDataFrame([(0, "rewrite", f"{REWRITE}\n{question}"), (0, "hyde", f"{SUPPOSE}\n{question}")], "query_id int, form string, prompt string")
        told = written(call_model(forms, self.generate), "forms").where("trim(answer) <> ''").select("query_id", "form", F.col("answer").alias("text"))
        given = {r["form"] for r in told.select("form").collect()}  # two rows at most
        form = lambda name: told.where(F.col("form") == name)
        if "rewrite" in given:
            lists["rewrite"] = retrieval.bm25_list(Bm25Index(memories), form("rewrite").select("query_id", "text"), memories)
        if "hyde" in given:
            lists["hyde"] = retrieval.vector_list(memories.select("id", "embedding"), form("hyde").select("query_id", self.embed(F.col("text")).alias("embedding")), memories)
        return self._chosen(lists, asked, k)

    def reason(self, question: str, names: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = (), k: int | None = None) -> str:
        """An answer; the episode that records it is saved, and the memories it used are counted as read."""
        concepts, memories = self.store.read("concepts"), self.store.read("memories")
        found = self.retrieve(question, names, k).select("id", "score", "sources", "place")
        activated = resolver.matched(self.spark.createDataFrame([(n,) for n in names], "name string"), concepts).select(F.col("concept_id").alias("id"), F.lit(1.0).alias("activation"))
        found, activated = reasoning.without_nodes(found, activated, exclude)
        found = checkpointed(reasoning.with_memories(found, memories, [i for i in include if i.startswith("mem")]))
        activated = checkpointed(reasoning.with_concepts(activated, self.spark.createDataFrame([(i,) for i in include if i.startswith("c_")], "id string")))
        asked = self.spark.createDataFrame([(0, question)], "query_id int, query string")
        rows = found.join(memories.select("id", "content", "confidence", "memory_type"), "id").withColumn("query_id", F.lit(0))
        estimates = reasoning.confidence(rows.withColumn("sources", F.split("sources", r"\+")))
        counts = rows.agg(F.count_if(F.col("memory_type") == "procedure").alias("p")).join(F.broadcast(activated.agg(F.count(F.lit(1)).alias("a"))))
        weight = reasoning.importance(F.lit(question), F.lit(len(names)), F.col("a"), F.col("p"))
        estimates = asked.select("query_id").join(estimates, "query_id", "left").join(F.broadcast(counts.select(weight.alias("importance"))))
        used = rows.groupBy("query_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        active = activated.groupBy(F.lit(0).alias("query_id")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
        answers, episodes = reasoning.reason(asked, memory_context(rows, "query_id"), active, used, estimates, self.generate, F.current_timestamp(), INSTRUCTION)
        own = self.store.begin()
        own.save("episodes", written(episodes, "episodes"))
        used = own.read("memories").join(found.select("id"), "id", "left_semi")
        own.save("memories", written(learning.touch_memories(used, found.select("id"), F.current_timestamp()), "touched"))
        own.commit()
        return answers.first()["answer"]

    def feedback(self, episode_id: str, kind: str, correction: str | None = None) -> None:
        """positive, negative or correction, for one episode."""
        now, episodes = F.current_timestamp(), self.store.read("episodes")
        events = self.spark.createDataFrame([(episode_id, correction)], "episode_id string, correction_text string")
        own = episodes.join(events.select(F.col("episode_id").alias("id")), "id", "left_semi")
        used = own.select(F.col("id").alias("episode_id"), F.explode("memories_used").alias("memory_id"))
        active = own.select(F.col("id").alias("episode_id"), F.explode("concepts_activated").alias("concept_id"))
        changed = learning.feedback(kind, episodes, self.store.read("memories"), self.store.read("relations"), events, used, active, now)
        own = self.store.begin()
        for table, rows in changed.items():
            own.save("memories" if table == "new_memories" else table, written(rows, table))
        own.commit()

    def re_reason(self, episode_id: str) -> tuple[DataFrame, DataFrame]:
        """Untried memories and other behaviours for a failed episode."""
        own = self.store.get("episodes", [episode_id])
        failed = own.select(F.explode("concepts_activated").alias("id"))
        tried = own.select(F.explode("memories_used").alias("id"))
        return reasoning.re_reason(failed, tried, self.store.read("memory_concept"), self.store.read("memories"), self.store.read("episodes"), self.store.read("episode_concept"), (own.first() or {"behavior_name": ""})["behavior_name"])

    def forget(self) -> DataFrame:
        """Rate all memories; memories by status afterwards."""
        self.store.write("memories", checkpointed(learning.forget(self.store.read("memories"), F.current_timestamp())))
        return learning.status_histogram(self.store.read("memories"))

    def calibrate(self) -> None:
        self.store.write("memories", checkpointed(learning.calibrate(self.store.read("memories"))))

    def stats(self) -> DataFrame:
        return graph.quality_report(self.store.read("concepts"), self.store.read("relations"))

    def page(self, table: str, order: str, limit: int = 50, offset: int = 0) -> DataFrame:
        return self.store.read(table).orderBy(F.desc(order), "id").offset(offset).limit(limit)

    def neighbours(self, name: str, limit: int = 50) -> DataFrame:
        concepts = self.store.read("concepts")
        asked = concepts.where(F.lower("name") == name.lower()).select("id")
        found = graph.neighbours(asked, self.store.read("relations"), concepts, limit)
        return found.join(concepts.select(F.col("id").alias("target_id"), "name"), "target_id").select("source_id", "target_id", "name", "weight")

    def duplicates(self, least: float = 0.9) -> DataFrame:
        """Pairs of concept names whose spelling is alike."""
        names = self.store.read("concepts").where(graph.is_active(F.col("status"))).select(F.lower("name").alias("n")).distinct()
        return resolver.alike(names.select(F.col("n").alias("a")), names.select(F.col("n").alias("b")), least).where("a < b")

    def merge(self, pairs: Sequence[tuple[str, str, float]], dry_run: bool = False) -> dict[str, str]:
        """Merge reviewed pairs (canonical, other, similarity), most similar first; edges and links follow.  Merged id to canonical id."""
        merged = ranking.greedy_merges(pairs)
        if merged and not dry_run:
            table = checkpointed(self.spark.createDataFrame(list(merged.items()), "id string, canonical string"))
            concepts, relations, links = (self.store.read(t) for t in ("concepts", "relations", "memory_concept"))
            moved = links.join(table.withColumnRenamed("id", "concept_id"), "concept_id", "left").select("memory_id", F.coalesce("canonical", "concept_id").alias("concept_id")).distinct()
            marked = concepts.join(table, "id", "left").withColumn("status", F.when(F.col("canonical").isNotNull(), "merged").otherwise(F.col("status"))).withColumn("canonical_id", F.coalesce("canonical", "canonical_id")).drop("canonical")
            own = self.store.begin()
            for name, rows in (("relations", graph.redirect(relations, table)), ("memory_concept", moved), ("concepts", marked)):
                own.write(name, written(rows, name))
            own.commit()
        return merged

    def delete_episode(self, episode_id: str) -> bool:
        return self.store.delete_episode(episode_id)

    def reset(self) -> None:
        self.store.clear()
