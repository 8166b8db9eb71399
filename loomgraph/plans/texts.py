"""Queries of the text functions and of the parsers of tables, lists and line protocols.

Inputs are put together from the driver's tables.  Where an input is built from
columns, the SQL says what must come out in terms of these columns, so it
parses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions.similarity import phonetic_similarity
from ..functions.stemming import stem_sql
from ..operators import enrichment, meaning, ranking, structure
from ..session import written
from ..sources import readers
from ..sources.derive import Graph
from .catalogue import BREAKS, SENTENCES, now, query, sentence_breaks, sentences_of

LATIN26, CYRILLIC26 = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстуввхузж"[:26]


def _cyrillic(text: Column) -> Column:
    """Cyrillic letters for Latin ones, so that there is Cyrillic text to work on."""
    return F.translate(F.lower(text), LATIN26, CYRILLIC26)


def _sql_cyrillic(text: str) -> str:
    return f"translate(lower({text}), '{LATIN26}', '{CYRILLIC26}')"


def _sql_to_latin(text: str) -> str:
    one = {c: x for c, x in T.LETTERS_TO_LATIN.items() if len(x) == 1}
    for c, x in T.LETTERS_TO_LATIN.items():
        if len(x) != 1:
            text = f"replace(replace({text}, '{c}', '{x}'), '{c.upper()}', '{x.capitalize()}')"
    one |= {c.upper(): x.upper() for c, x in one.items()}
    return f"translate({text}, '{''.join(one)}', '{''.join(one.values())}')"


def _sql_to_cyrillic(text: str) -> str:
    """For lower-case texts."""
    for latin, letter in T.DIGRAPHS_TO_CYRILLIC.items():
        text = f"replace({text}, '{latin}', '{letter}')"
    text = f"replace({text}, 'x', 'кс')"
    one = {c: x for c, x in T.LETTERS_TO_CYRILLIC.items() if len(x) == 1}
    return f"translate({text}, '{''.join(one)}', '{''.join(one.values())}')"


PREFIXES = ("кто такой ", "почему ", "Сравни ", "контакты ", "найди ", "кто в команде ")
_prefix = "[" + ", ".join(f"'{p}'" for p in PREFIXES) + "][(conv_id % 6)::INT + 1]"
_tokens = "list_filter(regexp_extract_all(lower(q), '[а-яёa-z](?:[а-яёa-z\\-]*[а-яёa-z])?'), lambda w: length(w) > 1 OR w IN ('я', 'в', 'с', 'к', 'у', 'о', 'а', 'и'))"


def _one_of_patterns(patterns: tuple[str, ...]) -> str:
    return "regexp_matches(trim(lower(q)), '" + "|".join(patterns) + "')"


QUESTIONS = f"""WITH c AS (SELECT conv_id, turn, {_prefix} || replace(text, chr(10), ' ') || ' (a+b) [c]: "d"?' AS q FROM conversations WHERE role = 'user'),
k AS (SELECT *, CASE WHEN {_one_of_patterns(T.SIMPLE_QUERIES)} THEN 'simple' WHEN {_one_of_patterns(T.COMPLEX_QUERIES)} THEN 'complex' ELSE 'moderate' END AS complexity,
  length(regexp_replace(q, '[^а-яА-ЯёЁ]', '', 'g')) AS cyr, length(regexp_replace(q, '[^a-zA-Z]', '', 'g')) AS lat FROM c)"""


def _questions(g: Graph) -> DataFrame:
    asked = g.table("conversations").where("role = 'user'")
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (F.col("conv_id") % 6).cast("int") + 1)
    return asked.select("conv_id", "turn", F.concat(prefix, F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(' (a+b) [c]: "d"?')).alias("q"))


@query(QUESTIONS + f""" SELECT conv_id, turn, regexp_replace(q, '([+\\-&|!(){{}}\\[\\]^"~*?:\\\\/])', '\\\\\\1', 'g') AS escaped, complexity, CASE complexity WHEN 'simple' THEN 4 WHEN 'complex' THEN 8 ELSE 6 END AS top_k,
array_to_string({_tokens}, ' ') AS tokens, cyr > 0 AS has_cyrillic, lat > 0 AS has_latin, cyr > 0 AND lat > 0 AS is_mixed, cyr / (cyr + lat) >= 0.5 AS is_russian, round(cyr / (cyr + lat), 6) AS share,
CASE conv_id % 6 WHEN 0 THEN 'person' WHEN 5 THEN 'team_members' END AS person_kind FROM k""", graph_views=False)
def question_features(g: Graph) -> DataFrame:
    q = F.col("q")
    return _questions(g).select(
        "conv_id", "turn", T.escape_query(q).alias("escaped"), T.query_complexity(q).alias("complexity"), T.dynamic_top_k(q).alias("top_k"), F.array_join(T.russian_tokens(q), " ").alias("tokens"),
        T.has_cyrillic(q).alias("has_cyrillic"), T.has_latin(q).alias("has_latin"), T.is_mixed(q).alias("is_mixed"), T.is_russian(q).alias("is_russian"), F.round(T.cyrillic_share(q), 6).alias("share"), enrichment.person_query(q)["kind"].alias("person_kind"),
    )


_name = "lower(p_name)"
_mixed = "translate(lower(p_name) || 'жжжжжжжжжжжжжжжжжжжжжжжжжжж', 'aeo', 'аео')"


@query(f"""WITH n AS (SELECT p_partkey AS id, {_name} AS n, {_sql_cyrillic(_name)} AS c, {_mixed} AS m FROM part),
v AS (SELECT *, {_sql_to_latin('c')} AS latin, {_sql_to_cyrillic('n')} AS cyrillic, translate(m, 'ABCEHKMOPTXYaceopyx', 'АВСЕНКМОРТХУасеорух') AS fixed FROM n)
SELECT id, latin, cyrillic, fixed, round(jaro_winkler_similarity({_sql_to_latin('n')}, latin), 6) AS sounds, array_to_string(list_distinct_ordered, '|') AS variants FROM (
  SELECT *, list_filter([n, CASE WHEN cyrillic <> n THEN cyrillic END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM v)""", graph_views=False)
def script_forms(g: Graph) -> DataFrame:
    n = F.lower("p_name")
    mixed = F.translate(F.concat(n, F.lit("ж" * 27)), "aeo", "аео")
    rows = g.table("part").select(F.col("p_partkey").alias("id"), n.alias("n"), _cyrillic(F.col("p_name")).alias("c"), mixed.alias("m"))
    return rows.select("id", T.to_latin(F.col("c")).alias("latin"), T.index_forms(F.col("n"))["cyrillic"].alias("cyrillic"), T.fix_lookalikes(F.col("m")).alias("fixed"), F.round(phonetic_similarity(F.col("n"), F.col("c")), 6).alias("sounds"), F.array_join(T.script_variants(F.col("n")), "|").alias("variants"))


_stop_list = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_ru = "regexp_extract_all(lower(t), '[а-яёa-z](?:[а-яёa-z\\-]*[а-яёa-z])?')"
_stem = stem_sql("w")


@query(f"""WITH t AS (SELECT doc_id, {_sql_cyrillic("text")} || '  не только это!!! но и то...' AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, t, list_filter({_ru}, lambda w: length(w) > 1 OR w IN ('я', 'в', 'с', 'к', 'у', 'о', 'а', 'и')) AS w FROM t),
s AS (SELECT *, list_filter(w, lambda x: x NOT IN ({_stop_list})) AS kept FROM k)
SELECT doc_id, array_to_string(kept, ' ') AS plain, array_to_string(list_filter(list_transform(kept, lambda w: {_stem}), lambda x: x NOT IN ({_stop_list})), ' ') AS lemmas,
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), '[.]{{2,}}', '.', 'g'), '[!]{{2,}}', '!', 'g'), '[?]{{2,}}', '?', 'g')) AS clean FROM s""", graph_views=False)
def search_texts(g: Graph) -> DataFrame:
    rows = g.table("documents").where("text IS NOT NULL").select("doc_id", F.concat(_cyrillic(F.col("text")), F.lit("  не только это!!! но и то...")).alias("t"))
    return T.with_search_texts(rows, "t").select("doc_id", "plain", "lemmas", T.clean_text(F.col("t")).alias("clean"))


@query("""SELECT conv_id, turn, 'Let me think: ' || h || chr(10) || chr(10) || 'end' AS shown, h || chr(10) || chr(10) || 'end' AS said, 'plan ' || conv_id AS thought, true AS leaks, 'Let me think: ' || h || ' end' AS flat
FROM (SELECT conv_id, turn, md5(text) AS h FROM conversations)""", graph_views=False)
def model_answers(g: Graph) -> DataFrame:
    raw = F.concat(F.lit("<think>plan "), F.col("conv_id").cast("string"), F.lit("</think>Let me think: "), F.md5("text"), F.lit("\n\n\n\n</think>end<|im_system|>x<|im_end|>"))
    rows = g.table("conversations").select("conv_id", "turn", raw.alias("r"))
    r = F.col("r")
    return rows.select("conv_id", "turn", T.strip_thinking(r).alias("shown"), T.strip_thinking(r, aggressive=True).alias("said"), T.thinking_of(r).alias("thought"), T.leaks_thinking(r).alias("leaks"), T.strip_thinking(r, structure=False).alias("flat"))


@query("""SELECT id, id AS json_id, 'alpha' || id || '|beta|gamma' AS items, 'kind=tool,name=a' || id || ',size=7' AS pairs, 'body' || id AS inside, CASE WHEN id % 2 = 0 THEN 'fact' ELSE 'procedure' END AS kind,
least(10.0, greatest(1.0, (id % 13)::DOUBLE)) AS importance, 'answer ' || id AS clean, CASE WHEN id % 2 = 0 THEN 'step_by_step' ELSE 'troubleshoot' END AS behavior, CASE WHEN id % 2 = 0 THEN 'docker' ELSE 'general' END AS domain, 'First ' || id AS summary,
'https://a.example/' || id || '/x' AS url, CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.9 END::DOUBLE AS same_source FROM (SELECT s_suppkey AS id FROM supplier)""", graph_views=False)
def parsed_answers(g: Graph) -> DataFrame:
    i = F.col("id").cast("string")
    c = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    even = F.col("id") % 2 == 0
    rows = g.table("supplier").select(F.col("s_suppkey").alias("id"))
    pairs = T.key_values(c("name: a", i, "\nsize = 7\n**kind**: tool\n"))
    behavior = T.behavior_of(F.when(even, "how about docker").otherwise("an error here"), F.when(even, "ok\nСТРАТЕГИЯ: [Step by step] — first this").otherwise("ok"))
    here, there = c("https://a.example/", i, "/x"), F.when(even, c("HTTPS://a.example/", i, "/x/")).otherwise(c("https://b.example/y/", "x"))
    return rows.select(
        "id", F.variant_get(T.tolerant_json(c('Sure: ```json\n{"id": ', i, ', "x": [1]}\n``` done')), "$.id", "bigint").alias("json_id"),
        F.array_join(T.parse_list(c("1. alpha", i, "\n2. beta\n- gamma")), "|").alias("items"),
        F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter(pairs, lambda k, v: k.isin("name", "size", "kind")))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("pairs"),
        T.between(c("x <<< body", i, " >>> y"), "<<<", ">>>").alias("inside"), T.one_of(F.when(even, " FACT ").otherwise("procedure"), ("fact", "procedure"), "fact").alias("kind"), T.importance_of((F.col("id") % 13).cast("string")).alias("importance"),
        T.clean_answer(c("answer ", i, "\nСТРАТЕГИЯ: [x] — y")).alias("clean"), behavior["name"].alias("behavior"), behavior["domain"].alias("domain"), enrichment.summary(c("First ", i, ". Second.")).alias("summary"),
        F.get(T.urls(c("see https://a.example/", i, "/x, and (https://a.example/", i, "/x).")), F.lit(0)).alias("url"), T.source_match(here, there).alias("same_source"),
    )


@query("""WITH a AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'short one' ELSE 'a longer answer with many words, which says all that there is to say' END AS answer, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'https://x' END AS url, s_suppkey % 11 / 10.0 AS v FROM supplier),
t AS (SELECT *, CASE WHEN answer = '' AND url = '' THEN 'empty' WHEN answer = '' THEN 'url_only' ELSE (CASE WHEN id % 4 = 1 THEN 'short' ELSE 'full' END) || CASE WHEN url = '' THEN '_no_url' ELSE '' END END AS kind FROM a),
w AS (SELECT *, CASE kind WHEN 'url_only' THEN [0.5, 0.1, 0.3, 0.1] WHEN 'short' THEN [0.2, 0.4, 0.25, 0.15] WHEN 'short_no_url' THEN [0, 0.5, 0.3, 0.2] WHEN 'full' THEN [0.1, 0.4, 0.3, 0.2] WHEN 'full_no_url' THEN [0, 0.45, 0.35, 0.2] ELSE [0, 0, 0.7, 0.3] END AS w FROM t)
SELECT id, kind, round(v, 6)::DOUBLE AS source_match, 0.5::DOUBLE AS key_info, round((w[1] * v + w[2] * 0.5 + w[3] * 1.0 + w[4] * 0.25)::DOUBLE, 6) AS overall FROM w""", graph_views=False)
def judged_answers(g: Graph) -> DataFrame:
    k = F.col("s_suppkey")
    answer = F.when(k % 4 == 0, "").when(k % 4 == 1, "short one").otherwise("a longer answer with many words, which says all that there is to say")
    rows = g.table("supplier").select(k.alias("id"), answer.alias("answer"), F.when(k % 3 == 0, "").otherwise("https://x").alias("url"), F.concat(F.lit("RESULT|"), F.format_number(k % 11 / 10, 1), F.lit("|0.5|1.0|0.25\nthat is all")).alias("raw"))
    told = rows.withColumn("s", enrichment.judged_scores(F.col("raw"))).withColumn("kind", S.answer_type(F.col("answer"), F.col("url")))
    parts = [F.col(f"s.{n}") for n in ("source_match", "key_info_match", "relevance", "no_contradiction")]
    return told.select("id", "kind", F.round(parts[0], 6).alias("source_match"), parts[1].alias("key_info"), F.round(S.overall(F.col("kind"), parts), 6).alias("overall"))


CELLS = (*T.YES_CELLS, *T.NO_CELLS, "N/A", "н/д", "blue")
_cells = ", ".join(f"'{c}'" for c in CELLS)


@query(f"""WITH c AS (SELECT s_suppkey AS id, [{_cells}][(s_suppkey % {len(CELLS)})::INT + 1] AS cell, substr('{T.BULLETS}', (s_suppkey % {len(T.BULLETS)})::INT + 1, 1) AS mark FROM supplier),
n AS (SELECT *, CASE WHEN id % {len(CELLS)} < {len(T.YES_CELLS)} THEN 'да' WHEN id % {len(CELLS)} < {len(T.YES_CELLS) + len(T.NO_CELLS)} THEN 'нет' WHEN cell = 'blue' THEN 'blue' ELSE '' END AS told FROM c)
SELECT id, told, '  - one' || chr(10) || '- two ' || mark AS bullets, '| x | ' || told || ' |' AS line, 'Title ' || id AS title, 'x' || chr(10) || chr(10) || 'é' AS clean FROM n""", graph_views=False)
def normalized_marks(g: Graph) -> DataFrame:
    k = F.col("s_suppkey")
    cell = F.element_at(F.array(*[F.lit(c) for c in CELLS]), (k % len(CELLS)).cast("int") + 1)
    mark = F.substring(F.lit(T.BULLETS), (k % len(T.BULLETS)).cast("int") + 1, F.lit(1))
    rows = g.table("supplier").select(k.alias("id"), cell.alias("cell"), mark.alias("mark"))
    line = F.concat(F.lit("| x | "), F.col("cell"), F.lit(" |"))
    page = F.concat(F.lit("---\nkey: v\n---\n\n# Title "), F.col("id").cast("string"), F.lit("\ntext"))
    return rows.select("id", T.normalize_cell(F.col("cell")).alias("told"), T.normalize_bullets(F.concat(F.lit("  "), "mark", F.lit(" one\n"), "mark", F.lit(" two "), "mark")).alias("bullets"), T.normalize_table_lines(line).alias("line"), T.title_of(page).alias("title"), T.clean_markdown(F.lit("---\nkey: v\n---\nx  \n\n\n\né ")).alias("clean"))


@query("""SELECT s_suppkey AS id, s_name AS title, 'https://w.example/' || s_suppkey AS url, 'Main|Teams|' || s_name AS path, 'Main' AS space, 'Teams|' || s_name AS parents, 'Body of ' || s_name AS content,
CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Teams' END AS hint FROM supplier""", graph_views=False)
def exported_pages(g: Graph) -> DataFrame:
    c = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    raw = c("Навигация: Main > Teams > ", F.col("s_name"), "\nID страницы: 5\nЗаголовок страницы: ", F.col("s_name"), "\nURL страницы: https://w.example/", F.col("s_suppkey").cast("string"), "\n\nBody of ", F.col("s_name"), "\n")
    rows = g.table("supplier").select(F.col("s_suppkey").alias("id"), raw.alias("raw")).withColumn("p", T.page_fields(F.col("raw")))
    no_headings = F.array().cast("array<string>")
    hint = structure.context_hint(no_headings, F.when(F.col("id") % 2 == 0, F.col("p.title")).otherwise("home"), F.slice("p.parents", 1, 1), F.col("p.space"))
    return rows.select("id", "p.title", "p.url", F.array_join("p.path", "|").alias("path"), "p.space", F.array_join("p.parents", "|").alias("parents"), T.strip_page_fields(F.col("raw")).alias("content"), hint.alias("hint"))


@query(f"WITH {SENTENCES} SELECT doc_id, (i - 1)::INT AS idx, s[i] AS sentence, floor(len(list_filter(string_split_regex(trim(s[i]), '\\s+'), lambda x: x <> '')) * 1.3)::INT AS n_tokens FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM sent)", graph_views=False)
def document_sentences(g: Graph) -> DataFrame:
    return sentences_of(g).select("doc_id", "idx", "sentence", T.token_count(F.col("sentence")).alias("n_tokens"))


# Chunks of sentences by a fold: [tokens of the current chunk, its first sentence, chunks so far].
@query(f"""WITH {BREAKS}, st AS (SELECT doc_id, (i - 1) AS idx, floor(len(list_filter(string_split_regex(trim(s[i]), '\\s+'), lambda x: x <> '')) * 1.3)::INT AS n FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM sent)),
r AS (SELECT st.doc_id, st.idx, n, coalesce(is_break, false) AS b FROM st LEFT JOIN br ON br.doc_id = st.doc_id AND br.idx = st.idx),
walk AS (SELECT doc_id, idx, n AS total, 0 AS chunk FROM r WHERE idx = 0
  UNION ALL SELECT r.doc_id, r.idx, CASE WHEN w.total + r.n > 60 OR r.b AND w.total >= 20 THEN r.n ELSE w.total + r.n END, w.chunk + CASE WHEN w.total + r.n > 60 OR r.b AND w.total >= 20 THEN 1 ELSE 0 END FROM walk w JOIN r ON r.doc_id = w.doc_id AND r.idx = w.idx + 1),
ch AS (SELECT doc_id, chunk, min(idx) AS first, max(idx) AS last, max(total) AS tokens FROM walk GROUP BY 1, 2),
fold AS (SELECT doc_id, chunk, 0 AS part, tokens FROM ch WHERE chunk = 0
  UNION ALL SELECT c.doc_id, c.chunk, f.part + CASE WHEN f.tokens < 20 AND f.tokens + c.tokens <= 60 THEN 0 ELSE 1 END, CASE WHEN f.tokens < 20 AND f.tokens + c.tokens <= 60 THEN f.tokens + c.tokens ELSE c.tokens END FROM fold f JOIN ch c ON c.doc_id = f.doc_id AND c.chunk = f.chunk + 1)
SELECT doc_id, part::INT AS idx, min(first)::INT AS first, max(last)::INT AS last, max(fold.tokens)::INT AS n_tokens FROM fold JOIN ch USING (doc_id, chunk) GROUP BY doc_id, part""", graph_views=True)
def sentence_chunks(g: Graph) -> DataFrame:
    """Chunks of 20 to 60 tokens without an overlap; the tests cover overlaps."""
    rows = sentence_breaks(g).select("doc_id", F.transform("sentences", T.token_count).alias("sizes"), "breaks")
    found = rows.select("doc_id", F.posexplode(structure.chunks_of(F.col("sizes"), F.col("breaks"), most=60, least=20, overlap=0)).alias("idx", "c"))
    return found.select("doc_id", "idx", "c.*")


# Pages put together from regions and nations.


def _pages(g: Graph) -> DataFrame:
    """doc_id and text: a heading, a paragraph, a table of nations, a numbered list of them, definitions and an end."""
    n = g.table("nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    yes = F.when(F.col("n_nationkey") % 2 == 0, "да").otherwise("нет")
    row = F.concat_ws("", F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" | "), yes, F.lit(" |"))
    lines = n.groupBy("r_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", row.alias("row")))).alias("ns"))
    r = g.table("region").join(lines, "r_regionkey")
    joined = lambda f: F.array_join(F.transform("ns", f), "\n")
    text = F.concat(
        F.lit("# Regions\n\n## "), F.col("r_name"), F.lit("\n\nNations of "), F.col("r_name"), F.lit(".\n\n| name | key | even |\n|---|---|---|\n"), joined(lambda x: x["row"]),
        F.lit("\n\nAfter the table.\n\n### Steps\n\n"), joined(lambda x, i: F.concat((i + 1).cast("string"), F.lit(". Visit "), x["n_name"])),
        F.lit("\n\n### Terms\n\n"), joined(lambda x: F.concat(x["n_name"], F.lit(": a nation of the region with the key "), x["n_nationkey"].cast("string"))), F.lit("\n\nThe end.\n"),
    )
    return r.select(F.col("r_regionkey").alias("doc_id"), text.alias("text"))


NATIONS = """n AS (SELECT n_nationkey AS k, n_name AS n, n_regionkey AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'да' ELSE 'нет' END AS even, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
r AS (SELECT r_regionkey AS doc_id, r_name, list(n.n ORDER BY k) AS names, list(k ORDER BY k) AS keys, list(even ORDER BY k) AS evens, count(*) AS c FROM region JOIN n ON n.doc_id = r_regionkey GROUP BY 1, 2)"""


@query(f"""WITH {NATIONS} SELECT doc_id, 0 AS idx, r_name AS title, 'name|key|even' AS headers, array_to_string(list_transform(range(1, c + 1), lambda i: names[i] || '/' || keys[i] || '/' || evens[i]), ';') AS rows,
false AS is_comparison, array_to_string(list_transform(range(1, c + 1), lambda i: names[i] || ' — key: ' || keys[i] || ', even: ' || evens[i]), ';') AS row_texts,
'key: ' || array_to_string(list_transform(range(1, c + 1), lambda i: names[i] || ': ' || keys[i]), ', ') || ';' || 'even: ' || array_to_string(list_transform(range(1, c + 1), lambda i: names[i] || ': ' || evens[i]), ', ') AS column_texts,
'| name | key | even |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(list_transform(range(1, c + 1), lambda i: '| ' || names[i] || ' | ' || keys[i] || ' | ' || evens[i] || ' |'), chr(10)) AS markdown,
'Таблица: ' || r_name || '. Содержит ' || c || ' строк и 3 столбцов. Столбцы: name, key, even.' AS description FROM r""", graph_views=False)
def page_tables(g: Graph) -> DataFrame:
    found = structure.enriched_tables(structure.with_renderings(structure.tables(_pages(g))))
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, "/")), ";")
    return found.select("doc_id", "idx", "title", F.array_join("headers", "|").alias("headers"), rows.alias("rows"), "is_comparison", F.array_join("row_texts", ";").alias("row_texts"), F.array_join("column_texts", ";").alias("column_texts"), "markdown", "description")


@query("""WITH n AS (SELECT n_regionkey AS doc_id, list('| ' || n_name || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN 'да' ELSE 'нет' END || ' |' ORDER BY n_nationkey) AS rows,
  list(CASE WHEN n_nationkey % 2 = 0 THEN 'even поддерживает ' ELSE 'even не поддерживает ' END || n_name ORDER BY n_nationkey) AS facts FROM nation GROUP BY 1)
SELECT doc_id, true AS is_comparison, array_to_string(facts[1:5], ';') AS facts, 'Таблица: T name, even' AS content, 'before' || chr(10) || chr(10) || 'after' AS around FROM n""", graph_views=False)
def comparison_tables(g: Graph) -> DataFrame:
    yes = F.when(F.col("n_nationkey") % 2 == 0, "да").otherwise("нет")
    row = F.concat(F.lit("| "), F.col("n_name"), F.lit(" | "), yes, F.lit(" |"))
    n = g.table("nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("ns"))
    docs = n.select("doc_id", F.concat(F.lit("# Таблица: T\nbefore\n\n| name | even |\n|---|---|\n"), F.array_join(F.transform("ns", lambda x: x["row"]), "\n"), F.lit("\n\nafter")).alias("text"))
    around = structure.explode_text(docs, lambda t: [(structure.around_table(t, "| name | even |").removeprefix("# Таблица: T\n"),)], "around string", ["around"]).select("doc_id", "around")
    found = structure.enriched_tables(structure.tables(docs))
    memories = structure.table_memories(found.select("doc_id", "idx", "title", "headers", "rows")).where("source_type = 'table'").select("doc_id", "content")
    return found.select("doc_id", "is_comparison", F.array_join("facts", ";").alias("facts")).join(memories, "doc_id").join(around, "doc_id")


@query(f"""WITH {NATIONS} SELECT doc_id, '# Regions' || chr(10) || chr(10) || '## ' || r_name || chr(10) || chr(10) || 'Nations of ' || r_name || '.' || chr(10) || chr(10) || '[ТАБЛИЦА]' || chr(10) || chr(10) || 'After the table.' || chr(10) || chr(10) || '### Steps' || chr(10) || chr(10) || '[СПИСОК]' || chr(10) || chr(10) || '### Terms' || chr(10) || chr(10) || '[СПИСОК]' || chr(10) || chr(10) || 'The end.' AS text FROM r""", graph_views=False)
def pages_without_tables(g: Graph) -> DataFrame:
    cut = lambda t: [(structure.without_lists(structure.without_tables(t)),)]
    return structure.explode_text(_pages(g), cut, "text string", ["text"]).select("doc_id", "text")


@query(f"""WITH {NATIONS} SELECT doc_id, 0 AS idx, 'numbered' AS kind, 'Steps' AS title, array_to_string(list_transform(names, lambda x: 'Visit ' || x), '|') AS items, 'этапы_процесса' AS meaning,
  'Steps. Нумерованный список. Содержит ' || c || ' пунктов. Включает: ' || array_to_string(list_transform(names[1:3], lambda x: 'Visit ' || x), '; ') AS description FROM r
UNION ALL SELECT doc_id, 1, 'definition', 'Terms', array_to_string(list_transform(range(1, c + 1), lambda i: names[i] || ': a nation of the region with the key ' || keys[i]), '|'), 'определения',
  'Terms. Список определений. Содержит ' || c || ' пунктов. Включает: ' || array_to_string(list_transform(range(1, least(c, 3) + 1), lambda i: names[i] || ': a nation of the region with the key ' || keys[i]), '; ') FROM r""", graph_views=False)
def page_lists(g: Graph) -> DataFrame:
    found = structure.enriched_lists(structure.lists(_pages(g)))
    return found.select("doc_id", "idx", "kind", "title", F.array_join("items", "|").alias("items"), "meaning", "description")


@query(f"""WITH {NATIONS}, t AS (SELECT *, list_transform(names, lambda x: 'Visit ' || x) AS items FROM r), d AS (SELECT *, list_transform(range(1, c + 1), lambda i: names[i] || ': a nation of the region with the key ' || keys[i]) AS items FROM r)
SELECT doc_id, 5.5::DOUBLE AS importance, 'list' AS source_type, '# Steps' || chr(10) || 'Steps. Нумерованный список. Содержит ' || c || ' пунктов. Включает: ' || array_to_string(items[1:3], '; ') || chr(10) || array_to_string(list_transform(items, lambda x: '- ' || x), chr(10)) AS content FROM t
UNION ALL SELECT doc_id, 5.5, 'list', '# Terms' || chr(10) || 'Terms. Список определений. Содержит ' || c || ' пунктов. Включает: ' || array_to_string(items[1:3], '; ') || chr(10) || array_to_string(list_transform(items, lambda x: '- ' || x), chr(10)) FROM d
UNION ALL SELECT doc_id, 5.0, 'list_fact', x FROM (SELECT doc_id, unnest(items[1:3]) AS x FROM t) WHERE length(x) >= 10 UNION ALL SELECT doc_id, 5.0, 'list_fact', unnest(items[1:3]) FROM d""", graph_views=False)
def page_list_memories(g: Graph) -> DataFrame:
    return structure.list_memories(structure.lists(_pages(g))).select("doc_id", "importance", "source_type", "content")


@query(f"""WITH {NATIONS} SELECT doc_id, 'procedure' AS kind, 'Steps' AS section, array_to_string(list_transform(names, lambda x: 'Visit ' || x), '|') AS terms, '' AS definitions FROM r
UNION ALL SELECT doc_id, 'definition', 'Terms', array_to_string(names, '|'), array_to_string(list_transform(keys, lambda k: 'a nation of the region with the key ' || k), '|') FROM r""", graph_views=False)
def section_lists(g: Graph) -> DataFrame:
    found = structure.sectioned_lists(_pages(g)).where("section IN ('Steps', 'Terms')")
    return found.select("doc_id", "kind", "section", F.array_join("terms", "|").alias("terms"), F.array_join(F.filter("definitions", lambda d: d != ""), "|").alias("definitions"))


@query("""SELECT r_regionkey AS doc_id, '# Regions|## ' || r_name AS headings, 'Nations of ' || r_name || '.' AS before, 'After the table.' AS after, r_name AS hint,
'Страница: Regions' || chr(10) || 'Заголовки над контентом:' || chr(10) || '  # Regions' || chr(10) || '  ## ' || r_name || chr(10) || 'Текст перед таблицей:' || chr(10) || 'Nations of ' || r_name || '.' AS prompt FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""", graph_views=False)
def table_contexts(g: Graph) -> DataFrame:
    found = structure.table_contexts(_pages(g))
    none = F.array().cast("array<string>")
    nothing = F.lit(None).cast("string")
    return found.select("doc_id", F.array_join("headings", "|").alias("headings"), "before", "after", structure.context_hint(F.col("headings"), F.lit("Regions"), none, nothing).alias("hint"), structure.context_prompt(nothing, none, F.lit("Regions"), F.col("headings"), F.col("before")).alias("prompt"))


@query(f"""WITH {NATIONS}, i AS (SELECT doc_id, (k - 1) // 4 AS p, list(x ORDER BY k) AS xs FROM (SELECT doc_id, unnest(range(1, c + 1)) AS k, names, 'Visit ' || names[k] AS x FROM r) GROUP BY 1, 2)
SELECT doc_id, p::INT AS idx, 'Steps: ' || array_to_string(xs, '; ') AS content FROM i""", graph_views=False)
def grouped_items(g: Graph) -> DataFrame:
    def parse(t: str) -> list[tuple]:
        return [(x,) for block in structure.find_lists(t) if block.kind == "numbered" for x in structure.grouped_items(block)]

    return structure.explode_text(_pages(g), parse, "content string", ["content"])


@query("""SELECT doc_id, (i - 1)::INT AS idx, CASE WHEN i = 1 THEN repeat('a', 60) || chr(10) || chr(10) || 'p1-' || doc_id ELSE right(repeat('a', 60) || chr(10) || chr(10) || 'p1-' || doc_id, 10) || chr(10) || chr(10) || repeat('b', 70) END AS content
FROM (SELECT s_suppkey AS doc_id, unnest([1, 2]) AS i FROM supplier)""", graph_views=False)
def char_chunks(g: Graph) -> DataFrame:
    i = F.col("s_suppkey").cast("string")
    docs = g.table("supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("a" * 60 + "\n\np1-"), i, F.lit("\n\n" + "b" * 70)).alias("text"))
    return structure.chunks(docs, size=80, overlap=10).select("doc_id", "idx", "content")


FIRST, LAST = ("Иван", "Мария", "Ольга", "Павел"), ("Петров", "Сидоров", "Иванов")
_first = "['" + "','".join(FIRST) + "'][(s_suppkey % 4)::INT + 1]"
_last = "['" + "','".join(LAST) + "'][(s_suppkey % 3)::INT + 1]"


def _people(g: Graph) -> DataFrame:
    k = F.col("s_suppkey")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n).cast("int") + 1)
    return g.table("supplier").select(k.alias("doc_id"), pick(FIRST, 4).alias("first"), pick(LAST, 3).alias("last"))


@query(f"""SELECT s_suppkey AS doc_id, {_first} || ' ' || {_last} AS name, 'тимлид' AS role, 'team' || s_suppkey AS team FROM supplier""", graph_views=False)
def persons(g: Graph) -> DataFrame:
    full = F.concat_ws(" ", "first", "last")
    team = F.concat(F.lit("team"), F.col("doc_id").cast("string"))
    docs = _people(g).select("doc_id", F.concat(full, F.lit(" — тимлид.\nкоманда "), team, F.lit(": "), F.col("first"), F.lit(", Анна\n"), full, F.lit(" (аналитик)")).alias("text"), "first")
    roles, teams = structure.person_roles(docs), structure.teams(docs)
    own = teams.join(docs.select("doc_id", F.col("first").alias("member")), ["doc_id", "member"], "left_semi").select("doc_id", "team")
    return roles.join(own, "doc_id").select("doc_id", "name", "role", "team")


@query(f"""SELECT s_suppkey AS doc_id, CASE {_first} WHEN 'Иван' THEN 'Иван' WHEN 'Мария' THEN 'Мария' WHEN 'Ольга' THEN 'Ольга' ELSE 'Павел' END || ' ' || {_last} AS full,
{_first} || ' ' || {_last} || '|' || CASE {_first} WHEN 'Иван' THEN 'Ваня' WHEN 'Мария' THEN 'Маша' WHEN 'Ольга' THEN 'Оля' ELSE 'Паша' END || ' ' || {_last} AS variants FROM supplier""", graph_views=False)
def person_names(g: Graph) -> DataFrame:
    short = F.element_at(F.create_map(*[F.lit(x) for x in ("Иван", "ваня", "Мария", "МАША", "Ольга", "оля", "Павел", "Паша")]), F.col("first"))
    name = F.concat_ws(" ", short, F.lower("last"))
    return _people(g).select("doc_id", structure.full_name(name).alias("full"), F.array_join(structure.name_variants(name), "|").alias("variants"))


# Line protocols and JSON put together from parts of a brand.

SPOKEN = """p AS (SELECT p_partkey AS id, lower(p_name) AS name, ['tool','resource','action','state','config','error','general'][(p_size % 7) + 1] AS kind, p_size FROM part)"""


def _spoken(g: Graph) -> DataFrame:
    """id and raw: one extraction output for each part, with noise."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("tool", "resource", "action", "state", "config", "error", "general")]), F.col("p_size") % 7 + 1)
    name = F.lower("p_name")
    c = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    raw = c("Here it is:\nCONCEPT|", F.upper(name), "|", kind, "|A thing\nCONCEPT|box|nonsense|Holds things\nRELATION|", name, "|box|is_a|0.5\nRELATION|", name, "|ghost|is_a|1\nMEMORY|", name, " fits into a box|fact|", F.col("p_size").cast("string"), "|", name, ", box\nMEMORY|short|fact|1|x\nPERSON|Иван Петров|тимлид|\nPERSON|И|x|y\n")
    return g.table("part").select(F.col("p_partkey").alias("id"), raw.alias("raw"))


@query(f"WITH {SPOKEN} SELECT id, name, kind AS type, 'A thing' AS description FROM p UNION ALL SELECT id, 'box', 'general', 'Holds things' FROM p", graph_views=False)
def spoken_concepts(g: Graph) -> DataFrame:
    return structure.concept_lines(structure.protocol_lines(_spoken(g)))


@query(f"WITH {SPOKEN} SELECT id, name AS source, 'box' AS target, 'is_a' AS relation_type, round(0.95 * 0.5, 6)::DOUBLE AS weight FROM p", graph_views=False)
def spoken_relations(g: Graph) -> DataFrame:
    lines = structure.protocol_lines(_spoken(g))
    return structure.relation_lines(lines, structure.concept_lines(lines)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {SPOKEN} SELECT id, name || ' fits into a box' AS content, 'fact' AS memory_type, least(10.0, greatest(1.0, p_size::DOUBLE)) AS importance, name || '|box' AS concepts, 'Иван Петров' AS person, 'тимлид' AS role FROM p", graph_views=False)
def spoken_memories(g: Graph) -> DataFrame:
    lines = structure.protocol_lines(_spoken(g))
    people = structure.person_lines(lines).select("id", F.col("name").alias("person"), "role")
    return structure.memory_lines(lines).select("id", "content", "memory_type", "importance", F.array_join("concepts", "|").alias("concepts")).join(people, "id")


@query(f"""WITH {SPOKEN} SELECT id, name, kind AS type, 'is_a' AS relation_type, 0.7::DOUBLE AS weight, name || ' is heavy enough' AS content, 'procedure' AS memory_type, least(10.0, greatest(1.0, p_size::DOUBLE)) AS importance FROM p""", graph_views=False)
def json_extraction(g: Graph) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("tool", "resource", "action", "state", "config", "error", "general")]), F.col("p_size") % 7 + 1)
    n = F.concat(F.lit(" "), F.upper("p_name"))
    rows = g.table("part").select(F.col("p_partkey").alias("id"), F.to_json(F.array(F.struct(n.alias("name"), kind.alias("type")), F.struct(F.lit("box").alias("name"), F.lit("x").alias("type")))).alias("c"),
        F.to_json(F.array(F.struct(n.alias("source"), F.lit("box").alias("target"), F.lit("is_a").alias("type")), F.struct(n.alias("source"), F.lit("ghost").alias("target"), F.lit("is_a").alias("type")))).alias("r"),
        F.to_json(F.array(F.struct(F.concat(F.lower("p_name"), F.lit(" is heavy enough")).alias("content"), F.lit("procedure").alias("type"), F.col("p_size").cast("string").alias("importance")), F.struct(F.lit("short").alias("content"), F.lit("fact").alias("type"), F.lit("1").alias("importance")))).alias("m"))
    concepts = structure.json_concepts(rows, "c")
    relations = structure.json_relations(rows, concepts, "r").select("id", "relation_type", "weight")
    memories = structure.json_memories(rows, "m").select("id", "content", "memory_type", "importance")
    return concepts.where("name <> 'box'").select("id", "name", "type").join(relations, "id").join(memories, "id")


@query("""SELECT s_suppkey AS id, 'A ' || s_name AS definition, 'thing' AS is_a, 'x|y' AS contains, 'd ' || s_suppkey AS description, 'f1|f2' AS facts, 'q1' AS queries FROM supplier""", graph_views=False)
def parsed_definitions(g: Graph) -> DataFrame:
    rows = g.table("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("A "), "s_name", F.lit("|is_a: Thing|contains: x, y")).alias("answer"), F.concat(F.lit("DESCRIPTION|d "), F.col("s_suppkey").cast("string"), F.lit("\nFACT|f1\nfact|f2\nQUERY|q1")).alias("t"))
    told = structure.parse_table_answers(rows.select("id", F.col("t").alias("answer"))).select("id", "description", F.array_join("facts", "|").alias("facts"), F.array_join("queries", "|").alias("queries"))
    return enrichment.definitions(rows).select("id", "definition", F.array_join("is_a", "|").alias("is_a"), F.array_join("contains", "|").alias("contains")).join(told, "id")


@query("""SELECT doc_id, sha256(text) AS source_hash, 'page ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 'markdown' WHEN doc_id % 3 = 1 THEN 'html' ELSE 'text' END AS doc_type FROM documents WHERE text IS NOT NULL""", graph_views=False)
def read_documents(g: Graph) -> DataFrame:
    """Texts as if from files; an own title takes precedence."""
    rows = g.table("documents").where("text IS NOT NULL")
    ext = F.when(F.col("doc_id") % 3 == 0, ".MD").when(F.col("doc_id") % 3 == 1, ".html").otherwise(".txt")
    path = F.concat(F.lit("/data/"), F.col("doc_id").cast("string"), ext)
    found = readers.documents(rows.select(path.alias("source_path"), F.col("text").alias("raw"), F.concat(F.lit("page "), F.col("doc_id").cast("string")).alias("title")))
    return found.select(F.regexp_extract("source_path", r"(\d+)\.", 1).cast("bigint").alias("doc_id"), "source_hash", "title", "doc_type")


@query(f"""SELECT id, round((epoch_us(TIMESTAMP '2001-08-02') - epoch_us(last_accessed::TIMESTAMP)) / 3.6e9, 9) AS hours, round(pow(0.995, (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(last_accessed::TIMESTAMP)) / 3.6e9), 9) AS recency,
round(0.2 * pow(0.995, (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(last_accessed::TIMESTAMP)) / 3.6e9) + 0.2 * importance / 10 + 0.3 * 0.5 + 0.3 * 0.01 * 10, 9) AS base,
CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.8 ELSE 0.7 END::DOUBLE AS weight, round(importance * 0.8 + importance * CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.8 ELSE 0.7 END * 0.2, 9) AS weighed,
round(0.5 * importance / 10 + 0.25 * confidence + 0.25 * 0.5, 9) AS combined, round((2 / 3 * 0.6 + importance / 10 * 0.4) * 1.5, 9) AS shared, round(importance / 10 * 1.3 * 0.7, 9) AS path, round(1 / (1 + exp(least(greatest((-2.0 - (confidence - 3)) / 0.4, -100), 100))), 9) AS probability FROM memories""")
def score_parts(g: Graph) -> DataFrame:
    m = g.memories()
    at = now("2001-08-02 00:00:00")
    kind = F.element_at(F.array(F.lit("Document"), F.lit("table"), F.lit("summary"), F.lit("other")), (F.col("id") % 4).cast("int") + 1)
    recent = S.recency(F.col("last_accessed"), at)
    values = {
        "hours": S.hours_since(F.col("last_accessed"), at), "recency": recent, "base": S.base_score(recent, F.col("importance"), F.lit(0.01), F.lit(None).cast("double")), "weight": S.source_weight(kind), "weighed": S.weigh_source(F.col("importance"), kind),
        "combined": S.combined_similarity(F.col("importance") / 10, F.col("confidence"), F.lit(0.5)), "shared": S.shared_memory_score(F.lit(2), F.lit(3), F.col("importance")), "path": S.path_memory_score(F.lit(2), F.col("importance")), "probability": S.retrieval_probability(F.col("confidence") - 3),
    }
    return m.select("id", *[F.round(c, 9).alias(n) for n, c in values.items()])


@query()
def topic_breaks(g: Graph) -> DataFrame:
    """Similarity of each sentence of all documents to the one before, by what its words occur with, and whether it is a break; sentences without words are like none."""
    rows = written(sentences_of(g), "sentences")
    pairs = meaning.learn(rows).to_previous(rows)
    return ranking.semantic_breaks(pairs.withColumn("similarity", F.round(F.coalesce("similarity", F.lit(0.0)), 6)))
