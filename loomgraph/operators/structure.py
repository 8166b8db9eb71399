"""Tables, lists, chunks and line protocols in texts.

Parsing a text is sequential, so parsers are plain functions over one text,
run batch by batch with ``mapInPandas``; a task holds one batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.text import importance_of, one_of
from ..schema import CONCEPT_TYPES, MEMORY_TYPES, RELATION_TYPES

# Fixed values.
RELATION_WEIGHTS = {"is_a": 0.95, "contains": 0.85, "uses": 0.75, "needs": 0.70, "causes": 0.65, "related_to": 0.50}
_SEPARATOR = re.compile(r"^\s*\|?[\s:\-|]+\|?\s*$")
_HEADING = re.compile(r"^\s*#{1,6}\s+(.+?)\s*$")
_CHECK = re.compile(r"^(\s*)[-*]\s*\[([ xX])\]\s+(.+)$")
_NUMBER = re.compile(r"^(\s*)(\d+)[.)]\s+(.+)$")
_BULLET = re.compile(r"^(\s*)[-*•●◦]\s+(.+)$")
_DEFINITION = re.compile(r"^(.+?)\s*[—–:]\s+(.{15,})$")
_SECTION_DEFINITIONS = (re.compile(r"^[*_]*(.+?)[*_]*\s*[—–-]\s+(.+)$"), re.compile(r"^(.+?):\s+(.+)$"), re.compile(r"^(.+?)\s*[→=>]\s+(.+)$"))
_SECTION_STEPS = (re.compile(r"^(\d+)[.)]\s+(.+)$"), re.compile(r"^[Шш]аг\s+(\d+)[.:]\s*(.+)$"))
_SECTION_BULLETS = (re.compile(r"^[-*•●◦]\s+(.+)$"), re.compile(r"^[—–]\s+(.+)$"))
LIST_MEANING = {"numbered": "этапы_процесса", "checklist": "задачи", "definition": "определения", "bullet": "перечисление"}
LIST_WORDS = {"numbered": "Нумерованный список", "checklist": "Чек-лист задач", "definition": "Список определений", "bullet": "Список"}
GENERIC_TITLES = ("команда", "документация", "описание", "информация", "главная", "home", "index")
ROLES = "тимлид|лид|руководитель|менеджер|директор|архитектор|разработчик|аналитик|дизайнер|тестировщик|девопс|SRE|PM|PO|CTO|CEO|CFO|COO|HR|QA"
PERSON = r"[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+)?"
TEAM = r"[а-яёА-ЯЁa-zA-Z0-9_-]+"
MEMBERS = r"[А-ЯЁ][а-яё]+(?:,\s*[А-ЯЁ][а-яё]+)*"
SHORT_NAMES = {
    "Александр": ("Саша", "Саня", "Шура", "Алекс"), "Алексей": ("Лёша", "Алёша", "Лёха"), "Анастасия": ("Настя", "Ася"), "Андрей": ("Андрюша", "Андрюха"),
    "Анна": ("Аня", "Анюта", "Нюра"), "Артём": ("Артур", "Тёма"), "Борис": ("Боря",), "Владимир": ("Вова", "Володя", "Влад"), "Виктор": ("Витя",), "Виктория": ("Вика",),
    "Дмитрий": ("Дима", "Митя"), "Евгений": ("Женя",), "Евгения": ("Женя",), "Екатерина": ("Катя", "Катюша"), "Елена": ("Лена",), "Иван": ("Ваня",), "Игорь": ("Гоша",),
    "Илья": ("Илюша",), "Ирина": ("Ира",), "Максим": ("Макс",), "Мария": ("Маша",), "Михаил": ("Миша",), "Наталья": ("Наташа",), "Николай": ("Коля",), "Олег": ("Олежка",),
    "Ольга": ("Оля",), "Павел": ("Паша",), "Пётр": ("Петя",), "Роман": ("Рома",), "Светлана": ("Света",), "Сергей": ("Серёжа", "Серёга"), "Татьяна": ("Таня",), "Юлия": ("Юля",), "Юрий": ("Юра",),
}


@dataclass
class Table:
    headers: list[str]
    rows: list[list[str]]
    title: str | None = None
    first_line: int = 0
    last_line: int = 0

    @property
    def is_comparison(self) -> bool:
        """Over half of the cells behind the first column say yes, no or nothing."""
        cells = [c for r in self.rows for c in r[1:]]
        return bool(cells) and sum(c.lower() in ("да", "нет", "") for c in cells) * 2 > len(cells)


def _cells(line: str) -> list[str]:
    line = line.strip()
    return [c.strip() for c in line.removeprefix("|").removesuffix("|").split("|")]


def _title_above(lines: list[str], at: int) -> str | None:
    for k in range(at - 1, max(-1, at - 5), -1):
        if m := _HEADING.match(lines[k]):
            return m[1]
    return None


def find_tables(text: str) -> list[Table]:
    """Runs of lines with pipes that have a header and at least one row."""
    lines, found, at = text.split("\n"), [], 0
    while at < len(lines):
        if not (lines[at].lstrip().startswith("|") and lines[at].count("|") >= 2):
            at += 1
            continue
        end = at
        while end < len(lines) and lines[end].lstrip().startswith("|"):
            end += 1
        body = [_cells(x) for x in lines[at:end] if not _SEPARATOR.match(x)]
        if len(body) >= 2:
            headers = [c for c in body[0] if c]
            found.append(Table(headers, [r[: max(len(headers), 1)] for r in body[1:]], _title_above(lines, at), at, end - 1))
        at = end
    return found


def without_tables(text: str, placeholder: str = "[ТАБЛИЦА]") -> str:
    lines = text.split("\n")
    for t in reversed(find_tables(text)):
        lines[t.first_line : t.last_line + 1] = [placeholder, ""]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines))


@dataclass
class ListBlock:
    kind: str
    items: list[str] = field(default_factory=list)
    title: str | None = None
    first_line: int = 0
    last_line: int = 0


def _line_kind(line: str) -> tuple[str, str] | None:
    """Kind and text of a list line; a check box before a number, a number before a bullet, a bullet before a definition."""
    line = line.strip()
    if m := _CHECK.match(line) or _NUMBER.match(line):
        return ("checklist" if m.re is _CHECK else "numbered"), m[3].strip()
    if m := _BULLET.match(line):
        return "bullet", m[2].strip()
    if m := _DEFINITION.match(line):
        return "definition", f"{m[1].strip()}: {m[2].strip()}"
    return None


def _list_end(lines: list[str], at: int, kind: str) -> int:
    """Last line of the list that begins at ``at``: one empty line and indented continuations stay inside, a numbering gap over two ends it."""
    end, empty, due = at, 0, None
    for k in range(at, len(lines)):
        line = lines[k]
        if not line.strip():
            empty += 1
            if empty > 1:
                break
            continue
        empty, found = 0, _line_kind(line)
        if found and found[0] == kind:
            if kind == "numbered":
                number = int(_NUMBER.match(line.strip())[2])
                if due is not None and number > due + 2:
                    break
                due = number + 1
            end = k
        elif found or line.strip().startswith("#") or not line.startswith(("    ", "\t")):
            break
        else:
            end = k
    return end


def _list_title(lines: list[str], at: int) -> str | None:
    """Heading among the four lines above, if only empty lines stand between."""
    for k in range(at - 1, max(0, at - 5), -1):
        if line := lines[k].strip():
            return line.lstrip("#").strip() if line.startswith("#") else None
    return None


def find_lists(text: str, min_items: int = 2) -> list[ListBlock]:
    """Lists of one kind that span ``min_items`` lines or more; an item is a line that begins one."""
    lines, found, at = text.split("\n"), [], 0
    while at < len(lines):
        first = _line_kind(lines[at])
        end = _list_end(lines, at, first[0]) if first else at
        if first and end - at + 1 >= min_items:
            kinds = [k for line in lines[at : end + 1] if (k := _line_kind(line))]
            found.append(ListBlock(first[0], [t for k, t in kinds if k == first[0]], _list_title(lines, at), at, end))
            at = end
        at += 1
    return found


def without_lists(text: str, placeholder: str = "[СПИСОК]") -> str:
    """The text with a placeholder and an empty line for each list; without a list as it is."""
    lines, blocks = text.split("\n"), find_lists(text)
    for block in reversed(blocks):
        lines[block.first_line : block.last_line + 1] = [placeholder, ""]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip() if blocks else text


def sections(text: str) -> list[tuple[str | None, list[str]]]:
    """Heading and lines of each section that has lines."""
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in text.split("\n"):
        if m := _HEADING.match(line):
            out.append((m[1], []))
        else:
            out[-1][1].append(line)
    return [x for x in out if x[1]] or [(None, [text])]


def section_lists(text: str, min_items: int = 2) -> list[tuple[str, str | None, list[str], list[str]]]:
    """kind, section, terms and definitions of the lists in each section.

    The same lines may be a definition list and a bullet list.  Steps go on
    over lines between them; definitions and bullets do not.
    """
    out = []
    for heading, lines in sections(text):
        for kind in ("definition", "procedure", "bullet"):
            items: list[tuple[str, str]] = []
            due = 1
            for raw in [*lines, ""]:
                line, item = raw.strip(), None
                if kind == "definition":
                    for m in (p.match(line) for p in _SECTION_DEFINITIONS):
                        if m and len(m[1].strip()) > 2 and len(m[2].strip()) > 10:
                            item = (m[1].strip(), m[2].strip())
                            break
                elif kind == "procedure":
                    m = next((m for p in _SECTION_STEPS if (m := p.match(line))), None)
                    if m and (not items or int(m[1]) in (due, due + 1)):
                        item, due = (m[2].strip(), ""), int(m[1]) + 1
                else:
                    m = next((m for p in _SECTION_BULLETS if (m := p.match(line))), None)
                    item = (m[1].strip(), "") if m and len(m[1].strip()) > 5 else None
                if item:
                    items.append(item)
                elif not line or kind != "procedure":
                    if len(items) >= min_items:
                        out.append((kind, heading, [t for t, _ in items], [d for _, d in items]))
                    items, due = [], 1
    return out


@dataclass
class Surroundings:
    """What stands around some lines of a page."""

    headings: list[str]
    before: str
    after: str


def surroundings(text: str, first: int, last: int, most: int = 500) -> Surroundings:
    """Headings that the lines stand under, and the paragraphs next to them, up to ``most`` characters before and half as many after."""
    lines = [x.strip() for x in text.split("\n")]
    heading = re.compile(r"^(#{1,6})\s+")
    stack: list[tuple[int, str]] = []
    for line in lines[:first]:
        if m := heading.match(line):
            stack = [x for x in stack if x[0] < len(m[1])] + [(len(m[1]), line)]
    before: list[str] = []
    for line in reversed(lines[:first]):
        if heading.match(line) or not line and before or len(" ".join(before)) > most:
            break
        if line and not line.startswith("|") and (before or not line.startswith(("-", "*", "•"))):
            before.insert(0, line)
    after: list[str] = []
    for line in lines[last + 1 :]:
        if line.startswith(("#", "|", "-", "*", "•")) and (not line.startswith("#") or heading.match(line)) or not line and after or len(" ".join(after)) > most // 2:
            break
        if line:
            after.append(line)
    return Surroundings([h for _, h in stack], " ".join(before), " ".join(after))


def around_table(text: str, first_line: str, paragraphs: int = 2) -> str:
    """Up to ``paragraphs`` paragraphs before and after that of a table, without other tables."""
    parts = re.split(r"\n\n+", text)
    wanted = first_line.strip() if first_line.strip() in text else first_line.replace("|", "").strip()
    at = next((k for k, p in enumerate(parts) if wanted[:30] in p or "|" in p and "---" in p), None)
    if at is None:
        return ""
    near = [p.strip() for k, p in enumerate(parts) if k != at and abs(k - at) <= paragraphs]
    return "\n\n".join(p for p in near if p and not p.startswith("|"))


def grouped_items(block: ListBlock, each: int = 4) -> list[str]:
    """Items in chunks; long definitions stand alone."""
    out, waiting = [], []
    head = f"{block.title}: " if block.title else ""
    for item in block.items:
        if block.kind == "definition" and (len(item) > 200 or item.count(".") > 2):
            out.append(head + item)
            continue
        waiting.append(item)
        if len(waiting) == each:
            out.append(head + "; ".join(waiting))
            waiting = []
    return out + [head + "; ".join(waiting)] if waiting else out


def char_chunks(text: str, size: int = 2000, overlap: int = 200) -> list[tuple[str, int, int]]:
    """Paragraphs packed up to ``size`` characters behind the tail of the chunk before; a longer paragraph stays whole."""
    out: list[tuple[str, int, int]] = []
    current, start, at = "", 0, 0
    for paragraph in text.split("\n\n"):
        if current and len(current) + 2 + len(paragraph) > size:
            out.append((current, start, start + len(current)))
            tail = current[-overlap:] if overlap else ""
            start, current = at - len(tail), tail
        current = f"{current}\n\n{paragraph}" if current else paragraph
        at += len(paragraph) + 2
    return [*out, (current, start, start + len(current))] if current.strip() else out


def explode_text(docs: DataFrame, parse: Callable[[str], list[tuple]], schema: str, names: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``parse`` for each text, numbered from 0 in ``idx``; null texts give none."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(key, k, *row) for key, value in zip(frame["doc_id"], frame["text"], strict=True) if value is not None for k, row in enumerate(parse(value))]
            yield pd.DataFrame(rows, columns=["doc_id", "idx", *names])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id {kind}, idx int, {schema}")


def tables(docs: DataFrame, **names: str) -> DataFrame:
    parse = lambda t: [(x.title, x.headers, x.rows, x.is_comparison, x.first_line, x.last_line) for x in find_tables(t)]
    return explode_text(docs, parse, "title string, headers array<string>, rows array<array<string>>, is_comparison boolean, first_line int, last_line int", ["title", "headers", "rows", "is_comparison", "first_line", "last_line"], **names)


def lists(docs: DataFrame, **names: str) -> DataFrame:
    parse = lambda t: [(x.kind, x.title, x.items, x.first_line, x.last_line) for x in find_lists(t)]
    return explode_text(docs, parse, "kind string, title string, items array<string>, first_line int, last_line int", ["kind", "title", "items", "first_line", "last_line"], **names)


def chunks(docs: DataFrame, size: int = 2000, overlap: int = 200, **names: str) -> DataFrame:
    return explode_text(docs, lambda t: char_chunks(t, size, overlap), "content string, start_offset int, end_offset int", ["content", "start_offset", "end_offset"], **names)


def table_memories(found: DataFrame) -> DataFrame:
    """One memory for each table and one for each of its row facts of ten characters or more."""
    facts = F.transform("rows", lambda r: F.concat_ws(", ", F.filter(F.zip_with("headers", r, lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat_ws(": ", h, v))), lambda x: x.isNotNull())))
    main = found.select("doc_id", "idx", F.concat_ws(" ", "title", F.concat_ws(", ", "headers")).alias("content"), F.lit(6.0).alias("importance"), F.lit("table").alias("source_type"))
    rows = found.select("doc_id", "idx", F.explode(facts).alias("content"), F.lit(5.0).alias("importance"), F.lit("table_fact").alias("source_type")).where("char_length(content) >= 10")
    return main.unionByName(rows)


def with_renderings(found: DataFrame) -> DataFrame:
    """Tables (title, headers, rows) with row_texts, column_texts, markdown and searchable, in one projection."""
    cells = lambda r: F.zip_with("headers", r, lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(h, F.lit(": "), v)))
    label = lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit(""))
    told = lambda r: F.filter(F.slice(cells(r), 2, F.size("headers")), lambda x: x.isNotNull())
    rows = F.filter(F.transform("rows", lambda r: F.when((label(r) != "") & (F.size(told(r)) > 0), F.concat(label(r), F.lit(" — "), F.array_join(told(r), ", "))).when(label(r) != "", label(r))), lambda x: x.isNotNull())

    def column(h: Column, k: Column) -> Column:
        said = F.transform("rows", lambda r: F.when((label(r) != "") & (F.coalesce(F.get(r, k), F.lit("")) != ""), F.concat(label(r), F.lit(": "), F.get(r, k))))
        said = F.filter(said, lambda x: x.isNotNull())
        return F.when((k > 0) & (F.size(said) > 0), F.concat(h, F.lit(": "), F.array_join(said, ", ")))

    columns = F.filter(F.transform("headers", column), lambda x: x.isNotNull())
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.transform("headers", lambda h: F.lit("---"))
    markdown = F.array_join(F.concat(F.array(line(F.col("headers")), line(rule)), F.transform("rows", line)), "\n")
    out = found.withColumn("row_texts", rows).withColumn("column_texts", columns).withColumn("markdown", markdown)
    head = F.when(F.col("title").isNotNull(), F.concat(F.lit("Таблица: "), F.col("title")))
    return out.withColumn("searchable", F.concat_ws("\n", head, F.concat(F.lit("Столбцы: "), F.array_join("headers", ", ")), F.array_join("row_texts", "\n")))


def enriched_tables(found: DataFrame) -> DataFrame:
    """Tables with a description and up to ten facts, from their cells alone: what each column of a comparison supports, for five rows."""
    size = F.lit("Содержит "), F.size("rows").cast("string"), F.lit(" строк и "), F.size("headers").cast("string"), F.lit(" столбцов.")
    title = F.when(F.col("title").isNotNull(), F.concat(F.lit("Таблица: "), F.col("title"), F.lit("."))).otherwise("Таблица данных.")
    names = F.when(F.size("headers") > 0, F.concat(F.lit("Столбцы: "), F.array_join("headers", ", "), F.lit(".")))

    def facts(r: Column) -> Column:
        def one(h: Column, v: Column) -> Column:
            low = F.lower(v)
            verb = F.when(low.isin("да", "yes", "+"), " поддерживает ").when(low.isin("нет", "no", "-"), " не поддерживает ")
            return F.concat(h, verb, F.get(r, F.lit(0)))

        return F.filter(F.slice(F.zip_with("headers", r, one), 2, F.size("headers")), lambda x: x.isNotNull())

    told = F.slice(F.flatten(F.transform(F.slice("rows", 1, 5), facts)), 1, 10)
    return found.withColumn("description", F.concat_ws(" ", title, F.concat(*size), names)).withColumn("facts", F.when(F.col("is_comparison"), told).otherwise(F.array().cast("array<string>")))


def parse_table_answers(answers: DataFrame) -> DataFrame:
    """description, facts and queries of a model's answer in lines KEY|value."""
    lines = F.transform(F.split("answer", "\n"), lambda x: F.trim(x))
    of = lambda key: F.transform(F.filter(lines, lambda x: F.upper(x).startswith(f"{key}|")), lambda x: F.trim(F.regexp_replace(x, r"^[^|]*\|", "")))
    return answers.select("id", F.get(of("DESCRIPTION"), F.lit(0)).alias("description"), of("FACT").alias("facts"), of("QUERY").alias("queries"))


def raw_tables(summaries: DataFrame, memories: DataFrame) -> DataFrame:
    """summary_id and the raw table's memory that its metadata (JSON) links to; summaries without one are left out."""
    links = summaries.select(F.col("id").alias("summary_id"), F.get_json_object("metadata", "$.linked_raw_id").alias("raw_id"))
    return links.join(memories.select(F.col("id").cast("string").alias("raw_id"), "content"), "raw_id").select("summary_id", "raw_id", "content")


def enriched_lists(found: DataFrame) -> DataFrame:
    """Lists (kind, title, items) with belonging, meaning, description and facts, from their items alone."""
    meaning = F.create_map(*[F.lit(x) for pair in LIST_MEANING.items() for x in pair])
    word = F.create_map(*[F.lit(x) for pair in LIST_WORDS.items() for x in pair])
    first = F.slice("items", 1, 3)
    told = F.concat_ws(" ", F.concat("title", F.lit(".")), F.concat(F.try_element_at(word, F.col("kind")), F.lit(".")), F.concat(F.lit("Содержит "), F.size("items").cast("string"), F.lit(" пунктов.")), F.when(F.size("items") > 0, F.concat(F.lit("Включает: "), F.array_join(first, "; "))))
    return found.withColumn("belonging", F.coalesce("title", F.lit(""))).withColumn("meaning", F.coalesce(F.try_element_at(meaning, F.col("kind")), F.lit("перечисление"))).withColumn("description", told).withColumn("facts", first)


def list_memories(found: DataFrame) -> DataFrame:
    """One memory for each list and one for each of its facts of ten characters or more."""
    rows = enriched_lists(found)
    head = F.when(F.col("belonging") != "", F.concat(F.lit("# "), F.col("belonging")))
    main = rows.select("doc_id", "idx", F.concat_ws("\n", head, "description", F.array_join(F.transform("items", lambda x: F.concat(F.lit("- "), x)), "\n")).alias("content"), F.lit(5.5).alias("importance"), F.lit("list").alias("source_type"))
    facts = rows.select("doc_id", "idx", F.explode("facts").alias("content"), F.lit(5.0).alias("importance"), F.lit("list_fact").alias("source_type")).where("char_length(content) >= 10")
    return main.unionByName(facts)


def sectioned_lists(docs: DataFrame, **names: str) -> DataFrame:
    return explode_text(docs, section_lists, "kind string, section string, terms array<string>, definitions array<string>", ["kind", "section", "terms", "definitions"], **names)


def table_contexts(docs: DataFrame, **names: str) -> DataFrame:
    """headings, before and after of each table."""
    def parse(t: str) -> list[tuple]:
        found = [surroundings(t, x.first_line, x.last_line) for x in find_tables(t)]
        return [(x.headings, x.before, x.after) for x in found]

    return explode_text(docs, parse, "headings array<string>, before string, after string", ["headings", "before", "after"], **names)


def context_hint(headings: Column, title: Column, parents: Column, space: Column) -> Column:
    """The nearest heading, else a title that says something, else the last parent, else the space."""
    heading = F.trim(F.regexp_replace(F.element_at(headings, -1), r"^#+\s*", ""))
    last = F.when(F.size(headings) > 0, F.when(F.char_length(heading) > 2, heading))
    own = F.when(~F.lower(title).isin(*GENERIC_TITLES) & (F.char_length(title) > 2), title)
    return F.coalesce(last, own, F.when(F.size(parents) > 0, F.element_at(parents, -1)), F.nullif(space, F.lit("")), F.lit(""))


def context_prompt(space: Column, parents: Column, title: Column, headings: Column, before: Column, of: str = "таблицей") -> Column:
    """What a model is told about where a table or list stands."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    parts = [
        F.when(some(space), F.concat(F.lit("Пространство Confluence: "), space)), F.when(F.size(parents) > 0, F.concat(F.lit("Навигация: "), F.array_join(parents, " → "))),
        F.when(some(title), F.concat(F.lit("Страница: "), title)), F.when(F.size(headings) > 0, F.concat(F.lit("Заголовки над контентом:\n  "), F.array_join(headings, "\n  "))),
        F.when(some(before), F.concat(F.lit(f"Текст перед {of}:\n"), F.trim(before))),
    ]
    text = F.concat_ws("\n", *parts)
    return F.when(text == "", "Контекст отсутствует.").otherwise(text)


def cut_sentences(sizes: list[int], breaks: set[int], most: int = 1024, least: int = 512, overlap: int = 50) -> list[tuple[int, int, int]]:
    """First sentence, end and tokens of each chunk.

    A chunk ends before it would exceed ``most`` tokens, or at a break once it
    has ``least``.  The next begins with the last sentences of up to
    ``overlap`` tokens.  Chunks under ``least`` then take in the next one if
    both fit into ``most``.
    """
    chunks: list[list[int]] = []
    first, tokens = 0, 0
    for k, size in enumerate(sizes):
        if k > first and (tokens + size > most or k in breaks and tokens >= least):
            chunks.append([first, k, tokens])
            first, tokens = k, 0
            while first > chunks[-1][0] and tokens + sizes[first - 1] <= overlap:
                first -= 1
                tokens += sizes[first]
        tokens += size
    if sizes:
        chunks.append([first, len(sizes), tokens])
    merged: list[list[int]] = []
    for chunk in chunks:
        if merged and merged[-1][2] < least and merged[-1][2] + chunk[2] <= most:
            merged[-1] = [merged[-1][0], chunk[1], merged[-1][2] + chunk[2]]
        else:
            merged.append(chunk)
    return [(a, b, n) for a, b, n in merged]


def semantic_chunks(parts: DataFrame, most: int = 1024, least: int = 512, overlap: int = 50) -> DataFrame:
    """doc_id, idx, first, last (sentences) and n_tokens from sentences (doc_id, idx, n_tokens, is_break); one document's sentences are a group."""
    kind = parts.schema["doc_id"].dataType.simpleString()

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        found = cut_sentences(rows["n_tokens"].tolist(), set(rows["idx"][rows["is_break"]].tolist()), most, least, overlap)
        return pd.DataFrame([(rows["doc_id"].iloc[0], k, a, b - 1, n) for k, (a, b, n) in enumerate(found)], columns=["doc_id", "idx", "first", "last", "n_tokens"])

    return parts.select("doc_id", "idx", "n_tokens", "is_break").groupBy("doc_id").applyInPandas(cut, f"doc_id {kind}, idx int, first int, last int, n_tokens int")


def chunks_of(sizes: Column, breaks: Column, most: int = 1024, least: int = 512, overlap: int = 50) -> Column:
    """The chunks of one text as a list of first, last and n_tokens, from the tokens of its sentences and whether each but the first is a break."""

    @F.arrow_udf(ArrayType(StructType([StructField(c, IntegerType()) for c in ("first", "last", "n_tokens")])))
    def cut(sizes: pa.Array, breaks: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("first", "last", "n_tokens")]))
        found = [cut_sentences(n, {k + 1 for k, x in enumerate(b) if x}, most, least, overlap) for n, b in zip(sizes.to_pylist(), breaks.to_pylist(), strict=True)]
        return pa.array([[(a, b - 1, n) for a, b, n in one] for one in found], kind)

    return cut(sizes, breaks)


def person_roles(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, name and role by three patterns; the first role of a name counts."""
    patterns = ((rf"({PERSON})\s*[—–-]\s*({ROLES})[а-яё]*", 1, 2), (rf"(?:^|[^а-яёА-ЯЁa-zA-Z])({ROLES})[а-яё]*\s*[:—–-]\s*({PERSON})", 2, 1), (rf"({PERSON})\s*\(({ROLES})[а-яё]*\)", 1, 2))

    def pairs(order: int, pattern: str, name: int, role: int) -> Column:
        names, roles = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (name, role))
        return F.transform(F.arrays_zip(names.alias("name"), roles.alias("role")), lambda x, i: F.struct(F.lit(order).alias("pattern"), i.alias("place"), F.trim(x["name"]).alias("name"), F.lower(F.trim(x["role"])).alias("role")))

    found = [pairs(order, *p) for order, p in enumerate(patterns)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.concat(*found)).alias("p")).select("doc_id", "p.*")
    return rows.groupBy("doc_id", "name").agg(F.min_by("role", F.struct("pattern", "place")).alias("role"))


def teams(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, team and member."""
    out = None
    for pattern in (rf"(?iu)команда\s+({TEAM}):\s*((?-i){MEMBERS})", rf"(?iu)в\s+команде\s+({TEAM})\s+работа[юе]т[а-я]*:\s*((?-i){MEMBERS})"):
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("team"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("members"))
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(pairs).alias("p")).select("doc_id", "p.team", F.explode(F.split("p.members", ",")).alias("m")).select("doc_id", "team", F.trim("m").alias("member"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def full_name(name: Column) -> Column:
    """Short forms become full ones, word by word; others get a capital.  Of two full names with one short form the last counts."""
    full = {short.lower(): name for name, shorts in SHORT_NAMES.items() for short in shorts} | {name.lower(): name for name in SHORT_NAMES}
    known = F.create_map(*[F.lit(x) for pair in full.items() for x in pair])
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000))))), " ")


def name_variants(name: Column) -> Column:
    """The full name, then with each short form of its first word."""
    shorts = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(y) for y in x]) for pair in SHORT_NAMES.items() for x in pair])
    full = full_name(name)
    first = F.get(F.split(full, " "), F.lit(0))
    rest = F.regexp_replace(full, r"^\S+", "")
    return F.array_distinct(F.concat(F.array(full), F.transform(F.coalesce(F.try_element_at(shorts, first), F.array().cast("array<string>")), lambda s: F.concat(s, rest))))


def protocol_lines(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Lines KIND|field|... of extraction output: kind and fields."""
    lines = raw.select("id", F.posexplode(F.split(text, "\n")).alias("line", "t"))
    parts = F.transform(F.split(F.trim("t"), r"\|"), lambda x: F.trim(x))
    return lines.select("id", "line", F.upper(F.get(parts, F.lit(0))).alias("kind"), parts.alias("fields")).where("size(fields) > 1")


def concept_lines(lines: DataFrame) -> DataFrame:
    """CONCEPT|name|type|description; the first line of each name counts."""
    field_at = lambda i: F.get("fields", F.lit(i))
    rows = lines.where("kind = 'CONCEPT' AND size(fields) >= 3").select("id", "line", F.lower(field_at(1)).alias("name"), one_of(field_at(2), CONCEPT_TYPES, "general").alias("type"), field_at(3).alias("description"))
    return rows.where("name <> ''").groupBy("id", "name").agg(F.min_by(F.struct("type", "description"), "line").alias("c")).select("id", "name", "c.*")


def relation_lines(lines: DataFrame, concepts: DataFrame) -> DataFrame:
    """RELATION|source|target|type|strength; both ends must be concepts of the same text."""
    field_at = lambda i: F.get("fields", F.lit(i))
    weights: Column = F.create_map(*[F.lit(x) for pair in RELATION_WEIGHTS.items() for x in pair])
    strength = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce(field_at(4).try_cast("double"), F.lit(1.0))))
    kind = one_of(field_at(3), RELATION_TYPES, "related_to")
    rows = lines.where("kind = 'RELATION' AND size(fields) >= 4").select("id", F.lower(field_at(1)).alias("source"), F.lower(field_at(2)).alias("target"), kind.alias("relation_type"), (F.try_element_at(weights, kind) * strength).alias("weight"))
    names = concepts.select("id", "name")
    return rows.join(names.withColumnRenamed("name", "source"), ["id", "source"], "left_semi").join(names.withColumnRenamed("name", "target"), ["id", "target"], "left_semi").where("source <> target")


def memory_lines(lines: DataFrame, min_length: int = 10) -> DataFrame:
    """MEMORY|content|type|importance|names,...; short contents go."""
    field_at = lambda i: F.get("fields", F.lit(i))
    rows = lines.where("kind = 'MEMORY' AND size(fields) >= 3").select(
        "id", "line", field_at(1).alias("content"), one_of(field_at(2), MEMORY_TYPES, "fact").alias("memory_type"), importance_of(field_at(3)).alias("importance"),
        F.filter(F.transform(F.split(F.coalesce(field_at(4), F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "").alias("concepts"),
    )
    return rows.where(F.char_length("content") >= min_length)


def persons(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Names with roles by the pattern "Surname Name — role"; the first role of a name counts.  A model for names can be joined in."""
    pattern = r"([А-ЯЁA-Z][а-яёa-z]+\s+[А-ЯЁA-Z][а-яёa-z]+)\s*[—–-]\s*([^\n,.;]{3,80})"
    hits = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("role"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(hits).alias("at", "p")).select("doc_id", "at", F.col("p.name").alias("name"), F.trim("p.role").alias("role"))
    return rows.groupBy("doc_id", "name").agg(F.min_by("role", "at").alias("role"))


def person_lines(lines: DataFrame) -> DataFrame:
    """PERSON|name|role|team; role and team may be missing, names of one character go."""
    field_at = lambda i: F.nullif(F.get("fields", F.lit(i)), F.lit(""))
    return lines.where("kind = 'PERSON'").select("id", "line", field_at(1).alias("name"), field_at(2).alias("role"), field_at(3).alias("team")).where(F.char_length("name") >= 2)


JSON_CONCEPTS = "array<struct<name:string,type:string,description:string>>"
JSON_RELATIONS = "array<struct<source:string,target:string,type:string>>"
JSON_MEMORIES = "array<struct<content:string,type:string,importance:string,concepts:array<string>>>"


def json_concepts(raw: DataFrame, text: str = "raw") -> DataFrame:
    """id, name, type and description from a JSON list of objects; the first object of a name counts."""
    rows = raw.select("id", F.posexplode(F.from_json(text, JSON_CONCEPTS)).alias("at", "c")).select("id", "at", F.lower(F.trim("c.name")).alias("name"), one_of(F.col("c.type"), CONCEPT_TYPES, "general").alias("type"), F.col("c.description").alias("description"))
    return rows.where("name <> ''").groupBy("id", "name").agg(F.min_by(F.struct("type", "description"), "at").alias("c")).select("id", "name", "c.*")


def json_relations(raw: DataFrame, concepts: DataFrame, text: str = "raw", weight: float = 0.7) -> DataFrame:
    """id, source, target, relation_type and weight; both ends must be concepts of the same text."""
    rows = raw.select("id", F.explode(F.from_json(text, JSON_RELATIONS)).alias("r")).select("id", F.lower(F.trim("r.source")).alias("source"), F.lower(F.trim("r.target")).alias("target"), one_of(F.coalesce("r.type", F.lit("")), RELATION_TYPES, "related_to").alias("relation_type"), F.lit(weight).alias("weight"))
    names = concepts.select("id", "name")
    return rows.join(names.withColumnRenamed("name", "source"), ["id", "source"], "left_semi").join(names.withColumnRenamed("name", "target"), ["id", "target"], "left_semi")


def json_memories(raw: DataFrame, text: str = "raw", min_length: int = 10) -> DataFrame:
    """id, content, memory_type, importance and concepts from a JSON list of objects."""
    rows = raw.select("id", F.explode(F.from_json(text, JSON_MEMORIES)).alias("m")).select(
        "id", F.trim("m.content").alias("content"), one_of(F.coalesce("m.type", F.lit("")), MEMORY_TYPES, "fact").alias("memory_type"), importance_of(F.col("m.importance")).alias("importance"),
        F.filter(F.transform(F.coalesce("m.concepts", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "").alias("concepts"),
    )
    return rows.where(F.char_length("content") >= min_length)


def enhanced_relations(relations: DataFrame) -> DataFrame:
    """Weights by kind times the told strength, which stays within 0.1 and 1."""
    weights: Column = F.create_map(*[F.lit(x) for pair in RELATION_WEIGHTS.items() for x in pair])
    strength = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce(F.col("strength"), F.lit(1.0))))
    return relations.withColumn("weight", F.coalesce(F.try_element_at(weights, F.col("relation_type")), F.lit(RELATION_WEIGHTS["related_to"])) * strength)
