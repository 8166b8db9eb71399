"""Text functions as Column expressions; pandas UDFs only where Spark has no built-in."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .stemming import stems

WORD = r"[\p{L}\p{N}_]+"
CYRILLIC, LATIN = "[а-яА-ЯёЁ]", "[a-zA-Z]"

# What counts as what in normalised text, by symbol.
BULLETS = "•●◦◆◇▪▫▸▹►▻‣⁃⁌⁍∙⋅⊙⊚○◌"
YES_CELLS = ("+", "＋", "✓", "✔", "☑", "✅", "⬛", "▣", "☒", "yes", "Yes", "YES", "да", "Да", "ДА")
NO_CELLS = ("-", "−", "–", "—", "―", "✗", "✘", "☐", "❌", "⬜", "☓", "✕", "no", "No", "NO", "нет", "Нет", "НЕТ")
EMPTY_CELLS = ("", "N/A", "n/a", "NA", "na", "Н/Д", "н/д")
SINGLE_LETTER_WORDS = ("я", "в", "с", "к", "у", "о", "а", "и")
LETTERS_TO_LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
LOOKALIKE_CYRILLIC, LOOKALIKE_LATIN = "АВСЕНКМОРТХУасеорух", "ABCEHKMOPTXYaceopyx"
LETTERS_TO_CYRILLIC = {
    "a": "а", "b": "б", "c": "с", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и", "j": "й", "k": "к", "l": "л", "m": "м",
    "n": "н", "o": "о", "p": "п", "q": "к", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "в", "x": "кс", "y": "й", "z": "з",
}
DIGRAPHS_TO_CYRILLIC = {"shch": "щ", "sh": "ш", "ch": "ч", "zh": "ж", "ts": "ц", "ya": "я", "yu": "ю", "yo": "ё", "kh": "х"}
MIXED_TERMS = {"login": "login", "email": "email", "api": "api", "url": "url", "http": "http", "https": "https", "json": "json", "xml": "xml", "логин": "login", "имейл": "email", "юрл": "url"}
STOPWORDS = tuple(
    """я ты он она оно мы вы они меня тебя его её нас вас их мне тебе ему ей нам вам им мной тобой нами вами ими себя себе собой
    мой твой наш ваш этот тот такой какой который чей весь всё все сам самый кто что никто ничто некто нечто
    в на с к у о об по из за от до под над при через после перед между без для про около вокруг среди вдоль против
    и а но или да ни либо то чтобы как когда если хотя пока потому поэтому так также тоже однако зато ведь
    не бы же ли ль вот вон даже лишь только уже ещё еще именно разве неужели
    быть есть был была было были будет будут буду будем будешь будете можно нужно надо нельзя стоит
    очень там тут здесь где куда откуда теперь сейчас тогда потом раньше позже почему зачем сколько
    это этого этому этим этом того тому тем том""".split()
)
PAGE_FIELDS = ("Навигация:", "ID страницы:", "Заголовок страницы:", "URL страницы:", "Автор страницы:", "Дата создания страницы:", "Редактор страницы:", "Дата последнего редактирования страницы:")
PATH_SEPARATORS = (" > ", " → ", " / ")
THOUGHT_PHRASES = (
    r"^Дай(?:те)? (?:мне )?подумать[.:]?\s*", r"^Мне нужно (?:по)?думать[.:]?\s*", r"^Давай(?:те)? разберём[.:]?\s*",
    r"^Let me think[.:]?\s*", r"^I need to think[.:]?\s*", r"^Let's break (?:this )?down[.:]?\s*",
)
LEAKS = (r"You are Kimi[\s\S]*?(?=\n\n|\z)", r"<\|im_system\|>[\s\S]*?<\|im_end\|>", r"<\|im_start\|>system[\s\S]*?<\|im_end\|>")
STRATEGY = r"СТРАТЕГИЯ:\s*\[?([^\]—\n]+?)\]?\s*[—-]\s*(.+?)"
BEHAVIORS = {  # name: keywords in the question, instruction
    "explain_concept": (("что такое", "what is", "explain", "объясни"), "Объяснить концепцию, дать определение и примеры использования"),
    "provide_instructions": (("как ", "how to", "how do"), "Предоставить пошаговые инструкции для выполнения задачи"),
    "troubleshoot": (("ошибка", "error", "не работает", "проблема", "failed"), "Диагностировать проблему и предложить решение"),
    "explain_reasoning": (("почему", "why", "зачем"), "Объяснить причины и логику"),
    "compare_options": (("сравни", "compare", "разница", "difference"), "Сравнить варианты, выделить различия"),
    "recommend": (("лучший", "best", "рекомендуй", "recommend"), "Порекомендовать оптимальный вариант с обоснованием"),
}
NO_BEHAVIOR = ("general_response", "Ответить на вопрос используя доступные знания")
DOMAINS = {
    "docker": ("docker", "контейнер", "container", "образ", "image", "dockerfile"),
    "kubernetes": ("kubernetes", "k8s", "pod", "kubectl", "deployment", "service"),
    "git": ("git", "commit", "branch", "merge", "репозитор"),
    "linux": ("linux", "ubuntu", "bash", "shell", "terminal", "apt"),
    "python": ("python", "pip", "venv", "django", "flask"),
    "database": ("database", "sql", "postgres", "mysql", "mongodb", "база данных"),
    "networking": ("network", "tcp", "http", "dns", "ip", "порт", "сеть"),
}
ABBREVIATIONS = (
    "т.е.", "т.к.", "и.т.д.", "и.т.п.", "т.н.", "т.д.", "т.п.", "г.", "гг.", "в.", "вв.", "н.э.", "до н.э.", "см.", "ср.", "напр.", "прим.", "др.", "пр.",
    "ок.", "обл.", "р.", "руб.", "коп.", "тыс.", "млн.", "млрд.", "трлн.", "им.", "ул.", "пер.", "пл.", "д.", "кв.", "стр.",
)
SIMPLE_QUERIES = (r"^(кто|что|где|когда)\s+", r"^как\s+называется", r"^какой\s+(номер|телефон|адрес|email)", r"^(дата|время|место)\s+", r"контакт(ы)?\s+")
COMPLEX_QUERIES = (r"(сравни|сравнение|отличия|разница)", r"(почему|зачем|для\s+чего)", r"(как\s+работает|принцип\s+работы)", r"(преимущества|недостатки|плюсы|минусы)", r"(объясни|расскажи\s+подробно)", r"(все|полный\s+список|перечисли)")
TOP_K = {"simple": 4, "moderate": 6, "complex": 8}


def escape_query(text: Column) -> Column:
    """A backslash before each character that a full-text query gives a meaning."""
    return F.regexp_replace(text, r"""([+\-&|!(){}\[\]^"~*?:\\/])""", r"\\$1")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def normalize_whitespace(text: Column) -> Column:
    """One kind of line end, no runs of blanks after the indent, no blanks at line ends, one empty line at most."""
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?<=\S) {2,}", " ")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n")


def normalize_bullets(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?m)^(\s*)[{BULLETS}](\s)", "$1-$2")


def normalize_cell(cell: Column) -> Column:
    """да for plus and check marks, нет for dashes and crosses, nothing for marks of absence."""
    c = F.trim(cell)
    return F.when(c.isin(*YES_CELLS), "да").when(c.isin(*NO_CELLS), "нет").when(c.isin(*EMPTY_CELLS), "").otherwise(c)


def normalize_table_lines(text: Column) -> Column:
    def row(line: Column) -> Column:
        is_row = F.ltrim(line).startswith("|") & ~line.rlike(r"^[\s|:\-]+$")
        cells = F.transform(F.split(F.trim(line), r"\|"), lambda c: F.when(F.trim(c) == "", c).otherwise(F.concat(F.lit(" "), normalize_cell(c), F.lit(" "))))
        return F.when(is_row, F.array_join(cells, "|")).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n"), row), "\n")


@F.pandas_udf(StringType())
def normalize_unicode(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalize_full(text: Column) -> Column:
    return normalize_table_lines(normalize_bullets(normalize_whitespace(normalize_unicode(text))))


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")


def clean_markdown(text: Column) -> Column:
    return F.trim(normalize_full(strip_front_matter(text)))


def title_of(text: Column) -> Column:
    """Header line, first heading, title field, or first line that is not a rule, cut at 100."""
    found = [F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in (r"(?m)^Заголовок:[ \t]*(.+)$", r"(?m)^#[ \t]+(.+)$", r"(?m)^title:[ \t]*[\"']?(.+?)[\"']?[ \t]*$")]
    first = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("---"))
    return F.coalesce(*found, F.substring(F.get(first, F.lit(0)), 1, 100), F.lit("Untitled"))


def doc_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext.isin(".md", ".markdown"), "markdown").when(ext.isin(".html", ".htm"), "html").when(ext == ".pdf", "pdf").otherwise("text")


def russian_tokens(text: Column) -> Column:
    """Words of Cyrillic and Latin letters with hyphens inside; of single letters only those that are words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([а-яёa-z](?:[а-яёa-z\-]*[а-яёa-z])?)"), F.lit(1))
    return F.filter(found, lambda w: (F.char_length(w) > 1) | w.isin(*SINGLE_LETTER_WORDS))


def cyrillic_share(text: Column) -> Column:
    count = lambda p: F.regexp_count(text, F.lit(p))
    return F.coalesce(F.try_divide(count(CYRILLIC), count(CYRILLIC) + count(LATIN)), F.lit(0.0))


def to_latin(text: Column) -> Column:
    """Letter by letter; single letters in one pass, the rest one by one."""
    one = {c: x for c, x in LETTERS_TO_LATIN.items() if len(x) <= 1}
    one |= {c.upper(): x.upper() for c, x in one.items()}
    many = {c: x for c, x in LETTERS_TO_LATIN.items() if len(x) > 1}
    for c, x in many.items():
        text = F.replace(F.replace(text, F.lit(c), F.lit(x)), F.lit(c.upper()), F.lit(x.capitalize()))
    kept = {c: x for c, x in one.items() if x}
    gone = [c for c, x in one.items() if not x]
    return F.translate(text, "".join([*kept, *gone]), "".join(kept.values()))


def has_cyrillic(text: Column) -> Column:
    return text.rlike(CYRILLIC)


def has_latin(text: Column) -> Column:
    return text.rlike(LATIN)


def is_mixed(text: Column) -> Column:
    return has_cyrillic(text) & has_latin(text)


def is_russian(text: Column, threshold: float = 0.5) -> Column:
    """Share of Cyrillic among Cyrillic and Latin letters; without a letter, no."""
    cyrillic, latin = (F.regexp_count(text, F.lit(p)) for p in ("[\u0400-\u04ff]", LATIN))
    return F.coalesce(F.try_divide(cyrillic, cyrillic + latin) >= threshold, F.lit(False))


def to_cyrillic(text: Column) -> Column:
    """Digraphs from the longest on, then letter by letter; a capital first letter makes a capital."""
    for latin, cyrillic in DIGRAPHS_TO_CYRILLIC.items():
        for first in (latin[0], latin[0].upper()):
            rest = "".join(f"[{c}{c.upper()}]" for c in latin[1:])
            text = F.regexp_replace(text, first + rest, cyrillic.upper() if first.isupper() else cyrillic)
    one = {c: x for c, x in LETTERS_TO_CYRILLIC.items() if len(x) == 1}
    for c, x in LETTERS_TO_CYRILLIC.items():
        if len(x) > 1:
            text = F.replace(F.replace(text, F.lit(c), F.lit(x)), F.lit(c.upper()), F.lit(x.upper()))
    one |= {c.upper(): x.upper() for c, x in one.items()}
    return F.translate(text, "".join(one), "".join(one.values()))


def script_variants(query: Column) -> Column:
    """The query, its Cyrillic and its Latin form, and for mixed script the one with lookalikes replaced; each once."""
    fixed = F.when(is_mixed(query), fix_lookalikes(query)).otherwise(query)
    return F.array_distinct(F.array(query, to_cyrillic(query), to_latin(query), fixed))


def index_forms(text: Column) -> Column:
    return F.struct(to_cyrillic(text).alias("cyrillic"), to_latin(text).alias("latin"), text.alias("original"))


def normalize_terms(text: Column) -> Column:
    """Terms that occur in either script, by substring and whatever their case."""
    for term, normal in MIXED_TERMS.items():
        text = F.regexp_replace(text, rf"(?iu)\Q{term}\E", normal)
    return text


def without_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*STOPWORDS))


def prepare_search_text(text: Column, lemmas: bool = True, stopwords: bool = True) -> Column:
    """Text as it is indexed and asked: tokens without stop words before and after lemmatising, or the text itself."""
    if not lemmas and not stopwords:
        return text
    tokens = without_stopwords(russian_tokens(text)) if stopwords else russian_tokens(text)
    if lemmas:
        tokens = stems(tokens)
        tokens = without_stopwords(tokens) if stopwords else tokens
    return F.array_join(tokens, " ")


def with_search_texts(docs: DataFrame, text: str) -> DataFrame:
    """Adds plain and lemmas, the two forms of ``prepare_search_text`` without stop words; words are split once."""
    once = docs.withColumn("_w", without_stopwords(russian_tokens(F.col(text))))
    return once.withColumns({"plain": F.array_join("_w", " "), "lemmas": F.array_join(without_stopwords(stems("_w")), " ")}).drop("_w")


def clean_text(text: Column) -> Column:
    """One blank for white space, and one of a run of full stops, exclamation or question marks."""
    text = F.regexp_replace(text, r"\s+", " ")
    for mark in (".", "!", "?"):
        text = F.regexp_replace(text, rf"[{mark}]{{2,}}", mark)
    return F.trim(text)


def page_fields(content: Column) -> Column:
    """title, url, path, space and parents of an exported page."""
    def after(name: str, value: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(content, rf"(?m)^{name}\s*({value})", 1)), F.lit(""))

    line = after("Навигация:", "[^\n]+")
    path = F.array(line)
    for mark in reversed(PATH_SEPARATORS):
        path = F.when(line.contains(mark), F.filter(F.transform(F.split(line, mark), lambda x: F.trim(x)), lambda x: x != "")).otherwise(path)
    path = F.when(line.isNull(), F.array().cast("array<string>")).otherwise(path)
    return F.struct(after("Заголовок страницы:", "[^\n]+").alias("title"), after("URL страницы:", r"https?://\S+").alias("url"), path.alias("path"), F.get(path, F.lit(0)).alias("space"), F.slice(path, 2, 1000).alias("parents"))


def strip_page_fields(content: Column) -> Column:
    """The text from its first line on that is neither empty nor a field of the page's header."""
    header = "|".join(rf"\Q{p}\E" for p in PAGE_FIELDS)
    return F.regexp_replace(F.regexp_replace(content, rf"\A(?:[^\S\n]*(?:(?:{header})[^\n]*)?(?:\n|\z))+", ""), r"\A\s+|\s+\z", "")


def sentences(text: Column) -> Column:
    """Parts that end in a mark before white space and a capital or a digit, or before a bullet; lines, if that gives one part only.

    Full stops of abbreviations end nothing, wherever their letters occur.
    """
    held = text
    for short in sorted(ABBREVIATIONS, key=len, reverse=True):
        held = F.replace(held, F.lit(short), F.lit(short.replace(".", "\u0001")))
    marked = F.regexp_replace(held, r"(?<=[.!?])\s+(?=[A-ZА-ЯЁ0-9])|(?<=\n)\s*(?=[-•*])", "\u0000")
    trimmed = lambda x: F.regexp_replace(F.replace(x, F.lit("\u0001"), F.lit(".")), r"\A\s+|\s+\z", "")
    parts = F.filter(F.transform(F.split(marked, "\u0000"), trimmed), lambda x: x != "")
    by_line = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != "")
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    lines = once(by_line, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(text)))
    return once(parts, lambda x: F.when(F.size(x) > 1, x).otherwise(lines))


def fix_lookalikes(text: Column) -> Column:
    """Letters of the rarer script that look like letters of the other become these; Latin wins a tie."""
    more = F.regexp_count(text, F.lit(CYRILLIC)) > F.regexp_count(text, F.lit(LATIN))
    mixed = text.rlike(CYRILLIC) & text.rlike(LATIN)
    return F.when(~mixed, text).when(more, F.translate(text, LOOKALIKE_LATIN, LOOKALIKE_CYRILLIC)).otherwise(F.translate(text, LOOKALIKE_CYRILLIC, LOOKALIKE_LATIN))


def expanded_query(query: Column, terms: Column) -> Column:
    """All different terms in lower case, or the query where there is none."""
    low = F.array_sort(F.array_distinct(F.transform(terms, F.lower)))
    return F.when(F.size(low) > 0, F.array_join(low, " ")).otherwise(query)


def expand_terms(name: Column, aliases: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lower(name)), F.transform(F.coalesce(aliases, F.array().cast("array<string>")), F.lower)))


def query_complexity(query: Column) -> Column:
    q = F.trim(F.lower(query))
    return F.when(q.rlike("|".join(SIMPLE_QUERIES)), "simple").when(q.rlike("|".join(COMPLEX_QUERIES)), "complex").otherwise("moderate")


def dynamic_top_k(query: Column) -> Column:
    kind = query_complexity(query)
    return F.when(kind == "simple", TOP_K["simple"]).when(kind == "complex", TOP_K["complex"]).otherwise(TOP_K["moderate"])


def _quality(w: Column, d: Column, stopwords: Sequence[str], min_words: int) -> Column:
    """From the words and the different words of a text."""
    n, distinct = F.size(w), F.size(d)
    length = F.least(F.lit(1.0), n / F.lit(float(min_words))) * F.when(n > 500, 0.9).otherwise(1.0)
    variety = F.when(n < 50, F.least(F.lit(1.0), distinct / n * 1.2)).otherwise(distinct / n)
    content, different = (F.size(F.filter(x, lambda y: ~y.isin(*stopwords))) for x in (w, d))
    return F.when(n < 5, 0.0).otherwise(0.2 * length + 0.3 * variety + 0.25 * content / n + 0.25 * different / n)


def chunk_quality(text: Column, stopwords: Sequence[str] = STOPWORDS, min_words: int = 20) -> Column:
    """Weighted mean of length, variety, share of content words and variety of these; 0 under five words."""
    w = words(text)
    return _quality(w, F.array_distinct(w), stopwords, min_words)


def with_quality(docs: DataFrame, text: str, name: str = "quality", stopwords: Sequence[str] = STOPWORDS, min_words: int = 20) -> DataFrame:
    """Adds ``chunk_quality``; words are split once and distinct ones found once."""
    once = docs.withColumn("_w", words(F.col(text))).withColumn("_d", F.array_distinct("_w"))
    return once.withColumn(name, _quality(F.col("_w"), F.col("_d"), stopwords, min_words)).drop("_w", "_d")


def good_chunks(docs: DataFrame, text: str, threshold: float = 0.4) -> DataFrame:
    """Rows whose text reaches the quality threshold."""
    return with_quality(docs, text, "_quality").where(F.col("_quality") >= threshold).drop("_quality")


def strip_thinking(text: Column, aggressive: bool = False, structure: bool = True) -> Column:
    """Complete reasoning blocks and leaked system prompts go; of tags without a partner only the tag goes.

    ``aggressive`` also takes away phrases that open a reasoning; without
    ``structure`` all white space becomes one blank.
    """
    blocks = (r"<think>[\s\S]*?</think>", r"<thinking>[\s\S]*?</thinking>", r"<\|im_thinking\|>[\s\S]*?<\|im_end\|>")
    for pattern in (*blocks, *LEAKS, r"</?think>|</?thinking>"):
        text = F.regexp_replace(text, pattern, "")
    for pattern in THOUGHT_PHRASES if aggressive else ():
        text = F.regexp_replace(text, f"(?imu){pattern}", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]+", " ") if structure else F.regexp_replace(text, r"\s+", " ")
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def thinking_of(text: Column) -> Column:
    """The first complete reasoning block; null without one."""
    return F.when(text.rlike(r"(?s)<think>.*?</think>"), F.trim(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)))


def leaks_thinking(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?s)<think>.*?</think>|<thinking>.*?</thinking>|<\|im_thinking\|>.*?<\|im_end\|>"), F.lit(False))


def tolerant_json(raw: Column) -> Column:
    """The text itself, a fenced block, the widest object or the widest list, whichever parses first; as a variant."""
    clean = strip_thinking(raw)
    tries = [clean, F.regexp_extract(clean, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(clean, r"(?s)(\{.*\})", 1), F.regexp_extract(clean, r"(?s)(\[.*\])", 1)]
    return F.coalesce(*[F.try_parse_json(F.nullif(F.trim(t), F.lit(""))) for t in tries])


def parse_list(raw: Column) -> Column:
    """Items by line if there are as many line ends as commas, else by comma, without leading marks and digits."""
    clean = strip_thinking(raw, aggressive=True)
    ends, commas = F.regexp_count(clean, F.lit("\n")), F.regexp_count(clean, F.lit(","))
    parts = F.when((ends > 0) & (ends >= commas), F.split(clean, "\n")).otherwise(F.split(clean, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[\s\-*•\d.]+", ""))), lambda x: x != "")


def key_values(raw: Column) -> Column:
    """Map of ``key: value``, ``key = value`` and ``**key**: value`` lines; later forms overwrite earlier ones."""
    clean = strip_thinking(raw, aggressive=True)
    found = []
    for pattern in (r"\*\*([^*]+)\*\*\s*[:=]\s*([^\n]+)", r"(?m)^([^:\n]+?)\s*:\s*([^\n]+)$", r"(?m)^([^=\n]+?)\s*=\s*([^\n]+)$"):
        pairs = F.arrays_zip(F.regexp_extract_all(clean, F.lit(pattern), F.lit(1)).alias("key"), F.regexp_extract_all(clean, F.lit(pattern), F.lit(2)).alias("value"))
        found.append(F.transform(pairs, lambda p: F.struct(F.trim(p["key"]).alias("key"), F.trim(p["value"]).alias("value"))))
    entries = F.filter(F.concat(*found), lambda p: (p["key"] != "") & (p["value"] != ""))
    last = F.filter(entries, lambda p, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def between(raw: Column, start: str, end: str) -> Column:
    """What stands between two markers, without the white space at its ends; null if they are not there."""
    pattern = rf"(?s)\Q{start}\E\s*(.*?)\s*\Q{end}\E"
    clean = strip_thinking(raw)
    return F.when(clean.rlike(pattern), F.regexp_extract(clean, pattern, 1))


def one_of(value: Column, known: Sequence[str], default: str) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(*known), v).otherwise(default)


def importance_of(value: Column) -> Column:
    """Within 1 and 10; 5 for what is no number."""
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.coalesce(value.try_cast("double"), F.lit(5.0))))


def shorten(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def infer(text: Column, rules: Mapping[str, Sequence[str]], default: str) -> Column:
    """First entry one of whose keywords occurs in the text, as a substring."""
    low, out = F.lower(text), F.lit(default)
    for name, keys in reversed(rules.items()):
        hit = F.lit(False)
        for key in keys:
            hit |= low.contains(key)
        out = F.when(hit, name).otherwise(out)
    return out


def behavior_of(query: Column, answer: Column) -> Column:
    """name, instruction and domain: from a strategy line, else from keywords of the question."""
    line = rf"(?imu){STRATEGY}$"
    low = F.lower(query)
    name, instruction = F.lit(NO_BEHAVIOR[0]), F.lit(NO_BEHAVIOR[1])
    for kind, (keys, text) in reversed(BEHAVIORS.items()):
        hit = low.rlike("|".join(keys))
        name, instruction = F.when(hit, kind).otherwise(name), F.when(hit, text).otherwise(instruction)
    told = F.coalesce(answer.rlike(line), F.lit(False))
    said = F.replace(F.lower(F.trim(F.regexp_extract(answer, line, 1))), F.lit(" "), F.lit("_"))
    domain = infer(F.concat_ws(" ", query, answer), DOMAINS, "general")
    return F.struct(F.when(told, said).otherwise(name).alias("name"), F.when(told, F.trim(F.regexp_extract(answer, line, 2))).otherwise(instruction).alias("instruction"), domain.alias("domain"))


def clean_answer(answer: Column) -> Column:
    """The answer without its strategy line."""
    return F.trim(F.regexp_replace(answer, rf"(?imu)\n*{STRATEGY}$", ""))


def source_match(asked: Column, given: Column) -> Column:
    """1 for the same address or path, 0.95 for the same page id, 0.9 for the same last segment, 0.8 for containment, else 0."""
    a, b = (F.regexp_replace(F.lower(F.trim(x)), r"/+$", "") for x in (asked, given))
    path = lambda u: F.regexp_replace(F.regexp_extract(u, r"^[a-z]+://[^/]+(/[^?#]*)", 1), r"/+$", "")
    page = lambda u: F.regexp_extract(u, r"pageid=(\d+)", 1)
    last = lambda u: F.regexp_extract(path(u), r"([^/]+)$", 1)
    same_path = (path(a) != "") & (path(a) == path(b))
    return (
        F.when((a == b) & (a != ""), 1.0).when(same_path & (page(a) == page(b)), 1.0).when((page(a) != "") & (page(a) == page(b)), 0.95)
        .when((last(a) != "") & (last(a) == last(b)), 0.9).when((a != "") & (b != "") & (a.contains(b) | b.contains(a)), 0.8).otherwise(0.0)
    )


def urls(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"')\]]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def token_count(text: Column) -> Column:
    return (F.size(F.array_remove(F.split(F.trim(text), r"\s+"), "")) * 1.3).cast("int")
