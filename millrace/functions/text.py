"""Text functions as Column expressions: retrieval terms, sentences, headings, titles.

All are built-in expressions over one row, so nothing is shuffled and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the text conventions that results must follow.
NOT_WORD = r"[^\p{L}\p{N}]+"
HAN = r"[\x{4e00}-\x{9fff}]+"
SENTENCE_END = "(?<=[。！？!?；;])"
CLAUSE_END = "(?<=[，、：:])"
MARKER = "第[一二三四五六七八九十百千万0-9]+条|第[一二三四五六七八九十百千万0-9]+款|[（(][一二三四五六七八九十0-9]+[)）]|[一二三四五六七八九十]+、|[0-9]+[、.]"
SHORT_MARKER = "^(?:第[一二三四五六七八九十百千万0-9]+[条款]|[（(][一二三四五六七八九十0-9]+[)）]|[一二三四五六七八九十]+、|[0-9]+[、.])"
MARKDOWN_HEADING = r"^(#{1,6})\s+(.+?)\s*$"
LIST_HEADING = r"^[一二三四五六七八九十百千]+、\s*(.+)$"
ARTICLE_HEADING = r"^第[一二三四五六七八九十百千0-9]+[章节条款部分编]\s*(.*)$"
NUMBER_HEADING = r"^(?:[(（]?[0-9]+[)）]|[0-9]+[.、])\s*(.+)$"
TITLE_PREFIX = r"^(?:附件|附录|说明|注：|备注：|一是|二是|三是|四是|五是|六是)\s*"
TITLE_SUFFIXES = ("条件", "范围", "材料", "流程", "期限", "对象", "要求", "标准", "方式", "程序", "附则")
TITLE_TRAILING = "。；;！？!?：:，,"
SENTENCE_SIGNS = "。！？!?；;"
MAX_SENTENCE, SHORT_SENTENCE, MAX_TITLE, SURE_TITLE = 120, 8, 30, 12
SPACE = r"(?U)\s+"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return trimmed(F.regexp_replace(c, SPACE, " "))


def folded(c: Column) -> Column:
    """Lower case for comparison; ß counts as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def _grams(span: Column) -> Column:
    """A span of Han characters itself if it is short, and all its stretches of two to four characters."""
    n = F.char_length(span)

    def of(k: int) -> Column:
        starts = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(span, i, F.lit(k)))

    whole = F.when(n <= 8, F.array(span)).otherwise(F.array().cast("array<string>"))
    return F.concat(whole, of(2), of(3), of(4))


def terms(c: Column) -> Column:
    """Distinct retrieval terms in order: words of more than one character, and the short spans and n-grams of Han characters. Null gives null."""
    text = trimmed(folded(c))
    pieces = F.filter(F.split(text, NOT_WORD), lambda p: F.char_length(p) > 0)
    first = F.flatten(F.transform(pieces, lambda p: F.when(p.rlike(f"^{HAN}$"), _grams(p)).when(F.char_length(p) > 1, F.array(p)).otherwise(F.array().cast("array<string>"))))
    second = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({HAN})")), _grams))
    return F.array_distinct(F.concat(first, second))


def _cleaned(parts: Column) -> Column:
    strip = lambda p: F.regexp_replace(p, "^[ ，、]+|[ ，、]+$", "")
    return F.filter(F.transform(parts, strip), lambda p: F.char_length(p) > 0)


def _packed(parts: Column, most: int) -> Column:
    """Neighbouring parts joined while they fit."""
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, x: Column) -> Column:
        full = (s["open"] != "") & (F.char_length(s["open"]) + F.char_length(x) > most)
        return F.struct(F.when(full, F.array_append(s["done"], trimmed(s["open"]))).otherwise(s["done"]).alias("done"), F.when(full, x).otherwise(F.concat(s["open"], x)).alias("open"))

    return F.aggregate(parts, none, step, lambda s: F.when(s["open"] != "", F.array_append(s["done"], trimmed(s["open"]))).otherwise(s["done"]))


def sentences(c: Column, most: int = MAX_SENTENCE) -> Column:
    """Sentence-like units: by line and end mark; a unit longer than ``most`` by structural markers, else by clauses; very short ones join the one before. Null gives null, blank text none."""
    text = F.regexp_replace(F.replace(c, F.lit("\u3000"), F.lit(" ")), "\r\n?", "\n")
    text = trimmed(F.regexp_replace(F.regexp_replace(text, r"[ \t]*\n+[ \t]*", "\n"), r"[\t\r\f\x0B ]+", " "))
    coarse = F.flatten(F.transform(F.split(text, "\n"), lambda line: _cleaned(F.split(trimmed(line), SENTENCE_END))))

    def finer(x: Column) -> Column:
        marked, clauses = _cleaned(F.split(x, f"(?={MARKER})")), _cleaned(F.split(x, CLAUSE_END))
        return F.when(F.char_length(x) <= most, F.array(x)).when(F.size(marked) > 1, _packed(marked, most)).when(F.size(clauses) > 1, _packed(clauses, most)).otherwise(F.array(x))

    fine = F.filter(F.transform(F.flatten(F.transform(coarse, finer)), trimmed), lambda x: F.char_length(x) > 0)

    def join(done: Column, x: Column) -> Column:
        short = (F.size(done) > 0) & (F.char_length(x) <= SHORT_SENTENCE) & ~x.rlike(SHORT_MARKER)
        return F.when(short, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), x)))).otherwise(F.array_append(done, x))

    return F.aggregate(fine, F.array().cast("array<string>"), join)


def is_heading(c: Column) -> Column:
    """Whether a paragraph is a heading: one line that is marked or numbered as such, or a short title."""
    text = trimmed(c)
    n = F.char_length(text)
    short = (
        (n <= MAX_TITLE)
        & ~F.right(text, F.lit(1)).rlike(f"[{TITLE_TRAILING}]")
        & ~text.rlike(f"[{SENTENCE_SIGNS}]")
        & text.rlike(r"[\p{L}\p{Nd}\p{No}]")
        & (text.rlike(TITLE_PREFIX) | text.rlike("(?:" + "|".join(TITLE_SUFFIXES) + ")$") | (n <= SURE_TITLE))
    )
    marked = text.rlike(MARKDOWN_HEADING) | text.rlike(LIST_HEADING) | text.rlike(ARTICLE_HEADING) | text.rlike(NUMBER_HEADING)
    return (n > 0) & ~text.contains("\n") & (marked | short)


def heading_title(c: Column) -> Column:
    """A heading without its markdown signs."""
    text = trimmed(c)
    return F.when(text.rlike(MARKDOWN_HEADING), F.regexp_extract(text, MARKDOWN_HEADING, 2)).otherwise(text)


def paragraphs(c: Column, markdown: Column | bool = False) -> Column:
    """Paragraphs of a raw text: blank lines separate them, lines are trimmed; in markdown a heading stands alone."""
    markdown = F.lit(markdown) if isinstance(markdown, bool) else markdown
    lines = F.transform(F.split(c, "\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"), trimmed)
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, x: Column) -> Column:
        head = markdown & x.rlike(r"^#{1,6}( |$)")
        ends = (x == "") | head
        done = F.when(ends & (s["open"] != ""), F.array_append(s["done"], s["open"])).otherwise(s["done"])
        done = F.when(head, F.array_append(done, x)).otherwise(done)
        text = F.when(ends, F.lit("")).when(s["open"] == "", x).otherwise(F.concat_ws("\n", s["open"], x))
        return F.struct(done.alias("done"), text.alias("open"))

    return F.aggregate(lines, none, step, lambda s: F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def title(found: Column, fallback: Column) -> Column:
    """The first line of the first paragraph, without markdown signs; the fallback if there is none."""
    first = F.get(F.filter(F.transform(found, trimmed), lambda p: F.char_length(p) > 0), 0)
    plain = trimmed(F.when(first.rlike(r"^#{1,6}( |$)"), F.regexp_replace(first, "^#+", "")).otherwise(F.get(F.split(first, "\n"), 0)))
    return F.coalesce(F.nullif(plain, F.lit("")), fallback)
