"""Scalar text functions as column expressions.

White space is Unicode white space, as in Python, so that results do not change with the engine: Java needs ``(?U)``.
Functions take and give columns; a null text counts as empty unless said otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellum.functions import fixed

#: White space as Python sees it: Unicode's, and four separators that Java leaves out.
SPACE = r"[\s\x{1c}-\x{1f}]"
#: The line ends that Python's ``splitlines`` knows.
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def _u(pattern: str, flags: str = "U") -> str:
    return f"(?{flags}){pattern}"


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+\z", "")


def lines(c: Column) -> Column:
    """Lines as ``splitlines`` gives them: no empty piece behind a final line end."""
    return let(F.split(text_of(c), LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() or unicodedata.is_normalized("NFKC", x) else unicodedata.normalize("NFKC", x))


#: Unicode compatibility composition, which Spark has no built-in function for.
nfkc = F.pandas_udf(_nfkc, StringType())


def squeeze(c: Column) -> Column:
    """A normalised text without invisible characters and with single spaces; newlines stay."""
    for ch in fixed.INVISIBLE:
        c = F.replace(c, F.lit(ch))
    return strip(F.regexp_replace(c, r"[\t\x0b\f\r ]+", " "))


def normalize_inline(c: Column) -> Column:
    """Compatibility composition, then :func:`squeeze`."""
    return squeeze(text_of(nfkc(c)))


def normalize_code_line(c: Column) -> Column:
    """A line of program text: composed, tabs as four spaces, nothing invisible, no space at its end."""
    c = text_of(nfkc(c))
    for ch in fixed.INVISIBLE:
        c = F.replace(c, F.lit(ch))
    return rstrip(F.replace(c, F.lit("\t"), F.lit("    ")))


def normalize_multiline(c: Column) -> Column:
    """Normalised lines, the empty ones left out. The text is composed once, then cut: composition adds no line ends."""
    return F.array_join(F.filter(F.transform(lines(nfkc(c)), squeeze), lambda x: x != ""), "\n")


def visible_chars(c: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(text_of(c), f"(?U){SPACE}+", ""))


def contains_cjk(c: Column) -> Column:
    return text_of(c).rlike(fixed.CJK)


def estimate_tokens(c: Column) -> Column:
    """One per CJK, kana or hangul character, one per four other visible characters (rounded up)."""
    wide = F.length(F.regexp_replace(text_of(c), f"(?U)[^{fixed.TOKEN_CHARS[1:-1]}]+", ""))
    return (wide + F.ceil((visible_chars(c) - wide) / 4)).cast("long")


def is_list_line(c: Column) -> Column:
    return strip(text_of(c)).rlike(_u(fixed.LIST_ITEM))


def is_page_number(c: Column) -> Column:
    return text_of(c).rlike(_u(fixed.PAGE_NUMBER.replace("$", r"\z"), "Ui"))


def is_promotion(c: Column) -> Column:
    return text_of(c).rlike(_u(fixed.PROMOTION, "Ui"))


def opens_paragraph(c: Column) -> Column:
    return text_of(c).rlike("^" + _any(fixed.PARAGRAPH_OPENERS))


def ends_sentence(c: Column) -> Column:
    return strip(text_of(c)).rlike(fixed.SENTENCE_END)


def is_number_run(c: Column) -> Column:
    """Two or more numbers, each one more than the last."""
    n = F.transform(F.split(c, r"\s+"), lambda x: F.try_to_number(x, F.lit("9999")).cast("int"))
    steps = F.zip_with(F.slice(n, 2, F.size(n)), F.slice(n, 1, F.size(n) - 1), lambda b, a: b - a == 1)
    return F.when(c.rlike(_u(fixed.NUMBER_RUN.replace("$", r"\z"))), F.forall(steps, lambda x: F.coalesce(x, F.lit(False)))).otherwise(F.lit(False))


def is_noise(c: Column) -> Column:
    """Whether a normalised line says nothing: empty, bullets alone, labels of a viewer, strips of line numbers."""
    c = text_of(c)
    return (c == "") | c.rlike(fixed.BULLETS) | c.rlike(_u(fixed.UI_LABEL, "Ui")) | c.rlike(_u(fixed.NUMBER_STRIP)) | is_number_run(c)


#: White space as Java's patterns see it, in Python's.
_JAVA_SPACE = r"[^\S\x1c-\x1f]"
_LABELS = [re.compile(p.replace(r"\s", _JAVA_SPACE), re.IGNORECASE) for p in (fixed.BULLETS, fixed.UI_LABEL, fixed.NUMBER_STRIP)]
_RUN = re.compile(fixed.NUMBER_RUN.replace(r"\s", _JAVA_SPACE))
#: First characters of lines that may be noise, besides digits: bullets and the labels of a viewer.
_SUSPECT = frozenset(fixed.BULLETS[2:-3] + "PpCcTt复")


def _steps_by_one(line: str) -> bool:
    n = re.split(r"[ \t-\r]+", line)
    return all(a.isdecimal() and b.isdecimal() and int(b) - int(a) == 1 for a, b in zip(n, n[1:], strict=False))


def _says_nothing(line: str) -> bool:
    """:func:`is_noise` of a normalised line that is not empty. Most lines are told by their first character."""
    if line[0] not in _SUSPECT and not line[0].isdecimal():
        return False
    return any(p.fullmatch(line) for p in _LABELS) or bool(_RUN.fullmatch(line)) and _steps_by_one(line)


def _cleaned(text: str | None) -> str:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        for ch in fixed.INVISIBLE:
            text = text.replace(ch, "")
    if "  " in text or "\t" in text:  # the other white space that is squeezed ends lines
        text = re.sub(r"[\t ]+", " ", text)
    return "\n".join(x for x in map(str.strip, text.splitlines()) if x and not _says_nothing(x))


def clean(c: Column) -> Column:
    """Normalised lines without noise: what :func:`lines`, :func:`squeeze` and :func:`is_noise` give, a text at a time."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_cleaned(x) for x in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, StringType())(c)


def count_of(c: Column, characters: str) -> Column:
    return F.length(c) - F.length(F.translate(c, characters, ""))


def like_sentence(c: Column) -> Column:
    """Whether a normalised line reads like a sentence or an item rather than a heading."""
    c = text_of(c)
    size = visible_chars(c)
    after_colon = F.regexp_extract(c, r"(?s)^[^：:]*[：:](.*)$", 1)
    return (c != "") & (
        c.rlike("[。！？!?；;，,]$") | (count_of(c, "，,") >= 2) | (c.rlike("[：:]") & (visible_chars(after_colon) >= 12)) | ((size > 36) & c.rlike(_any(fixed.EXPLANATORY))) | (size > 52)
    )


def continues(c: Column) -> Column:
    """Whether a normalised text starts like the rest of a sentence. Every Chinese first character counts."""
    c = text_of(c)
    return (c != "") & ~is_list_line(c) & (c.rlike("^" + _any(fixed.CONTINUATIONS)) | c.rlike(fixed.LATIN_CONTINUATION) | c.rlike("^" + fixed.CJK))


def starts_mid_sentence(c: Column) -> Column:
    """Whether a normalised text starts with an opening of the fixed list, or in lower case or punctuation."""
    c = text_of(c)
    return (c != "") & (c.rlike("^" + _any(fixed.SUSPICIOUS_OPENINGS)) | c.rlike(fixed.LATIN_CONTINUATION))


def has_broken_cjk_line(c: Column) -> Column:
    return text_of(c).rlike(rf"{fixed.CJK_WIDE}\n{{2,}}{fixed.CJK_WIDE}")


def has_glued_list(c: Column) -> Column:
    return text_of(c).rlike(rf"(?U)(?:^|\n)\s*\d+[.)、]\s*[^\n。！？!?]{{18,}}{_any(fixed.GLUED_OPENERS)}")


def is_malformed_code(c: Column) -> Column:
    c = text_of(c)
    wrong = c.rlike(fixed.MALFORMED_CODE[0])
    for pattern in fixed.MALFORMED_CODE[1:]:
        wrong = wrong | c.rlike(pattern)
    return c.rlike(r"(?:^|\n)\s*(?:def|class|import|from)\b") & wrong


def is_suspicious_heading(c: Column) -> Column:
    """Empty, a sentence, a long numbered item, or with two commas."""
    c = strip(text_of(c))
    size = visible_chars(c)
    numbered = c.rlike(_u(r"^\d+[、.]\s*"))
    return (c == "") | c.rlike(fixed.SENTENCE_END) | (numbered & ((size > 38) | (c.rlike("[:：]") & (size > 28)))) | (count_of(c, "，,") >= 2)


def code_like(line_array: Column, markers: int = 2) -> Column:
    """Whether lines look like program text: enough opening words, or one and two lines with code's punctuation."""
    live = F.filter(line_array, lambda x: strip(x) != "")
    marked = F.size(F.filter(live, lambda x: strip(x).rlike(_u(fixed.CODE_LINE, "i"))))
    pointed = F.size(F.filter(live, lambda x: x.rlike(fixed.CODE_PUNCTUATION)))
    return (marked >= markers) | ((marked >= 1) & (pointed >= 2))


def dense_code(c: Column) -> Column:
    """Whether a text of three lines or more is mostly code: by its lines, or by the share of code's punctuation."""
    live = F.filter(lines(c), lambda x: strip(x) != "")
    signs = F.size(F.filter(live, lambda x: strip(x).rlike(_u(fixed.CODE_SIGN, "i")))) + F.size(F.filter(live, lambda x: strip(x).rlike(r"^(?:```|\$ |>>> )")))
    punctuation = count_of(text_of(c), "{}[]();=<>")
    return (F.size(live) >= 3) & ((signs >= F.size(live) * 0.45) | (punctuation >= F.greatest(F.length(text_of(c)), F.lit(1)) * 0.08))


def toc_entries(line_array: Column) -> Column:
    """How many lines look like entries of a table of contents."""
    return F.size(F.filter(line_array, lambda x: squeeze(x).rlike(_u(fixed.TOC_ENTRY))))


#: :data:`fixed.SENTENCE_BOUNDARY` with the sign before it, so that a search goes from sign to sign.
_BOUNDARY = re.compile(rf"[。！？!?；;.\n](?:(?<=[。！？!?；;]){_JAVA_SPACE}*|(?<=\.){_JAVA_SPACE}+(?=[A-Z0-9])|(?<=\n)\n+)")


def _sentences(text: str | None) -> list[str | None]:
    if text is None or text == "":
        return [] if text == "" else [None]
    out, at = [], 0
    for m in _BOUNDARY.finditer(text):
        out.append(text[at : m.start() + 1].strip())
        at = m.end()
    return [x for x in (*out, text[at:].strip()) if x] or [text]


def split_sentences(c: Column) -> Column:
    """Sentences of a cleaned text; the text itself where none is found."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_sentences(x) for x in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(c)


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """The prefix and the first hex digits of SHA-256 over the parts, joined by a unit separator."""
    joined = F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, length))


def boilerplate_key(c: Column) -> Column:
    """What a line repeated over pages has in common: lower case, numbers as #, no spaces and dashes. Empty for blank
    lines and those of more than 120 visible characters."""
    c = text_of(c)
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\d+", "#"), r"(?U)\s+", ""), r"[-–—_/\\|·•]+", "")
    return F.when(visible_chars(c) > 120, F.lit("")).otherwise(key)


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(text_of(c), F.lit("|"), F.lit(r"\|")), F.lit("\n"), F.lit("<br>"))


def table_to_markdown(rows: Column) -> Column:
    """A Markdown table of an array of rows; short rows are filled up."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    filled = F.transform(rows, lambda r: F.transform(F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))), markdown_cell))
    body = F.transform(filled, line)
    ruled = F.concat(F.slice(body, 1, 1), F.array(line(F.array_repeat(F.lit("---"), width.cast("int")))), F.slice(body, 2, F.size(body)))
    return F.when(F.size(rows) == 0, F.lit("")).otherwise(F.array_join(ruled, "\n"))


def split_env_list(c: Column) -> Column:
    """Names of a comma-separated list, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text_of(c), ","), strip), lambda x: x != "")


def truncate(c: Column, most: int, mark: str = "\n...[truncated]") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def is_email(c: Column) -> Column:
    return F.contains(F.lower(strip(c)), F.lit("@"))


def prompt_field(c: Column, key: str) -> Column:
    """The rest of the line that starts with ``KEY:``."""
    return F.regexp_extract(c, rf"(?m)^{key}:\s*(.*)$", 1)


def word_set(c: Column) -> Column:
    """Distinct lower-case Latin words and single Chinese characters."""
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z0-9_]+"), F.lit(0)), F.regexp_extract_all(text_of(c), F.lit("[一-鿿]"), F.lit(0))))


def rewrite_query(c: Column) -> Column:
    """A spoken question as a search query: no fillers, 'how' questions as 'what is', one question mark."""
    for filler in fixed.FILLERS:
        c = F.replace(c, F.lit(filler))
    c = strip(c)
    topic = F.replace(F.regexp_replace(F.substring(c, 3, 1 << 30), "[？?]+$", ""), F.lit("报销保险费用"), F.lit("保险费用报销"))
    topic = F.when(topic.rlike("(?:报销|费用)$"), F.concat(topic, F.lit("流程"))).otherwise(topic)
    asked = F.when(c.rlike("^" + _any(fixed.HOW)), F.concat(topic, F.lit("是什么"))).otherwise(c)
    return F.concat(F.regexp_replace(asked, "[？?]+$", ""), F.lit("？"))


def source_prefix(file_name: Column, kind: str, path: Column, first: Column, last: Column) -> Column:
    """The lines in front of a chunk's body: file, kind, heading path and pages."""
    pages = F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))
    where = F.when(F.size(path) > 0, F.concat(F.lit(fixed.PREFIX_PATH), F.array_join(path, " > ")))
    return F.concat_ws("\n", F.concat(F.lit(fixed.PREFIX_FILE), file_name), F.lit(fixed.PREFIX_KIND + kind), where, F.concat(F.lit(fixed.PREFIX_PAGE), pages))
