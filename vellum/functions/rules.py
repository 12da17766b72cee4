"""The text rules on plain strings, for the folds that run in Python inside a group (see ``text`` for the expressions)."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import cache

from vellum.functions import fixed


@cache
def rx(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, flags)


def _words(names: list[str]) -> str:
    return "(?:" + "|".join(names) + ")"


IGNORE = re.IGNORECASE


def composed(s: str | None) -> str:
    """The text after compatibility composition, without invisible characters."""
    s = s or ""
    if s.isascii():
        return s
    s = unicodedata.normalize("NFKC", s)
    for ch in fixed.INVISIBLE:
        s = s.replace(ch, "")
    return s


def inline(s: str | None) -> str:
    s = composed(s)
    if "  " in s or any(ch in s for ch in "\t\v\f\r"):  # far faster than the pattern, which most lines do not need
        s = rx(r"[\t\v\f\r ]+").sub(" ", s)
    return s.strip()


def code_line(s: str | None) -> str:
    return composed(s).replace("\t", "    ").rstrip()


def visible(s: str | None) -> int:
    return len("".join((s or "").split()))


def cjk(s: str) -> bool:
    return bool(rx(fixed.CJK).search(s))


def list_line(s: str) -> bool:
    return bool(rx(fixed.LIST_ITEM).match(s.strip()))


def opens_paragraph(s: str) -> bool:
    return bool(rx(_words(fixed.PARAGRAPH_OPENERS)).match(inline(s)))


def ends_sentence(s: str) -> bool:
    return s.strip()[-1:] != "" and s.strip()[-1] in "。！？!?；;"


def counting(s: str) -> bool:
    """Numbers that go up by one."""
    if not rx(fixed.NUMBER_RUN).fullmatch(s):
        return False
    n = [int(x) for x in s.split()]
    return n == list(range(n[0], n[0] + len(n)))


def noise(s: str) -> bool:
    s = inline(s)
    return not s or counting(s) or any(rx(p, IGNORE).fullmatch(s) for p in (fixed.BULLETS, fixed.UI_LABEL, fixed.NUMBER_STRIP))


def clean(s: str | None) -> str:
    return "\n".join(x for x in map(inline, (s or "").splitlines()) if not noise(x)).strip()


def like_sentence(s: str) -> bool:
    s = inline(s)
    size = visible(s)
    tail = re.split("[：:]", s, maxsplit=1)
    signs = (
        s[-1:] in tuple("。！？!?；;，,"), s.count("，") + s.count(",") >= 2, len(tail) > 1 and visible(tail[1]) >= 12,
        size > 36 and bool(rx(_words(fixed.EXPLANATORY)).search(s)), size > 52,
    )
    return bool(s) and any(signs)


def continues(s: str) -> bool:
    s = inline(s)
    if not s or list_line(s):
        return False
    return bool(rx(_words(fixed.CONTINUATIONS)).match(s) or rx(fixed.LATIN_CONTINUATION).match(s)) or cjk(s[0])


def _halves(left: str, right: str) -> tuple[str, str] | None:
    """Up to four Chinese characters on either side of a break."""
    a, b = rx(f"{fixed.CJK_WIDE}{{1,4}}$").search(left), rx(f"{fixed.CJK_WIDE}{{1,4}}").match(right)
    return (a[0], b[0]) if a and b else None


#: Chinese characters of a short tail before a break, and of a short head behind it, at most.
SHORT_TAIL, SHORT_HEAD = 3, 2


def breaks_word(left: str, right: str) -> bool:
    """Whether a layout probably cut a Chinese word in two: a short tail or a short head, with nothing ending or starting
    at the break."""
    left, right = inline(left), inline(right)
    found = _halves(left, right)
    if not found or len(found[0]) > SHORT_TAIL and len(found[1]) > SHORT_HEAD:
        return False
    return not (ends_sentence(left) or list_line(right) or opens_paragraph(right))


def mend_blank_lines(s: str) -> str:
    """Paragraph breaks inside known broken words are closed."""
    out: list[str] = []
    for part in filter(None, map(str.strip, re.split(r"\n{2,}", s or ""))):
        left = out[-1] if out else ""
        open_end = left and not ends_sentence(left) and left[-1] not in "：:，,"
        found = _halves(left, part) if open_end and not list_line(part) and not opens_paragraph(part) else None
        if found and (found[0] in fixed.BROKEN_TAILS or found[1][0] in fixed.BROKEN_HEADS):
            out[-1] += part
        else:
            out.append(part)
    return "\n\n".join(out)


def join(left: str, right: str) -> str:
    """Two pieces of text as one: the first rule that holds gives what stands between them."""
    left, right = clean(left).rstrip(), clean(right).lstrip()
    if not left or not right:
        return left or right
    if left[-1] == "-" and rx("[a-z]").match(right):
        return left[:-1] + right
    opener = opens_paragraph(right)
    between = (
        (ends_sentence(left), "\n"), (list_line(right), "\n"), (opener and any(map(list_line, left.splitlines())), "\n\n"), (breaks_word(left, right), ""),
        (opener, "\n\n"), (cjk(left[-8:]) or cjk(right[:8]), ""), (True, " "),
    )
    return left + next(gap for holds, gap in between if holds) + right


def join_lines(lines: list[str]) -> str:
    """Lines of one layout block as text: hyphens closed, sentences and items on lines of their own."""
    out = ""
    for line in filter(lambda x: not noise(x), map(inline, lines)):
        tail = out.rstrip()
        if not out:
            out = line
        elif list_line(line) or (tail[-1:] and tail[-1] in "。！？!?；;：:"):
            out += "\n" + line
        elif tail[-1:] == "-" and rx("[a-z]").match(line):
            out = tail[:-1] + line
        else:
            out += ("" if cjk(tail[-8:]) or cjk(line[:8]) else " ") + line
    return clean(out)


def tokens(s: str | None) -> int:
    wide = len(rx(fixed.TOKEN_CHARS).findall(s or ""))
    return wide + math.ceil((visible(s) - wide) / 4)


def sentences(s: str) -> list[str]:
    s = clean(s)
    return [x for x in map(str.strip, rx(fixed.SENTENCE_BOUNDARY).split(s)) if x] or ([s] if s else [])


def hard_split(s: str, most: int) -> list[str]:
    """Pieces of up to ``most`` tokens, cut behind a full stop, semicolon, newline or space in a piece's second half. A
    piece that is denser than the whole and so too large is cut again; pieces of 40 characters stay."""
    n = tokens(s)
    if n <= most:
        return [s] if s else []
    step, out, at = max(40, int(len(s) * most / max(n, 1))), [], 0
    while at < len(s):
        end = min(at + step, len(s))
        if end < len(s):
            back = max(s.rfind(mark, at, end) for mark in "。；\n ")
            end = back + 1 if back > at + step // 2 else end
        out.append(s[at:end].strip())
        at = end
    return [q for x in out if x for q in (hard_split(x, most) if len(x) > 40 and tokens(x) > most else [x])]


def markdown(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda cells: "| " + " | ".join(cells) + " |"
    body = [line([clean(x).replace("|", r"\|").replace("\n", "<br>") for x in [*r, *[""] * (width - len(r))]]) for r in rows]
    return "\n".join([body[0], line(["---"] * width), *body[1:]])


def code_like(lines: list[str], markers: int = 2) -> bool:
    live = [x for x in map(code_line, lines) if x.strip()]
    marked = sum(bool(rx(fixed.CODE_LINE, IGNORE).match(x.strip())) for x in live)
    pointed = sum(bool(rx(fixed.CODE_PUNCTUATION).search(x)) for x in live)
    return bool(live) and (marked >= markers or (marked >= 1 and pointed >= 2))


def prefix(file_name: str, kind: str, path: list[str], first: int, last: int) -> str:
    out = [fixed.PREFIX_FILE + file_name, fixed.PREFIX_KIND + kind]
    if path:
        out.append(fixed.PREFIX_PATH + " > ".join(path))
    out.append(fixed.PREFIX_PAGE + (str(first) if first == last else f"{first}-{last}"))
    return "\n".join(out)
