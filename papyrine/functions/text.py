"""Cleaning and normalisation of text columns. Columns in, columns out; Python only where Spark has no built-in."""
from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions import patterns as P
from papyrine.functions import plain

#: Flags that give Java the meaning Python's ``re`` has: Unicode classes, and a dot that stops at \n only.
UNI, ICASE = "(?Ud)", "(?iuUd)"


def java(pattern: str) -> str:
    return pattern.replace("(?P<", "(?<")


def text_of(c: Column) -> Column:
    """Null is the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def squeeze(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), r"(?U)[\s\x1c-\x1f]+", " "))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"(?U)\D", "")


def crop(c: Column, most: int = 1200) -> Column:
    text = text_of(c)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n[...]"))).otherwise(text)


def preview(c: Column, size: int = 500) -> Column:
    return F.substring(text_of(c), 1, size)


# HTML and Markdown ---------------------------------------------------------------------------------


class _Visible(HTMLParser):
    """Text nodes outside script and style."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def visible_text(source: str) -> str:
    parser = _Visible()
    parser.feed(source)
    parser.close()
    return "\n".join(parser.parts)


class _Markdown(HTMLParser):
    """A small HTML to Markdown writer with ATX headings."""

    MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.lists, self.links, self.hidden, self.cells = [], [], [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.MARKS:
            self.out.append(self.MARKS[tag])
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "table"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "pre":
            self.out.append("\n\n```\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + ("* " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "tr":
            self.out.append("\n|")
        elif tag in ("td", "th"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.MARKS:
            self.out.append(self.MARKS[tag])
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" or tag in ("p", "div", "table"):
            self.out.append("\n\n")
        elif tag == "pre":
            self.out.append("\n```\n\n")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("td", "th"):
            self.out.append(" |")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def markdown_text(source: str) -> str:
    parser = _Markdown()
    parser.feed(source)
    parser.close()
    return "".join(parser.out)


@F.pandas_udf(T.StringType())
def _plain_of(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else _rendered(repair_text(s), visible_text))


@F.pandas_udf(T.StringType())
def _markdown_of(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else _rendered(repair_text(s), markdown_text))


def _rendered(text: str, render) -> str:
    return render(html.unescape(text)) if "<" in text or "&" in text else text


@F.pandas_udf(T.StringType())
def _nfkc(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(T.StringType())
def _key_of(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else fold_letters(repair_text(s).lower()))


def fold_letters(text: str) -> str:
    """ASCII for letters and signs of other scripts: by the fixed table, then the base letter; what has neither goes."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text.translate(_LETTERS)).translate(_LETTERS)
    return "".join(c for c in text if not unicodedata.combining(c)).encode("ascii", "ignore").decode()


_LETTERS = str.maketrans(P.LETTERS)
#: Characters that stand for one byte each in text that was decoded with the wrong code page.
_BYTE_OF = {bytes([b]).decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b): b for b in range(0x80, 0x100)} | {chr(b): b for b in range(0x80, 0xA0)}
_TAIL = "[" + "".join(re.escape(c) for c, b in _BYTE_OF.items() if 0x80 <= b < 0xC0) + "]"
#: Lead bytes of what such text usually holds: Latin letters and signs, punctuation, marks, pictures.
MOJIBAKE = f"[ÂÃÅ]{_TAIL}|[âïã]{_TAIL}{{2}}|ð{_TAIL}{{3}}"


def repair_encoding(text: str) -> str:
    """UTF-8 that was read as Windows-1252 or Latin-1, read anew; more than once where it happened more than once."""

    def read(match: re.Match) -> str:
        try:
            return bytes(_BYTE_OF[c] for c in match[0]).decode()
        except UnicodeDecodeError:
            return match[0]

    for _ in range(4):
        fixed = re.sub(MOJIBAKE, read, text)
        if fixed == text:
            break
        text = fixed
    return text


#: Full-width forms of the printable ASCII signs, by the rule that they lie in the same order, and the wide space.
_SIGNS = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {"\u3000": " "} | dict(zip(P.CURLY_QUOTES, P.STRAIGHT_QUOTES, strict=True)) | P.LIGATURES
_SIGN = re.compile("[" + "".join(map(re.escape, _SIGNS)) + "]")
_LINE_END = re.compile("\r\n?|[\u0085\u2028\u2029]")
_NO_TEXT = re.compile("\x1b\\[[0-9;]*[A-Za-z]|[\x00-\x08\x0b\x0e-\x1f\x7f\u206a-\u206f\ufeff\ufff9-\ufffc]")
#: A sign that plain text in Latin letters does not hold; leads of wrong code pages and the ampersand are among them.
#: Signs are listed one by one, not by ranges: so the matcher looks them up in a table.
_USUAL = [9, 10, *(i for i in (*range(0x20, 0x7F), *range(0xA1, 0x100)) if chr(i) not in "&ÂÃÅâãïð")]
UNUSUAL = "[^" + "".join(f"\\x{i:02x}" for i in _USUAL) + "]"


def repair_text(text: str) -> str:
    """Undo wrong code pages, entities (where no mark-up is), ligatures, curly quotes, wide forms, line ends, control signs."""
    if "&" in text and "<" not in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _SIGN.sub(lambda m: _SIGNS[m[0]], unicodedata.normalize("NFC", repair_encoding(text)))
        text = _LINE_END.sub("\n", text)
    elif "\r" in text:
        text = _LINE_END.sub("\n", text)
    return _NO_TEXT.sub("", text)


@F.pandas_udf(T.StringType())
def _repair(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else repair_text(s))


def fix_text(c: Column) -> Column:
    """``repair_text`` of the texts that hold an unusual sign; the others are as they should be and cost one look."""
    return _only_if(c.rlike(UNUSUAL), _repair, c)


def _only_if(test: Column, udf, c: Column) -> Column:
    """Send a text to Python only where the test holds; elsewhere the UDF gets a null."""
    return F.when(test, udf(F.when(test, c))).otherwise(c)


def _lines(c: Column) -> Column:
    lined = F.regexp_replace(F.translate(F.regexp_replace(c, "\r\n?", "\n"), "\t\u00a0", "  "), " {2,}", " ")
    lined = F.array_join(F.transform(F.split(lined, "\n"), strip), "\n")
    return strip(F.regexp_replace(lined, "\n{3,}", "\n\n"))


def clean_legal(c: Column, may_hold_html: bool = True) -> Column:
    """Conservative clean-up: repairs, entities, mark-up, line ends and spaces; words are never touched."""
    text = text_of(c)
    return _lines(_only_if(text.contains("<") | text.rlike(UNUSUAL), _plain_of, text) if may_hold_html else fix_text(text))


def html_to_markdown(c: Column) -> Column:
    text = text_of(c)
    text = _only_if(text.contains("<") | text.rlike(UNUSUAL), _markdown_of, text)
    return strip(F.regexp_replace(F.regexp_replace(text, " {2,}", " "), "\n{3,}", "\n\n"))


ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def search_key(c: Column) -> Column:
    """Lower case, no accents, single spaces: a column to search in."""
    text = text_of(c)
    low = F.translate(F.lower(text), ACCENTED, PLAIN)
    other = text.rlike(UNUSUAL) | low.rlike(r"[^\x00-\x7f]")
    return squeeze(F.when(other, _key_of(F.when(other, text))).otherwise(low))


def markdown_document(doc_id: Column, name: Column, kind: Column, text: Column) -> Column:
    a, b, c, d = P.MARKDOWN
    parts = (F.lit(a), text_of(doc_id), F.lit(b), text_of(name), F.lit(c), text_of(kind), F.lit(d), text_of(text))
    return F.concat(*parts)


# OCR clean-up --------------------------------------------------------------------------------------


def normalise_ocr(c: Column) -> Column:
    """Compatibility forms, odd spaces, quotes, dashes, control characters, spaces around punctuation; order matters."""
    text = text_of(c)
    text = _only_if(text.rlike(r"[^\x00-\x7fáéíóúüñÁÉÍÓÚÜÑ]"), _nfkc, text)
    same = P.SPACES + P.DOUBLE_QUOTES + P.SINGLE_QUOTES + P.DASHES + P.BULLETS
    into = " " * len(P.SPACES) + '"' * len(P.DOUBLE_QUOTES) + "'" * len(P.SINGLE_QUOTES) + "-" * (len(P.DASHES) + len(P.BULLETS))
    text = F.translate(text, same + P.DROPPED, into)
    text = F.translate(F.regexp_replace(text, "\r\n?", "\n"), "\t", " ")
    for pattern, new in (
        (r"[\p{C}&&[^\n]]", " "),
        (r"[ ]+", " "),
        (r" *\n *", "\n"),
        (r"(?U)([,.;:!?])\s*(?:[,.;:!?]){2,}", "$1"),
        (r"(?U)\s+([,.;:!?])", "$1"),
        (r"(?U)([({\[])\s+", "$1"),
        (r"(?U)\s+([)}\]])", "$1"),
        (r"\n{4,}", "\n\n\n"),
    ):
        text = F.regexp_replace(text, pattern, new)
    return strip(text)


def fix_terms(c: Column) -> Column:
    return F.coalesce(plain.fixed_of(c), fixed_columns(c))


def fixed_columns(c: Column) -> Column:
    for pattern, new, any_case in P.TERM_FIXES:
        c = F.regexp_replace(c, (ICASE if any_case else UNI) + pattern, new)
    return c


def legal_terms_pattern() -> str:
    return r"\b(?:" + "|".join(sorted(P.LEGAL_TERMS, key=len, reverse=True)) + r")\b"


def important_line_pattern() -> str:
    return ICASE + "(?:" + legal_terms_pattern() + "|" + "|".join(f"(?:{p})" for p in P.IMPORTANT.values()) + ")"


def is_important(line: Column) -> Column:
    return (strip(line) != "") & line.rlike(important_line_pattern())


def is_garbage(line: Column) -> Column:
    """Lines of noise; ``line`` is known not to be important."""
    text = strip(line)
    size, no_digit = F.length(text), ~text.rlike(r"(?U)\d")
    signs = F.length(F.regexp_replace(text, r"[\p{L}\p{N}]|(?U:\s)", ""))
    return (text != "") & (
        text.rlike(r"(?U)^[|!¡¿?\-_=~*#.:;,/\\\s]{3,}$")
        | text.rlike(r"(?U)^(?:[|Il1]\s*){4,}$")
        | text.rlike(r"(?U)^(?:[_\-~=.]{2,}\s*)+$")
        | ((size <= 2) & no_digit)
        | ((size <= 5) & text.rlike(rf"^[^{P.LATIN}0-9]*[{P.LATIN}]?[^{P.LATIN}0-9]*$"))
        | ((size >= 8) & (signs / size > 0.75))
        | (text.rlike(r"(?d)(.)\1{8,}") & ~text.rlike(r"(?U)\d{6,}"))
    )


def clean_line(line: Column, important: Column) -> Column:
    kept = F.regexp_replace(strip(F.regexp_replace(line, "[ ]{2,}", " ")), r"(?U)\s+([,.;:])", "$1")
    other = line
    for pattern, new in ((r"(?U)(?:\|\s*){3,}", " "), (r"[_~]{3,}", " "), (r"-{4,}", " -- "), (r"\.{5,}", " ... "), (r"(?d)(.)\1{5,}", "$1$1$1"), (r"[ ]{2,}", " ")):
        other = F.regexp_replace(other, pattern, new)
    return F.when(important, kept).otherwise(strip(other))


def clean_ocr(c: Column) -> Column:
    """Whole OCR clean-up: normalise, fix terms, clean each line, drop noise lines, squeeze blank runs."""
    return F.coalesce(plain.clean_of(text_of(c)), clean_columns(c))


def clean_columns(c: Column) -> Column:
    """The clean-up of any text, for those that ``plain`` leaves."""
    lines = F.split(fixed_columns(normalise_ocr(c)), "\n")
    # Whether a line matters is worked out before cleaning, and after it only for lines that it changed.
    lines = F.transform(lines, lambda x: F.struct(x.alias("t"), is_important(x).alias("i")))
    lines = F.transform(lines, lambda x: F.struct(clean_line(x["t"], x["i"]).alias("t"), x["t"].alias("old"), x["i"].alias("i")))
    kept = lambda x: F.when(x["t"] == x["old"], x["i"]).otherwise(is_important(x["t"])) | ~is_garbage(x["t"])
    lines = F.transform(F.filter(lines, kept), lambda x: x["t"])
    text = F.regexp_replace(F.array_join(lines, "\n"), r"\n(?:[ ]*\n){2,}", "\n\n")
    return strip(F.regexp_replace(text, "[ ]{2,}", " "))


def mask(c: Column, size: int = 300) -> Column:
    """The first ``size`` characters with identifiers masked (cut first, as a mask may need more text)."""
    text = F.substring(text_of(c), 1, size)
    for pattern, new in P.MASKS:
        text = F.regexp_replace(text, UNI + pattern, F.lit(new.replace("$", r"\$")))
    return F.replace(text, F.lit("\n"), F.lit(" "))


def money_ar(c: Column) -> Column:
    """es-AR amounts to double: with both signs the dot groups; a lone dot groups before exactly 3 digits or if repeated."""
    text = F.replace(text_of(c), F.lit("$"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, ICASE + r"\bARS\b", ""), ICASE + r"\bpesos?\b", "")
    text = F.regexp_replace(text, r"[^0-9,.]", "")
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    plain, point = F.replace(text, F.lit("."), F.lit("")), F.translate(text, ",", ".")
    grouped = (dots > 1) | text.rlike(r"\.\d{3}$")
    both = F.translate(plain, ",", ".")
    picked = F.when(text.contains(",") & (dots > 0), both).when(text.contains(","), point).when((dots > 0) & grouped, plain).otherwise(text)
    return F.when(picked.rlike(r"^(\d+\.?\d*|\.\d+)$"), picked.try_cast("double"))


def person_name(c: Column) -> Column:
    name = F.regexp_replace(strip(text_of(c)), r"(?U)\s+", " ")
    name = F.regexp_replace(F.regexp_replace(name, ICASE + P.NAME_TITLES, ""), ICASE + P.NAME_OFFICES, "")
    return F.btrim(name, F.lit(" .,:;-_"))


def entity_text(label: Column, value: Column) -> Column:
    return F.concat_ws(" ", label, squeeze(value))


def model_slug(c: Column) -> Column:
    return F.translate(F.replace(c, F.lit("/"), F.lit("__")), "-.", "__")


def context(text: Column, begin: Column, end: Column, window: int = 180) -> Column:
    """Characters around [begin, end); without a span the first 500."""
    low = F.greatest(begin - window, F.lit(0))
    cut = F.substring(text, low + 1, F.least(F.length(text), end + window) - low)
    return F.when(text.isNull(), "").when(begin.isNull() | end.isNull(), F.substring(text, 1, 500)).otherwise(cut)


@F.pandas_udf(T.StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Unified diff of the first 3000 characters, 80 lines at most (a report column)."""
    import difflib

    def crop3000(s):
        s = s or ""
        return s if len(s) <= 3000 else s[:3000] + "\n[...]"

    def diff(a, b):
        lines = list(difflib.unified_diff(crop3000(a).splitlines(), crop3000(b).splitlines(), fromfile="antes", tofile="despues", lineterm=""))
        return "\n".join(lines[:80] + (["[...] diff truncado"] if len(lines) > 80 else []))

    return pd.Series([diff(a, b) for a, b in zip(before, after, strict=True)])
