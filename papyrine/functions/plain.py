"""OCR clean-up, metrics and important data of plain texts, one text at a time.

They say what the columns of ``text`` and ``metrics`` say, and those stay for all other texts: a function here gives
None for a text that is not plain. Plain is ASCII but for the separators \\x1c to \\x1f, and the letters of Spanish;
there the patterns mean the same in Python and Java, and a character is a byte of Latin-1. What saves time is that a
pattern is tried only where a text holds what the matches of the pattern begin with.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.functions import patterns as P

_ALL = bytes(range(256))
_SPANISH = "áéíóúüñÁÉÍÓÚÜÑ"
_PLAIN = bytes(i for i in range(128) if not 0x1C <= i <= 0x1F) + _SPANISH.encode("latin-1")
_LETTERS = bytes(i for i in _PLAIN if chr(i).isalpha())
_DIGITS, _SPACES = b"0123456789", b"\t\n\x0b\x0c\r "


def _but(kept: bytes) -> bytes:
    return bytes(i for i in _ALL if i not in kept)


def _table(rules: dict[str, bytes], other: str | None = None) -> bytes:
    """A table for ``bytes.translate``: each sign of a class becomes the class; the rest stays or becomes ``other``."""
    out = bytearray(_ALL if other is None else other.encode() * 256)
    for new, signs in rules.items():
        for i in signs:
            out[i] = ord(new)
    return bytes(out)


_LOWER = bytes(ord(chr(i).lower()) if i in _LETTERS else i for i in range(256))
_NO_CONTROL = _table({" ": bytes(i for i in (*range(0x20), 0x7F) if i != 10)})
_SHAPE = _table({".": b",.;:!?", "(": b"({[", ")": b")}]", " ": _SPACES}, "a")
_WORDS = _table({"a": _LETTERS, "0": _DIGITS + b"_"}, " ")
_WORD_SIGNS = bytes(i if i in _LETTERS + _DIGITS + b"_" else 32 for i in range(256))
_ONLY_LETTERS = _table({"a": _LETTERS}, " ")
_NO_LETTERS, _NO_DIGITS = _but(_LETTERS), _but(_DIGITS)
_USUAL = _LETTERS + _DIGITS + _SPACES + bytes(range(0x1C, 0x20)) + P.ALLOWED_SIGNS.encode("latin-1")
_SHOWN = _but(bytes(i for i in (*range(0x20), 0x7F) if i not in b"\n\r\t"))
_ALNUM_OR_SPACE = _LETTERS + _DIGITS + _SPACES

_TERMS = frozenset(t.encode("latin-1") for t in P.LEGAL_TERMS if " " not in t)
_LONG_TERMS = [(t, re.compile(rf"\b{t}\b")) for t in P.LEGAL_TERMS if " " in t]
#: What a match of an important pattern begins with, in lower case, if it is not a number (see ``_numbers``).
_HEADS = {
    "dni": ("dni", "d.n.i", "documento"),
    "cuil_cuit": ("cuil", "cuit", "c.u.i.l", "c.u.i.t"),
    "cbu_cvu": ("cbu", "cvu"),
    "expediente": ("expediente", "expte", "autos", "causa"),
    "monto": ("$", "pesos", "ars", "usd"),
    "fecha": (),
    "alias": ("alias",),
    "banco": ("banc", "macro", "naci", "galicia", "santander", "bbva", "supervielle", "credicoop", "brubank", "mercado"),
    "caratula": ("caratula", "carátula", "autos"),
    "juzgado_secretaria": ("juzgado", "secretar", "tribunal", "camara", "cámara"),
}
#: Kind, heads, the first three signs of the words that they begin (None: they may be within words), matcher.
_IMPORTANT = [
    (k, _HEADS[k], None if k == "monto" else frozenset(re.match(r"\w{1,3}", h)[0].encode("latin-1") for h in _HEADS[k]), re.compile(p, re.IGNORECASE).match)
    for k, p in P.IMPORTANT.items()
]
_digits = re.compile("[0-9]+").finditer
#: Per fix of a term: a string that a match holds, the pattern without its \b at the front, the new text.
_FIXES = [(needle, re.compile(p.removeprefix(r"\b")).finditer, new) for needle, (p, new, _) in zip(
    ("exped", "expediente", "car", "caratula", "embarg", "demandant", "juzgad", "secretar", "aut", "banc", "cuent", "transferenc", "c", "c", "c", "c", "d", "nt", "pes", "sentenc", "med"),
    P.TERM_FIXES[1:], strict=True)]
_FIRST_FIX, _FIRST_NEW = re.compile(P.TERM_FIXES[0][0]).match, P.TERM_FIXES[0][1]


def plain_bytes(text: str) -> bytes | None:
    """A plain text as Latin-1, None for another one."""
    try:
        b = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if b.translate(None, _PLAIN) else b


def _low(text: str) -> str:
    return text.encode("latin-1").translate(_LOWER).decode("latin-1")


def lower_if_plain(text: str) -> str | None:
    b = plain_bytes(text)
    return None if b is None else b.translate(_LOWER).decode("latin-1")


def _words(b: bytes) -> tuple[bytes, list[bytes]]:
    """A text in lower case, and its words."""
    low = b.translate(_LOWER)
    return low, low.translate(_WORD_SIGNS).split()


def _places(low: str, needle: str) -> Iterator[int]:
    at = low.find(needle)
    while at >= 0:
        yield at
        at = low.find(needle, at + 1)


def matches(find: re.Pattern, text: str, low: str, heads: tuple[str, ...]) -> Iterator[re.Match]:
    """As ``finditer`` over a plain text, for a pattern whose matches begin with one of ``heads``."""
    end = 0
    for at in sorted(at for head in heads if head in low for at in _places(low, head)):
        if at >= end and (m := find.match(text, at)):
            yield m
            end = m.end()


def matches_before(find: re.Pattern, text: str, low: str, tails: tuple[str, ...], inner: str) -> Iterator[re.Match]:
    """As ``finditer`` over a plain text, for a pattern whose matches end with one of ``tails`` and have only signs of ``inner`` before it."""
    end = 0
    for at in sorted(at for tail in tails if tail in low for at in _places(low, tail)):
        for begin in range(end + len(text[end:at].rstrip(inner)), at):
            if m := find.match(text, begin):
                yield m
                end = m.end()
                break


def _numbers(text: str) -> dict[str, list[int]]:
    """Where numbers begin that an important pattern can begin with: by their length and the sign behind them."""
    dni, tax, money, date = [], [], [], []
    for m in _digits(text):
        b, e = m.span()
        n = e - b
        if n > 3:
            if n in (7, 8):
                dni.append(b)
            elif n in (10, 11):
                tax.append(b)
            continue
        sign = text[e : e + 1]
        if sign == ".":
            money.append(b)
        if n < 3 and (sign in ("/", "-") or sign.isspace()):
            date.append(b)
            if n == 2 and sign != "/":
                tax.append(b)
    return {"dni": dni, "cuil_cuit": tax, "monto": money, "fecha": date}


def _candidates(text: str, low: str, words: list[bytes]) -> Iterator[tuple[int, Callable, list[int]]]:
    """(number of the important pattern, its matcher, where it may match) of those that may match at all."""
    keys = {w[:3] for w in words}
    numbers = _numbers(text) if _digit(text) else {}
    for i, (kind, heads, first, match) in enumerate(_IMPORTANT):
        places = [at for head in heads if head in low for at in _places(low, head)] if first is None or not first.isdisjoint(keys) else []
        if found := numbers.get(kind):
            places += found
        if places:
            places.sort()
            yield i, match, places


def important_counts(text: str, low: str, words: list[bytes]) -> list[int]:
    """The matches of each important pattern, as a search from left to right finds them."""
    out = [0] * len(_IMPORTANT)
    for i, match, places in _candidates(text, low, words):
        end = 0
        for at in places:
            if at >= end and (m := match(text, at)):
                out[i] += 1
                end = m.end()
    return out


def has_important(text: str, low: str, words: list[bytes]) -> list[bool]:
    out = [False] * len(_IMPORTANT)
    for i, match, places in _candidates(text, low, words):
        out[i] = any(match(text, at) for at in places)
    return out


def _is_important(line: str, low: str) -> bool:
    words = low.encode("latin-1").translate(_WORD_SIGNS).split()
    if not _TERMS.isdisjoint(words) or any(t in low and p.search(low) for t, p in _LONG_TERMS):
        return True
    return any(match(line, at) for _, match, places in _candidates(line, low, words) for at in places)


_sub = {p: re.compile(p).sub for p in (
    r"([,.;:!?])\s*(?:[,.;:!?]){2,}", r"\s+([,.;:!?])", r"([({\[])\s+", r"\s+([)}\]])", r"\n{4,}", r"\s+([,.;:])",
    r"(?:\|\s*){3,}", r"[_~]{3,}", r"-{4,}", r"\.{5,}", r"(.)\1{5,}", r"\n(?:[ ]*\n){2,}",
)}
_NOISE = [re.compile(p) for p in (r"^[|!¡¿?\-_=~*#.:;,/\\\s]{3,}$", r"^(?:[|Il1]\s*){4,}$", r"^(?:[_\-~=.]{2,}\s*)+$")]
_digit, _one_letter, _long_run, _long_number = (re.compile(p).search for p in ("[0-9]", rf"^[^{P.LATIN}0-9]*[{P.LATIN}]?[^{P.LATIN}0-9]*$", r"(.)\1{8,}", "[0-9]{6,}"))


def _squeezed(text: str) -> str:
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def _normalised(text: str, b: bytes) -> str:
    if b"\r" in b:
        b = b.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    text = _squeezed(b.translate(_NO_CONTROL).decode("latin-1")).replace(" \n", "\n").replace("\n ", "\n")
    for shape, pattern, new in ((b"..", r"([,.;:!?])\s*(?:[,.;:!?]){2,}", r"\1"), (b" .", r"\s+([,.;:!?])", r"\1"), (b"( ", r"([({\[])\s+", r"\1"), (b" )", r"\s+([)}\]])", r"\1")):
        if shape in text.encode("latin-1").translate(_SHAPE):
            text = _sub[pattern](new, text)
    return (_sub[r"\n{4,}"]("\n\n\n", text) if "\n\n\n\n" in text else text).strip()


def _joined(text: str, spans: list[tuple[int, int]], new: str) -> str:
    parts, last = [], 0
    for b, e in spans:
        parts += [text[last:b], new]
        last = e
    return "".join([*parts, text[last:]])


def _inside(text: str, at: int) -> bool:
    """Whether the character before is one of a word."""
    return at > 0 and ((c := text[at - 1]).isalnum() or c == "_")


def _fixed(text: str) -> str:
    if "xp" in text:
        spans, end = [], 0
        for at in _places(text, "xp"):
            if at > end and (m := _FIRST_FIX(text, at - 1)):
                spans.append(m.span())
                end = m.end()
        text = _joined(text, spans, _FIRST_NEW)
    low = _low(text)
    for needle, find, new in _FIXES:
        if needle in low and (spans := [m.span() for m in find(low) if text[m.start() : m.end()] != new and not _inside(low, m.start())]):
            text = _joined(text, spans, new)
            low = _joined(low, spans, _low(new))
    return text


def fix_terms(text: str) -> str | None:
    return None if plain_bytes(text) is None else _fixed(text)


def _clean_line(line: str, important: bool) -> str:
    line = _squeezed(line) if important else line
    if important:
        line = line.strip()
        return _sub[r"\s+([,.;:])"](r"\1", line) if " ," in line or " ." in line or " ;" in line or " :" in line else line
    if line.count("|") > 2:
        line = _sub[r"(?:\|\s*){3,}"](" ", line)
    for pattern, new in ((r"[_~]{3,}", " "), (r"-{4,}", " -- "), (r"\.{5,}", " ... "), (r"(.)\1{5,}", r"\1\1\1")):
        line = _sub[pattern](new, line)
    return _squeezed(line).strip()


def _is_garbage(line: str) -> bool:
    text = line.strip()
    size = len(text)
    return size > 0 and bool(
        any(p.search(text) for p in _NOISE)
        or (size <= 2 and not _digit(text))
        or (size <= 5 and _one_letter(text))
        or (size >= 8 and len(text.encode("latin-1").translate(None, _ALNUM_OR_SPACE)) / size > 0.75)
        or (_long_run(text) and not _long_number(text))
    )


def _cleaned(text: str, b: bytes) -> str:
    text = _fixed(_normalised(text, b))
    kept = []
    for line, low in zip(text.split("\n"), _low(text).split("\n"), strict=True):
        important = _is_important(line, low)
        new = _clean_line(line, important)
        if (important if new == line else _is_important(new, _low(new))) or not _is_garbage(new):
            kept.append(new)
    text = "\n".join(kept)
    if "\n\n\n" in text or "\n " in text:
        text = _sub[r"\n(?:[ ]*\n){2,}"]("\n\n", text)
    return _squeezed(text).strip()


def clean_ocr(text: str) -> str | None:
    b = plain_bytes(text)
    return None if b is None else _cleaned(text, b)


_weird = re.compile(r"(?:\d+[/-]\d+|[A-Za-z]{1,4}\d+|\d+[A-Za-z]{1,4})").fullmatch
_latin, _latin_or_digit = re.compile(f"[{P.LATIN}]").search, re.compile(f"[{P.LATIN}0-9]").search
_same_five = re.compile(r"(.)\1{4,}").search
#: Whole numbers behind the fifteen metrics, without important data.
COUNTS = ["len_chars", "len_words", "alpha", "digits", "rare", "hidden", "line_breaks", "one_letter_words", "weird_alnum_tokens", "repeated_char_tokens", "near_empty_lines", "symbol_only_lines", "legal_terms_count", "normal_words"]


def _same_in_row(b: bytes) -> bool:
    """Whether five equal bytes follow each other: four zeros where the text and itself one byte on differ by nothing."""
    n = int.from_bytes(b)
    return b"\0\0\0\0" in (n ^ (n >> 8)).to_bytes(len(b))[1:]


def counts(text: str, b: bytes, low: bytes, words: list[bytes]) -> list[int]:
    shape, letters = b.translate(_WORDS), b.translate(_ONLY_LETTERS)
    runs = letters.split()
    alone = b" " + letters.replace(b" ", b"  ") + b" "
    terms = sum(map(_TERMS.__contains__, words))
    for t, p in _LONG_TERMS:
        if t.encode("latin-1") in low:
            terms += len(p.findall(low.decode("latin-1")))
    tokens = text.split()
    mixed = [t for t in tokens if not t.isalpha() and _digit(t) and _latin(t)]
    lines = [x for line in text.splitlines() if (x := line.strip())]
    return [
        len(text),
        len(words),
        len(b.translate(None, _NO_LETTERS)),
        len(b.translate(None, _NO_DIGITS)),
        len(b.translate(None, _USUAL)),
        len(b.translate(None, _SHOWN)),
        b.count(b"\n"),
        (b" " + shape.replace(b" ", b"  ") + b" ").count(b" a "),
        sum(not _weird(t) for t in mixed),
        sum(bool(_same_five(t)) for t in tokens) if _same_in_row(b) else 0,
        sum(len(x) < 3 for x in lines),
        sum(not _latin_or_digit(x) for x in lines),
        terms,
        len(runs) - alone.count(b" a "),
    ]


def measured(text: str) -> list[int] | None:
    """``COUNTS`` and the sum of the important data."""
    b = plain_bytes(text)
    if b is None:
        return None
    low, words = _words(b)
    return [*counts(text, b, low, words), sum(important_counts(text, low.decode("latin-1"), words))]


def checked(text: str) -> list | None:
    """The cleaned text, words before and after, important data before, its counts after, ``COUNTS`` of the cleaned text."""
    b = plain_bytes(text)
    if b is None:
        return None
    new = _cleaned(text, b)
    low_before, before = _words(b)
    low, after = _words(limpio := new.encode("latin-1"))
    return [new, len(before), len(after), *has_important(text, low_before.decode("latin-1"), before), *important_counts(new, low.decode("latin-1"), after), *counts(new, limpio, low, after)]


#: What a match of an audit pattern begins with, and how long a number is that it may begin with.
_AUDIT = [
    (k, heads, lengths, re.compile(P.AUDIT[k], re.IGNORECASE).match)
    for k, heads, lengths in (
        ("dni", ("dni", "d.n.i.", "documento", "doc"), range(7, 9)),
        ("cuil_cuit", ("cuil", "cuit", "c.u.i.l.", "c.u.i.t."), (2, 10, 11)),
        ("cbu_cvu", ("cbu", "cvu"), range(1, 23)),
        ("monto", ("$", "pesos", "importe", "monto"), ()),
        ("expediente", ("expediente", "expte", "exp.", "nro", "numero"), ()),
    )
]


def audited(text: str) -> list[bool] | None:
    """Whether each audit pattern matches."""
    b = plain_bytes(text)
    if b is None:
        return None
    low, numbers = b.translate(_LOWER).decode("latin-1"), [m.span() for m in _digits(text)]
    return [
        any(match(text, at) for head in heads if head in low for at in _places(low, head)) or any(e - b in lengths and match(text, b) for b, e in numbers)
        for _, heads, lengths, match in _AUDIT
    ]


# As columns ----------------------------------------------------------------------------------------


def _struct(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


MEASURED = _struct(dict.fromkeys([*COUNTS, "important_data_count"], T.IntegerType()))
CHECKED = _struct(
    {"texto": T.StringType(), "palabras_antes": T.IntegerType(), "palabras_despues": T.IntegerType()}
    | {f"antes_{k}": T.BooleanType() for k in P.IMPORTANT}
    | {f"n_{k}": T.IntegerType() for k in P.IMPORTANT}
    | dict.fromkeys(COUNTS, T.IntegerType())
)


def _udf(schema: T.StructType, find: Callable[[str], list | None]) -> Callable[[Column], Column]:
    """A column of structs by a function of a text; null where it gives None."""

    @F.arrow_udf(schema)
    def run(texts: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        rows = [None if t is None else find(t) for t in texts.to_pylist()]
        none = [None] * len(schema.fields)
        columns = zip(*(none if r is None else r for r in rows), strict=True)
        kinds = list(to_arrow_type(schema))
        arrays = [pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)] if rows else [pa.array([], k.type) for k in kinds]
        return pa.StructArray.from_arrays(arrays, fields=kinds, mask=pa.array([r is None for r in rows], pa.bool_()))

    return run


measure_of = _udf(MEASURED, measured)
check_of = _udf(CHECKED, checked)
audit_of = _udf(_struct({k: T.BooleanType() for k, *_ in _AUDIT}), audited)


@F.arrow_udf(T.StringType())
def clean_of(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else clean_ocr(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def fixed_of(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else fix_terms(t) for t in texts.to_pylist()], pa.string())
