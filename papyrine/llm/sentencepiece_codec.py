"""SentencePiece BPE encoding and decoding by backtracking over Aho-Corasick longest matches.

A sequence of pieces is the BPE encoding of a text exactly when every piece re-merges to itself
and every adjacent pair, merged from single characters, ends as that same pair. The encoder walks
the text with the longest piece first, checks the pair with the previous piece by re-merging it
(memoised), takes the next shorter piece when the check fails, and steps back when none is left. A
bit per position records that nothing valid continues from there, so no position is tried twice.

Defined results: null and empty texts encode to the end id alone; texts without white space and of
any length are encoded whole; repeated rows and extra columns do not matter (rows are independent).
"""
from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from papyrine.llm.common import append_columns

SPACE = "▁"
#: Words remembered per Python worker unless told otherwise, and pairs of pieces (bounds memory, about 330
#: bytes a word, not results).
CACHE_WORDS = 400_000
CACHE_LONGEST = 64
CACHE_PAIRS = 300_000
SYMBOL_BITS = 22
SYMBOL_MASK = (1 << SYMBOL_BITS) - 1
OUTSIDE = 1 << 21


def _fields(buf: bytes):
    """(number, value) of each field of a protocol-buffer message; varints as int, others as bytes."""
    at, n = 0, len(buf)

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = buf[at]
            value |= (byte & 127) << shift
            at += 1
            if byte < 128:
                return value, at
            shift += 7

    while at < n:
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            value, at = buf[at : at + size], at + size
        yield key >> 3, value


@dataclass
class PieceModel:
    """What encoding and decoding need of a model file; plain data, sent to the executors by broadcast."""

    pieces: list[str]
    scores: list[float]
    byte_ids: dict[int, int]
    silent: set[int]
    eos: int
    unk: int
    dummy_prefix: bool
    reachable: list[int] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        kinds = {"unused": sp.is_unused, "control": sp.is_control, "byte": sp.is_byte, "unknown": sp.is_unknown}
        ids = range(sp.get_piece_size())
        top = list(_fields(raw))
        trainer, rules = (dict(_fields(next((v for k, v in top if k == n), b""))) for n in (2, 3))
        if trainer.get(3, 1) != 2 or rules.get(2, b"") or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only BPE models with identity normalisation are supported")
        declared = [dict(_fields(v)).get(3, 1) for k, v in top if k == 1]
        if any(kind in (4, 5) for kind in declared):
            raise ValueError("user-defined and unused pieces are not supported")
        model = cls(
            [sp.id_to_piece(i) for i in ids],
            [sp.get_score(i) for i in ids],
            {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if kinds["byte"](i)},
            {i for i in ids if kinds["control"](i) or kinds["unknown"](i)},
            sp.eos_id(),
            sp.unk_id(),
            bool(rules.get(3, 1)),
        )
        plain = [i for i in ids if i not in model.silent and not kinds["byte"](i)]
        merger = Merger(model, plain)
        model.reachable = [i for i in plain if merger.merge(model.pieces[i]) == [model.pieces[i]]]
        return model


class Merger:
    """The plain definition: merge the best-scoring adjacent pair, leftmost of equals, until none is a piece."""

    def __init__(self, model: PieceModel, ids: list[int]):
        self.score = {model.pieces[i]: model.scores[i] for i in ids}

    def merge(self, text: str) -> list[str]:
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Codec:
    """Encoder and decoder of one worker. Within it a symbol is a piece's id, or ``OUTSIDE`` + code point."""

    def __init__(self, model: PieceModel, cache_words: int = CACHE_WORDS):
        import ahocorasick

        self.model = model
        bytes_ = set(model.byte_ids.values())
        plain = [i for i, p in enumerate(model.pieces) if i not in model.silent and i not in bytes_]
        self.merger = Merger(model, plain)
        self.automaton = ahocorasick.Automaton()
        for i in model.reachable:
            self.automaton.add_word(model.pieces[i], len(model.pieces[i]) << SYMBOL_BITS | i)
        self.automaton.make_automaton()
        # Of each piece: its length, and the longest other piece that it starts with.
        known = {model.pieces[i]: i for i in model.reachable}
        self.size = {i: len(p) for p, i in known.items()}
        prefixes = {i: next((known[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in known), None) for p, i in known.items()}
        self.shorter = {i: j for i, j in prefixes.items() if j is not None}
        self.fits: dict[int, bool] = {}
        joined = [model.pieces[i] for i in plain if len(model.pieces[i]) > 1]
        inner = any(SPACE in p.lstrip(SPACE) for p in joined)
        lone_newline = not any("\n" in p for p in joined)
        # No piece holds a space mark after another character, so no merge crosses that border.
        stop = SPACE + ("\n" if lone_newline else "")
        self.split = (lambda t: [t]) if inner else re.compile(f"{SPACE}*[^{stop}]+|{SPACE}+|\n").findall
        self.words = _Memo(self._word, cache_words // 2)
        self.most_pairs = min(CACHE_PAIRS, cache_words)
        self.spaced = {i: model.pieces[i].replace(SPACE, " ") for i in plain}
        self.decimal = {i: str(i) for i in plain}
        self.byte_of = {i: b for b, i in model.byte_ids.items()}

    def _surface(self, symbol: int) -> str:
        return self.model.pieces[symbol] if symbol < OUTSIDE else chr(symbol - OUTSIDE)

    def compatible(self, left: int, right: int) -> bool:
        """Whether two adjacent symbols, merged anew from single characters, come out as they are (memoised)."""
        key = left << SYMBOL_BITS | right
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) >= self.most_pairs:
                self.fits.clear()
            pair = [self._surface(left), self._surface(right)]
            ok = self.fits[key] = self.merger.merge(pair[0] + pair[1]) == pair
        return ok

    def symbols(self, text: str) -> list[int]:
        """Encode a text in which spaces are marks already: longest matches while every pair fits, then step by step."""
        out: list[int] = []
        begins: list[int] = []
        at, last, fits = 0, -1, self.fits
        for end, found in self.automaton.iter_long(text):
            if end - (found >> SYMBOL_BITS) + 1 != at:
                break
            symbol = found & SYMBOL_MASK
            if last >= 0:
                ok = fits.get(last << SYMBOL_BITS | symbol)
                if not (self.compatible(last, symbol) if ok is None else ok):
                    break
            out.append(symbol)
            begins.append(at)
            at, last = end + 1, symbol
        return out if at == len(text) else self._backtrack(text, out, begins, at)

    def _longest(self, text: str, at: int) -> int:
        """The longest piece that matches at a position; a character outside the vocabulary stands alone."""
        for end, found in self.automaton.iter_long(text, at):
            if end - (found >> SYMBOL_BITS) + 1 == at:
                return found & SYMBOL_MASK
            break
        return OUTSIDE + ord(text[at])

    def _backtrack(self, text: str, out: list[int], begins: list[int], at: int) -> list[int]:
        """Go on from a start whose pairs fit: longest piece first, the next shorter where a pair does not fit, a step back where none is left."""
        n, fits, shorter, size = len(text), self.fits, self.shorter, self.size
        failed = bytearray(n // 8 + 1)
        last = out[-1] if out else -1
        symbol = self._longest(text, at)
        while True:
            end = at + size.get(symbol, 1)
            if not failed[end >> 3] >> (end & 7) & 1:
                ok = True if last < 0 else fits.get(last << SYMBOL_BITS | symbol)
                if ok is None:
                    ok = self.compatible(last, symbol)
                if ok:
                    out.append(symbol)
                    begins.append(at)
                    if end == n:
                        return out
                    at, last = end, symbol
                    symbol = self._longest(text, at)
                    continue
            symbol = shorter.get(symbol, -1)
            while symbol < 0:  # nothing valid goes on from here
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("no valid encoding")
                symbol, at = shorter.get(out.pop(), -1), begins.pop()
                last = out[-1] if out else -1

    def _ids(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        for symbol in symbols:
            if symbol < OUTSIDE:
                out.append(symbol)
            elif self.model.byte_ids:
                out.extend(self.model.byte_ids[b] for b in chr(symbol - OUTSIDE).encode())
            else:
                out.append(self.model.unk)
        return out

    def _word(self, word: str) -> tuple[str, str]:
        """Ids of a word as decimal text, and what those ids decode to."""
        symbols = self.symbols(word)
        if max(symbols) >= OUTSIDE:
            ids = self._ids(symbols)
            return " ".join(map(str, ids)), self.raw(ids)
        return " ".join(map(self.decimal.__getitem__, symbols)), "".join(map(self.spaced.__getitem__, symbols))

    def _marked(self, text: str) -> list[str]:
        if not text:
            return []
        if self.model.dummy_prefix:
            text = " " + text
        return self.split(text.replace(" ", SPACE))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, the end id last."""
        return [int(i) for w in self._marked(text) for i in self.words[w][0].split(" ")] + [self.model.eos]

    def raw(self, ids: list[int]) -> str:
        """Surface of ids, spaces restored, the dummy prefix kept."""
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending = bytearray()
            if i == self.model.unk:
                out.append(" ⁇ ")
            elif i not in self.model.silent:
                out.append(self.spaced[i])
        if pending:
            out.append(pending.decode(errors="replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.raw(ids)
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of their decimal text, SHA-256 of what they decode to."""
        found = list(map(self.words.__getitem__, self._marked(text)))
        # Each word is decoded from its ids; bytes of one character never straddle two words.
        back = "".join([decoded for _, decoded in found])
        if self.model.dummy_prefix and back[:1] == " ":
            back = back[1:]
        line = " ".join([*[ids for ids, _ in found], str(self.model.eos)])
        return line.count(" ") + 1, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


class _Memo(dict):
    """Short keys are remembered in two generations of ``most`` each: what is asked for again outlives the turn."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > CACHE_LONGEST:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _codec_maker(df: DataFrame, model_path: str, cache_words: int = CACHE_WORDS):
    shared = df.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))  # bounded by the model file

    def codec() -> Codec:
        # One codec per worker process: later tasks find the words that earlier ones have seen.
        if "codec" not in shared.value.__dict__:
            shared.value.__dict__["codec"] = Codec(shared.value, cache_words)
        return shared.value.__dict__["codec"]

    return codec


def encode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Append ``ids`` (array of int, the end id last) of each whole text."""
    new = _codec_maker(df, model_path)

    def make():
        codec = new()
        return lambda texts: {ids_col: [codec.encode(t or "") for t in texts]}

    return append_columns(df, make, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], text_col)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Append the text of each array of ids (null: empty)."""
    new = _codec_maker(df, model_path)

    def make():
        codec = new()
        return lambda rows: {out_col: [codec.decode(r or []) for r in rows]}

    return append_columns(df, make, [T.StructField(out_col, T.StringType())], ids_col)


def encode_decode_digests(df: DataFrame, model_path: str, text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """Append n_tokens, ids_sha256 and decoded_sha256: the round trip without moving the ids out of the worker."""
    new = _codec_maker(df, model_path, cache_words)

    def make():
        codec = new()

        def run(texts):
            rows = [codec.digests(t or "") for t in texts]
            return {"n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]}

        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return append_columns(df, make, fields, text_col)
