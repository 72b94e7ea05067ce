"""Shared front half of a word-end BPE tokenizer: normalise, cut into pre-tokens, encode.

The tokenizer file fixes three things that are reproduced here over whole batches with numpy:
NFC and lower case, the pre-token pattern (contractions, letter runs, single numbers, runs of
anything else, white space dropped) and the byte alphabet.  The BPE merges themselves are the
tokenizers library's own (``PretokenEncoder``) or compiled (``token_transducer``).

The Unicode tables used here are Python's, the library's may be newer.  They agree on all code points that Python's know (a test runs over
all), so texts with any other (class ``UNKNOWN``) are handed to the library whole.

Null texts count as empty.  Texts may be of any length; nothing is truncated.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 1, 2, 0, 3, 4
#: Fixed values of the pre-token pattern: what may follow an apostrophe in one piece with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Fixed values of the White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others count up from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point, made once a process."""
    global _CLASSES
    if _CLASSES is None:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))
            if kind[0] == "L":
                table[cp] = LETTER
            elif kind[0] == "N":
                table[cp] = NUMBER
            elif kind == "Cn":
                table[cp] = UNKNOWN
        table[WHITE_SPACE] = SPACE
        _CLASSES = table
    return _CLASSES


class Spec:
    """What the file says; refuses files of another kind rather than give wrong ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        model = raw["model"]
        kinds = [x["type"] for x in (raw["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} is not a lower-casing word-end BPE file")
        self.path = path
        self.vocab: dict[str, int] = model["vocab"]
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in raw["added_tokens"]}
        self.size = 1 + max(max(self.vocab.values()), *self.special.values()) if self.special else 1 + max(self.vocab.values())
        self.names = [""] * self.size
        for k, v in (self.vocab | self.special).items():
            self.names[v] = k


def unknown(text: str) -> bool:
    """Whether a text has a code point that Python's Unicode tables don't know."""
    return not text.isascii() and bool((classes()[code_points(text)] == UNKNOWN).any())


def normalise(text: str) -> str:
    """NFC, then lower case letter by letter (so without the final-sigma rule)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


def starts_of(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each code point, whether a pre-token starts there)."""
    kind = classes()[cp]
    before = np.empty_like(kind)
    before[:1] = SPACE
    before[1:] = kind[:-1]
    start = ((kind != before) | (kind == NUMBER)) & (kind != SPACE)
    quote = np.flatnonzero((cp == 39) & start)
    if quote.size:
        at = np.zeros(cp.size + 4, dtype=np.uint32)
        at[: cp.size] = cp
        n = np.zeros(quote.size, dtype=np.int64)
        for tail in CONTRACTIONS:
            hit = np.ones(quote.size, dtype=bool)
            for k, c in enumerate(tail):
                hit &= at[quote + 1 + k] == ord(c)
            n = np.where(hit & (n == 0), len(tail), n)
        quote, n = quote[n > 0], n[n > 0]
        start[quote + 1] = False
        after = quote + 1 + n
        inside = after < cp.size
        after = after[inside]
        start[after] |= kind[after] == LETTER
    return kind, start


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def spaced(text: str) -> bytes:
    """The normalised text in UTF-8 with one blank before each pre-token and no other white space."""
    cp = code_points(text)
    if not cp.size:
        return b""
    kind, start = starts_of(cp)
    keep = kind != SPACE
    out = np.empty(cp.size + int(start.sum()), dtype=np.uint32)
    where = np.arange(cp.size) + np.cumsum(start)
    blank = np.zeros(out.size, dtype=bool)
    blank[where[start] - 1] = True
    out[where] = np.where(keep, cp, 32)
    out[blank] = 32
    return out.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


class Memory(dict):
    """A bounded memo of two generations: what was used since the last turn survives the next one."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class PretokenEncoder:
    """Ids of whole texts: pre-tokens cut here, encoded by the library's BPE model, remembered in a bounded memo."""

    def __init__(self, path: str, remembered: int = 60_000):
        from tokenizers import Tokenizer

        self.spec = Spec(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        letters = byte_letters()
        # Pre-tokens hold no blank; it parts them.
        self.table = {i: c for i, c in enumerate(letters)} | {32: " "}
        self.memo = Memory(remembered)
        self.special = sorted(self.spec.special, key=len, reverse=True)

    def _fill(self, words: list[bytes]) -> None:
        memo, old = self.memo, self.memo.old
        kept = {w: old[w] for w in words if w in old}
        memo.update(kept)
        new = [w for w in words if w not in kept] if kept else words
        for a in range(0, len(new), 2048):
            part = new[a : a + 2048]
            memo.update(zip(part, self._together(part)))

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token by the library's model; what Python does around the calls is done for all words at once."""
        letters = b" ".join(words).decode("latin-1").translate(self.table).split(" ")
        lists = list(map(self.model.tokenize, letters))
        flat = np.array([t.id for tokens in lists for t in tokens], dtype="<u2").tobytes()
        upto = (2 * np.cumsum([len(tokens) for tokens in lists])).tolist()
        return [flat[a:b] for a, b in zip([0, *upto], upto)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text, unsigned 16-bit."""
        texts = [t or "" for t in texts]
        strange = [i for i, t in enumerate(texts) if unknown(t)]
        if strange:
            plain = list(texts)
            for i in strange:
                plain[i] = ""
            out = self.encode(plain)
            for i in strange:
                out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, dtype="<u2")
            return out
        cut = {i: self.split_special(t) for i, t in enumerate(texts) if "<|" in t}
        cut = {i: parts for i, parts in cut.items() if len(parts) > 1}
        if not cut:
            return self._encode(texts)
        flat: list[str] = []
        for i, t in enumerate(texts):
            flat += cut[i][::2] if i in cut else [t]
        got, out = iter(self._encode(flat)), []
        for i in range(len(texts)):
            pieces = [next(got)]
            for name in cut[i][1::2] if i in cut else ():
                pieces += [np.array([self.spec.special[name]], dtype="<u2"), next(got)]
            out.append(np.concatenate(pieces) if len(pieces) > 1 else pieces[0])
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each different pre-token of the batch is looked up once; ids are then laid out with numpy."""
        texts = [normalise(t) for t in texts]
        joined = "\n".join(texts)
        cp = code_points(joined)
        kind, start = starts_of(cp)
        if not start.any():
            return [np.zeros(0, dtype="<u2") for _ in texts]
        first_letter = np.flatnonzero(start)
        ends = np.ones(cp.size, dtype=bool)  # a pre-token ends before the next and before white space
        np.logical_or(start[1:], kind[1:] == SPACE, out=ends[:-1])
        last_letter = np.flatnonzero(ends & (kind != SPACE))
        flat = joined.encode("utf-8", "surrogatepass")
        if len(flat) == cp.size:
            begin, end = first_letter, last_letter + 1
        else:
            width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
            at = np.cumsum(width, dtype=np.int64)
            begin, end = at[first_letter] - width[first_letter], at[last_letter]
        codes, first = different(flat, begin, end)
        memo = self.memo
        memo.turn()
        words = [flat[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())]
        ids = list(map(memo.get, words))
        if None in ids:
            self._fill([w for w, got in zip(words, ids) if got is None])
            ids = list(map(memo.__getitem__, words))
        pool = np.frombuffer(b"".join(ids), dtype="<u2")
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 1
        offset = np.cumsum(count) - count
        each = count[codes]
        upto = np.cumsum(each)
        take = np.repeat(offset[codes] - (upto - each), each)
        take += np.arange(take.size)
        out = pool[take]
        tokens = np.concatenate(([0], upto))
        last = np.cumsum([len(t) + 1 for t in texts]) - 2
        bound = tokens[np.searchsorted(first_letter, last, side="right")]
        return np.split(out, bound[:-1])

    def split_special(self, text: str) -> list[str]:
        """Text, special string, text, ... : special strings inside texts are tokens of their own."""
        if "<|" not in text and all("<|" in s for s in self.special):
            return [text]
        import re

        return re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]


#: The first k of eight bytes; odd numbers that mix keys; bytes from which on a pre-token is numbered in Python.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
LONG = 64


def different(flat: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each stretch of flat, equal ones alike; the first stretch of each number).

    Stretches are read eight bytes at a time and told apart by a key made of these; then all are held against the first of their key.
    """
    import pandas as pd

    size = end - begin
    eight = np.ndarray(len(flat) + 1, dtype="<u8", buffer=flat + bytes(8), strides=(1,))
    part = lambda which, k: eight[begin[which] + k] & _MASKS[np.minimum(size[which] - k, 8)]
    which = np.arange(len(begin))
    got = part(which, 0)
    parts = [(which, 0, got)]
    key = (got + size.astype(np.uint64) * _ODD2) * _ODD
    for k in range(8, LONG, 8):
        which = which[size[which] > k]
        if not which.size:
            break
        got = part(which, k)
        parts.append((which, k, got))
        x = key[which]
        key[which] = ((x ^ x >> np.uint64(29)) + got) * _ODD
    number: dict[bytes, int] = {}
    numbered = lambda which: np.fromiter((number.setdefault(flat[a:b], len(number)) for a, b in zip(begin[which].tolist(), end[which].tolist())), dtype=np.int64, count=len(which))
    which = which[size[which] > LONG]
    if which.size:
        numbers = np.full(len(begin), -1, dtype=np.int64)
        numbers[which] = numbered(which)
        key[which] ^= (numbers[which].astype(np.uint64) + np.uint64(1)) * _ODD2
    key ^= key >> np.uint64(32)
    codes, keys = pd.factorize(key)
    first = _firsts(codes, len(keys))
    own = first[codes]
    same = np.array_equal(size, size[own]) and all(np.array_equal(part(own[of], k), got) for of, k, got in parts) and (not which.size or np.array_equal(numbers, numbers[own]))
    if not same:  # keys of 64 bits do collide, for strings made to: then by the bytes themselves
        number.clear()
        codes = numbered(np.arange(len(begin)))
        first = _firsts(codes, len(number))
    return codes, first


def _firsts(codes: np.ndarray, n: int) -> np.ndarray:
    first = np.empty(n, dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return first


_ENCODERS: dict[tuple[str, int], PretokenEncoder] = {}


def encoder(path: str, remembered: int = 60_000) -> PretokenEncoder:
    """One encoder a process, so that the memo serves all tasks of a worker."""
    key = (path, remembered)
    if key not in _ENCODERS:
        _ENCODERS[key] = PretokenEncoder(path, remembered)
    return _ENCODERS[key]
