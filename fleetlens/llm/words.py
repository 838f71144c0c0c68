"""Words of texts as 64-bit hashes, for code that runs inside tasks."""

from __future__ import annotations

import numpy as np

SLICE_CHARS = 1 << 20


def slices(text: str, most: int = SLICE_CHARS):
    """The text in parts of bounded size, cut where a blank or a line end stands."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(" ", at, at + most), text.rfind("\n", at, at + most))
        if cut <= at:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:] if at else text


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes:
    """Hashes the words of a text; words are what ``bytes.split`` separates (blank, tab to carriage return).

    ``fold`` lower-cases A-Z; ``drop`` lists bytes that count as blanks. Hashes of words are kept in
    a table, which is emptied when it is full.
    """

    def __init__(self, fold: bool = False, drop: bytes = b"", most: int = 500_000):
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest
        self.fold, self.most = fold, most
        self.blanks = bytes(32 if b in drop else b for b in range(256)) if drop else None
        self.known: dict[bytes, int] = {}

    def split(self, text: str) -> list[bytes]:
        raw = text.encode()
        if self.fold:
            raw = raw.lower()
        if self.blanks:
            raw = raw.translate(self.blanks)
        return raw.split()

    def of_words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        missing = set(words).difference(known)
        if missing:
            if len(known) + len(missing) > self.most:
                known.clear()
                missing = set(words)
            digest = self.digest
            known.update((w, digest(w)) for w in missing)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        if len(text) <= SLICE_CHARS:
            return self.of_words(self.split(text))
        return np.concatenate([self.of_words(self.split(part)) for part in slices(text)])


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; with fewer words that of the whole, with none nothing."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return out


class ByteWords:
    """Hashes all words of a buffer at once, with a sum over its bytes that any part can be taken from.

    Bytes have random codes, which are weighted with powers of an odd number and added up; a word's
    hash is the difference of two sums, moved to a common power, with its length mixed in.
    """

    MOST = 1 << 21

    def __init__(self, fold: bool = False, most: int = MOST):
        self.most = most
        self.code = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
        if fold:
            self.code[65:91] = self.code[97:123]
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.up, self.down = powers(0xD1342543DE82EF95, most)

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word."""
        if len(raw) <= self.most:
            return self.part(raw)
        found, at = [], 0
        while at < len(raw):
            end = at + self.most
            if end < len(raw):
                cut = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
                if cut <= at:
                    found.append(self.longest(raw[at:], at))
                    break
                end = cut
            h, start = self.part(raw[at:end])
            found.append((h, start + at))
            at = end
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def longest(self, raw: bytes, at: int) -> tuple[np.ndarray, np.ndarray]:
        """For words that outgrow the tables: the powers are made for them alone."""
        wide = object.__new__(ByteWords)
        wide.code, wide.blank = self.code, self.blank
        wide.up, wide.down = powers(0xD1342543DE82EF95, len(raw))
        h, start = wide.part(raw)
        return h, start + at

    def part(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        start, end, sums = self.bounds(np.frombuffer(raw, np.uint8))
        return self.hashed(sums, start, end), start

    def bounds(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of each word, and the sums that hashes are taken from."""
        edge = np.zeros(len(b) + 2, np.int8)
        edge[1:-1] = ~self.blank[b]
        edge = np.diff(edge)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.code[b] * self.up[: len(b)], out=sums[1:])
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), sums

    def hashed(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[start]) * self.down[start]
        return mixed(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the texts, and where each text's words begin (and the end)."""
        raw = [t.encode() for t in texts]
        h, start = self.of(b" ".join(raw))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        first = np.cumsum(size + 1) - (size + 1)
        return h, np.append(np.searchsorted(start, first), len(h))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(max(n, 1), b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class RunHashes:
    """Hash of any run of a word sequence, from one pass over it."""

    BASE = 0xA0761D6478BD642F

    def __init__(self, words: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None):
        up, self.down = tables if tables and len(tables[0]) > len(words) else powers(self.BASE, len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return mixed((self.sums[start + size] - self.sums[start]) * self.down[start])


def text_runs(column, most_bytes: int = 1 << 20):
    """Texts of an Arrow column, a bounded number of characters at a time, with the place of the first."""
    some, held, at = [], 0, 0
    for i, text in enumerate(column):
        some.append(text.as_py() or "")
        held += len(some[-1])
        if held >= most_bytes:
            yield at, some
            some, held, at = [], 0, i + 1
    if some:
        yield at, some
