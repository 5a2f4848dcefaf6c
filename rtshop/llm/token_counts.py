"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

The exact count of tokens is kept for every prefix of a text, so that "how many tokens has the text", "how many has its
first half" and "where must it be cut for 1024 tokens" are all answered without encoding again.

A text is cut into the vocabulary's pieces (words with their leading space, numbers, signs, white space); tokens never
cross pieces. Within a piece, the encoding of the first i bytes ends in exactly one token t. It is the token for which
the encoding of the first i - len(t) bytes ends in a token that may stand before t; two tokens may stand next to each
other when the merges applied to their joined bytes give these two again. So ``last[i]`` follows from ``last[i - len(t)]``
and ``count[i] = count[i - len(t)] + 1``. Pieces repeat, so their arrays are kept in a bounded cache.

Defined results
---------------
* Null text counts as empty: 0 bytes, 0 tokens. An empty table gives an empty result. Repeated rows are counted one by one.
* A long text is handled whole; a long piece costs its length times the longest token's.
* Other columns of ``docs`` pass through where asked for; one named like a result column is replaced.
"""

from __future__ import annotations

import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rtshop.llm.common import add_columns

LIMIT = 1024
# The pieces of the byte-level vocabulary's own text splitter.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_PIECES = 800_000
KNOWN_PAIRS = 500_000
CACHED_LENGTH = 64


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary file: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for extra, byte in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + extra)] = byte
    return letters


class PrefixCounter:
    """Counts of one vocabulary file. ``path`` names a BPE file with byte-level pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self._cut = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self._pieces = regex.compile(PIECES)
        self._white = regex.compile(r"\s+")
        self.tokens = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self._rank = {(to_bytes(a), to_bytes(b)): r for r, (a, b) in enumerate(merges)}
        self._longest = max(map(len, self.tokens))
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        counter = self

        class Counts(dict):
            def __missing__(self, piece: str) -> int:
                n = counter.piece_counts(piece.encode())[-1]
                if len(piece) <= CACHED_LENGTH:
                    if len(self) >= CACHED_PIECES:
                        self.clear()
                    self[piece] = n
                return n

        self._counts = Counts()

    def merge(self, data: bytes) -> list[bytes]:
        """Encoding by the merges themselves; only ever used on the joined bytes of two tokens."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self._rank.get(pair, 1 << 60) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            joined, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self._rank.get((parts[i], parts[i + 1])) == best:
                    joined.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined
        return parts

    def _may_follow(self, before: bytes, token: bytes) -> bool:
        """Whether two tokens stay as they are when joined; with nothing before, whether one token encodes as itself."""
        if len(self._pairs) >= KNOWN_PAIRS:
            self._pairs.clear()
        fits = self.merge(before + token) == ([before, token] if before else [token])
        self._pairs[before, token] = fits
        return fits

    def piece_counts(self, piece: bytes) -> list[int]:
        """Exact token count of every byte prefix of one piece, the empty one first."""
        counts, last = [0], [b""]
        tokens, longest, pairs = self.tokens, self._longest, self._pairs
        for i in range(1, len(piece) + 1):
            for j in range(max(0, i - longest), i):
                token = piece[j:i]
                if token in tokens:
                    fits = pairs.get((last[j], token))
                    if fits is None:
                        fits = self._may_follow(last[j], token)
                    if fits:
                        break
            else:
                raise ValueError(f"no encoding ends at byte {i} of {piece[:40]!r}")
            counts.append(counts[j] + 1)
            last.append(token)
        return counts

    def _parts(self, text: str):
        """(is special, stretch) in text order."""
        at = 0
        for found in self._cut.finditer(text) if self._cut else ():
            yield False, text[at:found.start()]
            yield True, found.group()
            at = found.end()
        yield False, text[at:]

    def count(self, text: str | None) -> int:
        """Tokens of the whole text: the last entries of its pieces' arrays."""
        if not text:
            return 0
        if not any(s in text for s in self.specials):
            return sum(map(self._counts.__getitem__, self._pieces.findall(text)))
        return sum(1 if special else self.count_plain(part) for special, part in self._parts(text))

    def count_plain(self, text: str) -> int:
        return sum(map(self._counts.__getitem__, self._pieces.findall(text)))

    def prefix_counts(self, text: str | None) -> list[int]:
        """Exact token count of ``text[:k]`` for every k from 0 on.

        Pieces before the one that holds the cut stay as they are. White space is the exception: it is one piece when
        it ends a text, and gives its last character to the word after it otherwise; so within a run of it the count
        is taken from the start of the run. A special string counts once it is whole, before that as plain text.
        """
        out, base, before = [0], 0, ""
        for special, part in self._parts(text or ""):
            if special:
                own = self._plain_prefixes(before + part, base)[len(before) + 1:-1]
                base = out[-1] + 1
                out += [*own, base]
            else:
                out += self._plain_prefixes(part, base)[1:]
                before = part
        return out

    def _plain_prefixes(self, text: str, base: int) -> list[int]:
        out, run, white_until = [base], [], 0
        for match in self._pieces.finditer(text):
            piece, start = match.group(), match.start()
            own = self._by_character(piece)
            for k in range(start + 1, match.end() + 1):
                if k > white_until and (white := self._white.match(text, k - 1)):
                    white_until = white.end()
                    run = [base + n for n in self._by_character(white.group())]
                    run_at = k - 1
                out.append(run[k - run_at] if k <= white_until else base + own[k - start])
            base += own[-1]
        return out

    def _by_character(self, piece: str) -> list[int]:
        """Counts of a piece's prefixes by characters. A contraction cut short is no contraction."""
        counts, at, out = self.piece_counts(piece.encode()), 0, [0]
        for k, char in enumerate(piece, 1):
            at += len(char.encode())
            parts = self._pieces.findall(piece[:k]) if piece[0] == "'" and k < len(piece) <= 3 else ()
            out.append(sum(self._counts[p] for p in parts) if len(parts) > 1 else counts[at])
        return out

    def cut_for(self, text: str | None, budget: int) -> int:
        """Length of the longest prefix whose token count is within ``budget``."""
        counts = self.prefix_counts(text)
        return max(k for k, n in enumerate(counts) if n <= budget)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary and Python worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
          T.StructField("over_limit", T.BooleanType())]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens) to ``docs``. No shuffle."""

    def count(text):
        own = counter(vocabulary)
        values = text.to_pylist()
        tokens = [own.count(v) for v in values]
        return [[len(v.encode()) if v else 0 for v in values], tokens, [n > limit for n in tokens]]

    return add_columns(docs, count, FIELDS, ["text"], keep)


def prefix_table(docs: DataFrame, vocabulary: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``prefix_tokens``: the exact token count of each of the text's prefixes, by code points, the empty first."""

    def count(text):
        own = counter(vocabulary)
        return [[own.prefix_counts(v) for v in text.to_pylist()]]

    return add_columns(docs, count, [T.StructField("prefix_tokens", T.ArrayType(T.LongType()))], ["text"], keep)


def fit_budget(docs: DataFrame, vocabulary: str, budget: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_fit``, the code points of the longest prefix within ``budget`` tokens."""

    def fit(text):
        own = counter(vocabulary)
        return [[own.cut_for(v, budget) for v in text.to_pylist()]]

    return add_columns(docs, fit, [T.StructField("n_fit", T.LongType())], ["text"], keep)
