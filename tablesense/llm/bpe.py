"""Byte-pair encoding and decoding of texts with a public byte-level vocabulary.

A text is cut into words by the vocabulary's pattern; equal words of a task are encoded once. New words are merged
together: the symbols of all of them lie in one flat array, each round looks every adjacent pair up by binary search
over the sorted pair keys, and each word merges its pair of lowest rank wherever it stands. Long words would need a
round for each rank, so there a pair is also merged when no merge of a lower rank can ever cross its borders: a second
sorted table has, for every two adjacent symbols, the lowest rank of a merge that can join them as parts of larger ones.

Decoding looks the bytes of all ids up in one flat table. Nothing is shuffled; words are kept per task in a bounded
cache, which only spares work.

Defined results: null and empty texts have no ids and decode to the empty text; a string of a special token is that
token, as in the library; bytes that are no UTF-8 count as U+FFFD; ids without a token are left out when decoding.
Rows are independent, so repeated rows and ids come out as often as they go in; other columns are kept as asked for.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesense.llm.common import map_batches
from tablesense.llm.token_output import ODD_SPACE, WORDS

CACHED_WORDS = 1_000_000
NEW_BYTES = 1 << 21
"""New words go through the merge rounds by groups of so many bytes, so that arrays stay small; one word is never cut."""
LONG = 48
"""Words of more symbols also merge pairs whose borders no lower rank can cross."""
NONE = np.int64(1 << 62)

SPLIT = regex.compile(public_tokenizers.PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
STAND_INS = {"letter": "q", "number": "0", "space": "\t", "other": "!"}
"""Characters that this Unicode version classes otherwise than the library are cut like these."""


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def char_class(c: str, cut) -> str:
    """The class of a character by what it is kept together with; ``cut`` gives the number of words of a text."""
    for name, like in (("letter", "a"), ("number", "1"), ("other", ".")):
        if cut(c + like) == 1:
            return name
    return "space"


class Merges:
    """The merge list as sorted arrays; symbols are token ids."""

    def __init__(self, parts: np.ndarray, merged: np.ndarray, size: int):
        self.size = np.int64(size)
        self.left, self.right, self.made = parts[:, 0], parts[:, 1], merged
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys, kind="stable")  # the rank of each sorted key
        self.keys, self.results = keys[self.order], merged[self.order]
        rank = np.arange(len(merged))
        born = np.full(size, -1, np.int64)
        born[merged] = rank
        # every token has one merge, and comes after its parts: all places of a pair may then merge at once
        self.ordered = len(np.unique(merged)) == len(merged) and bool(np.all(born[self.left] < rank) and np.all(born[self.right] < rank))
        self._crossing: tuple[np.ndarray, np.ndarray] | None = None

    def ranks(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair (``NONE`` without a merge) and the symbol it becomes."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.order[at], NONE), self.results[at]

    def crossing(self, keys: np.ndarray) -> np.ndarray:
        """The lowest rank of a merge that can come to join two adjacent symbols after one of them merged on its other side."""
        if self._crossing is None:
            ends, starts = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
            ends[self.made], starts[self.made] = self.right, self.left  # the last and the first part of each token
            found, ranks = [], []
            a, b, rank = self.left, self.right, np.arange(len(self.made))
            while len(a):
                x, y, r = (a, b, rank) if found else (a[starts[b] >= 0], starts[b[starts[b] >= 0]], rank[starts[b] >= 0])
                while len(x):
                    found.append(x * self.size + y)
                    ranks.append(r)
                    y = starts[y]
                    x, y, r = x[y >= 0], y[y >= 0], r[y >= 0]
                a = ends[a]
                a, b, rank = a[a >= 0], b[a >= 0], rank[a >= 0]
            table, low = np.concatenate(found), np.concatenate(ranks)
            order = np.lexsort((low, table))
            table, low = table[order], low[order]
            first = np.concatenate(([True], table[1:] != table[:-1]))
            self._crossing = table[first], low[first]
        table, low = self._crossing
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, low[at], NONE)

    def _borders(self, keys: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """For each place a rank that no merge across it comes below, with one more on either end.

        A pair merges at its own rank, or as parts of larger symbols after a merge across a next place, which comes
        before. Ranks spread from the pairs that are there now; what has not spread after some steps is estimated low.
        """
        later = self.crossing(keys)
        low = np.concatenate(([NONE], rank, [NONE]))
        for _ in range(16):
            next_ = np.minimum(low[1:-1], np.maximum(later, np.minimum(low[:-2], low[2:]) + 1))
            changed = next_ < low[1:-1]
            if not changed.any():
                return low
            low[1:-1] = next_
        low[1:-1] = np.minimum(low[1:-1], np.maximum(later, low[1:-1][changed].min() + 1))
        return low

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge many words at once: their symbols in one array and how many each has, before and after."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols) and len(self.keys):
            inner = word[1:] == word[:-1]
            keys = np.where(inner, symbols[:-1] * self.size + symbols[1:], -1)
            rank, result = self.ranks(keys)
            starts = np.flatnonzero(np.concatenate(([True], ~inner)))
            sizes = np.diff(np.concatenate((starts, [len(symbols)])))
            lowest = np.minimum.reduceat(np.concatenate((rank, [NONE])), starts)
            # the place after a word's last symbol has no rank, so a word's lowest rank is that of its own pairs
            own = np.repeat(lowest, sizes)
            active = own < NONE
            chosen = (rank < NONE) & (rank == own[:-1])
            if not self.ordered:
                at = np.flatnonzero(chosen)
                chosen[at[1:][word[at[1:]] == word[at[:-1]]]] = False
            elif sizes.max() > LONG:
                border, padded = self._borders(keys, rank), np.concatenate(([-1], rank, [-1]))
                sure = rank < NONE
                for side in (slice(None, -2), slice(2, None)):
                    sure &= (rank < border[side]) | ((rank == border[side]) & (rank == padded[side]))
                chosen |= sure
            at = np.flatnonzero(chosen)
            if len(at):  # of overlapping places (aaa) the first, third, ... merge, where the first is among the chosen
                run = np.cumsum(np.concatenate(([True], np.diff(at) != 1))) - 1
                first = at[np.concatenate(([True], np.diff(run) != 0))]
                whole = (first == 0) | (rank[first - 1] != rank[first])
                at = at[((at - first[run]) % 2 == 0) & whole[run]]
            symbols = symbols.copy()
            symbols[at] = result[at]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            if not active.all():
                done.append((word[~active], symbols[~active]))
            stays &= active
            symbols, word = symbols[stays], word[stays]
        done.append((word, symbols))
        word, symbols = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lengths))


class Codec:
    """Ids of texts and texts of ids, as the library's with a byte-level vocabulary, without truncation and padding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        model, before, after = about["model"], about.get("pre_tokenizer") or {}, about.get("decoder") or {}
        plain = all(not model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        byte_level = before.get("type") == "ByteLevel" == after.get("type") and before.get("use_regex", True) and not before.get("add_prefix_space")
        added = about.get("added_tokens") or []
        if model.get("type") != "BPE" or not plain or not byte_level or about.get("normalizer") or any(
            t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added
        ):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        vocab, signs = model["vocab"], byte_signs()
        self.special = {t["content"]: t["id"] for t in added}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.first = np.array([vocab[s] for s, _ in sorted(signs.items(), key=lambda x: x[1])], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        parts = np.array([(vocab[a], vocab[b]) for a, b in pairs], np.int64).reshape(-1, 2)
        self.merges = Merges(parts, np.array([vocab[a + b] for a, b in pairs], np.int64), max(tokens) + 1)
        spelled = [
            b"" if t is None else bytes(map(signs.__getitem__, t)) if all(c in signs for c in t) else t.encode()
            for t in map(tokens.get, range(max(tokens) + 1))
        ]
        self.sizes = np.array([len(b) for b in spelled], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words: dict[str, bytes] = {}
        self.known = set(map(chr, range(0x250)))  # classes that no Unicode version has changed
        self.odd: dict[int, str] = {}
        self._library = None
        self.path = path

    def _library_cut(self, text: str) -> int:
        if self._library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return len(self._library.pre_tokenize_str(text))

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii():
            return SPLIT.findall(text)
        if new := set(text) - self.known:
            for c in new:
                stand_in = STAND_INS[char_class(c, self._library_cut)]
                if stand_in != STAND_INS[char_class(c, lambda s: len(SPLIT.findall(s)))]:
                    self.odd[ord(c)] = stand_in
            self.known |= new
        if self.odd and (like := text.translate(self.odd)) != text:
            return [text[m.start() : m.end()] for m in SPLIT.finditer(like)]
        return SPLIT.findall(text)

    def pieces(self, text: str) -> list[str]:
        """A text cut into special tokens and stretches of whole words, in order."""
        if ODD_SPACE.search(text):
            return [text[a:b] for a, b in self._around_special(text)]
        if not any(s in text for s in self.special):
            return WORDS.findall(text)
        return [w for a, b in self._around_special(text) for w in ([text[a:b]] if text[a:b] in self.special else WORDS.findall(text[a:b]))]

    def _around_special(self, text: str) -> list[tuple[int, int]]:
        spans, at = [], 0
        for m in self.cut_special.finditer(text) if self.cut_special else ():
            spans += [(at, m.start()), m.span()]
            at = m.end()
        return [(a, b) for a, b in [*spans, (at, len(text))] if a < b]

    def _learn(self, stretches: list[str]) -> None:
        """Find and keep the ids of new stretches of words."""
        own, words, size = [], [], 0
        for i, stretch in enumerate(stretches):
            cut = [w.encode() for w in self.split(stretch)]
            own.append(len(cut))
            words += cut
            size += len(stretch)
            if size >= NEW_BYTES or i == len(stretches) - 1:
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                symbols, lengths = self.merges.merge(self.first[np.frombuffer(b"".join(words), np.uint8)], lengths)
                ids, ends = symbols.astype("<u4").tobytes(), (4 * np.cumsum(lengths)[np.cumsum(own) - 1]).tolist()
                begin = 0
                for known, end in zip(stretches[i + 1 - len(own) : i + 1], ends, strict=True):
                    self.words[known] = ids[begin:end]
                    begin = end
                own, words, size = [], [], 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        distinct = set().union(*cut)
        if len(self.words) + len(distinct) > CACHED_WORDS:
            self.words.clear()
        if not self.words:
            self.words.update((s, np.array([i], "<u4").tobytes()) for s, i in self.special.items())
        self._learn([w for w in distinct if w not in self.words])
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]

    def decode(self, ids: list[bytes]) -> list[str]:
        """The text of each row of ids; bytes that are no UTF-8 become U+FFFD."""
        lengths = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(ids)), lengths)
        inside = flat < len(self.sizes)
        flat, row = flat[inside], row[inside]
        sizes = self.sizes[flat]
        shift = self.places[flat] - (np.cumsum(sizes) - sizes)
        raw = self.bytes[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].tobytes()
        ends = np.cumsum(np.bincount(row, weights=sizes, minlength=len(ids)).astype(np.int64)).tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    """One per Python worker. ``vocabulary`` is a file or the name of an installed public vocabulary."""
    return Codec(vocabulary if os.path.exists(vocabulary) else public_tokenizers.path(vocabulary))


GROUP_BYTES = 1 << 18


def _groups(column: pa.Array):
    """Spans of rows of about ``GROUP_BYTES``, and their values; null counts as empty."""
    start, size, values = 0, 0, []
    for i, value in enumerate(column):
        raw = value.as_py() or b""
        if values and size + len(raw) > GROUP_BYTES:
            yield start, values
            start, size, values = i, 0, []
        values.append(raw)
        size += len(raw)
    if values:
        yield start, values


def _mapped(df: DataFrame, keep: tuple[str, ...], source: str, target: str, kind: str, work) -> DataFrame:
    rows = df.select(*keep, F.col(source).cast("binary").alias("__in"))
    schema = rows.drop("__in").schema.add(target, kind)
    arrow = pa.binary() if kind == "binary" else pa.string()

    def run(batches):
        for batch in batches:
            for start, values in _groups(batch.column(len(keep))):
                part = batch.slice(start, len(values))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(work(values), arrow)], names=[*keep, target])

    return map_batches(rows, run, schema)


def encode(documents: DataFrame, vocabulary: str, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``ids``: the text's token ids, little-endian unsigned 32-bit integers in one binary."""
    return _mapped(documents, keep, text, "ids", "binary", lambda raw: codec(vocabulary).encode([r.decode("utf-8", "replace") for r in raw]))


def decode(tokens: DataFrame, vocabulary: str, *keep: str, ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``decoded``: the text that the ids of each row spell."""
    return _mapped(tokens, keep, ids, "decoded", "string", lambda raw: codec(vocabulary).decode(raw))
