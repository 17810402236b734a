"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table.

A text is cut into pieces by the tokenizer's pattern. Inside a piece, an Aho-Corasick automaton over all tokens gives the longest
token at every place. A sequence of tokens is what the merges would give exactly if each pair of neighbours is compatible,
meaning that no merge crosses their border before both are complete. The encoder takes the longest token, falls back to its longest
prefix that is a token, and steps back where none is compatible; places proven dead are never visited again, so the work is linear.
"""

from __future__ import annotations

import codecs
import hashlib
import json

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitgauge.llm.common import Memo, append_columns, field, segments

#: The pattern of byte-level BPE vocabularies of this family, and the printable stand-ins of bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

CACHE_ENTRIES = 300_000
CHUNK_TOKENS = 1 << 20
NEVER = 1 << 60
_LOADED: dict[str, "Bpe"] = {}


def stand_ins() -> dict[str, int]:
    """Printable character -> byte: bytes that don't print are numbered from 256."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


def gather(ids: np.ndarray, blob: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The entries of an offset table for ``ids``, one after the other."""
    lens = start[ids + 1] - start[ids]
    ends = np.cumsum(lens)
    return blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[ids] - (ends - lens), lens)]


def offset_table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    start = np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int64)
    return np.frombuffer(b"".join(entries), dtype=np.uint8), start


class Bpe:
    """Vocabulary, merges and added tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = stand_ins()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.data = [b""] * size
        for text, i in vocab.items():
            self.data[i] = bytes(byte[c] for c in text)
        for text, i in self.added.items():
            self.data[i] = text.encode()
        ids = {self.data[i]: i for i in vocab.values()}
        self.formed, self.left, self.right, self.pair = [-1] * size, [0] * size, [0] * size, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (bytes(byte[c] for c in part) for part in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = ids[a + b]
            self.pair[ids[a], ids[b]] = rank
            if self.formed[whole] < 0:
                self.formed[whole], self.left[whole], self.right[whole] = rank, ids[a], ids[b]
        self.length = [len(d) for d in self.data]
        self.match = ahocorasick.Automaton()
        for data, i in ids.items():
            self.match.add_word(data.decode("latin-1"), i)
        self.match.make_automaton()
        self.shorter = [next((ids[d[:k]] for k in range(len(d) - 1, 0, -1) if d[:k] in ids), -1) for d in self.data]
        self.pieces = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.table, self.decimals = offset_table(self.data), offset_table([b"%d," % i for i in range(size)])
        self.known: dict[tuple[int, int], bool] = {}
        self.cache = Memo(lambda piece: np.array(self.encode_piece(piece.encode()), dtype=np.int32).tobytes())
        self.spaced = Memo(lambda part: self._pieces(" " + part))

    def compatible(self, a: int, b: int) -> bool:
        """Would the merges over the bytes of ``a`` then ``b`` end with just these two tokens?

        Undoes the merges of both from the last to the first. While a last part of ``a`` and a
        first part of ``b`` exist side by side, a merge of the two comes first if it ranks
        before the merge that uses up either part (at equal rank the left one comes first).
        """
        if (found := self.known.get((a, b))) is not None:
            return found
        x, y, x_used, y_used, fits = a, b, NEVER, NEVER, True
        while fits:
            rank = self.pair.get((x, y))
            if rank is not None and rank < x_used and rank <= y_used:
                fits = False
            elif self.formed[x] < 0 and self.formed[y] < 0:
                break
            elif self.formed[x] > self.formed[y]:
                x_used, x = self.formed[x], self.right[x]
            else:
                y_used, y = self.formed[y], self.left[y]
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        self.known[a, b] = fits
        return fits

    def encode_piece(self, data: bytes) -> list[int]:
        n, chars = len(data), data.decode("latin-1")
        out = [token for _, token in self.match.iter_long(chars)]
        if all(map(self.compatible, out, out[1:])):  # the longest match was right everywhere: nothing to take back
            return out
        longest = [-1] * n
        for end, token in self.match.iter(chars):
            at = end + 1 - self.length[token]
            if longest[at] < 0 or self.length[longest[at]] < self.length[token]:
                longest[at] = token
        out, alive, at, token = [], bytearray(b"\x01") * (n + 1), 0, longest[0] if n else -1
        while at < n:
            if token < 0:  # nothing fits at this place
                alive[at] = 0
                last = out.pop()
                at -= self.length[last]
                token = self.shorter[last]
                continue
            end = at + self.length[token]
            if alive[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                token = self.shorter[token]
        return out

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.pieces(text)))

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens, put together from memorised segments."""
        first, rest = segments(text)
        return self._pieces(first) + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; the strings of added tokens inside it become those tokens."""
        if self.special is None or not any(s in text for s in self.added):
            return np.frombuffer(self._plain(text), dtype=np.int32)
        parts = [np.array([self.added[p]], dtype=np.int32).tobytes() if p in self.added else self._plain(p) for p in self.special.split(text) if p]
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that form no character become U+FFFD."""
        return gather(np.asarray(ids, dtype=np.int64), *self.table).tobytes().decode("utf-8", "replace")

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """sha256 of the decimal ids joined by commas, and of the decoded text in UTF-8."""
        numbers, text, reader = hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
        for k in range(0, len(ids), CHUNK_TOKENS):
            part, last = ids[k:k + CHUNK_TOKENS].astype(np.int64), k + CHUNK_TOKENS >= len(ids)
            numbers.update(gather(part, *self.decimals).tobytes()[:-1 if last else None])
            text.update(reader.decode(gather(part, *self.table).tobytes(), last).encode())
        return numbers.hexdigest(), text.hexdigest()


def load(path: str) -> Bpe:
    """One vocabulary per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` array<int>. A null or empty text has an empty array."""

    def make():
        bpe = load(path)
        return lambda texts: [[bpe.encode(t) for t in texts]]

    return append_columns(docs, text, [field(name, "array<int>")], make)


def decode_documents(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the texts of their ids (null ids: empty text); an existing column ``decoded`` is replaced."""
    @F.pandas_udf("string")
    def texts(column: pd.Series) -> pd.Series:
        bpe = load(path)
        return column.map(lambda x: "" if x is None or len(x) == 0 else bpe.decode(x))

    return rows.withColumn(name, texts(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Encode and decode every whole text: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``lossless``.

    Null is the empty text: no tokens, both digests of the empty string, lossless. Repeated rows give
    repeated results; other columns of ``docs`` come along only if named in ``keep``.
    """

    def make():
        bpe = load(path)

        def run(texts):
            n, numbers, decoded, same = [], [], [], []
            for t in texts:
                ids = bpe.encode(t)
                a, b = bpe.digests(ids)
                n.append(len(ids))
                numbers.append(a)
                decoded.append(b)
                same.append(b == hashlib.sha256(t.encode()).hexdigest())
            return n, numbers, decoded, same

        return run

    fields = [field("n_tokens", "long"), field("ids_sha256", "string"), field("decoded_sha256", "string"), field("lossless", "boolean")]
    return append_columns(docs, text, fields, make, keep=list(keep))
