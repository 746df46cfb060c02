"""Whole-corpus encoding with a public byte-level BPE tokenizer, and its inverse.

The work runs over Arrow batches. A text is cut into pieces at places where the tokenizer's own
pre-tokenizer must cut, each *distinct* piece is encoded once per worker with the ``tokenizers``
library, and the ids of a text are gathered from the piece table with numpy. The result equals
encoding the whole text at once: a cut is made only before a single blank that a non-blank
follows. The pre-tokenizer's pattern attaches such a blank to what follows it, or, after other
white space, matches the white space before it on its own, so no pre-token spans the cut.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.json"
BATCH_TABLE_LIMIT = 400_000  # distinct pieces a worker remembers; at the limit it starts afresh, which bounds its memory

_UNSAFE_BLANK = re.compile(r" (?:\s|$)")
_SAFE_CUT = re.compile(r"(?= \S)")
#: Finer cuts, for pieces met for the first time: before the last line end of several, and between a CJK letter and a digit or
#: CJK punctuation, which are of different classes in the pre-tokenizer's pattern and therefore never in one pre-token.
_FINE_CUT = re.compile(r"(?=[ \n]\S)|(?<=[一-龥])(?=[0-9，。（）；：])|(?<=[0-9，。（）；：])(?=[一-龥])")


def load_tokenizer(definition: str):
    """A tokenizer from its JSON text; special tokens' strings in a text count as ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = True
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def cut(text: str) -> list[str]:
    """Pieces whose ids, put one after another, are the ids of the text.

    A piece after the first is given without the blank that it begins with; the first is marked by a blank, with which no other piece begins, unless it is empty.
    """
    if _UNSAFE_BLANK.search(text):
        head, *rest = _SAFE_CUT.split(text)
        return [" " + head, *(p[1:] for p in rest)] if head else [p[1:] for p in rest]
    pieces = text.split(" ")
    if pieces[0]:
        pieces[0] = " " + pieces[0]
        return pieces
    return pieces[1:]


class _Places(dict):
    """Numbers pieces in the order in which they are first met."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class PieceEncoder:
    """Encodes batches of texts, remembering the ids of every distinct piece up to a bound."""

    def __init__(self, definition: str, limit: int = BATCH_TABLE_LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        self.tokenizer = load_tokenizer(definition)
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.place = _Places()
        self.atoms: dict[str, list[int]] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)

    def _learn(self) -> None:
        pieces = [_FINE_CUT.split(p[1:] if p[:1] == " " else " " + p) for p in self.place.new]
        self.place.new = []
        new = list(dict.fromkeys(a for own in pieces for a in own if a not in self.atoms))
        self.atoms.update(zip(new, (e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        ids = [self.atoms[own[0]] if len(own) == 1 else [i for a in own for i in self.atoms[a]] for own in pieces]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum()))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, flat])

    def _places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all texts in a row, and how many each text has."""
        if len(self.starts) > self.limit:
            self._forget()
        cuts = [cut(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))
        places = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cuts)), dtype=np.int64, count=int(counts.sum()))
        if self.place.new:
            self._learn()
        return places, counts

    def sizes_of(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text; 0 for empty and null texts."""
        places, counts = self._places(texts)
        sums = np.concatenate([[0], np.cumsum(self.sizes[places])])
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text; an empty list for empty and null texts."""
        places, counts = self._places(texts)
        sizes = self.sizes[places]
        starts = self.starts[places]
        flat = _gather(self.ids, starts, sizes)
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, reversed.

    Rule: printable Latin-1 characters stand for themselves, the other bytes in order for U+0100 onwards.
    """
    table, spare = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            table[chr(b)] = b
        else:
            table[chr(256 + spare)] = b
            spare += 1
    return table


def _gather(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches ``table[start : start + size]`` one after another."""
    ends = np.cumsum(sizes)
    return table[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class ByteDecoder:
    """Decoding by the reversed byte table, and the characters that each token covers."""

    def __init__(self, definition: str):
        table = byte_table()
        vocabulary = load_tokenizer(definition).get_vocab(with_added_tokens=True)
        raw = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            raw[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        self.sizes = np.array([len(r) for r in raw], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.table = np.frombuffer(b"".join(raw), dtype=np.uint8)
        leads = np.concatenate([[0], np.cumsum(self.table & 0xC0 != 0x80)])
        self.begun = leads[self.starts + self.sizes] - leads[self.starts]  # characters that begin in a token
        self.leads = np.array([bool(r) and r[0] & 0xC0 != 0x80 for r in raw])

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes of a row of tokens. Only they are joined, so a character split over tokens comes together."""
        return _gather(self.table, self.starts[ids], self.sizes[ids]).tobytes()

    def text(self, ids: list[int]) -> str:
        return self.raw(np.asarray(ids, dtype=np.int64)).decode("utf-8", errors="replace")

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end character positions of each token. A character split over tokens belongs to each of them."""
        ends = np.cumsum(self.begun[ids])
        before = ends - self.begun[ids]
        return np.where(self.leads[ids], before, np.maximum(before - 1, 0)), ends

    def offsets(self, ids: list[int]) -> list[tuple[int, int]]:
        first, end = self.spans(np.asarray(ids, dtype=np.int64))
        return list(zip(first.tolist(), end.tolist()))


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 1, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``most_bytes`` of text, so that long texts do not add up in a worker."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(sizes[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _definition(df: DataFrame, tokenizer_file: str):
    with open(tokenizer_file, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # one fixed vocabulary file of 1.5 MB


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """``(id, ids)``: the token ids of every text without special tokens.

    Empty and null texts have the empty list. Repeated rows give repeated rows; other columns are ignored.
    """
    definition, kind = _definition(df, tokenizer_file), df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(definition.value)
        for part in text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode(part.column(1).to_pylist())], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")


def token_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """``(id, n_tokens)``: the number of tokens of every text; 0 for empty and null texts."""
    definition, kind = _definition(df, tokenizer_file), df.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(definition.value)
        for part in text_slices(batches):
            sizes = pa.array(encoder.sizes_of(part.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes], names=[id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(measure, f"`{id_col}` {kind}, n_tokens long")


def round_trips(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """``(id, n_bytes, exact)``: whether decoding the ids gives the text back.

    Also that the tokens' character spans begin at 0, leave no gap and end at the text's end. A null text counts as empty.
    """
    definition, kind = _definition(df, tokenizer_file), df.schema[id_col].dataType.simpleString()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = PieceEncoder(definition.value), ByteDecoder(definition.value)
        for part in text_slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            plain = [t.encode() for t in texts]
            lists = encoder.encode(texts)
            flat, bounds, exact = lists.values.to_numpy().astype(np.int64), lists.offsets.to_numpy(), []
            for text, wanted, low, high in zip(texts, plain, bounds, bounds[1:]):
                ids = flat[low:high]
                first, end = decoder.spans(ids)
                covers = len(text) == 0 if not len(ids) else first[0] == 0 and end[-1] == len(text) and bool((end[:-1] >= first[1:]).all())
                exact.append(bool(covers) and decoder.raw(ids) == wanted)
            sizes = pa.array([len(p) for p in plain], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(exact, pa.bool_())], names=[id_col, "n_bytes", "exact"])

    return df.select(id_col, text_col).mapInArrow(verify, f"`{id_col}` {kind}, n_bytes long, exact boolean")


