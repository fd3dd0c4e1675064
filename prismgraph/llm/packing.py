"""Sum-of-squares online packing of token sequences.

Documents arrive one by one. Whole windows are cut off a long document; the rest goes where the sum of squares of the
counts of partially filled windows, by fill level, becomes smallest. The counts live in an array by level, so a choice
costs one pass over that array. At the end of a partition the windows that are still open are poured into one another,
cut freely, so that a partition leaves one partial window at most. Open windows hold no more than the ids of the
partition's own documents, two bytes each where the vocabulary allows.

Defined results: a null or empty text is its end token alone; rows that repeat are packed as often as they come; a
partition without rows, or an empty table, gives none; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from prismgraph.llm.common import bound_batches

_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}
_FILE_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}


def _unicode_bytes() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE vocabularies: visible Latin-1 stays, the rest counts up from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def byte_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ids of the byte strings, and of the added tokens, of a byte-level BPE file in the JSON format of tokenizers."""
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    added = read.get("added_tokens") or []
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"an added token of {path} is not met literally")
    with_byte = _unicode_bytes()
    ranks = {bytes(with_byte[c] for c in token): i for token, i in read["model"]["vocab"].items() if all(c in with_byte for c in token) and not token.startswith("<|")}
    return ranks, {t["content"]: t["id"] for t in added}


def byte_bpe(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a byte-level BPE file in the JSON format of tokenizers, no special tokens added or recognised.

    The file's merges are run by tiktoken, which is some four times faster here; tests hold the ids against tokenizers.
    """
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_ranks(path)[0], special_tokens={})
        _ENCODERS[path] = lambda text: np.array(encoding.encode_ordinary(text), dtype=np.uint32)
    return _ENCODERS[path]


def file_bpe(path: str) -> Callable[[str], np.ndarray]:
    """Ids as tokenizers gives them for the file without add_special_tokens: its added tokens, where a text holds them
    literally, are their own ids, and the text between them is encoded by byte_bpe."""
    if path not in _FILE_ENCODERS:
        plain, ids = byte_bpe(path), {t: np.array([i], dtype=np.uint32) for t, i in byte_ranks(path)[1].items()}
        split = re.compile("(" + "|".join(re.escape(t) for t in sorted(ids, key=len, reverse=True)) + ")").split

        def encode(text: str) -> np.ndarray:
            if not any(t in text for t in ids):
                return plain(text)
            return np.concatenate([ids[part] if part in ids else plain(part) for part in split(text)])

        _FILE_ENCODERS[path] = encode
    return _FILE_ENCODERS[path]


class Packer:
    """Online packing into windows of `size`; `emit` gets (window number, pieces) of every window that is closed."""

    def __init__(self, size: int, emit: Callable[[int, list], None]):
        self.size, self.emit = size, emit
        self.count = np.zeros(size + 1, dtype=np.int64)  # open windows by fill level
        self.open: dict[int, list[list]] = {}  # their pieces, by fill level
        self.closed = 0

    def _close(self, pieces: list) -> None:
        self.emit(self.closed, pieces)
        self.closed += 1

    def level(self, n: int) -> int:
        """The fill level to which n tokens go: that with the smallest sum of squares after it, the fuller of equals."""
        c, size = self.count, self.size
        best, cost = 0, (2 * int(c[n]) + 1 if n < size else 0)
        at = np.flatnonzero(c[1 : size - n + 1])
        if len(at):
            at += 1
            to = at + n
            change = np.where(to < size, 2 * c[np.minimum(to, size - 1)] + 1, 0) - 2 * c[at] + 1
            i = len(at) - 1 - int(np.argmin(change[::-1]))
            if change[i] <= cost:
                best = int(at[i])
        return best

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.size:
            self._close([(doc, start, ids[start : start + self.size], total)])
            start += self.size
        n = total - start
        if not n:
            return
        at = self.level(n)
        if at:
            pieces = self.open[at].pop()
            self.count[at] -= 1
        else:
            pieces = []
        pieces.append((doc, start, ids[start:].copy(), total))
        if at + n == self.size:
            self._close(pieces)
        else:
            self.open.setdefault(at + n, []).append(pieces)
            self.count[at + n] += 1

    def pour(self) -> Iterator[None]:
        """Pours the emptiest open windows into the fullest, cutting pieces, and closes the last; a step for each that closes."""
        left = [[lv, w] for lv in sorted(self.open) for w in self.open[lv]]
        self.open = {}
        self.count[:] = 0
        lo, hi = 0, len(left) - 1
        while lo < hi:
            room = self.size - left[hi][0]
            give = left[lo][1]
            while room and give:
                doc, start, ids, total = give.pop()
                if len(ids) > room:
                    give.append((doc, start, ids[:-room], total))
                    start, ids = start + len(ids) - room, ids[-room:]
                left[hi][1].append((doc, start, ids, total))
                left[hi][0] += len(ids)
                left[lo][0] -= len(ids)
                room -= len(ids)
            if not room:
                self._close(left.pop()[1])
                hi -= 1
                yield
            if not give:
                lo += 1
        if lo == hi and left[lo][1]:
            self._close(left[lo][1])
            yield

    def flush(self) -> None:
        for _ in self.pour():
            pass


PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, end_id: int, size: int, with_ids: bool, arrow_id: pa.DataType, rows_out: int = 20_000, bytes_out: int = 4 << 20):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = file_bpe(path)
        base = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        waiting = 0

        def emit(number: int, pieces: list) -> None:
            nonlocal waiting
            offset = 0
            for doc, start, ids, total in pieces:
                raw = ids.astype("<u4", copy=False).tobytes()
                waiting += len(raw) if with_ids else 0
                out.append((doc, start, len(ids), zlib.crc32(raw), total, base + number, offset) + ((raw,) if with_ids else ()))
                offset += len(ids)

        def batch() -> pa.RecordBatch:
            nonlocal waiting
            waiting = 0
            columns = list(zip(*out))
            kinds = [arrow_id] + [pa.int64()] * 6 + [pa.binary()] * with_ids
            made = pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)
            out.clear()
            return made

        packer = Packer(size, emit)
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                packer.add(doc.as_py(), ids.astype(np.uint16) if ids.max() < 1 << 16 else ids)
                if len(out) >= rows_out or waiting >= bytes_out:
                    yield batch()
        for _ in packer.pour():
            if len(out) >= rows_out or waiting >= bytes_out:
                yield batch()
        if out:
            yield batch()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (unsigned 32-bit,
    little-endian) if asked for. Every partition packs its own documents, in their order, without a shuffle."""
    from pyspark.sql.pandas.types import to_arrow_type

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    schema = PIECE.format(id=kind.simpleString()) + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_pack(tokenizer, end_id, size, with_ids, to_arrow_type(kind)), schema)
