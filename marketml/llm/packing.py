"""Cost-balanced packing of tokenized documents into sequences.

A piece of L tokens costs ``linear * L + quadratic * L * L`` (feed-forward
work and attention within the piece).  Pieces are taken in descending
order, and each goes to the sequence of lowest cost so far that has room for it.  What
fits nowhere is cut to fill the room that is left, so sequences come out full.

A document's full-length pieces are sequences of their own; only its remainder is
balanced against others.  A partition's documents are packed in groups of
``group`` sequences, in a stream, so memory has a fixed bound, and nothing is shuffled.  The
last tokens of a partition, fewer than one sequence, go to sequences with a power of two
as their length, which need no padding.  A task that runs again gives the same
sequences, as it reads the same rows in the same order.

Nulls and ties: a null text counts as empty and is packed as its end id alone; a
null id is kept; repeated rows are packed like others; ties go to the earlier document and
the earlier sequence.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketml.llm.common import give_back, prepare

END_ID = 1
#: str.split() also parts words at these, which the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Characters that lower-casing and composing treat alike in every Unicode version.
_PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u017f]*")


def _byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: the
    printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = (b for b in range(256) if b not in shown)
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return "".join(table[b] for b in range(256))


class Encoder:
    """Token ids of whole texts.  The tokenizer never joins characters over
    white space, so the ids of a text are those of its parts between white space.  Parts
    and their words that were met before are looked up, at most ``cached`` of each;
    a new word goes to the tokenizer's own model, a part with other than plain
    Latin letters to the whole tokenizer."""

    def __init__(self, path: str, cached: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split" and p["invert"]]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        # The word route holds for this kind of tokenizer only.
        self.rule = regex.compile(splits[0]).findall if len(splits) == 1 and kinds == ["NFC", "Replace", "Lowercase"] else None
        self.letters = _byte_letters()
        self.cached, self.known, self.old, self.words = cached, {}, {}, {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= self.cached:
                self.words.clear()
            text = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = self.words[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()
        return ids

    def _learn(self, parts) -> None:
        hard, known, old, word = [], self.known, self.old, self._word
        for part in parts:
            if part in old:
                known[part] = old[part]
            elif not self.rule or not (part.isascii() or _PLAIN.fullmatch(part)) or "<" in part and any(s in part for s in self.specials):
                hard.append(part)
            else:
                low = part.lower()
                # A word, or one and a mark after it, needs no splitting rule.
                if low.isalpha():
                    known[part] = word(low)
                elif low[-1] in ".,;:!?" and low[:-1].isalpha():
                    known[part] = word(low[:-1]) + word(low[-1])
                else:
                    known[part] = b"".join(map(word, self.rule(low)))
        known.update(zip(hard, self._encode(hard), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [None if _ODD_SPACE.search(t) else t.split() for t in texts]
        used = set().union(*(words for words in split if words))
        new = used.difference(self.known)
        if len(self.known) + len(new) > self.cached:
            self.old, self.known, new = self.known, {}, used
        self._learn(new)
        known = self.known
        out = [b"".join(map(known.__getitem__, words)) if words is not None else self._encode([t])[0] for t, words in zip(texts, split, strict=True)]
        for part in new:
            if len(part) > 64:
                del known[part]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, cached: int) -> Encoder:
    return Encoder(path, cached)


def balance(pieces: list, tokens: int, linear: float, quadratic: float) -> tuple[list, list]:
    """Fills floor(total / tokens) sequences.  ``pieces`` are (document,
    start, ids); returns the placed ones as (piece, sequence, offset) and those left over."""
    count = sum(len(p[2]) for p in pieces) // tokens
    cost, room = np.zeros(count), np.full(count, tokens)
    placed, wide, left = [], [], []

    def put(piece, at):
        size = len(piece[2])
        placed.append((piece, at, tokens - int(room[at])))
        room[at] -= size
        cost[at] += linear * size + quadratic * size * size

    for piece in sorted(pieces, key=lambda p: -len(p[2])):
        fits = np.flatnonzero(room >= len(piece[2]))
        if len(fits):
            put(piece, int(fits[np.argmin(cost[fits])]))
        else:
            wide.append(piece)
    for doc, start, ids in wide:
        while len(ids):
            open_ = np.flatnonzero(room)
            if not len(open_):
                left.append((doc, start, ids))
                break
            at = int(open_[np.argmin(cost[open_])])
            cut = min(int(room[at]), len(ids))
            put((doc, start, ids[:cut]), at)
            start, ids = start + cut, ids[cut:]
    return placed, left


def _packer(path: str, tokens: int, group: int, linear: float, quadratic: float, id_type: pa.DataType, with_ids: bool, cached: int, kept: bool = True):
    schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches):
        give_back()
        encode, sequence = (encoder if kept else Encoder)(path, cached), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        waiting, held = [], 0

        def emit(doc, start, ids, at, offset):
            rows.append((doc[0], start, len(ids), zlib.crc32(ids.tobytes()), doc[1], at, offset, *([ids] if with_ids else [])))

        def batch():
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, f.type) for c, f in zip(columns[:7], schema, strict=False)]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(np.cumsum([0, *columns[2]], dtype=np.int32), np.concatenate(columns[7]).astype(np.int32)))
            out = pa.RecordBatch.from_arrays(arrays, schema=schema)
            rows.clear()
            return out

        def pack():
            nonlocal waiting, held, sequence
            placed, waiting = balance(waiting, tokens, linear, quadratic)
            for (doc, start, ids), at, offset in placed:
                emit(doc, start, ids, sequence + at, offset)
            sequence += held // tokens
            held = sum(len(p[2]) for p in waiting)

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, data in zip(b.column(0).to_pylist(), encode(texts), strict=True):
                ids = np.append(np.frombuffer(data, "<u4"), np.uint32(END_ID)).astype("<u4")
                doc, full = (doc_id, len(ids)), len(ids) // tokens * tokens
                for start in range(0, full, tokens):
                    emit(doc, start, ids[start : start + tokens], sequence, 0)
                    sequence += 1
                if full < len(ids):
                    waiting.append((doc, full, ids[full:]))
                    held += len(ids) - full
                if held >= group * tokens:
                    pack()
            if rows:
                yield batch()
        if held >= tokens:
            pack()
        size, offset = 1 << held.bit_length() >> 1, 0
        for doc, start, ids in waiting:
            while len(ids):
                cut = min(size - offset, len(ids))
                emit(doc, start, ids[:cut], sequence, offset)
                start, ids, offset, held = start + cut, ids[cut:], offset + cut, held - cut
                if offset == size:
                    sequence, offset, size = sequence + 1, 0, 1 << held.bit_length() >> 1
        if rows:
            yield batch()
        if not kept:
            del encode
            give_back()

    return run


@F.arrow_udf(T.LongType())
def crc_of_ids(ids: pa.Array) -> pa.Array:
    """CRC of each piece's ids as little-endian unsigned 32-bit integers."""
    data, at = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
    return pa.array([zlib.crc32(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())


def pack(docs: DataFrame, tokenizer: str, tokens: int = 2048, group: int = 512, linear: float = 1.0, quadratic: float = 1 / 1024, with_ids: bool = True, text: str = "text", doc_id: str = "doc_id", cached: int = 600_000, kept: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, unless ``with_ids`` is false, the piece's ids.  ``tokenizer``
    is the path of a tokenizers file that executors can read; a Python worker remembers the ids of ``cached``
    parts of texts and as many older ones; with ``kept`` it does so from task to task, else its tokenizer and
    they go with the task."""
    from pyspark.sql.pandas.types import to_arrow_type

    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    out = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(_packer(tokenizer, tokens, group, linear, quadratic, to_arrow_type(kind), with_ids, cached, kept), out)
