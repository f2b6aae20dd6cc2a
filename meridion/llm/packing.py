"""Sum-of-squares online packing of tokenised documents.

Each partition packs its documents in order. Whole windows of a long document
are sequences of their own. The rest is placed at the fill level for which the
sum of the squared counts of partially filled windows is least; a level array
holds these counts. A window is given out as soon as it is full, so a task
holds the ids of open windows only. When the partition ends, the windows that
are still open are closed by another rule: least filled first, they are emptied
into the gaps of the others, cutting pieces where needed, so that one window of
a partition at most stays partly filled.

Ids are the tokenizer's own for the whole text, its special tokens included.

Cases: null or empty text is a document of the end token alone; repeated rows
are packed each on its own; texts may have any length; an empty table gives no
rows.
"""

from __future__ import annotations

import gc
import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import crc, docs_of, trim

WINDOW, END = 2048, 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CACHE: dict = {}
#: The type of array() that has four bytes.
LONG = "I"
CACHE_WORDS = 700_000
#: Characters that are encoded together, a text at least.
AT_ONCE = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordCache:
    """Encodes texts word by word, each distinct word once.

    The pre-tokeniser of byte-level BPE always begins a new token at a space
    before its next non-space, around a lone line feed, and between a letter
    or digit and punctuation. A text cut there encodes to the concatenation of
    its parts' ids, which are kept as little-endian bytes. Texts that hold one of
    the tokenizer's special tokens or a null character are encoded whole.
    """

    MARKS = ".,;:!?$%&*#|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + ["\0"]
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. A word's key lacks its space; what has none, as the first word of a text, is marked by a null character."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # the many lists of words make no cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        known = self.words
        whole = {i for s in self.special for i, text in enumerate(texts) if s in text}
        cut = [[] if i in whole else text.split(" ") for i, text in enumerate(texts)]
        for words in cut:
            if words:
                words[0] = "\0" + words[0]
        self._learn(set().union(*cut).difference(known))
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for i in whole:
            out[i] = array(LONG, self.tokenizer.encode(texts[i], add_special_tokens=False).ids).tobytes()
        return out

    def _learn(self, words: set[str]) -> None:
        known, marks = self.words, self.MARKS
        new, joined = set(), []
        for w in words:
            if "\n" in w:
                keys = self._parts(w)
            else:
                core = w.rstrip(marks)
                if core == w or not core or not (core[-1].isalpha() or core[-1] in "0123456789"):
                    new.add(w)
                    continue
                keys = (core, "\0" + w[len(core) :])
            joined.append((w, keys))
            new.update(keys)
        new = list(new.difference(known))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            coded = self.tokenizer.encode_batch_fast([k[1:] if k[:1] == "\0" else " " + k for k in part], add_special_tokens=False)
            for k, e in zip(part, coded, strict=True):
                known[k] = array(LONG, e.ids).tobytes()
        for w, keys in joined:
            if w not in known:
                known[w] = b"".join(map(known.__getitem__, keys))

    def _parts(self, word: str) -> list[str]:
        """The keys of the parts of a word that holds line feeds."""
        lines = word.split("\n")
        if not all(lines) or lines[0] == "\0" or any(c.isspace() for c in word if c != "\n"):
            return [word]
        out = []
        for k, line in enumerate(lines):
            if k:
                out.append("\0\n")
                line = "\0" + line
            core = line.rstrip(self.MARKS)
            if core != line and core and (core[-1].isalpha() or core[-1] in "0123456789"):
                out += [core, "\0" + line[len(core) :]]
            else:
                out.append(line)
        return out


def word_cache(path: str) -> WordCache:
    if path not in _CACHE:
        _CACHE[path] = WordCache(path)
    return _CACHE[path]


class Packer:
    """Windows of one partition. Pieces are [document, start, length]."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.full: list[list] = []

    def place(self, doc: int, start: int, length: int) -> None:
        w, n = self.window, self.level
        # Change of the sum of squares, for each level up to w - length.
        change = 1 - 2 * n[: w - length + 1]
        change[0] = 0  # a new window
        change += 2 * n[length:] + 1
        change[-1] -= 2 * n[w] + 1  # a full window isn't partially filled
        usable = n[: w - length + 1] > 0
        usable[0] = True
        at = np.flatnonzero(usable)
        h = int(at[::-1][np.argmin(change[at[::-1]])])  # ties: the fullest
        pieces = self.open[h].pop() if h else []
        pieces.append([doc, start, length])
        if h:
            n[h] -= 1
        if h + length == w:
            self.full.append(pieces)
        else:
            self.open[h + length].append(pieces)
            n[h + length] += 1

    def add(self, doc: int, tokens: int) -> None:
        at = 0
        while tokens - at >= self.window:
            self.full.append([[doc, at, self.window]])
            at += self.window
        if tokens > at:
            self.place(doc, at, tokens - at)

    def windows(self) -> list[list]:
        left = [p for level in self.open for p in level]  # least filled first
        fill = [sum(x[2] for x in p) for p in left]
        i, j = 0, len(left) - 1
        while i < j:
            gap = self.window - fill[j]
            if not gap:
                j -= 1
                continue
            piece = left[i][-1]
            take = min(gap, piece[2])
            left[j].append([piece[0], piece[1], take])
            piece[1], piece[2] = piece[1] + take, piece[2] - take
            if not piece[2]:
                left[i].pop()
            fill[j], fill[i] = fill[j] + take, fill[i] - take
            if not left[i]:
                i += 1
        self.open, self.level[:] = [[] for _ in self.open], 0
        return self.filled() + [p for p in left if p]

    def filled(self) -> list[list]:
        """The windows that are full; they are given out once."""
        out, self.full = self.full, []
        return out


def parts_of(texts: list[str], chars: int = AT_ONCE):
    """(start, stop) of runs of texts of about so many characters, a text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """A row for each piece; sequence_id is unique over all partitions."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        from pyspark import TaskContext

        trim()
        first, n = TaskContext.get().partitionId() << 33, 0
        cache, packer = word_cache(path), Packer(window)
        # Of each document with tokens in open windows: its id, the place of the first id held, the ids held, all tokens, tokens not given out.
        held: dict[int, list] = {}
        rows: list[tuple] = []

        def give(windows) -> None:
            nonlocal n
            for pieces in windows:
                offset = 0
                for d, start, length in pieces:
                    doc = held[d]
                    at = 4 * (start - doc[1])
                    rows.append((doc[0], start, length, crc(doc[2][at : at + 4 * length]), doc[3], first + n, offset))
                    offset += length
                    doc[4] -= length
                    if not doc[4]:
                        del held[d]
                n += 1

        stop = np.array([end], "<u4").tobytes()
        count = 0
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            for i, j in parts_of(texts):
                for doc_id, coded in zip(ids[i:j], cache.encode(texts[i:j]), strict=True):
                    coded += stop
                    tokens = len(coded) // 4
                    held[count] = [doc_id, 0, coded, tokens, tokens]
                    packer.add(count, tokens)
                    give(packer.filled())
                    if count in held and (whole := tokens // window * window):
                        held[count][1:3] = whole, coded[4 * whole :]
                    count += 1
                if len(rows) >= 10_000:
                    yield _batch(rows)
                    rows = []
        give(packer.windows())
        if rows:
            yield _batch(rows)
        cache.words.clear()  # workers outlive their tasks
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(docs_of(spark, sf_dir))
