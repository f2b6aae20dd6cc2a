"""SentencePiece models run by the tokenizers library.

The model's protobuf is read field by field; normaliser, metaspace marker,
scores or merges and byte fallback are rebuilt as a tokenizers pipeline. Where
no piece holds the marker after another character, a text is cut before its
runs of spaces, and each distinct word is encoded once, in batches over
threads. Parity with the sentencepiece library is verified for every distinct
word (or for every whole text that isn't cut); where the two differ
in ids or in the decoded text, sentencepiece's are taken and the row says so.

Cases: null or empty text has no ids; texts with the marker itself, or of
models with a character map or trimming of spaces, are encoded whole; repeated
rows and any length are fine; every row gives one row.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import crc, docs_of
from .packing import parts_of

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
THREADS = "2"
CACHE_WORDS = 1_000_000
SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, parity boolean"


def fields(data: bytes):
    """(number, value) of a protobuf message: int for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk, self.charsmap = UNIGRAM, False, 0, b""
        self.dummy_prefix = self.trim = self.escape = True
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(fields(value))
                self.kind, self.byte_fallback, self.unk = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
            elif number == 3:
                spec = dict(fields(value))
                self.charsmap, self.dummy_prefix, self.trim, self.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))

    @functools.cached_property
    def cuttable(self) -> bool:
        return not self.charsmap and not self.trim and self.escape and self.dummy_prefix and not any(MARK in p.lstrip(MARK) or (k == USER) for p, _, k in self.pieces)


def build(model: Model):
    """A tokenizers.Tokenizer that encodes as the model does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk, model.byte_fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        usable = {p for p, _, k in model.pieces if k in (NORMAL, USER, UNUSED)}
        merges = [(-s, i, len(p) - c, p[:c], p[c:]) for i, (p, s, k) in enumerate(model.pieces) if k == NORMAL for c in range(1, len(p)) if p[:c] in usable and p[c:] in usable]
        core = models.BPE(vocab, [(a, b) for *_, a, b in sorted(merges)], unk_token=model.pieces[model.unk][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} has no tokenizers counterpart here")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    out.add_tokens([AddedToken(p, normalized=False) for p, _, k in model.pieces if k == USER])
    return out


class Codec:
    """Encodes and decodes; every result is held against sentencepiece."""

    def __init__(self, data: bytes, threads: str = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", threads)
        import sentencepiece

        self.model = Model(data)
        self.fast = build(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads = int(threads)
        self.words: dict[str, tuple[bytes, str, bool]] = {}

    def _encode(self, texts: list[str]) -> list[tuple[bytes, str, bool]]:
        """(ids, decoded text, parity) of whole texts; parity is of ids and of what they decode to."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        out = []
        for a in range(0, len(texts), 20_000):
            part = texts[a : a + 20_000]
            own = [e.ids for e in self.fast.encode_batch_fast(part, add_special_tokens=False)]
            ref = self.reference.encode(part, num_threads=self.threads)
            same = [x == y for x, y in zip(own, ref, strict=True)]
            ids = [x if s else y for x, y, s in zip(own, ref, same, strict=True)]
            for x, d, r, s in zip(ids, self.fast.decode_batch(ids, skip_special_tokens=False), self.reference.decode(ids), same, strict=True):
                out.append((np.array(x, "<u4").tobytes(), r, s and d == r))
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, str, bool]]:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        known, out, cut, whole = self.words, [("", "", True)] * len(texts), {}, []
        for i, t in enumerate(texts):
            if not t:
                out[i] = (b"", "", True)
            elif not self.model.cuttable or MARK in t or "\0" in t:
                whole.append(i)
            else:
                words = t.split(" ")
                cut[i] = words if "" not in words else [w[1:] for w in re.findall(" +[^ ]*", " " + t)]
        new = list({w for ws in cut.values() for w in ws} - known.keys())
        for w, e in zip(new, self._encode(new), strict=True):
            # The empty word is the marker alone, which the libraries give no ids.
            known[w] = e if w else self._lone()
        for i, words in cut.items():
            got = [known[w] for w in words]
            out[i] = (b"".join([g[0] for g in got]), " ".join([g[1] for g in got]), all([g[2] for g in got]))
        for i, e in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = e
        return out

    def _lone(self) -> tuple[bytes, str, bool]:
        ids = [i for i, (p, _, _) in enumerate(self.model.pieces) if p == MARK][:1]
        return np.array(ids, "<u4").tobytes(), "", bool(ids)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.fast.decode_batch(ids, skip_special_tokens=False)


_CODECS: dict[str, Codec] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def codec(path: str) -> Codec:
    if path not in _CODECS:
        local = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        with open(local, "rb") as f:
            _CODECS[path] = Codec(f.read())
    return _CODECS[path]


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), decoded text and parity for each row."""
    path = model or default_model()

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            got = [g for i, j in parts_of(texts) for g in c.encode(texts[i:j])]
            lengths = np.cumsum([0] + [len(g[0]) // 4 for g in got]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.frombuffer(b"".join(g[0] for g in got), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got])], ["doc_id", "ids", "decoded", "parity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string, parity boolean")


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """The same encoding, with checksums in place of ids and decoded text."""
    path = model or default_model()

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            got = [g for i, j in parts_of(texts) for g in c.encode(texts[i:j])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(g[0]) // 4 for g in got], pa.int64()), pa.array([crc(g[0]) for g in got], pa.int64()), pa.array([crc(g[1].encode()) for g in got], pa.int64()), pa.array([g[2] for g in got])], ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "parity"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(docs_of(spark, sf_dir))
