"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here, and its normaliser, white-space marker, scores or merges and byte fallback are
rebuilt; the ids are those of the rebuilt tokenizer, which encodes batches by several threads. Texts are encoded by their distinct
segments. Parity is verified as it runs: a share of the distinct segments is encoded by the sentencepiece library too.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import textvec as tv
from spanloom.llm.common import small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Kinds of pieces and models in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct segments that a worker keeps; beyond, it starts anew.
MOST_KEPT = 300_000
#: Segments that are encoded in one call, and threads that share it.
AT_ONCE, THREADS = 2_000, 2
#: One of so many distinct segments (or whole texts, where segments can't be taken) is verified, chosen by its hash.
VERIFY_ONE_OF = 32


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: ints, 4 or 8 raw bytes, or bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[i : i + size]
        i += size


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for n, v in _fields(data):
            if n == 1:
                piece = dict(_fields(v))
                m.pieces.append(piece.get(1, b"").decode())
                m.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                m.kinds.append(piece.get(3, NORMAL))
            elif n == 2:
                spec = dict(_fields(v))
                m.model_type, m.unk_id = spec.get(3, UNIGRAM), spec.get(40, 0)
                m.byte_fallback, m.suffix = bool(spec.get(35, 0)), bool(spec.get(24, 0))
            elif n == 3:
                spec = dict(_fields(v))
                m.charsmap = spec.get(2, b"")
                m.dummy_prefix, m.squeeze, m.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        return m

    @property
    def splits_at_spaces(self) -> bool:
        """Whether no piece goes on over the begin of a run of spaces; texts are then encoded run by run, with equal results."""
        return self.escape and self.dummy_prefix and not self.suffix and not self.charsmap and not self.squeeze and not any(a != MARK and b == MARK for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER) for a, b in zip(p, p[1:], strict=False))


def build(model: Model, normalise: bool = True):
    """The tokenizers.Tokenizer of a model; without normalise, of texts whose spaces are already marked."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

    usable = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER)}
    if model.model_type == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores, strict=True)), unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.model_type == BPE:
        found = []
        for p, i in usable.items():
            pairs = [(p[:j], p[j:]) for j in range(1, len(p)) if p[:j] in usable and p[j:] in usable]
            found += [(-model.scores[i], i, usable[a], usable[b], a, b) for a, b in pairs]
        merges = [(a, b) for *_, a, b in sorted(found)]
        core = models.BPE({p: i for i, p in enumerate(model.pieces)}, merges, unk_token=model.pieces[model.unk_id], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.model_type} is neither unigram nor BPE")
    t = Tokenizer(core)
    if normalise:
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(_regex(" {2,}"), " ")]
        if model.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if model.escape else " "))
        if model.escape:
            steps.append(normalizers.Replace(" ", MARK))
        t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    own = [AddedToken(p, normalized=False) for p, k in zip(model.pieces, model.kinds, strict=True) if k == USER]
    if own:
        t.add_tokens(own)
    return t


def _regex(pattern: str):
    from tokenizers import Regex

    return Regex(pattern)


class _Segments:
    """The ids of segments by their hashes, on arrays: a few dozen bytes a segment."""

    def __init__(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes

    def add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """New hashes, sorted, and their ids."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, self.used + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.used += total

    def get(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        return self.starts[at], self.sizes[at]


class ParityError(RuntimeError):
    """The rebuilt tokenizer and the sentencepiece library give different ids."""


class Codec:
    """Encodes and decodes batches of texts. One for each worker; built from the model's bytes. The sentencepiece library never gives
    ids: it is loaded to verify a share of them, by which a model that is rebuilt wrongly ends the job with a ParityError."""

    def __init__(self, data: bytes, verify_one_of: int = VERIFY_ONE_OF):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        self.data, self.verify_one_of = data, verify_one_of
        self.model = Model.parse(data)
        self.by_segment = self.model.splits_at_spaces and USER not in self.model.kinds
        self.kept = _Segments()
        self.verified = 0
        shown = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, k in zip(self.model.pieces, self.model.kinds, strict=True)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_len = np.array([len(s) for s in shown])
        self.shown_at = np.cumsum(self.shown_len) - self.shown_len

    @cached_property
    def marked(self):
        """Encodes segments whose spaces are already marked."""
        return build(self.model, normalise=False)

    @cached_property
    def full(self):
        """Encodes whole texts."""
        return build(self.model)

    @cached_property
    def judge(self):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_proto=self.data)

    def _verify(self, texts: list[str], ids: list[list[int]]) -> None:
        for text, ours, theirs in zip(texts, ids, self.judge.encode(texts, num_threads=1), strict=True):
            if ours != theirs:
                raise ParityError(f"{text[:80]!r}: tokenizers {ours[:20]}, sentencepiece {theirs[:20]}")
        self.verified += len(texts)

    def _segments(self, plain: list[str], hashes: np.ndarray) -> list[list[int]]:
        """The ids of each segment, without its leading space, encoded by several threads. A lone marker, as after a text's last space,
        is no text to the library, so it isn't verified."""
        out: list[list[int]] = []
        for i in range(0, len(plain), AT_ONCE):
            out += [e.ids for e in self.marked.encode_batch([(MARK + p).replace(" ", MARK) for p in plain[i : i + AT_ONCE]], add_special_tokens=False)]
        chosen = [i for i in np.flatnonzero(hashes % np.uint64(self.verify_one_of) == 0).tolist() if plain[i]]
        self._verify([plain[i] for i in chosen], [out[i] for i in chosen])
        return out

    def encode_whole(self, texts: list[str]) -> list[list[int]]:
        """Texts one by one, without the detour over segments."""
        out = [e.ids for e in self.full.encode_batch(texts, add_special_tokens=False)] if texts else []
        chosen = [i for i, t in enumerate(texts) if zlib.crc32(t.encode()) % self.verify_one_of == 0]
        self._verify([texts[i] for i in chosen], [out[i] for i in chosen])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a string array; null and empty texts have no ids."""
        raw, offsets = tv.text_bytes(texts)
        parts, ends = [], [np.zeros(1, np.int64)]
        done = 0
        for i, j in tv.chunks(offsets):
            ids, off = self._encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            parts.append(ids)
            ends.append(off[1:] + done)
            done += len(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate(ends)

    def _encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if not self.by_segment or MARK.encode() in raw.tobytes():
            lists = self.encode_whole([raw[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)])
            return np.concatenate([np.array(x, np.int32) for x in lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        some = np.flatnonzero(np.diff(offsets))
        spaced = np.insert(raw, offsets[some], 0x20)
        begins = offsets[some] + np.arange(len(some))
        blank = spaced == 0x20
        heads = blank.copy()
        heads[1:] &= ~blank[:-1]
        heads[begins] = True
        starts = np.flatnonzero(heads)
        ends = np.append(starts[1:], len(spaced))
        base = tv.powers(tv._BASE, len(spaced) + 1)
        total = np.zeros(len(spaced) + 1, np.uint64)
        np.cumsum((spaced.astype(np.uint64) + np.uint64(1)) * base[:-1], out=total[1:])
        hashes = tv.mix((total[ends] - total[starts]) * tv.powers(tv._BASE_INV, len(spaced) + 1)[starts] + (ends - starts).astype(np.uint64) * tv.GOLD)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.kept.hashes) + len(distinct) > MOST_KEPT:
            self.kept = _Segments()
        new = np.flatnonzero(~self.kept.has(distinct))
        if len(new):
            plain = [spaced[a + 1 : b].tobytes().decode() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
            self.kept.add(distinct[new], self._segments(plain, distinct[new]))
        own_starts, own_sizes = self.kept.get(distinct)
        lengths = own_sizes[back]
        out = self.kept.flat[tv.ragged(own_starts[back], lengths)]
        closed = np.concatenate([[0], np.cumsum(lengths)])
        doc_ends = np.zeros(len(offsets), np.int64)
        doc_ends[some + 1] = closed[np.append(np.searchsorted(starts, begins[1:]), len(starts))]
        return out, np.maximum.accumulate(doc_ends)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of lists of ids; a text whose bytes aren't UTF-8 is left to the sentencepiece library. ValueError for
        ids that the model doesn't have."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.model.pieces)):
            raise ValueError("ids that the model doesn't have")
        out: list[str] = []
        for i, j in tv.chunks(offsets):
            part = ids[offsets[i] : offsets[j]]
            lengths = self.shown_len[part]
            data = self.shown[tv.ragged(self.shown_at[part], lengths)].tobytes() if len(part) else b""
            at = np.concatenate([[0], np.cumsum(lengths)])[offsets[i : j + 1] - offsets[i]].tolist()
            odd = (part == self.model.unk_id) | np.isin(part, [k for k, x in enumerate(self.model.kinds) if x == CONTROL])
            odd_at = np.concatenate([[0], np.cumsum(odd)])[offsets[i : j + 1] - offsets[i]]
            for n, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                piece = data[a:b]
                try:
                    if odd_at[n + 1] > odd_at[n] or self.model.squeeze:
                        raise UnicodeError
                    text = piece.decode()
                    out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
                except UnicodeError:
                    out.append(self.judge.decode(ids[offsets[i + n] : offsets[i + n + 1]].tolist()))
        return out


KEEP = "codec"


def codec_for(data: bytes) -> Codec:
    """The worker's codec of a model; a worker that is used again keeps it, and its segments, until another operator's task."""
    key = hashlib.sha256(data).digest()
    had = tv.kept.get(KEEP)
    if had is None or had[0] != key:
        tv.kept[KEEP] = had = (key, Codec(data))
    return had[1]


def _model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """docs with ids_col: array<int>, the ids of text_col. The driver reads the model's file (under a megabyte or a few) and
    sends it along. Null and empty texts have no ids; texts of any length are encoded whole; every row is encoded alone, so
    repeated rows are alike. A column ids_col is replaced, all others stay. Nothing is shuffled."""
    data = _model_bytes(model)
    kept = docs.drop(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(data)
        for b in batches:
            ids, off = codec.encode(b.column(text_col))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))], [*b.schema.names, ids_col])

    return small_batches(kept).mapInArrow(tv.trimmed(run, KEEP), kept.selectExpr("*", f"cast(null as array<int>) as `{ids_col}`").schema)


def decode_ids(rows: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """rows with text_col: the text of ids_col. Null and empty lists give empty texts. ValueError for unknown ids."""
    data = _model_bytes(model)
    kept = rows.drop(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(data)
        for b in batches:
            lists = b.column(ids_col).fill_null([])
            off = np.asarray(lists.offsets).astype(np.int64)
            texts = codec.decode(np.asarray(lists.values.fill_null(0))[off[0] : off[-1]], off - off[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, text_col])

    return small_batches(kept).mapInArrow(tv.trimmed(run, KEEP), kept.selectExpr("*", f"cast(null as string) as `{text_col}`").schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id_col, n_tokens, ids, decoded_sha256, exact): each text's ids, the digest of the text that they decode to, and
    whether that is the text itself. Both ways are gone in one pass, so that neither texts nor ids travel twice. Null texts
    count as empty."""
    data = _model_bytes(model)
    rows = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(data)
        for b in batches:
            ids, off = codec.encode(b.column(1))
            back = codec.decode(ids, off)
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(off), pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids)), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]), pa.array([x == (t or "") for x, t in zip(back, texts, strict=True)])],
                [id_col, "n_tokens", "ids", "decoded_sha256", "exact"],
            )

    return small_batches(rows).mapInArrow(tv.trimmed(run, KEEP), f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_tokens long, ids array<int>, decoded_sha256 string, exact boolean")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to its text."""
    return round_trip(table(spark, sf_dir, "documents"))
