"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed once on the driver and its bytes travel with the task closure (their size is checked).
Each Python worker rebuilds normaliser, metaspace marker, piece scores and byte fallback as one ``Tokenizer``.
Words (a run of markers plus what follows) are encoded in batches by the library's threads; a bounded memo keeps
words already seen.  Models whose pieces reach across words are encoded as whole texts instead.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from neurospan.llm.shared import pieces

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the public model format
UNIGRAM, BPE = 1, 2  # likewise

#: Largest model file that tasks may carry.
MODEL_LIMIT_BYTES = 64 * 1024 * 1024
#: Text bytes encoded at once, and words remembered by a worker.
SLICE_BYTES, MEMO_WORDS = 1 << 20, 150_000


# every byte that is no part of a character is one replacement character
codecs.register_error("sentencepiece", lambda e: ("\ufffd", e.start + 1))


@dataclass(frozen=True)
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protobuf message: ints, 4-byte and 8-byte values, byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        if at + size > len(data):
            raise ValueError("truncated model file")
        yield tag >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> Model:
    """Read the parts of a SentencePiece model that encoding needs."""
    pieces, rest = [], {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            rest |= {"kind": spec.get(3, UNIGRAM), "byte_fallback": bool(spec.get(35, 0)), "suffix_marker": bool(spec.get(24, 0))}
        elif number == 3:
            spec = dict(_fields(value))
            rest |= {"charsmap": spec.get(2, b""), "dummy_prefix": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}
    model = Model(pieces, **rest)
    if model.kind not in (UNIGRAM, BPE) or not pieces:
        raise ValueError("only unigram and BPE models are supported")
    if model.suffix_marker or not model.escape:
        raise ValueError("models with suffix markers or unescaped spaces are not supported")
    return model


def load_model(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MODEL_LIMIT_BYTES + 1)
    if len(data) > MODEL_LIMIT_BYTES:
        raise ValueError(f"the model is larger than {MODEL_LIMIT_BYTES} bytes")
    return data


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every split of every piece into two pieces, best score first: joining by score is joining by this rank."""
    usable = {p for p, _, kind in model.pieces if kind in (NORMAL, USER)}
    ranked = sorted((-score, i, p) for i, (p, score, kind) in enumerate(model.pieces) if kind in (NORMAL, USER))
    return [(p[:k], p[k:]) for _, _, p in ranked for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]


def build_tokenizer(model: Model):
    """The model as a ``tokenizers.Tokenizer`` without normalisation of the marker (see ``normaliser``)."""
    from tokenizers import AddedToken, Tokenizer, decoders, models

    # control and unused pieces must never match text, so their names move to a private-use prefix
    names = [p if kind in (NORMAL, USER, BYTE, UNKNOWN) else f"\U0010fffd{i}" for i, (p, _, kind) in enumerate(model.pieces)]
    unk = next((i for i, x in enumerate(model.pieces) if x[2] == UNKNOWN), 0)
    if model.kind == BPE:
        core = models.BPE(
            vocab={p: i for i, p in enumerate(names)}, merges=_merges(model), unk_token=names[unk], fuse_unk=True,
            byte_fallback=model.byte_fallback, cache_capacity=0,
        )
    else:
        core = models.Unigram([(p, s) for p, (_, s, _) in zip(names, model.pieces, strict=True)], unk_id=unk, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    out.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER])
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(steps + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return out


def normaliser(model: Model):
    """Text to marked text: the model's character map, squeezed spaces if it asks for them, marker and prefix."""
    from tokenizers import normalizers

    charsmap = normalizers.Precompiled(model.charsmap) if model.charsmap else None

    def run(text: str) -> str:
        if charsmap is not None:
            text = charsmap.normalize_str(text)
        if model.squeeze:
            text = re.sub(" {2,}", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if model.dummy_prefix else "") + text.replace(" ", MARK)

    return run


class Codec:
    """Encoder and decoder of one worker.

    Known words have a number; their ids lie one behind the other in ``flat``, cut at ``cuts``.
    """

    def __init__(self, data: bytes):
        self.model = parse_model(data)
        self.built = None  # a worker that only decodes seldom needs it
        self.normalise = normaliser(self.model)
        # a piece with a marker behind another character joins words; user pieces may do so too
        self.by_word = not any(kind == USER or (kind == NORMAL and re.search(f"[^{MARK}]{MARK}", p)) for p, _, kind in self.model.pieces)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.ties = self._ties() if self.model.kind == BPE else None
        self.plain = {p: (s, i) for i, (p, s, kind) in enumerate(self.model.pieces) if kind == NORMAL}
        self._forget()
        shown = [
            bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() if kind == NORMAL else None
            for p, _, kind in self.model.pieces
        ]
        self.simple = np.array([x is not None for x in shown])
        self.sizes = np.array([len(x or b"") for x in shown], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(x or b"" for x in shown), np.uint8)

    @property
    def tokenizer(self):
        if self.built is None:
            self.built = build_tokenizer(self.model)
        return self.built

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.cuts = array("i"), array("q", [0])

    def _ties(self):
        """Scores shared by several pieces: there the original joins the leftmost pair, not the best-ranked one."""
        seen: dict[float, list[str]] = {}
        for p, s, kind in self.model.pieces:
            if kind == NORMAL and len(p) > 1:
                seen.setdefault(s, []).append(p)
        letters = {c for same in seen.values() if len(same) > 1 for p in same for c in p}
        return re.compile("|".join(re.escape(c) + "{3,}" for c in sorted(letters))) if letters else None

    def _leftmost(self, word: str) -> list[int] | None:
        """Join by score with ties to the left, for words where rank order could differ; None if a character is unknown."""
        ids, parts = self.plain, list(word)
        if any(c not in ids for c in parts):
            return None
        while len(parts) > 1:
            best = max(((ids[a + b][0], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [ids[p][1] for p in parts]

    def _learn(self, words: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        for w, e in zip(words, found, strict=True):
            ids = e.ids
            if self.ties is not None and len(w) <= 256 and self.ties.search(w):
                ids = self._leftmost(w) or ids
            self.memo[w] = len(self.cuts) - 1
            self.flat.extend(ids)
            self.cuts.append(len(self.flat))

    def _split(self, text: str) -> list[str]:
        if "  " in text or MARK in text or not text or text[0] == " " or not self.model.dummy_prefix or self.model.charsmap or self.model.squeeze:
            return self.words(self.normalise(text))
        return [MARK + w for w in text.split(" ")]  # single spaces: each starts a word of one marker

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Ids of every text."""
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast([self.normalise(t) for t in texts], add_special_tokens=False)
            return pa.array([e.ids for e in found], pa.list_(pa.int32()))
        split = [self._split(t) for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self._forget()
        new = {w for ws in split for w in ws}.difference(self.memo)
        if new:
            self._learn(sorted(new))
        at = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(split)), np.int64)
        cuts, flat = np.frombuffer(self.cuts, np.int64), np.frombuffer(self.flat, np.int32)
        sizes = cuts[at + 1] - cuts[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(cuts[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        rows = np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)
        del cuts, flat  # the arrays cannot grow while they are looked at
        return pa.ListArray.from_arrays(pa.array(ends[rows].astype(np.int32)), pa.array(ids))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Text of every list of ids; nulls and empty lists give empty texts."""
        ids = ids.fill_null([]) if ids.null_count else ids
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.asarray(ids.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        rows = np.concatenate([[0], np.cumsum(sizes)])
        known = (flat >= 0) & (flat < len(self.sizes))
        flat, odd = np.where(known, flat, 0), ~known
        lengths = self.sizes[flat]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        data = self.bytes[np.repeat(self.starts[flat] - ends[:-1], lengths) + np.arange(ends[-1])].tobytes()
        odd |= ~self.simple[flat]
        strange = np.concatenate([[0], np.cumsum(odd)])
        out = []
        for a, b in zip(rows[:-1], rows[1:], strict=True):
            if strange[a] == strange[b]:
                text = data[ends[a] : ends[b]].decode("utf-8", "sentencepiece")
                out.append(text[1:] if self.model.dummy_prefix and text[:1] == " " else text)
            else:  # control or unknown pieces
                out.append(self.tokenizer.decode(flat[a:b].tolist(), skip_special_tokens=False))
        return pa.array(out, pa.string())


_CODECS: dict[int, Codec] = {}


def codec(data: bytes, threads: int) -> Codec:
    """One codec per worker and model."""
    key = hash(data)
    if key not in _CODECS:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        _CODECS.clear()
        _CODECS[key] = Codec(data)
    return _CODECS[key]


def _added(df: DataFrame, keep: Sequence[str], name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in keep], T.StructField(name, kind)])


def encode(
    df: DataFrame, model: bytes, text: str = "text", into: str = "ids", keep: Sequence[str] | None = None, threads: int = 2
) -> DataFrame:
    """The columns ``keep`` (all by default) and the token ids of ``text`` as ``into``; a column of that name is replaced.

    A null or empty text has no tokens.  Every row stays, repeated rows included.  Texts are encoded whole, however
    long; only words go to the library, so memory follows the text and not the library's record of each token.
    ``threads`` is the number of threads of the library in each worker.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != into.lower()]
    schema, at = _added(df, keep, into, T.ArrayType(T.IntegerType())), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, threads)
        for part in pieces(batches, at, SLICE_BYTES):
            ids = c.encode([t or "" for t in part.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.select(keep).columns, ids], names=[*keep, into])

    return df.mapInArrow(run, schema)


def decode(
    df: DataFrame, model: bytes, ids: str = "ids", into: str = "decoded", keep: Sequence[str] | None = None, threads: int = 2
) -> DataFrame:
    """The columns ``keep`` and the text of the token ids; null or no ids give an empty text.  Every row stays."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != into.lower()]
    schema = _added(df, keep, into, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, threads)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = c.decode(part.column(part.schema.get_field_index(ids)))
                yield pa.RecordBatch.from_arrays([*part.select(keep).columns, found], names=[*keep, into])

    return df.mapInArrow(run, schema)


def encode_decode(
    df: DataFrame, model: bytes, text: str = "text", into: str = "ids", back: str = "decoded",
    keep: Sequence[str] | None = None, threads: int = 2,
) -> DataFrame:
    """``encode`` and ``decode`` in one pass: a task needs one Python worker, and one table of words, instead of two."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in (into.lower(), back.lower())]
    schema, at = _added(df, keep, into, T.ArrayType(T.IntegerType())), df.columns.index(text)
    schema = T.StructType([*schema.fields, T.StructField(back, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, threads)
        for part in pieces(batches, at, SLICE_BYTES):
            ids = c.encode([t or "" for t in part.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.select(keep).columns, ids, c.decode(ids)], names=[*keep, into, back])

    return df.mapInArrow(run, schema)
