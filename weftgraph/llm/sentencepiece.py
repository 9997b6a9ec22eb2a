"""SentencePiece models on the tokenizers library: rebuild from the protobuf, encode, decode, verify parity."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy

SPACE = "▁"
# Fixed values of the model's protobuf: piece types and algorithms.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            c = data[at]
            at += 1
            n |= (c & 127) << shift
            shift += 7
            if c < 128:
                return n

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        if tag & 7 not in (1, 2, 5):
            raise ValueError("not a SentencePiece model")
        size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
        if at + size > len(data):
            raise ValueError("the model is cut off")
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Spec:
    """What the protobuf holds of pieces, algorithm and normaliser."""

    pieces: list[tuple[str, float, int]]
    algorithm: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse_model(data: bytes) -> Spec:
    import struct

    pieces, trainer, normal = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    if not pieces or sum(p[2] == UNKNOWN for p in pieces) != 1:
        raise ValueError("not a SentencePiece model")
    return Spec(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)))


def separable(spec: Spec) -> bool:
    """Whether words can be encoded apart: no piece holds a marker after another character, so none spans such a place."""
    return any(p == SPACE for p, _, _ in spec.pieces) and not any(SPACE in p.lstrip(SPACE) for p, _, kind in spec.pieces if kind == NORMAL)


def build(spec: Spec):
    """A tokenizers.Tokenizer with the same ids. Raises ValueError for what it can't express alike."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if not spec.escape or any(p[2] == USER_DEFINED for p in spec.pieces):
        raise ValueError("models with user-defined pieces or bare spaces are not supported")
    vocabulary = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    if spec.algorithm == BPE:
        # A merge for each way to make a normal piece of two; a better score merges first.
        usable = {p for p, _, kind in spec.pieces if kind == NORMAL}
        merges = []
        for i, (p, s, kind) in enumerate(spec.pieces):
            if kind == NORMAL and len(p) > 1:
                merges += [(-s, i, cut, p) for cut in range(1, len(p)) if p[:cut] in usable and p[cut:] in usable]
        model = models.BPE(vocabulary, [(p[:cut], p[cut:]) for _, _, cut, p in sorted(merges)], unk_token=spec.pieces[spec.unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    elif spec.algorithm == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], spec.unknown, spec.byte_fallback)
    else:
        raise ValueError("only BPE and unigram models are supported")
    out = Tokenizer(model)
    steps: list = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Strip()]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    steps.append(normalizers.Replace(" ", SPACE))
    out.normalizer = normalizers.Sequence(steps)
    if separable(spec):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix or spec.squeeze else []
    out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return out


def load(spark: SparkSession, path: str) -> bytes:
    """The model file's bytes, by Spark's readers, so that any store will do; a local path is the driver's."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def _ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length], one after the other."""
    out = []
    for at in range(0, len(starts), 1 << 18):  # bounded for very long texts
        n = lengths[at : at + (1 << 18)]
        ends = np.cumsum(n)
        out.append(flat[np.arange(ends[-1]) + np.repeat(starts[at : at + (1 << 18)] - ends + n, n)])
    return np.concatenate(out) if out else flat[:0]


class Codec:
    """A model on the tokenizers library. Words that recur are encoded once, as far as a bounded cache goes: beyond `cached` words, the
    half of that which most batches had stays, of words that more than one had.

    verify: hold what is encoded against the sentencepiece library: ids and the text read from them, of each word as
    it enters the cache, since both libraries treat words apart, or of whole texts where they don't. What differs is
    kept in `differ`.
    """

    def __init__(self, model: bytes, threads: int = 2, cached: int = 250_000, verify: bool = True):
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true"
        from tokenizers import Tokenizer, normalizers

        self.spec = spec = parse_model(model)
        self.charsmap = normalizers.Precompiled(spec.charsmap) if spec.charsmap else None
        self.whole, self.cached, self.threads, self.own = build(spec), cached, threads, None
        if verify:
            import sentencepiece

            self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.single = None
        if separable(spec) and spec.dummy_prefix and not spec.charsmap:
            self.single, self.joined = Tokenizer(self.whole.model), Tokenizer(self.whole.model)
            self.joined.pre_tokenizer = self.whole.pre_tokenizer
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.begins = np.array([p.startswith(SPACE) for p, _, _ in spec.pieces])
        surface = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, _, kind in spec.pieces]
        self.special = np.array([kind not in (NORMAL, BYTE) for _, _, kind in spec.pieces])
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.length = np.array([len(x) for x in surface], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self._forget()

    def _forget(self) -> None:
        self.known, self.differ = {}, set()
        self.ids, self.at, self.size, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _shrink(self) -> None:
        often = np.flatnonzero(self.used > 1)
        often = np.sort(often[np.argsort(-self.used[often], kind="stable")[: self.cached // 2]])
        words = list(self.known)
        words = [words[i] for i in often.tolist()]
        self.ids, self.size, self.used = _ragged(self.ids, self.at[often], self.size[often]), self.size[often], self.used[often] // 2
        self.at = np.cumsum(self.size) - self.size
        self.known, self.differ = dict(zip(words, range(len(words)), strict=True)), self.differ.intersection(words)

    def normalise(self, text: str) -> str:
        """As the whole tokenizer's normaliser has it, without its book-keeping of offsets."""
        if self.spec.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.spec.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (SPACE + text if text and self.spec.dummy_prefix else text).replace(" ", SPACE)

    def _learn(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used = np.concatenate([self.used, np.zeros(len(sizes), np.int64)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def _enter(self, new: list[str]) -> None:
        """Encode words that aren't known yet, and verify them."""
        # Words with one marker go together, as one text: where a piece has a marker, the next word begins.
        plain = [w for w in new if len(w) > 1 and w[1] != SPACE]
        rest = [w for w in new if not (len(w) > 1 and w[1] != SPACE)]
        chunks = [plain[i : i + 4096] for i in range(0, len(plain), 4096)]
        for words, e in zip(chunks, self.joined.encode_batch_fast(["".join(c) for c in chunks], add_special_tokens=False) if chunks else [], strict=True):
            found, text = e.ids, "".join(words)
            ids = np.array(found)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(words):  # not cut at their markers: each by itself
                rest += words
                continue
            self._learn(words, ids, np.diff(starts, append=len(ids)))
            spoken = text[1:].replace(SPACE, " ")
            if self.own and (found != self.own.encode(spoken) or self.own.decode(found) != spoken):
                self.differ.update(w for w in words if self._word(w) != self.own.encode(w[1:]) or self.own.decode(self._word(w)) != w[1:])
        if rest:
            found = [e.ids for e in self.single.encode_batch_fast(rest, add_special_tokens=False)]
            self._learn(rest, np.array([x for ids in found for x in ids]), np.array([len(x) for x in found]))
            if self.own:
                lead = self.own.encode("a")
                spoken = ["a" + w.replace(SPACE, " ") for w in rest]
                theirs = self.own.encode(spoken, num_threads=self.threads)
                self.differ.update(w for w, x, t, y in zip(rest, found, theirs, spoken, strict=True) if [*lead, *x] != t or self.own.decode(t) != y)

    def _word(self, word: str) -> list[int]:
        k = self.known[word]
        return self.ids[self.at[k] : self.at[k] + self.size[k]].tolist()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool | None]]:
        """All ids one after the other, the place where each text's end, from 0, and each text's parity."""
        if self.single is None:
            found = [e.ids if t else [] for t, e in zip(texts, self.whole.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
            same = [None] * len(texts)
            if self.own:
                back = self.whole.decode_batch(found, skip_special_tokens=False)
                same = [x == y and a == b for x, y, a, b in zip(found, self.own.encode(texts, num_threads=self.threads), back, self.own.decode(found, num_threads=self.threads), strict=True)]
            return np.array([x for ids in found for x in ids], np.int32), np.cumsum([0, *map(len, found)]), same
        if len(self.known) > self.cached:
            self._shrink()
        cut = [self.cut.findall(self.normalise(t)) for t in texts]
        words = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            self._enter(list(dict.fromkeys(words[i] for i in unknown)))
            at[unknown] = [self.known[words[i]] for i in unknown]
        self.used[at] += 1
        sizes = self.size[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, cut)])]
        same = [None if self.own is None else not self.differ or self.differ.isdisjoint(c) for c in cut]
        return _ragged(self.ids, self.at[at], sizes), ends, same

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids as encode() gives them. Normal and byte pieces stand for themselves; texts with others, or with
        bytes that aren't UTF-8, are left to the library."""
        sizes = self.length[ids]
        data = _ragged(self.bytes, self.start[ids], sizes).tobytes()
        cuts = np.concatenate([[0], np.cumsum(sizes)])[ends].tolist()
        special = np.concatenate([[0], np.cumsum(self.special[ids])])[ends]
        hard = np.flatnonzero(np.diff(special)).tolist()
        out = []
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            try:
                t = data[i:j].decode()
            except UnicodeDecodeError:
                hard.append(k)
                t = ""
            out.append(t[1:] if (self.spec.dummy_prefix or self.spec.squeeze) and t[:1] == " " else t)
        hard = sorted(set(hard))
        for i, t in zip(hard, self.whole.decode_batch([ids[ends[i] : ends[i + 1]].tolist() for i in hard], skip_special_tokens=False), strict=True):
            out[i] = t
        return out


_BUILT: dict[tuple[bytes, bool], Codec] = {}


def _codec(model: bytes, threads: int, verify: bool) -> Codec:
    """Built once in each worker."""
    if (model, verify) not in _BUILT:
        _BUILT.clear()
        _BUILT[model, verify] = Codec(model, threads, verify=verify)
    return _BUILT[model, verify]


def _pieces(texts: Iterable[str], most: int = 1 << 19) -> Iterator[list[str]]:
    """Batches of whole texts, of some `most` characters together: memory stays bounded."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", threads: int = 2, verify: bool = True) -> DataFrame:
    """(key, ids, n_tokens, decoded, parity) of each whole text, by the tokenizers library in batches on `threads` threads.

    A null text is empty and an empty one has no ids. decoded: the text read back from the ids. parity: whether the
    sentencepiece library gives the same ids and the same text for them; null without `verify`.
    Strings of control pieces in a text are ordinary text. Repeated rows keep a row each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(base64.b64encode(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(base64.b64decode(sent.value), threads, verify)
        for b in batches:
            at = 0
            for part in _pieces(t.as_py() or "" for t in b.column(1)):
                ids, ends, same = codec.encode(part)
                rows = b.slice(at, len(part))
                at += len(part)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(np.diff(ends), pa.int64()), pa.array(codec.decode(ids, ends), pa.string()), pa.array(same, pa.bool_())], names=["id", "ids", "n_tokens", "decoded", "parity"])

    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(tidy(run), "id long, ids array<int>, n_tokens long, decoded string, parity boolean").withColumnRenamed("id", key)


def decode(tokens: DataFrame, model: bytes, key: str = "doc_id", ids: str = "ids", threads: int = 2) -> DataFrame:
    """(key, text) from a column of ids; null or empty ids give an empty text."""
    sent = tokens.sparkSession.sparkContext.broadcast(base64.b64encode(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(base64.b64decode(sent.value), threads, False)
        for b in batches:
            found = [x.as_py() or [] for x in b.column(1)]
            texts = codec.decode(np.array([x for ids in found for x in ids], np.int64), np.cumsum([0, *map(len, found)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return tokens.select(F.col(key).cast("long").alias("id"), F.col(ids)).mapInArrow(run, "id long, text string").withColumnRenamed("id", key)
