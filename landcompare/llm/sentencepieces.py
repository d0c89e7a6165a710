"""SentencePiece models run by the tokenizers library.

The model's protobuf is read here and rebuilt: the normaliser (precompiled map, blanks,
dummy prefix), the metaspace marker, unigram scores or the merges that the scores of a
BPE model imply, and byte fallback. Where no piece has the marker after another
character, which is checked on the vocabulary, a text's pieces never cross the start of
a marked word: its words are then encoded in multithreaded batches, each distinct word
once, and remembered. The ids that come out are those of the rebuilt model, and they are
decoded again. Every word is also given to the sentencepiece library, but only to compare.

Rows: null text counts as empty and has no ids, null ids of documents stay, repeated
rows each get their ids, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from landcompare.llm.common import few, frugal, table, texts

MODEL = "piece_bpe_32k.model"
MARK = "▁"
MEMO_WORDS = 500_000
TOGETHER = 32  # new words that are decoded as one text
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

# Piece and model types of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    """What a model file says, with the format's defaults."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_blanks: bool = True
    escape_blanks: bool = True
    mark_behind: bool = False


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: numbers for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7)
        size = varint() if size is None else size
        yield tag >> 3, data[at : at + size]
        at += size


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece.get(2, bytes(4)))[0]
            model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(fields(value))
            model.kind = spec.get(3, UNIGRAM)
            model.byte_fallback = bool(spec.get(35, 0))
            model.mark_behind = bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze_blanks, model.escape_blanks = (bool(spec.get(n, 1)) for n in (3, 4, 5))
    if model.kind not in (UNIGRAM, BPE) or model.mark_behind or not model.escape_blanks:
        raise ValueError("only unigram and BPE models with a marker before words are rebuilt")
    return model


def normaliser(model: Model):
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_blanks:
        steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])


def merges(model: Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, best piece first."""
    known = {p for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
    ranked = sorted(((-score, k, p) for k, (p, score, _) in enumerate(model.pieces) if p in known and len(p) > 1))
    return [(p[:i], p[i:]) for _, _, p in ranked for i in range(1, len(p)) if p[:i] in known and p[i:] in known]


def rebuild(model: Model):
    """A tokenizers.Tokenizer with the model's ids."""
    from tokenizers import Tokenizer, decoders, models

    unknown = next((k for k, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, score) for p, score, _ in model.pieces], unknown, model.byte_fallback)
    else:
        vocabulary = {p: k for k, (p, _, _) in enumerate(model.pieces)}
        name = None if unknown is None else model.pieces[unknown][0]
        core = models.BPE(vocabulary, merges(model), unk_token=name, fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normaliser(model)
    blank = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *blank])
    return tokenizer


def by_words(model: Model) -> bool:
    """Whether no piece reaches over the start of a marked word."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED, UNUSED))


class Codec:
    """Encodes and decodes texts; remembers words with their ids and whether they passed both checks."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = parse(data)
        self.tokenizer = rebuild(self.model)
        plain = not self.model.charsmap and not self.model.squeeze_blanks  # then blanks are all there is to do
        self.normalise = self._marked if plain else normaliser(self.model).normalize_str
        self.tokenizer.normalizer = None  # texts come normalised
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.words = by_words(self.model)
        self.memo: dict[str, bytes] = {}
        self.strange: set[str] = set()  # words with other ids than the library's
        self.lost: set[str] = set()  # words that are not decoded to themselves

    def encode(self, found: list[str]) -> list[tuple[bytes, bool, bool]]:
        """(ids as 32-bit numbers, same ids as sentencepiece's, decoded to the same text) per text."""
        if not self.words:
            normal = [self.normalise(t) for t in found]
            wanted = self.reference.encode(found)
            got = self._ids(normal)
            again = self._decoded(got)
            rows = zip(wanted, got, again, map(self._shown, normal), strict=True)
            return [(packed(g), g == w, a == n) for w, g, a, n in rows]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        split = [WORDS.findall(self.normalise(t)) for t in found]
        self._learn([w for w in set().union(*split) if w not in self.memo])
        get = self.memo.__getitem__
        return [(b"".join(map(get, words)), self.strange.isdisjoint(words), self.lost.isdisjoint(words)) for words in split]

    def _marked(self, text: str) -> str:
        return (MARK if text and self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def _shown(self, normal: str) -> str:
        """What a normalised text reads like when decoded."""
        text = normal.replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def _ids(self, normal: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(normal, add_special_tokens=False)]

    def _decoded(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def _learn(self, new: list[str]) -> None:
        # After a letter a word stands as it does in a text, without the prefix that a text's start gets.
        lead = len(self.reference.encode("x"))
        wanted = [x[lead:] for x in self.reference.encode(["x" + w.replace(MARK, " ") for w in new])]
        got = self._ids(new)
        if got != wanted:
            self.strange.update(w for w, g, x in zip(new, got, wanted, strict=True) if g != x)
        # Words in a row are decoded as in a text; only where that text differs, each by itself.
        starts = range(0, len(new), TOGETHER)
        again = self._decoded([list(chain.from_iterable(got[k : k + TOGETHER])) for k in starts])
        for k, text in zip(starts, again, strict=True):
            some = new[k : k + TOGETHER]
            if text != self._shown("".join(some)):
                self.lost.update(w for w, a in zip(some, self._decoded(got[k : k + TOGETHER]), strict=True) if a != self._shown(w))
        self.memo.update(zip(new, map(packed, got), strict=True))


@lru_cache(maxsize=1)
def codec_of(data: bytes) -> Codec:
    """One codec for all tasks of a Python worker, as it takes half a second to make."""
    return Codec(data)


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def encode(docs: DataFrame, model_path: str, threads: int | None = None) -> DataFrame:
    """(doc_id, ids ARRAY<INT>, n_tokens, parity, round_trip) of every row.

    ``ids`` are those of the rebuilt tokenizer without begin or end; ``parity`` says whether the sentencepiece
    library gives the same, ``round_trip`` whether decoding the ids gives the normalised text again. ``threads``
    of the batch encoder per task are the task's cores if not given.
    """
    threads = threads or int(docs.sparkSession.conf.get("spark.task.cpus", "1"))
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # one file, below a MB here

    def run(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        codec = None
        try:
            for part in few(batches):
                codec = codec or codec_of(shared.value)
                rows = codec.encode(part.column("text").to_pylist())
                sizes = np.array([len(r[0]) // 4 for r in rows], np.int64)
                values = pa.array(np.frombuffer(b"".join(r[0] for r in rows), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)
                flags = [pa.array([r[k] for r in rows], pa.bool_()) for k in (1, 2)]
                yield pa.record_batch([part.column("doc_id"), lists, pa.array(sizes), *flags], ["doc_id", "ids", "n_tokens", "parity", "round_trip"])
        finally:
            if codec:
                codec.memo.clear()  # the codec stays with the worker, which other operators use as well

    return texts(docs).mapInArrow(frugal(run), "doc_id BIGINT, ids ARRAY<INT>, n_tokens BIGINT, parity BOOLEAN, round_trip BOOLEAN")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give null."""
    with open(model_path, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        tokenizer = None
        for batch in batches:
            tokenizer = tokenizer or rebuild(parse(shared.value))
            ids = batch.column("ids").to_pylist()
            found = iter(tokenizer.decode_batch([i for i in ids if i is not None], skip_special_tokens=False))
            yield pa.record_batch([batch.column("doc_id"), pa.array([None if i is None else next(found) for i in ids], pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(ids AS ARRAY<INT>) AS ids").mapInArrow(run, "doc_id BIGINT, text STRING")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
