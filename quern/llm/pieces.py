"""SentencePiece encoding with byte offsets, and decoding.

Normalisation is done here: at each position the longest prefix that the model's compiled
character map holds is replaced, and every byte made remembers the span of source bytes
that it came from. White space becomes U+2581 and a dummy prefix is added as the model
says. As no piece of a checked model runs from a word into the next word's U+2581, words
merge on their own: each distinct word is merged once by the sentencepiece library and
kept in a bounded cache, and a text's ids are those of its words. Every piece's bytes in
the normalised text then point back to the source.

Defined results: a null or empty text has the begin and end ids alone and decodes to an
empty text. Begin and end ids have empty spans at 0 and at the text's end. Rows are
independent; repeated rows repeat. Memory is bounded by the longest text. Models that
can't be split this way (white space as suffix, no byte fallback, unigrams) are refused.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import map_batches

SPACE = "▁"
#: Words kept per Python worker, and the longest that is kept, in characters.
CACHE_WORDS = 1 << 17
CACHE_CHARS = 48
#: Bytes of text, or of ids, that a worker takes at once; one longer text is taken alone.
STEP_BYTES = 1 << 19
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(raw: bytes):
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + size]
            at += size


class CharacterMap:
    """The compiled map of a normaliser: a double-array trie over UTF-8, and the replacements."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.replacements = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of raw[at:] in the map."""
        units, found = self.units, None
        node = self._offset(units[0])
        for length, byte in enumerate(raw[at : at + 64], 1):
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = length, units[node] & 0x7FFFFFFF
        if not found:
            return None
        start = found[1]
        return found[0], self.replacements[start : self.replacements.index(0, start)]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class Normaliser:
    """Normalisation with source alignment, by the model's own settings."""

    def __init__(self, spec: bytes):
        found = dict(_fields(spec))
        self.map = CharacterMap(found[2]) if found.get(2) else None
        self.prefix, self.squeeze, self.escape = (bool(found.get(k, 1)) for k in (3, 4, 5))

    def __call__(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The normalised text and, for each of its UTF-8 bytes, where the source bytes that made it begin and end."""
        raw = text.encode()
        if self.map is None and not self.squeeze and self.escape:
            return self._plain(text, raw)
        return self._mapped(raw)

    def _plain(self, text: str, raw: bytes) -> tuple[str, np.ndarray, np.ndarray]:
        if not raw:
            return "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        made = text.replace(" ", SPACE)
        start = np.repeat(np.arange(len(raw)), np.where(np.frombuffer(raw, np.uint8) == 0x20, 3, 1))
        stop = start + 1
        if self.prefix:
            made, start, stop = SPACE + made, np.concatenate([[0, 0, 0], start]), np.concatenate([[0, 0, 0], stop])
        return made, start, stop

    def _chunks(self, raw: bytes):
        at = 0
        while at < len(raw):
            hit = self.map.longest(raw, at) if self.map else None
            if hit:
                size, made = hit
            else:
                lead = raw[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                made = raw[at : at + size]
            yield at, at + size, made
            at += size

    def _mapped(self, raw: bytes) -> tuple[str, np.ndarray, np.ndarray]:
        out, start, stop = bytearray(), [], []
        space = SPACE.encode() if self.escape else b" "

        def put(made: bytes, a: int, b: int) -> None:
            out.extend(made)
            start.extend([a] * len(made))
            stop.extend([b] * len(made))

        begun = after_space = False
        for a, b, made in self._chunks(raw):
            if not begun:
                if self.squeeze and not made.strip(b" "):
                    continue
                if self.squeeze:
                    made = made.lstrip(b" ")
                if self.prefix:
                    put(space, a, a)
                begun, after_space = True, self.squeeze
            if self.squeeze and after_space:
                made = made.lstrip(b" ")
            if made:
                put(made.replace(b" ", space), a, b)
                after_space = made.endswith(b" ")
        while self.squeeze and out.endswith(space) and len(out) > 0:
            del out[-len(space) :], start[-len(space) :], stop[-len(space) :]
        return out.decode(errors="replace"), np.array(start, np.int64), np.array(stop, np.int64)


class Pieces:
    """A checked model: words to packed ids and piece lengths, ids to text."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = list(_fields(self.sp.serialized_model_proto()))
        trainer = dict(_fields(next(v for k, v in model if k == 2)))
        self.normalise = Normaliser(next((v for k, v in model if k == 3), b""))
        pieces = [dict(_fields(v)) for k, v in model if k == 1]
        text = [p[1].decode() for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]
        if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24) or 4 in kinds or not self.normalise.prefix or any(SPACE in t.lstrip(SPACE) for t in text):
            raise ValueError("this model's words don't merge on their own")
        self.lengths = np.array([1 if kind == 6 else 0 if kind == 3 else len(t.encode()) for t, kind in zip(text, kinds, strict=True)], np.int64)
        self.words: dict[str, bytes] = {}
        self.lone = self.sp.piece_to_id(SPACE)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids of normalised texts, with begin and end."""
        split = [_WORD.findall(t) for t in texts]
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        new = list({w for words in split for w in words} - known.keys())
        own: dict[str, bytes] = {}
        # the library adds a dummy U+2581 itself: each word is given without its first one
        made = self.sp.encode([w[1:] for w in new], num_threads=1)
        made = [ids if len(word) > 1 else [self.lone] for word, ids in zip(new, made, strict=True)]
        flat = np.fromiter(chain.from_iterable(made), "<u4").tobytes()
        at = 0
        for word, ids in zip(new, made, strict=True):
            (known if len(word) <= CACHE_CHARS else own)[word] = flat[at : (at := at + 4 * len(ids))]
        both = {**known, **own} if own else known
        begin, end = (np.array([x], "<u4").tobytes() for x in (self.sp.bos_id(), self.sp.eos_id()))
        return [begin + b"".join(map(both.__getitem__, words)) + end for words in split]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        """Packed ids, and the first and last byte of each piece's source span."""
        normal = [self.normalise(t) for t in texts]
        out = []
        for text, (_, start, stop), ids in zip(texts, normal, self.ids([n[0] for n in normal]), strict=True):
            length = self.lengths[np.frombuffer(ids, "<u4")]
            to = np.cumsum(length)
            if to[-1] != len(start):
                raise ValueError("pieces don't tile the normalised text")
            size = len(text.encode())
            start, stop = np.append(start, size), np.append(0, stop)
            begins = start[to - length]
            ends = np.where(length > 0, stop[to], begins)
            out.append((ids, begins.astype("<u4").tobytes(), ends.astype("<u4").tobytes()))
        return out

    def decode(self, packed: list[bytes]) -> list[str]:
        return self.sp.decode([np.frombuffer(x, "<u4").tolist() for x in packed], num_threads=1)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(key, ids, begins, ends): packed little-endian 32-bit ids and source byte spans of every text; with ``decoded`` also the text of those ids."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = pieces(model_path)
        made = model.encode([x or "" for x in batch.column(1).to_pylist()])
        columns = [pa.array([m[k] for m in made], pa.binary()) for k in range(3)]
        if decoded:
            columns.append(pa.array(model.decode([m[0] for m in made]), pa.string()))
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "ids", "begins", "ends", "decoded"][: len(columns) + 1])

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, ids binary, begins binary, ends binary" + (", decoded string" if decoded else "")
    made = map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), step, schema, "text", STEP_BYTES)
    return made.withColumnRenamed("key", key)


def decode(df: DataFrame, model_path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded): the text of packed ids; null ids give a null text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = batch.column(1).to_pylist()
        made = iter(pieces(model_path).decode([x for x in packed if x is not None]))
        column = pa.array([None if x is None else next(made) for x in packed], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], ["key", "ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    made = map_batches(df.select(F.col(key).alias("key"), F.col(ids).alias("ids")), step, f"key {kind}, ids binary, decoded string", "ids", STEP_BYTES)
    return made.withColumnRenamed("key", key)


def encode_digest(df: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes every text, decodes the ids and returns digests of ids, spans and decoded texts.

    One pass through Python: with a second one each task holds two workers, and those stay for the next job's tasks.
    """
    return encode(df, model_path, text, key, decoded=True).select(
        key,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"),
    )
