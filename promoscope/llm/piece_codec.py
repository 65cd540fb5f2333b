"""SentencePiece encoding with byte spans of the source, and decoding.

A text is normalised by the model's compiled character map: at every place the longest prefix that
the map's double-array trie knows is replaced, anything else is copied, and for every byte of the
normalised text the source byte it comes from is recorded.  White space handling (dummy prefix,
removal of extra spaces, the meta symbol for a space) follows the model's settings.  The library
gives the ids; the pieces then tile the normalised text, and the recorded alignment projects every
piece to a span of bytes of the source.

Defined cases: a null text is empty and has no ids; texts are encoded whole; repeated rows are
encoded alone; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import struct

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import arrow_map, text_or_empty

META = "▁".encode()  # the meta symbol that stands for a space
BROKEN = "�".encode()


def message(data: bytes) -> dict[int, list]:
    """The fields of a protocol buffer message: numbers and byte strings by field number."""
    out: dict[int, list] = {}
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
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at:at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at:at + n], at + n
        out.setdefault(key >> 3, []).append(value)
    return out


class CharacterMap:
    """Longest-prefix replacement by a compiled map: a double-array trie and replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size:] if blob else b""

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix at a place, and what replaces it."""
        units, node, found = self.units, 0, None
        if not units:
            return None
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1]:self.strings.index(b"\0", found[1])]


def character_length(text: bytes, at: int) -> int:
    """Bytes of the UTF-8 character at a place; 0 if it is broken."""
    b = text[at]
    n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
    return n if n and at + n <= len(text) and all(x & 0xC0 == 0x80 for x in text[at + 1:at + n]) else 0


class Normalizer:
    def __init__(self, model: bytes):
        fields = message(model)
        spec = message(fields[3][0]) if 3 in fields else {}
        trainer = message(fields[2][0]) if 2 in fields else {}
        self.map = CharacterMap(spec.get(2, [b""])[-1])
        self.dummy = bool(spec.get(3, [1])[-1])
        self.squeeze = bool(spec.get(4, [1])[-1])
        self.escape = bool(spec.get(5, [1])[-1])
        self.suffix = bool(trainer.get(24, [0])[-1])
        pieces = [message(p) for p in fields.get(1, [])]
        own = [p[1][0] for p in pieces if p.get(3, [1])[-1] == 4]  # user-defined: copied as they are
        self.own = sorted(own, key=len, reverse=True)

    def prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        for p in self.own:
            if text.startswith(p, at):
                return len(p), p
        if got := self.map.longest(text, at):
            return got
        n = character_length(text, at)
        return (n, text[at:at + n]) if n else (1, BROKEN)

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and the source place of each of its bytes and of its end."""
        if not (self.map.units or self.own or self.squeeze or self.suffix):
            return self.plain(text)
        return self.mapped(text)

    def plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map, only spaces change."""
        if not text:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(text, np.uint8)
        places = np.arange(len(raw) + 1)
        if self.escape:
            width = np.where(raw == 0x20, len(META), 1)
            places = np.repeat(places, np.append(width, 1))
            text = text.replace(b" ", META)
        if self.dummy:
            mark = META if self.escape else b" "
            text, places = mark + text, np.concatenate([np.zeros(len(mark), np.int64), places])
        return text, places

    def mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        space = META if self.escape else b" "
        at, n = 0, len(text)
        if self.squeeze:
            while at < n:
                size, said = self.prefix(text, at)
                if said != b" ":
                    break
                at += size
        if at == n:
            return b"", np.asarray([n])
        out, places = bytearray(), []

        def mark() -> None:
            out.extend(space)
            places.extend([at] * len(space))

        if self.dummy and not self.suffix:
            mark()
        spaced = self.squeeze
        while at < n:
            size, said = self.prefix(text, at)
            if self.squeeze and spaced:
                said = said.lstrip(b" ")
            if said:
                for b in said:
                    if b == 0x20:
                        mark()
                    else:
                        out.append(b)
                        places.append(at)
                spaced = said.endswith(b" ")
            at += size
            if not self.squeeze:
                spaced = False
        if self.squeeze:
            while out.endswith(space):
                cut = len(out) - len(space)
                at = places[cut]
                del out[cut:], places[cut:]
        if self.dummy and self.suffix:
            mark()
        return bytes(out), np.asarray([*places, at])


class Codec:
    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = Normalizer(self.sp.serialized_model_proto())
        n = self.sp.get_piece_size()
        self.unknown = self.sp.unk_id()
        self.length = np.asarray([
            1 if self.sp.is_byte(i) else len(self.sp.id_to_piece(i).encode()) for i in range(n)])
        self.said = [str(i) for i in range(n)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1, add_bos=False, add_eos=False)

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """(begin, end) of each piece in bytes of the UTF-8 text."""
        norm, places = self.normalize(text.encode())
        got = np.asarray(ids, np.int64)
        size = self.length[got]
        if (got == self.unknown).any():  # an unknown piece has its own text's length
            proto = self.sp.encode(text, out_type="immutable_proto")
            size = np.asarray([1 if self.sp.is_byte(p.id) else len(p.piece.encode()) for p in proto.pieces])
        ends = np.cumsum(size)
        if (int(ends[-1]) if len(ends) else 0) != len(norm):
            raise ValueError("the pieces do not tile the normalised text")
        bounds = places[np.concatenate([[0], ends]).astype(np.int64)]
        return np.stack([bounds[:-1], bounds[1:]], 1)


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  outputs: tuple[str, ...] = ("ids", "spans", "decoded")) -> DataFrame:
    """One row per row: the id, ``n_tokens``, and what ``outputs`` names.

    ``ids``, ``spans`` (begin and end byte of every piece), ``decoded`` (text from the ids),
    ``ids_sha256`` and ``decoded_sha256`` (hashes of the decimal ids joined by commas and of the
    decoded text), ``n_split`` (pieces whose span is less than a whole character, as byte pieces are).
    """
    kinds = {"ids": T.ArrayType(T.IntegerType()), "spans": T.ArrayType(T.ArrayType(T.LongType())),
             "decoded": T.StringType(), "ids_sha256": T.StringType(),
             "decoded_sha256": T.StringType(), "n_split": T.LongType()}
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()),
                           *(T.StructField(o, kinds[o]) for o in outputs)])
    src = docs.select(F.col(id_col), text_or_empty(F.col(text_col)).alias("__text"))
    decode = bool({"decoded", "decoded_sha256"} & set(outputs))
    align = bool({"spans", "n_split"} & set(outputs))

    def split(text: str, spans: np.ndarray) -> int:
        raw = np.append(np.frombuffer(text.encode(), np.uint8), 0)
        return int(((raw[spans] & 0xC0) == 0x80).any(axis=1).sum()) if len(spans) else 0

    def run(rows: list) -> list:
        c, out = codec(model_path), []
        texts = [t for _, t in rows]
        every = c.encode(texts)
        decoded = c.sp.decode(every) if decode else [""] * len(texts)
        for (i, text), ids, back in zip(rows, every, decoded):
            spans = c.spans(text, ids) if align else None
            made = {
                "ids": lambda: ids, "spans": lambda: spans.tolist(), "decoded": lambda: back,
                "ids_sha256": lambda: sha256(",".join(map(c.said.__getitem__, ids))),
                "decoded_sha256": lambda: sha256(back), "n_split": lambda: split(text, spans),
            }
            out.append((i, len(ids), *(made[o]() for o in outputs)))
        return out

    return arrow_map(src, run, schema)
