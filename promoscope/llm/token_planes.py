"""Token-id files: blocks of ids shuffled into bit or byte planes, compressed plane by plane.

``write_token_files`` encodes every text, ends each document with ``end_id`` and writes the ids in
ascending order of (id, hash of the text) into files of bounded size in the shared folder.  Rows are
dealt to ordered ranges by Spark's range partitioner on (id, text hash, row number), so neither an id
with a third of all rows nor a group of equal rows meets in one task.  A task writes its range from
front to back and holds one block of ids, the words it has encoded lately, and the index of the file it
is writing.  The manifest (one row per file) is written by Spark's own commit, so files of a task that
was lost or ran twice are never listed.

A file is a row of blocks and an index.  A block's ids (32-bit, little-endian) are transposed into 4
byte planes or 32 bit planes, and every plane is a zstandard frame of its own: the upper planes of a
vocabulary's ids are nearly constant and all but vanish.  The index holds each block's place, number of
ids, plane sizes and checksum, and each document's id and number of tokens, so any range of ids is
read by its blocks alone (``TokenFile.ids``).

``read_token_files`` reads the files of a manifest, a file per task, block by block, and gives each
document's first place among all ids, its number of ids and their CRC-32.

Texts are encoded by the ``tokenizers`` library.  For tokenizers that drop white space and never let a
token or a normalisation reach over it (``cut_at_space``), a text is cut at ASCII white space and words
met before are not encoded again; the library encodes each new word once, many at a time.

Defined cases: a null or empty text has the end id alone; null ids come last; rows repeated under one
id are ordered by their texts' hashes (equal rows are alike); a text of any length is cut into blocks
like all others; an empty table gives an empty manifest and no rows; other columns are not read, so
their names do not matter; a damaged file is an error.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.llm.common import parts, ship
from promoscope.sources.files import file_system

MAGIC = b"TPLANES1"
TAIL = struct.Struct("<Q8s")  # length of the index, magic
PLANES = {"byte": 4, "bit": 32}


def to_planes(ids: np.ndarray, kind: str) -> np.ndarray:
    """A row of bytes per plane: plane p holds byte (or bit) p of every id."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return np.ascontiguousarray(octets.T)
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    bits = np.unpackbits(planes, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


# The split of tokenizers that lower-case, drop white space and take runs of letters, single
# digits and runs of other marks as words.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FOLDING = ["NFC", "Replace", "Lowercase"]

# a word that ends in a run of ASCII marks after an ASCII letter or digit; the run is a token split of its own
MARKS = frozenset(bytes([c]) for c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
MARKED = re.compile(rb"(.*[0-9A-Za-z])([!-/:-@\[-`{-~]+)", re.DOTALL)


class Words:
    """Ids of texts as little-endian 32-bit bytes, by the library; words met lately are remembered.

    With ``cut_at_space``, texts are cut at ASCII white space and the distinct new words are encoded, many
    in one call with an added token as the fence between them.  Where the tokenizer's own settings are
    ``FOLDING`` and ``LETTER_RUNS``, marks at a word's end are words of their own, and words of Latin
    letters (below U+0250, where lower case is letter by letter and NFC changes nothing) need neither
    folding nor splitting, so a copy of the tokenizer without these steps encodes them.
    """

    def __init__(self, path: str, cut_at_space: bool, remember: int = 600_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.cut, self.remember = cut_at_space, remember
        added = self.tokenizer.get_added_tokens_decoder()
        plain = all(not (t.normalized or t.lstrip or t.rstrip or t.single_word) for t in added.values())
        self.fence = next(((t.content.encode(), i) for i, t in added.items()), None) if plain else None
        self.mark = re.compile(b"|".join(re.escape(t.content.encode()) for t in added.values()) or b"(?!)")
        self.letters = None
        if plain and letter_runs(json.loads(self.tokenizer.to_str())):
            self.letters = Tokenizer.from_file(path)
            self.letters.normalizer = normalizers.Sequence([])
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            suffix = self.letters.model.end_of_word_suffix
            ends = [i for token, i in self.letters.get_vocab().items() if token.endswith(suffix)]
            self.is_end = np.zeros(self.letters.get_vocab_size() + 1, bool)
            self.is_end[ends] = True
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of every text of a string array without nulls."""
        if not self.cut:
            return self._each([t.encode() for t in texts.to_pylist()])
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        known = listed(coded.dictionary)
        ids = list(map(self.new.get, known))
        missing = [w for w, x in zip(known, ids) if x is None]
        if missing:
            if len(self.new) + len(missing) > self.remember:
                self.old, self.new = self.new, {}
                missing = known
            self._learn(self._unknown(missing))
            ids = [self.new[w] if x is None else x for w, x in zip(known, ids)]
        # the ids of all words in a row: each word's ids lie at its place among those of the known ones
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        place = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        end = np.cumsum(n)
        at = np.repeat(place[which] - (end - n), n) + np.arange(end[-1] if len(end) else 0)
        raw = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        cuts = 4 * np.append(0, end)[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _unknown(self, words) -> list[bytes]:
        """Those that the older generation does not know either; the others pass to the new one."""
        out = []
        for w in words:
            known = self.old.get(w)
            if known is None:
                out.append(w)
            else:
                self.new[w] = known
        return out

    def _learn(self, words: list[bytes]) -> None:
        if self.fence is None:
            self.new.update(zip(words, self._each(words)))
            return
        if self.letters is None:
            self._fenced(words)
            return
        made: dict[bytes, tuple] = {}  # word -> the words that it consists of
        latin, others = set(), set()
        for w in words:
            m = None
            if len(w) > 1000 or self.mark.search(w):
                made[w] = (w,)
                others.add(w)
                continue
            if w[-1:] in MARKS and (m := MARKED.fullmatch(w)):
                others.add(m[2])
            stem = m[1] if m else w
            if stem.isascii():
                stem = stem.lower()
                (latin if stem.isalpha() else others).add(stem)
            else:
                s = stem.decode()
                if max(s) < "\u0250" and "\u0130" not in s:
                    s = s.lower()
                    stem = s.encode()
                    (latin if s.isalpha() else others).add(stem)
                else:
                    others.add(stem)
            made[w] = (stem, m[2]) if m else (stem,)
        self._letter_words(self._unknown(latin.difference(self.new)))
        self._fenced(self._unknown(others.difference(self.new)))
        new = self.new
        for w, made_of in made.items():
            if w not in new:
                new[w] = new[made_of[0]] if len(made_of) == 1 else new[made_of[0]] + new[made_of[1]]

    def _letter_words(self, words: list[bytes], many: int = 5000) -> None:
        """Words of lower-case Latin letters: every word has one token that ends a word, its last one."""
        for at in range(0, len(words), many):
            part = words[at:at + many]
            got = np.asarray(self.letters.encode_batch_fast(
                [b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            self._cut(part, got, np.flatnonzero(self.is_end[got]) + 1, 0)

    def _fenced(self, words: list[bytes], many: int = 5000) -> None:
        """Any words, with an added token between them; words that hold one, or are long, alone."""
        plain = [w for w in words if len(w) <= 1000 and not self.mark.search(w)]
        for at in range(0, len(plain), many):
            part = plain[at:at + many]
            got = np.frombuffer(self._each([self.fence[0].join(part)])[0], "<u4")
            self._cut(part, got, np.append(np.flatnonzero(got == self.fence[1]), len(got)), 1)
        rest = list(set(words).difference(plain))
        self.new.update(zip(rest, self._each(rest)))

    def _cut(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        if len(ends) != len(words):
            raise RuntimeError("the tokenizer does not keep words apart")
        raw = ids.tobytes()
        starts = np.append(0, ends[:-1] + gap)
        self.new.update((w, raw[4 * a:4 * b]) for w, a, b in zip(words, starts.tolist(), ends.tolist()))

    def _each(self, texts: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in got]


def listed(words: pa.Array) -> list[bytes]:
    """The bytes of words without white space, as Python objects."""
    if not len(words):
        return []
    whole = pa.ListArray.from_arrays([0, len(words)], words)
    return pc.binary_join(whole, "\n")[0].as_buffer().to_pybytes().split(b"\n")


def letter_runs(config: dict) -> bool:
    """Whether a tokenizer's settings fold and split as FOLDING and LETTER_RUNS say."""
    def steps(x, name):
        return (x or {}).get(name, [x] if x else [])

    fold = [n["type"] for n in steps(config["normalizer"], "normalizers")]
    split = steps(config["pre_tokenizer"], "pretokenizers")
    return (fold == FOLDING and len(split) == 2
            and split[0].get("pattern") == {"Regex": LETTER_RUNS} and split[0].get("invert") is True
            and split[1]["type"] == "ByteLevel" and not split[1]["use_regex"] and not split[1]["add_prefix_space"]
            and bool(config["model"].get("end_of_word_suffix")))


_WORDS: dict[tuple, Words] = {}  # of this worker process


def words_of(path: str, cut_at_space: bool) -> Words:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    key = (path, cut_at_space)
    if key not in _WORDS:
        _WORDS[key] = Words(path, cut_at_space)
    return _WORDS[key]


class TokenFileWriter:
    """Blocks of ``block_ids`` ids, then the index."""

    def __init__(self, stream, id_type: pa.DataType, planes: str, block_ids: int, level: int = 3):
        self.stream, self.id_type, self.planes, self.block_ids = stream, id_type, planes, block_ids
        self.pack = zstandard.ZstdCompressor(level=level)
        self.waiting: list[bytes] = []
        self.n_waiting = self.n_ids = 0
        self.blocks: list[tuple] = []
        self.doc_ids: list = []
        self.doc_tokens: list[int] = []
        self.place = len(MAGIC)
        stream.write(MAGIC)

    def document(self, doc_id, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.doc_tokens.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.n_waiting >= self.block_ids:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        raw = memoryview(b"".join(self.waiting))
        size = 4 * self.block_ids
        at = 0
        while len(raw) - at >= size or (last and at < len(raw)):
            piece = raw[at:at + size]
            ids = np.frombuffer(piece, "<u4")
            frames = [self.pack.compress(p) for p in to_planes(ids, self.planes)]
            for f in frames:
                self.stream.write(f)
            self.blocks.append((self.place, len(ids), zlib.crc32(piece), [len(f) for f in frames]))
            self.place += sum(map(len, frames))
            at += len(piece)
        self.waiting = [bytes(raw[at:])]
        self.n_waiting = (len(raw) - at) // 4

    def close(self) -> int:
        """Write what is left and the index; the file's size."""
        self._blocks(last=True)
        place, n, crc, sizes = map(list, zip(*self.blocks)) if self.blocks else ([], [], [], [])
        blocks = pa.table({"place": pa.array(place, pa.int64()), "n_ids": pa.array(n, pa.int64()),
                           "crc32": pa.array(crc, pa.int64()), "sizes": pa.array(sizes, pa.list_(pa.int64()))})
        docs = pa.table({"id": pa.array(self.doc_ids, self.id_type),
                         "n_tokens": pa.array(self.doc_tokens, pa.int64())})
        index = b"".join(ipc_bytes(t) for t in (blocks.replace_schema_metadata({"planes": self.planes}), docs))
        index = self.pack.compress(index)
        self.stream.write(index + TAIL.pack(len(index), MAGIC))
        self.stream.close()
        return self.place + len(index) + TAIL.size


def ipc_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    raw = sink.getvalue().to_pybytes()
    return struct.pack("<Q", len(raw)) + raw


class TokenFile:
    """A token file that is open for reading (``stream`` can seek)."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - TAIL.size)
        length, magic = TAIL.unpack(stream.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        stream.seek(size - TAIL.size - length)
        index = zstandard.ZstdDecompressor().decompress(stream.read(length))
        tables = []
        while index:
            n = struct.unpack_from("<Q", index)[0]
            tables.append(pa.ipc.open_stream(index[8:8 + n]).read_all())
            index = index[8 + n:]
        self.blocks, self.docs = tables
        self.planes = self.blocks.schema.metadata[b"planes"].decode()
        self.n_of = self.blocks["n_ids"].to_pylist()
        self.ends = np.cumsum(self.n_of, dtype=np.int64)
        self.places, self.sums = self.blocks["place"].to_pylist(), self.blocks["crc32"].to_pylist()
        self.sizes = self.blocks["sizes"].to_pylist()

    def block(self, b: int) -> np.ndarray:
        self.stream.seek(self.places[b])
        raw, at, rows = self.stream.read(sum(self.sizes[b])), 0, []
        unpack = zstandard.ZstdDecompressor()
        for size in self.sizes[b]:
            rows.append(np.frombuffer(unpack.decompress(raw[at:at + size]), np.uint8))
            at += size
        ids = from_planes(np.stack(rows), self.n_of[b], self.planes)
        if zlib.crc32(ids.tobytes()) != self.sums[b]:
            raise ValueError(f"block {b} does not have its checksum")
        return ids

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` .. ``start + n`` of the file, from the blocks that hold them."""
        out = []
        b = int(np.searchsorted(self.ends, start, "right"))
        while n > 0 and b < len(self.ends):
            first = int(self.ends[b]) - self.n_of[b]
            piece = self.block(b)[start - first:start - first + n]
            out.append(piece)
            start, n, b = start + len(piece), n - len(piece), b + 1
        return np.concatenate(out) if out else np.empty(0, "<u4")

    def documents(self, with_ids: bool = False) -> Iterator[tuple]:
        """(id, start in the file, number of ids, CRC-32 of the ids, ids or None), block by block."""
        block, b, used, start = b"", -1, 0, 0
        for doc_id, n in zip(self.docs["id"].to_pylist(), self.docs["n_tokens"].to_pylist()):
            crc, left, kept = 0, 4 * n, []
            while left:
                if used == len(block):
                    b, used = b + 1, 0
                    if b >= len(self.n_of):
                        raise ValueError("the file has fewer ids than its documents")
                    block = self.block(b).tobytes()
                piece = memoryview(block)[used:used + left]
                crc = zlib.crc32(piece, crc)
                if with_ids:
                    kept.append(bytes(piece))
                used, left = used + len(piece), left - len(piece)
            yield doc_id, start, n, crc, b"".join(kept) if with_ids else None
            start += n


MANIFEST = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("part", T.IntegerType()),
    T.StructField("number", T.IntegerType()), T.StructField("n_docs", T.LongType()),
    T.StructField("n_ids", T.LongType()), T.StructField("n_bytes", T.LongType()),
])


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = 1, cut_at_space: bool = True,
                      planes: str = "byte", block_ids: int = 1 << 16, range_bytes: int = 16 << 20,
                      file_ids: int = 64 << 20) -> DataFrame:
    """Write the ids of all texts below ``folder`` (shared by all executors); returns the manifest.

    ``range_bytes`` is the text that a task gets, about; a task starts a new file after ``file_ids`` ids.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if planes not in PLANES:
        raise ValueError(f"planes is one of {sorted(PLANES)}")
    spark = docs.sparkSession
    ship(spark)
    schema = to_arrow_schema(MANIFEST)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    ranges = max(1, -(-n_bytes // range_bytes))
    src = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"),
        F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_last(), "tie"]
    dealt = src.repartitionByRange(ranges, *order, "row").sortWithinPartitions(*order).select("id", "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = file_system(f"{folder}/ids")
        where.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()  # ranges are numbered in order
        name = f"{part:06d}-{uuid.uuid4().hex[:12]}"  # of this attempt alone
        words = words_of(tokenizer, cut_at_space)
        made, out = [], None

        def close() -> None:
            if out is not None:
                made[-1] += [len(out.doc_ids), out.n_ids, out.close()]

        for batch in batches:
            for piece in parts(batch):
                for doc_id, ids in zip(piece.column(0).to_pylist(), words.encode(piece.column(1))):
                    if out is None or out.n_ids >= file_ids:
                        close()
                        file = f"{name}-{len(made):04d}.tpl"
                        out = TokenFileWriter(where.open_output_stream(f"{base}/{file}"),
                                              batch.schema.field(0).type, planes, block_ids)
                        made.append([f"{folder}/ids/{file}", part, len(made)])
                    out.document(doc_id, ids + end)
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[i] for m in made], f.type) for i, f in enumerate(schema)], schema=schema)

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame, id_type: T.DataType = T.LongType(),
                     with_ids: bool = False) -> DataFrame:
    """Per document: ``id``, ``start`` (ids before it in all files), ``n_tokens``, ``ids_crc32``, and
    ``ids`` (little-endian 32-bit) if asked for."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(spark)
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    arrow = to_arrow_schema(schema)
    # a row per file: the window is over the manifest alone
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", "n_bytes", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, base in zip(*(c.to_pylist() for c in batch.columns)):
                where, name = file_system(path)
                with where.open_input_file(name) as stream:
                    rows, held = [], 0
                    for doc_id, start, n, crc, ids in TokenFile(stream, size).documents(with_ids):
                        rows.append((doc_id, base + start, n, crc, ids)[:len(arrow)])
                        held += 64 + len(ids or b"")
                        if held > 4 << 20:
                            yield batch_of(rows, arrow)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows, arrow)

    n = max(1, manifest.count())
    return files.repartition(n).mapInArrow(run, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
