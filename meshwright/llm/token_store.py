"""Token ids as independent zstandard frames with a trailing seek table.

File layout (the public seekable zstandard layout plus one extra skippable frame)::

    frame 0 .. frame n-1      token ids, little endian, whole documents, checksummed
    skippable 0x184D2A5D      document index: ids, frame of each, offset, length
    skippable 0x184D2A5E      seek table: (compressed, decompressed, xxh64 low 32 bits) * n, footer

A reader loads the two trailing parts and decompresses only the frames that hold the
documents asked for. Every frame carries zstandard's own checksum and the table's.

Defined cases: a null text is an empty one, so a document has at least the end id; an
empty table yields no file and no rows; a very long text makes one large frame; rows that
repeat a doc_id are kept, ordered by their text; a null doc_id sorts first; other columns
of the input are ignored. Writers are tasks: each attempt writes a file of its own name and
only the attempt that Spark commits is named in the manifest, so lost executors leave at
most unreferenced files.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm.common import materialize, open_fs, shared_folder, small_arrow_batches

SEEK_MAGIC, INDEX_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
FRAME_BYTES = 1 << 18
NULL_ID = -(1 << 63)
#: A run of Latin letters, then ASCII signs but no apostrophe: the vocabulary's pre-tokenizer parts just these two.
SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+)([!-&(-/:-@\\[-`{-~]*)")


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()
ODD_SPACE = re.compile("[\x1c-\x1f]")


class FrameWriter:
    """Writes documents of token ids to a binary stream."""

    def __init__(self, out: BinaryIO, width: int = 2, frame_bytes: int = FRAME_BYTES, level: int = 1):
        self.out, self.width, self.limit = out, width, frame_bytes
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.open: list[bytes] = []
        self.size = 0
        self.seek: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.where: list[tuple[int, int, int]] = []
        self.n_tokens = 0

    def add(self, doc_id: int, payload: bytes) -> None:
        if self.size and self.size + len(payload) > self.limit:
            self._flush()
        self.ids.append(doc_id)
        self.where.append((len(self.seek), self.size, len(payload)))
        self.open.append(payload)
        self.size += len(payload)
        self.n_tokens += len(payload) // self.width

    def _flush(self) -> None:
        raw = b"".join(self.open)
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.open, self.size = [], 0

    def close(self) -> None:
        if self.size or self.open:
            self._flush()
        where = np.array(self.where, "<u8").reshape(-1, 3)
        body = struct.pack("<BQ", self.width, len(self.ids)) + self.zip.compress(
            np.array(self.ids, "<i8").tobytes() + where.T.tobytes()
        )
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        table = b"".join(struct.pack("<III", *x) for x in self.seek)
        table += struct.pack("<IBI", len(self.seek), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class FrameReader:
    """Reads documents back; frames are decompressed when asked for and verified."""

    def __init__(self, src: BinaryIO, size: int):
        self.src = src
        self.unzip = zstandard.ZstdDecompressor()
        src.seek(size - 9)
        frames, _, magic = struct.unpack("<IBI", src.read(9))
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table at the end of the file")
        src.seek(size - 9 - 12 * frames)
        self.seek = np.frombuffer(src.read(12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.seek[:, 0])]).astype(np.int64)
        src.seek(int(self.starts[-1]))
        magic, length = struct.unpack("<II", src.read(8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index where the frames end")
        body = src.read(length)
        self.width, n = struct.unpack_from("<BQ", body)
        raw = self.unzip.decompress(body[9:])
        self.ids = np.frombuffer(raw, "<i8", n)
        self.frame, self.offset, self.length = np.frombuffer(raw, "<u8", 3 * n, 8 * n).reshape(3, n).astype(np.int64)
        self.decompressed = 0
        self._held: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self._held[0] != k:
            self.src.seek(int(self.starts[k]))
            raw = self.unzip.decompress(self.src.read(int(self.seek[k, 0])))
            if len(raw) != self.seek[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek[k, 2]:
                raise ValueError(f"frame {k} fails its checksum")
            self.decompressed += 1
            self._held = (k, raw)
        return self._held[1]

    def at(self, position: int) -> np.ndarray:
        raw, o, n = self._frame(int(self.frame[position])), int(self.offset[position]), int(self.length[position])
        return np.frombuffer(raw[o : o + n], f"<u{self.width}")

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every row of a document, mostly one."""
        return [self.at(int(i)) for i in np.flatnonzero(self.ids == doc_id)]

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for i, doc in enumerate(self.ids):
            yield int(doc), self.at(i)


class WordEncoder(dict):
    """word -> its ids as bytes; a word is encoded by the tokenizers library when first met.

    The vocabulary's pre-tokenizer drops white space and no token spans it, so ids of a text
    are the ids of its space-separated words in order. Runs of Latin letters go straight to
    the library's model, anything else through its whole pipeline. Two generations of words
    are held: when the young one is full it becomes the old one, from which words return.
    """

    def __init__(self, path: str, limit: int = 300_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's pool would spin on others
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.limit, self.old = limit, {}
        self.texts: dict[str, bytes] = {}  # the last whole texts, for copies
        self.code = "H" if self.tok.get_vocab_size() <= 65536 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def stem(self, low: str) -> bytes:
        """Ids of one lower-case run of Latin letters."""
        seen = low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_CHARS)
        return array(self.code, [t.id for t in self.model.tokenize(seen)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            simple = SIMPLE.fullmatch(word)
            if simple is None:
                found = self.whole(word)
            else:
                letters, signs = simple.groups()
                low = letters.lower()
                found = self.stem(low) if low == word else self[low]
                if signs:
                    found += self[signs] if signs != word else b""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        look, out = self.__getitem__, []
        for t in texts:
            got = b"" if not t else self.texts.get(t)
            if got is None:
                # str.split also parts at U+001C..U+001F, which the vocabulary does not take for white space
                words = t.split() if not ODD_SPACE.search(t) else filter(None, t.replace("\n", " ").split(" "))
                got = b"".join(map(look, words))
                if len(self.texts) >= 1000:
                    self.texts.clear()
                self.texts[t] = got
            out.append(got)
        return out


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One encoder a worker process, so tasks that follow find the words of those before."""
    return WordEncoder(path)


#: Texts on which a vocabulary must give the ids of its space-separated words, or it is refused.
PROBES = (
    "Hello, World!  two  spaces\tand a tab\nand a line", "it's 12,345.67 a.b@c.org x_y-z (q) [r] {s}", "naïve Äpfel ŒUVRE señor ÉCOLE straße",
    "</s> <s>[INST] ok [/INST] <<SYS>>", "日本語 текст עברית 🙂🙂 e\u0301", " lead and trail ", "",
)


def refuse_others(path: str) -> None:
    """An error for a vocabulary whose ids of a text are not those of its words in order."""
    words = encoder_of(path)
    for text in PROBES:
        if words.encode([text])[0] != words.whole(text):
            raise ValueError(f"{path}: tokens span white space, so texts cannot be encoded by words")


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode (doc_id, text) and write one file per range of doc_id.

    Returns the manifest: part, path, n_docs, n_tokens, first_id; parts ascend with doc_id.
    """
    spark = docs.sparkSession
    refuse_others(tokenizer_path)
    small_arrow_batches(spark, 500)
    folder = shared_folder(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = out = None
        part = TaskContext.get().partitionId()
        first = None
        for batch in batches:
            if writer is None:
                encoder = encoder_of(tokenizer_path)
                fs, inner = open_fs(folder)
                fs.create_dir(inner, recursive=True)
                path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.zst"
                out = fs.open_output_stream(open_fs(path)[1], compression=None)
                writer = FrameWriter(out, encoder.dtype.itemsize, frame_bytes)
                end = np.array([end_id], encoder.dtype).tobytes()
            ids = batch.column("doc_id").to_pylist()
            first = ids[0] if first is None else first
            for doc, payload in zip(ids, encoder.encode(batch.column("text").to_pylist()), strict=True):
                writer.add(NULL_ID if doc is None else doc, payload + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "path": [path], "n_docs": [len(writer.ids)], "n_tokens": [writer.n_tokens], "first_id": [first]},
                schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64())]),
            )

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(write, "part long, path string, n_docs long, n_tokens long, first_id long")
    return materialize(made, "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read files back: doc_id, start, n_tokens, ids_crc32 of every stored document.

    ``start`` adds the ids of all files before (a running sum over the manifest, one row a
    file) to those before it in its own.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = materialize(manifest.select("part", "path", before.alias("base")), "bases")
    n = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, inner = open_fs(path)
                with fs.open_input_file(inner) as src:
                    reader = FrameReader(src, src.size())
                    lengths = reader.length // reader.width
                    starts = base + np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
                    crcs = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in reader), np.int64, len(lengths))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.ids, mask=reader.ids == NULL_ID), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crcs)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = files.repartitionById(n, F.col("part").cast("int") % F.lit(n))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Token ids of the wanted doc_ids only; frames that hold none of them stay compressed.

    ``wanted`` is one column doc_id; it is matched to files by their ranges of ids. A null matches nothing.
    """
    ranges = materialize(
        manifest.select("path", F.coalesce("first_id", F.lit(NULL_ID)).alias("first_id"), F.lead("first_id").over(Window.orderBy("part")).alias("next_id")), "ranges"
    )
    hits = (
        wanted.select("doc_id").distinct()
        .join(ranges, (F.col("doc_id") >= F.col("first_id")) & (F.col("next_id").isNull() | (F.col("doc_id") <= F.col("next_id"))))
        .repartition("path").sortWithinPartitions("path", "doc_id").select("path", "doc_id")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, src, reader = None, None, None
            ids, tokens = [], []
            for path, doc in zip(batch.column("path").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                if path != held:
                    if src is not None:
                        src.close()
                    fs, inner = open_fs(path)
                    src, held = fs.open_input_file(inner), path
                    reader = FrameReader(src, src.size())
                for row in reader.get(doc):
                    ids.append(doc)
                    tokens.append(row.astype(np.int64).tolist())
            if src is not None:
                src.close()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return hits.mapInArrow(read, "doc_id long, ids array<long>")
