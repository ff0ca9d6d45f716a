"""Token ids by a public byte-level BPE vocabulary, and a seekable file format for them.

The vocabulary file's path is a parameter. Special-token strings inside a text are ordinary text.
"""

import re
import struct as st
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from meterline.llm.common import by_bytes, documents, fresh_path, map_columns, record_batch, shuffle_partitions, struct, written

END_ID = 2
#: Bytes by kind: white space, letters (and all bytes over 127), other. A chunk is white space with the letters that
#: follow, or with all up to the next white space where that begins otherwise. In this vocabulary's pre-tokenization no
#: piece goes on from other text into white space, nor from a letter into anything but letters, so the ids of a text are
#: those of its chunks, one after another.
LETTER, OTHER, SPACE = 0, 1, 2
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
#: Other characters that count as white space there.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Texts are cut into chunks this many bytes at a time; a single longer text is cut where a chunk begins.
PART_BYTES = 4_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def chunk_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the chunks of the texts that begin at ``starts`` (ascending, none empty) begin in their joined bytes."""
    kind = KIND[data]
    space = kind == SPACE
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    first = first[:-1]
    before = np.concatenate(([False], space[:-1]))
    words = np.flatnonzero(~space & (before | first))
    # in a word that begins with letters, the first other character begins a chunk
    other = np.flatnonzero(kind == OTHER)
    word = np.searchsorted(words, other, side="right") - 1
    lead = np.concatenate(([True], word[1:] != word[:-1])) if len(word) else np.zeros(0, bool)
    turns = other[lead & (other > words[word])] if len(word) else other
    begins = first | (space & ~before)
    begins[turns] = True
    return np.flatnonzero(begins)


class Encoder:
    """UTF-8 texts to ids. Each batch's chunks are made distinct by Arrow; chunks met before come from a dictionary.
    Once its chunks exceed ``capacity`` bytes, counting ``ENTRY`` more for each, it becomes the old one, from which chunks
    that are met again move to a new one (this changes speed only); so a worker, which keeps its encoder, holds two such
    dictionaries at most. Longer chunks than ``LONG`` bytes are never kept. A text with a chunk that might not be cut as said (odd white
    space; a last character over 127 that isn't a letter) is encoded in one piece."""

    LONG, ENTRY = 64, 100

    def __init__(self, path: str, capacity: int = 12_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        #: bytes of each token: in a byte-level vocabulary a character stands for a byte
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.capacity, self.held = capacity, 0
        self.ids: dict[bytes, bytes | None] = {}
        self.old: dict[bytes, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, chunks: list[bytes]) -> dict[bytes, bytes | None]:
        texts = [c.decode() for c in chunks]
        ids = np.array(self.tokenizer.encode_batch_fast([texts], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        cut = [0, *(np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1).tolist()]
        raw = ids.tobytes()
        new: dict[bytes, bytes | None] = {c: raw[4 * i : 4 * j] for c, i, j in zip(chunks, cut, cut[1:], strict=False)}
        new |= dict.fromkeys(c for c, t in zip(chunks, texts, strict=True) if (t[-1] > "\x7f" and not t[-1].isalpha()) or ODD_SPACE.search(t))
        self._keep({c: x for c, x in new.items() if len(c) <= self.LONG})
        return new

    def _keep(self, chunks: dict[bytes, bytes | None]) -> None:
        if self.held > self.capacity:
            self.ids, self.old, self.held = {}, self.ids, 0
        self.held += sum(map(len, chunks)) + self.ENTRY * len(chunks)
        self.ids.update(chunks)

    def _part(self, raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes)
        at = ends - sizes
        begins = chunk_starts(np.frombuffer(raw, np.uint8), at[sizes > 0])
        edges = np.concatenate((begins, [len(raw)])).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        distinct, codes = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
        known = self.ids
        found = [known.get(c) for c in distinct]
        if missing := [c for c, x in zip(distinct, found, strict=True) if x is None and c not in known]:
            old = self.old
            again = {c: old[c] for c in missing if c in old}
            self._keep(again)
            new = again | self._learn(rest) if (rest := [c for c in missing if c not in again]) else again
            found = [new[c] if c in new else x for c, x in zip(distinct, found, strict=True)]
        bounds = np.searchsorted(begins, np.append(at, len(raw)))
        if None in found:
            odd = np.array([x is None for x in found])[codes]
            pieces = []
            for k in range(len(sizes)):
                own = codes[bounds[k] : bounds[k + 1]]
                if odd[bounds[k] : bounds[k + 1]].any():
                    own = np.array([len(found)], codes.dtype)
                    found.append(self.whole(raw[at[k] : ends[k]].decode()))
                pieces.append(own)
            codes, bounds = np.concatenate(pieces), np.concatenate(([0], np.cumsum([len(x) for x in pieces])))
            found = [x or b"" for x in found]
        flat = np.frombuffer(b"".join(found), "<u4")
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, n = (np.cumsum(n) - n)[codes], n[codes]
        upto = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.arange(upto[-1]) + np.repeat(first - upto[:-1], n)]
        return out, np.diff(upto[bounds])

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        out: list[bytes] = []
        part, size = [], 0
        for t in texts:
            t = t or b""
            if part and size + len(t) > PART_BYTES:
                out += self._cut(part)
                part, size = [], 0
            part.append(t)
            size += len(t)
        return out + self._cut(part)

    def _cut(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        if len(texts) == 1 and len(texts[0]) > PART_BYTES:
            return [self._long(texts[0])]
        ids, n = self._part(b"".join(texts), np.fromiter(map(len, texts), np.int64, len(texts)))
        raw, ends = ids.tobytes(), (4 * np.cumsum(n)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _long(self, text: bytes) -> bytes:
        """A text in parts that end where white space begins; in one piece where that holds an odd chunk."""
        if ODD_SPACE.search(text.decode()):
            return self.whole(text.decode())
        out, at = [], 0
        while at < len(text):
            m = SPACE_AFTER.search(text, at + PART_BYTES)
            end = m.start() + 1 if m else len(text)
            out.append(self._part(text[at:end], np.array([end - at]))[0].tobytes())
            at = end
        return b"".join(out)


SPACE_AFTER = re.compile(rb"[^\x09-\x0d\x20](?=[\x09-\x0d\x20])")
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary: a Python worker keeps it, and the chunks it has met, from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# -- files: independent zstandard frames, a document directory, and a trailing seek table --------------------------

#: Fixed values of the public seekable zstandard format: skippable frames, and the magic number that ends the table.
SKIPPABLE_SEEK, SKIPPABLE_DIRECTORY, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1


def _skippable(magic: int, body: bytes) -> bytes:
    return st.pack("<II", magic, len(body)) + body


class ShardWriter:
    """One file: frames of whole documents' ids (a new frame once ``frame_bytes`` are reached), a skippable frame with
    the directory (per document: id, whether there is one, frame, tokens), and a skippable frame with the seek table
    (per frame: compressed bytes, bytes, low 32 bits of the bytes' XXH64)."""

    def __init__(self, out, frame_bytes: int = 1 << 18, level: int = 3):
        self.out, self.frame_bytes, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.pending, self.size, self.table, self.directory, self.tokens = [], 0, [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.directory.append((doc_id or 0, doc_id is not None, len(self.table), len(ids) // 4))
        self.pending.append(ids)
        self.size += len(ids)
        self.tokens += len(ids) // 4
        if self.size >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        raw = b"".join(self.pending)
        packed = self.zstd.compress(raw)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.out.write(packed)
        self.pending, self.size = [], 0

    def close(self) -> None:
        if self.pending:
            self._frame()
        d = list(zip(*self.directory, strict=True)) or [[]] * 4
        body = b"".join(np.array(c, t).tobytes() for c, t in zip(d, ("<i8", "u1", "<u4", "<u4"), strict=True))
        directory = _skippable(SKIPPABLE_DIRECTORY, self.zstd.compress(body) + st.pack("<I", len(self.directory)))
        self.out.write(directory)
        entries = b"".join(st.pack("<III", *x) for x in self.table)
        self.out.write(_skippable(SKIPPABLE_SEEK, entries + st.pack("<IBI", len(self.table), 0, SEEKABLE)))


class ShardReader:
    """Reads the trailing table and the directory, then only the frames asked for; each frame's checksum is tested."""

    def __init__(self, src):
        self.src, size = src, src.size()
        n, _, magic = st.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self.table = np.frombuffer(table, "<u4").reshape(-1, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.table[:, 0], dtype=np.int64)))
        body = self._at(int(self.starts[-1]) + 8, size - 9 - 12 * n - 8 - int(self.starts[-1]) - 8)
        docs = st.unpack("<I", body[-4:])[0]
        raw = zstandard.ZstdDecompressor().decompress(body[:-4]) if docs else b""
        self.doc_id, self.known = np.frombuffer(raw[: 8 * docs], "<i8"), np.frombuffer(raw[8 * docs : 9 * docs], "u1")
        self.frame, self.tokens = np.frombuffer(raw[9 * docs :], "<u4").reshape(2, -1)
        self.held: tuple[int, bytes] = (-1, b"")

    def _at(self, where: int, n: int) -> bytes:
        self.src.seek(where)
        return self.src.read(n)

    def frame_bytes(self, k: int) -> bytes:
        if self.held[0] != k:
            packed, size, check = map(int, self.table[k])
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k}: wrong checksum")
            self.held = (k, raw)
        return self.held[1]

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the file."""
        k = int(self.frame[i])
        first = int(np.searchsorted(self.frame, k))
        lo = int(self.tokens[first:i].sum(dtype=np.int64)) * 4
        return np.frombuffer(self.frame_bytes(k)[lo : lo + 4 * int(self.tokens[i])], "<u4")


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Writes every text's ids and ``end_id`` to seekable files in ascending ``doc_id`` order (null first; equal ids by
    text), one file for each range of ids, and returns the manifest (shard, path, n_docs, n_tokens).

    A null text is the empty text: its document holds the end id alone. A task writes to a name of its own and then
    renames, so a task run again leaves the same file. Other columns are ignored; an empty table gives no file.
    """
    spark = docs.sparkSession
    ordered = docs.select("doc_id", F.col("text").cast("binary").alias("text")).repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ddl = "shard int, path string, n_docs long, n_tokens long"
    arrow, end = to_arrow_schema(struct(ddl)), st.pack("<I", end_id)

    def run(batches):
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        shard = TaskContext.get().partitionId()
        own, final = f"{top}/_{shard:06d}-{uuid.uuid4().hex}", f"{top}/shard-{shard:06d}.zst"
        encode = encoder(vocabulary)
        with store.open_output_stream(own) as out:
            w = ShardWriter(out)
            for batch in batches:
                for part in by_bytes(batch, 1):
                    for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                        w.add(doc_id, ids + end)
            w.close()
        if not w.directory:
            store.delete_file(own)
            return
        store.move(own, final)
        yield record_batch([[shard], [f"{folder}/shard-{shard:06d}.zst"], [len(w.directory)], [w.tokens]], arrow)

    return written(ordered.mapInArrow(run, ddl), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in the whole order), n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    offsets = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    arrow = to_arrow_schema(struct(ddl))

    def run(batches):
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as src:
                    r = ShardReader(src)
                    crc = np.empty(len(r.tokens), np.int64)
                    lo, last = 0, -1
                    for i, (k, n) in enumerate(zip(r.frame.tolist(), r.tokens.tolist(), strict=True)):
                        lo, last = (lo, last) if k == last else (0, k)
                        crc[i] = zlib.crc32(r.frame_bytes(k)[lo : lo + 4 * n])
                        lo += 4 * n
                starts = base + np.concatenate(([0], np.cumsum(r.tokens, dtype=np.int64)[:-1])) if len(crc) else crc
                yield record_batch([pa.array(r.doc_id, mask=r.known == 0), starts, r.tokens.astype(np.int64), crc], arrow)

    return offsets.repartition(shuffle_partitions(manifest.sparkSession), "path").mapInArrow(run, ddl)


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit ids, ``end_id`` last). Null text: the end id alone."""
    end = st.pack("<I", end_id)

    def make():
        encode = encoder(vocabulary)
        return lambda doc_id, text: [doc_id, [x + end for x in encode(text)]]

    return map_columns(docs.select("doc_id", F.col("text").cast("binary")), make, "doc_id long, ids binary")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written as token shards and read back. Null and empty texts hold the end id alone; null ids come first,
    repeated rows one after another; an empty table gives no files and no rows; other columns are left out."""
    folder = fresh_path(spark, "token-shards")
    return read_shards(write_shards(documents(spark, sf_dir), folder, default_vocabulary()))
