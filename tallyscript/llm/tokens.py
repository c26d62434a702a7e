"""Token-ID output: fixed-length sequences and masks in Arrow IPC files, read again by random access.

A shard is one Arrow IPC file whose record batches hold fixed-size lists: `ids` (the sequence, as uint16 where the vocabulary has at most 65,536 ids, else uint32) and `mask`
(true where an id is real). All batches of a shard but the last have the same number of rows, so position p of a
shard lies in sequence p // length, and that in batch (p // length) // batch_rows: reading it maps the file and
copies nothing. Shards hold the documents in ascending doc_id order, shard after shard; only a shard's last
sequence is padded. The manifest has a row per shard with the ids before it, and the index one per document.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscript.llm.common import new_path, slices, table, written

#: Ids in a sequence, sequences in a record batch.
LENGTH, BATCH_ROWS = 2048, 64
#: Id after each document.
END_ID = 1
#: Bytes of text for which a shard is planned.
SHARD_BYTES = 16 << 20
#: Pieces that a worker remembers (some 70 bytes each); when there are more, it starts anew.
REMEMBERED = 2_000_000

#: The piece pattern of the tokenizer file, and the byte-level alphabet's printable bytes.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PIECES.pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

#: Words for which lower-casing and composing act on each character alone.
SIMPLE = regex.compile(r"[!-~\xc0-įĲ-ɏ]*")
#: Class of each byte: 0 white space, 1 letter, 2 digit, 3 other, 4 what keeps its word whole; and A-Z in lower case.
CLASS = bytes(4 if b > 127 or chr(b) in "'<" else 0 if chr(b) in " \t\n\v\f\r" else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Odd factors of the piece hash, masks of the first n bytes of eight, and the table's size.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SLOTS = 1 << 23


def byte_alphabet() -> dict[int, str]:
    """A visible character for each byte: printable ones stand for themselves, the others for 256 upward."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Texts to ids by the tokenizers library, each distinct piece once.

    The tokenizer cuts a text into pieces by character class and encodes each for itself. Pieces of plain ASCII words are
    cut here on arrays of bytes; a word with any other character, an apostrophe or `<|` stays whole and goes through
    the library's own rules. Pieces are looked up by a hash and compared: up to 24 bytes by themselves, longer ones by 128 bits
    of a digest. Unseen pieces go to the library. With a tokenizer of other rules, whole texts go to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        known = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER and rules["post_processor"] is None
        self.by_piece = known and all(t["content"].startswith("<|") for t in rules["added_tokens"])
        self.alphabet = byte_alphabet()
        self.forget()

    def forget(self) -> None:
        self.slots = np.full(SLOTS, -1, np.int32)
        self.pieces = np.empty((0, 4), np.uint64)
        self.counts, self.starts, self.ids = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, "<u4")

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; bytes that are no UTF-8 are encoded as replacement characters."""
        texts = [readable(t) for t in texts]
        if not self.by_piece:
            return [packed(e.ids) for e in self.library.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
        kind, low = np.frombuffer(bytearray(joined.translate(CLASS)), np.uint8), np.frombuffer(bytearray(joined.translate(LOWER) + bytes(24)), np.uint8)
        whole = np.flatnonzero(kind == 4)
        if len(whole):
            spaces = np.flatnonzero(kind == 0)
            after = np.unique(np.searchsorted(spaces, whole))
            edge = np.zeros(len(data) + 1, np.int8)
            edge[np.where(after > 0, spaces[after - 1] + 1, 0)] += 1
            edge[spaces[after]] -= 1
            inside = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
            kind[inside] = 4
            low[inside] = data[inside]
        first = np.empty(len(data), bool)
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first |= kind == 2
        cuts = np.flatnonzero(first)
        kinds, sizes = kind[cuts], np.diff(cuts, append=len(data))
        real = kinds != 0
        cuts, sizes, kinds = cuts[real], sizes[real], kinds[real]
        rows = self.rows(low, cuts, sizes, kinds)
        counts = self.counts[rows]
        total = np.append(0, np.cumsum(counts, dtype=np.int64))
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.starts[rows] - total[:-1], counts)]
        bounds = total[np.searchsorted(cuts, ends_of_texts)].tolist()
        return [ids[s:e].tobytes() for s, e in zip([0, *bounds[:-1]], bounds, strict=True)]

    def rows(self, low: np.ndarray, cuts: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The row of each piece's ids: an open-addressed table, by a hash of up to 24 bytes, the length and the kind."""
        eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
        pieces = np.zeros((len(cuts), 4), np.uint64)  # 24 bytes, and the length with the kind
        pieces[:, 3] = sizes.astype(np.uint64) * np.uint64(8) + kinds
        key = pieces[:, 3] * MIX[3]
        for k in range(3):
            some = np.flatnonzero(sizes > 8 * k)
            pieces[some, k] = eight[cuts[some] + 8 * k] & KEEP[np.minimum(sizes[some] - 8 * k, 8)]
        for i in np.flatnonzero(sizes > 24).tolist():
            digest = xxhash.xxh3_128_intdigest(low[cuts[i] : cuts[i] + sizes[i]].tobytes())
            pieces[i, 0], pieces[i, 1] = digest >> 64, digest & (1 << 64) - 1
        for k in range(3):
            key += pieces[:, k] * MIX[k]
            key ^= key >> np.uint64(29)
        key *= MIX[0]
        if len(self.pieces) > REMEMBERED:
            self.forget()
        rows = self.find(key, pieces)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            _, one = np.unique(pieces[missing].view([("", np.uint64)] * 4).ravel(), return_index=True)
            one = missing[one]
            made = [self.piece(low[c : c + n].tobytes(), k) for c, n, k in zip(cuts[one].tolist(), sizes[one].tolist(), kinds[one].tolist(), strict=True)]
            self.remember(key[one], pieces[one], made)
            rows[missing] = self.find(key[missing], pieces[missing])
        return rows

    def find(self, key: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        rows, open_, step = np.full(len(key), -1, np.int32), np.arange(len(key)), 0
        while len(open_):
            at = self.slots[((key[open_] >> np.uint64(20)) + np.uint64(step)) & np.uint64(SLOTS - 1)]
            taken = at >= 0
            open_, at = open_[taken], at[taken]
            same = (self.pieces[at] == pieces[open_]).all(1)
            rows[open_[same]] = at[same]
            open_, step = open_[~same], step + 1
        return rows

    def remember(self, new: np.ndarray, pieces: np.ndarray, made: list[list[int]]) -> None:
        counts = np.fromiter(map(len, made), np.int32, len(made))
        rows = np.arange(len(self.counts), len(self.counts) + len(made), dtype=np.int32)
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts, dtype=np.int64) - counts)
        self.counts, self.pieces = np.append(self.counts, counts), np.append(self.pieces, pieces, axis=0)
        self.ids = np.append(self.ids, np.fromiter((i for m in made for i in m), "<u4", counts.sum()))
        step = 0
        while len(rows):
            slot = ((new >> np.uint64(20)) + np.uint64(step)) & np.uint64(SLOTS - 1)
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rows[free]
            left = self.slots[slot] != rows
            new, rows, step = new[left], rows[left], step + 1

    def piece(self, piece: bytes, kind: int) -> list[int]:
        if kind != 4:
            return [t.id for t in self.model.tokenize("".join([self.alphabet[b] for b in piece]) if kind == 3 else piece.decode())]
        if SIMPLE.fullmatch(word := piece.decode()) and "<|" not in word:
            return [t.id for p in PIECES.findall(word.lower()) for t in self.model.tokenize("".join([self.alphabet[b] for b in p.encode()]))]
        return self.library.encode(word, add_special_tokens=False).ids


def readable(text: bytes) -> bytes:
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode(errors="replace").encode()


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, as loading the vocabulary takes long."""
    return Encoder(path)


def schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", pa.uint32() if wide else pa.uint16(), False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])


class ShardWriter:
    """Writes ids in sequences; holds one record batch. The file takes its name when it is complete."""

    def __init__(self, uri: str, length: int, batch_rows: int, wide: bool):
        self.store, self.path = fs.FileSystem.from_uri(uri)
        self.length, self.size, self.schema, self.kind = length, length * batch_rows, schema(length, wide), "<u4" if wide else "<u2"
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.store.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.store.open_output_stream(self.part)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.held: list[bytes] = []
        self.n_held = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.size:
            joined = np.frombuffer(b"".join(self.held), "<u4")
            whole = len(joined) // self.size * self.size
            for at in range(0, whole, self.size):
                self.write(joined[at : at + self.size])
            self.held, self.n_held = [joined[whole:].tobytes()], len(joined) - whole

    def write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        full = np.zeros(rows * self.length, self.kind)
        full[: len(ids)] = ids
        mask = np.arange(len(full)) < len(ids)
        self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((full, mask), self.schema, strict=True)], schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            self.write(np.frombuffer(b"".join(self.held), "<u4"))
        self.file.close()
        self.out.close()
        self.store.move(self.part, self.path)  # a second attempt of the task puts the same content in its place


class Shard:
    """A shard's file, mapped where the store is local; ids(start, end) reads any stretch."""

    def __init__(self, uri: str):
        self.store, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(self.store, fs.LocalFileSystem) else self.store.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        kind = self.file.schema.field("ids").type
        self.length = kind.list_size
        self.batch_ids = self.file.get_batch(0).num_rows * self.length if self.file.num_record_batches else 1

    def ids(self, start: int, end: int) -> Iterator[np.ndarray]:
        """The ids from start to before end, as views of the batches that hold them."""
        for b in range(start // self.batch_ids, -(-end // self.batch_ids)):
            batch, first = self.file.get_batch(b), b * self.batch_ids
            lo, hi = max(start - first, 0), min(end - first, batch.num_rows * self.length)
            if not batch.column(1).values.slice(hi - 1, 1)[0].as_py():
                raise ValueError("the index reaches beyond the real ids of a shard")
            yield batch.column(0).values.slice(lo, hi - lo).to_numpy(zero_copy_only=True)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, length: int = LENGTH, batch_rows: int = BATCH_ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode by a tokenizer file of the tokenizers library, write shards to folder in ascending doc_id order, and return the index.

    docs has doc_id and text; other columns are ignored. A null text is empty, and so one end id. Rows that share a
    doc_id follow each other in the order of their texts' hashes, over several shards if they are many; null doc_ids come
    first. An empty table gives no shard.
    Index: doc_id, shard, local_start (ids before it in the shard), n_tokens (end id included), start (ids before it).
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode, writer, at = TaskContext.get().partitionId(), encoder(tokenizer).encode, None, 0
        wide = encoder(tokenizer).library.get_vocab_size() > 1 << 16
        end = packed([END_ID])
        for batch, texts in slices(batches):
            ids_column, starts, counts = batch.column(0), [], []
            for ids in encode(texts):
                writer = writer or ShardWriter(f"{folder}/shard-{shard:06d}.arrow", length, batch_rows, wide)
                ids += end
                writer.add(ids)
                starts.append(at)
                counts.append(len(ids) // 4)
                at += counts[-1]
            if starts:
                yield pa.RecordBatch.from_arrays([ids_column, pa.array([shard] * len(starts), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "shard", "local_start", "n_tokens"])
        if writer:
            writer.close()

    kind = rows.schema["doc_id"].dataType.simpleString()
    order = rows.withColumn("hash", F.xxhash64("text"))
    spread = order.repartitionByRange(parts, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    index = written(spread.mapInArrow(run, f"doc_id {kind}, shard int, local_start long, n_tokens long"), "index")
    manifest = index.groupBy("shard").agg(F.sum("n_tokens").alias("n_ids"))
    before = manifest.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("before"))  # a row per shard
    return written(index.join(before, "shard").select("doc_id", "shard", "local_start", "n_tokens", (F.col("before") + F.col("local_start")).alias("start")), "placed")


def read_documents(index: DataFrame, folder: str) -> DataFrame:
    """Read each indexed document's ids from the shards: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, Shard] | None = None
        for batch in batches:
            sums = []
            for shard, start, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if opened is None or opened[0] != shard:
                    opened = shard, Shard(f"{folder}/shard-{shard:06d}.arrow")
                total = 0
                for ids in opened[1].ids(start, start + n):
                    total = zlib.crc32(np.ascontiguousarray(ids, "<u4"), total)
                sums.append(total)
            if sums:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(3), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = index.schema["doc_id"].dataType.simpleString()
    return index.select("doc_id", "shard", "local_start", "n_tokens", "start").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "tokens")
    index = write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(index, folder)
