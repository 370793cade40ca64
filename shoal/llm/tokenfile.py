"""Token-id files with a minimal perfect hash index.

A shard file holds the raw ids of its documents in ascending doc_id order (16-bit where the vocabulary allows, else
32-bit, little-endian), the records (key, length), and an index: a minimal perfect hash maps a document key to a slot,
which has the key's fingerprint and the document's offset and length. A lookup reads one slot and one run of ids.

The hash is a cascade of bit arrays: a key that alone hits its bit at a level is placed there, the others go on to the
next level; the slot is the rank of the bit. Bits are kept in blocks that know how many are set before them, so a lookup reads
one block a level, one slot and one run of ids, however large the file is.

There is a shard for each SHARD_BYTES of text, and at least one for each shuffle partition; memory is bounded by a shard's index.

Defined cases: null text is empty and holds the end id only; rows without doc_id come first and are not indexed; of rows
that repeat a doc_id the index has the first (they are ordered by a hash of their text), and all are read back in order; an
empty table writes no file.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.common import fresh_path, kept, map_arrow, slices, stash, texts_of

MAGIC = b"TOKSHRD2"
#: Pieces that a worker remembers from texts to texts; it forgets them all when it holds more, which changes no result.
REMEMBERED = 300_000
#: Pieces given to the library in one text, and bytes of documents encoded together, about.
AT_ONCE, TOGETHER = 4096, 2 << 20
#: Bytes of text in a shard, about.
SHARD_BYTES = 256 << 20
#: The pieces of the tokenizer that is encoded piece by piece; fixed values.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters, numbers and white space below U+0100, of lower-cased text; fixed values.
LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
LEVELS = 64
SPREAD = 2  # bits for each key of a level


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


# --- encoding by the tokenizers library -------------------------------------------------------------------------


class PieceEncoder(dict):
    """Ids of whole texts by the tokenizers library, as little-endian bytes; as a dict it numbers the pieces met, whose ids are in ``of``.

    The library's pre-tokenizer cuts a text into pieces that are encoded apart, so each distinct piece is given to it once: many of them in
    one text, between spaces. Where the tokenizer isn't of the kind this knows (lower case, pieces matched by one pattern of letters,
    digits and others, the last token of a piece marked by a suffix), texts go to the library whole.
    """

    def __init__(self, text: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(text)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        special = [t["content"] for t in spec["added_tokens"]]
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.special = {t["content"]: self.packed([t["id"]]) for t in spec["added_tokens"]}
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        first = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_piece = kinds == ["NFC", "Replace", "Lowercase"] and first.get("behavior") == "Removed" and first.get("invert") and first["pattern"]["Regex"] == PIECES and bool(suffix)
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        # the alternatives begin with different characters, so their order is free: the commonest first
        self.pattern = regex.compile(r"\p{L}+|'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\s\p{L}\p{N}]+")
        self.latin = re.compile(rf"[{LATIN_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{LATIN_NUMBERS}]|[^{LATIN_SPACE}{LATIN_LETTERS}{LATIN_NUMBERS}]+")
        self.of: list[bytes] = []
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.library.encode(text, add_special_tokens=False).ids)

    def pieces(self, text: str) -> list[str]:
        # the library lower-cases character by character; Python looks around a capital sigma
        text = self.library.normalizer.normalize_str(text) if "\u03a3" in text else unicodedata.normalize("NFC", text).lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return self.latin.findall(text)

    def numbers(self, text: str) -> list[int]:
        return [*map(self.__getitem__, self.pieces(text))]

    def learn(self) -> None:
        """The ids of the new pieces."""
        for at in range(0, len(self.new), AT_ONCE):
            part = self.new[at : at + AT_ONCE]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            raw = ids.tobytes()
            self.of += [raw[i:j] for i, j in zip([0, *ends], ends)] if len(ends) == len(part) else map(self.whole, part)
        self.new = []

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return [*map(self.whole, texts)]
        if len(self) > REMEMBERED:
            self.clear()
            self.of = []
        cut = []
        for t in texts:
            if any(s in t for s in self.special):
                cut.append([self.special.get(x) or self.numbers(x) for x in self.at_special.split(t)])
            else:
                cut.append(self.numbers(t))
        self.learn()
        joined = lambda numbers: b"".join(map(self.of.__getitem__, numbers))
        return [joined(c) if not c or isinstance(c[0], int) else b"".join(x if isinstance(x, bytes) else joined(x) for x in c) for c in cut]


def encoder(text: str) -> PieceEncoder:
    return kept(("pieces", zlib.crc32(text.encode())), lambda: PieceEncoder(text))


# --- minimal perfect hash ---------------------------------------------------------------------------------------


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of each key; the constants are the fixed values of a public mixing function."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A block of the hash's bits, with how many bits are set before it.
BLOCK = np.dtype([("rank", "<u8"), ("bits", "u1", 64)])
#: What a slot holds: the key's fingerprint, and where its document's ids are.
SLOT = np.dtype([("print", "<u4"), ("offset", "<i8"), ("size", "<i8")])


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys. ``blocks``: all levels' bit arrays, one after the other; ``sizes``: their lengths."""

    def __init__(self, blocks, sizes: list[int]):
        self.blocks, self.sizes = blocks, sizes
        self.starts = np.cumsum([0, *sizes])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys repeat")
            size = SPREAD * len(left)
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        bits = np.concatenate([np.zeros(0, bool), *levels])
        blocks = np.zeros(-(-len(bits) // 512), BLOCK)
        blocks["bits"] = np.packbits(np.pad(bits, (0, len(blocks) * 512 - len(bits))), bitorder="little").reshape(-1, 64)
        ends = np.cumsum([np.bitwise_count(b).sum(dtype=np.uint64) for b in blocks["bits"]], dtype=np.uint64)
        blocks["rank"][1:] = ends[:-1]
        return cls(blocks, [len(x) for x in levels])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The keys' slots; -1 for keys that no level knows."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.starts[level] + (mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = np.zeros(len(at), bool)
            for lo in range(0, len(at), 1 << 14):
                part, place = self.blocks[at[lo : lo + (1 << 14)] >> 9], at[lo : lo + (1 << 14)] & 511
                bits = np.unpackbits(part["bits"], axis=1, bitorder="little")
                own = bits[np.arange(len(part)), place].astype(bool)
                before = (bits * (np.arange(512) < place[:, None])).sum(1)
                out[open_[lo : lo + (1 << 14)][own]] = (part["rank"].astype(np.int64) + before)[own]
                hit[lo : lo + (1 << 14)] = own
            open_ = open_[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


# --- shard files ------------------------------------------------------------------------------------------------


class ShardWriter:
    def __init__(self, uri: str, width: int):
        self.fs, self.path = opened(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out, self.kind = self.fs.open_output_stream(self.path), f"<u{width}"
        self.keys, self.known, self.lengths = [], [], []

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.keys.append(key or 0)
        self.known.append(key is not None)
        self.lengths.append(len(ids) // np.dtype(self.kind).itemsize)

    def close(self) -> None:
        keys, known, lengths = np.array(self.keys, "<i8"), np.array(self.known, bool), np.array(self.lengths, "<i8")
        offsets = np.cumsum(lengths) - lengths
        rows = np.flatnonzero(known)
        distinct, first = np.unique(keys[rows], return_index=True)
        ph = PerfectHash.build(distinct)
        slots, slot, row = np.zeros(len(distinct), SLOT), ph.slots(distinct), rows[first]
        slots["print"][slot], slots["offset"][slot], slots["size"][slot] = fingerprint(distinct), offsets[row], lengths[row]
        sections = {"keys": keys, "known": known.astype("u1"), "lengths": lengths, "slots": slots, "blocks": ph.blocks}
        head = {"kind": self.kind, "ids": int(lengths.sum()), "levels": ph.sizes, "sections": {k: len(v) for k, v in sections.items()}}
        for v in sections.values():
            self.out.write(v.tobytes())
        tail = json.dumps(head).encode()
        self.out.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
        self.out.close()


class Paged:
    """A section of a file as an array of which only the records asked for are read; ``whole`` reads all."""

    def __init__(self, read, at: int, n: int, kind: np.dtype):
        self.read, self.at, self.n, self.kind = read, at, n, kind

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join(self.read(self.at + int(r) * self.kind.itemsize, self.kind.itemsize) for r in rows), self.kind)

    def whole(self) -> np.ndarray:
        return np.frombuffer(self.read(self.at, self.n * self.kind.itemsize), self.kind)


class ShardReader:
    """Keyed and ordered access to a shard file. Opening it reads its head only; a key costs a block of bits a level, one slot and its ids."""

    KINDS = {"keys": np.dtype("<i8"), "known": np.dtype("u1"), "lengths": np.dtype("<i8"), "slots": SLOT, "blocks": BLOCK}

    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        end = self._at(size - 16, 16)
        if end[8:] != MAGIC:
            raise ValueError(f"no token shard: {uri}")
        n = int.from_bytes(end[:8], "little")
        head = json.loads(self._at(size - 16 - n, n))
        self.kind, self.ids, at = np.dtype(head["kind"]), head["ids"], head["ids"] * np.dtype(head["kind"]).itemsize
        self.sections = {}
        for name, count in head["sections"].items():
            self.sections[name] = Paged(self._at, at, count, self.KINDS[name])
            at += count * self.KINDS[name].itemsize
        self.slots, self.hash = self.sections["slots"], PerfectHash(self.sections["blocks"], head["levels"])

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    @property
    def keys(self) -> np.ndarray:
        return self.sections["keys"].whole()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and lengths of the keys' documents; -1 where a fingerprint says the key isn't there."""
        slot, offsets, sizes = self.hash.slots(keys), np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        there = np.flatnonzero(slot >= 0)
        held = self.slots[slot[there]]
        same = held["print"] == fingerprint(keys[there])
        offsets[there[same]], sizes[there[same]] = held["offset"][same], held["size"][same]
        return offsets, sizes

    def read(self, offset: int, n: int) -> np.ndarray:
        return np.frombuffer(self._at(offset * self.kind.itemsize, n * self.kind.itemsize), self.kind).astype("<u4")

    def get(self, key: int) -> np.ndarray | None:
        offset, n = (int(x[0]) for x in self.find(np.array([key], np.int64)))
        return None if offset < 0 else self.read(offset, n)

    def records(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Key, offset in the shard and ids of every record in order; the first record of a key by way of the index, which is read as a whole."""
        keys, known, lengths = self.keys, self.sections["known"].whole(), self.sections["lengths"].whole()
        self.slots, self.hash.blocks = self.sections["slots"].whole(), self.sections["blocks"].whole()
        offsets = np.cumsum(lengths) - lengths
        rows = np.flatnonzero(known)
        distinct, first = np.unique(keys[rows], return_index=True)
        at, n = self.find(distinct)
        if (at < 0).any() or (n != lengths[rows[first]]).any():
            raise ValueError("the index and the records disagree")
        offsets[rows[first]] = at
        for key, is_known, offset, size in zip(keys.tolist(), known.tolist(), offsets.tolist(), lengths.tolist()):
            yield (key if is_known else None), offset, self.read(offset, size)


def write_shards(docs: DataFrame, path: str, end_id: int = 1, shards: int | None = None, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text) to shard files in ``folder``; returns shard, uri, start, n_docs, n_ids of each.

    ``path``: the tokenizer's JSON on the driver. Documents are range-partitioned by doc_id; a task writes the file of its range
    under a name of its own attempt, and only the attempt that Spark commits is in the result.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    folder = folder or fresh_path(spark, "token-shards")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("h"))
    if not shards:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ranged = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, shard, out = encoder(spec.value), TaskContext.get().partitionId(), None
        uri, end = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tok", e.packed([end_id])
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), texts_of(batch)
            for lo, hi in slices(texts, TOGETHER):
                out = out or ShardWriter(uri, e.width)
                for key, ids in zip(keys[lo:hi], e.encode([b.decode("utf-8", "replace") for b in texts[lo:hi]])):
                    out.add(key, ids + end)
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "uri": uri, "n_docs": len(out.lengths), "n_ids": sum(out.lengths)}], pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    written = stash(map_arrow(ranged, run, "shard int, uri string, n_docs long, n_ids long"), "token-index")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that ``write_shards`` has listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                rows = [(key, s["start"] + offset, len(ids), zlib.crc32(ids)) for key, offset, ids in ShardReader(s["uri"]).records()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = shards.select("uri", "start").repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(spread, run, "doc_id long, start long, n_tokens long, ids_crc32 long")
