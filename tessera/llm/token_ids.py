"""Token ids of whole texts by a public tokenizer file, and their file format.

White space never takes part in a token of `word_bpe_49k.json`, so a text's ids are those of its words in a
row, and a word is encoded once: each worker keeps a bounded table of the words it has met.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import give_back
from tessera.llm.shared import broadcast_if_small, new_path, written

END_ID = 2
KNOWN_WORDS = 150_000  # words, and pieces, of a generation; a worker remembers this and the one before
FILE_WORDS = 450_000  # the same where encoding is all that a task does
STRIPE_BYTES = 16 << 20
STRIDE = 1000
PARTS = 1_000_000  # largest table of totals that is broadcast

_PLAIN = re.compile("[!-;=-~À-ÖØ-öø-ÿ]+").fullmatch  # no `<`, which opens control strings
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
_OTHER_SPACE = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[ \t\n\r\x0b\x0c]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _raw(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, most: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most or KNOWN_WORDS
        self.letters = {chr(b): c for b, c in _byte_letters().items()}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, p: str) -> bytes:
        mapped = p if p.isascii() else "".join(self.letters[chr(b)] for b in p.encode())
        return _raw([t.id for t in self.tokenizer.model.tokenize(mapped)])

    def known_piece(self, p: str) -> bytes:
        ids = self.pieces[p] = self.piece(p)
        return ids

    def word(self, w: str) -> bytes:
        if _PLAIN(w):
            got, parts = self.pieces.get, _PIECES(w.lower())
            if len(parts) == 1:  # remembered as a word
                ids = got(parts[0]) or self.piece(parts[0])
            else:
                ids = b"".join([got(p) or self.known_piece(p) for p in parts])
        else:
            ids = _raw(self.tokenizer.encode(w, add_special_tokens=False).ids)
        self.words[w] = ids
        return ids

    def text(self, text: str) -> bytes:
        split = [w for w in _SPACES.split(text) if w] if _OTHER_SPACE.search(text) else text.split()
        known = self.words
        try:
            return b"".join([known[w] for w in split])
        except KeyError:
            if len(known) > self.most:  # words met since stay, those that were not go with the next generation
                self.older, self.words = known, {}
                known = self.words
            if len(self.pieces) > self.most:
                self.pieces.clear()
            ids, older = [], self.older.get
            for w in split:
                got = known.get(w)
                if got is None:
                    got = older(w)
                    if got is None:
                        got = self.word(w)
                    else:
                        known[w] = got
                ids.append(got)
            return b"".join(ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str, most: int | None = None) -> Encoder:
    """One encoder per worker and file, which remembers `most` words from now on."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].most = most or KNOWN_WORDS
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_column(column: pa.Array, tokenizer: str, most: int | None = None) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, ids with the end id of each of the next rows), about 4 MB of ids at a time."""
    enc, end = encoder(tokenizer, most), np.array([END_ID], "<u4").tobytes()
    first, out, size = 0, [], 0
    for i, text in enumerate(column):
        ids = enc.text(text.as_py() or "") + end
        out.append(ids)
        size += len(ids)
        if size > 4 << 20:
            yield first, out
            first, out, size = i + 1, [], 0
    if out:
        yield first, out
    give_back()


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, partitions: int | None = None) -> None:
    """docs (doc_id, text) as ORC files of (doc_id, ids array<int>), in ascending doc_id from file to file.

    ORC keeps the ids run-length encoded in stripes, with row indexes and a Bloom filter on doc_id, so
    readers take stripes in parallel and skip those that cannot hold a document. Texts, smaller than ids, are
    what the range shuffle moves; equal doc_ids are ordered by their text, and so may be split over files.

    Defined results: a null text is empty, so its ids are the end id alone; null doc_ids come first; repeated
    rows are written once each; an empty table gives no rows; other columns are ignored."""
    tokenizer = tokenizer or default_path()
    rows = docs.select("doc_id", "text")
    keys = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)

    def run(batches):
        for batch in batches:
            for first, ids in encode_column(batch.column("text"), tokenizer, FILE_WORDS):
                off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(ids)), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["doc_id", "ids"])

    made = rows.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, "doc_id long, ids array<int>")
    options = {"orc.create.index": "true", "orc.row.index.stride": str(STRIDE), "orc.stripe.size": str(STRIPE_BYTES), "orc.bloom.filter.columns": "doc_id", "orc.compress": "ZSTD"}
    made.write.options(**options).orc(path)


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, ids); a filter on doc_id reaches the row indexes and Bloom filters."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def _crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        off, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        rest = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "ids"]
        yield pa.RecordBatch.from_arrays([*rest, pc.cast(pa.array(np.diff(off)), pa.int64()), pa.array(crc, pa.int64())], [c for c in batch.schema.names if c != "ids"] + ["n_tokens", "ids_crc32"])


def index(spark, path: str) -> DataFrame:
    """Per row of the files: doc_id, start (ids of all rows before it), n_tokens, ids_crc32.

    Starts need only the counts: totals by file, summed over the files in order (as many rows as files),
    then a running sum inside each file."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    files = read_ids(spark, path).select(part.alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "doc_id", "ids")
    rows = written(files.mapInArrow(_crc_batches, "part long, block long, at long, doc_id long, n_tokens long, ids_crc32 long"), "token-index")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block", "at")) - F.col("n_tokens")
    out = rows.withColumn("own", inside).join(broadcast_if_small(before, PARTS), "part")
    return out.select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_files(docs: DataFrame, tokenizer: str | None = None) -> str:
    """Write docs below the shared folder; the path."""
    path = new_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer)
    return path
