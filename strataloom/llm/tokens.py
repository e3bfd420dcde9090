"""Token-ID shards: texts encoded by a public tokenizer and kept as one compressed wavelet matrix a shard."""

from __future__ import annotations

import os
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.spread import running_before
from strataloom.llm.wavelet import WaveletMatrix
from strataloom.session import shared_folder

SHARD_IDS = 1 << 21
CACHED_WORDS = 500_000
#: Punctuation that makes a pre-token of its own after letters; not the apostrophe, which may start "'s" and the like.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below are kept by the tokenizer's normaliser but for their case.
PLAIN_LETTERS = "\u0180"
SHARDS = "part int, turn int, first_doc long, ids long, docs binary, lengths binary, matrix binary"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of texts as 32-bit integers, by distinct words: no token reaches over white space.

    Words are split at ASCII white space only; what else counts as white space is left to the tokenizer. A word
    of plain letters with punctuation after it is two pre-tokens, so its letters are looked up in lower case and
    given to the tokenizer's merges directly; any other word is encoded as it stands.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end, self.letters, self.byte_letters = array("I", [end_id]).tobytes(), {}, byte_letters()

    def _plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _core(self, core: str) -> bytes:
        ids = self.letters.get(core)
        if ids is None:
            word = core if core.isascii() else core.encode().decode("latin-1").translate(self.byte_letters)
            ids = self.letters[core] = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return ids

    def _tail(self, tail: str) -> bytes:
        ids = self.letters.get(tail)
        if ids is None:
            ids = self.letters[tail] = self._plain(tail)
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        small = text.lower()
        core = small.rstrip(MARKS)
        if core and core.isalpha() and (core.isascii() or max(core) < PLAIN_LETTERS):
            ids = self._core(core)
            if len(core) < len(small):
                ids += self._tail(small[len(core) :])
        else:
            ids = self._plain(text)
        self[word] = ids
        return ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, the end id after each text; and the number of each text's ids."""
        if len(self) > CACHED_WORDS:
            self.clear()
            self.letters.clear()
        held = [b"".join([*map(self.__getitem__, (t or "").encode().split()), self.end]) for t in texts]
        return np.frombuffer(b"".join(held), np.uint32), np.array([len(h) >> 2 for h in held], np.int64)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder a Python worker, which keeps its words from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _sharded(path: str, end_id: int, shard_ids: int, width: int):
    def shards(batches):
        held_words = encoder(path, end_id)
        part, turn = TaskContext.get().partitionId(), 0
        docs, lengths, ids, held = [], [], [], 0

        def shard():
            sequence = np.concatenate(ids)
            return pa.record_batch(
                {
                    "part": pa.array([part], pa.int32()),
                    "turn": pa.array([turn], pa.int32()),
                    "first_doc": pa.array([int(docs[0][0])], pa.int64()),
                    "ids": pa.array([len(sequence)], pa.int64()),
                    "docs": pa.array([np.concatenate(docs).astype("<i8").tobytes()], pa.binary()),
                    "lengths": pa.array([np.concatenate(lengths).astype("<i8").tobytes()], pa.binary()),
                    "matrix": pa.array([WaveletMatrix.build(sequence, width).to_bytes()], pa.binary()),
                }
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                found, sizes = held_words.encode(piece.column("text").to_pylist())
                docs.append(piece.column("id").fill_null(2**63 - 1).to_numpy(zero_copy_only=False))
                lengths.append(sizes)
                ids.append(found)
                held += len(found)
                if held >= shard_ids:
                    yield shard()
                    docs, lengths, ids, held, turn = [], [], [], 0, turn + 1
        if docs:
            yield shard()

    return shards


def write_shards(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shard_ids: int = SHARD_IDS, width: int = 16) -> None:
    """Write all texts in ascending id order, null ids last, to a new folder `path` of the shared file system.

    Ids are range-partitioned by Spark; each part writes one zstd-compressed Parquet file, in which every
    shard is one row: its documents' ids and lengths and its wavelet matrix in the format of `wavelet`. A shard
    is closed once it has `shard_ids` ids, so a task holds about one shard. A null text counts as empty and
    gives the end id alone. Rows with one id stand next to each other in the order of their text.
    """
    session = docs.sparkSession
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = 2 * int(session.conf.get("spark.sql.shuffle.partitions"))
    ordered = known.repartitionByRange(parts, F.col("id").asc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_last(), "text")
    made = ordered.mapInArrow(_sharded(tokenizer, end_id, shard_ids, width), SHARDS)
    made.write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row a document of the shards: id, part, turn, place (in its shard), n_tokens, ids_crc32."""

    def documents(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids = WaveletMatrix.from_bytes(batch.column("matrix")[row].as_py()).ids().astype("<u4")
                docs = np.frombuffer(batch.column("docs")[row].as_py(), "<i8")
                lengths = np.frombuffer(batch.column("lengths")[row].as_py(), "<i8")
                ends = np.cumsum(lengths)
                places = ends - lengths
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(places, ends)]
                yield pa.record_batch(
                    {
                        "id": pa.array(docs),
                        "part": pa.array(np.full(len(docs), batch.column("part")[row].as_py(), np.int32)),
                        "turn": pa.array(np.full(len(docs), batch.column("turn")[row].as_py(), np.int32)),
                        "place": pa.array(places),
                        "n_tokens": pa.array(lengths),
                        "ids_crc32": pa.array(sums, pa.int64()),
                    }
                )

    return spark.read.parquet(path).select("part", "turn", "docs", "lengths", "matrix").mapInArrow(
        documents, "id long, part int, turn int, place long, n_tokens long, ids_crc32 long"
    )


def token_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shard_ids: int = SHARD_IDS, path: str | None = None) -> DataFrame:
    """One row a document, read back from the shards: id, start, n_tokens, ids_crc32.

    start is the number of ids of all documents before it. Without `path` the shards go to a new folder below the
    checkpoint folder. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer, id_col, text_col, end_id, shard_ids)
    shards = running_before(spark.read.parquet(path).select("part", "turn", "ids"), [], "part", ["turn"], "ids", "before")
    found = read_shards(spark, path).join(shards.select("part", "turn", "before"), ["part", "turn"])
    return found.select(F.nullif("id", F.lit(2**63 - 1)).alias(id_col), (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
