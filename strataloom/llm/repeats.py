"""Substring dedup by seed and extend: repeated passages leave all documents but the first that has them.

Documents are dealt into chunks by a hash of their id. Three passes read the same exchange:

1. Seeds. Of every `window` consecutive words the run of `seed` words with the smallest hash is an
   anchor (winnowing), so equal windows always share an anchor. Each chunk sends its distinct
   anchors to hash buckets; a bucket joins the chunks on equal anchors and tells each which of its
   anchors other chunks hold too.
2. Extension. Around every shared anchor the match is extended left and right over all windows that
   the anchor stands for. The chunk sends each distinct extended window with the smallest id that
   holds it; the bucket answers which windows start in a smaller document elsewhere.
3. Cut. Neighbouring repeated windows join to maximal repeats, at least `window` words long.

A chunk sends an anchor or window once however many of its documents hold it, so that a passage in
a third of all documents costs a bucket one entry a chunk. No pair of documents is ever listed.
Windows are told apart by 64-bit hashes of their words: of n distinct windows about n*n/2**65 pairs
are taken for equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.words import U64, Words, grams, ids_of, mix

SENT = "bucket int, chunk int, keys binary, firsts binary"
TOLD = "chunk int, keys binary"


def chunked(docs: DataFrame, id_col: str, text_col: str, chunks: int) -> DataFrame:
    """chunk, id, text; the id cast to long. Rows are dealt by id and text, so that null or repeated ids fill all chunks."""
    key = F.col(id_col).cast("long")
    return docs.select(F.pmod(F.xxhash64(key, F.col(text_col).cast("string")), F.lit(chunks)).cast("int").alias("chunk"), key.alias("id"), F.col(text_col).cast("string").alias("text"))


def chunk_count(docs: DataFrame) -> int:
    return 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _members(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which keys stand in the sorted array `of`."""
    if not len(of):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(of, keys)
    at[at == len(of)] = 0
    return of[at] == keys


def _told(answers: pa.Table) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, U64), *(np.frombuffer(x, U64) for x in answers["keys"].to_pylist())]))


def sent(chunk: int, keys: np.ndarray, firsts: np.ndarray | None, buckets: int) -> pa.Table:
    """One row a bucket with the keys that fall into it, and what goes with them."""
    bucket = ((keys >> U64(32)) % U64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, keys = bucket[order], keys[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
    to = np.r_[cut[1:], len(keys)] if len(cut) else cut
    firsts = None if firsts is None else firsts[order]
    return pa.table(
        {
            "bucket": pa.array(bucket[cut], pa.int32()),
            "chunk": pa.array(np.full(len(cut), chunk, np.int32)),
            "keys": pa.array([keys[a:b].tobytes() for a, b in zip(cut, to)], pa.binary()),
            "firsts": pa.array([b"" if firsts is None else firsts[a:b].tobytes() for a, b in zip(cut, to)], pa.binary()),
        }
    )


def _opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = [np.frombuffer(x, U64) for x in table["keys"].to_pylist()]
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    firsts = b"".join(table["firsts"].to_pylist())
    return np.concatenate([np.zeros(0, U64), *keys]), row, np.frombuffer(firsts, np.int64)


def _answer(table: pa.Table, keys: np.ndarray, row: np.ndarray, hit: np.ndarray) -> pa.Table:
    keys, row = keys[hit], row[hit]
    ends = np.searchsorted(row, np.arange(table.num_rows + 1))
    some = np.flatnonzero(np.diff(ends))
    chunk = table["chunk"].to_numpy()
    return pa.table({"chunk": pa.array(chunk[some].astype(np.int32)), "keys": pa.array([keys[ends[i] : ends[i + 1]].tobytes() for i in some], pa.binary())})


def held_elsewhere(table: pa.Table) -> pa.Table:
    """Of a bucket: to each chunk its keys that another chunk sent too."""
    keys, row, _ = _opened(table)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    hit = np.zeros(len(keys), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return _answer(table, keys, row, hit)


def held_before(table: pa.Table) -> pa.Table:
    """Of a bucket: to each chunk its keys that a smaller document of another chunk holds."""
    keys, row, firsts = _opened(table)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(firsts[order], at) if len(at) else firsts
    hit = np.zeros(len(keys), bool)
    hit[order] = least[np.cumsum(new) - 1] < firsts[order] if len(at) else False
    return _answer(table, keys, row, hit)


def anchors(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows' first words; each one's anchor word; the hashes of the anchors' seeds.

    The leftmost smallest hash among the window's seeds is the anchor, so it depends on the window's words only.
    """
    at = np.flatnonzero(words.room() >= window)
    h = words.hashes()
    seeds = mix(grams(h, seed) ^ U64(0x5851F42D4C957F2D))
    best, where = seeds[at], at.copy()
    for step in range(1, window - seed + 1):
        other = seeds[at + step]
        less = other < best
        best = np.where(less, other, best)
        where[less] = at[less] + step
    return at, where, best


def _many(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Sorted keys that documents of different ids hold."""
    order = np.lexsort((ids, keys))
    k, d = keys[order], ids[order]
    return np.unique(k[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])])


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with the smallest id that holds it."""
    order = np.lexsort((ids, keys))
    k = keys[order]
    new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[new], ids[order][new]


def _cut(table: pa.Table, before: np.ndarray, window: int) -> pa.Table:
    words = Words(table["text"])
    ids = ids_of(table["id"])
    at = np.flatnonzero(words.room() >= window)
    keys = grams(words.hashes(), window)[at]
    own = ids[words.text_of_word()[at]]
    known, least = _least(keys, own)
    gone = _members(keys, before)
    if len(keys):
        gone |= least[np.searchsorted(known, keys)] < own
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at[gone], 1)
    np.add.at(edge, at[gone] + window, -1)
    removed = np.cumsum(edge[:-1]) > 0
    kept = ~removed
    texts, spans, n_removed = [], [], []
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
        held = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().split()
        cut = removed[a:b]
        n = int(cut.sum())
        if n:
            turn = np.flatnonzero(np.diff(np.r_[False, cut, False].astype(np.int8))).reshape(-1, 2)
            spans.append([{"from_word": int(x), "to_word": int(y)} for x, y in turn])
            mask = kept[a:b]
            held = [held[j] for j in np.flatnonzero(mask)]
        else:
            spans.append([])
        n_removed.append(n)
        texts.append(b" ".join(held))
    span = pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64())]))
    return pa.table(
        {
            "id": table["id"],
            "n_words": pa.array(words.counts.astype(np.int64)),
            "n_removed": pa.array(n_removed, pa.int64()),
            "spans": pa.array(spans, span),
            "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
        }
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, seed: int = 5, chunks: int | None = None) -> DataFrame:
    """Per document: id, n_words, n_removed, spans of words removed, kept_text (kept words, one space between).

    A word goes if a window of `window` words over it also starts in a document with a smaller id; windows
    are those of the input. Rows with one id don't remove each other's words; a null id counts as the
    largest. Null and empty texts have no words. Columns other than the two named are not read. An
    empty table gives no rows.
    """
    if not 1 <= seed <= window:
        raise ValueError("seed must lie between 1 and window")
    chunks = chunks or chunk_count(docs)
    base = chunked(docs, id_col, text_col, chunks)

    def seeds(key, table):
        _, _, found = anchors(Words(table["text"]), window, seed)
        return sent(key[0].as_py(), np.unique(found), None, chunks)

    def extended(key, table, answers):
        words = Words(table["text"])
        at, _, found = anchors(words, window, seed)
        own = ids_of(table["id"])[words.text_of_word()[at]]
        near = _members(found, np.union1d(_told(answers), _many(found, own)))
        keys, least = _least(grams(words.hashes(), window)[at[near]], own[near])
        return sent(key[0].as_py(), keys, least, chunks)

    def cut(key, table, answers):
        return _cut(table, _told(answers), window)

    shared = base.groupBy("chunk").applyInArrow(seeds, SENT).groupBy("bucket").applyInArrow(held_elsewhere, TOLD)
    earlier = base.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(extended, SENT).groupBy("bucket").applyInArrow(held_before, TOLD)
    schema = "id long, n_words long, n_removed long, spans array<struct<from_word: long, to_word: long>>, kept_text string"
    return base.groupBy("chunk").cogroup(earlier.groupBy("chunk")).applyInArrow(cut, schema).withColumnRenamed("id", id_col)


#: The rows of op7 over `documents`, whose ids are unique: every window is compared as text.
SQL = r"""
WITH held AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM held),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM held)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM windows JOIN firsts USING (k), range(0, 13) t(d) WHERE first < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT h.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM held h LEFT JOIN kept k USING (doc_id)
"""
