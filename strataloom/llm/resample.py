"""Importance resampling towards a target distribution, on hashed word n-grams.

Texts are handled as UTF-8 bytes: one 256-byte table lower-cases A-Z and blanks every other ASCII byte that is not a
digit or a letter, ``bytes.split`` gives the words, and a word's crc32 seeds that of the n-gram one word longer.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.words import slices
from strataloom.operators.ranking import cumulate
from strataloom.session import cut_lineage

#: Digits, small letters and all bytes beyond ASCII stand for themselves; capitals become small; the rest is a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
CACHED_WORDS = 500_000
RUN = 10_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


class _Memo(dict):
    """Values of words by `make`, kept until the next `trim` finds too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes):
        value = self[word] = self.make(word)
        return value

    def trim(self) -> None:
        if len(self) > CACHED_WORDS:
            self.clear()


def gram_sums(words: list[bytes], most: int) -> Iterable[int]:
    """crc32 of every run of 2 to `most` words joined by one space, the shorter run's sum as the seed."""
    sums, tails = [*map(zlib.crc32, words)], [b" " + w for w in words]
    for size in range(2, most + 1):
        sums = [zlib.crc32(tail, seed) for tail, seed in zip(tails[size - 1 :], sums)]
        yield from sums


def _tallied(most: int, buckets: int):
    def tally(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            words, sums = Counter(), Counter()
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                held = words_of(text)
                words.update(held)
                if most > 1:
                    sums.update(gram_sums(held, most))
            for word, n in words.items():
                sums[zlib.crc32(word)] += n
            at = np.fromiter(sums, np.int64, len(sums)) % buckets
            np.add.at(total, at, np.fromiter(sums.values(), np.int64, len(sums)))
        seen = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(seen, pa.int32()), "n": pa.array(total[seen], pa.int64())})

    return tally


def bucket_counts(docs: DataFrame, text_col: str = "text", most: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): features of all whole texts by bucket; each task sends its own sums, `buckets` rows at most."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_tallied(most, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", most: int = 1, buckets: int = 10_000) -> list[int]:
    """Gain of each bucket: thousandths of the logarithm of its smoothed share in `target` over that in `docs`.

    The two tables of counts come to the driver; they have `buckets` rows each, whatever the texts are.
    """
    held = []
    for df, col in ((docs, text_col), (target, target_col)):
        counts = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(df, col, most, buckets).collect():
            counts[bucket] = n
        held.append(counts.tolist())
    raw, wanted = held
    both_raw, both_wanted = float(sum(raw) + buckets), float(sum(wanted) + buckets)
    return [math.floor(1000 * math.log(float(t + 1) * both_raw / (float(s + 1) * both_wanted))) for s, t in zip(raw, wanted)]


def noise(key: str) -> int:
    """Thousandths of a standard Gumbel variate, from the first 32 bits of the key's SHA-256."""
    h = int(sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gains: list[int], most: int, seed: int):
    buckets = len(gains)

    def score(batches):
        gain = _Memo(lambda word: gains[zlib.crc32(word) % buckets])
        for batch in slices(batches, "text"):
            gain.trim()
            ids, n_words, n_features, weights, scores = batch.column("id").to_pylist(), [], [], [], []
            for key, text in zip(ids, batch.column("text").cast(pa.binary()).to_pylist()):
                words = words_of(text)
                n, total = len(words), sum(map(gain.__getitem__, words))
                if most > 1:
                    longer = [gains[s % buckets] for s in gram_sums(words, most)]
                    n, total = n + len(longer), total + sum(longer)
                weight = total // n if n else 0
                n_words.append(len(words))
                n_features.append(n)
                weights.append(weight)
                scores.append(weight + noise(f"{seed}:{'' if key is None else key}"))
            columns = [ids, n_words, n_features, weights, scores]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["id", "n_words", "n_features", "weight", "score"])

    return score


def target_resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    most: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    least_words: int = 20,
    percent: int = 10,
) -> DataFrame:
    """One row a document: id, n_words, n_features, weight, score, rank (null where it is not drawn).

    Features are the runs of 1 to `most` words. `weight` is the floored mean of the gains of a document's features
    (none: 0), `score` adds Gumbel noise of (`seed`, id), and of the documents with at least `least_words` words the
    `percent` % with the highest scores are drawn: a draw without replacement in proportion to exp(weight / 1000).
    Ranks are 1, 2, 3...; ties go to the smaller id, null ids last.

    Texts are read twice, whole, and never shuffled; narrow rows of scores are checkpointed, tallied and range-partitioned
    by (score, id), so neither a common score nor a repeated id comes into one task as rows. A null text has no words,
    like an empty one; a text of any length is one row. A null id draws the noise of the empty id. Rows with one id are
    separate documents; those equal in every result share consecutive ranks in any order. Empty tables give no rows
    (an empty `target`: all its counts are 0). Other columns of either table are ignored.
    """
    gains = bucket_gains(docs, target, text_col, target_col, most, buckets)
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = cut_lineage(known.mapInArrow(_scored(gains, most, seed), "id long, n_words long, n_features long, weight long, score long"))
    values = ["id", "n_words", "n_features", "weight", "score"]
    able = F.col("n_words") >= least_words
    runs = scored.where(able).groupBy(*values).agg(F.count(F.lit(1)).alias("ties"))
    runs = runs.withColumns({"__down": -F.col("score"), "__last": F.col("id").isNull()})
    placed = cumulate(runs, [], ["__down", "__last", "id", "n_words", "n_features", "weight"], "ties")
    # a run of equal rows is laid out in pieces, so that one of any length fills many tasks
    piece = F.sequence(F.lit(0).cast("long"), F.col("ties") - 1, F.lit(RUN).cast("long"))
    pieces = placed.withColumn("__at", F.explode(piece))
    pieces = pieces.withColumn("__to", F.least(F.col("ties"), F.col("__at") + RUN) - 1)
    laid = pieces.withColumn("__k", F.explode(F.sequence("__at", "__to")))
    rank = F.col("below") + F.col("__k") + 1
    drawn = F.floor(F.lit(percent) * F.col("n") / 100)
    drawn_rows = laid.select(*values, F.when(rank <= drawn, rank).alias("rank"))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return drawn_rows.unionByName(rest).withColumnRenamed("id", id_col)


#: SQL of the query of `target_resample`: words, crc32 by its own table of 256, gains, noise and ranks.
SQL = r"""WITH crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
r AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT rid, unnest(words) AS word FROM r),
t AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
v AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM w UNION SELECT word FROM t)),
b AS (SELECT word, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS n FROM w JOIN b USING (word) GROUP BY 1), g AS (SELECT bucket, count(*) AS n FROM t JOIN b USING (word) GROUP BY 1),
gains AS (SELECT i.bucket, floor(1000 * ln((coalesce(g.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM w) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
 FROM (SELECT DISTINCT bucket FROM b) i LEFT JOIN s USING (bucket) LEFT JOIN g USING (bucket)),
f AS (SELECT rid, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM w JOIN b USING (word) JOIN gains USING (bucket) GROUP BY 1),
d AS (SELECT rid, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
 FROM r LEFT JOIN f USING (rid)),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM d)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM d WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM o"""
