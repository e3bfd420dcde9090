"""Personal data: patterns, and the terms around them that reveal them, by co-occurrence in the corpus.

Everything is DataFrame expressions. Spans are structs (start, rank, end, kind) of code points, end not included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "term")
#: Possessive repeats and starts only where a run begins (or the match before ended) keep every pattern linear in the text.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A run of digits, spaces and hyphens long enough for a card; two separators in a row end a number in it.
CARD_RUN, CARD_BREAK = r"[0-9][0-9\x20-]{10,}[0-9]", r"[\x20-]{2,}"
LETTERS = r"\p{L}+"
SPANS = "array<struct<start: int, rank: int, end: int, kind: string>>"
#: Code points of a piece of a long text, so that a part of it is found without counting from its start.
PIECE = 4096
BUCKETS, SALTS = 1 << 20, 16


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _most(ends: Column) -> Column:
    return F.aggregate(ends, F.lit(0), lambda a, x: F.greatest(a, x))


def _let(fn, **values: Column) -> Column:
    """fn of a struct of values, each worked out once; inside a lambda a plain expression would be worked out for every element."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), fn), F.lit(0))


def _before(numbers: Column, fold) -> Column:
    """fold of the numbers before each one, by blocks of about the root of their count: blocks before it, then its own block."""

    def blocks(h):
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(h["x"]))).cast("int"))
        return _let(lambda k: heads(h["x"], k["n"]), n=size)

    def heads(x, n):
        starts = F.sequence(F.lit(1), F.size(x), n)
        whole = lambda h: F.transform(h["t"], lambda _, i: fold(F.slice(h["t"], F.lit(1), i)))
        return _let(lambda g: _let(lambda h: places(x, n, h["heads"]), heads=whole(g)), t=F.transform(starts, lambda s: fold(F.slice(x, s, n))))

    def places(x, n, head):
        at = lambda i: F.floor(i / n).cast("int")
        both = lambda i: fold(F.array(F.get(head, at(i)), fold(F.slice(x, at(i) * n + 1, i - at(i) * n))))
        return F.transform(x, lambda _, i: both(i))

    return F.when(F.size(numbers) == 0, F.array().cast("array<int>")).otherwise(_let(blocks, x=numbers))


def _found(text: Column, pattern: str | Column) -> Column:
    """(start, value) of every match, leftmost first, none over another."""

    def placed(h):
        steps = F.transform(h["values"], lambda v, i: F.get(h["gaps"], i) + F.length(v))
        start = lambda b: F.transform(h["values"], lambda v, i: F.struct((F.get(b["before"], i) + F.get(h["gaps"], i)).alias("start"), v.alias("value")))
        return _let(start, before=_before(steps, _total))

    by = F.lit(pattern) if isinstance(pattern, str) else pattern
    return _let(placed, values=F.regexp_extract_all(text, by, F.lit(0)), gaps=F.transform(F.split(text, by, -1), F.length))


def _between(text: Column, pattern: str) -> Column:
    """(start, value) of what stands between matches."""

    def placed(h):
        steps = F.transform(h["values"], lambda v, i: F.length(v) + F.coalesce(F.get(h["seps"], i), F.lit(0)))
        start = lambda b: F.transform(h["values"], lambda v, i: F.struct(F.get(b["before"], i).alias("start"), v.alias("value")))
        return _let(start, before=_before(steps, _total))

    return _let(placed, values=F.split(text, pattern, -1), seps=F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return _total(doubled) % 10 == 0


def _small_part(part: Column) -> Column:
    plain = F.regexp_replace(part, r"^0+(?=[0-9])", "")
    return (F.length(plain) <= 3) & (F.substring(plain, 1, 3).cast("int") <= 255)


def _spans(found: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), (m["start"] + F.length(m["value"])).alias("end"), F.lit(kind).alias("kind")))


def personal_spans(text: Column) -> Column:
    """Spans of e-mail addresses, IP addresses, card and phone numbers, ordered by start, then kind."""
    none = F.array().cast(SPANS)
    ips = F.filter(_found(text, IP), lambda m: F.forall(F.split(m["value"], r"\."), _small_part))
    runs = F.transform(_found(text, CARD_RUN), lambda m: F.transform(_between(m["value"], CARD_BREAK), lambda p: F.struct((m["start"] + p["start"]).alias("start"), p["value"].alias("value"))))
    cards = F.filter(F.flatten(runs), lambda m: F.length(_digits(m["value"])).between(12, 19) & _luhn(_digits(m["value"])))
    phones = F.filter(_found(text, PHONE), lambda m: F.length(_digits(m["value"])).between(9, 15))
    each = [
        F.when(F.contains(text, F.lit("@")), _spans(_found(text, EMAIL), "email")).otherwise(none),
        F.when(text.rlike(IP), _spans(ips, "ip")).otherwise(none),
        F.when(text.rlike(CARD_RUN), _spans(cards, "card")).otherwise(none),
        F.when(F.contains(text, F.lit("+")), _spans(phones, "phone")).otherwise(none),
    ]
    return F.array_sort(F.concat(*each))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def span_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start..end of a text given in pieces."""
    first = F.floor(start / PIECE).cast("int")
    held = F.slice(pieces, first + 1, F.greatest(F.lit(0), F.ceil(end / PIECE).cast("int") - first))

    def cut(piece, k):
        base = (first + k) * PIECE
        low = F.greatest(start - base, F.lit(0))
        return F.substring(piece, low + 1, F.least(end - base, F.lit(PIECE)) - low)

    return F.array_join(F.transform(held, cut), "")


def _entities(text: Column, spans: Column) -> Column:
    """kind:value of each span, in lower case, each once."""
    named = lambda h: F.transform(h["spans"], lambda s: F.concat_ws(":", s["kind"], F.lower(_part(h["pieces"], s["start"], s["end"]))))
    return F.array_distinct(_let(named, pieces=_pieces(text), spans=spans))


def _terms(text: Column) -> Column:
    """Distinct terms of a text in lower case; letters of e-mail addresses and phone numbers are none."""
    plain = F.when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("+")), F.regexp_replace(text, f"{EMAIL}|{PHONE}", " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(LETTERS), F.lit(0)))


def revealing_terms(docs: DataFrame, holders: DataFrame, together: int = 3, disclosure: float = 0.9) -> DataFrame:
    """(entity, term, ratio): terms that reveal a protected entity.

    holders: content, text, spans, rows (documents of this text) of the texts with personal data. ratio is the pointwise mutual
    information of term and entity over the information content of the entity, 1 where the term never stands
    without it. A pair counts from `together` distinct texts on, wherever the two stand in them. Probabilities are
    shares of all documents; a term's count covers every document of `docs` (column text).
    """
    held = holders.select("content", "rows", F.explode(_entities(F.col("text"), F.col("spans"))).alias("entity"))
    entities = held.groupBy("entity").agg(F.sum("rows").alias("entity_docs"), F.count("*").alias("in_texts"))
    # an entity of fewer texts has no pair that counts, so only the others meet the terms of their texts
    entities = cut_lineage(entities.where(F.col("in_texts") >= together).drop("in_texts"))
    own = held.join(entities, "entity").groupBy("content").agg(F.collect_list("entity").alias("entities"))
    pairs = holders.join(own, "content").select("rows", "entities", F.explode(_terms(F.col("text"))).alias("term")).select("rows", "term", F.explode("entities").alias("entity"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("rows").alias("both_docs"), F.count("*").alias("texts")).where(F.col("texts") >= together)
    counts = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("term_docs"))
    total = docs.agg(F.count("*").alias("n")).first()["n"]
    information = -F.log(F.col("entity_docs") / F.lit(float(max(total, 1))))
    mutual = F.log(F.col("both_docs") * F.lit(float(max(total, 1))) / (F.col("entity_docs") * F.col("term_docs")))
    found = pairs.join(counts, "term").join(entities, "entity").withColumn("ratio", F.when(information > 0, mutual / information))
    return found.where(F.col("ratio") >= disclosure).select("entity", "term", "ratio")


def _flagged(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be in `wanted` (column of the same name): a broadcast of at most BUCKETS numbers decides, whatever the sizes."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    buckets = wanted.select(bucket(key).alias("__bucket")).distinct()
    return df.withColumn("__bucket", bucket(key)).join(F.broadcast(buckets), "__bucket", "left_semi").drop("__bucket")


def _bits(terms: DataFrame) -> Column:
    """BUCKETS bits, those set into which a term falls: a literal of BUCKETS / 8 bytes, however many terms there are."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS))
    held = terms.select((bucket / 8).cast("long").alias("id"), F.expr(f"shiftleft(1, cast(pmod(pmod(xxhash64(term), {BUCKETS}), 8) as int))").alias("bit"))
    byte = held.groupBy("id").agg(F.bit_or("bit").alias("byte"))
    each = terms.sparkSession.range(BUCKETS // 8).join(byte, "id", "left").select("id", F.lpad(F.hex(F.coalesce("byte", F.lit(0)).cast("long")), 2, "0").alias("hex"))
    row = each.agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "hex"))), lambda x: x["hex"]), "")).alias("bits")).first()
    return F.lit(bytes(row["bits"]))


def _candidates(text: Column, bits: Column) -> Column:
    """Distinct words of a text, as written, whose term falls into a set bit."""

    def kept(h):
        def set_(word):
            bucket = F.pmod(F.xxhash64(F.lower(word)), F.lit(BUCKETS))
            byte = F.conv(F.hex(F.substring(bits, F.floor(bucket / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.call_function("shiftright", byte, (bucket % 8).cast("int")) % 2 == 1

        return F.filter(h["words"], set_)

    return _let(kept, words=F.array_distinct(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))))


def _standing(known: DataFrame, revealing: DataFrame) -> DataFrame:
    """content, terms, gone: where the revealing terms stand in each text, whether it holds their entity or not; `gone` where the ratio is highest.

    A bit map of the terms, a literal of bounded size, tells the few words of a text that may be one; only those are looked for by place, and only they are
    shuffled, by (term, salt), the salt of a row, as one term may be frequent and one text may have many copies. Texts are not shuffled.
    """
    terms = cut_lineage(revealing.groupBy("term").agg(F.max("ratio").alias("ratio")))
    rows = known.select("content", "text", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("__salt"), _candidates(F.col("text"), _bits(terms)).alias("words")).where(F.size("words") > 0)
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("words", "|"), F.lit(r")(?!\p{L})"))
    found = rows.select("content", "__salt", F.explode(_found(F.col("text"), pattern)).alias("w"))
    words = found.select("content", "__salt", F.lower("w.value").alias("term"), F.col("w.start").alias("start"), (F.col("w.start") + F.length("w.value")).alias("end"))
    hits = words.join(_salted(terms), ["term", "__salt"]).groupBy("content", "start", "end").agg(F.max("ratio").alias("ratio"))
    span = F.struct("start", F.lit(KINDS.index("term")).alias("rank"), "end", F.lit("term").alias("kind"))
    return hits.groupBy("content").agg(F.array_sort(F.collect_list(span)).alias("terms"), F.collect_set(F.when(F.col("ratio") >= 1 - 1e-9, F.col("start"))).alias("gone"))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("__salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))


def _replaced(text: Column, spans: Column, gone: Column) -> Column:
    """The text with each span replaced by its kind in brackets; terms that never stand apart from an entity are removed."""

    def rewritten(h):
        def piece(s, i):
            at = F.get(h["at"], i)
            label = F.when((s["kind"] == "term") & F.array_contains(h["gone"], s["start"]), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.when(s["start"] >= at, F.concat(_part(h["pieces"], at, s["start"]), label)).otherwise("")

        rest = _part(h["pieces"], _most(h["spans"]["end"]), h["size"])
        return F.concat(F.array_join(F.transform(h["spans"], piece), ""), rest)

    ends = F.transform(spans, lambda s: s["end"])
    return _let(rewritten, pieces=_pieces(text), spans=spans, gone=gone, size=F.length(text), at=_before(ends, _most))


def _content(text: Column) -> Column:
    """A text's 128-bit name."""
    return F.concat_ws(":", F.xxhash64(text).cast("string"), F.xxhash64(F.lit(1), text).cast("string"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", together: int = 3, disclosure: float = 0.9) -> DataFrame:
    """One row a document: id, base (pattern spans), spans (those and revealing terms), clean_text.

    A term that stands with an entity in at least `together` distinct texts, however far off, whose mutual information
    with it reaches `disclosure` times the entity's information content, is a span of kind `term` wherever it stands, also in documents
    that don't show the entity, as it gives the entity away there. In clean_text patterns and terms give way to their kind in
    brackets; a term never seen without the entity is removed. Terms are runs of letters in lower case. Entities in fewer texts
    have no terms: what they stand with once or twice says nothing of either.

    Null texts count as empty and have no spans. Texts of any length are read whole: patterns are linear in the text, places of n matches
    take n times the root of n steps. Rows with one id are separate documents; rows of equal text (told by a 128-bit
    hash) get equal spans. Other columns, whatever their names, are ignored. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("content", _content(F.col("text")))
    marked = known.withColumn("base", personal_spans(F.col("text")))
    holders = marked.where(F.size("base") > 0).groupBy("content").agg(F.first("text").alias("text"), F.first("base").alias("spans"), F.count("*").alias("rows"))
    holders = cut_lineage(holders)
    terms = cut_lineage(_standing(known, revealing_terms(known, holders, together, disclosure)))
    # texts without a term are written as they are read; the others, and those that share a bucket with them, meet their terms
    hit = _flagged(marked, "content", terms).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    joined = hit.join(_salted(terms), ["content", "__salt"], "left").drop("__salt")
    bucket = F.pmod(F.xxhash64("content"), F.lit(BUCKETS))
    buckets = terms.select(bucket.alias("__bucket")).distinct()
    plain = marked.withColumn("__bucket", bucket).join(F.broadcast(buckets), "__bucket", "left_anti").drop("__bucket")
    none = plain.withColumns({"terms": F.array().cast(SPANS), "gone": F.array().cast("array<int>")})
    both = joined.unionByName(none)
    apart = F.filter(F.coalesce("terms", F.array().cast(SPANS)), lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    both = both.withColumn("spans", F.array_sort(F.concat("base", apart))).withColumn("__gone", F.coalesce("gone", F.array().cast("array<int>")))
    clean = F.when(F.size("spans") > 0, _replaced(F.col("text"), F.col("spans"), F.col("__gone"))).otherwise(F.col("text"))
    return both.select(F.col("id").alias(id_col), "base", "spans", clean.alias("clean_text"))
