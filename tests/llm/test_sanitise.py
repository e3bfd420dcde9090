import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from strataloom.llm.sanitise import sanitise


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


PARTS = ["a.b@c.de", "x@y", "é@b.c", "a@b.c._x@d.e", "1.2.3.4", "300.1.1.1", "001.002.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111",
         "4111111111111112", "+1 (988) 555-2485", "+49 30 1234567890123", "+1", "12 34", "😀", " ", " ", "word", "0", "-", ".", "+4111111111111111", "\n", "79927398713", "0000000000000000"]


def test_base_spans_against_python(spark):
    r = random.Random(9)
    rows = [(d, "".join(r.choice(PARTS) + r.choice(["", " ", "x"]) for _ in range(r.randint(0, 12)))) for d in range(500)]
    rows += [(600, None), (601, ""), (602, "word " * 40_000 + "a@b.co"), (603, "1 " * 30_000), (604, "7" * 20_000), (3, rows[3][1]), (None, "a@b.co")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"base": F.lit("b"), "spans": F.lit(1), "content": F.lit(2), "terms": F.lit(3)})
    out = sanitise(docs).collect()
    assert len(out) == len(rows)
    texts = {(d, t or "") for d, t in rows}
    for x in out:
        held = [(s.start, s.rank, s.end, s.kind) for s in x.base]
        assert any(held == base(t) for d, t in texts if d == x.doc_id), (x.doc_id, held)
        assert set(x.base) <= set(x.spans)
    assert sanitise(docs.limit(0)).count() == 0


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"note {i} from Zorblax and the team at bob@firm.example about topic{'abcdefgh'[i]}") for i in range(6)]
    rows += [(100 + i, f"the team and a note about something {i}") for i in range(60)]
    rows += [(200, "Zorblax alone would be clean but for her mail eve@other.example")]
    out = {r.doc_id: r for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        t = dict(rows)[i]
        terms = [t[s.start : s.end] for s in out[i].spans if s.kind == "term"]
        assert "Zorblax" in terms and "the" not in terms and "topic" not in terms
        assert "bob@firm.example" not in out[i].clean_text and "Zorblax" not in out[i].clean_text and "[EMAIL]" in out[i].clean_text
    assert all(not r.spans and r.clean_text == dict(rows)[d] for d, r in out.items() if 100 <= d < 200)
    # the term gives the entity away where the entity itself does not stand, most of all
    assert [s.kind for s in out[200].spans] == ["term", "email"]
    assert out[200].clean_text == "[TERM] alone would be clean but for her mail [EMAIL]"


def test_terms_far_from_the_entity_count_as_well(spark):
    far = "plain words of filler " * 20
    rows = [(i, f"Zorblax wrote {far if i % 2 else ''}to bob@firm.example {far}about Quuxley {i}") for i in range(6)]
    rows += [(100 + i, f"{far} wrote to about something {i}") for i in range(60)]
    for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        terms = {dict(rows)[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "term"}
        assert terms == ({"Zorblax", "Quuxley"} if r.doc_id < 100 else set())


def test_long_domains_digits_and_many_matches(spark):
    """Patterns neither recurse nor try again inside a run."""
    rows = [(1, "a@" + "b." * 100_000 + "c"), (2, "7" * 1_000_000), (3, "x" * 300_000 + " a@b.c " + "y" * 300_000), (4, "1.2.3.4 " * 20_000), (5, "+1" + " " * 300_000 + "x"), (6, "1 " + "-" * 300_000)]
    out = {r.doc_id: r for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.start, s.end, s.kind) for s in out[1].base] == [(0, 200_003, "email")] and out[1].clean_text == "[EMAIL]"
    assert not out[2].base and not out[5].base and not out[6].base
    assert [(s.start, s.end) for s in out[3].base] == [(300_001, 300_006)]
    assert [(s.start, s.end) for s in out[4].base] == [(8 * i, 8 * i + 7) for i in range(20_000)]
    assert out[4].clean_text == "[IP] " * 20_000 and out[3].clean_text == rows[2][1].replace("a@b.c", "[EMAIL]")


def plain_terms(rows, together, disclosure):
    """Terms over the threshold, by the definition: (term, ratio) of the entity they reveal most."""
    texts = {t for _, t in rows}
    entity = {t: {f"{k}:{t[a:b].lower()}" for a, _, b, k in base(t)} for t in texts}
    words = {t: set(re.findall(r"[^\W\d_]+", re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|\+[0-9][\x20().0-9-]+[0-9]", " ", t).lower())) for t in texts}
    n, out = len(rows), {}
    for e in {e for held in entity.values() for e in held}:
        docs = sum(e in entity[t] for _, t in rows)
        for w in {w for t in texts if e in entity[t] for w in words[t]}:
            if sum(e in entity[t] and w in words[t] for t in texts) < together or docs == n:
                continue
            both = sum(e in entity[t] and w in words[t] for _, t in rows)
            ratio = math.log(both * n / (docs * sum(w in words[t] for _, t in rows))) / math.log(n / docs)
            if ratio >= disclosure:
                out[w] = max(out.get(w, 0), ratio)
    return out


def test_terms_against_the_definition(spark):
    r = random.Random(6)
    people = ["bob@firm.example", "eve@other.example", "10.0.0.7", "+1 (988) 555-2485"]
    common = ["the", "and", "note", "team", "Straße", "über"]
    rows = []
    for i in range(240):
        who = r.randrange(8)
        said = [r.choice(common) for _ in range(r.randint(3, 8))] + ([f"secret{'abcd'[who]}", people[who]] if who < 4 else [])
        said += [f"secret{r.choice('abcd')}"] if r.random() < 0.02 else []
        r.shuffle(said)
        rows.append((i, " ".join(said)))
    rows += [(300 + i, rows[5][1]) for i in range(5)] + [(None, rows[7][1])]
    wanted = plain_terms(rows, 3, 0.8)
    assert wanted
    out = sanitise(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), disclosure=0.8).collect()
    by = Counter(t for _, t in rows)
    for x in out:
        text = next(t for t in by if x.clean_text is not None and [(s.start, s.rank, s.end, s.kind) for s in x.base] == base(t) and (x.doc_id, t) in set(rows))
        spots = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text) if m.group().lower() in wanted and not any(a < m.end() and m.start() < b for a, _, b, _ in base(text))]
        assert [(s.start, s.end) for s in x.spans if s.kind == "term"] == spots
        clean, at = "", 0
        for a, b, label in sorted([(a, b, f"[{k.upper()}]") for a, _, b, k in base(text)] + [(a, b, "" if wanted[text[a:b].lower()] >= 1 - 1e-9 else "[TERM]") for a, b in spots]):
            clean, at = clean + text[at:a] + label, b
        assert x.clean_text == clean + text[at:]
