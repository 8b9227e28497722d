import hashlib
import math
import random
import re

from sedimenta.llm import pii

from .helpers import odd_documents, table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, x in enumerate(d[::-1]):
        x *= 1 + i % 2
        total += x - 9 * (x > 9)
    return total % 10 == 0


def reference(t):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_are_those_of_the_expressions():
    r = random.Random(2)
    for _ in range(20_000):
        t = "".join(r.choice("0123456789.@+-( )aé_%4242 000") for _ in range(r.randint(0, 80)))
        assert pii.base_spans(t) == reference(t), t
    for t in ("0" * 30 + "1.2.3.4", "000000001.2.3.4", "1.2.3.0255", "1.2.3.256", "a@b.c_d@e.f", "4111 1111 1111 1111", "+1 (988) 555-2485"):
        assert pii.base_spans(t) == reference(t), t


def test_very_long_runs_take_linear_time():
    for t in ("a" * 300_000 + "@", "@" * 100_000, "1" * 300_000, "+1" * 100_000, "1." * 100_000, "a.b" * 50_000 + "@x", "1" * 100_000 + "x", "1 " * 100_000, "1-" * 50_000 + "x 1", ("+" * 1000 + " ") * 100):
        pii.mentions(t, pii.base_spans(t))


def test_patterns_find_what_expressions_miss(spark):
    rows, i = [], 0
    r = random.Random(4)
    word = lambda: "".join(r.choice("bcdfgh") for _ in range(5))
    for _ in range(40):
        n = f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
        rows.append((i, f"{word()} {word()} please call me at {n} {word()}", "s", "en", 0))
        rows.append((i + 1, f"{word()} writes to mail: {word()}@{word()}.com {word()}", "s", "en", 0))
        i += 2
    rows.append((900, f"{word()} please call me at 555-123-4567 {word()}", "s", "en", 0))
    rows.append((901, f"{word()} writes to mail: root@localhost {word()}", "s", "en", 0))
    rows.append((902, f"elsewhere 555-123-4567 {word()} and 555-999-0000", "s", "en", 0))
    rows.append((903, f"order number 1234567890 {word()}", "s", "en", 0))
    got = {x.doc_id: x for x in pii.find(table(spark, rows)).collect()}
    start = rows[-4][1].index("555")
    assert got[900].n_spans == 1 and got[903].n_spans == 0
    assert got[900].spans == f"phone:{start}:{start + 12}" and got[900].n_phone == 0
    assert got[901].spans.startswith("email:") and got[902].spans == "phone:10:22" and got[903].spans == ""
    assert all(got[k].n_phone == 1 and got[k].spans.startswith("phone:") for k in range(0, 80, 2))
    assert got[903].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_words_that_stand_before_anything_vouch_for_nothing(spark):
    rows = [(i, f"the +1 (415) 555-{1000 + i} and the dog and the cat and the sky and the end", "s", "en", 0) for i in range(50)]
    rows.append((99, "the 555-123-4567 of", "s", "en", 0))
    assert {r.doc_id: r.spans for r in pii.find(table(spark, rows)).collect()}[99] == ""


def test_odd_rows_and_redaction(spark):
    docs = odd_documents(spark)
    got = pii.find(docs)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"] and got.count() == docs.count()
    assert pii.find(docs.limit(0)).count() == 0
    clean = pii.without(docs.limit(0))
    assert clean.columns == docs.columns and clean.count() == 0
    texts = table(spark, [(1, "mail a.b@c.de now", "s", "en", 17), (2, None, "s", "en", None), (3, "10.0.0.1 é", "s", "en", 10)])
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.without(texts).collect()}
    assert out == {1: ("mail <EMAIL> now", 16), 2: (None, None), 3: ("<IP> é", 6)}
    assert pii.redacted("0123456789", "ip:1:4,card:3:6,phone:8:9") == "0<IP>67<PHONE>9"


def test_a_context_of_few_seeds_counts_in_a_large_corpus(spark):
    """80,000 other known numbers, each in a context of its own, take nothing from six."""
    rows = [(i, f"x{i} please ring +1 (415) 555-{1000 + i} y{i}", "s", "en", 0) for i in range(6)] + [(9, "x9 please ring 555-123-4567 y9", "s", "en", 0)]
    many = spark.range(100, 80_100).selectExpr("id AS doc_id", "concat('a', id, ' b', id, ' +1', 1000000000 + id, ' c', id) AS text", "'s' AS source", "'en' AS lang", "0L AS n_chars")
    for docs in (table(spark, rows), table(spark, rows).unionByName(many)):
        assert pii.find(docs).where("doc_id = 9").first().spans == "phone:15:27"


def test_rounds_go_on_while_they_find_something(spark):
    """Numbers of each generation stand in a context that only the generation before vouches for."""
    rows = [(i, f"x{i} alpha0 +1 (415) 555-{1000 + i} y{i}", "s", "en", 0) for i in range(6)]
    for g in range(1, 7):
        rows += [(100 * g + 10 * k + i, f"x{g}{k}{i} alpha{g - k} 555-000-{g}00{i} y{g}{k}{i}", "s", "en", 0) for i in range(6) for k in (0, 1)]
    assert pii.find(table(spark, rows)).where("spans = ''").count() == 0


def test_long_tokens_and_long_words_count(spark):
    rows = [(i, f"x{i} write to: u{i}@host.com y{i}", "s", "en", 0) for i in range(8)] + [(50, "x write to: root@" + "h" * 70 + " y", "s", "en", 0)]
    long = "w" * 85
    rows += [(100 + i, f"x{i} {long} +1 (415) 555-{1000 + i} y{i}", "s", "en", 0) for i in range(8)] + [(200, f"z {long} 555-123-4567 z", "s", "en", 0)]
    got = {r.doc_id: r.spans for r in pii.find(table(spark, rows)).collect()}
    assert got[50] == "email:12:87" and got[200] == "phone:88:100"


def plain(texts, support=5, purity=0.8, accept=0.7):
    """Spans of each text by the definition: all texts, all contexts and all instances again in each round."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    found = [pii.mentions(t, reference(t)) for t in texts]
    known = {}
    for m in (m for ms in found for m in ms if m[2] >= 0):
        known.setdefault(m[4], set()).add(m[2])
    seeds, learned, last = set(known), {}, None

    def total(context):
        kind, *w = context.split(" ")
        return sum(sum(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1)) for x in words)

    while learned != last:
        of = {k: set(v) for k, v in known.items()} | {k: {v} for k, v in learned.items()}
        contexts = {}
        for m in (m for ms in found for m in ms):
            for c in m[5]:
                key = (m[4], m[3])
                contexts.setdefault(c, {}).setdefault(key, 0)
                contexts[c][key] += 1
        patterns = {}
        for c, fillers in contexts.items():
            for k in range(4):
                rows = [(kind, shapes, n) for (x, shapes), n in fillers.items() for kind in of.get(x, {None})]
                fits = lambda r: r[0] is None and r[1] >> k & 1  # noqa: E731, B023
                pos = sum(r[0] == k for r in rows)
                neg = sum(r[0] != k and not fits(r) for r in rows)
                here = sum(r[2] for r in rows if r[0] == k or fits(r))
                if pos >= support and pos / (pos + neg + 1) >= purity and 2 * here > total(c):
                    patterns.setdefault(c, {})[k] = pos / (pos + neg + 1)
        doubt = {}
        for c, ks in patterns.items():
            for x, shapes in {key for key in contexts[c]}:
                for k, conf in ks.items():
                    if shapes >> k & 1:
                        doubt.setdefault(x, {}).setdefault(k, []).append(1 - conf)
        scores = {x: max((1 - math.prod(d), -k) for k, d in ks.items()) for x, ks in doubt.items() if x not in seeds}
        last, learned = learned, {x: -k for x, (score, k) in scores.items() if score >= accept}
    return [pii.joined([(m[0], m[2], m[1]) for m in ms if m[2] >= 0] + [(m[0], learned[m[4]], m[1]) for m in ms if m[2] < 0 and m[4] in learned]) for ms in found]


def test_discovered_spans_are_those_of_the_definition(spark):
    more = 0
    for seed in range(3):
        r = random.Random(seed)
        cues = ["tel", "fax", "Ring", "mail", "id", "the"]

        def identifier(cue):
            if cue == "mail":
                return r.choice([f"u{r.randint(0, 30)}@h{r.randint(0, 9)}.org", f"u{r.randint(0, 30)}@local"])  # noqa: B023
            if cue in ("tel", "fax", "Ring"):
                return r.choice([f"+1 415 555-{r.randint(1000, 1040)}", f"555-{r.randint(100, 120)}-0000"])  # noqa: B023
            return r.choice([str(r.randint(10**7, 10**7 + 20)), "cat", "dog", f"+44 20 {r.randint(10**7, 10**7 + 9)}"])  # noqa: B023

        texts = []
        for _ in range(120):
            parts = []
            for _ in range(r.randint(1, 3)):
                cue = r.choice(cues)
                parts.append(f"w{r.randint(0, 9)} {cue} {identifier(cue)} {r.choice(['end', 'and', 'or.'])}")
            texts.append(" ".join(parts))
        got = {x.doc_id: x.spans for x in pii.find(table(spark, [(i, t, "s", "en", 0) for i, t in enumerate(texts)])).collect()}
        want = plain(texts)
        assert [got[i] for i in range(len(texts))] == want
        more += sum(w != pii.joined(reference(t)) for w, t in zip(want, texts, strict=True))
    assert more > 20
