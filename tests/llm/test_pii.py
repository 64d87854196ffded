import hashlib
import random
import re

from quire.llm.pii import KINDS, labelled, personal_data
from quire.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, hit):
    digits = re.sub(r"[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(t - 9 if t > 9 else t for t in twice) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], text or "") if good(k, m[0])]


HARD = [
    None, "", "a@b.c_x@d.e.f@g.h", "..@a.b @c.d e@f", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3.4444444444444",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 4111  1111", "+1 (555) 555-2485 +49.30.1234567+ +1-2",
    "+1234567 +12345678 +1234567890123456", "\U0001f600 ä a.b%c+d@x-y.z-1.co \U0001f600", "12@34.56 1@2.3.4.5",
    "name (at) host (dot) org, 10 . 0 . 0 . 1", "00000000000000000000000001.2.3.4 0.0.0.0",
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(HARD)] * 2, "row long, text string, base string, kind int")
    got = personal_data(docs).collect()
    assert len(got) == 2 * len(HARD)
    for r in got:
        assert [(KINDS[s.kind], s.start, s.stop) for s in r.base] == brute(r._doc.text), r._doc.text
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op6_pii"](spark, sf_dir).collect():
        want = brute(docs[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in KINDS)
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_long_texts(spark):
    """The base spans are written down: the plain patterns need quadratic time for some of these."""
    n = 300_000
    want = {
        "a" * n: [], "1" * n: [], "1." * 30_000: [("ip", 8 * i, 8 * i + 7) for i in range(7_500)],
        "a@" + "b." * 150_000: [("email", 0, n + 1)], "+1 " * 100_000: [], "+1" + " " * n: [], "1 " * 150_000: [],
        "a@b.c " * 5_000: [("email", 6 * i, 6 * i + 5) for i in range(5_000)], "(at)" * 50_000: [],
    }
    got = {r._doc.text: r.base for r in personal_data(spark.createDataFrame([(t,) for t in want], "text string")).collect()}
    assert set(got) == set(want)
    for text, spans in want.items():
        assert [(KINDS[s.kind], s.start, s.stop) for s in got[text]] == spans, text[:20]


def check_digit(digits):
    twice = [int(d) * (2 - i % 2) for i, d in enumerate(reversed(digits))]
    return str(-sum(t - 9 if t > 9 else t for t in twice) % 10)


def planted(seed=5, n=400):
    """Texts with plain data, then data written otherwise with its spans, then what only looks like it."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choices("0123456789", k=k))
    plain, hidden, clean = [], [], []
    for i in range(n):
        card = rng.choice("3456") + number(14)
        card += check_digit(card)
        plain.append(f"text {rng.choice('abc')} +1 ({number(3)}) 555-{number(4)} and u{i}@mail{i % 9}.example.com, {card} or {'.'.join(str(rng.randint(1, 255)) for _ in range(4))} end")
    for i in range(60):
        card = "5" + number(14)
        card += check_digit(card)
        fours = [card[k : k + 4] for k in range(0, 16, 4)]
        own = [
            ("email", f"v{i}(at)host{i}.example.org"), ("email", f"w{i} [at] host (dot) example (dot) net"), ("card", "/".join(fours)), ("card", ".".join(fours)),
            ("ip", "[.]".join(str(rng.randint(1, 255)) for _ in range(4))), ("phone", f"1 ({number(3)}) 555-{number(4)}"), ("phone", f"001-{number(3)}-555-{number(4)}"),
        ]
        hidden += [(f"words before {hit} words after", kind, 13, 13 + len(hit)) for kind, hit in own]
        wrong = fours[:3] + [fours[3][:3] + str((int(fours[3][3]) + 1) % 10)]
        clean += [f"on {rng.choice(['20', '19'])}{number(2)}-07-1{number(1)} we met", "/".join(wrong), f"looked (at) him{i}", f"part {i} of {i % 7}", f"release {i}.{i % 11}.{i % 5}", f"300[.]{i}[.]1[.]2"]
    return plain, hidden, clean


def test_trees_add_altered_spans(spark):
    """Recall and precision of added spans on planted data."""
    plain, hidden, clean = planted()
    texts = plain + [h[0] for h in hidden] + clean
    got = {r._doc.text: r for r in personal_data(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)).collect()}
    extra = {t: {(KINDS[s.kind], s.start, s.stop) for s in r.spans if s not in r.base} for t, r in got.items()}
    found = sum((kind, a, b) in extra[t] for t, kind, a, b in hidden)
    wrong = sum(len(extra[t] - {(kind, a, b)}) for t, kind, a, b in hidden) + sum(len(extra[t]) for t in clean + plain)
    print("planted", len(hidden), "found", found, "wrong", wrong)
    assert found >= 0.9 * len(hidden)
    assert found >= 0.95 * (found + wrong)
    assert all([tuple(s) for s in r.base] == [(KINDS.index(k), a, b) for k, a, b in brute(t)] for t, r in got.items())


def test_empty_table(spark):
    assert personal_data(spark.createDataFrame([], "text string")).count() == 0


def test_the_trees_learn_from_every_labelled_span(spark):
    n = 25_000
    spans = spark.range(n).selectExpr(
        "id as row", "'email' as kind", "true as base", "0L as start", "10L as stop", "concat('a', id, '@b.org') as hit",
        "'' as before", "'' as after", "1 as y", "1 as z",
    )
    assert {r.y: r["count"] for r in labelled(spans).groupBy("y").count().collect()} == {1: n, 0: n}
