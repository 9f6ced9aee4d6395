import hashlib
import re

import numpy as np
import pytest

from lamella.llm import pii

SCHEMA = "doc_id long, text string, n_chars long, spans int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def fine(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    order = list(PATTERNS)
    found = [(m.start(), order.index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fine(k, m[0])]
    return [f"{order[k]}:{a}:{b}" for a, k, b in sorted(found)]


def texts():
    rng = np.random.default_rng(6)
    parts = ["a@b.com", "x.y+z%1@sub-1.example.org.", "@b.com", "a@b", "a@@b.co", "1.2.3.4", "256.1.1.1", "01.002.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "5500000000000004", "378282246310005", "+1 (555) 010-9999", "+49 30 123456", "+1.2", "+12345678901234567", "phone", "call", "card", "é", "日本", "12", " ", "-", "(at)", "a [at] b [dot] com",
             "token=AbCdEf0123456789abcdEF0123", "SSN 123-45-6789", "00000000000000"]
    made = [" ".join(rng.choice(parts, int(n))) for n in rng.integers(0, 14, 200)]
    made += ["".join(rng.choice(parts, int(n))) for n in rng.integers(0, 10, 200)]
    return [*made, "a@b.com" * 3000, "1." * 5000, "9" * 5000, "+1" + "(" * 3000, None, "", " \n\t", "word " * 100_000 + "z@example.com"]


def test_base_spans_match_brute_force(spark):
    made = texts()
    rows = [(i, t, 0, 1) for i, t in enumerate(made)] + [(3, made[3], 0, 1), (None, "a@b.com", 0, 1)]
    found = pii.find(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        base = brute("a@b.com" if r.doc_id is None else made[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        counts = [sum(s.startswith(f"{k}:") for s in base) for k in PATTERNS]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert set(base) <= set(r.spans.split(","))
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)


def test_spans_are_added_where_labelers_agree(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    docs = [f"{word()} token: {''.join(rng.choice(list('abcdefXYZ0123456789'), 32))} {word()}" for _ in range(60)]
    docs += [f"mail {word()}@example.com or call +1 555 010 {rng.integers(1000, 9999)}" for _ in range(60)]
    docs += [f"{word()} {word()} in 1999 and 2004" for _ in range(60)]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame([(i, t, 0, 1) for i, t in enumerate(docs)], SCHEMA)).collect()}
    assert all(found[i].startswith("secret:") for i in range(60))
    assert all(found[i] == "" for i in range(120, 180))


def test_added_spans_are_those_of_sure_patterns(spark):
    """Against the patterns and probabilities counted here, and precision and recall on what was planted."""
    rng = np.random.default_rng(5)
    word = lambda n=6: "".join(rng.choice(list("abcdefgh"), n))
    hexes = lambda n: "".join(rng.choice(list("abcdef0123456789"), n))
    docs, planted = [], []
    for i in range(500):
        kind = i % 5
        secret = [hexes(40), f"{hexes(15)}9", f"{word()} [at] {word()} [dot] com", f"{word()}@{word()}.org", ""][kind]
        lead = [f"{word()} ", "password=", f"{word()} ", ("mail ", f"{word()} ")[i % 2], f"{word()} in 19{rng.integers(10, 99)} or 1 000 {rng.integers(10**6, 10**7)} "][kind]
        docs.append(f"{word()} {lead}{secret} {word()}")
        start = docs[-1].index(secret) if secret else 0
        planted.append({(start, start + len(secret))} if secret else set())
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame([(i, t, 0, 1) for i, t in enumerate(docs)], SCHEMA)).collect()}
    counts = {}
    for t in docs:
        for *_, code in pii.candidates(t)[1]:
            counts[code] = counts.get(code, 0) + 1
    sure = {c for c, p in pii.classifier(counts).items() if p >= pii.SURE}
    right = wrong = 0
    for i, t in enumerate(docs):
        spans = {tuple(map(int, s.split(":")[1:])) for s in found[i].split(",") if s}
        assert spans == {(a, b) for a, b, k, code in pii.candidates(t)[1] if k in PATTERNS or code in sure}
        right += len(spans & planted[i])
        wrong += len(spans - planted[i])
    assert right >= 0.95 * 400 and wrong <= 0.02 * right


def test_redaction(spark):
    docs = [(1, "mail a@b.com now", 16, 1), (2, None, 0, 1), (3, "no data", 7, 1), (4, "1.2.3.4 and +1 555 010 9999", 27, 1), (1, "mail a@b.com now", 16, 1)]
    rows = spark.createDataFrame(docs, SCHEMA)
    kept = pii.redact(rows)
    assert kept.columns == rows.columns
    found = sorted(((r.doc_id, r.text, r.n_chars) for r in kept.collect()), key=str)
    assert found == sorted([(1, "mail [EMAIL] now", 16), (1, "mail [EMAIL] now", 16), (2, None, 0), (3, "no data", 7), (4, "[IP] and [PHONE]", 16)], key=str)


@pytest.mark.parametrize("rows", [[], [(1, None, 0, 1)]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.spans for r in pii.find(df).collect()] == [""] * len(rows)
    assert pii.redact(df).count() == len(rows)


def test_expectation_maximisation_finds_the_reliable_labeler():
    rng = np.random.default_rng(3)
    counts = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        votes = [int(1 + true) if rng.random() < p else int(2 - true) for p in (0.95, 0.9, 0.9, 0.55)]
        code = 0
        for v in votes:
            code = 3 * code + v
        counts[code] = counts.get(code, 0) + 1
    _, table = pii.reliabilities(counts)
    right = [(table[k][0, 1] + table[k][1, 2]) / 2 for k in range(4)]
    assert right[0] > 0.85 and right[1] > 0.8 and right[2] > 0.8 and right[3] < 0.7
