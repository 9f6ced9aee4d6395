"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Base spans follow fixed patterns and always stay. Around them, wider candidates (numbers, long tokens, what is assigned to
a password or a key, spelled-out addresses) are found. Regex, gazetteer, context and shape labelers vote on every candidate; the counts of each pattern
of votes over all documents go through expectation-maximisation, which estimates how reliable each labeler is, and a
logistic span classifier is trained on the posteriors. A candidate outside the base is added where its
probability is SURE or more, and nothing else decides.

A pattern of votes is a small number, so what is gathered is a table of at most a few thousand counts, however many
documents there are. Two rounds over the texts are needed only to redact; the spans themselves take one.

Defined results: null text counts as empty and has no spans; an empty table has none; repeated documents each get a
row; of wider candidates that overlap the first counts, then the longest, and none that overlaps a base span; very long
texts are read whole; extra columns are never read by find(), and kept by redact().
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "number", "address")
SURE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does: from inside a run, what follows the run is the same.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[0-9][0-9 ().-]{5,}[0-9]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+")
_ASSIGNED = re.compile(r"(?i:password|passwd|secret|token|bearer|api[_-]?key)[\"']?(?: ?[:=] ?|[ ])[\"']?([A-Za-z0-9+/_-]{8,128})(?![A-Za-z0-9+/_-])")
_RANDOM = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}|(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])[A-Za-z0-9_-]{32,}")
_GROUPED = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|(?:[0-9]{2,4}[ .-]){3,5}[0-9]{2,4}")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){1,5}")
_BEFORE = re.compile(r"([A-Za-zÀ-ÿ-]{2,20})[\s\"'=:]*$")

_GAZETTEER = {
    "email": {"email", "e-mail", "mail", "contact", "write", "courriel", "correo"},
    "ip": {"ip", "host", "address", "server", "login", "from"},
    "card": {"card", "visa", "mastercard", "credit", "amex", "carte", "karte", "tarjeta", "account"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "cell"},
    "secret": {"token", "key", "secret", "password", "passwd", "apikey", "bearer", "api-key"},
    "number": {"ssn", "passport", "account", "iban", "phone", "tel", "call", "fax", "mobile", "id"},
    "address": {"email", "e-mail", "mail", "contact", "write", "reach"},
}
_SUFFIXES = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "us", "ch", "at", "it"}


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans (start, end, kind), and the matches that failed a check; both by start, then kind as listed."""
    good = [(a, b, "email") for a, b in _emails(text)]
    bad = []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            (good if all(map(_small, m.groups())) else bad).append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            (good if 14 <= len(digits) <= 19 and _luhn(digits) else bad).append((*m.span(), "card"))
        for m in _PHONE.finditer(text):
            (good if 10 <= sum(map(m[0].count, "0123456789")) <= 15 else bad).append((*m.span(), "phone"))
    order = lambda s: (s[0], BASE_KINDS.index(s[2]))
    return sorted(good, key=order), sorted(bad, key=order)


def _votes(text: str, span: tuple[int, int, str], failed: list) -> tuple[int, ...]:
    """Votes of the labelers on a span: 0 abstains, 1 against, 2 for."""
    a, b, kind = span
    body = text[a:b]
    digits = sum(map(body.count, "0123456789"))
    if kind == "number":
        regex = 1 if digits >= 14 and any(x < b and a < y for x, y, _ in failed) else 2 if _GROUPED.fullmatch(body) else 0
    elif kind == "secret":
        assigned = _ASSIGNED.search(text, max(0, a - 24), b)
        regex = 2 if _RANDOM.fullmatch(body) or assigned and assigned.span(1) == (a, b) else 0
    else:
        regex = 2  # each has a pattern of its own
    word = _BEFORE.search(text, max(0, a - 40), a)
    gazetteer = 2 if word and word[1].lower() in _GAZETTEER[kind] else 0
    left, right = text[a - 1 : a], text[b : b + 1]
    context = 1 if left.isalnum() or right.isalnum() else 2 if (not left or left.isspace() or left in "\"'(<:=") else 0
    if kind in ("email", "address"):
        shape = 2 if re.split(r"[. )\]]", body)[-1].lower() in _SUFFIXES else 1
    elif kind == "ip":
        shape = 1 if body.startswith("0") or body.count(".0") > 2 else 2
    elif kind == "card":
        shape = 2 if body[0] in "3456" else 0
    elif kind == "phone":
        shape = 2 if digits >= 11 else 0
    elif kind == "secret":
        shape = 2 if len(set(body)) >= 8 and 0.2 < digits / len(body) < 0.95 else 1
    else:
        shape = 2 if 9 <= digits <= 12 and len(body) > digits else 1
    return regex, gazetteer, context, shape


LABELERS = ("regex", "gazetteer", "context", "shape")


def candidates(text: str) -> tuple[list, list[tuple[int, int, str, int]]]:
    """Base spans; and every candidate, the base included, with the number of its pattern of kind and votes."""
    if "@" not in text and not _DIGIT.search(text) and "at)" not in text and "at]" not in text:
        return [], []
    base, failed = base_spans(text)
    wide = []
    if _DIGIT.search(text):
        wide += [(*m.span(), "secret") for m in _TOKEN.finditer(text) if re.search("[A-Za-z]", m[0]) and _DIGIT.search(m[0])]
        wide += [(*m.span(1), "secret") for m in _ASSIGNED.finditer(text) if _DIGIT.search(m[1])]
        wide += [(*m.span(), "number") for m in _NUMBER.finditer(text)]
    if "at)" in text or "at]" in text:
        wide += [(*m.span(), "address") for m in _SPELLED.finditer(text)]
    edge, extra = 0, []
    taken = sorted((a, b) for a, b, _ in base)
    place = 0
    for span in sorted(wide, key=lambda s: (s[0], -s[1])):
        while place < len(taken) and taken[place][1] <= span[0]:
            place += 1
        clear = all(b <= span[0] or a >= span[1] for a, b in taken[max(0, place - 4) : place + 4])
        if span[0] >= edge and clear:
            extra.append(span)
            edge = span[1]
    out = []
    for is_base, spans in ((True, base), (False, extra)):
        for span in spans:
            near = [f for f in failed if f[0] < span[1] and span[0] < f[1]] if not is_base else []
            code = KINDS.index(span[2])
            for v in _votes(text, span, near):
                code = 3 * code + v
            out.append((*span, code))
    return base, out


def _features(code: int) -> tuple[int, list[int]]:
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v)
    return code, votes[::-1]


def reliabilities(counts: dict[int, int], rounds: int = 60) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of each pattern, and P(vote | class) by labeler, from the patterns' counts."""
    codes = sorted(counts)
    votes = np.array([_features(c)[1] for c in codes]).reshape(-1, len(LABELERS))
    n = np.array([counts[c] for c in codes], dtype=np.float64)
    prior = np.array([0.5, 0.5])
    table = np.array([[[0.5, 0.3, 0.2], [0.4, 0.1, 0.5]]] * len(LABELERS))  # labeler, class, vote
    post = np.zeros((len(codes), 2))
    for _ in range(rounds):
        log = np.log(prior) + sum(np.log(table[k][:, votes[:, k]].T) for k in range(len(LABELERS)))
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = post * n[:, None]
        prior = (mass.sum(axis=0) + 1) / (mass.sum() + 2)
        for k in range(len(LABELERS)):
            for v in range(3):
                table[k][:, v] = mass[votes[:, k] == v].sum(axis=0) + 1
            table[k] /= table[k].sum(axis=1, keepdims=True)
    return dict(zip(codes, post[:, 1].tolist(), strict=True)), table


def _design(code: int) -> np.ndarray:
    kind, votes = _features(code)
    row = np.zeros(1 + len(KINDS) + 2 * len(LABELERS))
    row[0] = row[1 + kind] = 1
    for k, v in enumerate(votes):
        if v:
            row[len(KINDS) + 2 * k + v] = 1
    return row


def classifier(counts: dict[int, int]) -> dict[int, float]:
    """Probability by pattern: logistic regression (Newton, ridge) on the posteriors, weighted by count."""
    if not counts:
        return {}
    post, _ = reliabilities(counts)
    x = np.array([_design(c) for c in post])
    y, n = np.array(list(post.values())), np.array([counts[c] for c in post], dtype=np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (n * (y - p)) - w)
    return dict(zip(post, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def accepted(counts: dict[int, int], sure: float = SURE) -> set[int]:
    """Patterns of kinds outside the base to which the classifier gives a probability of sure or more."""
    return {code for code, p in classifier(counts).items() if p >= sure and not _is_base(code)}


_SPANS = "array<struct<start:int,end:int,kind:int,code:int>>"


def _extracted(docs: DataFrame) -> DataFrame:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("code", pa.int32())]))

    def run(batch):
        rows = [
            [{"start": a, "end": b, "kind": KINDS.index(k), "code": c} for a, b, k, c in candidates(t or "")[1]]
            for t in batch.column("text").to_pylist()
        ]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, spans {_SPANS}")


def _is_base(code: int) -> bool:
    return _features(code)[0] < len(BASE_KINDS)


def _counts(spans: DataFrame) -> dict[int, int]:
    return {r.code: r["count"] for r in spans.select(F.explode("spans.code").alias("code")).groupBy("code").count().collect()}


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    spans = stored(_extracted(docs), "spans")
    added = accepted(_counts(spans))

    def run(batch):
        rows = []
        for i, found in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            found = sorted((s["start"], s["kind"], s["end"], s["code"]) for s in found)
            base = [s for s in found if _is_base(s[3])]
            text = lambda some: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in some)
            kept = [s for s in found if _is_base(s[3]) or s[3] in added]
            n = [sum(s[1] == k for s in base) for k in range(4)]
            rows.append((i, *n, hashlib.sha256(text(base).encode()).hexdigest(), text(kept)))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_arrow(spans, run, schema)


def redacted(text: str, added: set[int]) -> str:
    """text with every span of the base, and of the patterns added, replaced by its kind in brackets."""
    out, last = [], 0
    for a, k, b, c in sorted((a, KINDS.index(k), b, c) for a, b, k, c in candidates(text)[1]):
        if not (_is_base(c) or c in added) or b <= last:
            continue
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = b
    return "".join([*out, text[last:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced; n_chars, if there is one, follows the text. No document is dropped."""
    added = accepted(_counts(_extracted(docs)))
    names = docs.columns

    def run(batch):
        old = batch.column("text").to_pylist()
        new = [t and redacted(t, added) for t in old]
        columns = list(batch.columns)
        at = names.index("text")
        columns[at] = pa.array(new, batch.schema.field(at).type)
        if "n_chars" in names:
            at = names.index("n_chars")
            sizes = [c if n == o else len(n) for c, o, n in zip(batch.column(at).to_pylist(), old, new, strict=True)]
            columns[at] = pa.array(sizes, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, run, docs.schema)
