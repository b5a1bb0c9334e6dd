"""Operator 3, personal data: base patterns, and candidate gradient boosting for what they miss.

Base findings are the leftmost non-overlapping matches of fixed patterns and always stay. High-recall generators
propose further, overlapping spans (local phone numbers, spelled-out addresses, account and identity numbers).
Boosted trees score a proposal from its format and its context; a threshold for each kind, calibrated on labelled
findings that the trees did not see, selects. Of overlapping selections the highest score stays, and none may overlap a
base finding.

Labelled findings: the tables have none, so :func:`labelled_findings` writes them, true ones and look-alikes (order
numbers, versions, dates, measures), from a seed; ``detector`` takes any other list of (text, start, end, kind, label).

Offsets are code points, ends exclusive. Defined cases: NULL and empty texts have no finding; a NULL id is scanned
like any other; repeated rows repeat their result; only id and text are read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.text import Chosen, clean, small_batches
from odweave.llm.trees import Boosted

KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
#: Precision on unseen labelled findings that a kind's threshold has to reach.
PRECISION = 0.97

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(2 * int(c) - 9 * (c > "4") for c in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` from each @, so runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base findings, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


#: High-recall proposals beyond the base patterns.
_PROPOSALS = (
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,8}){1,4}(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2,3}[ -]?[0-9]{1,3}(?![0-9A-Za-z])")),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])")),
)
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[({]at[\])}]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[({]dot[\])}])\s?[A-Za-z0-9-]{1,63})+")
_ANY_NUMBER = re.compile(r"[0-9][0-9 .()/:A-Fa-f-]{5}")


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans that may be personal data."""
    out = []
    if _ANY_NUMBER.search(text):
        out = [(kind, *m.span()) for kind, pattern in _PROPOSALS for m in pattern.finditer(text)]
    if "at]" in text or "at)" in text or "at}" in text:
        out += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    return out


_CUES = (
    ("phone", re.compile(r"(?i)tel|phone|call|fax|mobile|cell|contact|whatsapp|dial")), ("card", re.compile(r"(?i)card|visa|master|credit|payment")),
    ("id", re.compile(r"(?i)ssn|social|security|tax")), ("bank", re.compile(r"(?i)iban|bank|account|transfer")), ("net", re.compile(r"(?i)\bip|address|host|server")),
    ("mail", re.compile(r"(?i)mail|write|contact|@")), ("other", re.compile(r"(?i)\bpart\b|article|order|invoice|version|ref|isbn|serial|date|page|lot|total|price|no\.|id\b|model|build|time|year")),
)
_ALL_KINDS = (*KINDS, *ADDED)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span, and what stands around it."""
    span, before, after = text[start:end], text[max(0, start - 30) : start], text[end : end + 15]
    groups = re.findall("[0-9]+", span)
    digits = "".join(groups)
    row = [float(kind == k) for k in _ALL_KINDS]
    row += [len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0]
    row += [span.count(c) for c in " -./(:"] + [len({c for c in span if not c.isalnum()})]
    row += [float(bool(digits) and luhn(digits)), float(digits[:1] == "0"), float(digits[:1] or -1), float(len(set(digits)))]
    row += [float(bool(p.search(before))) for _, p in _CUES]
    row += [sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), float(before[-1:] in "#$€£"), float(before[-1:] in ".,-/"), float(after[:1] in ".,-/%€$")]
    row.append(float(bool(re.match(r"(?:19|20)[0-9]{2}", groups[0] if groups else ""))))
    last = re.search(r"[A-Za-z0-9-]+\Z", span)
    row += [float(" . " in span), float("dot" in span.lower()), float(len(last[0])) if last else 0.0, float(bool(last) and not last[0].islower())]
    return row


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[str, int, int, str, int]]:
    """``(text, start, end, kind, label)``: true findings and look-alikes in short contexts."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9)))

    def filler(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def mailbox() -> str:
        return word() + rng.choice(["", "", number(2), f".{word()}", f"_{word()}", f"-{word()}"])

    def card() -> str:
        body = number(12 + rng.randrange(0, 3))
        check = next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", " ", "-"])
        digits = body + check
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def true_phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{number(3)} {number(6)}", f"00{rng.choice('1234')}{number(1)} {number(3)} {number(6)}", f"0{number(2)}/{number(7)}"])

    true = {
        "phone": (true_phone, ("call", "phone:", "tel.", "fax", "contact me at", "mobile", "", "")),
        "card": (card, ("card", "credit card number", "visa", "paid with", "")),
        "ssn": (lambda: f"{rng.randrange(1, 900):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}", ("ssn", "social security number", "tax id", "", "")),
        "iban": (lambda: f"{rng.choice(['DE', 'FR', 'ES', 'GB', 'NL'])}{number(2)}" + rng.choice([" ", ""]).join(["", *(number(4) for _ in range(4))]) + rng.choice(["", f" {number(2)}"]), ("iban", "bank account", "transfer to", "")),
        "ip": (lambda: ":".join(f"{rng.randrange(65536):x}" for _ in range(8)), ("ip", "server", "from address", "")),
        "email": (lambda: f"{mailbox()}{rng.choice([' [at] ', '(at)', ' (at) ', '[at]', ' {at} '])}{rng.choice(['', f'{word()}.', f'{word()}-'])}{word()}{rng.choice([' [dot] ', '.', ' (dot) ', '(dot)'])}{rng.choice(['com', 'org', 'net', 'de', 'uk', 'io', 'info'])}", ("mail", "write to", "contact", "")),
    }
    false = {
        "phone": (lambda: rng.choice([f"20{number(2)}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}.19{number(2)}", f"{number(2)} {number(3)} {number(3)}", f"{number(3)} {number(2)}", f"{number(4)}/{number(2)}", f"{number(5)}-{number(8)}-{number(4)}", f"{number(2)}.{number(2)}"]), ("order", "version", "isbn", "date", "pages", "total", "", "", "", "ref")),
        "card": (lambda: number(4) + "-" + number(4) + "-" + number(4) + "-" + number(2), ("serial", "order", "ref", "tracking", "")),
        "ssn": (lambda: f"{number(3)}-{number(2)}-{number(4)}", ("order", "part no.", "model", "invoice", "lot")),
        "iban": (lambda: "AB12" + "".join(rng.choice("ABCDEFGHJK0123456789") for _ in range(16)), ("serial", "key", "build", "model", "")),
        "ip": (lambda: ":".join(number(2) for _ in range(rng.randrange(4, 6))), ("time", "at", "ratio", "")),
        "email": (lambda: f"{word()} {rng.choice(['(at)', '[at]'])} {word()}{rng.choice([' . ', ' . ', '.'])}{rng.choice([word(), word().title() + 'ing'])}{rng.choice(['', 'tion'])}", ("meet", "sold", "", "price")),
    }
    out = []
    while len(out) < n:
        label = rng.random() < 0.5
        kind = rng.choice(("phone", "phone", "card", "ssn", "iban", "ip", "email"))
        make, cues = (true if label else false)[kind]
        cue, span = rng.choice(cues), make()
        head = f"{filler(rng.randrange(0, 5))} {cue}".strip()
        text = f"{head} {span}{rng.choice([' ', '. ', ', ', ''])}{filler(rng.randrange(0, 4))}".strip()
        start = text.index(span)
        out += [(text, a, b, k, int(label and k == kind and (a, b) == (start, start + len(span)))) for k, a, b in proposals(text)]
    return out[:n]


class Detector:
    """Boosted trees and each kind's calibrated threshold."""

    def __init__(self, findings: list[tuple[str, int, int, str, int]], precision: float = PRECISION):
        x = np.array([features(t, k, a, b) for t, a, b, k, _ in findings], float)
        y = np.array([f[4] for f in findings], float)
        held = np.arange(len(y)) % 3 == 2
        self.model = Boosted(x[~held], y[~held])
        self.thresholds = {}
        margin = self.model.margin(x[held])
        for kind in _ALL_KINDS:
            own = np.array([f[3] == kind for f in findings])[held]
            order = np.argsort(-margin[own], kind="stable")
            good = np.cumsum(y[held][own][order]) / np.arange(1, own.sum() + 1)
            pass_ = np.flatnonzero(good >= precision)
            self.thresholds[kind] = float(margin[own][order][pass_[-1]]) if len(pass_) else float("inf")

    def spans(self, texts: list[str]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
        """Base findings, and all findings, of each text; the trees score the proposals of all texts at once."""
        found = [base_spans(t) for t in texts]
        asked: list[tuple[int, str, int, int]] = []
        for i, (text, base) in enumerate(zip(texts, found, strict=True)):
            rows = proposals(text)
            if rows and base:
                taken = sorted((a, b) for _, a, b in base)
                starts, ends = np.array([a for a, _ in taken]), np.maximum.accumulate([b for _, b in taken])
                rows = [r for r in rows if not _overlaps(starts, ends, r)]
            asked += [(i, *r) for r in rows]
        added: dict[int, list[tuple[str, int, int]]] = {}
        if asked:
            margin = self.model.margin(np.array([features(texts[i], *r) for i, *r in asked], float))
            chosen: dict[int, Chosen] = {}
            for j in np.argsort(-margin, kind="stable"):
                i, kind, a, b = asked[j]
                if margin[j] >= self.thresholds[kind] and chosen.setdefault(i, Chosen()).take(a, b):
                    added.setdefault(i, []).append((kind, a, b))
        listed = lambda base, own: sorted([*base, *own], key=lambda s: (_ALL_KINDS.index(s[0]), s[1], s[2])) if own else base
        return [(base, listed(base, added.get(i))) for i, base in enumerate(found)]


def _overlaps(starts: np.ndarray, ends: np.ndarray, span: tuple[str, int, int]) -> bool:
    i = int(np.searchsorted(starts, span[2]))  # base spans that start before this one ends
    return i > 0 and int(ends[i - 1]) > span[1]


@lru_cache(maxsize=1)
def detector() -> Detector:
    """The detector of the built-in labelled findings."""
    return Detector(labelled_findings())


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(documents: DataFrame, found_by: Detector | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``: counts and digest of the base findings, and all."""
    small_batches(documents)
    model = found_by or detector()
    read = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, listed = [], [], []
            for base, every in model.spans(clean(batch.column(1)).to_pylist()):
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                listed.append(_listed(every))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(listed, pa.string())],
                [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return read.mapInArrow(kernel, f"`{id_col}` {read.schema['id'].dataType.simpleString()}, {kinds}, base_sha256 string, spans string")


def redact(text: str | None, found_by: Detector | None = None) -> str | None:
    """The text with every finding replaced by its kind."""
    if not text:
        return text
    out, done = [], 0
    for kind, a, b in sorted((found_by or detector()).spans([text])[0][1], key=lambda s: (s[1], -s[2])):
        if b > done:
            out += [text[done : max(a, done)], f"<{kind}>" if a >= done else ""]
            done = b
    return "".join([*out, text[done:]])
