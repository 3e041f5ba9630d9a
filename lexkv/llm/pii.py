"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexkv.llm.common import arrow_map, batch, strings

#: Kinds in order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Score of a span before context, after its validator passed.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
#: Words near a span that raise its score.
CONTEXT = {
    "email": ("mail", "contact", "correo"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "telefon"),
    "iban": ("iban", "bank", "konto", "account"),
    "ssn": ("ssn", "social", "security"),
}
CONTEXT_CHARS, CONTEXT_BONUS, LEAST_SCORE = 40, 0.3, 0.5
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the possessive runs and the look-behind change no match: they keep long runs of digits linear
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
NOT_DIGIT = re.compile(r"[^0-9]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(_DOUBLED[x] for x in d[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    x = iban.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@domain, found from each @ outward in linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        left = text[last:at]
        start = last + len(left.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the four base kinds, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p) < 4 and int(p) <= 255 or int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() >= 14 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def ibans(text: str) -> list[tuple[int, int]]:
    """From each start the longest match that mod-97 confirms: words behind an IBAN may look like a part of it."""
    out, last = [], 0
    for start in IBAN_START.finditer(text):
        at = start.start()
        m = IBAN.match(text, at) if at >= last else None
        while m and not mod97(m[0]):
            # the same match without its last word
            m = IBAN.fullmatch(text, at, at + m[0].rfind(" ")) if " " in m[0] else None
        if m:
            out.append((at, m.end()))
            last = m.end()
    return out


def added_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(a, 4, b) for a, b in ibans(text)]
    return out + [(m.start(), 5, m.end()) for m in SSN.finditer(text)] if "-" in text else out


def score(text: str, span: tuple[int, int, int]) -> float:
    start, kind, end = span
    near = (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()
    return min(1.0, BASE_SCORE[KINDS[kind]] + CONTEXT_BONUS * any(w in near for w in CONTEXT[KINDS[kind]]))


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]:
    """Base spans, all spans whose score holds (base ones always do), and the highest score."""
    base = base_spans(text)
    more = [s for s in added_spans(text) if score(text, s) >= LEAST_SCORE]
    every = sorted(base + more)
    return base, every, max((score(text, s) for s in every), default=0.0)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _detect(batches):
    for b in batches:
        n, sha, every, best = [], [], [], []
        for x in b["text"]:
            base, found, top = spans(x.as_py() or "")
            kinds = [k for _, k, _ in base]
            n.append([kinds.count(k) for k in range(4)])
            sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
            every.append(joined(found))
            best.append(top)
        n = np.array(n, dtype=np.int64).reshape(-1, 4)
        yield batch(doc_id=b["doc_id"], n_email=n[:, 0], n_ip=n[:, 1], n_card=n[:, 2], n_phone=n[:, 3], base_sha256=strings(sha), spans=strings(every), max_score=np.array(best, dtype=np.float64))


def detected(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: counts and digest of the base spans, all spans and the highest score.

    Null and empty texts have no spans; repeated rows repeat; a null doc_id
    stays null; extra columns are ignored; an empty table gives an empty result.
    """
    return arrow_map(docs.select("doc_id", "text"), _detect, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, max_score double")


def masked_text(text: str) -> str:
    """Spans replaced by [KIND]; overlapping spans become the first one's mask."""
    every = spans(text)[1]
    out, last = [], 0
    for a, k, b in every:
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, b)
    return "".join(out) + text[last:] if every else text


def masked(docs: DataFrame) -> DataFrame:
    """docs with personal data in text masked; n_chars, where present, follows. Null texts stay null."""
    names = docs.columns

    def task(batches):
        for b in batches:
            cols = {c: b[c] for c in names}
            cols["text"] = strings([None if x.as_py() is None else masked_text(x.as_py()) for x in b["text"]])
            yield batch(**cols)

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    out = arrow_map(docs, task, schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in names else out
