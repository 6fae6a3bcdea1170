"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

The patterns of the base kinds are matched in time linear in the text, also for long runs of letters or digits: an
address is searched from its ``@`` outwards, and runs of digits are taken whole, which finds the same leftmost,
non-overlapping matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import text_slices

#: The kinds in the order they are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    x[:2]: int(x[2:]) for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 "
        "GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 "
        "MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
#: Score of a span by its form and checks alone, and what words nearby add or take, the more the nearer they are: all of
#: it next to the span, half of it ``CONTEXT_CHARS`` away.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.55}
CONTEXT_SCORE, CONTEXT_CHARS = 0.3, 48
#: Words that speak for a kind, in English, German, French and Spanish; the next table has words against it.
FOR = {
    "email": "email e-mail mail contact write address kontakt schreiben adresse courriel écrire contacter correo escribir contacto dirección",
    "ip": "ip host server address login client rechner adresse anmeldung serveur connexion hôte servidor dirección conexión equipo",
    "card": "card credit debit visa mastercard amex payment cvv karte kreditkarte kartennummer zahlung carte crédit bancaire paiement tarjeta crédito pago",
    "phone": "phone tel telephone call mobile cell fax whatsapp sms telefon rufnummer handy anruf anrufen téléphone portable appeler appelez teléfono móvil llamar llame",
    "iban": "iban bank account swift bic konto kontonummer überweisung bankverbindung compte banque virement rib cuenta banco transferencia",
    "ssn": "ssn social security",
}
AGAINST = {
    "email": "example beispiel exemple ejemplo",
    "ip": "version release build chapter section kapitel abschnitt chapitre versión capítulo sección",
    "card": "isbn order invoice tracking ticket bestellung rechnung sendung commande facture colis pedido factura envío",
    "phone": "isbn order invoice formula bestellung rechnung commande facture pedido factura",
    "iban": "serial model product seriennummer modell produkt modèle produit serie modelo producto",
    "ssn": "part order product isbn teil bestellung",
}


def _words(listed: str) -> re.Pattern:
    return re.compile(r"(?i)(?<!\w)(?:" + "|".join(map(re.escape, sorted(listed.split(), key=len, reverse=True))) + r")(?!\w)")


CONTEXT = {kind: (_words(FOR[kind]), _words(AGAINST[kind])) for kind in KINDS}
#: A span the method adds to the base is reported from this score on.
LEAST_SCORE = 0.7
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in (2 * int(x) for x in digits[-2::-2]))
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return IBAN_LENGTHS.get(plain[:2]) == len(plain) and int("".join(str(int(x, 36)) for x in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > done and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            done = domain.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _byte(part: str) -> bool:
    plain = part.lstrip("0")
    return len(plain) < 3 or len(plain) == 3 and plain <= "255"


def _nearness(pattern: re.Pattern, before: str, after: str) -> float:
    """0 without a word of the pattern, else between a half, at the rim of the context, and 1, next to the span."""
    gaps = [len(before) - m.end() for m in pattern.finditer(before)][-1:] + [m.start() for m in pattern.finditer(after)][:1]
    return 1 - min(gaps) / (2 * CONTEXT_CHARS) if gaps else 0.0


def context(kind: str, text: str, start: int, end: int) -> float:
    """What the words around a span add to its score, or take from it."""
    before, after = text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS]
    speaks, denies = CONTEXT[kind]
    return CONTEXT_SCORE * (_nearness(speaks, before, after) - _nearness(denies, before, after))


def spans(text: str) -> list[tuple[int, int, int, float]]:
    """``(start, place in KINDS, end, score)`` of all spans by start, then kind."""
    found = [(a, "email", b) for a, b in _emails(text)] if "@" in text else []
    found += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), "card", m.end()))
    if "+" in text:
        found += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    found += [(m.start(), "iban", m.end()) for m in IBAN.finditer(text) if mod97(m[0])]
    found += [(m.start(), "ssn", m.end()) for m in SSN.finditer(text)]
    out = []
    for start, kind, end in found:
        score = min(1.0, max(0.0, SCORES[kind] + context(kind, text, start, end)))
        if kind in BASE or score >= LEAST_SCORE:
            out.append((start, KINDS.index(kind), end, round(score, 2)))
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("score", pa.float64())]))
    for batch in text_slices(batches, "text"):
        rows = [
            [{"start": a, "kind": KINDS[k], "end": b, "score": s} for a, k, b, s in spans(text or "")]
            for text in batch.column("text").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], names=["id", "spans"])


def personal_data(documents: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, spans)``: start, kind, end (code points, end exclusive) and score of each span, one row per input row.

    Base kinds stay whatever their score; added kinds (IBAN by mod-97 and its country's length, US social security numbers by
    their context) come with a score of at least ``LEAST_SCORE``.  Words nearby act on the score of every kind, for it or
    against it, in four languages.  A null text is empty; ids may be null or repeated; other columns are not read.
    """
    source = documents.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_scan, f"id {kind}, spans array<struct<start:int,kind:string,end:int,score:double>>")


def redacted(text: str) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first, then the longest, counts."""
    out, at = [], 0
    for start, kind, end, _ in sorted(spans(text), key=lambda x: (x[0], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = end
    return "".join([*out, text[at:]])


def of_kind(kind: str) -> F.Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def personal_data_by_document(documents: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans, and all spans with their scores."""

    def listed(only: F.Column, *parts: str) -> F.Column:
        return F.array_join(F.transform(only, lambda x: F.concat_ws(":", *(x[p].cast("string") for p in parts))), ",")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    counts = (of_kind(k).alias(f"n_{k}") for k in BASE)
    return personal_data(documents).select(
        F.col("id").alias("doc_id"), *counts, F.sha2(listed(base, "kind", "start", "end"), 256).alias("base_sha256"),
        listed(F.col("spans"), "kind", "start", "end").alias("spans"),
        listed(F.col("spans"), "kind", "start", "end", "score").alias("scored"),
    )
