"""Personal data: patterns propose spans, checksums confirm, context adjusts.

Each text is searched once, whole, in the task that reads it; nothing is
shuffled, so hot sources and groups of copies cost no more than other rows.

Patterns propose spans; checksum validators (Luhn for cards, mod-97 for IBANs)
confirm or drop them; words near a span raise or lower its score. The four base
kinds (email, ip, card, phone) are always reported; the further kinds (iban,
phone_local) only at a score of THRESHOLD or more.

Defined cases: a null text counts as empty and has no spans; repeated rows get
equal results; an empty table gives an empty table; extra columns pass through,
and an input column with the name of an output column is replaced. Patterns run
in time linear in the text, and overlaps are looked up in order, so long texts
are searched whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fresh_name

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "phone_local")
THRESHOLD = 0.5
#: Context is searched in so many characters before and after a span.
NEAR = 48

# Scores of a bare match, and context words by kind.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "phone_local": 0.35}
CONTEXT = {
    "email": ("mail", "email", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
#: Words that speak against personal data, such as software versions.
AGAINST = ("version", "release", "isbn", "order", "invoice", "example", "test")

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A match never starts inside a run of digits: had it failed at the run's
# start, it would fail there too. So runs are tried at their start only.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}))")
_TOKEN = re.compile(r"[A-Z0-9]+(?![A-Za-z0-9])")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for c in cs.split()
}
_PHONE_LOCAL = re.compile(r"(?<![0-9(+)-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    end = 0
    for m in _AT.finditer(text):
        at = m.start()
        if at < end:  # inside the previous match: cannot be, as domains hold no @
            continue
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    """A word or number may follow after a space, so an IBAN can end after each
    token: where its country's length says or, for other countries, at the last
    end that mod-97 confirms. The search goes on from there."""
    done = 0
    for m in _IBAN.finditer(text):
        start = m.start()
        if start < done:
            continue
        for t in reversed(list(_TOKEN.finditer(text, start, m.end(1) + 1))):
            end = t.end()
            plain = text[start:end].replace(" ", "")
            known = IBAN_LENGTHS.get(plain[:2])
            if (len(plain) == known if known else 15 <= len(plain) <= 34) and end <= m.end(1) and mod97(plain):
                yield start, end
                done = end
                break


def _locals(text: str):
    for m in _PHONE_LOCAL.finditer(text):
        yield m.span()


def _joined(found: list[tuple]) -> tuple[list[int], list[int]]:
    """Starts and ends of spans, overlapping ones joined, in order."""
    starts, ends = [], []
    for _, a, b in sorted(found, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _is_free(taken: tuple[list[int], list[int]], a: int, b: int) -> bool:
    k = bisect_left(taken[0], b) - 1  # the last that starts before the end
    return k < 0 or taken[1][k] <= a


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR])}
    score = SCORES[kind] + 0.25 * any(w in near for w in CONTEXT[kind]) - 0.25 * any(w in near for w in AGAINST)
    return round(min(1.0, max(0.0, score)), 2)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind in the order of KINDS, then start."""
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, search in (("ip", _ips), ("card", _cards), ("phone", _phones)):
            if kind == "phone" and "+" not in text:
                continue
            found += [(kind, *s) for s in search(text)]
        for kind, search in (("iban", _ibans), ("phone_local", _locals)):
            taken = _joined(found)  # a further span must not overlap one found before
            found += [(kind, a, b) for a, b in search(text) if _is_free(taken, a, b)]
    scored = [(k, a, b, _score(text, k, a, b)) for k, a, b in found]
    return [s for s in scored if s[0] in BASE_KINDS or s[3] >= THRESHOLD]


def masked(text: str, spans) -> str:
    """The text with every span replaced by its kind in brackets; spans that
    overlap become one, named by the first."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"


def detect(docs: DataFrame, text: str = "text", spans: str = "spans", redact: bool = False) -> DataFrame:
    """docs with an array column of found spans; redact: and with the spans
    replaced in the text."""

    @F.pandas_udf(f"found array<{SPAN}>, clean string" if redact else f"found array<{SPAN}>")
    def search(texts: pd.Series) -> pd.DataFrame:
        texts = texts.fillna("")
        found = [find_spans(t) for t in texts]
        out = {"found": [[dict(zip(("kind", "start", "end", "score"), s)) for s in ss] for ss in found]}
        if redact:
            out["clean"] = [masked(t, ss) if ss else t for t, ss in zip(texts, found)]
        return pd.DataFrame(out)

    got = fresh_name(docs, "got")
    df = docs.withColumn(got, search(F.col(text).cast("string")))
    if redact:
        df = df.withColumn(text, F.when(F.col(text).isNotNull(), F.col(got)["clean"]))
    return df.withColumn(spans, F.col(got)["found"]).drop(got)


def _count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = detect(docs).select("doc_id", "spans")
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return df.select(
        "doc_id",
        *[_count_of(kind).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(F.concat_ws(",", F.transform(base, named)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", named)).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"),
    )
