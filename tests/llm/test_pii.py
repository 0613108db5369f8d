import hashlib
import random
import re

import pytest

from lodestone.llm import pii


def brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_plain_patterns():
    draw = random.Random(5)
    parts = ["a.b@c.d", "@", "x@y", "1.2.3.4", "256.1.1.1", "1.2.3", "4111111111111111", "4111 1111-1111 1111", "+1 (974) 555-3436", "+", " ", "\n", ".", "-", "é", "0", "99", "a@b.c@d.e", "5500005555555559", "٣"]
    for _ in range(3000):
        t = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        assert [s[:3] for s in pii.find_spans(t) if s[0] in pii.BASE_KINDS] == brute(t), t


def test_method_adds_confirmed_spans():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 bitte") == ["iban"]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 33 bitte") == []
    assert kinds("call (974) 555-3436 now") == ["phone_local"] and kinds("part (974) 555-3436 now") == []
    near, far = (pii.find_spans(t)[0][3] for t in ("server 10.0.0.1", "version 10.0.0.1"))
    assert near > far


def test_iban_before_other_words():
    found = lambda t: [t[a:b] for k, a, b, _ in pii.find_spans(t) if k == "iban"]
    de, gb = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    for after in (" BIC COBADEFFXXX", " 2024", " A", " Bank", " bitte", ".", "", " 1 2 3 4 5 6 7 8 9", " BIC"):
        assert found(f"IBAN {de}{after}") == [de], after
        assert found(f"IBAN {gb}{after}") == [gb], after
    assert found(f"{de} {gb} {de}") == [de, gb, de]
    assert found(f"IBAN {de}X BIC") == found(f"IBAN {de[:-1]}1 BIC COBADEFFXXX") == []
    other = next(f"ZZ{k:02}12345678901234" for k in range(2, 99) if pii.mod97(f"ZZ{k:02}12345678901234"))
    assert found(f"IBAN {other} bank") == [other] and found(f"IBAN {other} ") == [other]
    assert pii.masked(f"IBAN {de} BIC X", pii.find_spans(f"IBAN {de} BIC X")) == "IBAN [IBAN] BIC X"


def test_table(spark):
    rows = [(1, None, "s"), (2, "", "s"), (2, "mail a@b.co, ip 1.2.3.4", "s"), (2, "mail a@b.co, ip 1.2.3.4", "s"), (None, "9" * 30_000 + "@" * 30_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, got string")
    got = pii.detect(docs, redact=True).collect()
    assert [len(r.spans) for r in got] == [0, 0, 2, 2, 0]
    assert got[0].text is None and got[2].text == "mail [EMAIL], ip [IP]" and got[2].got == "s"
    assert pii.detect(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["sf0.001"])
def test_query(spark, name):
    folder = f"/root/testdata/{name}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in pii.op2_pii(spark, folder).collect():
        spans = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert r.n_email == sum(s[0] == "email" for s in spans)


def test_a_dense_text_takes_time_by_its_length():
    import time

    one = "tel 555-123-4567 or a.b@site.org, "
    spans = {}
    for n in (2_000, 16_000):
        began = time.process_time()
        spans[n] = pii.find_spans(one * n), time.process_time() - began
    assert len(spans[16_000][0]) == 8 * len(spans[2_000][0]) == 32_000
    assert spans[16_000][1] < 25 * spans[2_000][1]


def test_further_spans_overlap_none():
    iban = "DE89370400440532013000"
    found = pii.find_spans(f"IBAN {iban} tel 555-123-4567 mail 555-123-4567@x.org")
    further = [s for s in found if s[0] not in pii.BASE_KINDS]
    assert [s[0] for s in further] == ["iban", "phone_local"]
    for i, s in enumerate(found):
        for o in found[i + 1 :]:
            assert s[0] in pii.BASE_KINDS and o[0] in pii.BASE_KINDS or s[2] <= o[1] or o[2] <= s[1]
