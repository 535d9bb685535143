import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import pii
from ledgerloom.llm.common import table

from .helpers import DATA, awkward, empty

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def found(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find(frame).orderBy("doc_id").collect()
    return [[(s.kind, s.start, s.end) for s in r.pii] for r in rows]


def base(spans):
    return [s for s in spans if s[0] in pii.BASE]


def test_query_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in pii.op9_pii(spark, "/root/testdata/sf0.01").collect()}
    seen = set()
    for r in docs.collect():
        spans = plain(r.text)
        seen |= {k for k, *_ in spans}
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        row = got[r.doc_id]
        assert row.base_sha256 == digest
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for k, *_ in spans) for x in PLAIN]
    assert seen == set(PLAIN)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="a1@.+-_ (é☃😀\n0259", max_size=50), min_size=120, max_size=120))
def test_random_texts(texts):
    from pyspark.sql import SparkSession

    assert [base(x) for x in found(SparkSession.getActiveSession(), texts)] == [plain(t) for t in texts]


def test_further_kinds_need_checksum_or_context(spark):
    texts = [
        "pay to DE89 3704 0044 0532 0130 00 now",
        "pay to DE88 3704 0044 0532 0130 00 now",
        "ssn 123-45-6789",
        "part 123-45-6789",
        "😀 mail a@b.co",
    ]
    assert found(spark, texts) == [[("iban", 7, 34)], [], [("ssn", 4, 15)], [], [("email", 7, 13)]]


def test_very_long_runs_stay_linear(spark):
    n = 30_000
    texts = ["a" * n, "1" * n, "1." * n, "1 " * n, "+1(" * n, "a@" * n, "a.b" * n + "@", "+1" + "(" * n, "x" * n + "@b.c", "A1" * n]
    began = time.time()
    got = found(spark, texts)
    assert time.time() - began < 60
    assert base(got[8]) == [("email", 0, n + 4)]


def test_awkward_rows_and_redaction(spark):
    docs = awkward(spark)
    assert pii.find(docs).count() == docs.count() and pii.find(empty(spark)).count() == 0
    texts = [(1, "a@b.co and 10.0.0.1", 19), (2, "plain", 5), (3, None, None), (4, "call +1 (974) 555-3436!", 23)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(frame).collect()}
    assert got == {1: ("<EMAIL> and <IP>", 16), 2: ("plain", 5), 3: (None, None), 4: ("call <PHONE>!", 13)}
    again = pii.find(pii.redact(table(spark, DATA, "documents")))
    assert again.where(F.size("pii") > 0).count() == 0


def test_redaction_keeps_every_other_character_and_column(spark):
    texts = ["\ue000 a@b.co \ue001\ue000\ue002", "\ue001\ue002 10.0.0.1\ue003", "\ue000\ue001 none \ue001\ue003", "a@b.co", "", None]
    own = ["row", "was", "now", "__before", "pii", "parts", "strange"]
    frame = spark.createDataFrame([(i, t, *[7] * len(own)) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in own))
    got = pii.redact(frame)
    assert got.columns == frame.columns and got.where("`row` = 7 AND was = 7 AND now = 7 AND `__before` = 7 AND pii = 7").count() == 6
    assert [r.text for r in got.orderBy("doc_id").collect()] == [
        "\ue000 <EMAIL> \ue001\ue000\ue002", "\ue001\ue002 <IP>\ue003", "\ue000\ue001 none \ue001\ue003", "<EMAIL>", "", None,
    ]
    assert pii.redact(empty(spark)).count() == 0
