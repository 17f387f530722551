"""Redaction: worked examples, a brute-force scan as second opinion, and the extension surface."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from promptledger.functions import pii
from verification.views import view

# The four detector patterns in Python's syntax.
PY_EMAIL = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9._%+-]+(?:@|\s*[\[(]\s*at\s*[\])]\s*)[A-Za-z0-9-]+(?:(?:\.|\s*[\[(]\s*dot\s*[\])]\s*)[A-Za-z0-9-]+)*"
    r"(?:\.|\s*[\[(]\s*dot\s*[\])]\s*)[A-Za-z]{2,24}(?![\w-])", re.I)
PY_CARD = re.compile(r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])")
PY_SSN = re.compile(
    r"(?<![\d-])(?:\d{3}([- ])\d{2}\1\d{4}|(?<=SSN[:\s#])\s*\d{9}|(?<=social security number[:\s])\s*\d{9})(?![\d-])", re.I)
PY_PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?)?\d{2,5}(?:[\s.-]?\d{2,5}){1,4}(?![\w])")


def only_digits(s):
    return "".join(c for c in s if c.isdecimal())


def luhn(d):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])]
    return sum(doubled) % 10 == 0


def card_ok(m):
    d = only_digits(m)
    return 13 <= len(d) <= 19 and (luhn(d) or bool(re.fullmatch(r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}", m.strip())))


def ssn_ok(m):
    d = only_digits(m)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def phone_ok(m):
    n, m = len(only_digits(m)), m.strip()
    low, high = (8, 15) if m[0] == "+" else (10, 15) if re.search(r"[\s().-]", m) else (10, 13)
    return low <= n <= high


BRUTE = [("EMAIL", PY_EMAIL, lambda m: True), ("CREDIT_CARD", PY_CARD, card_ok), ("SSN", PY_SSN, ssn_ok), ("PHONE", PY_PHONE, phone_ok)]


def brute_force(text):
    counts = {}
    for name, rx, ok in BRUTE:
        out, end = [], 0
        for m in rx.finditer(text):
            value = m.group()
            if ok(value):
                counts[name] = counts.get(name, 0) + 1
                value = value[:len(value) - len(value.lstrip())] + f"[REDACTED_{name}]"
            out += [text[end:m.start()], value]
            end = m.end()
        text = "".join(out) + text[end:]
    return text, counts


def scrub_all(spark, texts, patterns=pii.DEFAULT_PATTERNS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.pii for r in pii.scrub(df, "t", patterns).orderBy("i").collect()]


def with_check_digit(body):
    """The digits and the one that makes their checksum right."""
    return next(body + d for d in "0123456789" if luhn(body + d))


def grouped(digits, size, sep):
    return sep.join(digits[i:i + size] for i in range(0, len(digits), size))


def counts_of(spark, texts):
    return [r.counts for r in scrub_all(spark, texts)]


def test_cards_by_length_and_checksum(spark):
    """13 to 19 digits with the right check digit, alone or with blanks or hyphens between; else four equal groups of four."""
    cases = []
    for n in range(11, 22):
        good = with_check_digit("8" + "".join(str(i * 7 % 10) for i in range(n - 2)))
        bad = good[:-1] + str((int(good[-1]) + 1) % 10)
        for sep in ("", "-", " ")[:3 if n < 20 else 2]:  # of longer rows of groups the first four are one
            cases += [(grouped(good, 4, sep), 13 <= n <= 19), (grouped(bad, 4, sep), n == 16 and sep != "")]
    body = with_check_digit("8" * 14 + "2")
    wrong = body[:-1] + str((int(body[-1]) + 3) % 10)
    cases += [(f"{wrong[:4]}-{wrong[4:8]} {wrong[8:12]}-{wrong[12:]}", False), (f"{body[:4]}-{body[4:8]} {body[8:]}", True), (body[:8] + "--" + body[8:], False),
              ("7" + body[:4] + "x" + body[4:], False)]
    for (number, card), found in zip(cases, counts_of(spark, [f"account {c} closed" for c, _ in cases])):
        assert found.get("CREDIT_CARD", 0) == card, number


def test_ssn_by_parts(spark):
    """Any area but 000, 666 and from 900 on, any group but 00, any serial but 0000; apart by one kind of sign, or named."""
    cases = [(f"{a:03}{sep}{g:02}{sep}{n:04}", a not in (0, 666) and a < 900 and g > 0 and n > 0)
             for a in (0, 1, 100, 665, 666, 667, 899, 900, 999) for g in (0, 1, 99) for n in (0, 1, 9999) for sep in ("-", " ")]
    cases += [("301-22 4455", False), ("301.22.4455", False), ("301-224-455", False), ("SSN 301224455", True), ("SSN:301224455", True), ("sn 301224455", False),
              ("Social Security Number: 301224455", True), ("SSN 000224455", False)]
    for (number, ssn), found in zip(cases, counts_of(spark, [f"entry {c} kept" for c, _ in cases])):
        assert found.get("SSN", 0) == ssn, number


def test_phones_by_number_of_digits(spark):
    """8 to 15 digits behind a plus, 10 to 15 with signs between, 10 to 13 bare."""
    cases = []
    for n in range(6, 18):
        digits = ("3" + "".join(str(i * 3 % 10) for i in range(1, n)))
        digits = digits if not luhn(digits) else digits[:-1] + str((int(digits[-1]) + 1) % 10)
        cases += [(digits, 10 <= n <= 13), ("+" + digits[:2] + " " + grouped(digits[2:], 4, " ") if n % 4 != 3 else "+" + digits, 8 <= n <= 15)]
        if n % 3 != 1:
            cases += [(grouped(digits, 3, sep), 10 <= n <= 15) for sep in (" ", ".", "-") if n <= 15]
            cases.append((f"({digits[:3]}) {grouped(digits[3:], 3, ' ')}", 10 <= n <= 15) if n <= 15 else (digits + "x", False))
    texts = [f"room {c}, upstairs" for c, _ in cases]
    for (number, phone), text, found in zip(cases, texts, counts_of(spark, texts)):
        assert found == brute_force(text)[1], number
        if not {"CREDIT_CARD", "SSN"} & set(found):
            assert found.get("PHONE", 0) == phone, number


def test_emails_by_parts(spark):
    """Local part, at sign or the word in brackets, host labels, and a last label of 2 to 24 letters."""
    at, dot = ("@", " (at) ", "[at]", " at ", "(AT)"), (".", " [dot] ", "(dot)", " dot ")
    cases = [(f"{local}{x}lab{y}{'q' * n}", bool(local) and x != " at " and y != " dot " and 2 <= n <= 24)
             for local in ("k", "k.l-m_n%o+9", "") for x in at for y in dot for n in (1, 2, 24, 25)]
    texts = [f"<{c}>" for c, _ in cases]
    for (address, mail), text, found in zip(cases, texts, counts_of(spark, texts)):
        assert found.get("EMAIL", 0) == brute_force(text)[1].get("EMAIL", 0), address
        assert not mail or found["EMAIL"] == 1, address


def test_marks_stand_for_values_and_nothing_else(spark):
    """Any mixture of values between words: each becomes its mark, in whatever order, and words and short numbers stay."""
    import random
    rng = random.Random(11)
    kinds = list(pii.supported_types())
    make = {
        "EMAIL": lambda: f"{rng.choice('pqrs')}{rng.randint(0, 999)}@{rng.choice(['ab', 'c-d'])}.example",
        "CREDIT_CARD": lambda: grouped(with_check_digit("".join(rng.choices("123456789", k=15))), 4, rng.choice(["", " ", "-"])),
        "SSN": lambda: f"{rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "PHONE": lambda: f"+{rng.randint(20, 60)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}",
    }
    texts, wants, counts = ["", None], ["", ""], [{}, {}]
    for _ in range(60):
        text, want, n = "", "", Counter()
        for _ in range(rng.randint(0, 9)):
            word = rng.choice(["tar", "Oak", "elm,", "r7", "4:30", "v2.1", "98%", "2031-04", "no. 512"])
            kind = rng.choice([*kinds, None, None])
            n.update([kind] if kind else [])
            text, want = text + f"{word}; ", want + f"{word}; "
            if kind:
                text, want = text + make[kind]() + "; ", want + f"[REDACTED_{kind}]; "
        texts.append(text)
        wants.append(want)
        counts.append(dict(n))
    for text, want, n, got in zip(texts, wants, counts, scrub_all(spark, texts)):
        assert (got.redacted_text, got.counts, got.redaction_count) == (want, n, sum(n.values())), text
        assert got.detected_types == [k for k in kinds if k in n]


@pytest.mark.parametrize("source", ["documents", "requests"])
def test_same_as_brute_force(spark, sf, source):
    if source == "documents":
        df = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    else:
        df = view(spark, sf, "requests_v").select(F.coalesce("prompt", F.lit("")).alias("text"))
    rows = pii.scrub(df, "text").select("text", "pii").collect()
    assert len(rows) >= 200
    for r in rows:
        assert (r.pii.redacted_text, r.pii.counts) == brute_force(r.text)


def test_tricky_boundaries_same_as_brute_force(spark):
    texts = ["4242 4242 4242 4242 4242 4242 4242 4242", "٤٢٤٢ ٤٢٤٢ ٤٢٤٢ ٤٢٤٢", "call +٩١ ٩٨٧٦٥٤٣٢١٠", "a1234567890b", "x-6011000990139424",
             "6011000990139424-9", "mail ÄB@ex.org now", "a@b.co.", "a@b..co", "ſmith@eKample.org", "ssn#123456789 SSN\n 123456789",
             "social security number: 337529016", "12 345 678 901 234", "(1) (22) 333-4444", "+1 (555)123.4567,+49 30 901820",
             "0000 0000 0000 0000", "10.20.30.40 and 192.168.100.200", "1234567890123456789012", "\x1c555\x1c123\x1c4567"]
    for text, got in zip(texts, scrub_all(spark, texts)):
        assert (got.redacted_text, got.counts) == brute_force(text), text


def test_scrub_twice_changes_nothing(spark, sf):
    once = pii.scrub(spark.read.parquet(f"{sf}/documents.parquet"), "text").select(F.col("pii.redacted_text").alias("t"))
    assert pii.scrub(once, "t").filter("pii.redacted_text <> t").count() == 0


def test_custom_detectors(spark):
    types = pii.supported_types()
    seat = pii.PiiPattern("SEAT", r"<\d{10}>")
    for place in range(len(types) + 1):
        before = types[place] if place < len(types) else "NONE"
        chain = pii.with_pattern(pii.DEFAULT_PATTERNS, seat, before=before)
        assert pii.supported_types(chain) == types[:place] + ["SEAT"] + types[place:]
        # A value that two detectors take belongs to the first of them.
        got = scrub_all(spark, ["in <3003003001> too"], chain)[0]
        assert got.detected_types == (["SEAT"] if before != "NONE" else ["PHONE"])
    for check in (lambda m: F.substring(m, 2, 3).cast("int") % 2 == 0 if hasattr(m, "cast") else int(m[1:]) % 2 == 0, "cast(substring(m, 2, 3) as int) % 2 = 0"):
        even = [pii.PiiPattern("EVEN", r"#\d{3}", check)]
        text = " ".join(f"#{i}" for i in range(100, 108))
        assert scrub_all(spark, [text], even)[0].redacted_text == " ".join("[REDACTED_EVEN]" if i % 2 == 0 else f"#{i}" for i in range(100, 108))
    spaced = [pii.PiiPattern("X", r"\s*x+")]
    assert scrub_all(spark, ["a  xx b"], spaced)[0].redacted_text == "a  [REDACTED_X] b"


def test_luhn_and_views_of_the_result(spark):
    df = spark.createDataFrame([("371449635398431",), ("6011 0009 9013 9424",), ("6011000990139425",), ("42",), ("",), (None,)], "t string")
    assert [bool(r.ok) for r in df.select(pii.luhn_valid("t").alias("ok")).collect()] == [True, True, False, False, False, False]
    mail = spark.createDataFrame([("a@b.org and c@d.org", True), ("a@b.org", False)], "t string, on boolean")
    done = pii.scrub(mail, "t")
    assert [r.f for r in done.select(pii.findings(F.col("pii")).alias("f")).collect()][0][0].asDict() == {"type": "EMAIL", "count": 2}
    sent = done.select(pii.forwarded_text(F.col("t"), F.col("pii"), F.col("on")).alias("s")).collect()
    assert [r.s for r in sent] == ["[REDACTED_EMAIL] and [REDACTED_EMAIL]", "a@b.org"]
    assert [r.contains_pii for r in pii.contains_pii(mail, "t").collect()] == [True, True]
    assert pii.leak_check(mail, "t").count() == 2
    keyed = spark.createDataFrame([("has sk-1 in it", "sk-1"), ("clean", "sk-1"), ("clean", None)], "t string, k string")
    assert pii.leak_check(keyed, "t", raw_key=F.col("k")).count() == 1


def test_filter_on_result_runs_detectors_once(spark):
    df = spark.createDataFrame([("a@b.org",)], "t string")
    twice = pii.contains_pii(pii.scrub(df, "t").filter("pii.redaction_count > 0"), "t").filter("contains_pii")
    plan = twice._jdf.queryExecution().optimizedPlan().toString()
    assert twice.count() == 1 and plan.count("regexp_extract_all") <= 8


def test_hints_hold_for_ascii_and_other_digits(spark):
    texts = ["Ring 555 010 4477 99", "Ring ٥٥٥ ٠١٠ ٤٤٧٧", "café, card 4242 4242 4242 4242", "SSN: 219099999",
             "bo [at] site [dot] org", "bo(AT)site.org", "bo {at} site.org", "1 2 3 4 5 6 7", "", "12345678 [x]"]
    hints = {h for p in pii.DEFAULT_PATTERNS if (h := p.hint)}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    slow = rf"(?iu)[\[(]{pii.BLANK}*at{pii.BLANK}*[\])]"
    for h in hints:
        exact = F.expr("contains(t, '@')") | F.col("t").rlike(slow) if "contains" in h else F.col("t").rlike(r"\p{Nd}(?:\P{Nd}{0,2}\p{Nd}){7}")
        assert all(a == b for a, b in df.select(F.expr(h.replace("{t}", "t")), exact).collect())
    assert [len(r.pii.detected_types) for r in pii.scrub(df, "t").collect()] == [1, 1, 1, 1, 1, 1, 0, 0, 0, 0]
