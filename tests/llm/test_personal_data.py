"""Plain spans against Python's pattern search, added spans on planted ones, reliabilities on known ones."""

import hashlib
import random
import re
import time

import numpy as np
from llm.conftest_llm import SF, odd_rows

from vacancy_spark.llm import personal_data as P

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def checks(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    right = {
        "email": lambda s: True,
        "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and checks(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15}
    return [(k, m.start(), m.end()) for k, pattern in zip(right, (EMAIL, IP, CARD, PHONE))
            for m in re.finditer(pattern, text) if right[k](m.group())]


def test_plain_spans():
    rng = random.Random(3)
    bits = ["a@b.c", "@", ".", "1", "25", "255", "256", "0", "+", "+4", " ", "-", "(", ")", "x", "é", "%", "a.b",
            "4111111111111111", "4111 1111 1111 1111", "555-3824", "+1 (743) 555-3824", "1.2.3.4", "\n", "0000255"]
    for _ in range(6000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        got = [(P.KINDS[k], a, b) for k, a, b, right in P.plain_spans(text) if right]
        assert got == plain(text), text


def test_time_grows_with_the_length():
    for unit in ("1", "1.", "a", "@", "a@", "1 ", "+1", "+1 ", "(", "1-", "1.1.1.", "a.", " at ", "[at]", "(1)", ":1", " dot "):
        began = time.time()
        P.candidates(unit * (400_000 // len(unit)))
        assert time.time() - began < 8, unit


def test_reliabilities():
    """Labelers of known reliability: the estimate comes near, and tells real ones from the rest."""
    rng = np.random.default_rng(2)
    real = rng.random(20000) < .3
    rates = [.95, .9, .7, .55]  # right votes
    votes = np.stack([np.where(rng.random(len(real)) < r, real, ~real) * 2 - 1 for r in rates], 1)
    votes[rng.random(votes.shape) < .2] = 0
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, table, share = P.reliabilities(patterns, counts.astype(float))
    assert abs(share - .3) < .03
    for j, r in enumerate(rates):
        assert abs(table[1, j, 2] - .8 * r) < .03 and abs(table[0, j, 0] - .8 * r) < .03
    assert ((p[inverse.ravel()] > .5) == real).mean() > .93


PLANTED = [("email", "write to ", "jane.doe [at] mail dot example dot com"), ("email", "email: ", "sales(at)example.org"),
           ("ip", "server at address ", "192[.]168[.]4[.]11"),
           ("card", "my amex card ", "3782 822463 10005"), ("card", "visa card ", "4111.1111.1111.1111"),
           ("phone", "ing ", "+1 (269) 555-3296"), ("card", "+1 (269) 555-3296 ", "4524132264652876"),
           ("card", "x 12 ", "4111 1111 1111 1111"), ("phone", "call me: ", "(743) 555-3824"), ("phone", "phone ", "0049 30 1234567")]
CLEAN = ["the order 4379362835490467 of goods", "isbn 978-3-16-148410-0 is a book", "on 2024-01-31 12 people",
         "dated 12.05.2023 and later", "meet at noon. Then we look at house. And so on", "at 10:30:15 it was 1 000 000",
         "version 10.2.3 of it", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "x = 12345678901234;",
         "pages 1234-5678 and 1-2-3-4-5-6-7-8"]


def test_added_spans(spark, sf_docs):
    docs = [(r.doc_id, r.text) for r in sf_docs.collect()]
    cases = [(10**6 + i, f"Und so wéiter {before}{span} and then.") for i, (_, before, span) in enumerate(PLANTED)]
    clean = [(2 * 10**6 + i, t) for i, t in enumerate(CLEAN)]
    df = spark.createDataFrame(docs + cases + clean, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in P.personal_data(df).collect()}
    for (i, text), (kind, _, span) in zip(cases, PLANTED):
        assert (kind, text.index(span), text.index(span) + len(span)) in got[i], (text, got[i])
    for i, text in clean:
        assert got[i] == plain(text), (text, got[i])
    for i, text in docs:
        assert set(plain(text)) <= set(got[i])
    assert sum(len(got[i]) - len(plain(t)) for i, t in docs) <= 2  # clean documents are left alone


def row_of(doc_id, text):
    spans = plain(text or "")
    line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (doc_id, *(sum(s[0] == k for s in spans) for k in P.KINDS), hashlib.sha256(line.encode()).hexdigest())


def test_driver_documents(spark, sf_docs):
    got = sorted(P.op13_personal_data(spark, SF).collect())
    want = sorted(row_of(r.doc_id, r.text) for r in sf_docs.collect())
    assert [tuple(r)[:6] for r in got] == want
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        assert len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
        key = [(P.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert key == sorted(key)


def test_odd_rows(spark, odd, none):
    rows = [(i, t, "x") for i, t, *_ in odd_rows()]
    rows += [(300, "a@b.c " * 3000, "x"), (301, "1" * 30000, None), (None, "call +1 (743) 555-3824", "x"), (302, "١٢٣.١.٢.٣", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = P.personal_data(df).collect()
    count = lambda x: sorted(x, key=str)
    assert count((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in got) == \
        count((i, plain(t or "")) for i, t, _ in rows)
    assert P.personal_data(none).count() == 0
    assert all(not r.spans for r in P.personal_data(df.where("text is null or text = ''")).collect())
    some = P.find_candidates(df)
    assert P.learn(some, train_spans=5).weights.shape == (P.FEATURES,)
