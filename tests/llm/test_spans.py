"""Secret scan and personal data against plain scans of the same texts, and odd rows."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import pii, secrets

ODD = [(1, None, "x", 0), (2, "", "x", 0), (3, " \n\t ", "x", 0), (3, " \n\t ", "x", 0), (None, "password = hunter2hunter2", None, 0)]
SCHEMA = "doc_id long, text string, found string, start int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts, 10)] + ODD, SCHEMA)


def noisy(seed, pieces, n=120):
    r = random.Random(seed)
    return ["".join(r.choice(pieces) for _ in range(r.randint(1, 12))) for _ in range(n)]


SECRET_PIECES = ["password: ", 'Token="', "api_key=", "APIKEY : ", "secret", "=", "abcdefgh", "AKIA", "ABCDEFGHIJKL1234", "0123456789abcdef" * 2, "é", " ", "\n", "x" * 7, "𝄞", "passwd='"]


def plain_secrets(text):
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secrets_keep_base_spans(spark):
    d = docs(spark, noisy(1, SECRET_PIECES))
    found = secrets.scan(d, secrets.fit(d)).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    assert len(found) == d.count()
    for r in found:
        assert [tuple(x) for x in r["found"] if x["kind"] < 3] == plain_secrets(texts[r["doc_id"]])


def test_secrets_learn_a_format(spark):
    r = random.Random(2)
    code = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz" + "23456789" * 3) for _ in range(n))
    model = secrets.Model({"assign": secrets.infer([code(24) for _ in range(300)])}, secrets.infer(["".join(r.choice(["th", "er", "on", "an"]) for _ in range(8)) for _ in range(300)]), secrets.LEAST_GAIN)
    texts = [f"the key {code(24)} is here" for _ in range(100)]
    assert sum(any(k == 3 for _, k, _ in model.spans(t)) for t in texts) >= 95
    assert model.spans("theronanther anerthonthere and ononerththananer") == []


@pytest.mark.parametrize("s", ["kJhGfDsAqWeRtYuI", "Zx7kQpLmNvBcXzAsDf", "9481726350918273", "ABCDEFGH12IJKLMNOP"])
def test_secrets_candidates_need_no_digits_or_letters(s):
    assert [x[2] for x in secrets.candidates(f"the key {s} is here", [])] == [s]


@pytest.mark.parametrize("bare", [1, 40, 400])
def test_secrets_found_however_many_leak(spark, bare):
    """Unlabelled keys of a format that labels teach are found at a tenth of a per cent, a tenth, and half of all long tokens; plain long tokens are left alone."""
    r = random.Random(bare)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda: "ghp_" + "".join(r.choice(letters) for _ in range(36))
    syllable = lambda n: "".join(r.choice(["th", "er", "on", "an", "ing", "ment", "tion", "ver", "schaft", "de"]) for _ in range(n))
    plain = lambda: r.choice([lambda: "-".join(syllable(2) for _ in range(5)), lambda: f"www.{syllable(3)}.org/{syllable(3)}", lambda: syllable(7)])()
    words = lambda: " ".join(syllable(r.randint(1, 4)) for _ in range(30))
    keys, others = [key() for _ in range(bare)], [plain() for _ in range(max(400, 1000 if bare == 1 else 400))]
    texts = [f"token={key()} {words()}" for _ in range(400)] + [f"{words()} {k} {words()}" for k in keys] + [f"{words()} {x} {words()}" for x in others]
    d = docs(spark, texts)
    spans = {x["doc_id"]: x["found"] for x in secrets.scan(d, secrets.fit(d)).collect()}
    found = [[t[s:e] for s, k, e in spans[i] if k == 3] for i, t in enumerate(texts, 10)]
    hits = sum(k in found[400 + i] for i, k in enumerate(keys))
    assert hits >= 0.9 * bare
    assert sum(bool(found[400 + bare + i]) for i in range(len(others))) <= 0.01 * len(others)


def test_secrets_learn_from_all_strings(spark, monkeypatch):
    """Every distinct string counts, however many and however long, in whatever pieces they are read, and repeats don't."""
    r = random.Random(9)
    keys = ["".join(r.choice(secrets.LETTERS[:62]) for _ in range(r.choice([8, 20, 300]))) for _ in range(3000)]
    d = docs(spark, [f"token={k} and password={k}" for k in keys])
    rows = [(x["kind"], x["string"]) for x in secrets.labelled(d).collect()]
    assert len(rows) == len(set(rows)) and {s for k, s in rows if k == "assign"} == {*keys, "hunter2hunter2"}
    monkeypatch.setattr(secrets, "PIECE", 7)
    want = secrets.tallied([*keys[:50], "a"])
    steps = 0
    for s in [*keys[:50], "a"]:
        state = 0
        for i, c in enumerate(s):
            x = secrets.LETTERS.index(c) if i < secrets.PREFIX else int(secrets._CLASS[ord(c)])
            assert want[state * secrets.WIDTH + x] > 0
            state, steps = int(secrets._following()[state, x]), steps + 1
        assert want[state * secrets.WIDTH + secrets.END] > 0
    assert want.sum() == steps + 51
    monkeypatch.undo()
    n = secrets.counted(secrets.labelled(d))
    assert ((n["assign", 0] + n["assign", 1]) == secrets.tallied([*keys, "hunter2hunter2"])).all()


def test_secrets_on_empty_table(spark):
    d = docs(spark, []).limit(0)
    assert secrets.scan(d, secrets.fit(d)).collect() == []


PII_PIECES = ["a.b+c@x-y.com", "@", ".", "1.2.3.4", "256.1.1.1", "010.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", " ", "\n", "é", "𝄞", "7", "-", "user_", "b@c.d_e@f.g", "1234567890123456789012"]


def plain_pii(text):
    digits = lambda s: [int(c) for c in s if c.isdigit()]

    def luhn(s):
        return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits(s)[::-1])) % 10 == 0

    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, re.ASCII) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(m[0])],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15],
    }


def test_personal_data_keeps_base_spans(spark):
    d = docs(spark, [*noisy(3, PII_PIECES), "x" * 70_000 + "@" + "b." * 9_000 + "c", "1.2.3.4 " * 700])
    found = pii.find(d).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    assert len(found) == d.count()
    for r in found:
        want = plain_pii(texts[r["doc_id"]])
        assert {k: [tuple(x) for x in r[k]] for k in pii.KINDS} == want, texts[r["doc_id"]][:200]


def test_personal_data_adds_what_labelers_agree_on(spark):
    texts = [f"please call phone 415-555-{i:04d} today" for i in range(1000, 1060)] + [f"parts {i} 12-34 and 5-6 77" for i in range(100)]
    d = docs(spark, texts)
    found = {r["doc_id"]: r["learnt"] for r in pii.find(d).collect()}
    assert all(found[i] for i in range(10, 70)) and not any(found[i] for i in range(70, 170))


def test_reliabilities_follow_agreement():
    # 0 abstains, 1 yes, 2 no; the last labeler is a coin, and the counts are to show it
    m = pii.reliabilities({(1, 1, 1): 250, (1, 1, 2): 250, (2, 2, 1): 250, (2, 2, 2): 250, (1, 0, 1): 40, (2, 0, 2): 40})
    assert m.posterior((1, 1, 1)) > 0.9 > 0.1 > m.posterior((2, 2, 2)) and m.posterior((1, 1, 2)) > 0.9
    assert abs(m.true[2][1] - 0.5) < 0.1 and abs(m.false[2][1] - 0.5) < 0.1 and m.true[0][1] > 0.9


def test_personal_data_overlaps(spark):
    """Candidates that touch a base span or an earlier kind's candidate go, whatever the number of spans; against all pairs."""
    r = random.Random(5)
    rows, want = [], set()
    for row in range(40):
        base = {k: [(a, a + r.randint(1, 6)) for a in sorted(r.sample(range(200), 3))] for k in pii.KINDS}
        more = [(r.randint(1, len(pii.MORE)), "x", a, a + r.randint(1, 9), [0]) for a in r.sample(range(200), 12)]
        rows.append((row, *(base[k] for k in pii.KINDS), more))
        every = [(0, a, b) for k in pii.KINDS for a, b in base[k]] + [(o, a, b) for o, _, a, b, _ in more]
        want |= {(row, o, a, b) for o, _, a, b, _ in more if not any(p < o and x < b and y > a for p, x, y in every)}
    span = "array<struct<start:int,end:int>>"
    d = spark.createDataFrame(rows, f"row long, {', '.join(f'{k} {span}' for k in pii.KINDS)}, more array<struct<order:int,kind:string,start:int,end:int,codes:array<int>>>")
    assert {(x["row"], x["order"], x["start"], x["end"]) for x in pii.apart(d).collect()} == want


def test_personal_data_precision_and_recall(spark):
    """Planted spans of each kind among look-alikes; the model never sees which is which."""
    r = random.Random(6)
    letters = lambda n: "".join(r.choice("BCDFGHJK") for _ in range(n))

    def iban():
        body = f"{r.randint(10**17, 10**18 - 1)}"
        check = 98 - int(body + "131400") % 97  # DE00 behind the body
        solid = f"DE{check:02d}{body}"
        return " ".join(solid[i : i + 4] for i in range(0, 22, 4))

    given = pii.GIVEN.split()
    good = [
        lambda: f"my ssn is {r.randint(100, 600)}-{r.randint(10, 99)}-{r.randint(1000, 9999)} thanks", lambda: f"call me: ({r.randint(201, 989)}) {r.randint(200, 499)}-{r.randint(1000, 9999)} (home)",
        lambda: f"send it to account {iban()}, BIC follows", lambda: f"write to {letters(5).lower()} (at) gmail (dot) com soon",
        lambda: f"I live at {r.randint(1, 99)} {r.choice(['Oak', 'Park', 'Church'])} Street, Boston now", lambda: f"signed, Dr. {r.choice(given)} {letters(1)}{letters(5).lower()}, born in spring",
    ]
    bad = [lambda: f"part {r.randint(900, 999)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}-7 in stock", lambda: f"on 20{r.randint(10, 24)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} we met", lambda: f"serial {letters(2)}{r.randint(10, 99)} {letters(4)} {letters(4)} {letters(4)} end", lambda: f"version 12.{r.randint(10, 99)}.{r.randint(10, 99)} is out", lambda: "The House was old. The Street was long."]
    texts = [(r.choice(good)(), True) if r.random() < 0.5 else (r.choice(bad)(), False) for _ in range(600)]
    found = {x["doc_id"]: bool(x["learnt"]) for x in pii.find(docs(spark, [t for t, _ in texts])).collect()}
    ids = sorted(i for i, t in ((x["doc_id"], x["text"]) for x in docs(spark, [t for t, _ in texts]).collect()) if t in {t for t, _ in texts})
    truth = {t: y for t, y in texts}
    text_of = {x["doc_id"]: x["text"] for x in docs(spark, [t for t, _ in texts]).collect()}
    hit = sum(found[i] and truth[text_of[i]] for i in ids)
    assert hit >= 0.9 * sum(truth[text_of[i]] for i in ids) and hit >= 0.95 * sum(found[i] for i in ids)


def test_personal_data_on_empty_table(spark):
    assert pii.find(docs(spark, []).limit(0)).collect() == []


@pytest.mark.parametrize("text", ["", None])
def test_no_text_no_spans(text):
    assert secrets.Model({}, None, 1.0).spans(text) == []


def test_contexts_are_the_characters_around(spark):
    """What the pieces of a text give as context is what stands in the text, however short the gaps are."""
    r = random.Random(11)
    parts = ["030-123-4567 ", "a" * 50, " x ", "é𝄞", "Tel ", "(030) 123 4567", "\n", "1234-5678-90 "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(200)]
    pattern, hint = pii.MORE["call"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    d = d.select("i", "text", pii._pieces(F.col("text"), pattern, F.col("text").rlike(hint)).alias("p")).withColumn("e", pii._ends("p"))
    d = d.withColumn("m", pii._spans("p")).withColumn("e", pii._around("e")).where("p is not null")
    for x in d.collect():
        t = texts[x["i"]]
        for span, around in zip(x["m"][:-1], x["e"][:-1], strict=True):
            assert t[span["start"] : span["end"]] == span["s"]
            assert (around["before"], around["after"]) == (t[max(0, span["start"] - 40) : span["start"]], t[span["end"] : span["end"] + 40])


def test_many_candidates_take_linear_time(spark):
    """Twice as many candidates in one text take about twice the time, not four times."""
    import time

    took = []
    for n in (3000, 3000, 12_000):
        d = docs(spark, ["call (030) 123-4567 or 12 High Street now, " * n])
        began = time.time()
        pii.apart(pii.candidates(pii.base_spans(d)).select(F.monotonically_increasing_id().alias("row"), *(pii._places(k).alias(k) for k in pii.KINDS), "more")).count()
        took.append(time.time() - began)
    assert took[2] < 10 * max(took[1], 0.5)
