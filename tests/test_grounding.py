"""Grounded sentences, topics, sentences that name a subject, and histories of procedures, against plain versions."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from quillspark.functions.text import fold
from quillspark.operators import grounding as G
from quillspark.operators import procedures as P


def plain_grounded(reply, statements):
    reply = re.sub(r"\s+", " ", reply or "").strip()
    out = []
    if not statements or reply.upper().startswith("INSUFFICIENT"):
        return out
    for place, m in enumerate(re.finditer(G.SENTENCE, reply)):
        text = re.sub(G.CITATION, "", m[0]).strip()
        if not re.search(r"\w", text):
            continue
        cites = [int(x) for x in re.findall(G.CITATION, m[0])]
        said = " ".join(statements[n - 1] for n in sorted(set(cites)) if 1 <= n <= len(statements))
        problem = "NO_CITATION" if not cites else "NO_SUCH_STATEMENT" if any(not 1 <= n <= len(statements) for n in cites) else "UNSUPPORTED_NUMBER" if any(n not in said for n in re.findall(G.NUMBER, text)) else None
        out.append((place, re.sub(r"\s+([.!?,;:])", r"\1", text), list(dict.fromkeys(cites)), problem))
    return out


def test_grounded_sentences(spark):
    r = random.Random(6)
    statements = {1: ["the size is 12 mm", "it weighs 3.5 kg", "made of steel"], 2: ["only one, 7"], 3: []}
    pieces = ["The size is 12 mm", "It weighs 3.5 kg", "It weighs 99 kg", "Steel", "[1]", "[2]", "[3]", "[9]", "[0]", ".", "!", " . ", "\n", "12", "?"]
    replies = [(i, 1 + i % 3, " ".join(r.choice(pieces) for _ in range(r.randint(0, 14)))) for i in range(240)] + [(900, 1, "Insufficient. [1]"), (901, 1, None), (902, 1, "")]
    rows = [(i, p, s) for i, k, _ in replies for p, s in enumerate(statements[k])]
    given = G.numbered(spark.createDataFrame(rows, "request_id int, place int, statement string"))
    df = spark.createDataFrame([(i, t) for i, _, t in replies], "request_id int, reply string")
    got = {}
    for x in G.grounded(df, given).collect():
        got.setdefault(x["request_id"], []).append((x["place"], x["text"], list(x["citations"]), x["problem"]))
    for i, k, t in replies:
        assert sorted(got.get(i, [])) == plain_grounded(t, statements[k]), (t, k)
    whole = {x["request_id"]: (x["text"], x["n_kept"], x["n_removed"], x["insufficient"]) for x in G.explanations(df, given).collect()}
    for i, k, t in replies:
        want = plain_grounded(t, statements[k])
        kept = [x[1] for x in want if x[3] is None]
        assert whole[i] == (" ".join(kept), len(kept), len(want) - len(kept), not kept)


def test_statements_are_numbered(spark):
    rows = [(1, i, " " if i == 2 else f"s  {i} " + "x" * 700) for i in range(20)]
    got = sorted((x["number"], x["statement"]) for x in G.numbered(spark.createDataFrame(rows, "request_id int, place int, statement string")).collect())
    assert [n for n, _ in got] == list(range(1, 13)) and got[0][1].startswith("s 0 x") and got[2][1].startswith("s 3 ") and all(len(s) == 600 for _, s in got)


def test_topics(spark):
    cases = [("What are resistors made of?", "resistor", None), ("What is a glass?", "glass", None), ("What is a diode", "Zener diode", "NOT_ASKED: zener"), ("What", "  ", "NO_TOPIC"), ("bass class", "clas", "NOT_ASKED: cla")]
    df = spark.createDataFrame([(i, q, t) for i, (q, t, _) in enumerate(cases)], "i int, q string, t string")
    assert {x["i"]: x["p"] for x in df.select("i", G.topic_problem(F.col("q"), F.col("t")).alias("p")).collect()} == {i: p for i, (_, _, p) in enumerate(cases)}


def plain_naming(text, subject):
    out, start = [], 0
    for i, c in enumerate(text + "\n"):
        if c != "\n" and not (c in ".!?" and (i + 1 >= len(text) or text[i + 1].isspace())):
            continue
        piece = text[start : i + (c != "\n")]
        if piece.strip() and fold(subject) in fold(piece):
            at = start + piece.index(piece.strip())
            out.append((at, at + len(piece.strip()), " ".join(piece.split())))
        start = i + 1
    return out[:5]


def test_sentences_that_name_a_subject(spark):
    r = random.Random(8)
    texts = ["".join(r.choice(["The diode", "DIODE ", "ﬁeld", " is", ". ", "! ", "\n", "3.5", " ", "e.g.x", "?"]) for _ in range(r.randint(0, 30))) for _ in range(150)] + ["diode. " * 9]
    df = spark.createDataFrame([(i, t, "Diode" if i % 2 else "field") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "text", "")], "text_id int, text string, subject string")
    got = {}
    for x in G.naming(df).collect():
        got.setdefault(x["text_id"], {})[x["place"]] = (x["start"], x["end"], x["sentence"])
    for i, t in enumerate(texts):
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == plain_naming(t, "Diode" if i % 2 else "field"), repr(t)
    assert 900 not in got and 901 not in got


def test_histories_against_replay(spark):
    r = random.Random(9)
    versions = [(f"P{p}", v, t) for p in range(4) for v, t in enumerate(sorted(r.sample(range(0, 60), 3)), 1)]
    runs = [(f"P{r.randint(0, 4)}", f"V{i:03}", r.choice(P.OUTCOMES), r.randint(0, 60)) for i in range(80)]
    asked = [(f"P{p}", t) for p in range(6) for t in (-1, 7, 20, 20, 41, 60)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {(x["subject_id"], x["at"]): tuple(x)[2:] for x in P.states(df(runs, "subject_id string, id string, status string, at int"), df(versions, "subject_id string, version int, at int"), df(asked, "subject_id string, at int")).collect()}
    assert len(got) == 30
    for s, t in asked:
        def at(u):
            known = [(w, v) for p, v, w in versions if p == s and w <= u]
            return max(known)[1] if known else None

        seen = sorted((u, i, status) for p, i, status, u in runs if p == s and u <= t)
        good = [u for u, _, status in seen if status == "VERIFIED"]
        version = at(t)
        want = (version, len(seen), len(good), sum(x[2] == "FAILED" for x in seen), max(good, default=None), seen[-1][2] if seen else None, any(status == "VERIFIED" and at(u) == version for u, _, status in seen))
        assert got[s, t][:-1] == want, (s, t)
        assert got[s, t][-1].startswith("never executed" if not seen else "verified on" if good else "executed")


def test_files_against_hashes(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    docs = spark.createDataFrame([("D1", sha(b"a")), ("D2", sha(b"b")), ("D3", sha(b"c"))], "document_id string, file_hash string")
    files = spark.createDataFrame([("D1", bytearray(b"a")), ("D2", bytearray(b"x"))], "document_id string, content binary")
    assert {tuple(x) for x in P.file_checks(docs, files).collect()} == {("D1", "VERIFIED"), ("D2", "FAILED"), ("D3", "INCONCLUSIVE")}
