"""Alignments, located names and what follows from them, against plain versions."""

import random
import unicodedata
from types import SimpleNamespace

from quillspark.functions.alignment import aligned, with_alignment
from quillspark.functions.text import fold
from quillspark.operators import classification as K

PARTS = ["ﬁ", "ß", "é", "é", "각", "½", " ", "  ", "\t\n", "A", "bC", "İ", "ſ", "①", " ", "ẋ̣", "Å", "中", ".", "-"]


def test_alignment_is_proved(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 12))) for _ in range(800)] + [None, "", "plain text", "  Trim  me "]
    known = 0
    for t in texts:
        found = aligned(t)
        if found is None:
            continue
        known += 1
        norm, begins, ends = found
        assert norm == fold(t) and len(norm) == len(begins) == len(ends)
        for c, a, b in zip(norm, begins, ends, strict=True):
            assert 0 <= a < b <= len(t)
            piece = unicodedata.normalize("NFKC", t[a:b]).casefold()
            assert (not piece.strip() if c == " " else c in piece) or " " in piece
        assert all(x <= y for x, y in zip(begins, begins[1:], strict=False))
    assert known > 700
    rows = with_alignment(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").collect()
    assert all((x["norm"], x["begins"], x["ends"]) == (aligned(texts[x["i"]]) or (None, None, None)) for x in rows)


def plain(raw, own, names):
    text, found = fold(raw), []
    taken = []
    for name in sorted(names, key=lambda n: (-len(n), n)):
        at = text.find(name)
        while at >= 0:
            end = at + len(name)
            if not (at and text[at - 1].isalnum()) and not (end < len(text) and text[end].isalnum()) and not any(at < b and a < end for a, b in taken):
                taken.append((at, end))
                whole = aligned(raw)
                span = (whole[1][at], whole[2][end - 1]) if whole else None
                ok = span is not None and fold(raw[span[0] : span[1]]) == name
                outcome = "AMBIGUOUS" if len(names[name]) > 1 else "OWN" if names[name] == [own] else "MENTION" if ok else "UNMAPPABLE"
                found.append((name, at, end, *(span if outcome == "MENTION" else (None, None)), outcome))
            at = text.find(name, at + 1)
    return sorted(found, key=str)


def test_located_names(spark):
    r = random.Random(2)
    aliases = [("C1", "field effect transistor"), ("C2", "transistor"), ("C3", "gate"), ("C4", "gate"), ("C5", "fig"), ("C6", "c++"), ("C7", "straße"), ("C7", "strasse"), ("C8", "1⁄2 wave"), ("C9", "café"), ("C2", "field"), ("C10", "2 in")]
    aliases = [(c, fold(a)) for c, a in aliases]
    pieces = ["field", "Effect", "TRANSISTOR", "transistors", "gate", "ﬁg", "C++", "Straße", "½ wave", "café", "CAFÉ", "in", "the", ",", "(", "1⁄2 wave", "½ in"]
    texts = [(f"T{i}", r.choice(["C1", "C2", "C5"]), r.choice([" ", "  "]).join(r.choice(pieces) for _ in range(r.randint(1, 9)))) for i in range(300)] + [("N", "C1", None), ("E", "C1", "")]
    names = {}
    for c, n in aliases:
        names.setdefault(n, set()).add(c)
    names = {n: sorted(c) for n, c in names.items()}
    known = K.name_table(spark.createDataFrame(aliases, "concept_id string, normalized_alias string"))
    got = {}
    for x in K.located(spark.createDataFrame(texts, "text_id string, own string, text string"), known).collect():
        got.setdefault(x["text_id"], []).append((x["name"], x["start"], x["end"], x["raw_start"], x["raw_end"], x["outcome"]))
        if x["outcome"] == "MENTION":
            raw = next(t for i, _, t in texts if i == x["text_id"])
            assert raw[x["raw_start"] : x["raw_end"]] == x["matched"] and fold(x["matched"]) == x["name"]
    for i, own, t in texts:
        assert sorted(got.get(i, []), key=str) == (plain(t, own, names) if t else []), (i, t)
    assert {"MENTION", "OWN", "AMBIGUOUS", "UNMAPPABLE"} <= {x[-1] for rows in got.values() for x in rows}


def test_outcomes_runs_and_promotion(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = df([("O1", "C1", ["C2"], "b", "MENTION"), ("O2", "C2", ["C1"], "a", "MENTION"), ("O3", "C1", ["C3"], "c", "MENTION"), ("O4", "C4", ["C1"], "a", "MENTION"), ("O5", "C1", ["C5"], "e", "MENTION"), ("O6", "C1", ["C6"], "e", "OWN")], "text_id string, own string, concepts array<string>, matched string, outcome string")
    edges = df([("R1", "INFERRED", "C2", "C1"), ("R2", "INFERRED", "C1", "C2"), ("R3", "EXPLICIT", "C3", "C1"), ("R4", "INFERRED", "C1", "C5")], "id string, origin string, concept_a string, concept_b string")
    recorded = df([("R2", "O1", "b"), ("R4", "O5", "e")], "relationship_id string, basis_occurrence_id string, matched_text string")
    assert {tuple(x) for x in K.outcomes(found, edges, recorded).collect()} == {("C1", "C2", "BASIS_ADDED", 2, 1), ("C1", "C3", "EXPLICIT_EXISTS", 1, 0), ("C1", "C4", "CREATED", 1, 1), ("C1", "C5", "ALREADY_RECORDED", 1, 0)}
    runs = df([("RUN1", "D1", "COMPLETED"), ("RUN2", "D2", "COMPLETED"), ("RUN3", "D2", "FAILED"), ("RUN4", "D3", "FAILED")], "id string, document_id string, status string")
    asked = df([(1, "RUN1", None), (2, None, "D1"), (3, None, "D2"), (4, None, "D9"), (5, "RUN9", None), (6, None, None), (7, "RUN1", "D1"), (8, None, "D3"), (9, "RUN3", None)], "request_id int, run_id string, document_id string")
    got = {x["request_id"]: x["run_id"] or x["problem"] for x in K.selected_runs(SimpleNamespace(run=runs), asked).collect()}
    assert got == {1: "RUN1", 2: "RUN1", 3: "SEVERAL_RUNS", 4: "NO_RUN", 5: "NO_SUCH_RUN", 6: "NOTHING_NAMED", 7: "BOTH_NAMED", 8: "REFUSED_STATE", 9: "REFUSED_STATE"}
    e = df([("R1", "INFERRED", "ACTIVE"), ("R2", "INFERRED", "DELETED"), ("R3", "EXPLICIT", "ACTIVE"), ("R4", "EXPLICIT", "ACTIVE"), ("R5", "INFERRED", "ACTIVE")], "id string, origin string, lifecycle_status string")
    done = {x["id"]: (x["new_origin"], x["problem"]) for x in K.promoted(e, df([("R1",), ("R2",), ("R3",)], "relationship_id string")).collect()}
    assert done == {"R1": ("EXPLICIT", None), "R2": ("INFERRED", "NOT_ACTIVE"), "R3": ("EXPLICIT", None), "R4": ("EXPLICIT", "NO_EVIDENCE"), "R5": ("INFERRED", None)}
