"""Typed requests: what can't be asked, and what is found within scope and filters."""

from types import SimpleNamespace

from quillspark.operators import typed as T

PLACE = ", document_id string, source_id string, extraction_run_id string, page_number int, char_start int, char_end int, segment_id string, text string"


def test_problems(spark):
    ok = {"name": None, "identifier": None, "document_id": None, "page_number": None, "term": None, "prefix": None, "scope": None, "document_ids": None, "pages": None, "extractor_versions": None}
    cases = [
        ({"mode": "CONCEPT", "name": "x"}, None), ({"mode": "ASK", "name": "x"}, "NO_SUCH_MODE"), ({"mode": None}, "NO_SUCH_MODE"), ({"mode": "CONCEPT", "name": "x", "prefix": True}, "PREFIX_WITHOUT_KEYWORD"), ({"mode": "CONCEPT", "name": "x", "scope": "ALL"}, "NO_SUCH_SCOPE"),
        ({"mode": "CONCEPT", "name": "x", "document_ids": ["DOC-1"]}, "FILTER_NO_IDENTIFIER"), ({"mode": "CONCEPT", "name": "x", "document_ids": ["DOC-00000001"]}, None), ({"mode": "CONCEPT", "name": "x", "pages": ["-1"]}, "FILTER_NO_PAGE"), ({"mode": "CONCEPT", "name": "x", "pages": ["one"]}, "FILTER_NO_PAGE"),
        ({"mode": "CONCEPT", "name": "x", "extractor_versions": [" "]}, "FILTER_EMPTY_VERSION"), ({"mode": "CONCEPT"}, "OTHER_FIELDS_THAN_ITS_MODE"), ({"mode": "CONCEPT", "name": "x", "term": "y"}, "OTHER_FIELDS_THAN_ITS_MODE"), ({"mode": "CONCEPT", "name": " "}, "EMPTY_NAME"),
        ({"mode": "KEYWORD", "term": " .. "}, "EMPTY_TERM"), ({"mode": "KEYWORD", "term": "a", "prefix": True}, None), ({"mode": "EXACT", "identifier": "SRC-00000001"}, "NO_IDENTIFIER"), ({"mode": "EXACT", "identifier": "K-00000001"}, None), ({"mode": "PAGE", "document_id": "DOC-00000001", "page_number": -1}, "NO_PAGE"), ({"mode": "PAGE", "document_id": "DOC-00000001", "page_number": 0}, None), ({"mode": "PAGE", "document_id": "DOC-00000001"}, "OTHER_FIELDS_THAN_ITS_MODE"),
    ]
    rows = [(i, c["mode"], *({**ok, **c}[k] for k in ok)) for i, (c, _) in enumerate(cases)]
    schema = "request_id int, mode string, name string, identifier string, document_id string, page_number int, term string, prefix boolean, scope string, document_ids array<string>, pages array<string>, extractor_versions array<string>"
    got = {x["request_id"]: x["p"] for x in T.requests(spark.createDataFrame(rows, schema)).select("request_id", T.problem().alias("p")).collect()}
    assert got == {i: p for i, (_, p) in enumerate(cases)}


def test_answers_within_scope_and_filters(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    at = lambda source, run="RUN-00000001", page=1: ("DOC-00000001", source, run, page, 0, 1, None, "t")
    kb = SimpleNamespace(
        knowledge=df([("K-00000001", "RULE", "never swap wires", "ACTIVE", "KNOWN"), ("K-00000002", "EQUATION", "swapping wires helps", "SUPERSEDED", "UNCERTAIN"), ("K-00000003", "RULE", "none", "ACTIVE", "KNOWN")], "id string, knowledge_type string, statement string, lifecycle_status string, certainty string"),
        concept=df([("CPT-00000001", "Wire", "ACTIVE")], "id string, canonical_name string, lifecycle_status string"), alias=df([("CPT-00000001", "wire", "ACTIVE")], "concept_id string, normalized_alias string, lifecycle_status string"),
        edge=df([], "id string, relation_type string, origin string, lifecycle_status string"), edge_occurrence=df([], "id string, relationship_id string" + PLACE), basis=df([], "relationship_id string, rule string, basis_occurrence_id string"),
        source_occurrence=df([("S1", "K-00000001", *at("OWN")), ("S2", "K-00000001", *at("OWN", "RUN-00000002", 2)), ("S3", "K-00000002", *at("EXT"))], "id string, knowledge_id string" + PLACE), concept_occurrence=df([("C1", "CPT-00000001", *at("NO"))], "id string, concept_id string" + PLACE),
        source=df([("OWN", "AUTHORIZED", "LOCAL_SOURCE"), ("EXT", "AUTHORIZED", "SYSTEM_DERIVED"), ("NO", "NOT_AUTHORIZED", "LOCAL_SOURCE")], "id string, authorization string, source_category string"), run=df([("RUN-00000001", "COMPLETED", 6), ("RUN-00000002", "PARTIAL", 5)], "id string, status string, extractor_version int"),
    )
    schema = "request_id int, mode string, identifier string, name string, term string, prefix boolean, scope string, knowledge_types array<string>, run_statuses array<string>, extractor_versions array<string>, include_superseded boolean, document_id string, page_number int"
    cases = {
        1: (("EXACT", "K-00000001", None, None, None, None, None, None, None, None, None, None), {("K-00000001", 2, None)}), 2: (("EXACT", "K-00000001", None, None, None, None, None, ["PARTIAL"], None, None, None, None), {("K-00000001", 1, None)}), 3: (("EXACT", "K-00000001", None, None, None, None, None, ["FAILED"], None, None, None, None), {("K-00000001", 0, "filtered")}),
        4: (("EXACT", "K-00000001", None, None, None, None, ["EQUATION"], None, None, None, None, None), {("K-00000001", 0, "LEFT_OUT")}), 5: (("EXACT", "K-00000002", None, None, None, None, None, None, None, None, None, None), {("K-00000002", 0, "not authorized")}), 6: (("EXACT", "K-00000002", None, None, None, "AUTHORIZED", None, None, None, None, None, None), {("K-00000002", 1, None)}),
        7: (("EXACT", "K-00000002", None, None, None, "AUTHORIZED", None, None, None, False, None, None), {("K-00000002", 0, "LEFT_OUT")}), 8: (("EXACT", "K-00000003", None, None, None, None, None, None, None, None, None, None), {("K-00000003", 0, "no evidence")}), 9: (("CONCEPT", None, " WIRE ", None, None, None, None, None, None, None, None, None), {("CPT-00000001", 0, "not authorized")}),
        10: (("KEYWORD", None, None, "swap", None, None, None, None, None, None, None, None), {("K-00000001", 2, None)}), 11: (("KEYWORD", None, None, "swap", True, "AUTHORIZED", None, None, None, None, None, None), {("K-00000001", 2, None), ("K-00000002", 1, None)}), 12: (("KEYWORD", None, None, "swap wir", True, "AUTHORIZED", None, None, None, None, None, None), {("K-00000001", 2, None)}),
        13: (("PAGE", None, None, None, None, None, None, None, ["5"], None, "DOC-00000001", 2), {("K-00000001", 1, None)}), 14: (("CONCEPT", None, "nothing", None, None, None, None, None, None, None, None, None), {(None, None, None)}),
    }
    got = {}
    for x in T.answered(kb, df([(i, *c) for i, (c, _) in cases.items()], schema)).collect():
        assert x["problem"] is None
        got.setdefault(x["request_id"], set()).add((x["item_id"], x["n_in_scope"], x["reason"]))
    assert got == {i: want for i, (_, want) in cases.items()}
