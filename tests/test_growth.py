"""What must not grow with the tables: what the driver collects for joins, and work done twice."""

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark import session
from quillspark.adapter import knowledge_base
from quillspark.operators import calculation, catalogue, classification, dedup, detectors, mentions, requests, retrieval, solving, structure, verification
from quillspark.plans import checks, lookups  # noqa: F401, queries register on import
from quillspark.plans.catalog import QUERIES

SF, LIMIT = "/root/testdata/sf0.001", "spark.sql.autoBroadcastJoinThreshold"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_over_a_limit_are_not_broadcast(spark):
    before = spark.conf.get(LIMIT)
    try:
        for given, left in (("10MB", str(session.MAX_BROADCAST)), ("64k", "64k"), ("-1", "-1")):
            spark.conf.set(LIMIT, given)
            knowledge_base(spark, SF)
            assert spark.conf.get(LIMIT) == left
    finally:
        spark.conf.set(LIMIT, before)


def test_stretches_of_runs_are_not_broadcast(spark):
    atoms = spark.createDataFrame([("S1",), ("K2",)], "atom string")
    found = solving.products(spark.createDataFrame([("S1K2",)], "run string"), atoms)
    assert "Broadcast" not in plan_of(found)
    assert [(x["run"], x["ways"]) for x in found.collect()] == [("S1K2", ["S1*K2"])]


def test_heads_work_out_each_text_once(spark):
    kb = spark.createDataFrame([(r"S_{1} = \frac{S_{2}}{K_{3}}",), ("S_{4}^{2} = S_{5}",), ("nothing",)], "expression string")
    found = solving.heads(kb)
    assert [x["atom"] for x in found.collect()] == ["S1"]
    assert "frac" not in plan_of(found)


def test_spans_carry_no_lists_of_concepts(spark):
    known = mentions.name_sizes(spark.createDataFrame([("C1", "red box"), ("C2", "red box"), ("C2", "Red-box"), ("C1", "box")], "concept_id string, normalized_alias string"))
    assert {tuple(x) for x in known.select("name", "n_words", "n_concepts").collect()} == {("red box", 2, 2), ("box", 1, 1)}
    found = mentions.spans(spark.createDataFrame([("t", "o", "a red box in a box")], "text_id string, own string, text string"), known)
    assert not any("array" in kind for _, kind in found.dtypes)
    assert {(x["name"], x["start_word"]) for x in found.collect()} == {("red box", 2), ("box", 6)}


def test_places_of_characters_are_not_broadcast(spark):
    texts = spark.createDataFrame([("t", "o", "a red box")], "text_id string, own string, text string")
    known = classification.name_table(spark.createDataFrame([("C1", "red box")], "concept_id string, normalized_alias string"))
    found = classification.located(texts, known)
    assert "SortMergeJoin" in plan_of(found)
    assert [(x["name"], x["raw_start"], x["outcome"]) for x in found.collect()] == [("red box", 2, "MENTION")]


def test_pairs_are_compared_by_numbers_read_once(spark):
    norms = ["it is 5 by a", "it is 6 by a", "it is 5.0 by a", "it is # by a", "it is 5, by a", "it is 7, by a", "it is 5 by b", "it is " + "9" * 60 + " by a"]
    rows = spark.createDataFrame([(f"K-{i:08d}", "RULE", n, "x") for i, n in enumerate(norms)], "id string, knowledge_type string, norm string, name string")
    pairs = [(a, b) for a in range(len(norms)) for b in range(a + 1, len(norms))]
    one = spark.createDataFrame([(a, b, norms[a], norms[b]) for a, b in pairs], "i int, j int, a string, b string")
    want = {(f"K-{x['i']:08d}", f"K-{x['j']:08d}") for x in one.where(dedup.contradicts(one["a"], one["b"])).collect()}
    found = dedup.contradictions(rows, "name")
    assert "split" not in plan_of(found)
    assert {tuple(x) for x in found.collect()} == want and len(want) == 3
    assert {(x["canonical_id"], x["other_id"]) for x in dedup.compared(rows, "name").where("outcome = 'CONTRADICTORY'").collect()} == want


def test_texts_are_compared_once_for_all_statements_that_have_them(spark, monkeypatch):
    """Blocks of two numbers each give the same pairs as every two statements; a text of twenty statements is compared once a block."""
    rows = [(f"K-{(i * 37) % 101:08d}", ("RULE", "RULE", "PROPERTY")[i % 3], f"it is {i % 4} by {'ab'[i % 2]}", ("x", "y")[i % 5 == 0]) for i in range(80)]
    rows += [("K-00000003", "RULE", "another by a", "x"), ("odd", "RULE", "it is 1 by a", "x"), ("K-00000900", "RULE", None, "x"), ("K-00000901", None, "it is 1 by a", "x"), ("K-00000902", "RULE", "it is 1 by a", None)]
    said = spark.createDataFrame(rows, "id string, knowledge_type string, norm string, name string")
    kinds = {(a, b): c for a, b, c in spark.createDataFrame([(a, b) for a in {r[2] for r in rows if r[2]} for b in {r[2] for r in rows if r[2]}], "a string, b string").select("a", "b", dedup.contradicts(F.col("a"), F.col("b"))).collect()}
    number = lambda r: int(r[0][2:]) if r[0].startswith("K-") else None
    want = sorted((a[0], b[0], "CONTRADICTORY" if kinds[a[2], b[2]] else "POSSIBLE_DUPLICATE") for a in rows for b in rows if None not in (*a, *b, number(a), number(b)) and a[1] == b[1] and a[3] == b[3] and a[2] != b[2] and number(a) < number(b))
    monkeypatch.setattr(dedup, "_BLOCK", 2)
    found = dedup.compared(said, "name")
    assert sorted(map(tuple, found.collect())) == want and len({x[2] for x in want}) == 2
    # texts meet below the lists of statements that are written out
    assert "zip_with" in plan_of(found).split("Generate", 2)[2] and "zip_with" not in plan_of(found).split("Generate", 2)[0]


def test_citations_of_a_number_that_two_edges_bear(spark):
    kb = knowledge_base(spark, SF)
    own = kb.edge.where("relation_type = 'REQUIRES' and lifecycle_status = 'ACTIVE'").join(kb.edge_occurrence.join(kb.source.where("authorization = 'AUTHORIZED' and source_category <> 'UNAUTHORIZED_SOURCE'").selectExpr("id as source_id"), "source_id").selectExpr("relationship_id as id"), "id", "left_semi").orderBy("id").limit(1)
    other = own.selectExpr("id", "'DEFINED_BY' as relation_type", "origin", "lifecycle_status", "'CPT-00001000' as from_concept_id", "cast(null as string) as to_concept_id", "'K-00000001' as to_knowledge_id")
    both = SimpleNamespace(**vars(kb) | {"edge": own.unionByName(other)})
    steps = own.selectExpr("1L as answer_id", "1 as number", "from_concept_id as concept_id", "array(to_concept_id) as requirements", "array(id) as relationships")
    assert [(x["status"], x["detail"]) for x in verification.derivations(both, steps).collect()] == [("VERIFIED", None)]


def test_lines_of_a_number_that_two_edges_bear_keep_their_order(spark):
    """Two edges of the smallest table bear the number REL-00000007: lines that lead to a statement come first."""
    found = QUERIES["an1_answers"](spark, SF).where("request_id = 2 and item_id = 'REL-00000007'").orderBy("line")
    assert [x["text"] for x in found.collect()] == ["APPLIES_TO: NATION_6", "PARENT_OF: NATION_6"]


def test_answers_leave_out_no_line_and_no_mention(spark):
    kb = knowledge_base(spark, SF)
    edges = spark.range(6000).selectExpr("concat('REL-', lpad(id, 8, '0')) as id", "'RELATED_TO' as relation_type", "'EXPLICIT' as origin", "'ACTIVE' as lifecycle_status", "'CPT-00000001' as from_concept_id", "'CPT-00000002' as to_concept_id", "cast(null as string) as to_knowledge_id")
    said = spark.range(30).selectExpr("concat('K-', lpad(id, 8, '0')) as id", "'PROPERTY' as knowledge_type", "'x' as canonical_name", "'the america is rated' as statement", "'ACTIVE' as lifecycle_status", "'KNOWN' as certainty")
    kb = SimpleNamespace(**vars(kb) | {"edge": edges, "knowledge": said})
    asked = spark.createDataFrame([(1, "Show everything about AFRICA"), (2, "What are the prerequisites of AMERICA")], "request_id long, text string")
    asked = asked.unionByName(spark.createDataFrame([(3, "Show everything about ASIA")], asked.schema))
    found = {(x["request_id"], x["status"]): (x["n"], x["last"]) for x in requests.answers(kb, asked).groupBy("request_id", "status").agg(F.count("*").alias("n"), F.max("line").alias("last")).collect()}
    assert found == {(1, "FOUND"): (6000, 6000), (2, "MENTIONED"): (30, 30), (3, "UNKNOWN"): (1, 0)}


def test_problems_are_not_broadcast_to_meet_equations(spark, monkeypatch):
    plans, old = [], calculation.written
    monkeypatch.setattr(calculation, "written", lambda df, name: (plans.append(plan_of(df)) if name == "tried" else None, old(df, name))[1])
    eq = spark.createDataFrame([("1", "b", "b = a + 1", ["a"]), ("2", "c", "c = 4", []), ("3", "d", "d = b / c", ["b", "c"])], "equation_id string, target string, formula string, needs array<string>")
    known = spark.range(20000).selectExpr("id as problem_id", "'a' as symbol", "cast(id % 7 as string) as value", "cast(null as array<int>) as dimension")
    found = calculation.solved(eq, known)
    assert "BroadcastNestedLoopJoin BuildLeft" in plans[0] and "BroadcastNestedLoopJoin BuildRight" not in plans[0]
    assert found.where("symbol = 'd'").groupBy("state", "round").count().collect() == [("DERIVED", 2, 20000)]
    assert found.where("symbol = 'd' and problem_id = 9").first()["value"] == "3/4"


def test_values_are_read_column_by_column():
    kind = pa.map_(pa.string(), pa.struct([("value", pa.string()), ("dimension", pa.list_(pa.int32()))]))
    rows = pa.array([[("a", {"value": "1", "dimension": None})], None, [], [("b", {"value": "2", "dimension": []}), ("c", {"value": "3", "dimension": [1, 0]})]], kind)
    assert calculation._tuples(rows) == [(("a", "1", None),), (), (), (("b", "2", ()), ("c", "3", (1, 0)))]
    assert calculation._tuples(rows.slice(2)) == calculation._tuples(rows)[2:]


def test_pairs_of_names_are_dropped_where_they_meet(spark):
    rows = spark.createDataFrame([("C-1", "x"), ("C-2", "x"), ("C-3", "x"), ("C-1", "y"), ("C-2", "y"), ("C-4", "y"), ("C-5", "z"), ("C-1", None)], "concept_id string, name string")
    found = catalogue.name_pairs(rows, F.col("a.concept_id") < F.col("b.concept_id")).select("a.concept_id", "b.concept_id", "a.name")
    assert sorted(tuple(x) for x in found.collect()) == [("C-1", "C-2", "x"), ("C-1", "C-3", "x"), ("C-1", "C-4", "y"), ("C-2", "C-3", "x"), ("C-2", "C-4", "y")]
    got = retrieval.one_hop_equivalents(rows, spark.createDataFrame([("C-2",), ("C-3",), ("C-2",)], "concept_id string"))
    assert sorted(tuple(x) for x in got.collect()) == [("C-2", "C-1"), ("C-2", "C-3"), ("C-2", "C-4"), ("C-3", "C-1")]
    kb = knowledge_base(spark, SF)
    for df in (catalogue.equivalent_pairs(kb), got, QUERIES["d10_unrecorded_pairs"](spark, SF)):
        # above the join of names nothing gathers or sorts pairs
        assert not any(x in plan_of(df).split("SortMergeJoin [name")[0].split("SortMergeJoin")[0] for x in ("Aggregate", "Exchange", "Sort "))


def test_recorded_pairs_are_left_out(spark):
    kb = knowledge_base(spark, SF.replace("0.001", "0.01"))
    pairs = catalogue.equivalent_pairs(kb).collect()
    first = pairs[0]
    recorded = spark.createDataFrame([(first["concept_b"], first["concept_a"]), (first["concept_a"], None)], "a string, b string")
    left = catalogue.equivalent_pairs(kb, recorded).collect()
    assert sorted(map(tuple, left)) == sorted(tuple(x) for x in pairs if x != first)


def test_rounds_of_plans_leave_out_what_is_too_far_behind(spark, monkeypatch):
    outputs, old = [], solving._merged
    monkeypatch.setattr(solving, "_merged", lambda rows: (outputs.append({x["o"] for x in rows.selectExpr("step.output as o").distinct().collect()}), old(rows))[1])
    # each quantity by the next one, each also by the one after it, so plans change until the last round
    laws = [(f"E-{i}", f"q{i} = q{i + 1} + 1", True) for i in range(7)] + [(f"F-{i}", f"q{i} = q{i + 2} * 2", True) for i in range(6)]
    found = solving.forms(spark.createDataFrame(laws, "equation_id string, formula string, stated boolean")).where("not rearranged")
    known, target = spark.createDataFrame([(1, "q6")], "problem_id long, symbol string"), spark.createDataFrame([(1, "q0")], "problem_id long, symbol string")
    plans = solving.plans(found, known, target).collect()
    assert len(outputs) == 6 and outputs[-1] == {"q0"} and "q5" not in outputs[3]
    assert len(plans) == solving.KEEP and [s["output"] for s in sorted(plans, key=lambda x: x["place"])[0]["steps"]] == ["q4", "q2", "q0"]


def test_plans_look_only_at_what_lies_between(spark, monkeypatch):
    """Wherever the search from both ends meets, the plans are the same, and equations whose inputs can't be had are not carried along."""
    laws = [(f"E-{i}", f"q{i} = q{i + 1} + 1", True) for i in range(6)] + [("F-0", "q0 = q2 * k", True), ("F-1", "q1 = q4 / k", True)]
    idle = [(f"D-{i}", f"q{i % 3} = d{i} + k", True) for i in range(20)] + [(f"D-{i + 20}", f"d{i} = g{i} + 1", True) for i in range(20)]
    found = solving.forms(spark.createDataFrame(laws + idle, "equation_id string, formula string, stated boolean")).where("not rearranged")
    known = spark.createDataFrame([(1, "q4"), (1, "k"), (2, "q6"), (2, "k"), (3, "k")], "problem_id long, symbol string")
    targets = spark.createDataFrame([(1, "q0"), (2, "q0"), (3, "q0"), (1, "q4")], "problem_id long, symbol string")
    seen, old, got = [], solving._between, []
    monkeypatch.setattr(solving, "_between", lambda each, *rest: (lambda x: (seen.append(x.join(each, "form").selectExpr("problem_id", "step.equation_id as e")), x)[1])(old(each, *rest)))
    for lean in (0, 10**9):
        monkeypatch.setattr(solving, "_LEAN", lean)
        got.append(sorted((x["problem_id"], x["place"], [s["formula"] for s in x["steps"]]) for x in solving.plans(found, known, targets).collect()))
    assert got[0] == got[1] and {x[0] for x in got[0]} == {1, 2}
    assert got[0][0][2] == ["q1 = q4 / k", "q0 = q1 + 1"]
    # ahead alone nothing is carried that can't be had; the search back alone still saw dead ends
    assert not {x["e"] for x in seen[1].collect()} & {x[0] for x in idle} and {x["problem_id"] for x in seen[1].collect()} == {1, 2}


def test_a_second_evaluation_runs_nothing_again(spark, monkeypatch):
    """Recorded steps are enough for it, and verdicts read the equations once for the record and the run that repeats it."""
    calls, old = [], checks._forms
    monkeypatch.setattr(checks, "_forms", lambda kb: (calls.append(1), old(kb))[1])
    with monkeypatch.context() as m:
        m.setattr(solving, "answers", None)
        assert QUERIES["vr1_second_evaluation"](spark, SF).where("status = 'VERIFIED'").count() > 0 and len(calls) == 1
    assert QUERIES["vr2_verdicts"](spark, SF).count() > 0 and len(calls) == 2


def test_costs_try_only_equations_of_what_fell(spark, monkeypatch):
    tried, old = [], solving._touched
    monkeypatch.setattr(solving, "_touched", lambda each, fell: (tried.append(sorted(x["equation_id"] for x in old(each, fell).collect())), old(each, fell))[1])
    laws = [(f"E-{i}", f"q{i + 1} = q{i} + 1", True) for i in range(4)] + [("F-0", "q0 = q1 * k", True), ("G-0", "z = q4 + k", True), ("H-0", "y = none + k", True)]
    found = solving.forms(spark.createDataFrame(laws, "equation_id string, formula string, stated boolean")).where("not rearranged")
    known = spark.createDataFrame([(1, "q0"), (1, "k")], "problem_id long, symbol string")
    got = {x["symbol"]: x["cost"] for x in solving.costs(found, known).collect()}
    assert got == {"q0": 0, "k": 0, "q1": 1, "q2": 2, "q3": 3, "q4": 4, "z": 5}
    assert tried == [["E-0", "F-0", "G-0", "H-0"], ["E-1", "F-0"], ["E-2"], ["E-3"], ["G-0"], []]


def test_costs_that_fall_later_are_passed_on(spark):
    """The short way costs more: b by two inputs of two equations each, then by a chain of three."""
    laws = [("A-0", "b = c + d", True), ("A-1", "c = e + 1", True), ("A-2", "d = f + 1", True), ("A-3", "e = k + 1", True), ("A-4", "f = k + 2", True), ("B-0", "u = k + 3", True), ("B-1", "v = u + 1", True), ("B-2", "w = v + 1", True), ("B-3", "b = w + 1", True), ("C-0", "x = b + 1", True)]
    found = solving.forms(spark.createDataFrame(laws, "equation_id string, formula string, stated boolean")).where("not rearranged")
    known = spark.createDataFrame([(1, "k")], "problem_id long, symbol string")
    got = {x["symbol"]: x["cost"] for x in solving.costs(found, known).collect()}
    assert got["b"] == 4 and got["x"] == 5


def test_ways_to_missing_quantities_are_not_broadcast(spark):
    found = solving.forms(spark.createDataFrame([("E-1", "b = a + c", True)], "equation_id string, formula string, stated boolean"))
    known, targets = spark.createDataFrame([(1, "a")], "problem_id long, symbol string"), spark.createDataFrame([(1, "b")], "problem_id long, symbol string")
    ways = solving.missing(found, known, targets)
    assert "Broadcast" not in plan_of(ways)
    assert [(x["formula"], x["needs"]) for x in ways.collect()] == [("b = a + c", ["c"])]


def test_sentences_without_a_cue_are_not_stored(spark, monkeypatch):
    """Each detector finds the same in the sentences that are kept as in all of them."""
    told = ["By mass we mean what resists a push.", "Resistance: the property of a thing that holds back a current.", "Zeta – a letter of the Greek alphabet here.", "The moving part is called the rotor.", "Power is defined as work by time.", "The ohm is a unit.", "Voltage is the measure of push.",
            "It holds where V is the voltage, and I denotes the current.", "The push is denoted by F.", "Force is measured in newtons (N).", "The SI unit of force is the newton.", "Inertia is a property of bodies.", "The characteristics of steel are many.", "One must not touch it.",
            "Ohm's law says the sum of drops is zero.", "Algebra is a prerequisite for analysis.", "Analysis requires a knowledge of algebra.", "A motor consists of a rotor and a stator.", "Heat depends on the current.", "THE GEAR IS USED IN A CLOCK."]
    idle = ["Nothing at all was there that day.", "We went home, later.", "Viele Worte ohne Sinn."]
    rows = spark.createDataFrame([("d", 1, i * 100, i * 100 + len(x), x) for i, x in enumerate([*told, *idle])], "document_id string, page_number int, start int, end int, flat string")
    kept = rows.where(detectors.telling(rows["flat"]))
    assert {x["flat"] for x in kept.collect()} == set(told)
    for f in (detectors.definitions, detectors.variables, detectors.units_of, detectors.properties, detectors.rules, detectors.prerequisites, detectors.relations):
        found = [sorted(map(str, f(x).collect())) for x in (rows, kept)]
        assert found[0] == found[1] and found[0]
    stored, old = {}, detectors.written
    monkeypatch.setattr(detectors, "written", lambda df, name: (lambda t: (stored.update({name: t}), t)[1])(old(df, name)))
    detectors.detect(spark.createDataFrame([("d", 1, "The moving part is called the rotor of it.\n\n\nNothing at all was there that day, they said.\n\nx = y + 1\n")], "document_id string, page_number int, text string"))
    assert [x["flat"] for x in stored["sentences"].collect()] == ["The moving part is called the rotor of it."]
    assert [x["stripped"] for x in stored["lines"].collect()] == ["x = y + 1"]


def test_masks_of_plain_pages_need_no_windows(spark):
    """Pages alone and in their documents: the same masks as from the lines of all."""
    texts = [("a", 1, "one line\r\n(a) an option\nis it so?\n\n ____ gap\x0btail"), ("a", 2, None), ("a", 3, ""), ("b", 1, "Exercises\nfind x"), ("b", 2, "still asked [1999]"), ("b", 3, "CHAPTER HIGHLIGHTS\nfree again"), ("c", 1, "Example 1 stem\nmore stem\nSolution\nplain"), ("c", 2, "plain [2001] year\rnext"), (None, 1, "Exercises\nasked"), ("d", 1, "\n")]
    pages = spark.createDataFrame(texts, "document_id string, page_number int, text string")
    whole, found = structure._masked(pages), structure.masked(pages)
    assert found.dtypes == whole.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    plain = structure.masked(pages.where("document_id = 'a'"))
    assert [x["expository"] for x in plain.collect()] == ["one line\r\n" + " " * 13 + "\n" + " " * 9 + "\n\n" + " " * 10 + "tail"]


def test_statements_made_from_small_files_are_not_broadcast(spark):
    """20,000 parts are under 180 KB of files, but statements made of them are megabytes."""
    before = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "10MB")
        kb = knowledge_base(spark, SF.replace("0.001", "0.1"))
        said = kb.knowledge.selectExpr("id as knowledge_id", "statement")
        assert "Broadcast" not in plan_of(kb.source_occurrence.join(said, "knowledge_id"))
    finally:
        spark.conf.set(LIMIT, before)


def test_requests_are_spread_and_interpreted_in_one_pass(spark, monkeypatch):
    """A packed file gives few tasks; requests are dealt over all before the rules, and written once, behind them."""
    from quillspark.operators import requests

    seen = []
    monkeypatch.setattr(requests, "written", lambda df, name: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    d = spark.createDataFrame([(i, f"what is a thing {i}?") for i in range(40)], "request_id long, text string").coalesce(1)
    found = requests.interpreted(d).orderBy("request_id").collect()
    assert [(r["target"], r["rule"]) for r in found] == [(f"thing {i}", "query.what_is") for i in range(40)]
    assert len(seen) == 1 and "REPARTITION_BY_COL" in seen[0]


def test_writer_makes_only_what_is_asked_for(spark, monkeypatch):
    """Statements need no edges or issues, rows are numbered without a second shuffle, and pages that don't say how they were read are not met."""
    from quillspark.operators import writer

    names, plans, kept = [], [], writer.written
    monkeypatch.setattr(writer, "written", lambda df, name: (names.append(name), plans.append(plan_of(df)), kept(df, name))[2])
    found = QUERIES["v10_planted_knowledge"](spark, SF)
    assert found.count() > 0 and set(names) == {"candidates", "numbered", "linked"}
    assert not any("row_number" in p for p in plans) and "REPARTITION_BY_COL" in plans[0]


def test_numbers_follow_the_order_over_all_ranges(spark):
    from quillspark.operators import writer

    rows = spark.range(1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("v"))
    found = writer.numbered(rows, "K", F.col("v")).orderBy("v").collect()
    assert [(r["v"], r["id"]) for r in found] == [(i, f"K-{i + 1:08d}") for i in range(1000)]
