"""Files, readers and streams on small files made here."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quillspark.operators import answers, manuals
from quillspark.sources import formats, readers
from quillspark.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


FILES = {
    "a.docx": archive(word__document_dot_xml=f"<w:document {W}><w:p><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Bo</w:t><w:t>dy</w:t></w:r></w:p></w:document>"),
    "b.pptx": archive(ppt__slides__slide2_dot_xml=f"<sld {A}><a:p><a:t>two</a:t></a:p></sld>", ppt__slides__slide1_dot_xml=f"<sld {A}><a:p><a:t>one</a:t></a:p></sld>"),
    "c.xlsx": archive(xl__sharedStrings_dot_xml="<sst><si><t>name</t></si></sst>", xl__worksheets__sheet1_dot_xml='<s><row><c t="s"><v>0</v></c><c><v>5</v></c><c t="b"><v>1</v></c></row></s>'),
    "d.epub": archive(o__c_dot_opf='<p><manifest><item id="x" href="x.html" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="x"/></spine></p>', o__x_dot_html="<h1>Cap</h1><p>Text<script>no</script></p>"),
    "e.csv": b"a;b\n1;2\n",
    "f.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}}Hello\par W\'e9 \u233?}",
    "g.md": b"# Title\n\nSome **bold** [link](http://x)\n",
    "h.html": b"<html><head><title>T</title></head><body><nav>n</nav><p>a<b>b<br>c<!-- x --><style>s</style></body>",
    "i.txt": "é windows".encode("cp1252"),
    "j.txt": b"",
    "k.json": b"{}",
    "l.docx": b"PK\x03\x04broken",
    "m.txt": "é windows".encode("cp1252"),
    "o.png": bytes.fromhex("89504E470D0A1A0A") + b"pixels",
    "p.xlsx": archive(xl__workbook_dot_xml='<w><sheet name="Prices"/></w>', xl__sharedStrings_dot_xml="<sst><si><t>name</t></si></sst>", xl__worksheets__sheet1_dot_xml='<s><row><c r="A1" t="s"><v>9</v></c><c r="C1"><v>5</v></c></row></s>'),
    "q.epub": archive(o__x_dot_html="<p>alone</p>"),
    "r.rtf": rb"{\rtf1 a\u-9999?b}",
    "s.docx": archive(word__document_dot_xml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Part</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>point</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Term</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>body</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>', word__footnotes_dot_xml=f"<w:footnotes {W}><w:footnote><w:p><w:r><w:t>below</w:t></w:r></w:p></w:footnote></w:footnotes>"),
    "n.doc": bytes.fromhex("D0CF11E0A1B11AE1"),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for name, data in FILES.items():
        (d / name).write_bytes(data)
    return d


def test_readers(spark, folder):
    found = formats.detected(formats.files(spark, str(folder))).cache()
    kinds = {x["path"].rpartition("/")[2]: (x["format"], x["reason"]) for x in found.collect()}
    assert kinds["a.docx"] == ("docx", None) and kinds["f.rtf"] == ("rtf", None) and kinds["g.md"] == ("markdown", None)
    assert "j.txt" not in kinds and kinds["k.json"][1] == "data, not a document" and kinds["n.doc"][1] == "an old binary format"
    once = formats.ingested(found)
    name = {x["file_hash"]: x["path"].rpartition("/")[2] for x in once.collect()}
    assert "m.txt" not in name.values() and "i.txt" in name.values()
    texts, problems = {}, {}
    for x in readers.parts(once).orderBy("n").collect():
        (problems if x["problem"] else texts).setdefault(name[x["document_id"]], []).append(x["problem"] or x["text"])
    assert texts["a.docx"] == ["Head", "Body"] and texts["b.pptx"] == ["one", "two"] and texts["c.xlsx"] == ["name\t5\tTRUE"] and texts["d.epub"] == ["Cap", "Text"]
    assert texts["e.csv"] == ["a\tb\n1\t2"] and texts["f.rtf"] == ["Hello\nWé é"] and texts["g.md"] == ["Title", "Some bold link\n"] and texts["h.html"] == ["n", "ab", "c"] and texts["i.txt"] == ["é windows"]
    assert "BadZipFile" in problems["l.docx"][0] and "no reader for png" in problems["o.png"][0] and "no package file" in problems["q.epub"][0]
    assert texts["p.xlsx"] == ["Prices", "\t\t5"] and texts["r.rtf"] == ["a?b"]
    blocks = [(x["kind"], x["level"], x["text"]) for x in readers.parts(once).orderBy("n").collect() if name[x["document_id"]] == "s.docx"]
    assert blocks == [("heading", 2, "Part"), ("item", None, "point"), ("row", None, "Term: body"), ("note", None, "below")]
    assert formats.ingested(found, once).count() == 0
    assert readers.segments(once).where(F.col("text").isNull()).count() == 0


def test_html_columns(spark):
    df = spark.createDataFrame([("<title>A  b</title><p>x<p>y", 1), (None, 2)], "html string, text_ int")
    assert [(x["text"], x["title"]) for x in readers.html_text(df).orderBy("text_").collect()] == [("x\ny", "A b"), ("", None)]


def test_streams(spark, tmp_path):
    schema = StructType([StructField("document_id", StringType()), StructField("page_number", IntegerType()), StructField("text", StringType())])
    spark.createDataFrame([("d", 1, "A Tree is a connected graph that has no cycle at all.\n")], schema).write.parquet(str(tmp_path / "in"))
    run = lambda: ingest.candidates_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert run()
    spark.createDataFrame([("e", 1, "A Leaf is a node that has no child in any tree.\n")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert run()
    names = {x["name"] for x in spark.read.parquet(str(tmp_path / "out")).where("category = 'DEFINITION'").collect()}
    assert names == {"Tree", "Leaf"}


def test_answer_columns(spark):
    # each text with the first of the reasons that holds for it
    cases = {
        "V = IR": None, "V = \ufffd": "contains a Unicode replacement character", "V = {2": "unbalanced braces", "V == 2": "two equality signs run together", "V = (I": "unbalanced parentheses", "V = [I": "unbalanced brackets", "V = f()": "empty parentheses",
        "V = 2 + - 3": "two operators in a row", "V = 2. Then it ": "a sentence runs on", "no equality": "nothing on the right-hand side", "V =": "nothing on the right-hand side", "V = * 2": "the right-hand side opens with an operator",
        "V = 2 +": "the right-hand side ends in an operator", "V = 2 where": "the line ends mid-clause", "V = L di dt": "a differential without a denominator or an integral sign", "V = L di/dt": None, "V = d": "the right-hand side is a lone d", "dV = dt": None,
        "W = Pd t": "a split differential without a denominator or an integral sign", "P = Energy": "the right-hand side is a single word",
    }
    got = {x["t"]: x["p"] for x in spark.createDataFrame([(t,) for t in cases], "t string").select("t", answers.equation_problem(F.col("t")).alias("p")).collect()}
    assert got == cases
    r = spark.createDataFrame([("Open A / Press <key> / Save  <file name> as <key>", "the voltage is 10 volts")], "s string, q string").select(manuals.stored_steps(F.col("s")).alias("steps"), manuals.parameters(F.array("s")).alias("p"), answers.quantity(F.col("q")).alias("q")).first()
    assert r["steps"] == ["Open A", "Press <key>", "Save <file name> as <key>"] and r["p"] == ["key", "file name"] and tuple(r["q"]) == ("voltage", "10", "volts")
    c = spark.createDataFrame([("d", "A", "b"), ("d", "A", "z"), ("e", "A", "B")], "document_id string, subject string, object string")
    k = spark.createDataFrame([("d", "a"), ("d", "B"), ("d", "b")], "document_id string, name string")
    assert {(x["document_id"], x["object"]): x["broken"] for x in answers.endpoints_known(c, k).collect()} == {("d", "b"): False, ("d", "z"): True, ("e", "B"): True}
    e = spark.createDataFrame([("d", 2, "v"), ("d", 1, "V"), ("d", 1, "I")], "document_id string, page_number int, symbol string")
    assert [tuple(x) for x in answers.unknown_symbols(e, spark.createDataFrame([("d", "i")], "document_id string, symbol string")).collect()] == [("d", 1, "V")]
