"""Mathematics of office files and of markup gives the same line, in every reader that meets it."""

import io
import zipfile
from xml.etree import ElementTree

import pytest

from quillspark.sources import formats, mathematics, readers

OFFICE = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
T = lambda x: f"<m:r><m:t>{x}</m:t></m:r>"
FORMULAS = {
    r"\frac{V^{2}}{R}": (f"<m:f><m:num><m:sSup><m:e>{T('V')}</m:e><m:sup>{T('2')}</m:sup></m:sSup></m:num><m:den>{T('R')}</m:den></m:f>", "<mfrac><msup><mi>V</mi><mn>2</mn></msup><mi>R</mi></mfrac>"),
    "a/b": (f'<m:f><m:fPr><m:type m:val="lin"/></m:fPr><m:num>{T("a")}</m:num><m:den>{T("b")}</m:den></m:f>', '<mfrac bevelled="true"><mi>a</mi><mi>b</mi></mfrac>'),
    r"x_{i}^{2}": (f"<m:sSubSup><m:e>{T('x')}</m:e><m:sub>{T('i')}</m:sub><m:sup>{T('2')}</m:sup></m:sSubSup>", "<msubsup><mi>x</mi><mi>i</mi><mn>2</mn></msubsup>"),
    r"{a+b}^{n}": (f"<m:sSup><m:e>{T('a+b')}</m:e><m:sup>{T('n')}</m:sup></m:sSup>", "<msup><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow><mi>n</mi></msup>"),
    r"\sqrt[3]{x}": (f"<m:rad><m:deg>{T('3')}</m:deg><m:e>{T('x')}</m:e></m:rad>", "<mroot><mi>x</mi><mn>3</mn></mroot>"),
    r"\sqrt{x}": (f'<m:rad><m:radPr><m:degHide m:val="1"/></m:radPr><m:deg/><m:e>{T("x")}</m:e></m:rad>', "<msqrt><mi>x</mi></msqrt>"),
    r"\left( a , b \right)": (f"<m:d><m:e>{T('a')}</m:e><m:e>{T('b')}</m:e></m:d>", "<mfenced><mi>a</mi><mi>b</mi></mfenced>"),
    r"\begin{bmatrix} a & b \\ c & d \end{bmatrix}": (f'<m:d><m:dPr><m:begChr m:val="["/><m:endChr m:val="]"/></m:dPr><m:e><m:m><m:mr><m:e>{T("a")}</m:e><m:e>{T("b")}</m:e></m:mr><m:mr><m:e>{T("c")}</m:e><m:e>{T("d")}</m:e></m:mr></m:m></m:e></m:d>', "<mrow><mo>[</mo><mtable><mtr><mtd><mi>a</mi></mtd><mtd><mi>b</mi></mtd></mtr><mtr><mtd><mi>c</mi></mtd><mtd><mi>d</mi></mtd></mtr></mtable><mo>]</mo></mrow>"),
    r"\vec{F}": (f'<m:acc><m:accPr><m:chr m:val="→"/></m:accPr><m:e>{T("F")}</m:e></m:acc>', "<mover><mi>F</mi><mo>→</mo></mover>"),
    r"a\le b": (T("a≤b"), "<mrow><mi>a</mi><mo>≤</mo><mi>b</mi></mrow>"),
    r"x\{y\}": (T("x{y}"), "<mrow><mi>x</mi><mi>{y}</mi></mrow>"),
}


@pytest.mark.parametrize("line", FORMULAS)
def test_both_notations_give_one_line(line):
    office, markup = FORMULAS[line]
    spaced = lambda x: x.replace(" ", "")  # noqa: E731, blanks around signs are all that may differ
    assert spaced(mathematics.linear(ElementTree.fromstring(f"<m:oMath {OFFICE}>{office}</m:oMath>"))) == spaced(line)
    assert spaced(mathematics.linear(ElementTree.fromstring(f"<math>{markup}</math>"))) == spaced(line)
    found, _ = readers.markup_blocks(f"<p>so <math>{markup}</math> holds</p><math display='block'>{markup}</math><p>end")
    assert [(k, spaced(t)) for k, _, t in found] == [("paragraph", "so" + spaced(line) + "holds"), ("equation", spaced(line)), ("paragraph", "end")]


def test_other_elements():
    f = lambda x: mathematics.linear(ElementTree.fromstring(f"<m:oMath {OFFICE}>{x}</m:oMath>"))
    assert f(f'<m:nary><m:naryPr><m:chr m:val="∑"/></m:naryPr><m:sub>{T("i=1")}</m:sub><m:sup>{T("n")}</m:sup><m:e>{T("i")}</m:e></m:nary>') == r"\sum_{i=1}^{n} i"
    assert f(f"<m:nary><m:naryPr><m:supHide m:val='1'/></m:naryPr><m:sub>{T('C')}</m:sub><m:sup/><m:e>{T('f')}</m:e></m:nary>") == r"\int_{C} f"
    assert f(f"<m:func><m:fName>{T('sin')}</m:fName><m:e>{T('x')}</m:e></m:func>") == r"\sin x"
    assert f(f"<m:func><m:fName><m:limLow><m:e>{T('lim')}</m:e><m:lim>{T('n→∞')}</m:lim></m:limLow></m:fName><m:e>{T('x')}</m:e></m:func>") == r"\lim_{n\to \infty} x"
    assert f(f'<m:d><m:dPr><m:begChr m:val="{{"/><m:endChr m:val=""/></m:dPr><m:e><m:eqArr><m:e>{T("a")}</m:e><m:e>{T("b")}</m:e></m:eqArr></m:e></m:d>') == r"\begin{cases} a \\ b \end{cases}"
    assert f(f"<m:unknown>{T('kept')}</m:unknown><m:phant><m:e>{T('gone')}</m:e></m:phant><m:bar><m:e>{T('y')}</m:e></m:bar>") == r"kept\overline{y}"
    assert mathematics.linear(ElementTree.fromstring("<math><semantics><mrow><mi>a</mi><mtext>if so</mtext></mrow><annotation>gone</annotation></semantics></math>")) == r"a\text{if so}"
    assert readers.markup_blocks("<p>a <math><mfrac><mi>x</mi></p>")[0] == [("paragraph", None, "a")]


def test_every_reader_meets_it(spark, tmp_path):
    office, markup = FORMULAS[r"\frac{V^{2}}{R}"]

    def archive(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in members.items():
                z.writestr(name, text)
        return out.getvalue()

    word = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" {OFFICE}><w:body><w:p><w:r><w:t>Power </w:t></w:r><m:oMath>{office}</m:oMath><w:r><w:t> here</w:t></w:r></w:p><w:p><m:oMathPara><m:oMath>{office}</m:oMath></m:oMathPara></w:p></w:body></w:document>'
    slide = f'<p:sld xmlns:p="p" xmlns:a="a" {OFFICE}><p:sp><a:p><a:r><a:t>Power </a:t></a:r><m:oMath>{office}</m:oMath></a:p></p:sp></p:sld>'
    opf = '<package><manifest><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c"/></spine></package>'
    files = {"a.docx": archive({"word/document.xml": word}), "b.bin": archive({"ppt/slides/slide1.xml": slide}), "c.epub": archive({"META-INF/container.xml": "<x/>", "c.opf": opf, "c.xhtml": f"<p>Power <math>{markup}</math></p>"}), "d.html": f"<p>Power <math>{markup}</math></p>".encode(), "e.docx": archive({"other/thing.xml": "<x/>"}), "f.zip": archive({"other/things.xml": "<x/>"})}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = formats.detected(formats.files(spark, str(tmp_path)))
    assert {r["path"].rsplit("/", 1)[1]: (r["format"], r["reason"]) for r in found.collect()} == {"a.docx": ("docx", None), "b.bin": ("pptx", None), "c.epub": ("epub", None), "d.html": ("html", None), "e.docx": ("docx", None), "f.zip": (None, "unknown format")}
    texts = {}
    for r in readers.parts(found.where("reason is null")).join(found.select("file_hash", "format"), readers.F.col("document_id") == readers.F.col("file_hash")).orderBy("n").collect():
        if r["problem"] is None:
            texts.setdefault(r["format"], []).append((r["kind"], r["text"]))
    line = r"Power \frac{V^{2}}{R}"
    assert texts == {"docx": [("paragraph", line + " here"), ("equation", r"\frac{V^{2}}{R}")], "pptx": [("paragraph", line)], "epub": [("paragraph", line)], "html": [("paragraph", line)]}
