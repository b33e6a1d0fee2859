"""Trees of mathematics in office files and markup as one line of text, the same for either notation.

A rule for each element says which of its parts play which role; the line is written from the leaves up. What has no
rule gives the text of its parts, so nothing is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from xml.etree.ElementTree import Element

#: Commands by character, operators that take limits, accents, names of functions, brackets of matrices.
COMMANDS = {"∫": r"\int", "∬": r"\iint", "∭": r"\iiint", "∮": r"\oint", "∑": r"\sum", "∏": r"\prod", "≤": r"\le", "≥": r"\ge", "≠": r"\ne", "≈": r"\approx", "→": r"\to", "∞": r"\infty", "∂": r"\partial", "·": r"\cdot", "×": r"\times", "±": r"\pm", "∓": r"\mp", "∝": r"\propto", "∇": r"\nabla", "⋅": r"\cdot", "−": "-"}
BIG = {"∫": r"\int", "∬": r"\iint", "∭": r"\iiint", "∮": r"\oint", "∑": r"\sum", "∏": r"\prod", "⋃": r"\bigcup", "⋂": r"\bigcap"}
ACCENTS = {"\N{COMBINING CIRCUMFLEX ACCENT}": r"\hat", "^": r"\hat", "\N{COMBINING MACRON}": r"\bar", "¯": r"\bar", "\N{COMBINING DOT ABOVE}": r"\dot", "\N{COMBINING RIGHT ARROW ABOVE}": r"\vec", "→": r"\vec", "\N{COMBINING TILDE}": r"\tilde", "~": r"\tilde", "\N{COMBINING DIAERESIS}": r"\ddot"}
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "log", "ln", "exp", "lim", "max", "min", "det")
MATRICES = {"()": "pmatrix", "[]": "bmatrix", "||": "vmatrix", "{}": "Bmatrix"}
_OFF = ("1", "on", "true", "")


def local(e: Element) -> str:
    return e.tag.rpartition("}")[2]


def linear(e: Element) -> str:
    """The line of a tree (oMath, oMathPara or math)."""
    return " ".join(_line(e).split())


def _all(parts: list[Element]) -> str:
    return "".join(map(_line, parts))


def _literal(text: str) -> str:
    return "".join(r"\backslash " if c == "\\" else "\\" + c if c in "{}" else c for c in text)


def _signs(text: str) -> str:
    return "".join(f"{COMMANDS[c]} " if c in COMMANDS else _literal(c) for c in text)


# the writers, which either notation uses


def _braced(text: str) -> str:
    return "{" + text.strip() + "}"


def _base(text: str) -> str:
    """What a script stands at: one symbol as it is, more in braces."""
    t = text.strip()
    return t if len(t) <= 1 or re.fullmatch(r"\\[A-Za-z]+|[A-Za-z]+|[0-9.]+", t) else _braced(t)


def _scripts(base: str, below: str | None = None, above: str | None = None) -> str:
    return base + (f"_{_braced(below)}" if below else "") + (f"^{_braced(above)}" if above else "")


def _fraction(over: str, under: str, flat: bool) -> str:
    return f"{over}/{under}" if flat else rf"\frac{_braced(over)}{_braced(under)}"


def _root(body: str, degree: str = "") -> str:
    return rf"\sqrt{f'[{degree.strip()}]' if degree.strip() else ''}{_braced(body)}"


def _fenced(opening: str, parts: list[str], closing: str, mark: str) -> str:
    side = lambda c: "." if c == "" else "\\" + c if c in "{}" else c
    return rf"\left{side(opening)} {f' {mark} '.join(parts)} \right{side(closing)}"


def _grid(rows: list[list[str]], kind: str) -> str:
    return rf"\begin{{{kind}}} " + r" \\ ".join(" & ".join(cells) for cells in rows) + rf" \end{{{kind}}}"


def _function(name: str) -> str:
    return "\\" + name if name in FUNCTIONS else name


# office mathematics: parts by name


def _of(e: Element, name: str) -> list[Element]:
    return [x for x in e if local(x) == name]


def _part(e: Element, name: str) -> str:
    return "".join(_all(list(x)) for x in _of(e, name)[:1])


def _setting(e: Element, name: str) -> str | None:
    """A property of an element: null if it is not set, an empty text if it has no value."""
    for properties in (x for x in e if local(x) == f"{local(e)}Pr"):
        for x in _of(properties, name):
            return next((v for k, v in x.attrib.items() if k.rpartition("}")[2] == "val"), "")
    return None


def _office_grid(e: Element) -> list[list[str]]:
    return [[_all(list(cell)) for cell in _of(row, "e")] for row in _of(e, "mr")]


def _delimited(e: Element) -> str:
    opening, closing, mark = (default if (x := _setting(e, name)) is None else x for name, default in (("begChr", "("), ("endChr", ")"), ("sepChr", ",")))
    cells = _of(e, "e")
    only = [x for x in cells[0] if not local(x).endswith("Pr")] if len(cells) == 1 else []
    if len(only) == 1 and local(only[0]) == "m" and opening + closing in MATRICES:
        return _grid(_office_grid(only[0]), MATRICES[opening + closing])
    if (opening, closing) == ("{", "") and any(local(x) == "eqArr" for x in only):
        array = next(x for x in only if local(x) == "eqArr")
        return _grid([[_all(list(x))] for x in _of(array, "e")], "cases")
    return _fenced(opening, [_all(list(x)) for x in cells], closing, mark)


def _large(e: Element) -> str:
    sign = _setting(e, "chr") or "∫"
    limits = [_part(e, name) if _setting(e, f"{name}Hide") not in _OFF else "" for name in ("sub", "sup")]
    return f"{_scripts(BIG.get(sign, _literal(sign)), *limits)} {_part(e, 'e')}"


def _limit(e: Element) -> str:
    base = " ".join(_part(e, "e").split())
    return _scripts(r"\lim" if base in ("lim", r"\lim") else base, _part(e, "lim"))


OFFICE: dict[str, Callable[[Element], str]] = {
    "t": lambda e: _signs(e.text or ""), "r": lambda e: _all(_of(e, "t")), "phant": lambda e: "", "oMathPara": lambda e: r" \\ ".join(map(_line, _of(e, "oMath"))),
    "f": lambda e: _fraction(_part(e, "num"), _part(e, "den"), _setting(e, "type") == "lin"),
    "sSup": lambda e: _scripts(_base(_part(e, "e")), None, _part(e, "sup") or " "), "sSub": lambda e: _scripts(_base(_part(e, "e")), _part(e, "sub") or " "), "sSubSup": lambda e: _scripts(_base(_part(e, "e")), _part(e, "sub") or " ", _part(e, "sup") or " "),
    "sPre": lambda e: _scripts("{}", _part(e, "sub") or " ", _part(e, "sup") or " ") + _part(e, "e"),
    "rad": lambda e: _root(_part(e, "e"), "" if _setting(e, "degHide") in _OFF else _part(e, "deg")), "nary": _large, "d": _delimited,
    "func": lambda e: f"{_function(' '.join(_part(e, 'fName').split()))} {_part(e, 'e')}", "limLow": _limit, "limUpp": lambda e: _scripts(_base(_part(e, "e")), None, _part(e, "lim")),
    "acc": lambda e: ACCENTS.get(_setting(e, "chr") or "^", r"\hat") + _braced(_part(e, "e")), "bar": lambda e: rf"\overline{_braced(_part(e, 'e'))}",
    "m": lambda e: _grid(_office_grid(e), "matrix"), "eqArr": lambda e: _grid([[_all(list(x))] for x in _of(e, "e")], "aligned"),
}


# mathematics in markup: parts by place


def _text(e: Element) -> str:
    return "".join(e.itertext())


def _token(e: Element) -> str:
    t = _text(e).strip()
    return f" {COMMANDS[t]} " if t in COMMANDS else f"{_function(t)} " if t in FUNCTIONS else _literal(t)


def _table(e: Element, brackets: str = "") -> str:
    rows = [[_all(list(cell)).strip() for cell in row if local(cell) == "mtd"] for row in e if local(row) == "mtr"]
    return _grid(rows, MATRICES.get(brackets, "cases" if brackets == "{" else "matrix"))


def _row(e: Element) -> str:
    """Parts in a row; brackets around a single table are the table's."""
    parts = [x for x in e if local(x) not in ("mspace",)]
    if 2 <= len(parts) <= 3 and local(parts[0]) == "mo" and local(parts[1]) == "mtable":
        around = _text(parts[0]).strip() + (_text(parts[2]).strip() if len(parts) == 3 else "")
        if around in MATRICES or around == "{":
            return _table(parts[1], around)
    return _all(list(e))


def _over(e: Element) -> str:
    base, mark = _line(e[0]).strip(), _text(e[1]).strip()
    return ACCENTS[mark] + _braced(base) if mark in ACCENTS else _scripts(_base(base), None, _line(e[1]))


def _fence(e: Element) -> str:
    opening, closing, mark = e.get("open", "("), e.get("close", ")"), (e.get("separators", ",") or ",")[0]
    if len(e) == 1 and local(e[0]) == "mtable" and (opening + closing in MATRICES or opening + closing == "{"):
        return _table(e[0], opening + closing)
    return _fenced(opening, [_line(x) for x in e], closing, mark)


#: Rules, and the number of parts that each needs; with fewer, an element is a row.
MARKUP: dict[str, tuple[int, Callable[[Element], str]]] = {
    **{tag: (0, _token) for tag in ("mi", "mn", "mo", "ms")}, **{tag: (0, lambda e: "") for tag in ("annotation", "annotation-xml", "mphantom", "none")}, **{tag: (0, _row) for tag in ("mrow", "math", "mstyle", "mpadded", "menclose", "merror", "mtd", "maction")},
    "semantics": (1, lambda e: _line(e[0])), "mtext": (0, lambda e: rf"\text{{{_literal(t)}}}" if (t := _text(e).strip()) else " "), "mspace": (0, lambda e: " "),
    "mfrac": (2, lambda e: _fraction(_line(e[0]), _line(e[1]), e.get("bevelled") == "true")), "msup": (2, lambda e: _scripts(_base(_line(e[0])), None, _line(e[1]) or " ")), "msub": (2, lambda e: _scripts(_base(_line(e[0])), _line(e[1]) or " ")), "msubsup": (3, lambda e: _scripts(_base(_line(e[0])), _line(e[1]) or " ", _line(e[2]) or " ")),
    "msqrt": (0, lambda e: _root(_row(e))), "mroot": (2, lambda e: _root(_line(e[0]), _line(e[1]))), "munder": (2, lambda e: _scripts(_base(_line(e[0])), _line(e[1]))), "mover": (2, _over), "munderover": (3, lambda e: _scripts(_base(_line(e[0])), _line(e[1]), _line(e[2]))),
    "mfenced": (0, _fence), "mtable": (0, _table),
}


def _line(e: Element) -> str:
    name = local(e)
    if name in OFFICE:
        return OFFICE[name](e)
    if name.endswith("Pr"):
        return ""
    least, rule = MARKUP.get(name.lower(), (0, None))
    if rule is not None and len(e) >= least:
        return rule(e)
    return _all(list(e)) or _literal((e.text or "").strip())
