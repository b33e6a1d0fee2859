"""Personal data: fixed patterns, and spans that weakly supervised labelers agree on, all as DataFrame expressions.

Candidates of other forms (grouped digits, accounts, spelt-out mail addresses, streets, names) get votes from labelers:
the shape of the span, a gazetteer, the words before and after, check digits. Each may say yes or no or abstain. The
candidates of a kind are counted by votes and features; expectation-maximisation over these counts estimates what each
labeler's votes are worth. The span classifier is a logistic model over votes and features, trained on the resulting
posteriors, and emitted as one expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import cut

#: Fixed values of the contract, made possessive where nothing could be given back, so that long runs take linear time.
#: A run is entered at its start or where the last match ended, which is where the leftmost match begins. A run of
#: digits with fewer than 16 is never a card, so the pattern asks for them.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to be tried at all.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

#: Candidates of the method by kind, earlier kinds first where they overlap, and what a text must hold for the kind to be looked for.
MORE = {
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "id": (r"(?<![0-9A-Za-z.-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}[- ][0-9]{2}[- ][0-9]"),
    "call": (r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[- ./])[0-9]{2,4}[- ./][0-9]{2,5}(?:[- ./][0-9]{2,4})?(?![0-9A-Za-z-])", r"[0-9][)\x20./-]+[0-9]{2,4}[- ./][0-9]"),
    "spelt": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,40}\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{2,40}(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]{2,20}){1,3}", r"[(\[{]at[)\]}]"),
    "street": (r"(?<![0-9\p{L}.-])(?:[0-9]{1,5}[a-z]?(?:\x20\p{Lu}\p{Ll}+){1,3}\x20(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd|Court|Square|Way)|\p{Lu}\p{Ll}+(?:straße|strasse|weg|platz|allee|gasse)\x20[0-9]{1,4}[a-z]?|[0-9]{1,4}\x20(?:rue|avenue|boulevard|place)\x20(?:de\x20(?:la\x20)?|du\x20|des\x20)?\p{Lu}\p{L}+|(?:Calle|Avenida|Plaza)\x20(?:de\x20(?:la\x20)?)?\p{Lu}\p{Ll}+,?\x20[0-9]{1,4})(?![0-9\p{L}])", r"[0-9]"),
    "name": (r"(?<![\p{L}\p{N}'-])\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?(?:\x20\p{Lu}\.)?(?:\x20(?:van|von|de|da|del|la)){0,2}\x20\p{Lu}\p{Ll}+(?:[-']\p{Lu}\p{Ll}+)?(?![\p{L}\p{N}])", r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?(?:\x20\p{Lu}\.)?(?:\x20(?:van|von|de|da|del|la))*\x20\p{Lu}\p{Ll}"),
}
#: The gazetteers; callers may pass others. Given names, mail hosts and their endings, countries whose accounts have an IBAN, towns that follow a street, area codes.
GIVEN = (
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret "
    "Paul Sandra Steven Ashley Andrew Emily Kenneth Donna George Michelle Joshua Carol Kevin Amanda Brian Laura Edward Rebecca Peter Anna Hans Klaus Jürgen Wolfgang Stefan Andreas Ursula Monika Petra Sabine "
    "Jean Pierre Michel André Philippe Alain Marie Nathalie Isabelle Sylvie Catherine Françoise José Antonio Manuel Francisco Juan Carlos Luis Miguel Carmen Ana Isabel Dolores Pilar Giovanni Maria Luigi Ali "
    "Mohammed Ahmed Fatima Wei Li Yuki Hiroshi Ivan Olga Sergei Anders Lars Ingrid Sven Jan Piotr Katarzyna Alice Bob Emma Noah Olivia Liam Sophie Lucas Julia Max Felix Clara Hugo Lena Paula Diego Lucía Marta"
)
HOSTS = r"(?i)(?:gmail|googlemail|outlook|hotmail|yahoo|icloud|proton|gmx|web\.?de|mail|inbox|post|example)|(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|nl|eu)$"
COUNTRIES = "AD AE AL AT BE BG CH CY CZ DE DK EE ES FI FR GB GI GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO RS SA SE SI SK SM TN TR"
TOWNS = r"(?i)^,?\x20?(?:[0-9]{4,5}\x20)?(?:Apt|Suite|Floor|London|Paris|Berlin|Madrid|Rome|Vienna|Wien|München|Munich|Hamburg|Köln|Lyon|Marseille|Barcelona|Sevilla|Boston|Chicago|New\x20York|Springfield|[0-9]{5}\b)"
#: Labelers: for each kind, patterns for yes and for no (None: never said); what neither matches is abstained from. A
#: shape and a gazetteer read the span, the contexts the characters before and after it. CHECKED kinds have one more.
SHAPES = {
    "id": (r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^(?:000|666|9)|^.{4}00|0000$"),
    "call": (r"^(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}$", r"^(?:[12][0-9]{3}|[0-3]?[0-9])[-./][01]?[0-9][-./][0-9]{2,4}$"),
    "iban": (r"^[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){3,7}(?:\x20[A-Z0-9]{1,3})?$", r"\x20.*[A-Z0-9]{5}"),
    "spelt": (r"^[A-Za-z][A-Za-z0-9._-]+.*(?:\.|dot[)\]}]\x20?)[A-Za-z]{2,6}$", r"^[0-9]+\x20?[(\[{]"),
    "street": (r"^[0-9]{1,5}\x20|\x20[0-9]{1,4}[a-z]?$", None),
    "name": (r"\x20\p{Lu}\.\x20", r"^(?:The|This|That|These|In|On|At|It|We|He|She|They|New|North|South|East|West|United|Der|Die|Das|Ein|Le|La|Les|El|Los|Un|Une)\x20"),
}
CONTEXT = {
    "id": (r"(?i)(?:ssn|social security|insurance|identity|\bid\b|\bno\b|number)[^\n]{0,12}$", r"(?i)(?:version|isbn|issn|part|order|fig|page|§)[^\n]{0,8}$"),
    "call": (r"(?i)(?:phone|tel|call|mobile|cell|fax|telefon|tél|handy|ruf|reach|móvil|whatsapp)[^\n]{0,12}$", r"(?i)(?:version|isbn|issn|date|on|from|until|page|fig|§|v)[.:]?\x20?$"),
    "iban": (r"(?i)(?:iban|account|acct|konto|compte|cuenta|bank|transfer)[^\n]{0,12}$", r"(?i)(?:serial|model|part|sku|key)[^\n]{0,8}$"),
    "spelt": (r"(?i)(?:mail|contact|write|reach|send|kontakt|correo|courriel|address)[^\n]{0,12}$", None),
    "street": (r"(?i)(?:address|live[sd]?|resid|home|located|adresse|wohn|habite|domicil|dirección|at|in)[^\n]{0,12}$", r"(?i)(?:page|figure|table|chapter|version)\x20$"),
    "name": (r"(?:\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\b\.?|(?i:\b(?:name|contact|signed|sincerely|regards|author|nombre|nom|patient|customer|employee|dear)\b)[:,]?)\x20?$", r"(?:^|[.!?:]\x20|\n)$"),
}
AFTER = {
    "id": (None, r"^[-./]?[0-9]"),
    "call": (r"(?i)^\x20?(?:ext|x[0-9]|\(?(?:home|work|mobile|office|cell))", r"^[-./]?[0-9]|^\x20?(?:%|kg|km|cm|mm|EUR|USD|€|\$)"),
    "iban": (r"(?i)^[,;\x20]{0,3}(?:bic|swift)", None),
    "spelt": (None, None),
    "street": (TOWNS, None),
    "name": (r"(?i)^(?:,\x20?(?:born|née|geb|aged?|[0-9]{2}\b)|\x20?(?:<|\(?born))", r"^\x20(?:Inc|Ltd|GmbH|Corp|University|Street|Company)"),
}
CHECKED = ("iban",)
CONTEXT_CHARS, ROUNDS, PRIOR, THRESHOLD = 40, 50, 0.3, 0.9
#: What a labeler that is no better or worse than expected says of true and of false spans (abstains, yes, no), and the pseudo-votes for it.
EXPECTED, WEIGHT = ((0.35, 0.6, 0.05), (0.55, 0.05, 0.4)), 2.0
LABELERS = ("shape", "gazetteer", "before", "after", "check")
#: Features of the span besides the votes: length, share of digits, separators, whether it begins a line; each with so many values.
FEATURES = {"length": 4, "digits": 3, "separators": 3, "line_start": 2}
WIDTH = 3 * len(LABELERS) + sum(FEATURES.values())
#: The classifier's training: steps, and the pull of weights to zero.
STEPS, PULL = 30, 1.0
EXTRA = "learnt"


_SPAN = "array<struct<start:int,end:int,s:string>>"
#: Matches of a text that are placed together; places are running sums, first within and then over such chunks.
CHUNK = 256


def _parts(text: Column, pattern: str, hint: Column) -> Column:
    """array<struct<gap, s>> of the matches of a pattern, each with what lies before it; null where the hint doesn't hold."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(hint, F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("s")))


def _pieces(text: Column, pattern: str, hint: Column) -> Column:
    """array<struct<gap, s>> as of _parts, and a last piece with what lies behind the last match."""
    return F.when(hint, F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("s")))


#: Pieces that may lie within CONTEXT_CHARS of a match: matches have five characters at least.
_NEAR = CONTEXT_CHARS // 5


def _ends(pieces: str) -> Column:
    """Of a column of _pieces, the characters at either end of each gap that may be context, and the matches."""
    return F.transform(pieces, lambda x: F.struct(F.left(x["gap"], F.lit(CONTEXT_CHARS)).alias("l"), F.right(x["gap"], F.lit(CONTEXT_CHARS)).alias("r"), F.coalesce(x["s"], F.lit("")).alias("s")))


def _around(ends: str) -> Column:
    """array<struct<before, after>>: the CONTEXT_CHARS characters before and after each match, made of the ends of the gaps nearby, so that no text is walked again for each match."""
    joined = lambda some, one: F.array_join(F.transform(some, one), "")

    def each(x: Column, i: Column) -> Column:
        before = F.concat(joined(F.slice(ends, F.greatest(i - _NEAR, F.lit(0)) + 1, F.least(i, F.lit(_NEAR))), lambda y: F.concat(y["r"], y["s"])), x["r"])
        after = joined(F.slice(ends, i + 2, F.lit(_NEAR)), lambda y: F.concat(y["l"], y["s"]))
        return F.struct(F.right(before, F.lit(CONTEXT_CHARS)).alias("before"), F.left(after, F.lit(CONTEXT_CHARS)).alias("after"))

    return F.transform(ends, each)


def _spans(parts: str) -> Column:
    """array<struct<start, end, s>> of a column of _parts, in code points."""

    def add(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["s"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["s"].alias("s")))).alias("out"))

    def chunk(c: Column) -> Column:
        return F.aggregate(F.slice(parts, c * CHUNK + 1, CHUNK), F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), add)

    def shifted(out: Column, by: Column) -> Column:
        return F.transform(out, lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["s"].alias("s")))

    def join(a: Column, c: Column) -> Column:
        return F.struct((a["at"] + c["at"]).alias("at"), F.concat(a["out"], F.array(shifted(c["out"], a["at"]))).alias("out"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), chunk)
    placed = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), join, lambda a: F.flatten(a["out"]))
    return F.when(F.size(parts) > 0, placed).otherwise(F.array().cast(_SPAN))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def _luhn(s: Column) -> Column:
    """Whether the digits pass: from the right, every second one doubled, digits summed, divisible by 10."""
    digits = F.split(F.reverse(_digits(s)), "")
    value = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(s)).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _valid_spans(kind: str) -> Column:
    return F.filter(kind, lambda x: _valid(kind, x["s"]))


def _hint(kind: str, text: Column) -> Column:
    if kind == "card":
        return text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")
    return text.contains(HINTS[kind]) if kind != "ip" else text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, and for each kind an array of spans start, end, s) of docs; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    d = d.select("doc_id", "text", *(_parts(F.col("text"), PATTERNS[k], _hint(k, F.col("text"))).alias(k) for k in KINDS))
    d = d.select("doc_id", "text", *(_spans(k).alias(k) for k in KINDS))
    return d.select("doc_id", "text", *(_valid_spans(k).alias(k) for k in KINDS))


def gazetteers(given: str = GIVEN, hosts: str = HOSTS, countries: str = COUNTRIES) -> dict[str, tuple[str | None, str | None]]:
    """Patterns for yes and no of the gazetteer labeler by kind."""
    return {
        "id": (None, r"^(?:123[- ]45[- ]6789|078[- ]05[- ]1120|219[- ]09[- ]9999)$"),  # numbers printed as examples
        "call": (r"^\(?(?:0[1-9]|[2-9][0-9]{2})", r"^\(?[01]{2,3}[^0-9]|555[-.]01[0-9]{2}$"),
        "iban": (rf"^(?:{'|'.join(countries.split())})", rf"^(?!{'|'.join(countries.split())})"),
        "spelt": (hosts, None),
        "street": (r"(?i)(?:Main|High|Church|Park|Oak|Maple|Station|Victoria|Market|Haupt|Bahnhof|Schul|Garten|Kirch|Liberté|République|Mayor)", None),
        "name": (rf"^(?:{'|'.join(given.split())})(?![\p{{L}}])", None),
    }


def _iban_check(s: Column) -> Column:
    """Whether an IBAN's digits leave 1 modulo 97: letters count as two digits, the first four characters come last."""
    solid = F.regexp_replace(s, r"\x20", "")
    moved = F.concat(F.substring(solid, 5, 40), F.substring(solid, 1, 4))
    digit = lambda c: F.conv(c, 36, 10).cast("int")
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.pmod(F.when(digit(c) > 9, a * 100).otherwise(a * 10) + digit(c), F.lit(97)))
    return rest == 1


def _vote(text: Column, patterns: tuple[str | None, str | None]) -> Column:
    """1 (yes), 2 (no) or 0 (abstains)."""
    yes, no = (F.lit(False) if p is None else text.rlike(p) for p in patterns)
    return F.when(no, 2).when(yes, 1).otherwise(0)


def candidates(docs: DataFrame, gazetteer: dict[str, tuple[str | None, str | None]] | None = None) -> DataFrame:
    """docs of base_spans with `more`: the candidates (order, kind, start, end, codes) of the method, codes the places of its votes and features among a kind's weights."""
    gazetteer = gazetteer or gazetteers()
    d = docs.select("*", *(_pieces(F.col("text"), p, F.col("text").rlike(hint)).alias(f"p_{k}") for k, (p, hint) in MORE.items()))
    d = d.select("*", *(F.slice(f"p_{k}", 1, F.greatest(F.size(f"p_{k}") - 1, F.lit(0))).alias(f"m_{k}") for k in MORE), *(_ends(f"p_{k}").alias(f"e_{k}") for k in MORE)).drop(*(f"p_{k}" for k in MORE))
    d = d.select(*docs.columns, *(_spans(f"m_{k}").alias(f"m_{k}") for k in MORE), *(_around(f"e_{k}").alias(f"e_{k}") for k in MORE))
    return d.withColumn("more", F.concat(*(_coded(i, k, gazetteer[k]) for i, k in enumerate(MORE, 1)))).drop(*(f"{c}_{k}" for k in MORE for c in "me"))


def _places(spans: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def _coded(order: int, kind: str, gazetteer: tuple[str | None, str | None]) -> Column:
    """The candidates of a kind with their votes and features."""

    def coded(x: Column, i: Column) -> Column:
        s, around = x["s"], F.get(f"e_{kind}", i)
        before, after = around["before"], around["after"]
        check = F.when(_iban_check(s), 1).otherwise(2) if kind in CHECKED else F.lit(0)
        votes = [_vote(s, SHAPES[kind]), _vote(s, gazetteer), _vote(before, CONTEXT[kind]), _vote(after, AFTER[kind]), check]
        size, digits = F.length(s), F.length(_digits(s))
        features = {
            "length": F.when(size <= 11, 0).when(size <= 14, 1).when(size <= 20, 2).otherwise(3),
            "digits": F.when(digits * 10 <= size, 0).when(digits * 10 <= 7 * size, 1).otherwise(2),
            "separators": F.least(F.length(F.regexp_replace(s, r"[\p{L}\p{N}]+", "")) - 1, F.lit(2)),
            "line_start": before.rlike(r"(?:^|\n)$").cast("int"),
        }
        at, codes = 3 * len(LABELERS), [v + 3 * i for i, v in enumerate(votes)]
        for name, n in FEATURES.items():
            codes.append(F.greatest(features[name], F.lit(0)) + at)
            at += n
        return F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.array(*codes).alias("codes"))

    return F.transform(f"m_{kind}", coded)


def apart(found: DataFrame) -> DataFrame:
    """(row, order, kind, start, end, codes): the candidates that overlap no base span and no candidate of an earlier kind. found: (row, KINDS, more).

    Spans stand in order of their starts; what overlaps from the left is known by the furthest end so far, from the
    right by the nearest start to come, for each kind: a running value each from one end, however many spans a text has.
    """
    base = F.transform(F.concat(*map(_places, KINDS)), lambda x: F.struct(F.lit(0).alias("order"), F.lit("").alias("kind"), x["start"], x["end"], F.array().cast("array<int>").alias("codes")))
    spans = found.where(F.size("more") > 0).select("row", F.explode(F.concat(base, F.col("more"))).alias("x")).select("row", "x.*")
    at = W.partitionBy("row").orderBy("start", "end", "order")
    left = at.rowsBetween(W.unboundedPreceding, -1)
    right = W.partitionBy("row").orderBy(F.col("start").desc(), F.col("end").desc(), F.col("order").desc()).rowsBetween(W.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("order") == i, F.col("end"))).over(left).alias(f"last{i}") for i in range(len(MORE))]
    soon = [F.min(F.when(F.col("order") == i, F.col("start"))).over(right).alias(f"soon{i}") for i in range(len(MORE))]
    met = reduce(lambda a, b: a | b, ((F.col("order") > i) & (F.coalesce(F.col(f"last{i}") > F.col("start"), F.lit(False)) | F.coalesce(F.col(f"soon{i}") < F.col("end"), F.lit(False))) for i in range(len(MORE))))
    return spans.select("*", *last, *soon).where((F.col("order") > 0) & ~met).select(*spans.columns)


@dataclass(frozen=True)
class Labelers:
    """Of one kind: how often each labeler abstains, says yes and says no on true and on false spans, and the share of true spans."""

    true: tuple[tuple[float, ...], ...]
    false: tuple[tuple[float, ...], ...]
    prior: float

    def posterior(self, votes: tuple[int, ...]) -> float:
        z = math.log((1 - self.prior) / self.prior) + sum(math.log(self.false[i][v] / self.true[i][v]) for i, v in enumerate(votes))
        return 1 / (1 + math.exp(min(z, 700.0)))


def reliabilities(counts: dict[tuple[int, ...], int]) -> Labelers:
    """Expectation-maximisation over the counts of vote patterns, started from EXPECTED, which weighs as much as WEIGHT votes; a labeler of which the data say more is what they say."""
    n = len(next(iter(counts)))
    model = Labelers((EXPECTED[0],) * n, (EXPECTED[1],) * n, PRIOR)
    for _ in range(ROUNDS):
        p = {v: model.posterior(v) for v in counts}

        def rates(weight: dict[tuple[int, ...], float], expected: tuple[float, ...]) -> tuple[tuple[float, ...], ...]:
            total = sum(weight.values())
            return tuple(tuple((sum(w for v, w in weight.items() if v[i] == x) + WEIGHT * expected[x]) / (total + WEIGHT) for x in range(3)) for i in range(n))

        true, false = {v: k * p[v] for v, k in counts.items()}, {v: k * (1 - p[v]) for v, k in counts.items()}
        share = (sum(true.values()) + WEIGHT * PRIOR) / (sum(counts.values()) + WEIGHT)
        model = Labelers(rates(true, EXPECTED[0]), rates(false, EXPECTED[1]), min(0.95, max(0.05, share)))
    return model


def logistic(rows: list[tuple[tuple[int, ...], float, float]]) -> np.ndarray:
    """Weights, the constant last, of a logistic model of soft labels: rows of (codes, label, times). Newton's steps with PULL to zero."""
    x = np.zeros((len(rows), WIDTH + 1))
    for i, (codes, _, _) in enumerate(rows):
        x[i, list(codes)] = 1
    x[:, WIDTH] = 1
    y, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=float)
    w = np.zeros(WIDTH + 1)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + PULL * np.eye(WIDTH + 1), x.T @ (n * (y - p)) - PULL * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


Classifier = dict[str, list[float]]


def train(counted: list[tuple[str, tuple[int, ...], int]]) -> Classifier:
    """The weights of each kind from its candidates' (kind, codes, times): a logistic model of votes and features, trained on the posteriors of the labelers."""
    by: dict[str, dict[tuple[int, ...], int]] = {}
    for kind, codes, n in counted:
        by.setdefault(kind, {})[tuple(codes)] = n
    out = {}
    for kind, counts in sorted(by.items()):
        votes: dict[tuple[int, ...], int] = {}
        read = lambda codes: tuple(c - 3 * i for i, c in enumerate(codes[: len(LABELERS)]))
        for codes, n in counts.items():
            votes[read(codes)] = votes.get(read(codes), 0) + n
        model = reliabilities(votes)
        out[kind] = [float(x) for x in logistic([(codes, model.posterior(read(codes)), n) for codes, n in sorted(counts.items())])]
    return out


def fit(found: DataFrame) -> Classifier:
    """The classifier from all candidates (kind, codes) of a table. Only counts of codes are gathered, of which there are as many as kinds, votes and features allow, whatever the table's size."""
    each = found.groupBy("kind", "codes").count()
    return train([(r["kind"], tuple(r["codes"]), r["count"]) for r in each.collect()])


def accepts(model: Classifier) -> Column:
    """Whether a candidate (kind, codes) has THRESHOLD probability or more, as one expression."""
    least, out = math.log(THRESHOLD / (1 - THRESHOLD)), F.lit(False)

    def odds(weights: list[float]) -> Column:
        each = F.array(*map(F.lit, weights[:WIDTH]))
        return F.aggregate("codes", F.lit(weights[WIDTH]), lambda a, c: a + F.get(each, c))

    for kind, weights in sorted(model.items()):
        out = F.when(F.col("kind") == kind, odds(weights) >= least).otherwise(out)
    return out


def find(docs: DataFrame, gazetteer: dict[str, tuple[str | None, str | None]] | None = None) -> DataFrame:
    """One row per row of docs: (doc_id, email, ip, card, phone, learnt), arrays of spans (start, end) in code points, ends exclusive.

    Null and empty texts have none; an empty table gives no rows; repeated rows are scanned alike. The spans of a kind
    don't overlap; those of different base kinds may; learnt spans overlap no base span. Texts are scanned once: their
    spans alone are written, and rows with candidates, few next to the texts, are the only ones that are dealt anew.
    """
    found = candidates(base_spans(docs), gazetteer).select(F.monotonically_increasing_id().alias("row"), "doc_id", *(_places(k).alias(k) for k in KINDS), "more")
    found = cut(found, "pii")
    single = cut(apart(found), "pii-apart")
    kept = single.where(accepts(fit(single))).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(EXTRA))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return found.join(kept, "row", "left").select("doc_id", *KINDS, F.coalesce(EXTRA, none).alias(EXTRA))
