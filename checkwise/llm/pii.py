"""Personal data: regular expressions propose, checksums confirm, context adjusts. [native]

Everything is a Column expression: Java regular expressions find candidates,
Luhn and mod-97 run as ``aggregate`` folds, context is a look at the characters
before a span. Positions (code points) come from the lengths of the pieces
between matches, as ``split`` and ``regexp_extract_all`` walk the same matches.

Defined cases: a null text is empty (no spans); null ids, repeated rows and
extra columns pass through; matches are leftmost and do not overlap within a
kind; spans of different kinds may overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Possessive quantifiers keep matching linear; a look-behind skips starts inside
# a run whose first start has already failed (\G: right after the last match).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # a whole run of digits with single separators; runs of other lengths fail the check anyway
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = [*BASE, *ADDED]

#: Words that raise the score of a span of the kind when they stand just before it.
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|master|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|anruf",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
}
#: Score of a span by its form alone, and after its checksum.
START_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
CONTEXT_SCORE = 0.4
CONTEXT_CHARS = 40
MIN_SCORE = 0.7


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn checksum of a string of digits."""
    cells = F.reverse(F.split(digits, ""))
    doubled = F.transform(cells, lambda c, i: F.when(i % 2 == 0, c.cast("int"))
                          .otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """The IBAN check: letters as two digits, first four characters last, remainder 1."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(values, F.lit(0), lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97))
    return F.length(plain).between(15, 34) & (rest == 1)


_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,match:string>>"
#: Matches summed up in one go; arrays grow by copying, so long lists are built from blocks.
_BLOCK = 128


def _placed(kind: str, matches: Column, gaps: Column) -> Column:
    """Matches with their code-point spans: running sums over gaps and matches, by block."""
    def step(acc, x):
        s = acc["p"] + F.length(x["g"])
        e = s + F.length(x["m"])
        one = F.array(F.struct(F.lit(kind).alias("kind"), s.alias("start"), e.alias("end"), x["m"].alias("match")))
        return F.struct(e.alias("p"), F.concat(acc["o"], one).alias("o"))

    none = F.struct(F.lit(0).alias("p"), F.array().cast(_SPAN).alias("o"))
    pairs = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)),
                       lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _BLOCK).cast("int")),
                         lambda b: F.aggregate(F.slice(pairs, b * _BLOCK + 1, _BLOCK), none, step))
    offsets = F.aggregate(blocks, F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("o")),
                          lambda acc, x: F.struct((acc["p"] + x["p"]).alias("p"),
                                                  F.concat(acc["o"], F.array(acc["p"])).alias("o")),
                          lambda acc: acc["o"])
    return F.flatten(F.zip_with(blocks, offsets, lambda x, f: F.transform(x["o"], lambda s: F.struct(
        s["kind"].alias("kind"), (s["start"] + f).alias("start"), (s["end"] + f).alias("end"),
        s["match"].alias("match")))))


def _scored(kind: str, text: Column, span: Column) -> Column:
    lead = F.substring(text, F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0)) + 1,
                       F.least(span["start"], F.lit(CONTEXT_CHARS)))
    near = F.lower(lead).rlike(rf"\b(?:{CONTEXT[kind]})")
    score = F.lit(START_SCORE[kind]) + F.when(near, CONTEXT_SCORE).otherwise(0.0)
    return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
                    F.least(score, F.lit(1.0)).alias("score"))


def _valid(kind: str, matches: Column, gaps: Column) -> Column:
    """Placed matches whose check holds; null where there is no match at all."""
    return F.when(F.size(matches) > 0,
                  F.filter(_placed(kind, matches, gaps), lambda s: _confirmed(kind, s["match"])))


def _judged(kind: str, text: Column, spans: Column) -> Column:
    scored = F.transform(spans, lambda s: _scored(kind, text, s))
    if kind in ADDED:
        scored = F.filter(scored, lambda s: s["score"] >= MIN_SCORE)
    return F.coalesce(scored, F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def find(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: array of (kind, start, end, score), by kind as in KINDS, then start.

    Base kinds are kept once their check holds, whatever their score; added
    kinds also need a score of MIN_SCORE.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # temporary names that no column of the input can have
    tmp = lambda stage, k: f"__{out}_{stage}_{k}"
    df = docs.withColumns({tmp("m", k): F.regexp_extract_all(text, F.lit(r), F.lit(0))
                           for k, r in {**BASE, **ADDED}.items()})
    df = df.withColumns({tmp("p", k): _valid(k, F.col(tmp("m", k)), F.split(text, r, -1))
                         for k, r in {**BASE, **ADDED}.items()})
    return df.withColumn(out, F.concat(*[_judged(k, text, F.col(tmp("p", k))) for k in KINDS])).drop(*[tmp(s, k) for s in "mp" for k in KINDS])


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one mark.

    A null text stays null.
    """
    spans = "__redact_spans"
    df = find(docs, text_col, spans)
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("p"), F.array().cast("array<string>").alias("o"))

    def step(acc, s):
        fresh = s["start"] >= acc["p"]
        add = F.array(F.substring(text, acc["p"] + 1, s["start"] - acc["p"]),
                      F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.struct(F.greatest(acc["p"], s["end"]).alias("p"),
                        F.when(fresh, F.concat(acc["o"], add)).otherwise(acc["o"]).alias("o"))

    ordered = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    clean = F.aggregate(ordered, start, step, lambda acc: F.concat(
        F.array_join(acc["o"], ""), F.substr(text, acc["p"] + 1)))
    return df.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).drop(spans)
