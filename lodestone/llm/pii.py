"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. Matches are marked with two control characters by ``regexp_replace``; splitting at the marks
gives gaps and matches in turn, whose running lengths are the offsets (code points, end exclusive). The control
characters are first replaced in the text by a third that no pattern contains, so offsets stay true.

Kinds: email, ip (parts at most 255), card (12 to 19 digits passing Luhn), phone (9 to 15 digits), iban (mod 97 is 1,
15 to 34 characters). Each kind is matched leftmost and non-overlapping by itself; failing matches are dropped. Possessive
quantifiers and the anchors in front keep matching linear on very long texts and change no match. A span's score is
its kind's weight, plus 0.1 if one of the kind's context words stands in the 40 characters before it.

A null or empty text has no spans. Ties, repeated rows, null ids and extra columns are allowed; empty tables stay empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
REACH = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # cheap test that any text with a match passes
    weight: float
    context: str


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        0.9,
        r"(?i)\b(?:e-?mail|contact|write)\b",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\.[0-9]", 0.6, r"(?i)\b(?:ip|host|server|address)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", 0.8, r"(?i)\b(?:card|visa|credit|payment)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", 0.7, r"(?i)\b(?:phone|tel|call|mobile|fax)\b"),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "[A-Z]{2}[0-9]{2}",
        0.9,
        r"(?i)\b(?:iban|account|bank|transfer)\b",
    ),
)
BASE = ("email", "ip", "card", "phone")


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int")).otherwise(
            F.substring(back, i, F.lit(1)).cast("int") * 2
            - F.when(F.substring(back, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))
    return (
        F.aggregate(
            F.sequence(F.lit(1), F.length(code)),
            F.lit(0),
            lambda acc, i: F.when(
                F.substring(turned, i, F.lit(1)).between("0", "9"),
                (acc * 10 + F.ascii(F.substring(turned, i, F.lit(1))) - 48) % 97,
            ).otherwise((acc * 100 + F.ascii(F.substring(turned, i, F.lit(1))) - 55) % 97),
        )
        == 1
    )


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(match, "\\."),
            lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255),
        )
    if kind == "card":
        return F.length(digits_of(match)).between(12, 19) & luhn(digits_of(match))
    if kind == "phone":
        return F.length(digits_of(match)).between(9, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(code).between(15, 34) & mod97(code)
    return F.lit(True)


def confirmed(kind: str):
    return lambda m: valid(kind, m["match"])


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def matches(parts: Column) -> Column:
    """array<struct<at, match>> of the odd parts, ``at`` being the code points before them."""
    return F.aggregate(
        parts,
        F.struct(
            F.lit(0).alias("pos"), F.lit(False).alias("inside"), F.lit(None).cast("array<struct<at:int,match:string>>").alias("out")
        ),
        lambda acc, p: F.struct(
            (acc["pos"] + F.length(p)).alias("pos"),
            (~acc["inside"]).alias("inside"),
            F.when(
                acc["inside"],
                F.concat(F.coalesce(acc["out"], F.array().cast("array<struct<at:int,match:string>>")),
                         F.array(F.struct(acc["pos"].alias("at"), p.alias("match")))),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: array<struct<start, kind_no, kind, end, score>> by start, then kind."""
    text, names = "__pii_text", {k.name: f"__pii_{k.name}" for k in KINDS}
    got = docs.withColumn(text, F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), OPEN + CLOSE, OTHER * 2))
    marked = {
        names[k.name]: F.when(
            F.contains(text, F.lit("@")) if k.needs == "@" else F.col(text).rlike(k.needs),
            F.split(F.regexp_replace(text, f"{k.pattern}", f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]"),
        )
        for k in KINDS
    }
    got = got.withColumns(marked)
    got = got.withColumns(
        {
            names[k.name]: F.when(
                F.size(names[k.name]) > 1,
                F.filter(matches(F.col(names[k.name])), confirmed(k.name)),
            )
            for k in KINDS
        }
    )

    def span(no: int, k: Kind):
        return lambda m: span_of(no, k, m)

    def span_of(no: int, k: Kind, m: Column) -> Column:
        before = F.substring(F.col(text), F.greatest(F.lit(1), m["at"] + 1 - REACH), F.least(m["at"], F.lit(REACH)))
        return F.struct(
            m["at"].alias("start"),
            F.lit(no).alias("kind_no"),
            F.lit(k.name).alias("kind"),
            (m["at"] + F.length(m["match"])).alias("end"),
            F.round(F.lit(k.weight) + F.when(before.rlike(k.context), 0.1).otherwise(0.0), 2).alias("score"),
        )

    kind_type = "array<struct<start:int,kind_no:int,kind:string,end:int,score:double>>"
    every = [
        F.coalesce(
            F.transform(F.col(names[k.name]), span(no, k)).cast(kind_type), F.array().cast(kind_type)
        )
        for no, k in enumerate(KINDS)
    ]
    found = F.when(F.coalesce(*names.values()).isNotNull(), F.array_sort(F.concat(*every))).otherwise(F.array().cast(kind_type))
    return got.withColumn(out, found).drop(text, *names.values())


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> for the base kinds, base_sha256, spans (text) and scores (text, in the spans' order)."""
    found = with_spans(docs.select("doc_id", "text"), "text", "__spans")
    return found.select(
        "doc_id",
        *[
            F.size(F.filter("__spans", of_kind(k))).cast("long").alias(f"n_{k}")
            for k in BASE
        ],
        F.sha2(joined(F.filter("__spans", lambda s: s["kind_no"] < len(BASE))), 256).alias("base_sha256"),
        joined(F.col("__spans")).alias("spans"),
        F.array_join(F.transform("__spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are hidden together."""
    pieces = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["pos"], s["end"]).alias("pos"),
            F.when(
                s["start"] >= acc["pos"],
                F.concat(
                    acc["out"],
                    F.array(F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.array(F.substring(text, acc["pos"] + 1, F.length(text)))),
    )
    return F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(text)


def stage(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """``docs`` with the spans of score ``least`` or more masked in text (n_chars follows, where it is a column)."""
    found = with_spans(docs, "text", "__spans").withColumn("__spans", F.filter("__spans", lambda s: s["score"] >= least))
    text = found.withColumn("text", masked(F.col("text"), F.col("__spans")))
    if "n_chars" in docs.columns:
        text = text.withColumn(
            "n_chars",
            F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")),
        )
    return text.select(*docs.columns)
