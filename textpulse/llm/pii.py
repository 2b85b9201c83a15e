r"""Personal data in texts, with DataFrame functions only.

A kind has a regular expression that proposes spans from left to right without overlap, a validator that confirms them
(Luhn for card numbers, mod 97 for account numbers, ranges for addresses and phone numbers) and words whose presence near
the span raises or lowers its score. Base kinds keep every span that their validator confirms, whatever the score; added
kinds keep those that score ``ACCEPT`` or more and overlap no base span.

Positions come from the pieces between matches: the text split by the expression and the list of its matches alternate,
and prefix sums of their lengths are the starts. Lengths are code points. The expressions use possessive quantifiers and
start only at the edge of a run (or where the previous match ended), so a text takes time in proportion to its length.

Defined results: a null or empty text has no spans; repeated rows are judged alike; other columns are kept, columns named
like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40  # characters before and after a span that are searched for context words
ACCEPT = 0.6
STEP = 256

# The patterns of the base kinds, made possessive and anchored to the edge of a run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
LOCAL = r"(?<![0-9+.-])\(?[0-9]{3,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"


@dataclass(frozen=True)
class Kind:
    """``guard`` is a cheap condition without which the pattern cannot match."""

    name: str
    pattern: str
    guard: str
    base: bool
    score: float
    near: str
    against: str = r"(?!)"

    def valid(self, v: Column) -> Column:
        digits = F.regexp_replace(v, "[^0-9]", "")
        if self.name == "ip":
            return v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
        if self.name == "card":
            return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
        if self.name == "phone":
            return F.length(digits).between(10, 15)
        if self.name == "iban":
            return mod97(F.replace(v, F.lit(" "), F.lit(""))) == 1
        return F.lit(True)


KINDS = [
    Kind("email", EMAIL, "@", True, 0.9, r"mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", IP, r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", True, 0.6, r"\bip\b|address|host|server|login", r"version|release"),
    Kind("card", CARD, r"[0-9](?:[ -]?[0-9]){13}", True, 0.8, r"card|visa|master|credit|karte|tarjeta|carte"),
    Kind("phone", PHONE, r"\+[0-9]", True, 0.7, r"phone|tel|call|fax|mobile|ruf|llam|appel"),
    Kind("iban", IBAN, r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", False, 0.8, r"iban|account|bank|konto|cuenta|compte"),
    Kind("local_phone", LOCAL, r"[0-9][) .-]{1,2}[0-9]{3,4}[ .-][0-9]{3}", False, 0.3, r"phone|\btel\b|call|fax|mobile|telefon|llam|appel",
         r"order|invoice|version"),
    Kind("ssn", SSN, r"[0-9]{3}-[0-9]{2}-[0-9]{4}", False, 0.3, r"\bssn\b|social security"),
]
RANK = {k.name: i for i, k in enumerate(KINDS)}


def mod97(account: Column) -> Column:
    """Remainder of the account number with its first four characters moved to the end and letters read as 10 to 35."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def step(total: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(c.between("0", "9"), (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda t, c: F.when(c == "", t).otherwise(step(t, c)).cast("int"))


def _starts(gaps: Column, hits: Column) -> Column:
    """Start of every match: prefix sums of lengths, in steps so that thousands of matches stay cheap."""
    sizes = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.size(hits) / STEP).cast("int")), lambda c: F.aggregate(
        F.slice(sizes, (c * STEP + 1).cast("int"), STEP), F.lit(0), lambda a, x: a + x))
    return F.struct(sizes.alias("sizes"), steps.alias("steps"))


def _spans(kind: Kind, gaps: Column, hits: Column, sums: Column) -> Column:
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    def one(hit: Column, i: Column) -> Column:
        block = F.floor(i / STEP).cast("int")
        before = F.get(gaps, i)
        start = (total(F.slice(sums["steps"], 1, block)) + total(F.slice(sums["sizes"], block * STEP + 1, i - block * STEP))
                 + F.length(before))
        around = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(NEAR))))
        score = (F.lit(kind.score) + F.when(around.rlike(kind.near), 0.3).otherwise(0.0)
                 - F.when(around.rlike(kind.against), 0.3).otherwise(0.0))
        return F.struct(start.cast("long").alias("start"), F.lit(RANK[kind.name]).alias("rank"), F.lit(kind.name).alias("kind"),
                        (start + F.length(hit)).cast("long").alias("end"),
                        F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"), kind.valid(hit).alias("valid"))

    found = F.filter(F.transform(hits, one), lambda s: s["valid"])
    return found if kind.base else F.filter(found, lambda s: s["score"] >= ACCEPT)


EMPTY = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double,valid:boolean>>"


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pii``: structs (start, rank, kind, end, score), by start and then by the order of the kinds."""
    def has(k: Kind) -> Column:
        return F.contains(F.col(text), F.lit(k.guard)) if k.name == "email" else F.col(text).rlike(k.guard)

    out = docs.drop("pii")
    # Each step is a projection of its own, so that no expression is evaluated twice for one row.
    out = out.select("*", *(F.when(has(k), F.split(text, k.pattern, -1)).alias(f"_gaps_{k.name}") for k in KINDS))
    out = out.select("*", *(F.when(F.size(f"_gaps_{k.name}") > 1, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)))
                            .alias(f"_hits_{k.name}") for k in KINDS))
    out = out.select("*", *(_starts(F.col(f"_gaps_{k.name}"), F.col(f"_hits_{k.name}")).alias(f"_sums_{k.name}") for k in KINDS))
    out = out.select("*", *(F.coalesce(F.when(F.col(f"_hits_{k.name}").isNotNull(), _spans(
        k, F.col(f"_gaps_{k.name}"), F.col(f"_hits_{k.name}"), F.col(f"_sums_{k.name}"))), F.array().cast(EMPTY))
        .alias(f"_found_{k.name}") for k in KINDS))
    base = F.concat(*(F.col(f"_found_{k.name}") for k in KINDS if k.base))
    added = F.concat(*(F.col(f"_found_{k.name}") for k in KINDS if not k.base))
    out = out.withColumn("_base", base)
    clear = F.filter(added, lambda a: ~F.exists("_base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    sorted_spans = F.array_sort(F.concat("_base", clear))
    out = out.withColumn("pii", F.transform(sorted_spans, lambda s: s.dropFields("valid")))
    return out.drop("_base", *(f"_{p}_{k.name}" for p in ("gaps", "hits", "sums", "found") for k in KINDS))


def count_kind(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")


def listed(base_only: bool = False) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    spans = F.filter("pii", lambda s: s["rank"] < sum(k.base for k in KINDS)) if base_only else F.col("pii")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span by its kind in brackets; spans that overlap become one. Drops ``pii``.

    ``found`` is the result of ``find_pii``; texts without a span are returned as they are.
    """
    merged = F.aggregate(F.col("pii"), F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"), lambda out, s: F.when(
        (F.size(out) > 0) & (s["start"] < F.element_at(out, -1)["end"]),
        F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(
            F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"),
            F.element_at(out, -1)["kind"].alias("kind"))))).otherwise(
        F.concat(out, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))))
    # A span is cut at the end of its predecessor; the rest of the text follows the last one.
    masked = found.withColumn("_cuts", F.when(F.size("pii") > 0, merged))
    pieces = F.transform("_cuts", lambda s, i: F.concat(
        F.substring(text, (F.coalesce(F.get(F.col("_cuts"), i - 1)["end"], F.lit(0)) + 1).cast("int"),
                    (s["start"] - F.coalesce(F.get(F.col("_cuts"), i - 1)["end"], F.lit(0))).cast("int")),
        F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rest = F.substring(text, (F.element_at("_cuts", -1)["end"] + 1).cast("int"), F.length(text))
    return masked.withColumn(text, F.when(F.col("_cuts").isNotNull(), F.concat(F.array_join(pieces, ""), rest))
                             .otherwise(F.col(text))).drop("_cuts", "pii")
