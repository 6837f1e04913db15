"""Personal data: regular expressions propose, checksums confirm, context scores.

Column expressions only. Possessive quantifiers keep Java's matcher from
recursing or backtracking over long runs; they match what the plain patterns
match, since no part gives back a character a later part could use. The
look-behinds skip starts inside a run that already failed (or, for \\G, was not
consumed by the match before).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_LOCAL = r"[A-Za-z0-9._%+-]"
# kind -> (pattern, a cheap test a text with a match passes)
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@"))),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]"))),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", lambda t: F.rlike(t, F.lit(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+"))),
    "iban": (r"(?<![0-9A-Za-z_])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![0-9A-Za-z_])", lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"))),
}
BASE = ("email", "ip", "card", "phone")
# Score of a confirmed span, and words that raise it when they stand near (fixed values).
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8}
CONTEXT = {
    "email": "mail|contact|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
NEAR = 40  # characters before and after a span that are searched for context words
_BLOCK = 500


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(pieces: Column, found: Column) -> Column:
    """array<struct(start, match)> from what stands between the matches and the
    matches. Blocks of 500 keep the growing arrays short."""
    def block(at: Column, b: Column) -> Column:
        last = F.least(b + (_BLOCK - 1), F.size(found) - 1)
        zero = F.struct(at.alias("pos"), F.array().cast("array<struct<start:int,match:string>>").alias("out"))

        def step(s: Column, i: Column) -> Column:
            start = s["pos"] + F.length(F.get(pieces, i))
            return F.struct((start + F.length(F.get(found, i))).alias("pos"),
                            F.concat(s["out"], F.array(F.struct(start.alias("start"), F.get(found, i).alias("match")))).alias("out"))
        return F.aggregate(F.sequence(b, last), zero, step)

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<array<struct<start:int,match:string>>>").alias("out"))
    whole = F.aggregate(
        F.sequence(F.lit(0), F.size(found) - 1, F.lit(_BLOCK)), zero,
        lambda s, b: _let(block(s["pos"], b), lambda x: F.struct(x["pos"].alias("pos"), F.concat(s["out"], F.array(x["out"])).alias("out"))))
    return F.flatten(whole["out"])


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True when the digits pass the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """True when an IBAN's check digits are right: the code with its first four
    characters moved to the end, letters as 10 to 35, is 1 modulo 97."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _octet_ok(part: Column) -> Column:
    p = F.regexp_replace(part, "^0+", "")
    return (F.length(p) <= 3) & (F.concat(F.lit("0"), F.substr(p, F.lit(1), F.lit(3))).cast("int") <= 255)


def confirmed(kind: str, x: Column) -> Column:
    """Whether a match passes its kind's validator."""
    if kind == "ip":
        return F.forall(F.split(x, r"\."), _octet_ok)
    if kind == "card":
        d = digits_of(x)
        # the length first: no checksum over a run of thousands of digits
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits_of(x)).between(9, 15)
    if kind == "iban":
        return mod97(x)
    return F.lit(True)


def _kind_spans(docs: DataFrame, kind: str) -> DataFrame:
    pattern, may = PATTERNS[kind]
    t = F.col("_t")
    some = may(t)
    staged = (docs.withColumn("_p", F.when(some, F.split(t, pattern, -1)))
              .withColumn("_m", F.when(some, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))))
    spans = F.when(F.size("_m") > 0, F.filter(_spans(F.col("_p"), F.col("_m")), lambda s: confirmed(kind, s["match"])))
    scored = F.transform(spans, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end"),
        F.when(F.rlike(F.concat(F.substr(t, F.greatest(s["start"] - (NEAR - 1), F.lit(1)), F.least(s["start"], F.lit(NEAR))), F.lit(" "),
                                F.substr(t, s["start"] + F.length(s["match"]) + 1, F.lit(NEAR))),
                       F.lit(rf"(?iu)(?<!\p{{L}})(?:{CONTEXT[kind]})")),
               F.lit(round(SCORE[kind] + 0.1, 2))).otherwise(F.lit(SCORE[kind])).alias("score")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return staged.withColumn(f"_{kind}", F.coalesce(scored, none)).drop("_p", "_m")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and an array of spans per kind (email, ip, card,
    phone, iban), each (kind, start, end, score) in code points, end exclusive.

    Matches are the leftmost non-overlapping ones of each kind; those that fail
    the kind's check are dropped. IBANs are proposed besides the four kinds and
    kept when modulo 97 confirms them. A span's score is its kind's, and 0.1
    more with a context word within 40 characters. Null and empty texts have no
    spans. Repeated rows each give a row; an empty table gives none; other
    columns are not read.
    """
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    for kind in PATTERNS:
        df = _kind_spans(df, kind)
    return df.select(F.col("_id").alias(id_col), *[F.col(f"_{k}").alias(k) for k in PATTERNS])


def span_text(spans: Column) -> Column:
    """kind:start:end of each span."""
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the base spans' SHA-256 and all spans as text."""
    base = F.concat_ws(",", F.flatten(F.array(*[span_text(F.col(k)) for k in BASE])))
    every = F.concat_ws(",", F.flatten(F.array(*[span_text(F.col(k)) for k in PATTERNS])))
    return found.select(F.col(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"),
                        F.round(F.coalesce(F.array_max(F.transform(F.flatten(F.array(*[F.col(k) for k in PATTERNS])), lambda s: s["score"])), F.lit(0.0)), 2).alias("max_score"))
