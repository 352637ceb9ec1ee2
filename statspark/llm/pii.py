"""Personal data in text, by DataFrame functions only.

For each kind a regular expression proposes leftmost, non-overlapping spans.
``regexp_extract_all`` gives the matches and ``split`` the text between them,
so running sums of lengths give positions in code points. Validators confirm:
number ranges, digit counts, the Luhn sum for cards, mod 97 for account
numbers; entropy and mixed letters and digits for secrets. Words near a span
raise its score: identity numbers and assigned values, which no checksum
confirms, count only where a fitting word stands within reach. Keys of known
forms (``key``) tell themselves by their prefix.

The patterns use possessive repeats and may only start at the head of a run (or
where the last match ended); they match what the plain patterns in ``FIXED``
match, in time linear in the text and without deep recursion.

Defined cases: a null text is empty, without spans; any length is scanned whole;
repeated rows and null ids are scanned like others; spans of different kinds
may overlap, and redaction then joins them; an empty table gives an empty
result; an existing column of the name of a result is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their listed order, and the plain patterns of the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
FIXED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9])",
    "secret": r"(?<=[=:][\x20\x22\x27]{0,3})(?<![A-Za-z0-9+/_.~-])[A-Za-z0-9+/_.~-]{8,}+",
}
KINDS = tuple(PATTERNS)
#: What a text must hold before a kind's pattern is tried; else a digit.
NEEDS = {"email": "@", "phone": "\\+", "key": "AKIA|ASIA|gh[opsu]_|xox|eyJ", "secret": "[=:][\\x20\\x22\\x27]{0,3}[A-Za-z0-9+/_.~-]{8}"}

#: Score of a confirmed span, and what a context word within reach adds.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "key": 0.9, "secret": 0.3}
CONTEXT = {
    "email": "mail|contact|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|tel[eé]fono",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id",
    "key": "key|token|aws|secret",
    "secret": "password|passwd|pwd|passwort|kennwort|mot de passe|contraseña|secret|token|api[_ -]?key|access[_ -]?key|auth|bearer",
}
CONTEXT_GAIN = 0.1
CONTEXT_GAINS = {"ssn": 0.5, "secret": 0.5}
CONTEXT_REACH = 40
LEAST_SCORE = 0.5
#: Bits a character that an assigned value must have to be a secret.
LEAST_ENTROPY = 2.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _ip(value: Column) -> Column:
    parts = F.split(value, r"\.")
    return F.forall(parts, lambda p: F.coalesce(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.lit(False)) & (F.coalesce(F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), 1, 4).cast("int"), F.lit(0)) <= 255))


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    n = F.length(digits)
    doubled = F.transform(
        F.filter(F.split(digits, ""), lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def _phone(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def _iban(value: Column) -> Column:
    """The number moved round, letters as 10 to 35, has remainder 1 modulo 97."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    values = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    rest = F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97)
    return F.length(plain).between(15, 34) & (rest == 1)


def _ssn(value: Column) -> Column:
    return ~value.rlike("^(000|666|9)") & ~value.rlike("-00-|-0000$")


def _secret(value: Column) -> Column:
    """Letters and digits together, and characters as mixed as those of random values."""
    n = F.length(value)

    def bits(total: Column, c: Column) -> Column:
        share = (n - F.length(F.replace(value, c, F.lit("")))) / n
        return total - share * F.log2(share)

    entropy = F.aggregate(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), F.lit(0.0), bits)
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (entropy >= LEAST_ENTROPY)


CONFIRM = {"email": lambda v: F.lit(True), "ip": _ip, "card": _luhn, "phone": _phone, "iban": _iban, "ssn": _ssn, "key": lambda v: F.lit(True), "secret": _secret}


def _found(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: start, place of the kind, end, kind, score."""
    pattern = F.lit(PATTERNS[kind])
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    start_type = "array<struct<start:int,place:int,end:int,kind:string,score:double>>"
    # (position so far, spans): a gap, then a match
    located = F.aggregate(
        F.arrays_zip(matches.alias("m"), between.alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(
                x["m"].isNotNull() & CONFIRM[kind](x["m"]),
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["g"])).alias("start"), (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("end"), x["m"].alias("value")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )

    def scored(s: Column) -> Column:
        left = F.greatest(s["start"] - CONTEXT_REACH, F.lit(0))
        near = F.concat(F.substring(text, left + 1, s["start"] - left), F.lit(" \n "), F.substring(text, s["end"] + 1, F.lit(CONTEXT_REACH)))
        gain = F.when(near.rlike(rf"(?i)(?<![\p{{L}}])(?:{CONTEXT[kind]})(?![\p{{L}}])"), F.lit(CONTEXT_GAINS.get(kind, CONTEXT_GAIN))).otherwise(F.lit(0.0))
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.round(gain + SCORES[kind], 3).alias("score"))

    spans = F.transform(located, scored)
    if kind not in BASE_KINDS:
        spans = F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)
    holds = text.rlike(NEEDS.get(kind, "[0-9]"))
    return F.when(holds, spans).otherwise(F.array().cast(start_type))


def find(df: DataFrame, text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``df`` with ``pii``: the spans of every whole text by start, then kind, each with its score."""
    source = F.coalesce(F.col(text), F.lit(""))
    kept = df.drop("pii") if "pii" != text else df
    return kept.withColumn("pii", F.array_sort(reduce(F.concat, [_found(source, k) for k in kinds])))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span (overlapping ones together) by the bracketed name of its first kind."""
    source = F.coalesce(F.col(text), F.lit(""))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(
        F.col("pii"),
        state,
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(source, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(source, acc["at"] + 1, F.length(source))),
    )
    return found.withColumn(text, F.when(F.size("pii") > 0, cut).otherwise(F.col(text)))
