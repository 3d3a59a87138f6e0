"""Personal data by patterns, checksums and context, in DataFrame functions only.

A regular expression proposes spans of each kind; validators confirm them (Luhn for cards,
mod-97 for bank account numbers, ranges for addresses, lengths for phones).  The kinds of
``BASE`` are decided by pattern and validator alone.  Further kinds have a score: what
their validator is worth, and more where a context word stands in the ``NEAR`` characters
before or after; they are reported from ``LEAST_SCORE`` on and never overlap a base span,
but for account numbers, whose check is the stronger one, and logins inside URLs.

An account number is tried at every place where one can begin, so no other text takes part of
it: with the fixed length of its country, else (codes without one here) with the longest end
at a word's end that mod-97 confirms.

Spans are code-point offsets, end exclusive.  They come from marking each match inside the
text and summing the lengths of the parts between the marks, so they need no Python; only
texts that can hold a kind (a cheap test first) are marked.  No shuffle, no join.

Patterns are written so that no text makes them try a run of characters more than once:
a leading run is entered only at its start or where the last match ended.

A list of matches is put together from short ones, so its work grows with the matches; a text
with many thousands of account numbers alone takes more than that.

Defined cases: a null text is empty; texts that contain the two mark characters (control
characters 1 and 2) are searched with both replaced by a character no pattern knows;
equal rows are judged row by row; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40
LEAST_SCORE = 0.6

_SPANS = "array<struct<start:int,end:int,text:string>>"


@dataclass(frozen=True)
class Kind:
    """pattern: Java expression; test: cheap expression over the text that a match implies;
    valid: check of one match; worth: score of a confirmed match; near: words that add to it;
    spans: confirmed spans of a text, in place of the search for the pattern; sure: whether a
    confirmed match stands beside a base span."""

    name: str
    pattern: str
    test: str
    valid: object
    worth: float = 1.0
    near: tuple[str, ...] = field(default=())
    spans: object = None
    sure: bool = False


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check; each digit from the right counts once
    or, every second one, doubled with its digits summed."""
    n = F.length(number)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, k: acc
        + F.when((k - 1) % 2 == 0, F.substring(number, n - k + 1, F.lit(1)).cast("int")).otherwise(
            F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(number, n - k + 1, F.lit(1)).cast("int"))
        ),
    )
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (letters and digits, at most 34) leaves 1 by the mod-97 rule."""
    plain = F.regexp_replace(F.upper(account), "[^A-Z0-9]", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.lit(40)), F.substring(plain, F.lit(1), F.lit(4)))
    value = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)),
        F.lit(0),
        lambda acc, k: F.when(
            F.substring(turned, k, F.lit(1)).rlike("[0-9]"), (acc * 10 + F.ascii(F.substring(turned, k, F.lit(1))) - 48) % 97
        ).otherwise((acc * 100 + F.ascii(F.substring(turned, k, F.lit(1))) - 55) % 97),
    )
    return (F.length(plain) >= 15) & (F.length(plain) <= 34) & (value == 1)


#: Length of account numbers by country (ISO 13616).
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_OF_COUNTRY = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _LENGTHS.items())
_LISTED = "|".join(_LENGTHS.values()).replace(" ", "|")
_ACCOUNT = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11}"


def _accounts(text: Column) -> Column:
    """Confirmed account numbers in order, none over another: the text is cut at each place where
    one can begin."""
    parts = F.split(F.regexp_replace(text, f"(?={_ACCOUNT})", "\x01"), "\x01")
    empty = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), F.array().cast(_SPANS).alias("found"))

    def step(acc: Column, part: Column) -> Column:
        ahead = F.substring(text, acc["at"] + 1, F.lit(68))  # 34 signs, spaces between, and the next one
        fixed = F.regexp_extract(ahead, rf"^(?:{_OF_COUNTRY})\b", 0)
        free = F.regexp_extract(ahead, rf"^(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}", 0)
        ends = F.filter(
            F.sequence(F.greatest(F.length(free), F.lit(15)), F.lit(15), F.lit(-1)),
            lambda n: F.substring(ahead, n, F.lit(2)).rlike(r"^[A-Z0-9](?:\W|$)") & mod97(F.substring(ahead, F.lit(1), n)),
        )
        n = F.when(fixed != "", F.when(mod97(fixed), F.length(fixed))).when(free != "", F.get(ends, F.lit(0)))
        after = F.coalesce(F.try_element_at(acc["found"]["end"], F.lit(-1)), F.lit(0))
        span = F.struct(acc["at"].alias("start"), (acc["at"] + n).alias("end"), F.substring(ahead, F.lit(1), n).alias("text"))
        more = F.when(n.isNotNull() & (acc["at"] >= after), F.array(span)).otherwise(F.array().cast(_SPANS))
        return F.struct((acc["at"] + F.length(part)).alias("at"), F.concat(acc["found"], more).alias("found"))

    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), empty, step)["found"]


def _between(low: int, high: int):
    return lambda text: F.length(digits_of(text)).between(low, high)


def _card(text: Column) -> Column:
    number = digits_of(text)
    return F.when(F.length(number).between(13, 19), luhn(number)).otherwise(F.lit(False))


def _ipv6(m: Column) -> Column:
    """Eight groups, or one gap and three groups or more."""
    groups = F.filter(F.split(m, ":"), lambda g: g != "")
    gaps = (F.length(m) - F.length(F.replace(m, F.lit("::"), F.lit("")))) / 2
    return ((gaps == 0) & (F.size(groups) == 8)) | ((gaps == 1) & F.size(groups).between(3, 7) & ~F.contains(m, F.lit(":::")))


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

BASE = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "instr(text, '@') > 0",
        lambda m: F.lit(True),
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"text rlike '[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]'",
        lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    ),
    Kind("card", r"[0-9]++(?:[ -][0-9]++)*+", r"text rlike '[0-9](?:[ -]?[0-9]){12}'", _card),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"text rlike '\\+[0-9]'", _between(9, 15)),
)
FURTHER = (
    Kind(
        "iban",
        _ACCOUNT,
        r"text rlike '[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11}'",
        mod97,
        0.7,
        ("iban", "account", "konto", "compte", "cuenta", "bank"),
        _accounts,
        True,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        r"text rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'",
        lambda m: F.lit(True),
        0.4,
        ("ssn", "social security", "taxpayer"),
    ),
    Kind(
        "local_phone",
        r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
        r"text rlike '[0-9]{3}[ .-][0-9]{4}'",
        _between(10, 10),
        0.4,
        ("phone", "tel", "call", "mobile", "fax", "telefon", "anruf", "telefono"),
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
        r"text rlike '[A-Za-z0-9+/_-]{20}'",
        lambda m: (F.length(digits_of(m)) >= 3) & (F.length(F.regexp_replace(m, "[^A-Za-z]", "")) >= 3) & (F.length(m) <= 512),
        0.4,
        ("token", "secret", "password", "passwd", "credential", "bearer", "api key", "api_key", "apikey", "access key", "access_key"),
    ),
    Kind(
        "key_format",
        r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
        r"text rlike 'AKIA|ASIA|gh[pousr]_|eyJ|PRIVATE KEY'",
        lambda m: F.lit(True),
        0.9,
        ("key", "token", "secret"),
    ),
    Kind(
        "url_login",
        r"(?<=://)[^\s/@:]{1,64}:[^\s/@]{1,64}(?=@)",
        r"text rlike '://[^ ]{1,64}:'",
        lambda m: F.lit(True),
        0.9,
        ("password",),
        sure=True,
    ),
    Kind(
        "ipv6",
        r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}+[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])",
        r"text rlike '[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:'",
        lambda m: _ipv6(m),
        0.7,
        ("ip", "address", "host"),
    ),
)


#: Parts of a marked text that are gathered together; a list grows by copies, so long ones are
#: made of short ones.
TOGETHER = 256


def _matches(text: Column, kind: Kind) -> Column:
    """Spans of every match: the text is cut at marks set before and after each match."""
    marked = F.regexp_replace(text, f"({kind.pattern})", "\x01$1\x02")
    parts = F.split(marked, "\x01")
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))

    def step(acc: Column, part: Column) -> Column:
        size = F.instr(part, "\x02") - 1
        span = F.struct(acc["at"].alias("start"), (acc["at"] + size).alias("end"), F.substring(part, F.lit(1), size).alias("text"))
        return F.struct((acc["at"] + F.length(part) - 1).alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    def grouped(parts: Column) -> Column:
        n = F.size(parts) - 1  # parts that begin with a match
        firsts = F.sequence(F.lit(2), F.greatest(n, F.lit(1)) + 1, F.lit(TOGETHER))
        return F.transform(firsts, lambda k: F.aggregate(F.slice(parts, k, F.least(F.lit(TOGETHER), F.greatest(n + 2 - k, F.lit(0)))), empty, step))

    def joined(groups: Column, before: Column) -> Column:
        places = F.aggregate(groups, F.array(before), lambda acc, group: F.concat(acc, F.array(F.element_at(acc, -1) + group["at"])))
        moved = lambda group, place: F.transform(
            group["found"], lambda s: F.struct((s["start"] + place).alias("start"), (s["end"] + place).alias("end"), s["text"].alias("text"))
        )
        return F.flatten(F.zip_with(groups, F.slice(places, F.lit(1), F.size(groups)), moved))

    return _bound(parts, lambda p: _bound(grouped(p), lambda groups: joined(groups, F.length(F.get(p, F.lit(0))))))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often the lambdas in it refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scored(text: Column, kind: Kind, span: Column) -> Column:
    around = F.lower(F.substring(text, F.greatest(span["start"] - NEAR + 1, F.lit(1)), span["end"] - span["start"] + 2 * NEAR))
    met = reduce(lambda a, b: a | b, [F.contains(around, F.lit(w)) for w in kind.near])
    return F.lit(kind.worth) + F.when(met, 0.3).otherwise(0.0)


def _valid(kind: Kind) -> Column:
    return F.col(kind.name) if kind.spans else F.filter(kind.name, lambda span: kind.valid(span["text"]))


def _reported(kind: Kind, least_score: float) -> Column:
    free = lambda s: ~F.exists("taken", lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    return F.filter(kind.name, lambda span: (F.lit(kind.sure) | free(span)) & (_scored(F.col("text"), kind, span) >= least_score))


def find(docs: DataFrame, least_score: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, for every kind, its spans (start, end, text) in order."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\x01\x02", "��")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    none = F.array().cast(_SPANS)
    for kind in (*BASE, *FURTHER):
        rows = rows.withColumn(kind.name, F.when(F.expr(kind.test), kind.spans(F.col("text")) if kind.spans else _matches(F.col("text"), kind)).otherwise(none))
    rows = rows.select("doc_id", "text", *[_valid(k).alias(k.name) for k in (*BASE, *FURTHER)])
    taken = F.concat(*[F.col(k.name) for k in BASE])
    rows = rows.withColumn("taken", taken)
    for k in FURTHER:
        rows = rows.withColumn(k.name, _reported(k, least_score))
    return rows.select("doc_id", *[k.name for k in (*BASE, *FURTHER)])


def _named(kind: Kind) -> Column:
    return F.transform(kind.name, lambda span: F.concat_ws(":", F.lit(kind.name), span["start"], span["end"]))


def spans_text(kinds) -> Column:
    """kind:start:end of the given kinds in turn, comma-joined."""
    return F.array_join(F.concat(*[_named(k) for k in kinds]), ",")
