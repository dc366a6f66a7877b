"""Format-preserving pseudonyms for personal data; DataFrame functions only.

Numbers, dates, addresses and secrets are found by one pattern, validated by kind (Luhn for cards, octets for network
addresses, the calendar for dates, ranges for social security numbers, whose first digit stays) and permuted inside their
own format by a keyed Feistel network: letters stay letters, digits stay digits, punctuation stays. Where the network
leaves the valid values (a social security number with a group of zeros), it is applied again until it is back: that
permutes the valid ones among themselves. So equal values get equal pseudonyms in every document and formats still
validate, but without the key nobody can go back. Texts without a digit, an at sign or the name of a secret hold no
candidate and are not searched further.

Kinds: email (local part), card (the check digit is made valid again), phone (country code stays), ssn, ip (octets),
date (a day of the same 400-year calendar cycle, such as 1800 to 2199; years before 200 and from 9800 on stay), key and
secret (the value after its name, in small or capital letters). Dates are written year, month, day, or with the year last,
with - / or . between: with / the month comes first, else the day, but for a day over 12 in the other order. International
phone numbers begin with + and have 8 to 15 digits in any groups; a country code that is not set apart is permuted too.

The key is the session's spark.stratalith.pseudonym.key; without it a public one is used, which hides nothing from readers of
this file.

Defined cases: a null text stays null, an empty one empty, both with 0 replacements; what doesn't validate stays as it
is; a valid value counts as replaced, even if it is one of the few that its permutation leaves where they are; nulls and extra columns pass through; the outputs n_replaced and kinds win over input columns of their names;
repeated rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Candidates, in the order in which they are tried at one place. Repetitions are bounded: no match needs deep recursion.
PATTERNS = {
    "email": r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b",
    "secret": r"\b(?i:password|passwd|token|secret|api_?key)\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9_+/=-]{8,200}",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}\b|\+\d{1,3}[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}\b|\b\d{3}[.-]\d{3}[.-]\d{4}\b|\+(?=(?:[ .()-]{0,2}\d){8,15}(?![ .-]?\d))\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,6}){1,7}\b",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "date": "|".join(rf"\b\d{{4}}{x}\d{{2}}{x}\d{{2}}\b|\b\d{{2}}{x}\d{{2}}{x}\d{{4}}\b" for x in ("-", "/", r"\.")),
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b\d{13,19}\b|\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b|\b\d{4}[ -]\d{6}[ -]\d{5}\b",
}
ANY = "|".join(PATTERNS.values())
MAYBE = "[0-9@]|(?i:password|passwd|token|secret|api_?key)"
ROUNDS = 4
DAYS = (189, 773)  # 146097 days of a calendar cycle


def _bind(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chars(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def _byte(digest: Column, i: Column) -> Column:
    """Byte i (from 0, below 32) of a hexadecimal digest."""
    return F.conv(F.substring(digest, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _shifted(chars: Column, secret: Column) -> Column:
    """Each character moved inside its class (digits, small or large letters) by a keyed amount."""

    def move(c: Column, i: Column) -> Column:
        by = _byte(F.sha2(F.concat(secret, F.lit("/"), F.floor(i / 32).cast("string")), 256), i % 32)
        code = F.ascii(c)
        turn = lambda first, n: F.char(((code - first + by) % n + first).cast("long"))
        return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).otherwise(c)

    return F.transform(chars, move)


def feistel(value: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings with value's classes of characters."""

    def run(chars: Column) -> Column:
        half = F.floor(F.size(chars) / 2).cast("int")
        left, right = F.slice(chars, F.lit(1), half), F.slice(chars, half + 1, F.size(chars))

        def step(acc: Column, i: Column) -> Column:
            secret = F.concat(F.lit(f"{key}/{kind}/"), F.size(chars).cast("string"), F.lit("/"), i.cast("string"), F.lit("/"), F.array_join(acc["r"], ""))
            return F.struct(acc["r"].alias("l"), _shifted(acc["l"], secret).alias("r"))

        done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.alias("l"), right.alias("r")), step)
        return F.array_join(_bind(done, lambda d: F.concat(d["l"], d["r"])), "")

    return _bind(_chars(value), run)


def feistel_numbers(a: Column, b: Column, n_a: int, n_b: int, key: str, kind: str) -> Column:
    """struct(a, b): a keyed permutation of the pairs below (n_a, n_b)."""

    def step(acc: Column, i: Column) -> Column:
        def amount(x: Column) -> Column:
            return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}/{kind}/"), i.cast("string"), F.lit("/"), x.cast("string")), 256), 1, 12), 16, 10).cast("long")

        return F.when(i % 2 == 1, F.struct(((acc["a"] + amount(acc["b"])) % n_a).alias("a"), acc["b"].alias("b"))).otherwise(F.struct(acc["a"].alias("a"), ((acc["b"] + amount(acc["a"])) % n_b).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string."""
    each = F.transform(F.reverse(_chars(digits)), lambda c, i: _bind(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d)


def _refilled(pattern_value: Column, core: Column) -> Column:
    """The letters and digits of a value replaced, in order, by those of core."""
    chars = _chars(pattern_value)

    def fill(c: Column, i: Column) -> Column:
        done = F.length(F.regexp_replace(F.substring(pattern_value, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("^[0-9A-Za-z]$"), F.substring(core, done, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars, fill), "")


def _core(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9A-Za-z]", "")


def _card(m: Column, key: str) -> Column:
    def made(body: Column) -> Column:
        check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
        return F.concat(body, check.cast("string"))

    def checked(digits: Column) -> Column:
        body = feistel(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        return F.when(_luhn(digits) % 10 == 0, _refilled(m, _bind(body, made)))

    return _bind(_core(m), checked)


def _ip(m: Column, key: str) -> Column:
    def go(o: Column) -> Column:
        left, right = o[0] * 256 + o[1], o[2] * 256 + o[3]
        new = _bind(feistel_numbers(left, right, 65536, 65536, key, "ip"), lambda p: F.concat_ws(".", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256))
        return F.when(F.forall(o, lambda x: x < 256), new)

    return _bind(F.split(m, r"\.").cast("array<int>"), go)


def _date(m: Column, key: str) -> Column:
    begin, cycle = F.lit("1800-01-01").cast("date"), DAYS[0] * DAYS[1]
    mark = F.regexp_extract(m, "[-/.]", 0)
    plain = F.translate(m, "/.", "--")

    def permuted(n: Column) -> Column:
        """Day n of the calendar moved inside its cycle."""
        inside = F.pmod(n, F.lit(cycle))
        return F.when(n.isNotNull(), _bind(feistel_numbers(F.floor(inside / DAYS[1]), inside % DAYS[1], *DAYS, key, "date"), lambda p: (n - inside + p["a"] * DAYS[1] + p["b"]).cast("int")))

    def late(n: Column) -> Column:
        """The same among the days after the 12th alone, which no other order of day and month can write."""
        again = lambda acc, i: F.when((i > 1) & (F.dayofmonth(F.date_add(begin, acc)) > 12), acc).otherwise(permuted(acc))
        return F.when(n.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(60)), n, again))

    def go(form: str, use=permuted) -> Column:
        day = F.date_diff(F.try_to_timestamp(plain, F.lit(form)).cast("date"), begin)
        moved = lambda n: F.date_format(F.date_add(begin, use(F.when(n.between(-4 * cycle, 20 * cycle - 1), n))), form)
        return F.replace(_bind(day, moved), F.lit("-"), mark)

    month, day = "MM-dd-yyyy", "dd-MM-yyyy"
    short = F.when(mark == "/", F.coalesce(go(month), go(day, late))).otherwise(F.coalesce(go(day), go(month, late)))
    return F.when(m.rlike("^[0-9]{4}"), go("yyyy-MM-dd")).otherwise(short)


SSN_BAD = "^(?:000|666|9)|^...00|0000$"
WALKS = 24  # a step leaves the valid numbers about once in a hundred times


def _ssn(m: Column, key: str) -> Column:
    first = F.substring(m, 1, 1)
    step = lambda acc: feistel(acc, key, "ssn")
    walk = lambda acc, i: F.when((i > 1) & ~F.concat(first, acc).rlike(SSN_BAD), acc).otherwise(step(acc))
    moved = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.substring(_core(m), 2, 8), walk)
    digits = _bind(moved, lambda x: F.concat(first, F.substring(x, 1, 2), F.lit("-"), F.substring(x, 3, 2), F.lit("-"), F.substring(x, 5, 4)))
    return F.when(~_core(m).rlike(SSN_BAD), digits)


def _tail(m: Column, name: str, key: str, kind: str) -> Column:
    """m with what follows the pattern `name` permuted."""
    head = F.regexp_extract(m, name, 0)
    rest = F.substring(m, F.length(head) + 1, F.length(m))
    return F.concat(head, _refilled(rest, feistel(_core(rest), key, kind)))


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, value) of a match; kind is null where it doesn't validate."""
    whole = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}
    local = F.regexp_extract(m, "^[^@]*", 0)
    email = F.concat(_refilled(local, feistel(_core(local), key, "email")), F.regexp_extract(m, "@.*$", 0))
    secret = _tail(m, "^[A-Za-z_]+\\s{0,3}[:=]\\s{0,3}[\"']?", key, "secret")
    cut = F.regexp_extract(m, r"^(?:\+\d{1,3}(?:[ .-]|(?=\()))?", 0)
    rest = F.substring(m, F.length(cut) + 1, F.length(m))
    phone = F.concat(cut, _refilled(rest, feistel(_core(rest), key, "phone")))
    made = {
        "email": email, "secret": secret, "key": _tail(m, "^AKIA", key, "key"), "phone": phone,
        "ip": _ip(m, key), "date": _date(m, key), "ssn": _ssn(m, key), "card": _card(m, key),
    }
    out = None
    for kind, value in made.items():
        test = m.rlike(whole[kind])
        pair = F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        out = F.when(test, pair) if out is None else out.when(test, pair)
    out = out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value")))
    return _bind(out, lambda p: F.struct(F.when(p["value"].isNotNull(), p["kind"]).alias("kind"), F.coalesce(p["value"], m).alias("value")))


def pseudonymized(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the text's personal data replaced, n_replaced and kinds (array, in text order)."""
    t = F.col(f"`{text}`")
    found = F.when(t.rlike(MAYBE), F.regexp_extract_all(t, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    with_found = docs.withColumn("__found", found)
    with_new = with_found.withColumn("__new", F.transform("__found", lambda m: pseudonym(m, key)))
    pieces = F.split(t, ANY, -1)
    woven = F.array_join(F.zip_with(pieces, "__new", lambda a, b: F.concat(a, F.coalesce(b["value"], F.lit("")))), "")
    kinds = F.filter(F.transform("__new", lambda p: p["kind"]), lambda k: k.isNotNull())
    out = with_new.withColumn(text, F.when(F.size("__found") > 0, woven).otherwise(t)).withColumn("kinds", F.coalesce(kinds, F.array().cast("array<string>")))
    return out.withColumn("n_replaced", F.size("kinds").cast("long")).drop("__found", "__new")


def key_of(spark: SparkSession) -> str:
    return spark.conf.get("spark.stratalith.pseudonym.key", "a public key")


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymized(docs, key_of(spark)).select("doc_id", "text", "n_replaced", F.array_join("kinds", ",").alias("kinds"))


SQL: dict[str, str] = {}
QUERIES = {"op6_feistel_pseudonyms": op6_feistel_pseudonyms}
