"""Personal data replaced by format-preserving pseudonyms.

A value that passes its check - card (Luhn), IBAN (mod 97), social security
number, phone, IPv4 address, calendar date - is permuted within its format by a
keyed Feistel network over the numbers of that format: digits stay digits at
their places, check digits are right again, dates are dates. Under one key
different values stay different and equal values stay equal, in all documents.
Mail addresses are no numbers; they become a keyed name of fixed form.

Everything is a DataFrame expression on the row; nothing is shuffled. The
network alternates two unequal halves, with the leading hexadecimal digits of
SHA-256 as round function.

Cards are sought in whole runs of digits with single blanks or hyphens: at every
group the longest 13 to 19 digits that end with a group and pass. IBANs may be
printed in groups of four, if their country's length is known.

Dates move within their 400-year block. Slashed dates are read as month/day
where that is a date, else as day/month, and keep that order.

Defined cases: null stays null, empty stays empty. What fails its check is left
alone. Other columns are kept as they are; ``n_chars`` follows the text if it is
there. Rows are independent, so repeated rows change alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Lengths of IBANs, for those printed in groups of four.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
GROUPED = "|".join(
    f"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, lands in LENGTHS.items()
)

# The forms that are looked at, in the order in which they are tried at one place; cards in what the others leave.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}+|{GROUPED})(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-][0-9]{1,4}){3,6}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3} [0-9]{3} [0-9]{4}|(?<!\.)[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+",
}
KINDS = list(FORMS)
FIRST = [k for k in KINDS if k != "card"]
ANY = "|".join(FORMS[k] for k in FIRST)
ROUNDS = 8


def rounds(key: str, tag, left: Column, right: Column, a: Column, b: Column) -> Column:
    """Feistel network over pairs of numbers below a and b; struct(left, right)."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(pair: Column, i: Column) -> Column:
        other = F.when(i % 2 == 0, pair["r"]).otherwise(pair["l"])
        said = F.sha2(F.concat_ws("|", F.lit(key), tag, i.cast("string"), other.cast("string")), 256)
        noise = F.conv(F.substring(said, 1, 15), 16, 10).cast("long")
        return F.struct(
            F.when(i % 2 == 0, (pair["l"] + noise) % a).otherwise(pair["l"]).alias("l"),
            F.when(i % 2 == 1, (pair["r"] + noise) % b).otherwise(pair["r"]).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def digits_permuted(key: str, tag: str, digits: Column) -> Column:
    """A string of up to 36 digits as another of the same length."""
    n = F.length(digits)
    half = (n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10), k).cast("long")
    number = lambda s: F.concat(F.lit("0"), s).cast("long")
    out = rounds(
        key, F.concat_ws("/", F.lit(tag), n.cast("string")),
        number(F.substr(digits, F.lit(1), half)), number(F.substr(digits, half + 1, n)), power(half), power(n - half),
    )
    return F.transform(F.array(out), lambda p: F.concat(
        F.when(half > 0, F.lpad(p["l"].cast("string"), half, F.lit("0"))).otherwise(F.lit("")), F.lpad(p["r"].cast("string"), n - half, F.lit("0")),
    ))[0]


def luhn_sum(digits: Column) -> Column:
    """Sum with every second digit doubled, the last digit counted once."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def filled(form: Column, digits: Column) -> Column:
    """The form with its digits replaced in order; other characters stay."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        is_digit = (c >= "0") & (c <= "9")
        return F.struct(
            F.concat(acc["out"], F.when(is_digit, F.substr(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + is_digit.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(form, ""), start, step, lambda acc: acc["out"])


def with_value(value: Column, use) -> Column:
    """Computes ``value`` once and hands it on (a let for expressions)."""
    return F.transform(F.array(value), use)[0]


def card(key: str, m: Column) -> Column:
    def replace(d: Column) -> Column:
        body = digits_permuted(key, "card", F.substr(d, F.lit(1), F.length(d) - 1))
        whole = with_value(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when((luhn_sum(d) % 10 == 0) & (F.length(d) >= 13), filled(m, whole))

    return with_value(F.regexp_replace(m, "[^0-9]", ""), replace)


def cards(key: str, m: Column) -> Column:
    """struct(new, n): digits in groups, with every card among them that begins and ends at a group edge replaced.

    From left to right; of several that begin at one place the longest that passes.
    """
    def run(groups: Column) -> Column:
        part = lambda i, j: F.array_join(F.slice(groups, i, j - i + 1), "")
        start = F.struct(F.lit("").alias("new"), F.lit(0).alias("n"), F.lit(1).alias("next"))

        def passes(i: Column, j: Column) -> Column:
            return with_value(F.regexp_replace(part(i, j), "[^0-9]", ""), lambda d: F.when(F.length(d).between(13, 19), luhn_sum(d) % 10 == 0).otherwise(False))

        def step(acc: Column, i: Column) -> Column:
            ends = F.filter(F.sequence(i, F.least(i + 18, F.size(groups))), lambda j: passes(i, j))
            taken = with_value(F.array_max(ends), lambda j: F.when(j.isNull(), F.struct(
                F.concat(acc["new"], F.element_at(groups, i)).alias("new"), acc["n"].alias("n"), (i + 1).alias("next"),
            )).otherwise(F.struct(F.concat(acc["new"], card(key, part(i, j))).alias("new"), (acc["n"] + 1).alias("n"), (j + 1).alias("next"))))
            return F.when(i < acc["next"], acc).otherwise(taken)

        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step, lambda acc: F.struct(acc["new"].alias("new"), acc["n"].alias("n")))

    return with_value(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0)), run)


def without_cards(key: str, text: Column) -> Column:
    """struct(new, n) of a text that holds no other form."""
    form = FORMS["card"]

    def joined(runs: Column) -> Column:
        shown = F.zip_with(F.split(text, form, -1), runs, lambda g, r: F.concat(g, F.coalesce(r["new"], F.lit(""))))
        return F.struct(F.array_join(shown, "").alias("new"), F.aggregate(runs, F.lit(0), lambda a, r: a + r["n"]).alias("n"))

    found = F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda m: cards(key, m))
    return F.when(text.rlike(form), with_value(found, joined)).otherwise(F.struct(text.alias("new"), F.lit(0).alias("n")))


def phone(key: str, m: Column) -> Column:
    """The country code behind a plus stays."""
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-]))?", 0)
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    return with_value(F.regexp_replace(rest, "[^0-9]", ""), lambda d: F.when(
        F.length(d).between(7, 15), F.concat(code, filled(rest, digits_permuted(key, "phone", d)))
    ))


def address(key: str, m: Column) -> Column:
    def replace(p: Column) -> Column:
        n = F.transform(p, lambda x: x.cast("int"))
        right = F.size(F.filter(n, lambda x: x > 255)) == 0
        # No leading zeros: the format has no place for them.
        plain = F.size(F.filter(p, lambda x: (F.length(x) > 1) & x.startswith("0"))) == 0
        out = rounds(key, F.lit("ip"), n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536))
        shown = with_value(out, lambda q: F.concat_ws(
            ".", *[x.cast("string") for x in ((q["l"] / 256).cast("int"), q["l"] % 256, (q["r"] / 256).cast("int"), q["r"] % 256)]
        ))
        return F.when(right & plain, shown)

    return with_value(F.split(m, r"\."), replace)


def social(key: str, m: Column) -> Column:
    area, group, serial = (F.substring(m, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    right = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    out = rounds(key, F.lit("ssn"), place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

    def shown(q: Column) -> Column:
        p = (q["l"] / 99).cast("int")
        return F.format_string("%03d-%02d-%04d", F.when(p >= 665, p + 2).otherwise(p + 1), (q["l"] % 99 + 1).cast("int"), (q["r"] + 1).cast("int"))

    return F.when(right, with_value(out, shown))


def mod97(text: Column) -> Column:
    """Remainder of the IBAN number: letters are 10 to 35."""
    def add(total: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return (total * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def iban(key: str, m: Column) -> Column:
    """Blanks stay where they are."""
    def replace(plain: Column) -> Column:
        land, body = F.substring(plain, 1, 2), F.substr(plain, F.lit(5), F.length(plain))
        digits = F.regexp_replace(body, "[^0-9]", "")

        def checked(new: Column) -> Column:
            return F.concat(land, F.format_string("%02d", (98 - mod97(F.concat(new, land, F.lit("00")))).cast("int")), new)

        right = mod97(F.concat(body, F.substring(plain, 1, 4))) == 1
        return F.when(right & (F.length(digits) > 0), with_value(filled(body, digits_permuted(key, "iban", digits)), checked))

    # Groups are of four.
    grouped = lambda new: F.when(m.contains(" "), F.rtrim(F.regexp_replace(new, "(.{4})", "$1 "))).otherwise(new)
    return with_value(with_value(F.regexp_replace(m, " ", ""), replace), grouped)


def date(key: str, m: Column) -> Column:
    def moved(read: str) -> Column:
        day = F.try_to_timestamp(m, F.lit(read)).cast("date")
        # Days since a first of March that begins a 400-year block: 146,097 = 189 x 773 days.
        n = F.datediff(day, F.lit("2000-03-01").cast("date"))
        block = F.floor(n / 146097)
        inside = n - block * 146097
        out = rounds(key, F.concat(F.lit("date/"), block.cast("string")), (inside / 773).cast("int"), inside % 773, F.lit(189), F.lit(773))
        new = with_value(out, lambda q: F.date_add(F.lit("2000-03-01").cast("date"), (block * 146097 + q["l"] * 773 + q["r"]).cast("int")))
        # Years of four digits only: blocks at the ends of the calendar reach beyond them.
        return F.when(F.year(day).between(1600, 9599) & day.isNotNull(), F.date_format(new, read))

    slash = F.coalesce(moved("MM/dd/yyyy"), moved("dd/MM/yyyy"))
    return F.when(m.contains("-"), moved("yyyy-MM-dd")).when(m.contains("/"), slash).otherwise(moved("dd.MM.yyyy"))


def email(key: str, m: Column) -> Column:
    name = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16)
    return F.concat(F.lit("user-"), name, F.lit("@mail.invalid"))


REPLACE = {"email": email, "iban": iban, "phone": phone, "ssn": social, "ip": address, "date": date}


def pseudonym(key: str, m: Column) -> Column:
    """struct(kind, text) of a match; kind is null where the check fails and the match stays."""
    whole = lambda k: m.rlike("^(?:" + FORMS[k] + ")$")
    tried = [F.when(whole(k), F.struct(F.lit(k).alias("kind"), REPLACE[k](key, m).alias("new"))) for k in FIRST]
    fits = [F.when(t["new"].isNotNull(), t) for t in tried]
    return F.coalesce(*fits, F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new")))


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """All rows and columns, with new texts, and the number of replacements of each kind as n_<kind>."""
    text = F.col(column).cast("string")
    some = text.rlike(ANY) | text.rlike(FORMS["card"])
    found = F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    gaps = F.when(F.col("__pii_found").isNotNull(), F.split(text, ANY, -1))
    left = lambda x: F.struct(F.lit(None).cast("string").alias("kind"), x.alias("new"))
    # Gaps and matches in turn; cards are looked for in all that stays.
    parts = F.flatten(F.zip_with("__pii_gaps", F.transform("__pii_found", lambda m: pseudonym(key, m)), lambda g, p: F.array(left(g), F.coalesce(p, left(F.lit(""))))))
    told = F.transform("__pii_parts", lambda p: F.when(p["kind"].isNotNull(), F.struct(p["new"].alias("new"), F.lit(0).alias("n"))).otherwise(without_cards(key, p["new"])))
    out = docs.withColumn("__pii_found", found).withColumn("__pii_gaps", gaps).withColumn("__pii_parts", parts).withColumn("__pii_new", told)
    counts = {f"n_{k}": F.size(F.filter("__pii_parts", lambda p: p["kind"] == k)) for k in FIRST}
    counts["n_card"] = F.aggregate("__pii_new", F.lit(0), lambda a, p: a + p["n"])
    counts = {n: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long") for n, c in counts.items()}
    joined = F.array_join(F.transform("__pii_new", lambda p: p["new"]), "")
    out = out.withColumns({column: F.when(F.col("__pii_found").isNull(), text).otherwise(joined), **counts})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(column).cast("long"), F.col("n_chars").cast("long")))
    return out.drop("__pii_found", "__pii_gaps", "__pii_parts", "__pii_new")
