"""Format-preserving pseudonyms for personal data, by Feistel networks under a key.

Card numbers (Luhn), IBANs (mod 97), social security numbers, telephone numbers, IP addresses, calendar dates
and e-mail addresses are found and validated in whole texts, and each is replaced by another valid one of its
format: same length, same separators, same classes of characters, check digits that hold. The replacement is a permutation of
the format's values, chosen by the key: equal values get equal pseudonyms in all documents, different
ones different, and with the key the original comes back (reveal=True). What fails its validation stays.

Finding: wherever a pattern begins, the kinds are tried in order, and of a kind whose end is open (cards, IBANs, telephone numbers) each end
that leaves a whole word: cards of usual lengths first, IBANs of their country's length first, then the longest. The leftmost valid values
win; what they cover is not looked at again. So a value is found whatever digits or capitals follow it, and its pseudonym depends on nothing but itself.
A pseudonym may by chance turn its neighbours into a valid value (a number before a card, once in ten); a second scan, as reveal=True makes it, then
finds another value there, and that one original does not come back.

Two kinds of network, both of ROUNDS rounds keyed by SHA-256:
- mixed(a, b): numbers in [0, a * b) as a pair of residues, each in turn shifted by a keyed function of the other;
  for values whose format is a range: dates (days of a 200-year cycle), North American telephone numbers, IP addresses, social security numbers.
- classes: strings as two halves, each character in turn shifted within its class (digits, small or capital letters)
  by a keyed function of the other half; for card numbers, IBANs, other telephone numbers and e-mail addresses.

All of it is column expressions: no row leaves the JVM. No pattern repeats a group without bound and each value is at most HEAD long (but for an address's
domain), so the cost follows the length of a text. A date is the same day whatever its notation, and keeps its notation. Dates between slashes, points or hyphens are
read day first and, where that is no date, month first; a date keeps whether its day is above 12 (the permutation is walked on until it does), so that its pseudonym is read the same way.
Addresses and IBANs are the same value in capitals and small letters, and keep their case. Not found: IP addresses of version 6, dates without leading zeros or in words, names and postal addresses.

The key is the caller's: who has it can reveal the originals.

Defined results: a null text stays null, and an empty one empty; a text without personal data is unchanged; rows are independent, so repeated rows give
repeated results; other columns stay as they are, whatever their names, but that `into` takes the place of a column of its name. A pseudonym may by chance
equal its original (a fixed point of the permutation), once in as many values as the format has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.spans import folded, gaps, matches

ROUNDS = 8
#: Steps after which a pseudonym that is still read as another sort of value stays; that many are wanted once in 10**12 values.
WALK = 64
#: What is looked for, in this order; each as a whole word. Fixed formats; an address's local part has at most 64 characters, a label 63.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?=\.)[A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "iban": r"[A-Za-z]{2}[0-9]{2}(?:[ \xA0]?[A-Za-z0-9]{4}){2,7}(?:[ \xA0]?[A-Za-z0-9]{1,3})?",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",
    "card": r"[0-9]{4}(?:\.[0-9]{4}){3}|[0-9](?:[ \xA0-]?[0-9]){11,18}",
}
WORD = "[A-Za-z0-9_]"
#: What follows a value: no word character, or behind a date the time of day.
ENDS = dict.fromkeys(PATTERNS, f"(?!{WORD})") | {"date": f"(?:(?!{WORD})|(?=T[0-9]{{2}}:?[0-9]{{2}}))"}
#: Where a value may begin, and from there what its kind and end are told from: at most HEAD characters, or a whole address.
HEAD = 50
#: A value begins behind no word character; a telephone number in brackets behind any.
BEGIN = f"(?:(?<!{WORD})|(?=\\())(?=" + "|".join(f"(?:{p}){ENDS[k]}" for k, p in PATTERNS.items()) + ")"
BEGUN = f"{BEGIN}(?=({PATTERNS['email']}{ENDS['email']}|[\\s\\S]{{1,{HEAD}}}))"
#: Kinds whose matches may be followed by what looks like more of them, beside cards.
LONG = ("iban", "phone")
#: Digits of a card, the more usual first.
CARD_LENGTHS = (16, 15, 14, 13, 19, 18, 17, 12)
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
#: What every match has, to pass over texts at once: an address two digits with at most a point between them, a card with at most a space, point or hyphen.
HINT = r"[0-9][ .\xA0-]?[0-9]|@"
#: First day and length of a cycle of dates: 250 * 292 days from 1900-01-01.
CYCLE_START, CYCLE_A, CYCLE_B = "1900-01-01", 250, 292


def with_(value: Column, to) -> Column:
    """to(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), to), 1)


def keyed(key: str, *parts: Column) -> Column:
    """A number below 16**15 from the key and parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 256), 1, 15), 16, 10).cast("long")


def rounds(reveal: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if reveal else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def mixed(value: Column, a: int, b: int, key: str, tweak: str, reveal: bool = False) -> Column:
    """A keyed permutation of [0, a * b): even rounds shift value div b within a, odd rounds value mod b within b."""
    sign = -1 if reveal else 1

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        shift = keyed(key, F.lit(tweak), i, F.when(even, s["r"]).otherwise(s["l"]))
        return F.struct(
            F.when(even, F.pmod(s["l"] + sign * (shift % a), F.lit(a).cast("long"))).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * (shift % b), F.lit(b).cast("long"))).alias("r"),
        )

    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))
    return F.aggregate(rounds(reveal), start, step, lambda s: s["l"] * b + s["r"])


def shifted(text: Column, by: Column, sign: int, key: str, tweak: str) -> Column:
    """Each digit or letter of text moved within its class by a keyed function of `by` and its place."""

    def one(c: Column, i: Column) -> Column:
        n = F.ascii(c)

        def within(first: int, size: int) -> Column:
            return F.char(F.lit(first) + F.pmod(n - first + sign * (keyed(key, F.lit(tweak), by, i + 1) % size).cast("int"), F.lit(size)))

        return F.when(n.between(48, 57), within(48, 10)).when(n.between(97, 122), within(97, 26)).when(n.between(65, 90), within(65, 26)).otherwise(c)

    return F.array_join(F.transform(chars(text), one), "")


def classes(text: Column, key: str, tweak: str, reveal: bool = False) -> Column:
    """A keyed permutation of the strings whose characters have the classes of text's, in each place."""
    sign = -1 if reveal else 1
    half = F.floor(F.length(text) / 2).cast("int")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        round_ = lambda x, y: shifted(x, F.concat_ws(":", i.cast("string"), y), sign, key, tweak)
        return F.struct(F.when(even, round_(s["l"], s["r"])).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(round_(s["r"], s["l"])).alias("r"))

    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    return F.aggregate(rounds(reveal), start, step, lambda s: F.concat(s["l"], s["r"]))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[\\s\\S]"), F.lit(0))


def dressed(format_: Column, bare: Column, kept: str) -> Column:
    """bare's characters put in the places of format_ that match the class `kept`; all others of format_ stay."""

    def of(new: Column) -> Column:
        return F.aggregate(
            chars(format_),
            F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
            lambda s, c: F.when(c.rlike(kept), F.struct((s["at"] + 1).alias("at"), F.concat(s["out"], F.substring(new, s["at"], F.lit(1))).alias("out"))).otherwise(
                F.struct(s["at"].alias("at"), F.concat(s["out"], c).alias("out"))
            ),
            lambda s: s["out"],
        )

    return with_(bare, of)


def luhn_sum(bare: Column) -> Column:
    """The sum of a number's digits, each second one from the right doubled and reduced to one digit."""
    back = F.reverse(bare)
    as_is = F.regexp_replace(back, "(.)(.?)", "$1")
    doubled = F.translate(F.regexp_replace(back, "(.)(.?)", "$2"), "0123456789", "0246813579")
    return F.aggregate(F.regexp_extract_all(F.concat(as_is, doubled), F.lit("."), F.lit(0)), F.lit(0), lambda s, c: s + c.cast("int"))


def luhn(payload: Column) -> Column:
    """The check digit of a card number without its last digit."""
    return F.pmod(-luhn_sum(F.concat(payload, F.lit("0"))), F.lit(10)).cast("string")


def mod97(text: Column) -> Column:
    """The remainder by 97 of digits and capital letters, A as 10 to Z as 35."""
    return F.aggregate(
        chars(text),
        F.lit(0),
        lambda s, c: F.when(c.rlike("[A-Z]"), s * 100 + F.ascii(c) - 55).otherwise(s * 10 + c.cast("int")) % 97,
    )


def day(text: Column, month_first: bool = False) -> Column:
    """The calendar date of a match that is read day first, or month first; null if it is none."""
    month, date = (1, 4) if month_first else (4, 1)
    parts = F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, month, 2), F.substring(text, date, 2))
    return F.try_to_date(F.when(text.rlike("^[0-9]{4}-"), text).otherwise(parts), "yyyy-MM-dd")


def cased(like: Column, text: Column) -> Column:
    """text with the letters' case of `like`, place by place."""
    return F.array_join(F.zip_with(chars(like), chars(text), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).when(a.rlike("[a-z]"), F.lower(b)).otherwise(b)), "")


def _date(m: Column, key: str, reveal: bool) -> Column:
    cycle = CYCLE_A * CYCLE_B
    date = lambda n: F.date_add(F.lit(CYCLE_START).cast("date"), n.cast("int"))
    late = lambda n: F.dayofmonth(date(n)) > 12
    once = lambda n: F.floor(n / cycle) * cycle + mixed(F.pmod(n, F.lit(cycle)), CYCLE_A, CYCLE_B, key, "date", reveal)
    walk = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(n), lambda x, _: F.when(late(x) == late(n), x).otherwise(once(x)))
    read = F.coalesce(day(m), day(m, True))
    moved = with_(F.datediff(read, F.lit(CYCLE_START).cast("date")).cast("long"), walk)

    def shown(to: Column) -> Column:
        parts = [F.when(day(m).isNull(), F.date_format(to, a)).otherwise(F.date_format(to, b)) for a, b in (("MM", "dd"), ("dd", "MM"))]
        return F.when(m.rlike("^[0-9]{4}-"), F.date_format(to, "yyyy-MM-dd")).otherwise(F.concat(parts[0], F.substring(m, 3, 1), parts[1], F.substring(m, 6, 1), F.date_format(to, "yyyy")))

    return with_(date(moved), shown)


def _phone(m: Column, key: str, reveal: bool) -> Column:
    code = F.when(m.startswith("+"), F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[^0-9])|^\+[0-9]", 0)).otherwise(F.lit(""))
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    bare = digits(rest)
    american = lambda x: x.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$") & code.isin("+1", "")
    number = (F.substring(bare, 1, 3).cast("long") - 200) * 8_000_000 + F.substring(bare, 4, 7).cast("long") - 2_000_000
    to = with_(mixed(number, 800, 8_000_000, key, "phone", reveal), lambda x: F.concat((F.floor(x / 8_000_000) + 200).cast("string"), (x % 8_000_000 + 2_000_000).cast("string")))
    # what is no American number becomes none, or its pseudonym would be read as one
    once = lambda x: classes(x, key, "phone", reveal)
    other = with_(bare, lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(x), lambda y, _: F.when(american(y), once(y)).otherwise(y)))
    return F.concat(code, dressed(rest, F.when(american(bare), to).otherwise(other), "[0-9]"))


def _card(m: Column, key: str, reveal: bool) -> Column:
    payload = with_(digits(m), lambda d: F.substring(d, F.lit(1), F.length(d) - 1))
    return dressed(m, with_(classes(payload, key, "card", reveal), lambda x: F.concat(x, luhn(x))), "[0-9]")


def _ssn(m: Column, key: str, reveal: bool) -> Column:
    area = F.substring(m, 1, 3).cast("long")
    value = (F.when(area > 666, area - 2).otherwise(area - 1)) * (99 * 9999) + (F.substring(m, 5, 2).cast("long") - 1) * 9999 + F.substring(m, 8, 4).cast("long") - 1

    def shown(x: Column) -> Column:
        a = F.floor(x / (99 * 9999)).cast("long")
        return F.format_string("%03d-%02d-%04d", F.when(a >= 665, a + 2).otherwise(a + 1), F.floor(x % (99 * 9999) / 9999).cast("long") + 1, x % 9999 + 1)

    return with_(mixed(value, 898, 99 * 9999, key, "ssn", reveal), shown)


def _ip(m: Column, key: str, reveal: bool) -> Column:
    value = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    return with_(mixed(value, 65536, 65536, key, "ip", reveal), lambda x: F.concat_ws(".", *((F.floor(x / 256**k) % 256).cast("string") for k in (3, 2, 1, 0))))


def _iban(m: Column, key: str, reveal: bool) -> Column:
    bare = F.upper(bare_iban(m))
    country, account = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare))
    check = lambda x: F.lpad((98 - mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0")
    return cased(m, dressed(m, with_(classes(account, key, "iban", reveal), lambda x: F.concat(country, check(x), x)), "[A-Za-z0-9]"))


def bare_iban(m: Column) -> Column:
    return F.regexp_replace(m, r"[ \xA0]", "")


def _email(m: Column, key: str, reveal: bool) -> Column:
    """Both the local part and the first label of the domain; its other labels stay."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    label = F.substring_index(domain, ".", 1)
    shown = lambda x: F.concat(F.substring(x, F.lit(1), F.length(local)), F.lit("@"), F.substring(x, F.length(local) + 1, F.length(x)), F.substring(domain, F.length(label) + 1, F.length(domain)))
    both = F.concat(local, label)
    return with_(cased(both, classes(F.lower(both), key, "email", reveal)), shown)


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a kind's pattern is one of its values."""
    if kind == "card":
        return luhn_sum(digits(m)) % 10 == 0
    if kind == "iban":
        bare = F.upper(bare_iban(m))
        # words in small letters are many: there the country must be a listed one and the length its own
        capital = m.rlike(r"^[A-Z0-9 \xA0]*$") | (m.rlike(r"^[a-z0-9 \xA0]*$") & usual_length(m, False))
        # IBANs whose check digits exceed 98 or fall below 2 are not issued; as the remainder tells them apart from none, they do not pass
        return capital & F.length(bare).between(15, 34) & F.substring(bare, 3, 2).between("02", "98") & (mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1)
    if kind == "date":
        return F.coalesce(day(m), day(m, True)).isNotNull()
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda x: (x.cast("int") > 255) | ((F.length(x) > 1) & x.startswith("0")))
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


MADE = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def moved_to(kind: Column, m: Column, key: str, reveal: bool = False) -> Column:
    """The pseudonym of a value of a kind; null where the kind is null."""
    out = F
    for k, f in MADE.items():
        out = out.when(kind == k, f(m, key, reveal))
    return out


def usual_length(iban: Column, unlisted: bool = True) -> Column:
    """Whether an IBAN has its country's length; `unlisted` if its country is not listed."""
    country = F.upper(F.substring(iban, 1, 2))
    length = F.length(bare_iban(iban))
    out = F.lit(unlisted)
    for n, countries in IBAN_LENGTHS.items():
        out = F.when(country.isin(*countries.split()), length == n).otherwise(out)
    return out


def best_valid(kind: str, longest: Column) -> Column:
    """The value at the start of the longest match of a kind's pattern, or null."""
    if kind == "email":  # a domain has no empty label
        return with_(F.regexp_replace(longest, r"\.\.[\s\S]*", ""), lambda m: F.when(m.rlike(f"^(?:{PATTERNS['email']})$"), m))
    if kind == "card":
        words = F.array(*(F.regexp_extract(longest, f"^[0-9](?:[ .\\xA0-]?[0-9]){{{n - 1}}}(?!{WORD})", 0) for n in CARD_LENGTHS))
        return F.get(F.filter(words, lambda w: (w != "") & valid(kind, w)), F.lit(0))
    if kind not in LONG:
        return F.when(valid(kind, longest), longest)
    whole = f"^(?:{PATTERNS[kind]})$"
    ends = F.filter(F.sequence(F.length(longest), F.lit(1), F.lit(-1)), lambda k: ~F.substring(longest, k + 1, F.lit(1)).rlike(WORD) & F.substring(longest, F.lit(1), k).rlike(whole))
    words = F.filter(F.transform(ends, lambda k: F.substring(longest, F.lit(1), k)), lambda w: valid(kind, w))
    if kind == "iban":
        words = with_(words, lambda ws: F.concat(F.filter(ws, lambda w: usual_length(w)), ws))
    return F.get(words, F.lit(0))


def first_value(head: Column) -> Column:
    """struct<kind, word> of the value at the start of a string, or null."""

    def value(kind: str, pattern: str) -> Column:
        longest = F.regexp_extract(head, f"^(?:{pattern}){ENDS[kind]}", 0)
        word = with_(longest, lambda x: F.when(x != "", best_valid(kind, x)))
        return with_(word, lambda w: F.when(w.isNotNull(), F.struct(F.lit(kind).alias("kind"), w.alias("word"))))

    return F.coalesce(*(value(k, p) for k, p in PATTERNS.items()))


def spans(text: Column) -> Column:
    """struct<before, found: array<struct<kind, word, rest>>>: the text as what lies before the first place where a value may begin and, for each such
    place, the value there (null if none, or if an earlier one covers the place) and what follows up to the next place."""

    def step(s: Column, x: Column) -> Column:
        taken = (s["state"] == 0) & x["value"].isNotNull()
        covered = F.when(taken, F.length(x["value"]["word"])).otherwise(s["state"])
        n = F.length(x["piece"])
        item = F.struct(F.when(taken, x["value"]["kind"]).alias("kind"), F.when(taken, x["value"]["word"]).alias("word"), F.substring(x["piece"], covered + 1, n).alias("rest"))
        return F.struct(F.greatest(covered - n, F.lit(0)).alias("state"), F.concat(s["out"], F.array(item)).alias("out"))

    def of(pieces: Column) -> Column:
        places = F.zip_with(F.slice(pieces, F.lit(2), F.size(pieces)), matches(text, BEGUN, 1), lambda p, h: F.struct(p.alias("piece"), first_value(h).alias("value")))
        found = folded(places, F.lit(0), step, "array<struct<kind:string,word:string,rest:string>>")
        return F.struct(F.substring(pieces[0], F.lit(2), F.length(pieces[0])).alias("before"), found.alias("found"))

    # a line break in front, as an empty match at the start of a text parts nothing
    return with_(gaps(F.concat(F.lit("\n"), text), BEGIN), of)


def rewritten(found: Column, key: str, reveal: bool = False) -> Column:
    """The text that spans() took apart, with pseudonyms for its values."""
    made = F.transform(found["found"], lambda x: F.concat(F.coalesce(moved_to(x["kind"], x["word"], key, reveal), F.lit("")), x["rest"]))
    return F.concat(found["before"], F.array_join(made, ""))


def with_spans(df: DataFrame, text: str) -> DataFrame:
    """(_row: a struct of df's columns, _text, _spans: null where there is nothing to look for); one projection, so that spans are found once."""
    t = df[text]
    return df.select(F.struct(*(df[c] for c in df.columns)).alias("_row"), t.alias("_text"), F.when(t.rlike(HINT), spans(t)).alias("_spans"))


def pseudonymised(df: DataFrame, text: str, key: str, reveal: bool = False, into: str | None = None) -> DataFrame:
    """df with the text column (or a further column `into`) in pseudonyms; with reveal, from pseudonyms to originals."""
    into = into or text
    made = F.when(F.size("_spans.found") > 0, rewritten(F.col("_spans"), key, reveal)).otherwise(F.col("_text"))
    columns = [*df.columns, *[into] * (into not in df.columns)]
    return with_spans(df, text).select(*(made.alias(c) if c == into else F.col("_row")[c].alias(c) for c in columns))


def pseudonyms(df: DataFrame, doc_id: str, text: str, key: str) -> DataFrame:
    """(doc_id, text in pseudonyms, and the number of each kind replaced)."""
    rows = with_spans(df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")), "text")
    made = F.when(F.size("_spans.found") > 0, rewritten(F.col("_spans"), key)).otherwise(F.col("_text"))
    number = lambda k: F.coalesce(F.size(F.filter("_spans.found", _is(k))), F.lit(0)).cast("long")
    return rows.select(F.col("_row.doc_id").alias("doc_id"), made.alias("text"), *(number(k).alias(f"n_{k}") for k in PATTERNS))


def _is(kind: str):
    return lambda x: x["kind"] == kind
