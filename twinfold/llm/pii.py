"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by pattern and validated: card numbers by the Luhn digit, social security numbers by their
number ranges, IPv4 addresses by their octets, dates by the calendar. Each valid value is replaced by another valid value of
the same format through a keyed Feistel network, so equal values keep equal pseudonyms in every document, different
values never meet, and whoever has the key can go back (``inverse``).

* Card numbers, phone numbers and the local part of mail addresses are permuted as strings: the halves of the string take turns in
  being shifted, digit by digit and letter by letter, by a stream derived from the other half. Of card and phone numbers only
  the digits are permuted and the marks put back between them, so one number in two spellings keeps one pseudonym. A card
  number's last digit is computed anew. A phone number keeps its country code, an address its domain.
* A run of digit groups may hold more than a card number (a list number before it, an expiry or a check number behind it).
  Every piece of 13 to 19 digits that begins and ends at a group border is tried, from the left; pieces of 16 and 15
  digits go before others that begin with them or overlap them.
* IPv4 addresses, social security numbers and dates are numbered through and permuted as numbers a * b + c, whose two parts
  take turns in being shifted modulo their size. Dates cover 73,000 days from 1900-01-01.

Not found: phone numbers without one of the marks of ``PATTERNS`` (``555 123 4567``), foreign groupings (``+44 20 7946 0958``),
month before day (``12/31/1999``), mail names in other letters; of a name with an apostrophe the part behind it is replaced.
``inverse`` finds the same pieces again but for one case: where groups that belong to no card stand before one so that together they
could be another of 15 or 16 digits, one in ten pseudonyms completes that one by chance.

The round function is SHA-256 over key, kind, length, round and the other half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

_END = r"(?![0-9A-Za-z])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kind and pattern, in order of preference where several fit at one place. Runs start at their left end and are
#: possessive, so no text makes the search go back over them.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9A-Za-z])",
    "ssn": rf"(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?!-){_END}",
    "date": rf"(?<![0-9A-Za-z./-])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}})(?![/-]){_END}",
    "phone": rf"(?<![0-9A-Za-z+])(?:\+[0-9]{{1,3}}[ -]?)?(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[-.])[0-9]{{3}}[-. ][0-9]{{4}}{_END}",
}
#: A group after a space that begins a value of another kind ends a run of card digits; two groups of ten digits and more
#: never belong to one card number, so a run ends between them too.
_OTHER = "|".join(PATTERNS[k] for k in ("ip", "ssn", "date", "phone"))
PATTERNS["card"] = (rf"(?<![0-9A-Za-z])(?=(?:[ -]?[0-9]){{13}})[0-9]++{_END}"
                    rf"(?:(?: (?!{_OTHER})|-)(?!(?<=[0-9]{{10}}[ -])[0-9]{{10}})[0-9]++{_END})*+")
ANY = "|".join(PATTERNS.values())

#: Days that dates are permuted among: 250 * 292 from this one on.
FIRST_DAY = "1900-01-01"
DATE_PARTS = (250, 292)
#: Areas 001-899 without 666; groups 01-99 with serials 0001-9999.
SSN_PARTS = (898, 99 * 9999)
IP_PARTS = (1 << 16, 1 << 16)
#: How dates are written; day before month.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy")


def _digest(key: str, *parts) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def _shift_text(text: Column, stream: Column, sign: int) -> Column:
    """Letters and digits of ``text`` moved within their class by the bytes of a hex ``stream`` (used in a circle)."""
    def moved(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(stream, 1 + 2 * F.pmod(i, F.lit(32)), F.lit(2)), 16, 10).cast("int") * sign
        letter = lambda base: F.char(F.pmod(F.ascii(c) - base + by, F.lit(26)) + base)
        return (F.when(c.between("0", "9"), F.pmod(F.ascii(c) - 48 + by, F.lit(10)).cast("string"))
                .when(c.between("a", "z"), letter(97)).when(c.between("A", "Z"), letter(65)).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), moved), "")


def feistel_text(text: Column, kind: str, key: str, inverse: bool = False) -> Column:
    """Keyed permutation of strings that keeps length, marks, and which places hold digits, small and capital letters."""
    half = F.floor(F.length(text) / 2).cast("int")
    halves = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text) - half).alias("r"))

    def forth(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), _shift_text(s["l"], _digest(key, kind, F.length(s["l"]), i, s["r"]), 1).alias("r"))

    def back(s: Column, i: Column) -> Column:
        return F.struct(_shift_text(s["r"], _digest(key, kind, F.length(s["r"]), i, s["l"]), -1).alias("l"), s["l"].alias("r"))

    order = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])
    return F.aggregate(order, halves, back if inverse else forth, lambda s: F.concat(s["l"], s["r"]))


def feistel_number(x: Column, parts: tuple[int, int], kind: str, key: str, inverse: bool = False) -> Column:
    """Keyed permutation of the numbers 0 .. parts[0] * parts[1] - 1."""
    def by(i: Column, other: Column) -> Column:
        return F.conv(F.substring(_digest(key, kind, i, other), 1, 12), 16, 10).cast("long")

    size = lambda i: F.when(i % 2 == 0, F.lit(parts[0]).cast("long")).otherwise(F.lit(parts[1]).cast("long"))
    start = F.struct(F.floor(x / parts[1]).cast("long").alias("a"), F.pmod(x, F.lit(parts[1])).cast("long").alias("b"))

    def forth(s: Column, i: Column) -> Column:
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + by(i, s["b"]), size(i)).alias("b"))

    def back(s: Column, i: Column) -> Column:
        return F.struct(F.pmod(s["b"] - by(i, s["a"]), size(i)).alias("a"), s["a"].alias("b"))

    order = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])
    return F.aggregate(order, start, back if inverse else forth, lambda s: s["a"] * parts[1] + s["b"])


def _luhn_digit(body: Column) -> Column:
    """The digit that completes ``body`` (digits and marks) to a valid number, as text."""
    digits = F.split(F.reverse(F.regexp_replace(body, "[^0-9]", "")), "")
    worth = lambda c, i: F.when(i % 2 == 1, F.ascii(c) - 48).otherwise(
        F.when(F.ascii(c) >= 53, (F.ascii(c) - 48) * 2 - 9).otherwise((F.ascii(c) - 48) * 2))
    total = F.aggregate(F.transform(digits, worth), F.lit(0), lambda a, v: a + v)
    return F.pmod(-total, F.lit(10)).cast("string")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _laid(template: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of a short ``template``."""
    at = lambda i: i + 1 - F.length(F.regexp_replace(F.substring(template, F.lit(1), i), "[0-9]", ""))
    return F.array_join(F.transform(F.split(template, ""), lambda c, i: F.when(
        c.between("0", "9"), F.substring(digits, at(i), F.lit(1))).otherwise(c)), "")


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


#: Numbers of digits a card number may have, the likelier ones first.
CARD_DIGITS = (16, 15, 14, 13, 19, 18, 17)


def _card_pieces(groups: Column) -> Column:
    """Per group the best valid card number that begins there: rank, number of groups, digits; null if there is none."""
    rank = lambda d: F.array_position(F.array(*[F.lit(n) for n in CARD_DIGITS]), F.length(d))

    def piece(i: Column, n: Column) -> Column:
        return _bound(F.array_join(F.slice(groups, i + 1, n), ""), lambda d: F.when(
            rank(d) > 0, F.when(F.right(d, F.lit(1)) == _luhn_digit(F.substring(d, F.lit(1), F.length(d) - 1)),
                                F.struct(rank(d).alias("rank"), n.alias("n"), d.alias("digits")))))

    best = lambda i: F.array_min(F.transform(
        F.sequence(F.lit(1), F.least(F.lit(max(CARD_DIGITS)), F.size(groups) - i)), lambda n: piece(i, n)))
    return F.transform(F.sequence(F.lit(0), F.size(groups) - 1), best)


def _cards(m: Column, key: str, inverse: bool) -> Column:
    """Struct of a run of digit groups with its card numbers replaced, and the list of their pseudonyms."""
    words = F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0))
    return _bound(words, lambda w: _bound(F.transform(w, _only_digits), lambda groups: _bound(
        _bound(_card_pieces(groups), _chosen), lambda taken: _filled(w, groups, taken, key, inverse))))


def _chosen(best: Column) -> Column:
    """The pieces that are replaced, from the left: first group, number of groups, digits."""
    def step(s: Column, i: Column) -> Column:
        mine = F.element_at(best, i + 1)
        yields = (mine["rank"] > 2) & F.exists(F.slice(best, i + 2, mine["n"] - 1), lambda o: F.coalesce(o["rank"] <= 2, F.lit(False)))
        piece = F.struct(i.alias("i"), mine["n"].alias("n"), mine["digits"].alias("digits"))
        return F.when((i < s["next"]) | mine.isNull() | yields, s).otherwise(
            F.struct((i + mine["n"]).alias("next"), F.concat(s["taken"], F.array(piece)).alias("taken")))

    none = F.array().cast("array<struct<i:int,n:int,digits:string>>")
    return F.aggregate(F.sequence(F.lit(0), F.size(best) - 1), F.struct(F.lit(0).alias("next"), none.alias("taken")), step,
                       lambda s: s["taken"])


def _filled(words: Column, groups: Column, taken: Column, key: str, inverse: bool) -> Column:
    """What ``_cards`` gives, from a run's groups with and without the mark before them and its chosen pieces."""
    def new_digits(digits: Column) -> Column:
        body = feistel_text(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key, inverse)
        return _bound(body, lambda d: F.concat(d, _luhn_digit(d)))

    def laid(i: Column, n: Column, digits: Column) -> Column:
        """The digits over n groups from i on, with the marks between these."""
        def step(s: Column, g: Column) -> Column:
            size = F.length(F.element_at(groups, g + 1))
            word = F.element_at(words, g + 1)
            mark = F.when((g > i) & (F.length(word) > size), F.left(word, F.lit(1))).otherwise("")
            return F.struct((s["at"] + size).alias("at"), F.concat(s["text"], mark, F.substring(digits, s["at"], size)).alias("text"))

        return F.aggregate(F.sequence(i, i + n - 1), F.struct(F.lit(1).alias("at"), F.lit("").alias("text")), step, lambda s: s["text"])

    def render(done: Column) -> Column:
        end = lambda k: F.when(k > 0, F.element_at(taken, k)["i"] + F.element_at(taken, k)["n"]).otherwise(F.lit(0))
        between = lambda a, n: F.array_join(F.slice(words, a + 1, n), "")
        # A piece's first word gives the mark before the piece.
        before = lambda p, k: F.concat(between(end(k), p["i"] - end(k)), F.when(
            p["i"] > 0, F.left(F.element_at(words, p["i"] + 1), F.lit(1))).otherwise(""))
        filled = F.transform(taken, lambda p, k: F.concat(before(p, k), F.element_at(done, k + 1)))
        last = end(F.size(taken))
        return F.struct(F.concat(F.array_join(filled, ""), between(last, F.size(words) - last)).alias("text"), done.alias("listed"))

    new = F.transform(taken, lambda p: _bound(new_digits(p["digits"]), lambda d: laid(p["i"], p["n"], d)))
    return _bound(new, render)


def _email(m: Column, key: str, inverse: bool) -> Column:
    return F.concat(feistel_text(F.substring_index(m, "@", 1), "email", key, inverse), F.lit("@"), F.substring_index(m, "@", -1))


def _phone(m: Column, key: str, inverse: bool) -> Column:
    code = F.regexp_extract(m, r"^(\+[0-9]+[ -]?)?", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _laid(rest, feistel_text(_only_digits(rest), "phone", key, inverse)))


def _ip(m: Column, key: str, inverse: bool) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o)
    new = feistel_number(number, IP_PARTS, "ip", key, inverse)
    return F.concat_ws(".", *[F.pmod(F.floor(new / (1 << shift)), F.lit(256)).cast("string") for shift in (24, 16, 8, 0)])


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    """Null outside the number ranges."""
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    number = (area - F.when(area > 666, 2).otherwise(1)) * SSN_PARTS[1] + (group - 1) * 9999 + serial - 1
    new = feistel_number(number, SSN_PARTS, "ssn", key, inverse)
    new_area = F.floor(new / SSN_PARTS[1]) + 1
    new_area = new_area + F.when(new_area >= 666, 1).otherwise(0)
    rest = F.pmod(new, F.lit(SSN_PARTS[1]))
    pad = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")
    return F.when(valid, F.concat_ws("-", pad(new_area, 3), pad(F.floor(rest / 9999) + 1, 2), pad(F.pmod(rest, F.lit(9999)) + 1, 4)))


def _date(m: Column, key: str, inverse: bool) -> Column:
    """Null for days that do not exist or are not covered."""
    first, days = F.lit(FIRST_DAY).cast("date"), DATE_PARTS[0] * DATE_PARTS[1]
    out = F.lit(None).cast("string")
    for form, mark in zip(DATE_FORMATS, "-/."):
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        number = F.datediff(day, first)
        new = feistel_number(number.cast("long"), DATE_PARTS, "date", key, inverse)
        out = F.when(m.contains(mark), F.when(number.between(0, days - 1), F.date_format(F.date_add(first, new.cast("int")), form))).otherwise(out)
    return out


_MAKERS = {"email": _email, "ip": _ip, "ssn": _ssn, "date": _date, "phone": _phone}


def _kind(m: Column) -> Column:
    """Which pattern a match of ``ANY`` belongs to."""
    return (F.when(m.contains("@"), "email").when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
            .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
            .when(m.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})$"), "date")
            .when(m.rlike(rf"^({PATTERNS['phone']})$"), "phone").otherwise("card"))


def _pseudonym(m: Column, key: str, inverse: bool) -> Column:
    """Struct of a match's kind, its new text and the list of pseudonyms in that (empty if nothing in it is valid)."""
    kind = _kind(m)
    one = F.lit(None).cast("string")
    for name, make in _MAKERS.items():
        one = F.when(kind == name, make(m, key, inverse)).otherwise(one)
    none = F.array().cast("array<string>")
    single = _bound(one, lambda p: F.struct(F.coalesce(p, m).alias("text"), F.when(p.isNull(), none).otherwise(F.array(p)).alias("listed")))
    new = F.when(kind == "card", _cards(m, key, inverse)).otherwise(single)
    return _bound(new, lambda n: F.struct(kind.alias("kind"), n["text"].alias("text"), n["listed"].alias("listed")))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with the text's personal data replaced, and ``pii``: kind and pseudonym of each replaced value, in order.

    Values that fail validation stay as they are and are not listed. Null text stays null, its list (and that of an empty
    text) is empty. Every row and column stays (a column ``pii`` is replaced); repeated rows get equal results; an empty
    table gives an empty result. ``inverse`` undoes the replacement with the same key.
    """
    names = docs.columns
    low = [c.lower() for c in names]
    at = low.index(text_col.lower())
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    text = F.col(f"c{at}")
    some = text.rlike("[0-9@]")
    found = F.when(some, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: _pseudonym(m, key, inverse)))
    # The matches become a column before they are read: an explode is never folded into the expressions above it.
    rows = rows.select("*", F.explode(F.array(F.struct(found.alias("found")))).alias("m"))
    gaps = F.split(text, ANY, -1)
    filled = F.zip_with(gaps, "m.found", lambda gap, x: F.concat(gap, F.coalesce(x["text"], F.lit(""))))
    new = F.when(F.size("m.found") > 0, F.array_join(filled, "")).otherwise(text)
    listed = F.flatten(F.transform("m.found", lambda x: F.transform(
        x["listed"], lambda p: F.struct(x["kind"].alias("kind"), p.alias("pseudonym")))))
    empty = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    plain = [(new if i == at else F.col(f"c{i}")).alias(n) for i, n in enumerate(names) if low[i] != "pii"]
    return rows.select(*plain, F.coalesce(listed, empty).alias("pii"))
