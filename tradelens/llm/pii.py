"""Format-preserving pseudonyms for personal data (operator 8, native).

Found and validated: e-mail addresses, payment card numbers (13-19 digits,
Luhn check), telephone numbers with ten national digits, US social security
numbers (issued ranges), IPv4 addresses (octets to 255) and calendar dates
(year-month-day and day-month-year, years 1800-2199).

Every value is permuted within its own format by a keyed Feistel network:
the value is split in two halves x in Z_a and y in Z_b and every round maps
(x, y) to (y, x + f(y) mod a), a and b taking turns.  That is a bijection for
any a and b, so nothing needs to be rejected: card numbers stay Luhn-valid
(the check digit is recomputed), telephone numbers keep country code, area
and exchange rules, dates stay dates (day numbers within a 400-year cycle of
189 * 773 days), addresses stay addresses.  The round function is SHA-256 of
key, kind, round and half.  Letters and digits of an e-mail's local part are
shifted within their class by the same network over strings.

Equal values get equal pseudonyms in every document, and different values of
a kind different ones; separators stay in place.  Everything is DataFrame
expressions over one row; nothing is shuffled.

Card numbers are looked for in runs of digit groups joined by single blanks
or hyphens: every stretch of whole groups with 13-19 digits is a candidate, so
that an expiry date, security code or other number beside a card does not hide
it.  Of overlapping candidates that pass Luhn the customary groupings come
first, numbers of a known network before others, longer before shorter.
Grouped numbers of no known network count only at an end of their run, other
groupings only where no other kind of finding begins inside.

Defined results: a null text stays null with no finding, an empty text stays
empty; text outside findings is unchanged; numbers that fail validation are
unchanged; repeated rows get equal results; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import named

ROUNDS = 8

# Fixed formats.  Order matters: at one place the first that fits is taken.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "date": r"(?<![\d/.-])(?:\d{4}([-/])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # a run of digit groups, cut before a group where another kind begins; the cards in it are chosen by _cards
    "card": "",
}


def _unnumbered(kind: str, tag: str) -> str:
    """The pattern with named back references, to stand beside others."""
    return PATTERNS[kind].replace("([-/])", f"(?<{tag}1>[-/])").replace(r"\1", rf"\k<{tag}1>").replace("([-/.])", f"(?<{tag}2>[-/.])").replace(r"\2", rf"\k<{tag}2>")


_OTHER = "|".join(f"(?:{_unnumbered(k, 's')})" for k in ("ip", "date", "phone", "ssn"))
_MIN_DIGITS = r"(?<!\d)(?=\d(?:[ -]?\d){12})"
RUN = rf"{_MIN_DIGITS}\d++(?:[ -]\d++)*+"
PATTERNS["card"] = rf"{_MIN_DIGITS}\d++(?:[ -](?!{_OTHER})\d++)*+"
ANY = "|".join(f"(?:{_unnumbered(k, 't')})" for k in PATTERNS)
# customary groupings: the usual ones, and those that may also be a usual one and a number beside it
USUAL_CARD = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5})$"
OTHER_CARD = r"^(?:\d{4}([ -])\d{4}\1\d{4}\1(?:\d{4}\1)?\d{1,3}|\d{6}[ -]\d{13})$"
NETWORK = r"^(?:4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|(?:6011|64[4-9]\d|65\d\d|62\d\d|35\d\d)\d{12,15}|(?:5[06-9]|6\d)\d{11,17})$"
# a cheap test first: every kind has an @ or two digits with at most a separator between
MAYBE = r"@|[0-9][-./ )]?[0-9]"

CYCLE_DAYS = 146097  # days of 400 Gregorian years = 189 * 773
FIRST_DAY = "1800-01-01"


def _hash(key: str, kind: str, round_: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), half.cast("string")).cast("binary"), 256)


def _feistel(x: Column, y: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Keyed permutation of Z_a x Z_b (``ROUNDS`` is even, so sides end where they began)."""

    def step(acc: Column, i: Column) -> Column:
        f = F.conv(F.substring(_hash(key, kind, i, acc["y"]), 1, 15), 16, 10).cast("long")
        return F.struct(acc["y"].alias("x"), ((acc["x"] + f) % F.when(i % 2 == 1, F.lit(a).cast("long")).otherwise(F.lit(b).cast("long"))).alias("y"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _shift(half: Column, digest: Column, least: int = 0) -> Column:
    """Shift each letter or digit within its class by a byte of the digest,
    by ``least`` places at least; an empty half stays empty."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for alphabet in (lower, upper, digits):
            at = F.instr(F.lit(alphabet), c) - 1
            out = F.when(at >= 0, F.substr(F.lit(alphabet), (at + least + by % (len(alphabet) - least)) % len(alphabet) + 1, F.lit(1))).otherwise(out)
        return out

    return F.when(half == "", half).otherwise(F.array_join(F.transform(F.split(half, ""), one), ""))


def _feistel_text(text: Column, key: str, kind: str) -> Column:
    """The network over the two halves of a string; classes and length stay.
    One character has no two halves: it is shifted by a keyed number of places."""
    cut = F.floor(F.char_length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), cut).alias("x"), F.substr(text, cut + 1, F.lit(1 << 20)).alias("y"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda acc, i: F.struct(acc["y"].alias("x"), _shift(acc["x"], _hash(key, kind, i, acc["y"])).alias("y")))
    single = _shift(text, _hash(key, kind, F.lit(0), F.lit("")), least=1)
    return F.when(F.char_length(text) == 1, single).otherwise(F.concat(out["x"], out["y"]))


def _bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and use it many times."""
    return F.transform(F.array(value), fn)[0]


def _pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _number(text: Column, start: Column | int, length: Column | int) -> Column:
    pos = F.lit(start) if isinstance(start, int) else start
    size = F.lit(length) if isinstance(length, int) else length
    return F.coalesce(F.substr(text, pos, size).try_cast("long"), F.lit(0).cast("long"))


def _refill(template: Column, digits: Column) -> Column:
    """Digits of ``template`` replaced in order by ``digits``; other characters stay."""

    def one(c: Column, i: Column) -> Column:
        before = F.char_length(_digits(F.substr(template, F.lit(1), i + 1)))
        return F.when(c.rlike("^[0-9]$"), F.substr(digits, before, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(template, ""), one), "")


def _luhn_sum(payload: Column, from_right: int) -> Column:
    """Luhn sum; ``from_right`` 0 doubles the last digit, 1 the one before it."""
    chars = F.reverse(F.split(payload, ""))

    def add(acc: Column, c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == from_right, twice).otherwise(d)

    pairs = F.transform(chars, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), lambda acc, p: add(acc, p["c"], p["i"]))


def _card(m: Column, key: str) -> Column:
    def permuted(d: Column) -> Column:
        n = F.char_length(d)
        out = F.lit(None).cast("string")
        for size in range(13, 20):
            u, v = (size - 1) // 2, size - 1 - (size - 1) // 2
            z = lambda d, u=u, v=v, size=size: _bind(
                _feistel(_number(d, 1, u), _number(d, u + 1, v), 10**u, 10**v, key, f"card{size}"),
                lambda r: F.concat(_pad(r["x"], u), _pad(r["y"], v)),
            )
            out = F.when(n == size, z(d)).otherwise(out)
        return _bind(out, lambda p: F.concat(p, ((10 - _luhn_sum(p, 0) % 10) % 10).cast("string")))

    return _bind(_digits(m), lambda d: _refill(m, permuted(d)))


def _pieces(text: Column, pattern: str, fn) -> Column:
    """``text`` cut at the matches of ``pattern``: an array of (kind, value),
    kind "" between matches; ``fn`` gives the pieces of one match."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    return F.flatten(F.transform(parts, lambda z: F.when(z["match"].isNull(), F.array(_piece("", z["gap"]))).otherwise(F.concat(F.array(_piece("", z["gap"])), fn(z["match"])))))


def _piece(kind: str | Column, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))


def _cards(run: Column, customary: bool) -> Column:
    """Pieces of a run of digit groups: its card numbers and what is between.
    ``customary``: only those in a customary grouping, and a run that is one
    number of a known network."""
    tokens = F.regexp_extract_all(run, F.lit(r"\d+[ -]?"), F.lit(0))
    # what begins at each group, as far as 19 digits can reach
    starts = F.regexp_extract_all(run, F.lit(r"(?<!\d)(?=(\d[\d -]{0,37}))"), F.lit(1))

    def candidates(tokens: Column) -> Column:
        def rated(v: Column, k: Column) -> Column:
            def of(d: Column) -> Column:
                groups = F.char_length(v) - F.char_length(d) + 1
                usual, other, known = v.rlike(USUAL_CARD), v.rlike(OTHER_CARD), d.rlike(NETWORK)
                first, last = k == 0, k + groups == F.size(tokens)
                if customary:
                    whole = first & last & known & ~run.rlike(rf"^(?:{_OTHER})")
                    fits = usual | other | whole
                else:
                    fits = ~v.rlike(r"\d{13}")  # a number that fails by itself does not pass with its neighbour
                fits = fits & ((groups == 1) | known | first | last)
                tier = F.when(usual & known, 0).when(other & known, 1).when(usual, 2).when(other, 3).when(known, 4).otherwise(5)
                valid = F.when(fits & ~d.rlike("^0+$"), _luhn_sum(d, 1) % 10 == 0).otherwise(False)
                return F.struct(valid.alias("valid"), tier.alias("tier"), (-F.char_length(d)).alias("size"), k.alias("k"), groups.alias("groups"), v.alias("value"))

            return _bind(_digits(v), of)

        def at(w: Column, k: Column) -> Column:
            found = F.array(*[F.regexp_extract(w, rf"^\d(?:[ -]?\d){{{n - 1}}}(?!\d)", 0) for n in range(13, 20)])
            return F.filter(F.transform(F.filter(found, lambda v: v != ""), lambda v: rated(v, k)), lambda c: c["valid"])

        return F.sort_array(F.flatten(F.transform(starts, at)))

    def disjoint(found: Column) -> Column:
        slim = F.transform(found, lambda c: F.struct(c["k"].alias("k"), (c["k"] + c["groups"]).alias("end"), c["value"].alias("value")))
        none = F.filter(slim, lambda c: F.lit(False))
        taken = F.aggregate(slim, none, lambda acc, c: F.when(F.exists(acc, lambda a: (a["k"] < c["end"]) & (c["k"] < a["end"])), acc).otherwise(F.concat(acc, F.array(c))))
        return F.sort_array(taken)

    def cut(tokens: Column) -> Column:
        def written(taken: Column) -> Column:
            def before(i: Column, upto: Column) -> Column:
                """Text between the number before ``i`` and group ``upto``."""
                end = F.when(i > 0, F.get(taken, i - 1)["end"]).otherwise(0)
                sep = F.when(i > 0, F.regexp_extract(F.get(tokens, end - 1), "[ -]$", 0)).otherwise("")
                return F.concat(sep, F.array_join(F.slice(tokens, end + 1, upto - end), ""))

            numbers = F.flatten(F.transform(taken, lambda c, i: F.array(_piece("", before(i, c["k"])), _piece("card", c["value"]))))
            return F.concat(numbers, F.array(_piece("", before(F.size(taken), F.size(tokens)))))

        return _bind(disjoint(candidates(tokens)), written)

    return _bind(tokens, cut)


def _phone(m: Column, key: str) -> Column:
    def permuted(d: Column) -> Column:
        n = F.char_length(d)
        country = F.substr(d, F.lit(1), n - 10)
        area, exchange, line = _number(d, n - 9, 3), _number(d, n - 6, 3), _number(d, n - 3, 4)
        # numbering-plan numbers: area and exchange begin with 2-9
        plan = _bind(
            _feistel(area - 200, (exchange - 200) * 10000 + line, 800, 8_000_000, key, "phone"),
            lambda r: F.concat(country, _pad(r["x"] + 200, 3), _pad(F.floor(r["y"] / 10000) + 200, 3), _pad(r["y"] % 10000, 4)),
        )
        # others keep what precedes the last seven digits
        other = _bind(_feistel(exchange, line, 1000, 10000, key, "line"), lambda r: F.concat(F.substr(d, F.lit(1), n - 7), _pad(r["x"], 3), _pad(r["y"], 4)))
        return F.when((area >= 200) & (exchange >= 200), plan).otherwise(other)

    return _bind(_digits(m), lambda d: F.when(F.char_length(d) >= 10, _refill(m, permuted(d))).otherwise(m))


def _ssn(m: Column, key: str) -> Column:
    def permuted(d: Column) -> Column:
        area, group, serial = _number(d, 1, 3), _number(d, 4, 2), _number(d, 6, 4)
        ok = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
        index = area - 1 - F.when(area > 666, 1).otherwise(0)
        back = lambda x: x + 1 + F.when(x >= 665, 1).otherwise(0)
        out = _bind(
            _feistel(index, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn"),
            lambda r: F.concat(_pad(back(r["x"]), 3), F.lit("-"), _pad(F.floor(r["y"] / 9999) + 1, 2), F.lit("-"), _pad(r["y"] % 9999 + 1, 4)),
        )
        return F.when(ok, out).otherwise(m)

    return _bind(_digits(m), permuted)


def _ip(m: Column, key: str) -> Column:
    def permuted(o: Column) -> Column:
        octet = [F.coalesce(o[i].try_cast("int"), F.lit(999)) for i in range(4)]
        ok = (octet[0] <= 255) & (octet[1] <= 255) & (octet[2] <= 255) & (octet[3] <= 255)
        out = _bind(
            _feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], 65536, 65536, key, "ip"),
            lambda r: F.concat_ws(".", *[x.cast("string") for x in (F.floor(r["x"] / 256), r["x"] % 256, F.floor(r["y"] / 256), r["y"] % 256)]),
        )
        return F.when(ok, out).otherwise(m)

    return _bind(F.split(m, r"\."), permuted)


def _date(m: Column, key: str) -> Column:
    def permuted(p: Column) -> Column:
        year_first = F.char_length(p[0]) == 4
        year, month, day = F.when(year_first, p[0]).otherwise(p[2]), p[1], F.when(year_first, p[2]).otherwise(p[0])
        value = F.to_date(F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")))
        number = F.date_diff(value, F.lit(FIRST_DAY).cast("date"))
        ok = value.isNotNull() & (number >= 0) & (number < CYCLE_DAYS)
        safe = F.when(ok, number).otherwise(0)
        sep = F.regexp_extract(m, r"[-/.]", 0)
        def written(r: Column) -> Column:
            new = F.date_add(F.lit(FIRST_DAY).cast("date"), (r["x"] * 773 + r["y"]).cast("int"))
            y, mo, d = (F.date_format(new, f) for f in ("yyyy", "MM", "dd"))
            return F.when(year_first, F.concat(y, sep, mo, sep, d)).otherwise(F.concat(d, sep, mo, sep, y))

        out = _bind(_feistel(F.floor(safe / 773), safe % 773, 189, 773, key, "date"), written)
        return F.when(ok, out).otherwise(m)

    return _bind(F.split(m, r"[-/.]"), permuted)


def _email(m: Column, key: str) -> Column:
    local = F.regexp_extract(m, r"^([^@]+)@", 1)
    return F.concat(_feistel_text(local, key, "email"), F.regexp_extract(m, r"@.*$", 0))


def kind_of(m: Column) -> Column:
    """Kind of a finding, by its format."""
    out = F.lit("card")
    for kind, test in (
        ("ssn", r"^\d{3}-\d{2}-\d{4}$"),
        ("phone", r"^(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$"),
        ("date", r"^(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})$"),
        ("ip", r"^(?:\d{1,3}\.){3}\d{1,3}$"),
        ("email", "@"),
    ):
        out = F.when(m.rlike(test), F.lit(kind)).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """Pseudonym of one finding (unchanged where it fails validation)."""
    fns = {"email": _email, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}
    out = m
    for name, fn in fns.items():
        out = F.when(kind == name, fn(m, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` with pseudonyms in place, ``n_found`` (values
    replaced) and ``found``: array of (kind, pseudonym) in text order."""
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    maybe = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    # customary card numbers first; what is left of the text is joined again, so that other findings see their surroundings
    mark = F.when(F.contains("text", F.lit("\0")), F.concat(F.lit("\0"), F.sha2(F.col("text").cast("binary"), 256), F.lit("\0"))).otherwise(F.lit("\0"))
    rows = rows.withColumn("mark", F.when(maybe, mark))
    runs = _pieces(F.col("text"), f"(?:{PATTERNS['email']})|(?:{RUN})", lambda m: F.when(m.contains("@"), F.array(_piece("", m))).otherwise(_cards(m, True)))
    marked = F.array_join(F.transform(runs, lambda p: F.when(p["kind"] == "card", F.concat("mark", p["value"], "mark")).otherwise(p["value"])), "")
    rows = rows.withColumn("parts", F.when(maybe, F.when(F.col("text").rlike(RUN), F.split(marked, F.col("mark"), -1)).otherwise(F.array("text"))))

    def rest(m: Column) -> Column:
        return _bind(kind_of(m), lambda k: F.when(k == "card", _cards(m, False)).otherwise(F.array(_piece(k, m))))

    cut = F.flatten(F.transform("parts", lambda p, i: F.when(i % 2 == 1, F.array(_piece("card", p))).otherwise(_pieces(p, ANY, rest))))
    rows = rows.withColumn("raw", F.filter(cut, lambda p: p["value"] != ""))
    done = F.transform("raw", lambda p: F.struct(p["kind"].alias("kind"), p["value"].alias("value"), F.when(p["kind"] == "", p["value"]).otherwise(pseudonym(p["value"], p["kind"], key)).alias("pseudonym")))
    rows = rows.withColumn("done", done)
    woven = F.array_join("done.pseudonym", "")
    changed = F.filter("done", lambda d: d["value"] != d["pseudonym"])
    found = F.coalesce(F.transform(changed, lambda d: F.struct(d["kind"].alias("kind"), d["pseudonym"].alias("pseudonym"))), F.array().cast("array<struct<kind:string,pseudonym:string>>"))
    return rows.select("doc_id", F.when(F.col("done").isNotNull(), woven).otherwise(F.col("text")).alias("text"), F.size(found).cast("long").alias("n_found"), found.alias("found"))
