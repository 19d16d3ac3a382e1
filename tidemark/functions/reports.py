"""Facts of periodic reports: the moment they speak of, ordered fall-through of patterns, tallies and places.

All are built-in expressions over tables that callers pass; those below are for Ukrainian reports.  Counts are read
from tokens by one rule: a number means the first counted noun that follows it closely, in the same sentence.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let, strip_markdown

# Names of months and number words of the language.
MONTHS = {"січня": 1, "лютого": 2, "березня": 3, "квітня": 4, "травня": 5, "червня": 6, "липня": 7, "серпня": 8, "вересня": 9, "жовтня": 10, "листопада": 11, "грудня": 12}
IN_MONTHS = {"січні": 1, "лютому": 2, "березні": 3, "квітні": 4, "травні": 5, "червні": 6, "липні": 7, "серпні": 8, "вересні": 9, "жовтні": 10, "листопаді": 11, "грудні": 12}
NUMBERS = {
    "один": 1, "одна": 1, "одне": 1, "одну": 1, "два": 2, "дві": 2, "двічі": 2, "три": 3, "тричі": 3, "чотири": 4, "п'ять": 5, "шість": 6, "сім": 7, "вісім": 8, "дев'ять": 9, "десять": 10,
    "одинадцять": 11, "дванадцять": 12, "тринадцять": 13, "чотирнадцять": 14, "п'ятнадцять": 15, "шістнадцять": 16, "сімнадцять": 17, "вісімнадцять": 18, "дев'ятнадцять": 19,
    "двадцять": 20, "тридцять": 30, "сорок": 40, "п'ятдесят": 50, "шістдесят": 60, "сімдесят": 70, "вісімдесят": 80, "дев'яносто": 90, "сто": 100,
    "двісті": 200, "триста": 300, "чотириста": 400, "п'ятсот": 500, "шістсот": 600, "сімсот": 700, "вісімсот": 800, "дев'ятсот": 900,
    # Russian, where it differs
    "одно": 1, "две": 2, "четыре": 4, "пять": 5, "шесть": 6, "семь": 7, "восемь": 8, "девять": 9, "десять": 10,
    "одиннадцать": 11, "двенадцать": 12, "тринадцать": 13, "четырнадцать": 14, "пятнадцать": 15, "шестнадцать": 16, "семнадцать": 17, "восемнадцать": 18, "девятнадцать": 19,
    "двадцать": 20, "тридцать": 30, "пятьдесят": 50, "шестьдесят": 60, "семьдесят": 70, "восемьдесят": 80, "девяносто": 90,
    "двести": 200, "четыреста": 400, "пятьсот": 500, "шестьсот": 600, "семьсот": 700, "восемьсот": 800, "девятьсот": 900,
}


def plain(text: Column) -> Column:
    """Without Markdown, and with one kind of apostrophe."""
    return F.translate(strip_markdown(text), "’ʼ", "''")


def _table() -> Column:
    return F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])


def tokens(text: Column) -> Column:
    """Numbers (with blanks between thousands), words, commas and full stops, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\d+(?:\s\d{3}\b)*|[\p{L}'–—-]+|[.,]"), F.lit(0))


def values(toks: Column) -> Column:
    """The value of each token that is a number or a number word, else null."""
    return F.transform(toks, lambda t: F.coalesce(F.regexp_replace(t, r"\s", "").try_cast("long"), F.try_element_at(_table(), t).cast("long")))


def _since(vals: Column, end: Column) -> Column:
    """The sum of the numbers that stand together up to place ``end``, null if none stands there ("сорок чотири")."""
    last = F.struct(*[F.when(end - k >= 0, F.get(vals, F.greatest(end - k, F.lit(0)))).alias(name) for k, name in enumerate(("one", "two", "three"))])

    def leads(b: Column, a: Column) -> Column:
        """Whether ``b`` and ``a`` are one number: tens before ones, or hundreds before either."""
        tens, hundreds = b.between(20, 90) & (b % 10 == 0) & (a < 10), b.between(100, 900) & (b % 100 == 0) & (a < 100)
        return F.coalesce((a > 0) & (tens | hundreds), F.lit(False))

    def summed(x: Column) -> Column:
        more = F.when(leads(x["three"], x["two"]), x["three"]).otherwise(0)
        return x["one"] + F.when(leads(x["two"], x["one"]), x["two"] + more).otherwise(0)

    return let(last, summed)


def spelt_number(words: Column) -> Column:
    """The number with which the words end, in digits or words; null if they end otherwise."""
    return let(values(tokens(words)), lambda vals: _since(vals, F.size(vals) - 1))


def first_known(text: Column, patterns: Sequence[str], group: int = 1) -> Column:
    """The number of the first pattern that gives one; 0 counts as none, as in a chain of alternatives."""
    return F.coalesce(*[F.nullif(spelt_number(F.nullif(F.regexp_extract(text, p, group), F.lit(""))), F.lit(0).cast("long")) for p in patterns], F.lit(None).cast("long"))


def snapshot_of(text: Column, posted: Column, *, header: str = r"станом\s+на", previous: str = r"минулої\s+доби|минулу\s+добу", same: str = r"початку\s+(?:цієї\s+)?доби", zone: str = "Europe/Kyiv") -> Column:
    """``header HH:MM day month year`` as (report_date, snapshot_at, note); null without one.

    A header more than 12 hours from the post (``posted`` is UTC) has a wrong day: the post's local day is taken and
    noted.  The report is about the day before if it says so, about the same day if it says so, else by the hour
    (before noon: the day before).
    """
    text = plain(text)
    spelt = rf"(?iU){header}\s+(\d{{1,2}})[:.](\d{{2}})\s+(\d{{1,2}})\s+(\p{{L}}+)\s+(\d{{4}})"
    dotted = rf"(?iU){header}\s+(\d{{1,2}})[:.](\d{{2}})\s+(\d{{1,2}})[./](\d{{1,2}})[./](\d{{4}})"
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])

    def part(k: int) -> Column:
        return F.coalesce(F.regexp_extract(text, spelt, k).try_cast("int"), F.regexp_extract(text, dotted, k).try_cast("int"))

    month = F.coalesce(F.try_element_at(months, F.lower(F.regexp_extract(text, spelt, 4))), F.regexp_extract(text, dotted, 4).try_cast("int"))
    said = F.try_make_timestamp_ntz(part(5), month, part(3), part(1), part(2), F.lit(0))
    local = F.from_utc_timestamp(posted, zone).cast("timestamp_ntz")
    wrong = F.abs(F.timestamp_diff("MINUTE", said, local)) > 720
    at = F.when(wrong, F.try_make_timestamp_ntz(F.year(local), F.month(local), F.dayofmonth(local), part(1), part(2), F.lit(0))).otherwise(said)
    before = text.rlike(rf"(?iU){previous}") | (~text.rlike(rf"(?iU){same}") & (part(1) < 12))
    note = F.when(wrong, F.concat(F.lit("header said "), F.date_format(said, "yyyy-MM-dd")))
    return F.when(said.isNotNull(), F.struct(F.date_sub(F.to_date(at), before.cast("int")).alias("report_date"), at.alias("snapshot_at"), note.alias("note")))


#: How a list of targets is written: stems of the verb before it, words between items, stems of what other items contain.
LISTS = {"verb": ("уразил",), "between": ("та", "і", "й", ","), "content": ("озброєн", "технік", "живої")}


def _stem(token: Column, stems: Sequence[str]) -> Column:
    """True for tokens that begin with one of the stems."""
    return token.rlike("^(?:" + "|".join(stems) + ")")


def tally(text: Column, words: dict[str, Sequence[str]] = LISTS) -> Column:
    """What the first clause after the verb counts: of each listed item its numbers, or 1 without any; null without the verb.

    An item that begins with a content word says only what another item contains: it counts for its numbers, if any.
    """
    toks = tokens(plain(text))

    def clause(t: Column) -> Column:
        begin = F.array_position(F.transform(t, lambda x: _stem(x, words["verb"])), True)
        rest = F.slice(t, begin.cast("int") + 1, F.size(t))
        stop = F.array_position(rest, ".")
        return F.when(begin > 0, F.when(stop > 0, F.slice(rest, 1, stop.cast("int") - 1)).otherwise(rest))

    def counted(t: Column) -> Column:
        """A fold over the clause: done items, and the open one (words, number, whether it counts)."""
        vals, between = values(t), lambda x: x.isin(*words["between"])
        state = lambda done, n, number, real: F.struct(done.alias("done"), n.alias("n"), number.alias("number"), real.alias("real"))
        worth = lambda s: F.when(s["n"] > 0, F.coalesce(s["number"], F.when(s["real"], 1).otherwise(0))).otherwise(0).cast("long")
        start = state(F.lit(0).cast("long"), F.lit(0), F.lit(None).cast("long"), F.lit(True))
        step = lambda s, x: F.when(between(x["t"]), state(s["done"] + worth(s), F.lit(0), F.lit(None).cast("long"), F.lit(True))).otherwise(
            state(s["done"], s["n"] + 1, F.when(x["v"].isNotNull(), F.coalesce(s["number"], F.lit(0).cast("long")) + x["v"]).otherwise(s["number"]), s["real"] & ~((s["n"] == 0) & _stem(x["t"], words["content"])))
        )
        return F.aggregate(F.arrays_zip(t.alias("t"), vals.alias("v")), start, step, lambda s: s["done"] + worth(s))

    return F.get(F.transform(F.filter(F.array(clause(toks)), lambda c: c.isNotNull()), counted), F.lit(0))


@dataclass(frozen=True)
class PlaceWords:
    """Stems and endings by role: how reports name places, and count what happened there."""

    before: tuple[str, ...] = ("на", "у", "в")
    ending: tuple[str, ...] = ("ому", "ій", "их", "ім")
    head: tuple[str, ...] = ("напрямк",)
    join: tuple[str, ...] = ("та", "і", "й")
    no_name: tuple[str, ...] = ("цьому", "цих", "інших", "іншому", "окремих", "визначених")
    counted: tuple[str, ...] = ("штурм", "атак", "бойов", "боєзіткнен", "зіткнен", "наступ", "спроб", "боїв", "намаг")
    times: tuple[str, ...] = ("раз",)
    going: tuple[str, ...] = ("трива",)
    stopped: tuple[str, ...] = ("відби",)
    quiet: tuple[str, ...] = ("дій не проводив", "не виявлено")
    #: Tokens after a number within which its noun stands, and after the noun its duration.
    reach: int = 4
    #: Characters of the last section, behind which other matters follow, and of a lead that no full stop parts.
    last: int = 600
    lead: int = 80

    @property
    def name(self) -> str:
        return rf"[\p{{L}}'–—-]+(?:{'|'.join(self.ending)})"

    @property
    def anchor(self) -> str:
        joint = rf"(?:,\s+|\s+(?:{'|'.join(self.join)})\s+)"
        return rf"(?iU)\b(?:{'|'.join(self.before)})\s+{self.name}(?:{joint}{self.name})*\s+(?:{'|'.join(self.head)})\p{{L}}*"


def mentions(text: Column, words: PlaceWords) -> Column:
    """Numbers with the role of the noun that they count: (n, role), role being total, going or part; others are left out."""

    def read(toks: Column) -> Column:
        vals = values(toks)

        def at(v: Column, i: Column) -> Column:
            behind = F.slice(toks, i + 2, words.reach)
            noun = F.array_position(F.transform(behind, lambda x: _stem(x, words.counted)), True).cast("int")
            stop = F.array_position(behind, ".").cast("int")
            lasts = F.array_join(F.slice(toks, i + 2 + noun, words.reach), " ").rlike(rf"(?U)^[^.,\d]*\b(?:{'|'.join(words.going)})")
            role = (
                F.when(v.isNull() | F.get(vals, i + 1).isNotNull(), None)  # the last of numbers that stand together speaks for them
                .when(F.coalesce(_stem(F.get(behind, F.lit(0)), words.times), F.lit(False)) & (noun > 0), "total")
                .when((noun > 0) & ((stop == 0) | (stop > noun)), F.when(lasts, "going").otherwise("part"))
                .when((i > 0) & _stem(F.get(toks, F.greatest(i - 1, F.lit(0))), words.stopped), "part")
            )
            return F.struct(_since(vals, i).alias("n"), role.alias("role"))

        return F.filter(F.transform(vals, at), lambda m: m["role"].isNotNull() & (m["n"] > 0))

    return F.get(F.transform(F.array(tokens(text)), read), F.lit(0))


def place_reports(text: Column, words: PlaceWords = PlaceWords()) -> Column:
    """Rows of (place, attacks, ongoing, group_size, group_id), one a place: its first mention counts.

    A section runs from an anchor to the next; the part of its sentence before the anchor ("25 attacks were made in …")
    counts for it and not for the section before.  Where no full stop parts two anchors, the characters before the
    later one are read only if its own section has no number.  Places named together share a count, their number being
    the group's size.  A total ("N times") wins over parts; a section that says that nothing happened has no counts.
    """
    text = plain(text)
    anchors = F.regexp_extract_all(text, F.lit(words.anchor), F.lit(0))
    pieces = F.split(text, words.anchor)

    def parted(head: Column, i: Column) -> Column:
        before, piece = F.get(pieces, i), F.get(pieces, i + 1)
        ended = F.instr(before, ".") > 0
        lead = F.when(ended, F.substring_index(before, ".", -1)).otherwise(F.right(before, F.lit(words.lead)))
        whole = F.when(F.instr(piece, ".") > 0, F.regexp_extract(piece, r"(?s)^(.*\.)", 1)).otherwise(piece)
        body = F.when(i + 1 < F.size(anchors), whole).otherwise(F.substring(piece, F.lit(1), F.lit(words.last) - F.length(head)))
        leads = F.when(ended | (i == 0), F.array(lead)).otherwise(F.array(F.lit(""), lead))
        return F.struct(head.alias("anchor"), body.alias("body"), leads.alias("leads"))

    def section(part: Column, i: Column) -> Column:
        head, body = part["anchor"], part["body"]
        names = F.filter(F.regexp_extract_all(F.lower(head), F.lit(rf"(?U)({words.name})\b"), F.lit(1)), lambda n: ~n.isin(*words.no_name))
        quiet = F.substring_index(body, ".", 1).rlike("(?iU)" + "|".join(q.replace(" ", r"\s+") for q in words.quiet))
        found = F.transform(part["leads"], lambda x: mentions(F.concat(x, head, body), words))

        def first(*roles: str) -> Column:
            """The first number of the first role that any reading has."""
            of = lambda role: F.get(F.transform(F.filter(F.flatten(found), lambda m: m["role"] == role), lambda m: m["n"]), F.lit(0))
            return F.coalesce(*map(of, roles))

        count, going = first("total", "part", "going"), first("going")
        return F.transform(
            names,
            lambda n: F.struct(
                F.regexp_replace(n, "[–—-]", "").alias("place"), F.when(~quiet, count).alias("attacks"), F.when(~quiet, going).alias("ongoing"),
                F.size(names).alias("group_size"), F.when(F.size(names) > 1, i).alias("group_id"),
            ),
        )

    rows = F.flatten(F.transform(F.transform(anchors, parted), section))
    return F.filter(rows, lambda r, i: F.array_position(F.transform(rows, lambda x: x["place"]), r["place"]) == i + 1)


def parse_summary(text: Column, metrics: dict[str, Sequence[str]], part: str = r"(?iU)частина\s+(\d+)") -> Column:
    """Metrics by their pattern chains, and the part's number; later parts carry no metrics."""
    text = plain(text)
    number = F.regexp_extract(text, part, 1).try_cast("int")
    later = F.coalesce(number > 1, F.lit(False))
    return F.struct(*[F.when(~later, first_known(text, p)).alias(name) for name, p in metrics.items()], number.alias("part"))


def period_of(text: Column, *, summing: str = r"за\s+(?:підсумками|результатами)", of: dict[str, int] = MONTHS, preposition: str = "[ув]", within: dict[str, int] = IN_MONTHS) -> Column:
    """The month a report sums up, as ``yyyy-MM``; null without a month or a year.

    The first word after ``summing`` that names a month (genitive) gives it, else the first "in <month>" (locative);
    the year is the first 20xx in the text.
    """

    def known(words: Column, table: dict[str, int]) -> Column:
        months = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return F.get(F.filter(F.transform(words, lambda w: F.try_element_at(months, F.lower(w))), lambda m: m.isNotNull()), F.lit(0))

    month = F.coalesce(
        known(F.regexp_extract_all(text, F.lit(rf"(?iU){summing}\s+(\w+)"), F.lit(1)), of),
        known(F.regexp_extract_all(text, F.lit(rf"(?iU)\b{preposition}\s+({'|'.join(within)})\b"), F.lit(1)), within),
    )
    year = F.regexp_extract(text, r"(?U)\b(20\d{2})\b", 1)
    return F.when(month.isNotNull() & (year != ""), F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0")))
