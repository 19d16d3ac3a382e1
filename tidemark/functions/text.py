"""Facts from text, as built-in string expressions; word numbers are the only table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is not text.
DROPPED = ("script", "style", "nav", "header", "footer", "svg", "iframe", "noscript")
#: Named entities as the standard library has them; no-break spaces are read as blanks.
ENTITIES = {name: " " if code == 0xA0 else chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
#: The entities that are tried first.
USUAL = ("amp", "lt", "gt", "quot", "nbsp")
#: Number words of three languages.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "один": 1, "одна": 1, "два": 2, "дві": 2, "две": 2, "три": 3, "чотири": 4, "четыре": 4, "п'ять": 5, "пять": 5, "шість": 6, "шесть": 6, "сім": 7, "семь": 7,
    "вісім": 8, "восемь": 8, "дев'ять": 9, "девять": 9, "десять": 10, "одинадцять": 11, "одиннадцать": 11, "дванадцять": 12, "двенадцать": 12,
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    """White space (no-break spaces too) as single blanks, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"[\s ]+", " "))


def unescape(text: Column) -> Column:
    """Named and numeric entities (``&eacute;``, ``&#233;``, ``&#xE9;``) as characters, once; others stay as they are."""
    named = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])
    usual = lambda name: reduce(lambda c, n: c.when(name == n, ENTITIES[n]), USUAL[1:], F.when(name == USUAL[0], ENTITIES[USUAL[0]]))

    def read(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        code = F.coalesce(F.regexp_extract(name, r"^#([0-9]+)$", 1).try_cast("long"), F.conv(F.nullif(F.regexp_extract(name, r"^#[xX](.+)$", 1), F.lit("")), 16, 10).cast("long"))
        number = F.when(code == 160, " ").when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        char = F.coalesce(usual(name), F.try_element_at(named, name), number)
        return F.when(i == 0, piece).when((name != "") & char.isNotNull(), F.concat(char, F.substr(piece, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), piece))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, "&", -1), read), "")).otherwise(t))


def without(text: Column, start: str, end: str) -> Column:
    """``text`` with a blank for each stretch from a match of ``start`` to the next one of ``end``; an unclosed start stays.

    Only what stands before the last end is searched, where every start is closed: the search goes over the text once.
    """

    def searched(t: Column, head: Column) -> Column:
        return F.concat(F.regexp_replace(head, f"(?is){start}.*?{end}", " "), F.substr(t, F.length(head) + 1))

    return let(text, lambda t: let(F.regexp_extract(t, f"(?is)^.*{end}", 0), lambda head: F.when(head == "", t).otherwise(searched(t, head))))


def html_to_text(html: Column) -> Column:
    """The text of a page without dropped elements, comments and tags, in time that grows in proportion to the page."""
    text = without(html, "<!--", "-->")
    for name in DROPPED:
        text = without(text, f"<{name}[ >]", f"</{name}>")
    return collapse(unescape(without(text, "<", ">")))


def strip_markdown(text: Column) -> Column:
    """Without emphasis marks, code marks and soft hyphens."""
    return F.regexp_replace(text, r"[*_`~­]", "")


def number_word(word: Column) -> Column:
    """The value of a number word, or of digits; null otherwise."""
    known = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    low = F.lower(F.trim(word))
    return F.coalesce(F.when(low.rlike(r"^[0-9]{1,9}$"), low.try_cast("long")), F.try_element_at(known, low).cast("long"))


def list_sum(text: Column, sep: str = ",") -> Column:
    """The sum over a list's items: each item's first number, or 1 if it has none; blank items don't count."""
    items = F.filter(F.transform(F.split(text, sep), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    counts = F.transform(items, lambda x: F.coalesce(F.regexp_extract(x, r"([0-9]{1,9})", 1).try_cast("long"), F.lit(1).cast("long")))
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def distributed(text: Column) -> Column:
    """``3 over a, b and c`` as rows of (name, count): the count holds for every name."""
    count = F.regexp_extract(text, r"([0-9]{1,9}) over ", 1).try_cast("long")
    names = F.split(F.regexp_extract(text, r"[0-9]{1,9} over (.+)$", 1), r", | and ")
    return F.transform(F.filter(names, lambda n: F.length(F.trim(n)) > 0), lambda n: F.struct(F.trim(n).alias("name"), count.alias("count")))


def first_category(text: Column, patterns: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first pattern that the text matches."""
    out = None
    for name, pattern in patterns:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def gate(text: Column, phrase: str, header: str, bodies: Sequence[str]) -> Column:
    """True for a report: its phrase, its header and at least one body pattern."""
    any_body = F.lit(False)
    for b in bodies:
        any_body = any_body | text.rlike(b)
    return text.rlike(phrase) & text.rlike(header) & any_body


def first_failing(text: Column, stages: Sequence[tuple[str, str]]) -> Column:
    """The name of the first stage whose pattern the text fails; null if it passes all."""
    out = None
    for name, pattern in stages:
        out = F.when(~text.rlike(pattern), name) if out is None else out.when(~text.rlike(pattern), name)
    return F.lit(None).cast("string") if out is None else out


def date_in(text: Column) -> Column:
    """The first ``dd.mm.yyyy``, ``yyyy-mm-dd`` or ``d month yyyy``, as a date."""
    dotted = F.regexp_extract(text, r"(\d{2}\.\d{2}\.\d{4})", 1)
    iso = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    named = r"(?i)(\d{1,2}) (" + "|".join(MONTHS) + r") (\d{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, named, 2)))
    spelt = F.when(month > 0, F.concat_ws("-", F.regexp_extract(text, named, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, named, 1), 2, "0")))
    return F.coalesce(F.to_date(F.try_to_timestamp(dotted, F.lit("dd.MM.yyyy"))), iso.try_cast("date"), spelt.try_cast("date"))


def label_values(text: Column) -> Column:
    """Bullets ``label – total (+delta)`` as rows of (label, total, delta); a missing delta is 0."""
    bullet = r"([^\n–:;]+?) – ([0-9]+(?: [0-9]{3})*)(?: \(\+([0-9]+)\))?"
    parts = F.regexp_extract_all(text, F.lit(bullet), F.lit(0))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.trim(F.regexp_extract(p, bullet, 1)).alias("label"),
            F.regexp_replace(F.regexp_extract(p, bullet, 2), " ", "").try_cast("long").alias("total"),
            F.coalesce(F.regexp_extract(p, bullet, 3).try_cast("long"), F.lit(0).cast("long")).alias("delta"),
        ),
    )


def bound_before(text: Column, number: str, reach: int = 25) -> Column:
    """What the words closest before a number say of it: at_least, approx, up_to or exact."""
    before = F.lower(F.regexp_extract(text, rf"(?s)(.{{0,{reach}}}){number}", 1))
    words = (("at_least", ("at least", "more than", "over ")), ("approx", ("about", "around", "nearly")), ("up_to", ("up to", "at most")))
    places = [F.struct(F.greatest(*[F.length(before) - F.length(F.substring_index(before, p, -1)) - len(p) + 1 for p in phrases]).alias("at"), F.lit(name).alias("bound")) for name, phrases in words]
    closest = F.array_max(F.array(*places))
    return F.when(closest["at"] > 0, closest["bound"]).otherwise("exact")


DATED_WINDOW = r"(?i)from (\d{1,2}):(\d{2}) on (\d{1,2}) (\p{L}+) to (\d{1,2}):(\d{2}) on (\d{1,2}) (\p{L}+)"
NIGHT = r"(?i)\b(?:overnight|(?:last|past) night|during the night)\b"


def report_window(text: Column, posted: Column, *, dated: str = DATED_WINDOW, months: Sequence[str] = MONTHS, night: str = NIGHT) -> Column:
    """The window of a report posted at ``posted`` as (start, end, kind); null without one.

    First ``from HH:MM on D month to HH:MM on D month``, the year being the post's, and the year before for a start in
    a later month than the end; else ``from HH:MM to HH:MM``, over midnight, 24:00 and the day before included; else,
    where the text speaks of the night, 20:00 to 07:00.  A window that would start after the post belongs to the day
    before.  Kinds: night (dated, said to be, over midnight, from 18:00 on, or until 07:00 at the latest) and day.
    """
    pattern = r"from ([0-2]?\d):([0-5]\d) to ([0-2]?\d):([0-5]\d)"
    said = text.rlike(night)
    h1, m1, h2, m2 = (F.coalesce(F.regexp_extract(text, pattern, k).try_cast("int"), F.when(said, usual)) for k, usual in ((1, 20), (2, 0), (3, 7), (4, 0)))
    begin, finish = h1 * 60 + m1, h2 * 60 + m2
    day = F.to_date(posted)
    over = finish <= begin
    base = F.when(over, F.date_sub(day, 1)).otherwise(day)
    late = F.timestamp_add("MINUTE", begin, base.cast("timestamp")) > posted.cast("timestamp")
    base = F.when(late, F.date_sub(base, 1)).otherwise(base)
    start = F.timestamp_add("MINUTE", begin, base.cast("timestamp"))
    end = F.timestamp_add("MINUTE", F.when(over, finish + 1440).otherwise(finish), base.cast("timestamp"))
    kind = F.when(said | over | (h1 >= 18) | (finish <= 7 * 60), "night").otherwise("day")
    plain = F.when(begin.isNotNull() & (begin <= 1440), F.struct(start.alias("start"), end.alias("end"), kind.alias("kind")))

    def month(k: int) -> Column:
        return F.nullif(F.array_position(F.array(*map(F.lit, months)), F.lower(F.regexp_extract(text, dated, k))), F.lit(0)).cast("int")

    def at(k: int, year: Column) -> Column:
        date = F.concat_ws("-", year.cast("string"), month(k + 3).cast("string"), F.nullif(F.regexp_extract(text, dated, k + 2), F.lit(""))).try_cast("date")
        return F.timestamp_add("MINUTE", F.regexp_extract(text, dated, k).try_cast("int") * 60 + F.regexp_extract(text, dated, k + 1).try_cast("int"), date.cast("timestamp"))

    first, last = at(1, F.year(posted) - (month(4) > month(8)).cast("int")), at(5, F.year(posted))
    back = F.when(first > posted.cast("timestamp"), -1).otherwise(0)
    whole = F.struct(F.timestamp_add("DAY", back, first).alias("start"), F.timestamp_add("DAY", back, last).alias("end"), F.lit("night").alias("kind"))
    return F.coalesce(F.when(first.isNotNull() & last.isNotNull(), whole), plain)


def count_near(text: Column, noun: str, most: int = 5000) -> Column:
    """The number in ``destroyed N nouns``, ``N nouns`` or ``one noun``; null if above ``most`` or absent."""
    verb_first = F.regexp_extract(text, rf"(?i)destroyed ([0-9]{{1,9}}) {noun}s?\b", 1).try_cast("long")
    noun_first = F.regexp_extract(text, rf"(?i)([0-9]{{1,9}}) {noun}s?\b", 1).try_cast("long")
    single = F.when(text.rlike(rf"(?i)\b(one|a) {noun}\b"), F.lit(1).cast("long"))
    n = F.coalesce(verb_first, noun_first, single)
    return F.when(n <= most, n)


#: Where the summary of a wider window begins in the same post.
FOOTER = r"(?i)\bin total\b|\boverall\b|📊|➡|Всего"
_COUNT = "[0-9]{1,9}|" + "|".join(sorted(NUMBER_WORDS, key=lambda w: (-len(w), w)))
_PLACE_WORD = rf"(?!(?:and|over|was|were|destroyed|shot|{_COUNT})\b)[\p{{L}}'-]+"
_PLACE = rf"{_PLACE_WORD}(?: {_PLACE_WORD})*"
#: Passes in order: pattern ({noun} to be filled in), groups of the count (0: one) and of the place or places.
BREAKDOWN = (
    (rf"(?iU)\b({_COUNT})(?: {{noun}}s?)? each over (?:the )?({_PLACE}(?:(?:,? and |, )(?:over )?(?:the )?(?!an? ){_PLACE})+)", 1, 2),
    (rf"(?iU)\bover (?:the )?({_PLACE})(?:: |,? (?:(?:was|were) )?(?:destroyed|shot down) )({_COUNT}) {{noun}}s?\b(?! (?:was |were )?(?:destroyed |shot down )?over\b)", 2, 1),
    (rf"(?iU)\b({_COUNT}) {{noun}}s? (?:was |were )?(?:destroyed|shot down) over (?:the )?({_PLACE})", 1, 2),
    (rf"(?iU)\b(?:an?|another) {{noun}}(?: was)?(?: destroyed| shot down)? over (?:the )?({_PLACE})", 0, 1),
    (rf"(?iU)\b({_COUNT})(?: {{noun}}s?)?(?: each)? over (?:the )?([\p{{L}}' -]+?)(?=,|;|\.|\n|▪| and |$)", 1, 2),
)


def _item(pattern: str, count: int, place: int, joints: str) -> Callable[[Column], Column]:
    def read(p: Column) -> Column:
        n = number_word(F.regexp_extract(p, pattern, count)) if count else F.lit(1).cast("long")
        return F.transform(F.split(F.trim(F.regexp_extract(p, pattern, place)), joints), lambda x: F.struct(F.trim(x).alias("place"), n.alias("count")))

    return read


def breakdown(text: Column, noun: str, *, passes: Sequence[tuple[str, int, int]] = BREAKDOWN, footer: str = FOOTER, joints: str = r",? and (?:over )?(?:the )?|, (?:over )?(?:the )?") -> Column:
    """The items of a report as rows of (place, count), a place once; fewer than two places are no breakdown.

    Passes run in order, each on what the earlier ones left: a count for several places, place first, noun first, one
    without a number, and ``N nouns over place``.  What follows a footer is about a wider window and doesn't count.
    """
    kind = "array<struct<place:string,count:bigint>>"
    rest = F.get(F.split(text, footer), F.lit(0))
    items = []
    for pattern, count, place in passes:
        pattern = pattern.replace("{noun}", noun)
        found = F.regexp_extract_all(rest, F.lit(pattern), F.lit(0))
        items.append(F.flatten(F.transform(found, _item(pattern, count, place, joints))))
        rest = F.regexp_replace(rest, pattern, "▪")
    rows = F.concat(*items)

    def merged(rows: Column) -> Column:
        total = lambda name: F.aggregate(F.filter(rows, lambda r: r["place"] == name), F.lit(0).cast("long"), lambda s, r: s + r["count"])
        return F.transform(F.array_distinct(F.transform(rows, lambda r: r["place"])), lambda name: F.struct(name.alias("place"), total(name).alias("count")))

    rows = F.get(F.transform(F.array(rows), merged), F.lit(0))
    return F.when(F.size(rows) >= 2, rows).otherwise(F.array().cast(kind))


def rough_places(text: Column, *, lead: str = r"\bover ", joints: str = r",|\s+and\s+", most: int = 300) -> Column:
    """The clause after the first ``lead`` up to a full stop as (places, clause): how many it lists, and its first characters."""
    clause = collapse(F.regexp_extract(text, rf"(?i){lead}([^.]+)", 1))
    return F.struct(F.size(F.filter(F.split(clause, joints), lambda x: F.trim(x) != "")).alias("places"), F.left(clause, F.lit(most)).alias("clause"))


#: Kinds of summaries in order: name, pattern, and the pattern of the period ("" for none).
SUMMARIES = (
    ("briefing", r"(?i)\bbriefing\b", ""),
    ("main_of_day", r"(?i)\bhighlights of the day\b", ""),
    ("weekly", r"(?i)\bfrom \d{1,2}(?: \p{L}+)? to \d{1,2} \p{L}+ \d{4}", r"(?i)\bfrom (\d{1,2}(?: \p{L}+)? to \d{1,2} \p{L}+ \d{4})"),
    ("daily", r"(?i)\bas of \d{1,2} \p{L}+ \d{4}", r"(?i)\bas of (\d{1,2} \p{L}+ \d{4})"),
    ("summary", "", ""),
)


def summary_kind(text: Column, *, gate: str = r"(?i)\bsummary\b|\bbriefing\b|\bhighlights of the day\b", kinds: Sequence[tuple[str, str, str]] = SUMMARIES) -> Column:
    """(kind, period) of a summary, by the first kind that fits; null for other texts.

    The period is as written; a range whose first day has no month ("2 to 8 May 2025") gets the second's.
    """
    flat = collapse(text)
    out = None
    for name, pattern, period in kinds:
        shown = F.nullif(F.regexp_extract(flat, period, 1), F.lit("")) if period else F.lit(None).cast("string")
        shown = F.regexp_replace(shown, r"^(\d{1,2}) to (\d{1,2}) (\p{L}+)", "$1 $3 to $2 $3")
        value = F.struct(F.lit(name).alias("kind"), shown.alias("period"))
        out = F.when(flat.rlike(pattern), value) if out is None else out.when(flat.rlike(pattern), value)
    return F.when(flat.rlike(gate), out)


def parse_report(text: Column, posted: Column, noun: str) -> Column:
    """Headline, window and breakdown of a report: the count is the greater of headline and parts; null without a window."""
    window, parts = report_window(text, posted), breakdown(text, noun)
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x["count"])
    headline = count_near(text, noun)
    return F.when(window.isNotNull() & headline.isNotNull(), F.struct(F.greatest(headline, total).alias("count"), window.alias("window"), F.to_date(window["end"]).alias("report_date"), parts.alias("parts")))
