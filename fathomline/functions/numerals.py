"""Words with numerals: numbers spelled out in English read as digits, content words, stated numbers.

A run of number words is one token of the text; only such short runs are folded, word by word, through a small automaton
(state: numbers done, thousands so far, current number, whether the last word was a unit). Cost is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions import text as T

#: Number words; the place of a unit is its value, a ten's is its value in tens from twenty on.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 100, "thousand": 1000}
VALUES = {w: k for k, w in enumerate(UNITS)} | {w: 10 * k for k, w in enumerate(TENS, 2)}
#: Numbers from here on count as this one.
MOST = 10**15

#: Words without content, by language; words of other languages that are also everyday English ones are left out.
STOP = {
    "en": """a an and are as at be been but by can could do does for from had has have how if in into is it its may might must no not of on or our shall
should so such than that the their them then there these they this those to was we were what when where which who whom why will with would you your""",
    "es": """el la los las un una unos unas lo le les de del al en con por para sobre entre hasta desde y o u pero que qué como cómo es están está ser fue ha
han se su sus este esta estos estas ese esa más muy también cuando donde cada todos toda todas puede pueden debe""",
    "de": """der das den dem des ein eine einen einem einer eines und oder aber von zu zum zur mit auf für im ins bei aus nach über unter ist sind wird werden
wurde hat haben kann können muss müssen sie es er ihr ihre sich nicht kein keine auch noch dass wenn wie jede jeder jedes alle""",
    "fr": """le les une des du au aux et ou mais dans pour avec sans sur sous entre est sont été être avoir ont il elle ils elles se ce cette ces qui que dont
ne pas aussi chaque tout tous toute toutes peut doit leur leurs sa ses""",
    "pt": """o os um uma uns umas do da dos das na nos nas ao aos em com por pela pelo para sem sobre entre e ou mas que é são foi ser estar tem têm se seu sua
seus suas este esta esse essa mais muito também cada todos pode deve""",
    "it": """il lo gli i uno di da dei degli delle della dello nel nella nei sul sulla con per tra fra ed ma che è sono essere ha hanno si suo sua suoi sue
questo questa quello quella più anche ogni tutto tutti può deve non""",
}
STOPS = sorted({w for words in STOP.values() for w in words.split()})

_W = r"[\p{L}\p{N}_]"
_FIRST = "|".join(VALUES)
_RUN = rf"(?<!{_W})(?:{_FIRST})(?!{_W})(?:[ -]++(?:{_FIRST}|{'|'.join(SCALES)}|and)(?!{_W}))*+"
TOKEN = rf"{_RUN}|{_W}+"
STARTS_RUN = rf"^(?:{_FIRST})(?!{_W})"
#: A citation marker; a separator of thousands; hyphens that typesetters use; a list item's own mark.
MARKER = r"\[\d{1,6}(?:\s*[-–]\s*\d{1,6})?(?:\s*,\s*\d{1,6}(?:\s*[-–]\s*\d{1,6})?)*\]"
THOUSANDS, HYPHENS, LIST_MARK = "(?<=\\p{Nd})[,\u202f\u00a0'](?=\\p{Nd}{3}(?![\\p{L}\\p{N}_]))", "\u2010\u2011\u2012", r"^\s*(?:\d{1,3}[.)]|[-*•])\s+"
#: A count of the sources themselves; parts of a currency's unit.
SOURCE_COUNT = (
    r"(?i)\b(?:all|the|these|those|each of the)\s+(?:two|three|four|five|six|seven|eight|nine|ten|[2-9]|10)\b"
    r"(?=\s+(?:documents?|polic(?:y|ies)|files?|sources?|passages?|texts?|versions?|say|agree|share|cover|state|describe)\b)"
)
SUBUNIT = r"(?i)\b(?:cents?|pence|paise|centimes?)\b"


def _folded(run: Column) -> Column:
    """The numbers of a run of number words, in order: tens and units add up, hundred and thousand multiply, two units are two numbers."""
    value = F.expr("map(" + ", ".join(f"'{w}', {v}" for w, v in VALUES.items()) + ")")
    held = lambda x: F.least(x, F.lit(MOST))

    def state(done: Column, total: Column, current: Column, unit: Column) -> Column:
        return F.struct(done.alias("done"), total.alias("total"), current.alias("current"), unit.alias("unit")).cast("struct<done:array<bigint>,total:bigint,current:bigint,unit:boolean>")

    def read(s: Column, w: Column) -> Column:
        v = F.try_element_at(value, w)
        return (
            F.when((v < 20) & s["unit"], state(F.concat(s["done"], F.array(s["total"] + s["current"])), F.lit(0), v, F.lit(True)))
            .when(v.isNotNull(), state(s["done"], s["total"], s["current"] + v, v < 20))
            .when(w == "hundred", state(s["done"], s["total"], held(F.greatest(s["current"], F.lit(1))) * SCALES["hundred"], F.lit(False)))
            .when(w == "thousand", state(s["done"], held(s["total"] + s["current"]) * SCALES["thousand"], F.lit(0), F.lit(False)))
            .otherwise(s)
        )

    start = state(F.array().cast("array<bigint>"), F.lit(0), F.lit(0), F.lit(False))
    return F.aggregate(F.split(run, "[ -]+"), start, read, lambda s: F.transform(F.concat(s["done"], F.array(s["total"] + s["current"])), lambda n: held(n).cast("string")))


def words(text: Column) -> Column:
    """A text's lower-cased words in order, numbers spelled out as digits ("two hundred and forty-five": 245)."""
    return F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.when(t.rlike(STARTS_RUN), _folded(t)).otherwise(F.array(t))))


def content_words(text: Column, stops: list[str] | None = None) -> Column:
    """The distinct words of a text that say something: no stop words, no single letters; single digits count."""
    kept = F.filter(words(text), lambda w: (F.char_length(w) > 1) | w.rlike(r"^\p{Nd}+$"))
    return F.array_except(F.array_distinct(kept), F.split(F.lit(" ".join(STOPS if stops is None else stops)), " "))


def numbers(text: Column) -> Column:
    """The distinct whole numbers that a text states, in digits; thousands separators go, parts of decimals stand alone."""
    plain = F.translate(F.regexp_replace(text, THOUSANDS, ""), HYPHENS, "-" * len(HYPHENS))
    return F.array_distinct(F.filter(words(plain), lambda w: w.rlike(r"^\p{Nd}+$")))


def claimed_numbers(claim: Column) -> Column:
    """The numbers of a claim: no citation markers, no list mark, no count of the sources."""
    bare = F.regexp_replace(F.regexp_replace(claim, MARKER, " "), LIST_MARK, "")
    return numbers(F.regexp_replace(bare, SOURCE_COUNT, " "))


def source_numbers(text: Column, header: Column) -> Column:
    """The numbers a source gives: its text's, its name's and section's; 0 too where it speaks of cents."""
    named = numbers(F.regexp_replace(header, r"[^\p{L}\p{N}]+", " "))
    return F.array_distinct(F.concat(numbers(text), named, F.when(text.rlike(SUBUNIT), F.array(F.lit("0"))).otherwise(F.array().cast("array<string>"))))
