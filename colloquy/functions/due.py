"""Due dates that people name, resolved against the day of the meeting by expressions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import calendar_date, end_of_month, end_of_week, weekday_after
from .text import fold

#: Folded names of weekdays from Monday, and of months with their short forms.
ENGLISH_WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
FRENCH_WEEKDAYS = "lundi mardi mercredi jeudi vendredi samedi dimanche".split()
ENGLISH_MONTHS = ["january jan", "february feb", "march mar", "april apr", "may", "june jun", "july jul", "august aug", "september sept sep", "october oct", "november nov", "december dec"]
FRENCH_MONTHS = "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre".split()
APOSTROPHES = "’ʼ´`‛"

Group = Callable[[int], Column]


def exact_date(day: Column, month: Column, year: Column) -> Column:
    """That date; null if there is none. Years of two digits are of this century."""
    full = F.when(year < 100, year + 2000).otherwise(year)
    return F.try_make_timestamp(full, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def day_of_month(n: Column, day: Column) -> Column:
    """The n-th of this month, or of the next one if that is past; null if this month has no such day."""
    this = exact_date(n, F.month(day), F.year(day))
    following = F.date_add(F.last_day(day), 1)
    return F.when(this >= day, this).when(this.isNotNull(), exact_date(n, F.month(following), F.year(following)))


class _Rules:
    """Patterns over a folded text, each with the date that its first occurrence means."""

    def __init__(self, text: Column, day: Column, language: str | None) -> None:
        self.x = text
        self.day = day
        self.found: list[Column] = []
        self.both()
        if language != "en":
            self.french()
        if language != "fr":
            self.english()

    def add(self, pattern: str, date: Callable[[Group], Column]) -> None:
        start = F.regexp_instr(self.x, F.lit(pattern))
        end = start + F.length(F.regexp_extract(self.x, pattern, 0))
        meant = date(lambda k: F.regexp_extract(self.x, pattern, k))
        self.found.append(F.when(start > 0, F.struct(start.alias("start"), (-end).alias("back"), F.lit(len(self.found)).alias("rule"), meant.alias("date"))))

    def calendar(self, day: Column, month: Column, year: Column) -> Column:
        d, y = day.try_cast("int"), year.try_cast("int")
        return F.when(y.isNotNull(), exact_date(d, month, y)).otherwise(calendar_date(d, month, self.day))

    def both(self) -> None:
        self.add(r"\b(\d{4}-\d{2}-\d{2})\b", lambda g: g(1).try_cast("date"))

    def numeric(self, day_first: bool) -> None:
        d, m = (1, 2) if day_first else (2, 1)
        self.add(r"\b(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?\b", lambda g: self.calendar(g(d), g(m).try_cast("int"), g(3)))

    def weekdays(self, before: str, names: list[str], after: str) -> None:
        number = F.create_map(*[F.lit(v) for k, n in enumerate(names) for v in (n, k)])

        def meant(g: Group) -> Column:
            n = F.try_element_at(number, g(2))
            options = [F.when(n == k, F.when((g(1) != "") | (g(3) != ""), weekday_after(self.day, k, True)).otherwise(weekday_after(self.day, k))) for k in range(7)]
            return F.coalesce(*options)

        self.add(rf"\b{before}({'|'.join(names)}){after}\b", meant)

    def french(self) -> None:
        months = F.create_map(*[F.lit(v) for k, n in enumerate(FRENCH_MONTHS, 1) for v in (n, k)])
        self.add(rf"\b(\d{{1,2}})(?:er)?\s+({'|'.join(FRENCH_MONTHS)})(?:\s+(\d{{4}}))?\b", lambda g: self.calendar(g(1), F.try_element_at(months, g(2)), g(3)))
        self.numeric(True)
        self.add(r"\bapres-demain\b", lambda g: F.date_add(self.day, 2))
        self.add(r"\bdemain\b", lambda g: F.date_add(self.day, 1))
        self.add(r"\b(?:aujourd'hui|ce soir|en fin de journee)\b", lambda g: self.day)
        self.weekdays("()", FRENCH_WEEKDAYS, r"(\s+prochain)?")
        self.add(r"\bsemaine\s+prochaine\b", lambda g: end_of_week(self.day, 1))
        self.add(r"\bfin\s+(?:de\s+)?(?:la\s+)?semaine\b|\bcette semaine\b", lambda g: end_of_week(self.day))
        self.add(r"\bfin\s+du\s+mois\b", lambda g: end_of_month(self.day))
        self.add(r"\ble\s+mois\s+prochain\b", lambda g: end_of_month(self.day, 1))
        self.offsets("dans", ("jours?", "semaines?", "mois"))
        self.add(r"\ble\s+(\d{1,2})\b(?!\s*[hm:])", lambda g: day_of_month(g(1).try_cast("int"), self.day))

    def english(self) -> None:
        forms = [(form, k) for k, names in enumerate(ENGLISH_MONTHS, 1) for form in names.split()]
        months = F.create_map(*[F.lit(v) for pair in forms for v in pair])
        either = "|".join(form for form, _ in forms)  # full names come before their short forms
        self.add(rf"\b({either})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?\b", lambda g: self.calendar(g(2), F.try_element_at(months, g(1)), g(3)))
        self.add(rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+of\s+({either})(?:,?\s+(\d{{4}}))?\b", lambda g: self.calendar(g(1), F.try_element_at(months, g(2)), g(3)))
        self.numeric(False)
        self.add(r"\bthe day after tomorrow\b", lambda g: F.date_add(self.day, 2))
        self.add(r"\btomorrow\b", lambda g: F.date_add(self.day, 1))
        self.add(r"\b(?:today|tonight|by eod|end of (?:the )?day)\b", lambda g: self.day)
        self.weekdays(r"(next\s+)?", ENGLISH_WEEKDAYS, "()")
        self.add(r"\bnext week\b", lambda g: end_of_week(self.day, 1))
        self.add(r"\b(?:eow|this week|end of (?:the )?week)\b", lambda g: end_of_week(self.day))
        self.add(r"\b(?:eom|month end|end of (?:the )?month)\b", lambda g: end_of_month(self.day))
        self.add(r"\bnext month\b", lambda g: end_of_month(self.day, 1))
        self.offsets("in", ("days?", "weeks?", "months?"))
        self.add(r"\b(?:by|on|before) the\s+(\d{1,2})(?:st|nd|rd|th)\b", lambda g: day_of_month(g(1).try_cast("int"), self.day))

    def offsets(self, word: str, units: tuple[str, str, str]) -> None:
        after = (lambda n: F.date_add(self.day, n), lambda n: F.date_add(self.day, 7 * n), lambda n: end_of_month(self.day, n))
        for unit, date in zip(units, after, strict=True):
            self.add(rf"\b{word}\s+(\d{{1,6}})\s+{unit}\b", lambda g, date=date: date(g(1).try_cast("int")))

    def first(self) -> Column:
        spans = F.array_sort(F.array_compact(F.array(*self.found)))
        near = F.filter(spans, lambda s: s.start <= -F.get(spans, F.lit(0)).back)
        widest = F.array_sort(F.transform(near, lambda s: F.struct(s.back.alias("back"), s.start.alias("start"), s.rule.alias("rule"), s.date.alias("date"))))
        return F.get(widest, F.lit(0)).date


def due_date(text: Column, day: Column, language: str | None = None) -> Column:
    """The date that a text names relative to ``day``, by the rules of ``language`` (``en``, ``fr``), or of both with the French ones first; null if none.

    Of all expressions found, the one that begins first counts, or the one among those that overlap or touch it which reaches furthest. An
    expression that gives no date (a 40th of May) gives null. Null stays null.
    """
    folded = F.translate(fold(text), APOSTROPHES, "'" * len(APOSTROPHES))
    return F.get(F.transform(F.array(folded), lambda x: _Rules(x, day, language).first()), F.lit(0))  # so that the text is folded once
