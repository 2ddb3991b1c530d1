"""Date expressions. Dates travel as ISO strings, so that their order is plain string order."""

from datetime import date

from pyspark.sql import Column, functions as F

from tidings import fixed_values as fv
from tidings.functions.text import blank_to_null


def _month_numbers() -> Column:
    pairs = [F.lit(x) for i, m in enumerate(fv.MONTH_NAMES, 1) for x in (m.lower(), i)]
    return F.create_map(*pairs)


def month_number(name: Column) -> Column:
    """Month name in any letter case -> 1..12, unknown -> null."""
    return F.element_at(_month_numbers(), F.lower(name))


def month_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, fv.MONTH_NAMES)), number)


def last_day_iso(year: Column, month: Column) -> Column:
    return F.date_format(F.last_day(F.make_date(year, month, F.lit(1))), "yyyy-MM-dd")


def sort_key(published: Column, first_seen: Column) -> Column:
    """The date an item is ordered and aged by; an empty string counts as missing. Never null."""
    return F.coalesce(blank_to_null(published), blank_to_null(first_seen), F.lit(""))


def month_bucket(key: Column) -> Column:
    """Archive month of a sort key."""
    return F.when(key == "", F.lit(fv.UNDATED_MONTH)).otherwise(F.substring(key, 1, 7))


def cutoff(as_of: str, max_age_days: int) -> Column:
    """Oldest ISO date still inside the window."""
    return F.date_format(F.date_sub(F.lit(as_of).cast("date"), max_age_days), "yyyy-MM-dd")


def in_recent_months(year: Column, month: Column, as_of: str,
                     count: int = fv.RECENT_MONTHS) -> Column:
    """Whether (year, month) is one of the `count` months that end with the month of `as_of`."""
    today = date.fromisoformat(as_of)
    last = today.year * 12 + today.month
    return (year * 12 + month).between(last - count + 1, last)


def leading_date(text: Column) -> Column:
    """ISO date of a leading "Month d, yyyy" line, null when absent or of an unknown month.

    The day is not validated: the string is kept as written, zero-padded.
    """
    def part(group: int) -> Column:
        return F.regexp_extract(text, fv.LEADING_DATE, group)

    number = month_number(part(1))
    return F.when(number.isNotNull(), F.concat_ws(
        "-", part(3), F.lpad(number.cast("string"), 2, "0"), F.lpad(part(2), 2, "0")))


def drop_leading_date(text: Column) -> Column:
    """Remove the leading date line, also when its month is unknown."""
    return F.regexp_replace(text, fv.LEADING_DATE, "")


_RFC822 = (r"(?i)^\s*(?:[a-z]{3,9},?\s+)?(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{2}|\d{4})\s+"
           r"(\d{1,2}:\d{2})(:\d{2})?(?:\.\d+)?\s*([+-]\d{2}:?\d{2}|[a-z]{1,4})?\s*$")
_ISO = (r"(?i)^\s*(\d{4}-\d{2}-\d{2})(?:[t ](\d{2}:\d{2})(:\d{2})?(?:[.,]\d+)?\s*"
        r"(z|[+-]\d{2}:?\d{2})?)?\s*$")

# Named zones of RFC 822; other names count as UTC.
_ZONES = {"est": "-0500", "edt": "-0400", "cst": "-0600", "cdt": "-0500", "mst": "-0700",
          "mdt": "-0600", "pst": "-0800", "pdt": "-0700"}


def _offset(zone: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in _ZONES.items() for x in pair])
    numeric = F.replace(zone, F.lit(":"), F.lit(""))
    return F.when(zone.rlike(r"^[+-]\d"), numeric).otherwise(
        F.coalesce(F.element_at(known, F.lower(zone)), F.lit("+0000")))


def feed_date(stamp: Column) -> Column:
    """Feed timestamp (RFC 822 or ISO 8601) -> ISO date in UTC, null when it is neither."""
    def rfc(group: int) -> Column:
        return F.regexp_extract(stamp, _RFC822, group)

    def iso(group: int) -> Column:
        return F.regexp_extract(stamp, _ISO, group)

    short_year = F.when(rfc(3).try_cast("int") < 69, F.lit("20")).otherwise(F.lit("19"))
    year = F.when(F.length(rfc(3)) == 2, F.concat(short_year, rfc(3))).otherwise(rfc(3))
    seconds = F.coalesce(blank_to_null(rfc(5)), F.lit(":00"))
    rfc_text = F.concat(rfc(1), F.lit(" "), F.initcap(rfc(2)), F.lit(" "), year, F.lit(" "),
                        F.lpad(rfc(4), 5, "0"), seconds, F.lit(" "), _offset(rfc(6)))
    iso_text = F.concat(iso(1), F.lit(" "), F.coalesce(blank_to_null(iso(2)), F.lit("00:00")),
                        F.coalesce(blank_to_null(iso(3)), F.lit(":00")), F.lit(" "),
                        _offset(iso(4)))
    instant = (
        F.when(stamp.rlike(_RFC822),
               F.try_to_timestamp(rfc_text, F.lit("d MMM yyyy HH:mm:ss Z")))
        .when(stamp.rlike(_ISO),
              F.try_to_timestamp(iso_text, F.lit("yyyy-MM-dd HH:mm:ss Z"))))
    return F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), "yyyy-MM-dd")


# A date in extended or basic form, or of a week; a clock of either form; an offset of either form. A fraction
# may follow any part of a clock, and where there is none, one character may stand before an offset.
_CLOCK = r"(?:\d{2}:\d{2}:\d{2}|\d{6}|\d{2}:\d{2}|\d{4}|\d{2})"
_FRACTION = r"(?:[.,]\d+)?"
_OFFSET = rf"(?:Z|[+-]{_CLOCK}{_FRACTION})"
_TIME = rf"(?:{_CLOCK}.?{_OFFSET}|{_CLOCK}{_FRACTION}{_OFFSET}?)"
# Groups of each: year, separator, month or week, day. In the basic form of a week, digits that follow are the
# day and then an odd number, or the clock.
_DAY = r"(\d{4})(-?)(\d{2})\2(\d{2})"
_WEEKS = (r"(\d{4})(-)W(\d{2})(?:-([1-7])(?!\d))?",
          r"(\d{4})()W(\d{2})(?:([1-7])(?=(?:\d(?:\d\d)*)?(?!\d)))?")


def rfc2822(stamp: Column) -> Column:
    """ISO date or datetime -> RFC 2822 text; null if it is neither.

    Dates may be of a day or of a week (its Monday, if the day is left out), in extended or basic
    form but not a mixture. An offset is replaced by UTC, not converted, and the clock is read without a time
    zone.
    """
    def part(pattern: str, group: int) -> Column:
        return blank_to_null(F.regexp_extract(stamp, "^" + pattern, group))

    def week_part(group: int) -> Column:
        return F.coalesce(*[part(x, group) for x in _WEEKS]).try_cast("int")

    def matches(pattern: str) -> Column:
        return stamp.rlike(f"(?s)^{pattern}(?:.{_TIME})?$")

    day = F.concat_ws("-", part(_DAY, 1), part(_DAY, 3), part(_DAY, 4)).try_cast("date")
    # The fourth of January is always in the first week.
    year, week = week_part(1), week_part(3)
    fourth = F.when(year > 0, F.make_date(year, F.lit(1), F.lit(4)))
    monday = F.date_add(F.date_trunc("week", fourth).cast("date"), (week - 1) * 7)
    of_week = F.when((week >= 1) & (F.weekofyear(monday) == week),       # not every year has 53
                     F.date_add(monday, F.coalesce(week_part(4), F.lit(1)) - 1))
    date = (F.when(stamp.startswith("0000"), None).when(matches(_DAY), day)
            .when(matches(_WEEKS[0]) | matches(_WEEKS[1]), of_week))
    clock = F.coalesce(*[part(f"(?s){x}.({_TIME})$", 5) for x in (_DAY, *_WEEKS)], F.lit(""))
    digits = F.rpad(F.replace(F.regexp_extract(clock, f"^{_CLOCK}", 0), F.lit(":"), F.lit("")), 6, "0")
    time = F.concat_ws(":", *[F.substring(digits, at, 2) for at in (1, 3, 5)])
    instant = F.concat(date.cast("string"), F.lit(" "), time).try_cast("timestamp_ntz")
    return F.when(instant.isNotNull(), F.concat(
        F.date_format(date, "EEE, dd MMM yyyy "),
        F.substring(instant.cast("string"), 12, 8), F.lit(" +0000")))


def iso_date(text: Column) -> Column:
    """The DATE of an ISO date or datetime string, null when there is none."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"),
                  F.substring(text, 1, 10).try_cast("date"))
