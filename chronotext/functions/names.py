"""Names and times as columns: slugs, labels, identities, clock formats, file-name times, start-time guesses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that a file name can't hold, and the shapes of times in file names.
UNSAFE = r'[<>:"/\\|?*\x00-\x1f]'
NAME_TIMES = (
    r"(\d{4})[-_.]?(\d{2})[-_.]?(\d{2})[ _-]+(\d{2})[-_.:]?(\d{2})(?:[-_.:]?(\d{2}))?",
    r"(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})",
)


def _dashed(text: Column) -> Column:
    safe = F.regexp_replace(F.trim(text), UNSAFE, "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(safe, r"(?U)[\s_]+", "-"), "-{2,}", "-"), r"^[-.]+|[-.]+$", "")


def slug(text: Column, most: int = 40) -> Column:
    out = F.regexp_replace(F.left(F.lower(_dashed(text)), F.lit(most)), "-+$", "")
    return F.when(F.lower(_dashed(text)) == "", "untitled").when(out == "", "untitled").otherwise(out)


def course_label(text: Column, most: int = 60) -> Column:
    out = F.regexp_replace(F.left(_dashed(text), F.lit(most)), r"[-.]+$", "")
    return F.when(out == "", "unknown-course").otherwise(out)


def identity_prefix(session_id: Column, date: Column, start: Column, course: Column) -> Column:
    """date_time_course_sequence; what is missing is taken from the id, or named unknown."""
    from_id = F.regexp_extract(session_id, r"^\d{4}-\d{2}-\d{2}_(\d{4})_", 1)
    number = F.regexp_extract(session_id, r"_(\d{3})$", 1)
    return F.concat_ws(
        "_",
        F.coalesce(date, F.date_format(start, "yyyy-MM-dd"), F.lit("unknown-date")),
        F.coalesce(F.date_format(start, "HHmm"), F.when(from_id != "", from_id), F.lit("unknown-time")),
        course_label(F.coalesce(course, F.lit("unknown-course"))),
        F.when(number != "", number).otherwise("001"),
    )


def session_id(date: Column, start: Column, course: Column, number: Column) -> Column:
    return F.concat_ws("_", date, F.coalesce(F.date_format(start, "HHmm"), F.lit("0000")), slug(course), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _wide(c: Column) -> Column:
    return F.when(c < 100, _two(c)).otherwise(c.cast("string"))


def hhmmss(seconds: Column) -> Column:
    t = F.greatest(F.lit(0).cast("long"), F.bround(seconds, 0).cast("long"))
    return F.concat_ws(":", _wide(F.floor(t / 3600)), _two(F.floor(t % 3600 / 60)), _two(t % 60))


def hhmmss_ms(seconds: Column) -> Column:
    """A carry from the milliseconds goes to the seconds only, which can so be 60."""
    t = F.greatest(F.lit(0.0), seconds)
    whole = F.floor(t)
    ms = F.bround((t - whole) * 1000, 0).cast("long")
    s = whole % 60 + F.when(ms == 1000, 1).otherwise(0)
    clock = F.concat_ws(":", _wide(F.floor(whole / 3600)), _two(F.floor(whole % 3600 / 60)), _two(s))
    return F.concat(clock, F.lit("."), F.lpad(F.when(ms == 1000, 0).otherwise(ms).cast("string"), 3, "0"))


def name_time(name: Column) -> Column:
    """Wall-clock time in a file name: the first shape whose parts are a valid time; else null."""

    def of(p: str) -> Column:
        g = [F.regexp_extract(name, p, k) for k in range(1, 7)]
        n = [F.when(x != "", x.cast("int")) for x in g]
        return F.when(F.rlike(name, F.lit(p)), F.try_make_timestamp_ntz(*n[:5], F.coalesce(n[5], F.lit(0)).cast("decimal(16,6)")) if hasattr(F, "try_make_timestamp_ntz") else None)

    return F.coalesce(*map(of, NAME_TIMES))


def start_guess(name: Column, seconds: Column, created: Column, modified: Column, changed: Column) -> Column:
    """struct(start, source, confidence). A container time about when the named recording ended is its end."""
    named = name_time(name)
    span = lambda c: F.make_dt_interval(secs=c)
    ended = F.coalesce((created > named) & (F.abs(F.timestamp_diff("SECOND", named + span(seconds), created)) <= 600) & (seconds > 0), F.lit(False))
    guess = lambda at, source, how: F.struct(at.alias("start"), F.lit(source).alias("source"), F.lit(how).alias("confidence"))
    return (
        F.when(created.isNotNull() & ended, guess(named, "filename", "high"))
        .when(created.isNotNull(), guess(created, "ffprobe", "high"))
        .when(named.isNotNull(), guess(named, "filename", "high"))
        .when(F.coalesce(seconds > 0, F.lit(False)), guess(modified - span(seconds), "mtime-duration", "medium"))
        .otherwise(guess(changed, "ctime", "low"))
    )


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight of HH:MM[:SS]."""
    parts = F.split(text, ":")
    return F.try_add(parts[0].cast("int") * 60, parts[1].cast("int"))


def seconds_of(text: Column) -> Column:
    """Seconds of a number, MM:SS or HH:MM:SS; null if it is none."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("double"))
    return F.when((F.size(parts) <= 3) & ~F.exists(parts, lambda p: p.isNull()), F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p))
