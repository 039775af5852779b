"""Days, clock times and minutes.

All clocks of a row belong to the row's own service day, also when a window crosses midnight.
Times are wall clock (TIMESTAMP_NTZ), so results do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from punctual.functions.text import strip_sql

_DAY_AND_CLOCK = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}(:\d{1,2})?$"
_ISO_DAY_CLOCK = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?$"
_YMD = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})([ T].*)?$"
_XY_YEAR = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})([ T].*)?$"
_XYZ_DOTS = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})([ T].*)?$"
_D_MON_Y = r"^(\d{1,2})[ -]([A-Za-z]{3})[a-z]*\.?,?[ -](\d{4})([ T].*)?$"
_MON_D_Y = r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})([ T].*)?$"
# A clock at the end of a text, alone or behind a day of any form, with or without AM or PM.
_CLOCK_END = r"^(?:[0-9A-Za-z.,/ -]*\d[ T])?(\d{1,2}):(\d{2})(?::(\d{1,2})(?:\.\d+)?)? ?(?:([AaPp])\.?[Mm]\.?)?$"
_PLAIN_INSTANT = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2})?$"
_INSTANT = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?( ?(Z|[+-]\d{2}:?\d{2}))?)?$"
_ZONED = r":\d{1,2}(\.\d+)? ?(Z|[+-]\d{2}:?\d{2})$"
# The forms that most texts have, told by one small pattern.
_PLAIN_CLOCK = r"^(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?$"
_PLAIN_DAY_CLOCK = r"^\d{4}-\d{2}-\d{2}[ T](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d)?$"
_PLAIN_DAY = r"^\d{4}-\d{2}-\d{2}[ T].*$"


def clock_sql(day: str, clock: str) -> str:
    text = f"concat_ws(' ', {day}, {clock})"
    return f"try_cast(regexp_extract({text}, r'{_DAY_AND_CLOCK}', 0) AS timestamp_ntz)"


def clock_seconds(clock: str) -> Column:
    """Second of the day of a clock ``H:MM[:SS]``; NULL if it is none."""
    return F.expr(f"cast(timestampdiff(SECOND, timestamp_ntz'1970-01-01', {clock_sql("'1970-01-01'", clock)}) AS int)")


def is_typed(df: DataFrame, *names: str) -> bool:
    """Whether the seconds of these clocks are stored with the rows, as ingest leaves them."""
    return all(f"{n}_sec" in df.columns for n in names)


def _at(day: str, seconds: str) -> Column:
    return F.expr(f"timestampadd(SECOND, {seconds}, {day})")


#: Midnight of an ISO day in text, looked at by place and not by pattern.
_MIDNIGHT = "try_cast(if(length(date_dos) BETWEEN 8 AND 10 AND substring(date_dos, 5, 1) = '-', date_dos, NULL) AS timestamp_ntz)"


def clock_ts(day: str, clock: str) -> Column:
    """Day ``YYYY-MM-DD`` plus clock ``H:MM[:SS]`` as TIMESTAMP_NTZ; NULL if either is invalid.

    The pattern is needed: a cast alone reads an empty clock as midnight and ``6`` as 06:00. Text that
    does not match becomes blank, which casts to NULL. Small expressions matter here: a generated
    method beyond 8000 bytes of code is not compiled by the JVM.
    """
    return F.expr(clock_sql(day, clock))


def with_clocks(df: DataFrame, *names: str) -> DataFrame:
    """Adds ``<name>_ts`` for each clock column: from its stored seconds, or else from its text."""
    if is_typed(df, *names):
        return df.withColumns({f"{n}_ts": _at(_MIDNIGHT, f"{n}_sec") for n in names})
    return df.withColumns({f"{n}_ts": clock_ts("date_dos", n) for n in names})


def with_clocks_on(df: DataFrame, day: str, *names: str) -> DataFrame:
    """The same for a DATE column, and texts with blanks around them."""
    if is_typed(df, *names):
        return df.withColumns({f"{n}_ts": _at(f"cast({day} AS timestamp_ntz)", f"{n}_sec") for n in names})
    return df.withColumns({f"{n}_ts": clock_ts(day, strip_sql(n)) for n in names})


#: ``HH:MM`` of each minute of a day, a literal once the plan is optimised: looking one up costs less than making it of digits.
_DAY_CLOCKS = f"split('{','.join(f'{m // 60:02}:{m % 60:02}' for m in range(1440))}', ',')"


def minute_clock(minute: str) -> str:
    """``HH:MM`` of an INT minute of the day, else NULL."""
    return f"get({_DAY_CLOCKS}, {minute})"


def _shown_seconds(seconds: str) -> str:
    """``HH:MM``."""
    return minute_clock(f"cast({seconds} / 60 AS int)")


def _shown_odd(text: str) -> str:
    """A text that is no clock, as ``with_hhmm`` leaves it."""
    return (
        f"CASE WHEN lower({text}) IN ('', 'nan', 'none') THEN ''"
        f" WHEN substring({text}, 3, 1) = ':' AND length({text}) >= 5 THEN left({text}, 5) ELSE coalesce({text}, '') END"
    )


#: Bytes of a text that is no clock which a code can hold. Ingest leaves no such text.
CODE_BYTES = 7


def clock_code_sql(name: str) -> str:
    """A clock in a LONG: its second of the day, or below zero the bytes of a text that is none; NULL stays NULL.

    A LONG fits the fixed-width buffers of a hash aggregation, a text does not.
    """
    odd = f"-1 - cast(conv(concat('1', substring(hex({strip_sql(name)}), 1, {2 * CODE_BYTES})), 16, 10) AS bigint)"
    return f"CASE WHEN {name}_sec IS NOT NULL THEN cast({name}_sec AS bigint) ELSE {odd} END"


def _odd_text(code: str) -> str:
    return f"decode(unhex(substring(conv(cast(-1 - {code} AS string), 10, 16), 2)), 'UTF-8')"


def with_texts(df: DataFrame, *names: str) -> DataFrame:
    """Codes as the texts they stand for; columns that are texts already stay as they are."""
    codes = [n for n in names if df.schema[n].dataType.typeName() == "long"]
    return df.withColumns({n: F.expr(f"CASE WHEN {n} >= 0 THEN {_shown_seconds(n)} WHEN {n} < 0 THEN {_odd_text(n)} END") for n in codes})


def _with_decoded(df: DataFrame, *names: str) -> DataFrame:
    """Codes as texts for display, blank if missing."""
    odd = {n: _let(_odd_text(n), 't', _shown_odd('t')) for n in names}
    return df.withColumns({n: F.expr(f"CASE WHEN {n} >= 0 THEN {_shown_seconds(n)} WHEN {n} < 0 THEN {odd[n]} ELSE '' END") for n in names})


def minutes(start: str, end: str) -> Column:
    """``end - start`` in minutes as DOUBLE, NULL if either is missing."""
    return F.expr(f"timestampdiff(SECOND, {start}, {end}) / 60.0D")


def _clock_parts(text: str) -> str:
    """Hour, minute, second and half of the day of a text that ends in a clock, NULL if it does not."""
    # A pattern's end is also before a last line end, of which Unicode has more than are stripped.
    return f"split(if({text} RLIKE r'{_CLOCK_END}', regexp_replace({text}, r'{_CLOCK_END[:-1]}\\v?$', '$1:$2:$3:$4'), NULL), ':')"


def _plain_time(text: str) -> str:
    """``HH:MM`` of a text in one of the plain forms, else NULL."""
    return (
        f"CASE WHEN {text} RLIKE r'{_PLAIN_CLOCK}' THEN if(substring({text}, 2, 1) = ':', concat('0', left({text}, 4)), left({text}, 5))"
        f" WHEN {text} RLIKE r'{_PLAIN_DAY_CLOCK}' AND try_cast(left({text}, 10) AS date) IS NOT NULL THEN substring({text}, 12, 5) END"
    )


def _time_sql(text: str, parts: str) -> str:
    """Time of day ``HH:mm`` of a clock, with or without AM or PM, or of a day with a clock behind it.

    ``parts``: the column with its ``_clock_parts``.
    """
    half, hour = f"lower({parts}[3])", f"try_cast({parts}[0] AS int)"
    hour24 = f"CASE {half} WHEN '' THEN {hour} ELSE if({hour} BETWEEN 1 AND 12, {hour} % 12 + if({half} = 'p', 12, 0), NULL) END"
    time = f"try_cast(concat('1970-01-01 ', {hour24}, ':', {parts}[1], ':', if({parts}[2] = '', '0', {parts}[2])) AS timestamp_ntz)"
    iso = f"try_cast(regexp_extract({text}, r'{_ISO_DAY_CLOCK}', 0) AS timestamp_ntz)"
    shown = lambda t: minute_clock(f"cast(hour({t}) * 60 + minute({t}) AS int)")
    return f"if({text} LIKE '____-%', {shown(iso)}, {shown(time)})"


def with_hhmm(df: DataFrame, *names: str) -> DataFrame:
    """Clock texts for display: blank if missing, ``HH:MM`` if it looks like a time, else unchanged.

    Codes of first clocks are decoded, and where seconds are stored they are shown.
    """
    if all(df.schema[n].dataType.typeName() == "long" for n in names):
        return _with_decoded(df, *names)
    if is_typed(df, *names):
        shown = {n: F.expr(f"CASE WHEN {n}_sec IS NOT NULL THEN {_shown_seconds(f'{n}_sec')} ELSE {_let(strip_sql(n), 't', _shown_odd('t'))} END") for n in names}
        return df.withColumns(shown)
    df = _with_times(df.withColumns({n: F.expr(f"coalesce({strip_sql(n)}, '')") for n in names}), *names)
    return df.withColumns(
        {
            n: F.expr(
                f"CASE WHEN lower({n}) IN ('', 'nan', 'none') THEN ''"
                f" WHEN {n} LIKE '__:__%' THEN left({n}, 5) ELSE coalesce({n}__time, {n}) END"
            )
            for n in names
        }
    ).drop(*[f"{n}__time" for n in names])


def _with_times(df: DataFrame, *names: str) -> DataFrame:
    """Adds ``<name>__time``, the time of day of each of these stripped texts.

    Texts in a plain form, most of them, meet one or two small patterns; the others are cut into parts once. One
    function serves all columns: written out for each, they make a method that the JVM does not compile.
    """
    time = f"coalesce({_plain_time('t')}, {_let(_clock_parts('t'), 'p', _time_sql('t', 'p'))})"
    df = df.withColumn("__times", F.expr(f"transform(array({', '.join(names)}), t -> {time})"))
    return df.withColumns({f"{n}__time": F.expr(f"__times[{k}]") for k, n in enumerate(names)}).drop("__times")


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def with_clock_text(df: DataFrame, *names: str) -> DataFrame:
    """Any accepted time of day as ``HH:MM``, else NULL."""
    df = _with_times(df.withColumns({n: F.expr(strip_sql(n)) for n in names}), *names)
    return df.withColumns({n: F.col(f"{n}__time") for n in names}).drop(*[f"{n}__time" for n in names])


_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def _day(c: str, *formats: tuple[str, str]) -> Column:
    t = "t"
    tries = [
        f"try_cast(CASE WHEN {t} RLIKE r'{form}' THEN regexp_replace({t}, r'{form}', '{iso}') END AS date)"
        for form, iso in formats
    ]
    for form, month, day in ((_D_MON_Y, 2, 1), (_MON_D_Y, 1, 2)):
        part = lambda k, form=form: f"regexp_extract({t}, r'{form}', {k})"
        place = f"locate(initcap({part(month)}), '{_MONTHS}')"
        number = f"if({t} RLIKE r'{form}' AND {place} % 3 = 1, cast(({place} + 2) DIV 3 AS string), NULL)"
        tries.append(f"try_cast(concat({part(3)}, '-', {number}, '-', {part(day)}) AS date)")
    # Most days are plain ISO days, some with a clock behind them; the other forms are tried only where a day is neither.
    iso = f"length({t}) = 10 AND substring({t}, 5, 1) = '-' AND substring({t}, 8, 1) = '-'"
    head = f"CASE WHEN {iso} THEN {t} WHEN {t} RLIKE r'{_PLAIN_DAY}' THEN left({t}, 10) END"
    return F.expr(_let(strip_sql(c), t, f"coalesce(try_cast({head} AS date), {', '.join(tries)})"))


def day_text(c: str) -> Column:
    """Any accepted day as ``YYYY-MM-DD``: year first; with slashes or dashes month first, as in US files, else day
    first; with dots the same; or with the English name of the month.
    """
    return _day(
        c, (_YMD, "$1-$2-$3"), (_XY_YEAR, "$3-$1-$2"), (_XY_YEAR, "$3-$2-$1"), (_XYZ_DOTS, "$3-$1-$2"), (_XYZ_DOTS, "$3-$2-$1")
    ).cast("string")


def report_day(c: str) -> Column:
    """Day of the window report as DATE: ISO is ISO, everything else is day-first."""
    return _day(c, (_YMD, "$1-$2-$3"), (_XY_YEAR, "$3-$2-$1"), (_XYZ_DOTS, "$3-$2-$1"))


def service_day(df: DataFrame) -> Column:
    """Day of the window report of a row. Where seconds are stored, ingest has written the day too, as an ISO day."""
    return F.expr(f"cast({_MIDNIGHT} AS date)") if is_typed(df, "win_from") else report_day("date_dos")


def utc_instant(df: DataFrame, name: str) -> Column:
    """Instant as UTC wall clock. Text without a zone is UTC; invalid text is NULL.

    The text is taken as it is: a day with an empty clock behind it is invalid, not midnight.
    """
    c, kind = F.col(name), df.schema[name].dataType.typeName()
    if kind == "timestamp_ntz":
        return c
    if kind == "timestamp":
        return _utc(c)
    # A function of the text: written out for each column, it makes a method that the JVM does not compile.
    return F.transform(F.array(c.cast("string")), _instant_of_text)[0]


def _instant_of_text(t: Column) -> Column:
    # A cast wants seconds before the zone and a colon inside it.
    zoned = F.regexp_replace(t, r"[ T](\d{1,2}:\d{1,2}) ?([Z+-].*)$", " $1:00$2")
    zoned = F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")
    # Most texts name no zone and have all their digits, which one small pattern tells.
    return F.when(t.rlike(_PLAIN_INSTANT), t.try_cast("timestamp_ntz")).when(
        t.rlike(_INSTANT), F.when(t.rlike(_ZONED), _utc(zoned)).otherwise(t.try_cast("timestamp_ntz"))
    )


def _utc(instant: Column) -> Column:
    return F.timestamp_add(
        "MICROSECOND", F.unix_micros(instant), F.lit("1970-01-01").cast("timestamp_ntz")
    )
