"""Mixed timestamp texts to UTC instants.

The distinct pairs of text and zone go through every layout once; the results are kept in a dictionary
table that grows by the pairs not seen before, and join back to the rows.  All parsing is done by
built-in expressions, so that it stays inside the JVM.

Cases: a null or empty text, a relative word, a date without a time, a time without a date and an
impossible date or time give no instant.  A null zone is the default zone; an unknown zone name gives
no instant.  A text without a year needs ``collected_at`` and gives none where that is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.session import scratch_path

DEFAULT_ZONE = "Asia/Shanghai"

# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "UTC": 0,
    "GMT": 0,
    "CET": 60,
    "CEST": 120,
    "EST": -300,
    "EDT": -240,
    "AEST": 600,
    "AEDT": 660,
}
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()

#: Years before the one of collection that a text without a year may lie in; 29 February needs eight.
YEARS_BACK = 9

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　   "
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "    "

_MON = "(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_YMD = r"(?<!\d)(\d{4})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})(?!\d)"
_DMONY = r"(?<!\d)(\d{1,2})[-\s./]*" + _MON + r"[-\s.,/]*(\d{4})(?!\d)"
_MONDY = _MON + r"\.?\s*(\d{1,2})(?:st|nd|rd|th)?\s*,?\s*(\d{4})(?!\d)"
_MDY = r"(?<![\d/])(\d{1,2})/(\d{1,2})/(\d{4})(?!\d)"
_MD = r"(?<![\d\-/.:])(\d{1,2})\s*[-/.月]\s*(\d{1,2})日?[\sT]+(?=\D{0,4}\d{1,2}\s*[:时点])"
_TIME = (
    r"(?i)(上午|下午|凌晨|早上|中午|晚上|AM|PM)?\s*(?<![\d.:])(\d{1,2})\s*[:时点]\s*(\d{1,2})(?!\d)"
    r"(?:\s*[:分]\s*(\d{1,2})(?!\d)(?:秒|[.,](\d+))?)?分?"
    r"\s*(AM|PM|A\.M\.|P\.M\.)?"
)
_FULL = r"(?<!\d)(\d{4})(\d{2})(\d{2})[T\s]?(\d{2})(\d{2})(\d{2})(?!\d)"
_SHORT = r"(?<!\d)(\d{4})(\d{2})(\d{2})[T\s]?(\d{2})(\d{2})(?!\d)"
_UNIX = r"^\D*?(?<![\d.\-])(\d{13}|\d{10}|\d{9})(?![\d.])\D*$"
_OFFSET = r"(?i)^\s*(?:UTC|GMT|Z)?\s*([+\-−])\s*(\d{1,2})(?::?(\d{2}))?(?!\d)"
_ABBR = r"^\s*\(?(" + "|".join(sorted(ABBREVIATIONS, key=len, reverse=True)) + r"|Z)(?![A-Za-z])"


def narrow(text: Column) -> Column:
    """Full-width letters, digits and signs to plain ones, blanks trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, _WIDE, _NARROW), r"[​﻿]", ""))


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _int(text: Column) -> Column:
    return text.try_cast("int")



def parse_stamps(df: DataFrame) -> DataFrame:
    """Add ``fixed_ms`` for a text with a year or a bare Unix time, and ``by_year_ms`` for one without:
    the instants in each year from the one after ``stamp_year`` downwards.

    Written in steps so that each pattern is matched once a row.
    """
    t, zone, year = F.col("t"), F.col("stamp_zone"), F.col("stamp_year")
    plain = narrow(F.col("stamp_text"))
    out = df.withColumn("unix", _group(plain, _UNIX, 1))
    spread = F.regexp_replace(F.regexp_replace(plain, _FULL, "$1-$2-$3 $4:$5:$6"), _SHORT, "$1-$2-$3 $4:$5")
    out = out.withColumn("t", spread)
    layouts = {"ymd": (_YMD, 3), "dmony": (_DMONY, 3), "mondy": (_MONDY, 3), "mdy": (_MDY, 3), "md": (_MD, 2)}
    out = out.withColumns({k: F.array(*[_group(t, p, g + 1) for g in range(n)]) for k, (p, n) in layouts.items()})
    out = out.withColumn("clock", F.array(*[_group(t, _TIME + "(.*)$", g) for g in range(1, 8)]))

    def date(layout: str, y: int | None, m: int, d: int) -> Column:
        c = F.col(layout)
        month = F.array_position(F.array(*[F.lit(x.lower()) for x in MONTHS]), F.lower(c[m])).cast("int")
        return F.struct(
            (F.lit(None).cast("int") if y is None else _int(c[y])).alias("y"),
            (month if "mon" in layout else _int(c[m])).alias("m"),
            _int(c[d]).alias("d"),
        )

    found = {k: F.col(k)[0] != "" for k in layouts}
    day = (
        F.when(found["ymd"], date("ymd", 0, 1, 2))
        .when(found["dmony"], date("dmony", 2, 1, 0))
        .when(found["mondy"], date("mondy", 2, 0, 1))
        .when(found["mdy"], date("mdy", 2, 0, 1))
        .when(found["md"], date("md", None, 0, 1))
    )
    clock, tail = F.col("clock"), F.col("clock")[6]
    half = F.upper(F.concat(clock[0], F.regexp_replace(clock[5], r"\.", "")))
    abbr = _group(tail, _ABBR, 1)
    by_abbr = F.when(abbr == "Z", 0)
    for name, minutes in ABBREVIATIONS.items():
        by_abbr = by_abbr.when(abbr == name, minutes)
    sign = F.when(_group(tail, _OFFSET, 1) == "+", 1).otherwise(-1)
    by_hours = sign * (_int(_group(tail, _OFFSET, 2)) * 60 + F.coalesce(_int(_group(tail, _OFFSET, 3)), F.lit(0)))
    out = out.withColumns(
        {
            "day": day,
            "half": half,
            "h": _int(clock[1]),
            "mi": _int(clock[2]),
            "s": F.when(clock[3] == "", 0).otherwise(_int(clock[3])),
            "ms": F.when(clock[4] == "", 0).otherwise(_int(F.rpad(F.substring(clock[4], 1, 3), 3, "0"))),
            "offset": F.coalesce(by_hours, by_abbr),
        }
    )
    h = F.col("h")
    later = F.col("half").isin("PM", "下午", "晚上") & (h < 12) | (F.col("half") == "中午") & (h < 10)
    midnight = F.col("half").isin("AM", "上午", "凌晨", "早上") & (h == 12)
    out = out.withColumn("h", F.when(later, h + 12).when(midnight, 0).otherwise(h))
    valid = F.col("h").between(0, 23) & F.col("mi").between(0, 59) & F.col("s").between(0, 59)
    out = out.withColumn("h", F.when(valid, F.col("h")))

    def instant(in_year: Column) -> Column:
        parts = (in_year, F.col("day.m"), F.col("day.d"), F.col("h"), F.col("mi"), F.col("s").cast("decimal(8,6)"))
        at_zone = F.unix_millis(F.try_make_timestamp(*parts, zone))
        at_utc = F.unix_millis(F.try_make_timestamp(*parts, F.lit("UTC"))) - F.col("offset") * 60_000
        return F.when(F.col("offset").isNotNull(), at_utc).otherwise(at_zone) + F.col("ms")

    unix = F.col("unix")
    unix_ms = F.when(F.length(unix) == 13, unix.try_cast("long")).when(unix != "", unix.try_cast("long") * 1000)
    years = F.transform(F.sequence(F.lit(-1), F.lit(YEARS_BACK)), lambda k: instant(year - k))
    no_year = (unix == "") & F.col("day.y").isNull() & F.col("day.m").isNotNull()
    return out.select(
        *df.columns,
        F.coalesce(unix_ms, F.when(F.col("day.y").isNotNull(), instant(F.col("day.y")))).alias("fixed_ms"),
        F.when(no_year, F.filter(years, lambda x: x.isNotNull())).alias("by_year_ms"),
    )


KEY = ["stamp_text", "stamp_zone", "stamp_year"]


def stamp_keys(df: DataFrame, text: str, zone: str | None, collected: str | None, default_zone: str) -> list[Column]:
    """The dictionary's key of each row; the year counts only where no layout of the text has one."""
    z = F.lit(None).cast("string") if zone is None else F.nullif(F.trim(df[zone]), F.lit(""))
    at = F.lit(None).cast("timestamp") if collected is None else df[collected]
    plain = narrow(df[text])
    # Four digits may be an offset or a fraction; only a layout of parse_stamps makes them a year.
    dated = plain.rlike(_YMD)
    for layout in (_FULL, _SHORT, _DMONY, _MONDY, _MDY, _UNIX):
        dated = dated | plain.rlike(layout)
    no_year = ~(plain.rlike(r"\d{4}") & dated)
    return [
        df[text].alias("stamp_text"),
        F.coalesce(z, F.lit(default_zone)).alias("stamp_zone"),
        F.when(no_year & at.isNotNull(), F.year(at)).otherwise(0).alias("stamp_year"),
    ]


def extend_dictionary(keys: DataFrame, path: str) -> DataFrame:
    """Parse the keys that the dictionary at ``path`` lacks, append them, and return the whole dictionary.

    Parsing depends on the key alone, so that entries written twice by two jobs agree.
    """
    spark = keys.sparkSession
    new = keys.where(F.col("stamp_text").isNotNull()).distinct()
    try:
        known = spark.read.parquet(path)
        new = new.join(known.select(*KEY), KEY, "left_anti")
    except Exception as e:  # no dictionary yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    parse_stamps(new).write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy(*KEY).agg(F.first("fixed_ms").alias("fixed_ms"), F.first("by_year_ms").alias("by_year_ms"))


def normalise_instants(
    df: DataFrame,
    text: str,
    zone: str | None = None,
    collected: str | None = None,
    out: str = "utc_ms",
    default_zone: str = DEFAULT_ZONE,
    dictionary_path: str | None = None,
) -> DataFrame:
    """``df`` with the instant of ``text`` in milliseconds since 1970-01-01 UTC as ``out``, null where there is none.

    ``dictionary_path`` keeps the dictionary from run to run; without it each call has its own in the
    shared folder.  All columns and rows of ``df`` stay, repeated rows too; a column named ``out`` is replaced.
    """
    path = dictionary_path or scratch_path(df.sparkSession, "instants")
    keyed = df.drop(out) if out in df.columns else df
    text_key, zone_key, year_key = stamp_keys(df, text, zone, collected, default_zone)
    book = extend_dictionary(df.select(text_key, zone_key, year_key), path)
    book = book.where(F.col("fixed_ms").isNotNull() | F.col("by_year_ms").isNotNull())
    at = F.lit(None).cast("long") if collected is None else F.unix_millis(F.col(f"r.`{collected}`"))
    # Rows without a text match nothing; a hash of the row spreads them over the tasks of the join.
    plain = [F.col(f"`{c}`") for c, t in keyed.dtypes if "map<" not in t and "variant" not in t]
    alone = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*plain), F.lit(1024)).cast("string"))
    on = [
        F.col("r.__text") == F.col("d.stamp_text"),
        F.col("r.__zone") == F.col("d.stamp_zone"),
        F.col("r.__year") == F.col("d.stamp_year"),
    ]
    keyed = keyed.withColumns({"__zone": zone_key, "__year": year_key, "__text": F.coalesce(keyed[text], alone)})
    late = F.array_max(F.filter(F.col("d.by_year_ms"), lambda x: x <= at))
    rows = keyed.alias("r").join(book.alias("d"), on, "left")
    kept = [F.col(f"r.`{c}`") for c in keyed.columns if c not in ("__zone", "__year", "__text")]
    return rows.select(*kept, F.coalesce(F.col("d.fixed_ms"), late).alias(out))
