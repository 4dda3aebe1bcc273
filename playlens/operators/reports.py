"""Players' reports: lenient JSON, each field of a wrong type left out rather than refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.functions.text import word
from playlens.operators.quantiles import with_quantiles
from playlens.session import stored

# Fixed values.
MAX_CODE = 65_535
SHOWN = 5

_c = F.col
_NUMBER = "^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"


def _type(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def number(v: Column, path: str) -> Column:
    return F.when(_type(v, path).rlike(_NUMBER), F.try_variant_get(v, path, "double"))


def text(v: Column, path: str) -> Column:
    return F.when(_type(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def short(v: Column, path: str) -> Column:
    return F.nullif(word(text(v, path)), F.lit(""))


def boolean(v: Column, path: str) -> Column:
    return F.when(_type(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def elements(v: Column, path: str) -> Column:
    """The array's elements as variants; null where there is no array."""
    return F.when(_type(v, path).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def parse_reports(df: DataFrame, body: str = "body") -> DataFrame:
    """``df`` with ``code``, ``message`` and ``stats`` (variant), only the rows that are reports.

    The parse and the three fields each stand behind a one-row ``explode``: filters and projections over them can't be
    pushed through it, so that a body is parsed once however often its fields are asked for.
    """
    parsed = df.select(*df.columns, F.explode(F.array(F.try_parse_json(body))).alias("__v"))
    code = F.when(_type(_c("__v"), "$.code") == "BIGINT", F.try_variant_get(_c("__v"), "$.code", "bigint"))
    whole = parsed.where(_type(_c("__v"), "$").startswith("OBJECT"))
    fields = F.struct(
        F.when(code >= 0, F.least(code, F.lit(MAX_CODE))).alias("__code"),
        text(_c("__v"), "$.message").alias("__message"),
        F.when(_type(_c("__v"), "$.stats").startswith("OBJECT"), F.try_variant_get(_c("__v"), "$.stats", "variant")).alias("stats"),
    )
    read = whole.select(*df.columns, F.inline(F.array(fields)))
    both = _c("__code").isNotNull() & _c("__message").isNotNull()
    return read.select(
        *df.columns,
        F.when(both, _c("__code")).alias("code"),
        F.when(both, _c("__message")).alias("message"),
        "stats",
    ).where(_c("code").isNotNull() | _c("stats").isNotNull())


def report_failures(reports: DataFrame) -> DataFrame:
    """The reports of something that could not be played past; stats sent under code 0 are none."""
    return reports.where(_c("code").isNotNull() & ((_c("code") != 0) | _c("stats").isNull()))


def report_stats(reports: DataFrame) -> DataFrame:
    """One flat typed row a report with stats."""
    s = _c("stats")
    idle = number(s, "$.fragments.idleLowMs")
    return reports.where(s.isNotNull()).select(
        *[c for c in reports.columns if c not in ("code", "message", "stats", "body")],
        *[short(s, f"$.{k}").alias(k) for k in ("event", "browser", "engine", "buffers")],
        number(s, "$.fragments.count").alias("fragments"),
        number(s, "$.fragments.bytes").alias("bytes"),
        number(s, "$.fragments.loadMs").alias("load_ms"),
        number(s, "$.fragments.kbpsMedian").alias("kbps_median"),
        number(s, "$.fragments.kbpsP10").alias("kbps_p10"),
        number(s, "$.fragments.slowestMs").alias("slowest_ms"),
        F.when(idle > 0, idle).alias("idle_low_ms"),
        number(s, "$.bandwidthEstimateKbps").alias("estimate_kbps"),
        number(s, "$.droppedFrames").alias("dropped"),
        number(s, "$.totalFrames").alias("frames"),
    )


def stats_by_client(flat: DataFrame) -> DataFrame:
    """Reports, dropped frames and exact tenths of the median rate by browser and engine.

    The four columns are stored, as they are read twice and come out of bodies that are dear to parse.
    """
    by = ["browser", "engine"]
    flat = stored(flat.select(*by, "dropped", "kbps_median"), "client-stats")
    totals = flat.groupBy(*by).agg(F.count("*").alias("reports"), F.sum("dropped").alias("dropped"))
    return with_quantiles(totals, flat, by, ["kbps_median"], {"p10": 0.1, "p50": 0.5, "p90": 0.9})


def error_kinds(reports: DataFrame, key: str) -> DataFrame:
    """(key, kind, times, fatal, first): each kind of error once a report, in the order first seen."""
    listed = reports.select(key, F.posexplode(elements(_c("stats"), "$.errors")).alias("pos", "e"))
    count = number(_c("e"), "$.count")
    return (
        listed.select(
            key,
            "pos",
            F.coalesce(short(_c("e"), "$.details"), F.lit("?")).alias("kind"),
            F.coalesce(boolean(_c("e"), "$.fatal"), F.lit(False)).alias("fatal"),
            F.when(count.isNull(), F.lit(1)).otherwise(F.greatest(count, F.lit(1.0))).cast("bigint").alias("n"),
        )
        .groupBy(key, "kind")
        .agg(F.sum("n").alias("times"), F.bool_or("fatal").alias("fatal"), F.min("pos").alias("first"))
    )


def stall_rollup(reports: DataFrame, key: str) -> DataFrame:
    """(key, stalls, frozen, stalled_ms, open, fetching, idle): a report's stalls, where it says anything of them."""
    s = _c("stats")
    rows = reports.select(
        key, elements(s, "$.stalls").alias("list"), number(s, "$.stallCount").alias("count"), number(s, "$.stalledMs").alias("stalled_ms")
    )

    def having(cond) -> Column:
        return F.coalesce(F.size(F.filter("list", cond)), F.lit(0))

    n = F.when(_c("count").isNull(), 0).otherwise(F.greatest(_c("count"), F.lit(0.0))).cast("bigint")
    return rows.where(_c("list").isNotNull() | _c("count").isNotNull()).select(
        key,
        F.greatest(n, F.coalesce(F.size("list"), F.lit(0))).cast("bigint").alias("stalls"),
        having(lambda x: F.coalesce(text(x, "$.kind") == "frozen", F.lit(False))).alias("frozen"),
        "stalled_ms",
        having(lambda x: F.coalesce(_type(x, "$.ms") == "VOID", F.lit(False))).alias("open"),
        having(lambda x: F.coalesce(boolean(x, "$.loading"), F.lit(False))).alias("fetching"),
        having(lambda x: F.coalesce(~boolean(x, "$.loading"), F.lit(False))).alias("idle"),
    )


def _whole(n: Column) -> Column:
    return F.bround(n, 0).cast("bigint").cast("string")


def stall_words(s: Column) -> Column:
    """One stall in words; a part that it doesn't tell, or tells in a wrong type, is left out.

    Fixed values: the wording of the parts, ``at=512s frozen 4200ms v=12.0 a=11.8 idle=8200ms``, `ms=?` for one not over yet.
    """
    loading, idle = boolean(s, "$.loading"), number(s, "$.idleMs")
    lasted = F.when(_type(s, "$.ms") == "VOID", "ms=?").otherwise(F.concat(_whole(number(s, "$.ms")), F.lit("ms")))
    waiting = F.coalesce(F.concat(F.lit("idle="), _whole(idle), F.lit("ms")), F.lit("idle"))
    told = F.concat_ws(
        " ",
        F.concat(F.lit("at="), _whole(number(s, "$.at")), F.lit("s")),
        short(s, "$.kind"),
        lasted,
        _tenths("v=", number(s, "$.videoAhead")),
        _tenths("a=", number(s, "$.audioAhead")),
        F.when(loading, "fetching").when(~loading, waiting),
    )
    return F.coalesce(F.nullif(told, F.lit("")), F.lit("?"))


def _tenths(name: str, n: Column) -> Column:
    return F.when(n.isNotNull(), F.format_string(name + "%.1f", F.bround(n, 1)))


def stalls_with_rest(reports: DataFrame, key: str, k: int = SHOWN) -> DataFrame:
    """(key, stalls_shown): a report's first ``k`` stalls in words, and how many more it counts; rows with a list only."""
    s = _c("stats")
    rows = reports.select(key, elements(s, "$.stalls").alias("l"), number(s, "$.stallCount").alias("count")).where(F.size("l") > 0)
    total = F.greatest(F.coalesce(_c("count"), F.lit(0.0)).cast("bigint"), F.size("l").cast("bigint"))
    rest = total - F.least(F.size("l"), F.lit(k))
    more = F.when(rest > 0, F.concat(F.lit("+"), rest.cast("string"), F.lit(" more")))
    return rows.select(key, F.concat_ws("; ", F.transform(F.slice("l", 1, k), stall_words), more).alias("stalls_shown"))


def top_k_with_rest(kinds: DataFrame, key: str, k: int = SHOWN) -> DataFrame:
    """(key, shown): a report's first ``k`` kinds of error in words, and how many more there were.

    A report is at most 64 KB, and so are its kinds.
    """
    words = F.concat(
        _c("kind"),
        F.when(_c("times") > 1, F.concat(F.lit(" x"), _c("times").cast("string"))).otherwise(""),
        F.when(_c("fatal"), "(fatal)").otherwise(""),
    )
    rows = kinds.select(key, "first", words.alias("w"))
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "w"))).alias("l"))
    rest = F.size("l") - k
    return packed.select(
        key,
        F.concat_ws(",", F.slice(_c("l.w"), 1, k), F.when(rest > 0, F.concat(F.lit("+"), rest.cast("string"), F.lit(" more")))).alias("shown"),
    )
