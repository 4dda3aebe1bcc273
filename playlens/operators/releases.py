"""Which releases a player can have, and how.

The expressions read flat columns: a listing's (``codec``, ``bit_depth``, ``resolution``, ``hdr``, ``probed``,
``dv_profile``), a probe's (``video``, ``codecs``, ``hdr``, ``dv_profile``, ``dv_compat`` …) and a player's
capabilities. ``reported`` says whether the player sent any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.functions.codecs import av1_depth, av1_range, codec_profile_level, dolby_vision_signal

# Extensions of containers that are never opened.
LEFT_OUT = (
    ".avi", ".ts", ".m2ts", ".mts", ".m2t", ".iso", ".img", ".wmv", ".asf", ".mpg", ".mpeg", ".vob",
    ".flv", ".rm", ".rmvb", ".divx", ".ogm", ".ogv", ".webm",
)
UNPLAYABLE_TTL = 7 * 24 * 3600

COPY, CONVERT, NEVER = "copy", "convert", "never"
FIT_RANK = {COPY: 0, CONVERT: 1, NEVER: 2}

CAPABILITIES = (
    "reported", "takes_hevc_flag", "h264", "h264_high10", "hevc_main", "hevc_main10", "hevc_high_tier", "p_hdr", "eac3",
    "aac_multichannel", "dv_p5", "dv_p8", "av1", "av1_main10", "av1_hdr", "flac", "aac71", "vp9", "vp9_profile2",
)

_c = F.col


def release_name() -> Column:
    return F.coalesce("filename", "title")


def left_out_extension(name: Column) -> Column:
    ext = F.regexp_extract(F.lower(name), r"(\.[a-z0-9]+)$", 1)
    return F.when(ext.isin(*LEFT_OUT), ext)


def is_imdb(tag: Column) -> Column:
    return tag.rlike("^tt[0-9]{1,10}$")


def title_id(imdb: Column, season: Column, episode: Column) -> Column:
    return F.when(season.isNull() | episode.isNull(), imdb).otherwise(
        F.concat_ws(":", imdb, season.cast("string"), episode.cast("string"))
    )


def title_kind(tag: Column) -> Column:
    return F.when(tag.contains(":"), "series").otherwise("movie")


def eligible(av1: Column, vp9: Column) -> Column:
    codec = F.lower("codec")
    known = codec.isNull() | codec.isin("h264", "hevc") | (av1 & (codec == "av1")) | (vp9 & (codec == "vp9"))
    return (
        _c("cached").eqNullSafe(F.lit(True))
        & F.coalesce(known, F.lit(False))
        & ~_c("three_d")
        & left_out_extension(release_name()).isNull()
    )


def eligible_releases(df: DataFrame, av1: Column | bool = False, vp9: Column | bool = False) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.where(eligible(as_col(av1), as_col(vp9)))


def is_uhd() -> Column:
    return F.coalesce(F.lower("resolution").isin("2160p", "4k"), F.lit(False))


def classify_fit() -> Column:
    """copy, convert or never, from what the listing says before anything is opened."""
    codec, uhd, ten = F.lower("codec"), is_uhd(), _c("bit_depth") >= 10
    has = _c("reported")
    h264 = F.when(ten & (_c("probed") | ~_c("hdr")), _c("h264_high10")).otherwise(_c("h264"))
    hevc = F.when(ten, _c("hevc_main10")).otherwise(F.greatest("hevc_main", "hevc_main10"))
    av1 = F.when(~has, 0).when(ten, _c("av1_main10")).otherwise(F.greatest("av1", "av1_main10"))
    vp9 = has & F.when(_c("bit_depth") == 0, _c("vp9") | _c("vp9_profile2")).when(ten, _c("vp9_profile2")).otherwise(
        _c("vp9")
    )

    def unless(bad: Column, verdict: str) -> Column:
        return F.when(bad, verdict).otherwise(COPY)

    return (
        F.when((_c("dv_profile") == 5) & ~(has & _c("dv_p5")), CONVERT)
        .when((codec == "h264") & has, unless((h264 == 0) | (uhd & (h264 < 51)), NEVER))
        .when((codec == "hevc") & has, unless((hevc == 0) | (uhd & (hevc < 150)) | (_c("hdr") & ~_c("p_hdr")), CONVERT))
        .when(codec == "av1", unless((av1 == 0) | (uhd & (av1 < 12)) | (_c("hdr") & ~(has & _c("av1_hdr"))), NEVER))
        .when(codec == "vp9", unless(~vp9, NEVER))
        .when((codec == "hevc") & ~has & ~_c("takes_hevc_flag"), CONVERT)
        .otherwise(COPY)
    )


def probe_facts(media: DataFrame) -> DataFrame:
    """``media`` with what its codec string and Dolby Vision record name: worked out once a release, before any join."""
    named = codec_profile_level(_c("codecs"))
    bits = F.try_element_at(F.split("codecs", r"\."), F.lit(4))
    return media.withColumn("__named", named).select(
        *media.columns,
        _c("__named.profile").alias("named_profile"),
        _c("__named.level").alias("named_level"),
        _c("__named.high_tier").alias("named_high"),
        av1_depth(_c("codecs")).alias("av1_bits"),
        F.when(_c("video") == "vp9", bits).alias("vp9_bits"),
        dolby_vision_signal(_c("dv_profile"), _c("dv_compat"), _c("dv_level")).alias("dv_signal"),
    )


def _player_takes() -> Column:
    """Whether a reporting player takes the probed video as it is. A level the file does not name is taken."""
    profile, level, high = _c("named_profile"), _c("named_level"), F.coalesce("named_high", F.lit(False))
    untold = profile.isNull()

    def fits(limit: Column) -> Column:
        return (limit > 0) & (untold | (level <= limit))

    hevc = (
        F.when(high, _c("hevc_high_tier"))
        .when(untold | (profile == 1), F.greatest("hevc_main", "hevc_main10"))
        .when(profile == 2, _c("hevc_main10"))
        .otherwise(0)
    )
    av1 = (
        F.when(~untold & ((profile != 0) | high), 0)
        .when(_c("av1_bits") == 10, _c("av1_main10"))
        .when(_c("av1_bits").isNull() | (_c("av1_bits") == 8), F.greatest("av1", "av1_main10"))
        .otherwise(0)
    )
    h264 = F.when(profile == 110, _c("h264_high10")).otherwise(_c("h264"))
    vp9 = F.when(profile == 0, _c("vp9")).when((profile == 2) & (_c("vp9_bits") == "10"), _c("vp9_profile2"))
    takes = (
        F.when(_c("video") == "h264", fits(h264))
        .when(_c("video") == "hevc", fits(hevc) & (~_c("hdr") | _c("p_hdr")))
        .when(_c("video") == "av1", fits(av1) & (~_c("hdr") | _c("av1_hdr")))
        .when(_c("video") == "vp9", vp9)
    )
    return F.coalesce(takes, F.lit(False))


def _said(verdict: str, why: Column | str | None) -> Column:
    reason = why if isinstance(why, Column) else F.lit(why).cast("string")
    return F.struct(F.lit(verdict).alias("plays"), reason.alias("why"))


def judge(pairs: DataFrame) -> DataFrame:
    """Probed releases (with :func:`probe_facts`) beside players, judged:

    ``takes`` (by its report), ``plays_it`` (a player that reported nothing can only have said that it takes no HEVC),
    ``keeps_dv``, ``blank`` (Dolby Vision with no base layer, to a player that neither shows it nor takes the release as
    it is) and ``verdict``, struct(plays, why).
    """
    unreported = F.when(_c("video") == "hevc", _c("takes_hevc_flag")).otherwise(~_c("video").isin("av1", "vp9"))
    shown = F.when(_c("dv_profile") == 5, _c("dv_p5")).when(_c("dv_profile") == 8, _c("dv_p8"))
    bare = F.coalesce(_c("dv_compat") == 0, F.lit(False)) & ~_c("dv_mismatch")
    codec = F.coalesce("codecs", F.lit("video"))
    profile5 = F.concat(
        F.format_string("Dolby Vision profile %d", F.coalesce("dv_profile", F.lit(5))),
        F.when(_c("dv_recordless"), " without a record").otherwise(""),
    )
    verdict = (
        F.when(_c("blank"), _said("no", profile5))
        .when(_c("plays_it"), _said("yes", None))
        .when(_c("video") == "hevc", _said("convert", F.concat(codec, F.lit(" is converted"))))
        .otherwise(_said("no", F.concat(codec, F.lit(" is beyond the player"))))
    )
    return (
        pairs.withColumn("takes", _player_takes())
        .withColumn("plays_it", F.when(_c("reported"), _c("takes")).otherwise(unreported))
        .withColumn("keeps_dv", F.coalesce(_c("reported") & _c("dv_signal").isNotNull() & shown, F.lit(False)))
        .withColumn("blank", bare & ~(_c("keeps_dv") & _c("plays_it")))
        .withColumn("verdict", verdict)
    )


def listed_verdict(fit: Column) -> Column:
    """struct(plays, why) from the listing alone."""
    return (
        F.when(fit == COPY, _said("yes", None))
        .when((fit == CONVERT) & (_c("dv_profile") == 5), _said("convert", "Dolby Vision profile 5 needs a base layer"))
        .when(fit == CONVERT, _said("convert", "converted"))
        .otherwise(_said("no", F.concat(F.coalesce("codec", F.lit("video")), F.lit(" is not decoded"))))
    )


def audio_plan(codec: Column, channels: Column) -> Column:
    """struct(copied_as, out, bitrate, channels): a track copied where the player plays it, else AAC."""
    dolby = F.when(codec.isin("A_EAC3", "ec-3"), "ec-3").when(codec.startswith("A_AC3") | (codec == "ac-3"), "ac-3")
    flac = F.when(codec.isin("A_FLAC", "fLaC"), "fLaC")
    has = _c("reported")
    copied = F.coalesce(F.when(has & _c("eac3"), dolby), F.when(has & _c("flac"), flac))

    def plan(out: str, rate: int | None, carried: Column) -> Column:
        return F.struct(
            copied.alias("copied_as"),
            F.lit(out).alias("out"),
            F.lit(rate).cast("bigint").alias("bitrate"),
            carried.cast("int").alias("channels"),
        )

    return (
        F.when(copied.isNotNull(), plan("copy", None, channels))
        .when((channels >= 8) & has & _c("aac71"), plan("aac-7.1", 512_000, F.lit(8)))
        .when((channels >= 6) & has & _c("aac_multichannel"), plan("aac-5.1", 384_000, F.lit(6)))
        .otherwise(plan("aac-stereo", 192_000, F.lit(2)))
    )


def signal_range(transcoded: Column) -> Column:
    """struct(codecs, supplemental, range) the manifest names for a judged release's picture as it is sent."""
    kept = _c("keeps_dv") & ~_c("dv_mismatch") & ~transcoded
    dv = _c("dv_signal")
    copied = F.when(_c("video") == "av1", av1_range(_c("codecs"))).when(
        _c("video").isin("hevc", "vp9") & _c("hdr"), F.when(_c("hlg"), "HLG").otherwise("PQ")
    )
    return F.struct(
        F.when(kept, F.coalesce(dv["codecs"], _c("codecs"))).otherwise(_c("codecs")).alias("codecs"),
        F.when(kept, dv["supplemental"]).alias("supplemental"),
        F.when(kept, dv["range"]).when(~transcoded, copied).alias("range"),
    )


def tone_mapped(transcoded: Column) -> Column:
    return transcoded & (_c("hdr") | F.coalesce(_c("dv_compat") != 2, F.lit(False)))


def with_memory(releases: DataFrame, unplayable: DataFrame) -> DataFrame:
    """``releases`` with the newest lasting verdict under (title, size, name), for :func:`recalled` to weigh at a request's time."""
    memory = unplayable.groupBy("title_id", "size_bytes", "name").agg(
        F.max("found_at").alias("__found"), F.max_by("why", "found_at").alias("__why")
    )
    joined = releases.withColumn("name", release_name()).join(memory.hint("merge"), ["title_id", "size_bytes", "name"], "left")
    return joined.select(*releases.columns, "__found", "__why")


def recalled(candidates: DataFrame) -> DataFrame:
    """Rows of :func:`with_memory` beside requests, with ``remembered_why``: the verdict where it is young enough at ``at``."""
    young = (_c("size_bytes") > 0) & (_c("at") - _c("__found") < UNPLAYABLE_TTL)
    return candidates.withColumn("remembered_why", F.when(young, _c("__why"))).drop("__found", "__why")


def remembered(candidates: DataFrame, unplayable: DataFrame) -> DataFrame:
    """``candidates`` with ``remembered_why``: a lasting verdict under (title, size, name), young enough at ``at``.

    A release of unknown size has no such identity.
    """
    return recalled(with_memory(candidates, unplayable))


def codecs_taken() -> Column:
    """0 to 3: whether AV1 (2) and VP9 (1) count as eligible for a player. The place in arrays by kind of player."""
    av1 = _c("reported") & ((_c("av1") > 0) | (_c("av1_main10") > 0))
    vp9 = _c("reported") & (_c("vp9") | _c("vp9_profile2"))
    return F.when(av1, 2).otherwise(0) + F.when(vp9, 1).otherwise(0)


def with_standing(releases: DataFrame) -> DataFrame:
    """``releases`` with ``__eligible`` and ``__leads``, arrays by :func:`codecs_taken`: whether it is eligible, and the first of
    those in its title under its name. Worked out once a release, before any request; a title's releases are a short list."""
    open_to = [eligible(F.lit(av1), F.lit(vp9)) for av1 in (False, True) for vp9 in (False, True)]
    alike, place = Window.partitionBy("title_id", release_name()), F.struct("listed_pos", "release_id")
    leads = [ok & F.min(F.when(ok, place)).over(alike).eqNullSafe(place) for ok in open_to]
    return releases.withColumns({"__eligible": F.array(*open_to), "__leads": F.array(*leads)})


def candidates(offers: DataFrame) -> DataFrame:
    """``offers`` (a request's releases, :func:`with_standing`, with player columns) that are worth opening, with ``named`` and ``fit``.

    ``wanted_name``, ``excluded`` (names), ``remembered_why``, ``no_transcode`` and ``fits_only`` are the request's.
    """
    name, kind = release_name(), codecs_taken()
    named = name.eqNullSafe(_c("wanted_name")) & F.get("__leads", kind)
    marked = offers.where(F.get("__eligible", kind)).withColumn("named", named).withColumn("fit", classify_fit())
    may_convert = ~_c("no_transcode") & ~_c("fits_only")
    open_to = (
        ~F.coalesce(F.array_contains("excluded", name), F.lit(False))
        & _c("remembered_why").isNull()
        & (_c("fit") != NEVER)
        & ((_c("fit") != CONVERT) | may_convert)
    )
    return marked.where(open_to).drop("__eligible", "__leads")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`candidates` with ``rank``: the named release leads, then by fit, listing order within.

    A request sees the releases of one title, a short list: rows dealt by title stay where they are. Rows are sorted whole, so
    what is wide is better reduced before.
    """
    mine = [x for x in ("title_id", "request_id") if x in rows.columns]
    order = Window.partitionBy(*mine).orderBy(
        _c("named").desc(), F.when(_c("fit") == COPY, 0).otherwise(1), "listed_pos", "release_id"
    )
    return rows.withColumn("rank", F.row_number().over(order))


def rank_candidates(offers: DataFrame) -> DataFrame:
    """:func:`candidates` of ``offers``, :func:`ranked`."""
    return ranked(candidates(offers))


def cheapest(df: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` releases of each title to read first: up to 1080p before larger, then by size."""
    usable = df.where(
        _c("cached").eqNullSafe(F.lit(True)) & ~_c("three_d") & left_out_extension(release_name()).isNull()
    )
    res = F.lower("resolution")
    uhd = F.coalesce(res.contains("2160") | res.contains("4k"), F.lit(False))
    w = Window.partitionBy("title_id").orderBy(uhd, _c("size_bytes").asc_nulls_last(), "listed_pos", "release_id")
    return usable.withColumn("rank", F.row_number().over(w)).where(_c("rank") <= k)


def drop_excluded(candidates: DataFrame, exclude: DataFrame) -> DataFrame:
    """``exclude``: (request_id, name)."""
    return candidates.withColumn("name", release_name()).join(exclude, ["request_id", "name"], "left_anti")


def compatibility_matrix(players: DataFrame, media: DataFrame) -> DataFrame:
    """Every kind of player against every kind of release: (class, traits, plays, why, n_players, n_releases).

    What a verdict depends on is a handful of columns, so players and releases are first counted by them. The pairs
    are then an equi-join on the codec of two small tables, and stand for all players times all releases.
    """
    traits = ["video", "codecs", "hdr", "dv_profile", "dv_compat", "dv_level", "dv_mismatch", "dv_recordless"]
    kinds = players.groupBy("class", *CAPABILITIES).agg(F.count("*").alias("n_players"))
    shapes = probe_facts(media.groupBy(*traits).agg(F.count("*").alias("n_releases")))
    family = F.when(_c("video").isin("h264", "hevc", "av1", "vp9"), _c("video")).otherwise("other")
    every = F.explode(F.array(*[F.lit(x) for x in ("h264", "hevc", "av1", "vp9", "other")]))
    pairs = kinds.withColumn("family", every).join(shapes.withColumn("family", family), "family")
    return judge(pairs).select("class", *traits, "n_players", "n_releases", "verdict.plays", "verdict.why")


def met_kinds(requests: DataFrame, titles: DataFrame, media: DataFrame, players: DataFrame, traits: list[str]) -> DataFrame:
    """(class, capabilities, traits, n): how many times requests bring a kind of player before a kind of release.

    ``requests``: (title_id, owner); ``titles``: (title_id, release_id). Both sides are counted by title and kind before they
    meet, so a verdict is worked out once a kind, and no pair of a request and a release is ever shuffled.
    """
    who = players.select(_c("player_id").alias("owner"), "class", *CAPABILITIES)
    asked = requests.select("title_id", "owner").join(who.hint("merge"), "owner")
    asked = asked.groupBy("title_id", "class", *CAPABILITIES).agg(F.count("*").alias("__asked"))
    listed = titles.select("title_id", "release_id").join(media.select("release_id", *traits).hint("merge"), "release_id")
    listed = listed.groupBy("title_id", *traits).agg(F.count("*").alias("__listed"))
    met = asked.join(listed.hint("merge"), "title_id")
    return met.groupBy("class", *CAPABILITIES, *traits).agg(F.sum(_c("__asked") * _c("__listed")).alias("n"))


def playable_share(matrix: DataFrame) -> DataFrame:
    n = _c("n_players") * _c("n_releases")

    def share(word: str) -> Column:
        return F.sum(F.when(_c("plays") == word, n).otherwise(0)) / F.sum(n)

    return matrix.groupBy("class").agg(
        share("yes").alias("as_is"), share("convert").alias("converted"), F.sum(n).alias("pairs")
    )


def _long(*cols: Column | str) -> Column:
    """Whether one of these strings is longer than any real one."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.octet_length(c) > 256, F.lit(False))
    return cond


def _bad_time(t: Column, limit: Column) -> Column:
    return F.isnan(t) | (t < 0) | (t > limit)


def _failed_rules() -> Column:
    """Names of the rules a probe breaks, in order. Reads what its children were reduced to: kf_, ix_, au_ and su_ columns."""
    rules = {
        "container": _c("container").isin("matroska", "mp4"),
        "duration": ~F.isnan("duration") & _c("duration").between(0.0, 7 * 86400.0),
        "size": (_c("width") <= 65_535) & (_c("height") <= 65_535),
        "strings": ~_long("codecs", "video"),
        "frame_rate": F.coalesce(~F.isnan("frame_rate") & _c("frame_rate").between(0.0, 1000.0), F.lit(True)),
        "dolby_vision": F.coalesce(
            (_c("dv_profile") <= 10) & (_c("dv_compat") <= 7) & (_c("dv_level") <= 13), F.lit(True)
        ),
        "audio": (F.coalesce("au_n", F.lit(0)) <= 128) & ~F.coalesce("au_bad", F.lit(False)),
        "subtitles": (F.coalesce("su_n", F.lit(0)) <= 128) & ~F.coalesce("su_bad", F.lit(False)),
        "keyframes": (F.coalesce("kf_n", F.lit(0)) <= 65_536)
        & ~F.coalesce("kf_wild", F.lit(False))
        & ~F.coalesce("kf_unordered", F.lit(False)),
        "byte_index": (F.coalesce("ix_n", F.lit(0)) <= 65_536)
        & ~F.coalesce("ix_wild", F.lit(False))
        & ~F.coalesce("ix_unordered", F.lit(False)),
    }
    return F.filter(F.array(*[F.when(~ok, F.lit(n)) for n, ok in rules.items()]), lambda x: x.isNotNull())


def validate_media(media: DataFrame, keyframes: DataFrame, index: DataFrame, audio: DataFrame, subs: DataFrame) -> DataFrame:
    """``media`` with ``failed``: the rules each probe breaks, in order; empty when it may be used.

    The long child tables are reduced to one row a release before they meet it. ``keyframes`` and ``index`` carry
    their order in ``i``.
    """
    from playlens.operators.ordered import Scan, scan

    limits = media.select("release_id", (_c("duration") + 1.0).alias("__limit"))

    def series(df: DataFrame, values: list[str]) -> DataFrame:
        prev = scan(df, ["release_id"], ["i"], F.floor(_c("i") / 4096), [
            Scan(f"__prev_{v}", "last", _c(v), inclusive=False) for v in values
        ])
        down = F.lit(False)
        for v in values:
            down = down | F.coalesce(_c(f"__prev_{v}") > _c(v), F.lit(False))
        return (
            prev.join(limits.hint("shuffle_hash"), "release_id")
            .groupBy("release_id")
            .agg(F.count("*").alias("n"), F.max(_bad_time(_c("t"), _c("__limit"))).alias("wild"), F.max(down).alias("unordered"))
        )

    kf = series(keyframes, ["t"]).select("release_id", *[_c(c).alias(f"kf_{c}") for c in ("n", "wild", "unordered")])
    ix = series(index, ["t", "pos"]).select("release_id", *[_c(c).alias(f"ix_{c}") for c in ("n", "wild", "unordered")])
    au = audio.groupBy("release_id").agg(
        F.count("*").alias("au_n"), F.max(_long("codec", "language", "name") | (_c("channels") > 64)).alias("au_bad")
    )
    su = subs.groupBy("release_id").agg(F.count("*").alias("su_n"), F.max(_long("codec", "language")).alias("su_bad"))
    joined = media
    for child in (kf, ix, au, su):  # a few numbers a release: hashed, so that media aren't sorted
        joined = joined.join(child.hint("shuffle_hash"), "release_id", "left")
    return joined.select(*media.columns, _failed_rules().alias("failed"))


def validate_nested(media: DataFrame) -> DataFrame:
    """:func:`validate_media` for probes that carry their children as arrays, in order: ``keyframes`` (seconds),
    ``byte_index`` (t, pos), ``audio`` (codec, language, name, channels) and ``subs`` (codec, language); null ones are empty.

    Every rule is judged inside the row: nothing is exploded, grouped or joined.
    """
    limit = _c("duration") + 1.0

    def any_of(values: Column, bad) -> Column:
        return F.coalesce(F.exists(values, lambda x: F.coalesce(bad(x), F.lit(False))), F.lit(False))

    def falls(values: Column) -> Column:
        """Whether a value is less than the one before it."""
        rest = F.greatest(F.size(values) - 1, F.lit(0))
        down = F.zip_with(F.slice(values, F.lit(1), rest), F.slice(values, F.lit(2), rest), lambda x, y: x > y)
        return any_of(down, lambda x: x)

    index_t, index_pos = _c("byte_index.t"), _c("byte_index.pos")
    reduced = {
        "kf_n": F.size("keyframes"),
        "kf_wild": any_of(_c("keyframes"), lambda t: _bad_time(t, limit)),
        "kf_unordered": falls(_c("keyframes")),
        "ix_n": F.size("byte_index"),
        "ix_wild": any_of(index_t, lambda t: _bad_time(t, limit)),
        "ix_unordered": falls(index_t) | falls(index_pos),
        "au_n": F.size("audio"),
        "au_bad": any_of(_c("audio"), lambda x: _long(x["codec"], x["language"], x["name"]) | (x["channels"] > 64)),
        "su_n": F.size("subs"),
        "su_bad": any_of(_c("subs"), lambda x: _long(x["codec"], x["language"])),
    }
    return media.withColumns(reduced).select(*media.columns, _failed_rules().alias("failed"))
