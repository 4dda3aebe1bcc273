"""Codec strings, colours and Dolby Vision, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(c: Column, pattern: str = "^[0-9]+$") -> Column:
    return F.when(c.rlike(pattern), c.cast("int"))


def codec_profile_level(codecs: Column) -> Column:
    """struct(profile, level, high_tier) that an RFC 6381 string names; null where it names none."""
    part = F.split(codecs, r"\.")

    def at(i: int) -> Column:
        return F.try_element_at(part, F.lit(i))

    def named(profile: Column, level: Column, high: Column) -> Column:
        return F.when(
            profile.isNotNull() & level.isNotNull(),
            F.struct(profile.alias("profile"), level.alias("level"), high.alias("high_tier")),
        )

    def hexed(start: int) -> Column:
        two = F.substring(at(2), start, 2)
        return F.when(two.rlike("^[0-9a-fA-F]{2}$"), F.conv(two, 16, 10).cast("int"))

    no = F.lit(False)
    hevc_profile = _int(F.regexp_replace(at(2), "^[ABC]*", ""))
    hevc = named(hevc_profile, _int(F.substring(at(4), 2, 10)), at(4).startswith("H"))
    tier = F.substring(at(3), 3, 10)
    av1 = named(_int(at(2)), _int(F.substring(at(3), 1, 2), "^[0-9]{2}$"), tier == "H")
    return (
        F.when(at(1).isin("avc1", "avc3"), named(hexed(1), hexed(5), no))
        .when(at(1).isin("hvc1", "hev1"), hevc)
        .when(at(1) == "av01", av1)
        .when(at(1) == "vp09", named(_int(at(2)), _int(at(3)), no))
    )


def _av1_field(codecs: Column, i: int) -> Column:
    return F.when(codecs.startswith("av01."), F.try_element_at(F.split(codecs, r"\."), F.lit(i)))


def av1_depth(codecs: Column) -> Column:
    return _int(_av1_field(codecs, 4))


def av1_range(codecs: Column) -> Column:
    transfer = _av1_field(codecs, 8)
    return F.when(transfer == "16", "PQ").when(transfer == "18", "HLG")


def merge_colour(container: Column, stream: Column) -> Column:
    """0 and 2 both mean that the container does not say."""
    return F.when(container.isin(0, 2), stream).otherwise(container)


def is_hdr(transfer: Column, primaries: Column, matrix: Column) -> Column:
    return transfer.isin(16, 18) | (primaries == 9) | (matrix == 9)


# Level, largest picture, luma samples a second.
VP9_LEVELS = (
    (10, 36_736, 829_440),
    (11, 73_856, 2_764_800),
    (20, 122_880, 4_608_000),
    (21, 245_760, 9_216_000),
    (30, 552_960, 20_736_000),
    (31, 983_040, 36_864_000),
    (40, 2_228_224, 83_558_400),
    (41, 2_228_224, 160_432_128),
    (50, 8_912_896, 311_951_360),
    (51, 8_912_896, 588_251_136),
    (52, 8_912_896, 1_176_502_272),
    (60, 35_651_584, 1_176_502_272),
    (61, 35_651_584, 2_353_004_544),
    (62, 35_651_584, 4_706_009_088),
)


def vp9_level(width: Column, height: Column, frame_rate: Column) -> Column:
    """The lowest level covering the picture and its sample rate; 1080p and 60 a second where not known."""
    area = width.cast("bigint") * height.cast("bigint")
    picture = F.when(area == 0, F.lit(1920 * 1080)).otherwise(area)
    samples = picture * F.when(frame_rate > 0, frame_rate).otherwise(F.lit(60.0))
    (level, size, rate), *rest = VP9_LEVELS
    out = F.when((picture <= size) & (samples <= float(rate)), level)
    for level, size, rate in rest:
        out = out.when((picture <= size) & (samples <= float(rate)), level)
    return out.otherwise(62)


def vp9_codec_string(
    depth: Column,
    profile: Column,
    level: Column,
    chroma: Column,
    primaries: Column,
    transfer: Column,
    matrix: Column,
    full_range: Column,
) -> Column:
    """The whole string: what nothing records is assumed, and the colour fields are written all together or not."""
    bits = F.coalesce(depth, F.when(transfer.isin(16, 18), 10).otherwise(8))
    prof = F.coalesce(profile, F.when(bits > 8, 2).otherwise(0))
    sub = F.coalesce(chroma, F.lit(1))
    says = ~primaries.isin(0, 2) | ~transfer.isin(0, 2) | ~matrix.isin(0, 2) | (sub != 1)

    def code(c: Column) -> Column:
        return F.when(c == 0, 2).otherwise(c)

    colours = F.format_string(
        ".%02d.%02d.%02d.%02d.%02d",
        sub,
        code(primaries),
        code(transfer),
        code(matrix),
        F.coalesce(full_range, F.lit(False)).cast("int"),
    )
    return F.concat(F.format_string("vp09.%02d.%02d.%02d", prof, level, bits), F.when(says, colours).otherwise(""))


def dolby_vision_signal(profile: Column, compat: Column, level: Column) -> Column:
    """struct(codecs, supplemental, range) a manifest names kept Dolby Vision by; null where it has no name."""

    def named(codecs: Column, supplemental: Column, rng: str) -> Column:
        return F.struct(
            codecs.cast("string").alias("codecs"), supplemental.cast("string").alias("supplemental"),
            F.lit(rng).alias("range"),
        )

    def branded(brand: str, rng: str) -> Column:
        return named(F.lit(None), F.concat(F.format_string("dvh1.08.%02d/", level), F.lit(brand)), rng)

    return (
        F.when(profile == 5, named(F.format_string("dvh1.05.%02d", level), F.lit(None), "PQ"))
        .when((profile == 8) & (compat == 1), branded("db1p", "PQ"))
        .when((profile == 8) & (compat == 2), branded("db2g", "SDR"))
        .when((profile == 8) & (compat == 4), branded("db4h", "HLG"))
    )
