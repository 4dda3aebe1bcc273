"""Language tags, compared as ISO 639-1 where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ISO 639-1, 639-2/B, 639-2/T, English name.
LANGUAGES = (
    ("en", "eng", "eng", "English"),
    ("fi", "fin", "fin", "Finnish"),
    ("sv", "swe", "swe", "Swedish"),
    ("no", "nor", "nor", "Norwegian"),
    ("nb", "nob", "nob", "Norwegian"),
    ("nn", "nno", "nno", "Norwegian"),
    ("da", "dan", "dan", "Danish"),
    ("is", "ice", "isl", "Icelandic"),
    ("de", "ger", "deu", "German"),
    ("fr", "fre", "fra", "French"),
    ("es", "spa", "spa", "Spanish"),
    ("it", "ita", "ita", "Italian"),
    ("pt", "por", "por", "Portuguese"),
    ("nl", "dut", "nld", "Dutch"),
    ("pl", "pol", "pol", "Polish"),
    ("cs", "cze", "ces", "Czech"),
    ("sk", "slo", "slk", "Slovak"),
    ("hu", "hun", "hun", "Hungarian"),
    ("ro", "rum", "ron", "Romanian"),
    ("bg", "bul", "bul", "Bulgarian"),
    ("hr", "hrv", "hrv", "Croatian"),
    ("sr", "srp", "srp", "Serbian"),
    ("sl", "slv", "slv", "Slovenian"),
    ("el", "gre", "ell", "Greek"),
    ("tr", "tur", "tur", "Turkish"),
    ("ru", "rus", "rus", "Russian"),
    ("uk", "ukr", "ukr", "Ukrainian"),
    ("et", "est", "est", "Estonian"),
    ("lv", "lav", "lav", "Latvian"),
    ("lt", "lit", "lit", "Lithuanian"),
    ("ar", "ara", "ara", "Arabic"),
    ("he", "heb", "heb", "Hebrew"),
    ("fa", "per", "fas", "Persian"),
    ("hi", "hin", "hin", "Hindi"),
    ("ta", "tam", "tam", "Tamil"),
    ("te", "tel", "tel", "Telugu"),
    ("ja", "jpn", "jpn", "Japanese"),
    ("ko", "kor", "kor", "Korean"),
    ("zh", "chi", "zho", "Chinese"),
    ("th", "tha", "tha", "Thai"),
    ("vi", "vie", "vie", "Vietnamese"),
    ("id", "ind", "ind", "Indonesian"),
    ("ms", "may", "msa", "Malay"),
)
NORWEGIAN = {"nb": "no", "nn": "no"}
UNDETERMINED = "und"


def _codes() -> dict[str, tuple[str, str]]:
    out: dict[str, tuple[str, str]] = {}
    for one, biblio, term, name in LANGUAGES:
        for code in (one, biblio, term):
            out.setdefault(code, (NORWEGIAN.get(one, one), name))
    return out


def language_dim(spark: SparkSession) -> DataFrame:
    """(code, canonical, language_name): a constant of some hundred rows."""
    rows = [(code, canon, name) for code, (canon, name) in _codes().items()]
    return spark.createDataFrame(rows, "code string, canonical string, language_name string")


def primary_subtag(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, "^([^-_]*)", 1))


def canonical(tag: Column) -> Column:
    """The expression form of :func:`canonical_language`, for use inside array functions."""
    pairs = [F.lit(x) for code, (canon, _) in _codes().items() for x in (code, canon)]
    primary = primary_subtag(tag)
    return F.when(tag.isNotNull(), F.coalesce(F.create_map(*pairs)[primary], primary))


def canonical_language(df: DataFrame, tag: str, out: str = "canonical", name: str = "language_name") -> DataFrame:
    """``df`` with the canonical code of ``tag`` and a name to show: English, "Unknown", or the tag itself."""
    dim = F.broadcast(language_dim(df.sparkSession)).alias("dim")  # a constant, so its size is known
    primary = primary_subtag(F.col(f"d.{tag}"))
    shown = F.when(F.col(f"d.{tag}") == UNDETERMINED, "Unknown").otherwise(
        F.coalesce("dim.language_name", F.col(f"d.{tag}"))
    )
    return (
        df.alias("d")
        .join(dim, primary == F.col("dim.code"), "left")
        .select("d.*", F.coalesce("dim.canonical", primary).alias(out), shown.alias(name))
    )


def ordered_union(*lists: Column) -> Column:
    """One preference list out of several: first appearance wins, order kept, empty entries dropped."""
    joined = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.array_distinct(F.filter(joined, lambda x: x.isNotNull() & (x != "")))
