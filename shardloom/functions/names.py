"""Keys, file names, URLs, durations and timestamps."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .binding import let


def image_key(index: Column) -> Column:
    """``NNNNN/imgNNNNNNNN.png``; longer indices are never cut."""
    digits = F.format_string("%08d", index)
    return F.concat(F.substring(digits, 1, 5), F.lit("/img"), digits, F.lit(".png"))


def row_key(stem: Column, row: Column) -> Column:
    return F.concat(stem, F.lit("-"), F.format_string("%09d", row))


def shard_name(stem: Column, number: Column) -> Column:
    return F.concat(stem, F.lit("-"), F.format_string("%05d", number), F.lit(".tar"))


def short_hash(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def urlsafe_hash(text: Column, length: int = 16) -> Column:
    encoded = F.base64(F.unhex(F.sha2(text, 256)))
    return F.substring(F.translate(F.regexp_replace(encoded, r"\s", ""), "+/", "-_"), 1, length)


def split_name(name: Column) -> tuple[Column, Column]:
    """Key and extension at the last dot of the base name; the extension keeps its dot."""
    pattern = r"(?s)^(.*[^/.][^/]*)(\.[^./]*)$"
    dotted = F.regexp_like(name, F.lit(pattern))
    return (
        F.when(dotted, F.regexp_extract(name, pattern, 1)).otherwise(name),
        F.when(dotted, F.regexp_extract(name, pattern, 2)).otherwise(F.lit("")),
    )


def file_extension(name: Column) -> Column:
    return F.lower(split_name(name)[1])


def parent_dir(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def shard_prefix(url: Column) -> Column:
    """Base name of a shard without its trailing ``-digits`` and ``.tar``."""
    base = F.regexp_extract(url, r"([^/]*)$", 1)
    return F.regexp_replace(F.regexp_replace(base, r"\.tar$", ""), r"-\d+$", "")


def sidecar_path(shard_url: Column, suffix: str) -> Column:
    return F.replace(shard_url, F.lit(".tar"), F.lit(f"{suffix}.json"))


# scheme, authority, path, query, fragment of a URL
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_parts(url: Column) -> dict[str, Column]:
    fields = ("scheme", "netloc", "path", "query", "fragment")
    return {f: F.regexp_extract(url, _URL, i + 1) for i, f in enumerate(fields)}


def url_build(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    rooted = F.when((netloc != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(F.lit("")),
        # These schemes write an empty authority too: file:///path.
        F.when((netloc != "") | F.lower(scheme).isin("file", "ftp", "http", "https"), F.concat(F.lit("//"), netloc)).otherwise(
            F.lit("")
        ),
        rooted,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def dirname(path: Column) -> Column:
    head = F.regexp_extract(path, r"(?s)^(.*/)?[^/]*$", 1)
    return F.when(F.regexp_like(head, F.lit(r"^/+$")), head).otherwise(F.regexp_replace(head, r"/+$", ""))


def _parsed(url: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in url_parts(url).items()])


def url_dir(url: Column) -> Column:
    return let(
        _parsed(url), lambda p: url_build(p["scheme"], p["netloc"], dirname(p["path"]), p["query"], p["fragment"])
    )


def normalise_path(path: Column) -> Column:
    """Collapse ``.``, ``..`` and doubled slashes; an empty path is ``.``."""
    rooted = path.startswith("/")
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    def step(done: Column, s: Column) -> Column:
        tail = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        return (
            F.when(s != "..", F.concat(done, F.array(s)))
            .when((F.size(done) > 0) & (tail != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
            .when(rooted, done)
            .otherwise(F.concat(done, F.array(s)))
        )

    parts = F.aggregate(steps, F.array().cast("array<string>"), step)
    joined = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("."))


def url_merge(base: Column, url: Column) -> Column:
    """Missing parts come from ``base``; query and fragment only from ``url``; absolute paths win."""

    def merge(b: Column, u: Column) -> Column:
        base_path = F.regexp_replace(b["path"], r";[^/]*$", "")
        slash = F.when((base_path == "") | base_path.endswith("/"), F.lit("")).otherwise(F.lit("/"))
        path = F.when(u["path"].startswith("/"), u["path"]).otherwise(
            let(F.concat(base_path, slash, u["path"]), normalise_path)
        )

        def pick(part: str) -> Column:
            return F.when(u[part] != "", u[part]).otherwise(b[part])

        return let(
            F.struct(pick("scheme").alias("s"), pick("netloc").alias("n"), path.alias("p")),
            lambda m: url_build(m["s"], m["n"], m["p"], u["query"], u["fragment"]),
        )

    return let(F.struct(_parsed(base).alias("b"), _parsed(url).alias("u")), lambda x: merge(x["b"], x["u"]))


def format_duration(seconds: Column) -> Column:
    """``HH:MM:SS`` of whole seconds; null and negative values are dashes."""
    whole = F.floor(seconds).cast("bigint")
    text = F.concat(
        F.format_string("%02d", F.floor(whole / 3600)),
        F.lit(":"),
        F.format_string("%02d", F.floor((whole % 3600) / 60)),
        F.lit(":"),
        F.format_string("%02d", whole % 60),
    )
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")) | (seconds < 0), F.lit("--:--:--")).otherwise(text)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def zone_time(ts: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm:ss")


def output_name(prompt: Column, suffix: str = ".jpg") -> Column:
    return F.concat(F.substring(prompt, 1, 100), F.lit(suffix))


@F.pandas_udf(T.StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Compatibility-decompose and drop what is not ASCII; no built-in expression does this."""
    return text.map(
        lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    )


def clean_filename(text: Column, fold: bool = True) -> Column:
    """Safe lower-case file name of at most 200 characters; ``untitled`` when nothing is left."""
    from .text import strip

    name = F.trim(strip(text), F.lit("."))
    if fold:
        # Texts that are ASCII already travel to the Python worker as nulls.
        foreign = F.length(name) != F.octet_length(name)
        name = F.coalesce(ascii_fold(F.when(foreign, name)), name)
    name = F.regexp_replace(F.replace(name, F.lit("/"), F.lit("_")), "_{2,}", "_")
    name = F.substring(F.lower(name), 1, 200)
    return F.when(name == "", F.lit("untitled")).otherwise(name)


def name_field(name: Column, pattern: str, default: str = "unknown") -> Column:
    """First group of a pattern in a name, or a default."""
    return F.coalesce(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.lit(default))
