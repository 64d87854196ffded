"""URL columns. Regular expressions, since strict URI parsing fails on real links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: URL grammar and the API address of a repository listing ---
URL_RE = r"\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
VIDEO_RE = r"(?:v=|/)([a-zA-Z0-9_-]{11})"
LISTING_API = "https://api.github.com/repos/"


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, URL_RE, 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, URL_RE, 2)


def url_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, URL_RE, 3), r";[^/]*\z", "")


def is_url(text: Column) -> Column:
    return F.coalesce((scheme(text) != "") & (host(text) != ""), F.lit(False))


def url_kind(url: Column) -> Column:
    """First match of the host and path rules; hosts are tested by containment."""
    h, p = host(url), url_path(url)
    has = lambda text: F.contains(h, F.lit(text))
    return (
        F.when(has("github.com"), "github")
        .when(has("youtube.com") | has("youtu.be"), "youtube")
        .when(has("arxiv.org") & F.contains(p, F.lit("/abs/")), "arxiv")
        .when(F.endswith(F.lower(p), F.lit(".pdf")), "pdf")
        .otherwise("web")
    )


def video_id(url: Column) -> Column:
    found = F.regexp_extract(url, VIDEO_RE, 1)
    return F.when(found != "", found)


def abstract_pdf_url(url: Column) -> Column:
    return F.concat(F.replace(url, F.lit("/abs/"), F.lit("/pdf/")), F.lit(".pdf"))


def content_route(mime: Column, url: Column) -> Column:
    m = F.lower(mime)
    return (
        F.when(F.contains(m, F.lit("application/pdf")) | F.endswith(F.lower(url), F.lit(".pdf")), "pdf")
        .when(F.contains(m, F.lit("text/html")), "html")
        .otherwise("unsupported")
    )


def route_error(mime: Column, url: Column) -> Column:
    return F.when(
        content_route(mime, url) == "unsupported",
        F.concat(F.lit("Error: Unsupported content type '"), F.lower(mime), F.lit("'")),
    )


def repo_parts(url: Column) -> Column:
    """Owner/name, branch, sub-path and listing address of a repository URL."""
    steps = F.split(F.trim(url_path(url), F.lit("/")), "/", -1)
    repo = F.concat_ws("/", F.get(steps, F.lit(0)), F.get(steps, F.lit(1)))
    in_tree = F.coalesce((F.size(steps) > 3) & (F.get(steps, F.lit(2)) == "tree"), F.lit(False))
    branch = F.when(in_tree, F.get(steps, F.lit(3))).otherwise("")
    below = F.when(
        in_tree, F.array_join(F.slice(steps, F.lit(5), F.greatest(F.size(steps) - 4, F.lit(0))), "/")
    ).otherwise("")
    api = F.concat(
        F.lit(LISTING_API), repo, F.lit("/contents/"), below,
        F.when(branch != "", F.concat(F.lit("?ref="), branch)).otherwise(""),
    )
    return F.struct(repo.alias("repo"), branch.alias("branch"), below.alias("sub_path"), api.alias("listing_url"))
