"""URL and path functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def authority(url: Column) -> Column:
    """The authority as written (port and user included); empty if there is none."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)


def fold_dots(path: Column) -> Column:
    """Dot segments of a path folded; a last `.` or `..` leaves its slash."""
    parts = F.split(path, "/")
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, p: F.when(p == ".", a).when(p == "..", F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)).otherwise(F.concat(a, F.array(p))),
    )
    tail = F.when(path.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(folded, "/"), tail)


def urljoin(base: Column, ref: Column) -> Column:
    """Resolution of ref against an absolute base as the standard library does it: a fragment or query that is empty goes with its sign, empty segments of
    a relative path are closed up, and a scheme of the base's own with no authority after it is as if it weren't there."""
    return let(F.struct(base.alias("base"), ref.alias("ref")), lambda x: let(_parts(x["base"], x["ref"]), _joined))


def _parts(base: Column, ref: Column) -> Column:
    scheme = F.regexp_extract(base, _SCHEME, 0)
    own = F.startswith(F.lower(ref), F.lower(scheme)) & ~F.startswith(F.substr(ref, F.length(scheme) + 1), F.lit("//")) & F.lower(scheme).isin("http:", "https:", "ftp:", "file:")
    to = F.when(own, F.substr(ref, F.length(scheme) + 1)).otherwise(ref)
    return F.struct(base.alias("base"), ref.alias("ref"), scheme.alias("scheme"), to.alias("to"), F.regexp_extract(to, r"^[^?#]*", 0).alias("path"), F.regexp_extract(base, r"^[^?#]*", 0).alias("bare"))


def _joined(x: Column) -> Column:
    base, ref, scheme, to, to_path, bare = (x[c] for c in ("base", "ref", "scheme", "to", "path", "bare"))
    root = origin(base)
    folder = F.regexp_extract(F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"^(.*/)?", 0)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_extract(to, r"^[^?#]*(.*)$", 1), r"#$", ""), r"^\?(?=#|$)", "")
    inside = F.regexp_replace(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), to_path), "/{2,}", "/")
    trimmed = lambda x: F.regexp_replace(F.regexp_replace(x, r"#$", ""), r"^([^?#]*)\?(?=#|$)", "$1")
    return (
        F.when(ref == "", base)
        .when(to.rlike(_SCHEME), F.when(F.startswith(F.lower(to), F.lower(scheme)), trimmed(to)).otherwise(to))
        .when(F.startswith(to, F.lit("//")), trimmed(F.concat(scheme, to)))
        .when((to_path == "") & F.startswith(rest, F.lit("?")), F.concat(bare, rest))
        .when(to_path == "", F.concat(trimmed(F.regexp_extract(base, r"^[^#]*", 0)), rest))
        .when(F.startswith(to, F.lit("/")), F.concat(root, fold_dots(to_path), rest))
        .otherwise(F.concat(root, fold_dots(inside), rest))
    )


def unquoted(ref: Column) -> Column:
    """Without its fragment, percent-decoded; a plus stays one."""
    return percent_decoded(F.split_part(ref, F.lit("#"), F.lit(1)))


def percent_decoded(x: Column) -> Column:
    """A percent sign without two hexadecimal digits after it stays as it is, and so does a plus."""
    return F.url_decode(F.replace(F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def percent_encoded(x: Column) -> Column:
    """All but letters, digits, `_.-~` and slashes as percent codes."""
    out = F.url_encode(x)
    for code, char in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def norm_path(path: Column) -> Column:
    """POSIX normal form of a relative path."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(p))),
    )
    joined = F.array_join(folded, "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^(.*/)?", 0), r"/+$", "")


def resource_path(section: Column, ref: Column) -> Column:
    """A section's reference as an archive path; null if it is empty or leads outside."""
    clean = strip(unquoted(ref))
    return F.when((clean == "") | clean.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string")).otherwise(
        F.when(F.startswith(clean, F.lit("/")), norm_path(clean)).otherwise(norm_path(F.concat(folder_of(section), F.lit("/"), clean)))
    )


def config_name(url: Column) -> Column:
    """Last path segment, else the authority with hyphens."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_extract(url, r"^[^?#]*", 0), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "/"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.replace(authority(url), F.lit("."), F.lit("-")))


def with_slash(url: Column) -> Column:
    return F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/"))
