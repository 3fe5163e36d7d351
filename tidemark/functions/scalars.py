"""Scalar expressions: ids, time, tokens, money, text, paths and repository addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_id(*parts: Column) -> Column:
    """Content hash of a natural key: sha256 of the parts joined by U+001F (null as U+0000), 32 hex digits."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256), 1, 32)


def to_millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp without zone, floored, as UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def iso_millis(text: Column) -> Column:
    """Epoch milliseconds of an ISO-8601 text (no zone: UTC), rounded; null if it does not parse."""
    return F.round(F.unix_micros(F.try_to_timestamp(text)) / 1000).cast("long")


def nano(tokens: Column, rate_per_mtok: Column) -> Column:
    """Cost in nano units, half to even."""
    return F.rint(tokens * rate_per_mtok * F.lit(1e9) / F.lit(1e6)).cast("long")


def ttl_split(write: Column, hour: Column) -> tuple[Column, Column, Column]:
    """Cache-write tokens as (5-minute, 1-hour, assumed): an unknown hour part makes all of them 5-minute and assumed."""
    total = F.coalesce(write, F.lit(0))
    one = F.when(hour.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(hour, total)))
    return total - one, one, hour.isNull() & (total > 0)


def role(is_subagent: Column, attended: Column) -> Column:
    return F.when(is_subagent, "autonomous").when(attended == True, "human").otherwise("unattended_root")  # noqa: E712


def tokens_of(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))


def normalize_remote(url: Column) -> Column:
    """One spelling of a repository address: scp form to https, no user, lower-case host, no .git and no trailing slash."""
    u = F.trim(url)
    scp = ~u.contains("://") & u.rlike(r"^[^/@\s]+@[^/:\s]+:")
    u = F.when(scp, F.regexp_replace(u, r"^[^/@\s]+@([^/:\s]+):/*", "https://$1/")).otherwise(u)
    u = F.regexp_replace(u, r"^(ssh|git|http|https|git\+ssh)://", "https://")
    u = F.regexp_replace(u, r"^(https://)[^/@]*@", "$1")
    u = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "/+$", ""), r"\.git$", ""), "/+$", "")
    host = F.regexp_extract(u, "^https://([^/]*)", 1)
    return F.when(u.startswith("https://"), F.concat(F.lit("https://"), F.lower(host), F.substr(u, F.length(host) + 9))).otherwise(u)


def forge(remote: Column) -> dict[str, Column]:
    """host, owner and repo of a normalized address."""
    path = F.split(F.regexp_replace(remote, "^https://", ""), "/")
    return {"host": F.get(path, F.lit(0)), "owner": F.when(F.size(path) > 2, F.get(path, F.lit(1))), "repo": F.when(F.size(path) > 1, F.element_at(path, -1))}


def windows_path(path: Column) -> Column:
    return path.rlike(r"^([A-Za-z]:|\\\\)") | (path.contains("\\") & ~path.startswith("/"))


def path_key(path: Column) -> Column:
    """Comparable form: forward slashes, `.` and `..` resolved, no trailing slash; lower case for Windows paths."""
    win = windows_path(path)
    slashed = F.when(win, F.translate(path, "\\", "/")).otherwise(path)
    lead = F.when(slashed.startswith("//") & win, "//").when(slashed.startswith("/"), "/").otherwise("")
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1)).when((p == "..") & (lead != ""), done).otherwise(F.array_append(done, p)),
    )
    out = F.concat(lead, F.array_join(folded, "/"))
    return F.when(win, F.lower(out)).when(out == "", F.lit(".")).otherwise(out)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def is_ancestor(parent_key: Column, child_key: Column) -> Column:
    """Strict, whole segments, on keys of path_key."""
    return child_key.startswith(F.concat(F.regexp_replace(parent_key, "/$", ""), F.lit("/"))) & (parent_key != child_key)


def strip_date(model: Column) -> Column:
    return F.regexp_replace(model, r"-(\d{8}|\d{4}-\d{2}-\d{2})$", "")


def spelling(model: Column) -> Column:
    """A model name without provider prefixes and date, lower case, `.` and `@` as `-`."""
    return F.translate(strip_date(F.element_at(F.split(F.lower(model), "[/:]"), -1)), ".@", "--")
