"""String, name, hash and date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(name: Column) -> Column:
    """PEP 503."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def normalize_dist(name: Column) -> Column:
    return F.regexp_replace(normalize_name(name), "^-+|-+$", "")


def alnum_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def import_name(name: Column) -> Column:
    return F.translate(F.lower(name), "-", "_")


def cwe_id(raw: Column) -> Column:
    return F.upper(F.regexp_extract(raw, r"(?i)(CWE-\d+)", 1))


def commit_parts(url: Column) -> dict[str, Column]:
    """owner, repo and sha of a commit or pull-request commit URL; '' where it is neither."""
    pattern = r"github\.com/([^/]+)/([^/]+)/(?:commit|pull/\d+/commits)/([0-9a-f]{7,40})"
    return {name: F.regexp_extract(url, pattern, k) for k, name in enumerate(("owner", "repo", "sha"), 1)}


def canonical_commit(url: Column) -> Column:
    p = commit_parts(url)
    return F.when(p["sha"] != "", F.concat(F.lit("https://github.com/"), p["owner"], F.lit("/"), p["repo"], F.lit("/commit/"), p["sha"])).otherwise(url)


def github_url(url: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), r"^git@github\.com:", "https://github.com/"), r"^http://", "https://")
    return F.regexp_replace(F.regexp_replace(plain, r"/+$", ""), r"\.git$", "")


def clean_fqn(fqn: Column) -> Column:
    """Without src and lib segments and with neighbouring repeats collapsed."""
    kept = F.filter(F.split(fqn, r"\."), lambda s: ~s.isin("src", "lib", "lib2", "lib3"))
    once = F.aggregate(kept, F.array().cast("array<string>"), lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == s), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(once, ".")


def module_name(path: Column) -> Column:
    """Dotted module of a relative path; a package's __init__ is the package."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/", "."), r"\.__init__$", "")


def cve_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"(CVE-\d{4}-\d{4,})"), F.lit(1)))


def version_literals(spec: Column) -> Column:
    return F.regexp_extract_all(spec, F.lit(r"(\d+(?:\.\d+)*)"), F.lit(1))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def strip_fences(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.ltrim(x).startswith("```")), "\n")


def backoff_seconds(error: Column, attempt: Column) -> Column:
    """The seconds that a message asks to wait for, else two to the power of the attempt."""
    asked = F.regexp_extract(error, r"retry in (\d+(?:\.\d+)?)s", 1)
    return F.when(asked != "", asked.cast("double")).otherwise(F.pow(F.lit(2.0), attempt))


def cache_key(content: Column, tool: str, version: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{tool}@{version}:"), F.sha2(content, 256)), 256)


def fresh(fetched_at: Column, now: Column, days: int = 30) -> Column:
    """Whether a timestamp text lies less than so many days before now; what isn't one is not fresh."""
    return F.coalesce(F.try_to_timestamp(fetched_at) > now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))


def alias_pattern(alias: Column) -> Column:
    return F.concat(F.regexp_extract(alias, r"([A-Za-z0-9_.]+)$", 1), F.lit("(...)"))


def purl(package: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:pypi/"), F.lower(F.trim(package)), F.when(version != "", F.concat(F.lit("@"), version)).otherwise(""))


def node_id(kind: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts])


def major_jump(a: Column, b: Column) -> Column:
    """Whether both begin with a number and these differ upwards."""
    x, y = F.regexp_extract(a, r"^(\d+)", 1), F.regexp_extract(b, r"^(\d+)", 1)
    return F.coalesce((x != "") & (y != "") & (y.try_cast("int") > x.try_cast("int")), F.lit(False))


def defined_name(header: Column) -> tuple[Column, Column]:
    """(name, kind) of a diff's section header that begins a function or class."""
    return F.regexp_extract(header, r"(?:def|class)\s+([A-Za-z_]\w*)", 1), F.when(header.rlike(r"\bclass\s+\w"), "class").when(header.rlike(r"\bdef\s+\w"), "function").otherwise("")
