"""Versions and specifiers of PEP 440 as column expressions: a text that sorts as the version does, clauses as ranges of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RELEASE_PARTS = 5
#: A version in small letters: epoch, release, pre-release and its number, post-release as "-n", as a word and its number, dev and its number, local.
VERSION = (
    r"^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]+)?)?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]+)?)?(?:[-_.]?(dev)[-_.]?([0-9]+)?)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)
CLAUSE = r"(?s)^\s*(===|~=|==|!=|<=|>=|<|>)\s*(.*?)\s*$"


def release_key(version: Column) -> Column:
    """The release numbers as an array of five, which compares as the version does; parts that aren't numbers count 0."""
    parts = F.slice(F.concat(F.transform(F.split(version, r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^(\d{1,9})", 1).try_cast("int"), F.lit(0))), F.array_repeat(F.lit(0), RELEASE_PARTS)), 1, RELEASE_PARTS)
    return parts


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once."""
    return F.transform(F.array(value), use)[0]


#: Numbers are written with this many digits; longer ones aren't read.
DIGITS = 20


def parsed(version: Column) -> Column:
    """What a version says, null if it isn't one.

    key sorts as versions do; public is the key without the local part; base is epoch and release without the zeros at
    its end, stem with them. The keys of all versions that begin with the release lie in [base, stem + "/"); wider is the
    stem of one part less, null if there is none. early begins the keys of the version and of all its post-releases, first
    those of the version and of its dev releases. pre (true of dev releases too), post, dev and local say what it has.

    All numbers have the same width. A release ends with "!", which comes before the dot of a longer one; a pre-release
    is 0 for a lone dev release, 1 and its letter and number, or 2 for none; a post-release is 1 and its number, or 0 for
    none; a dev release is 0 and its number, or 1 for none; a local part is 1 and its segments, or 0 for none: numbers
    there come after words, as ":" comes before letters and its mark after these.
    """
    kinds = "|".join(f"${k}" for k in (1, 2, 3, 4)) + "|$5$6|$5$7|$8|$9|$10"
    fields = F.regexp_replace(F.translate(F.lower(F.trim(version)), "|", "?"), VERSION, kinds)
    wide = F.regexp_replace(F.regexp_replace(fields, r"(?<![a-z0-9])([0-9]+)(?![a-z0-9])", "0" * DIGITS + "$1"), rf"(?<![a-z0-9])0*([0-9]{{{DIGITS}}})(?![a-z0-9])", "$1")

    def pieces(p: Column) -> Column:
        has = lambda k: p[k] != ""
        number = lambda k: F.lpad(p[k], DIGITS, "0")
        letter = F.when(F.startswith(p[2], F.lit("a")), "1a").when(F.startswith(p[2], F.lit("b")), "1b").otherwise("1c")
        # a number's segment is marked to come after all words, a word ends before its longer forms
        local = F.concat(F.lit("1"), F.regexp_replace(F.regexp_replace(p[8], "([a-z0-9]+)", "$1!"), rf"(^|[-_.])([0-9]{{{DIGITS}}}!)", "$1~$2"))
        return F.struct(
            F.concat(number(0), F.lit("!"), F.regexp_replace(p[1], rf"(\.0{{{DIGITS}}})+$", "")).alias("base"), F.concat(number(0), F.lit("!"), p[1]).alias("stem"),
            F.when(has(2), F.concat(letter, number(3))).when(has(6) & ~has(4), "0").otherwise("2").alias("pre"), F.when(has(4), F.concat(F.lit("1"), number(5))).otherwise("0").alias("post"),
            F.when(has(6), F.concat(F.lit("0"), number(7))).otherwise("1").alias("dev"), F.when(has(8), F.translate(local, "-_", "..")).otherwise("0").alias("local"),
        )

    def keys(x: Column) -> Column:
        early, after = F.concat(x["base"], F.lit("!"), x["pre"]), F.concat(x["post"], x["dev"])
        cut = F.regexp_replace(x["stem"], r"\.[0-9]+$", "")
        return F.struct(
            x["base"], x["stem"], F.nullif(cut, x["stem"]).alias("wider"), early.alias("early"), F.concat(early, x["post"]).alias("first"), F.concat(early, after, F.lit("0")).alias("public"),
            F.concat(early, after, x["local"]).alias("key"), (x["pre"] < "2").alias("pre"), (x["post"] != "0").alias("post"), (x["dev"] < "1").alias("dev"), (x["local"] != "0").alias("local"),
        )

    # nine fields, none of whose numbers is too long
    return _bound(F.split(wide, r"\|", -1), lambda p: F.when((F.size(p) == 9) & ~p[1].rlike(rf"[0-9]{{{DIGITS + 1}}}"), _bound(_bound(p, pieces), keys)))


def version_key(version: Column) -> Column:
    """A text that sorts as the version does among all versions of PEP 440; null if it isn't one."""
    return parsed(version)["key"]


def compare_key(version: Column) -> Column:
    """The version's key; what isn't a version comes first, by its release numbers."""
    release = F.array_join(F.transform(release_key(version), lambda p: F.lpad(p.cast("string"), 9, "0")), ".")
    return F.coalesce(version_key(version), F.concat(F.lit("!"), release))


def _clause(v: Column, text: Column, clause: Column) -> Column:
    """Whether a parsed version meets a clause; null if the clause can't be read. text: the version as written."""
    below = lambda stem: v["public"] < F.concat(stem, F.lit("/"))

    def test(c: Column) -> Column:
        op, wild = c["op"], c["wild"]

        def against(b: Column) -> Column:
            same = F.when(wild, (v["public"] >= b["base"]) & below(b["stem"])).when(b["local"], v["key"] == b["key"]).otherwise(v["public"] == b["public"])
            equal = F.when(op == "==", same).when(op == "!=", ~same)
            # a bound's own pre-releases don't come before it, nor its post-releases and local versions after it
            less = F.when(b["pre"], v["key"] < b["key"]).when(b["post"], v["key"] < b["first"]).otherwise(v["key"] < F.concat(b["base"], F.lit("!")))
            more = F.when(b["dev"] | b["post"], v["public"] > b["public"]).otherwise(v["key"] >= F.concat(b["early"], F.lit("2")))
            ordered = F.when(op == "<", less).when(op == ">", more).when(op == "<=", v["public"] <= b["public"]).when(op == ">=", v["public"] >= b["public"]).when((op == "~=") & b["wider"].isNotNull(), (v["public"] >= b["public"]) & below(b["wider"]))
            # a prefix is a release and no more
            return F.when(wild & (b["pre"] | b["post"] | b["local"]), F.lit(None).cast("boolean")).when(wild | b["local"], equal).otherwise(F.coalesce(equal, ordered))

        return F.when(op == "===", F.lower(F.trim(text)) == F.lower(c["said"])).otherwise(_bound(parsed(F.when(wild, F.regexp_replace(c["said"], r"\.\*$", "")).otherwise(c["said"])), against))

    said = F.regexp_extract(clause, CLAUSE, 2)
    return _bound(F.struct(F.regexp_extract(clause, CLAUSE, 1).alias("op"), said.alias("said"), F.endswith(said, F.lit(".*")).alias("wild")), test)


def satisfies(version: Column, specifiers: Column) -> Column:
    """Whether a version meets all comma-separated clauses, pre-releases included.

    No clause, a clause that can't be read, and a version that can't be read are met.
    """
    clauses = F.filter(F.split(F.coalesce(specifiers, F.lit("")), ","), lambda c: F.trim(c) != "")

    def all_met(v: Column) -> Column:
        return v.isNull() | _bound(F.transform(clauses, lambda c: _clause(v, version, c)), lambda met: F.exists(met, lambda m: m.isNull()) | F.forall(met, lambda m: m))

    return _bound(parsed(version), all_met)
