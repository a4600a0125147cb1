"""Symbols that a patch changes: files and hunks of unified diffs, definitions of either side, labels by rules in SQL.

A diff is cut into hunks and each hunk into the lines before and after it; a batched parser gives the facts of the
definitions of either side. All that compares sides, from which definitions meet to what a change is called, is DataFrame
work: patches, files and hunks are rows, and nothing but one hunk's text is held at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import defined_name
from riskloom.operators.extract import classify

#: Files beyond which a patch is only listed, and what counts as code besides Python.
MOST_FILES = 20
NATIVE = ("c", "h", "pyx", "pxd", "cc", "cpp")
#: What a line that only hardens holds.
GUARDS = ("if ", "assert ", "raise ", "validate", "strip", "check")

HUNKS = "cve_id string, root string, file string, old_file string, change string, files int, broken boolean, hunk int, header string, before string, after string, n_added int, n_removed int"
HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@ ?(.*)")


def hunks_of(text: str | None) -> tuple[list[dict], bool]:
    """The files of a unified diff, each with its hunks, and whether a hunk ends too early or holds a line that is none.

    A hunk's header says how many lines either side has; what follows these is outside of it, whatever it looks like.
    """
    files: list[dict] = []
    lines, at, broken = (text or "").split("\n"), 0, False
    named: dict = {}
    while at < len(lines):
        line, at = lines[at], at + 1
        if line.startswith("diff --git "):
            named = {}
        elif line.startswith(("rename from ", "rename to ")):
            named[line.split(" ")[1]] = line.split(" ", 2)[2].strip()
            if len(named) == 2:
                files.append({"old": named["from"], "new": named["to"], "hunks": []})
        elif line.startswith("--- ") and at < len(lines) and lines[at].startswith("+++ "):
            old, new = (x[4:].split("\t")[0].strip() for x in (line, lines[at]))
            old, new = (x if x == "/dev/null" else re.sub("^[ab]/", "", x) for x in (old, new))
            at += 1
            if not (files and not files[-1]["hunks"] and (files[-1]["old"], files[-1]["new"]) == (old, new)):
                files.append({"old": old, "new": new, "hunks": []})
        elif (m := HUNK.match(line)) and files:
            left, right = (int(x) if x is not None else 1 for x in m.group(1, 2))
            before, after, added, removed = [], [], 0, 0
            while (left > 0 or right > 0) and at < len(lines):
                mark, rest = lines[at][:1] or " ", lines[at][1:]
                if mark == "\\":
                    at += 1
                    continue
                if mark not in " +-":
                    break
                at += 1
                if mark != "+":
                    before.append(rest)
                    left -= 1
                    removed += mark == "-"
                if mark != "-":
                    after.append(rest)
                    right -= 1
                    added += mark == "+"
            broken |= bool(left or right)
            files[-1]["hunks"].append((m[3], "\n".join(before), "\n".join(after), added, removed))
    return files, broken


def extract_hunks(patches: DataFrame) -> DataFrame:
    """A row for each hunk of patches (cve_id, root, text), and one for each file without any. root: the import root of the package, may be null."""

    def parse(parts: Iterator) -> Iterator:
        import pandas as pd

        names = [f.split(" ")[0] for f in HUNKS.split(", ")]
        for pdf in parts:
            rows = []
            for cve, root, text in zip(pdf.cve_id, pdf.root, pdf.text):
                files, broken = hunks_of(text)
                for f in files:
                    change = "added" if f["old"] == "/dev/null" else "removed" if f["new"] == "/dev/null" else "renamed" if f["old"] != f["new"] else "modified"
                    path = f["old"] if change == "removed" else f["new"]
                    for n, h in enumerate(f["hunks"] or [(None, None, None, 0, 0)]):
                        rows.append((cve, root, path, f["old"] if change == "renamed" else None, change, len(files), broken, n if f["hunks"] else None, *h))
            out = pd.DataFrame(rows, columns=names)
            out["hunk"] = out["hunk"].astype("Int32")
            yield out

    return patches.select("cve_id", "root", "text").mapInPandas(parse, HUNKS)


def files_changed(hunks: DataFrame) -> DataFrame:
    """cve_id, file, old_file, change, n_added, n_removed of each file, and whether its patch is partial: broken, or of more files than are looked into."""
    partial = F.max(F.col("broken") | (F.col("files") > MOST_FILES)).alias("partial")
    return hunks.groupBy("cve_id", "file").agg(F.max("old_file").alias("old_file"), F.min("change").alias("change"), F.sum("n_added").alias("n_added"), F.sum("n_removed").alias("n_removed"), partial)


def looked_into(hunks: DataFrame) -> DataFrame:
    """Hunks of whole patches, outside of tests and binary files."""
    file = F.replace("file", F.lit("\\"), F.lit("/"))
    top = F.lower(F.substring_index(file, "/", 1))
    tests = top.isin("test", "tests", "dummyserver") | F.contains(file, F.lit("/tests/")) | F.startswith(file, F.lit("test_")) | F.endswith(file, F.lit("_test.py"))
    other = F.endswith(file, F.lit(".bin")) | F.contains(file, F.lit("/images/"))
    return hunks.filter(~F.col("broken") & (F.col("files") <= MOST_FILES) & F.col("hunk").isNotNull() & ~tests & ~other)


KEY = ["cve_id", "root", "file", "hunk"]
FACTS = "name string, kind string, inner boolean, signature string, args array<string>, n_defaults int, kw_default boolean, returns array<string>, guards int, body string"
SIDES = "cve_id string, root string, file string, hunk int, header string, wanted string, before string, after string, n_added int, n_removed int"


def definitions(text: str | None, wanted: str | None) -> list[tuple]:
    """Facts of a source's own functions and classes; where it has none, of the first inner function named wanted.

    Facts of a function: first line, parameters (with their stars), number of defaults, whether a parameter that must be
    named has one, its returns, guards and body as text. Guards are if, assert and raise, those inside of others left out.
    """
    import ast

    try:
        tree = ast.parse(f"{text}\n" if text else "")
    except (SyntaxError, ValueError):
        return []
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
    found = {n.name: (n, False) for n in tree.body if isinstance(n, (*kinds, ast.ClassDef))}
    if not found and wanted:
        found = {wanted: (n, True) for n in reversed([*ast.walk(tree)]) if isinstance(n, kinds) and n.name == wanted}

    def inside(node, stop=()):
        for child in ast.iter_child_nodes(node):
            yield child
            if not isinstance(child, stop):
                yield from inside(child, stop)

    guards, out = (ast.If, ast.Assert, ast.Raise), []
    for name, (node, inner) in found.items():
        if isinstance(node, ast.ClassDef):
            out.append((name, "class", inner, f"class {name}", [], 0, False, [], 0, ""))
            continue
        a = node.args
        starred = [("", x) for x in (*a.posonlyargs, *a.args)] + [("*", a.vararg)] + [("", x) for x in a.kwonlyargs] + [("**", a.kwarg)]
        args = [star + x.arg for star, x in starred if x]
        returns = [ast.unparse(x) for x in inside(node) if isinstance(x, ast.Return)]
        n = sum(isinstance(x, guards) for x in inside(node, guards))
        out.append((name, "function", inner, ast.unparse(node).split("\n", 1)[0], args, len(a.defaults), any(d is not None for d in a.kw_defaults), returns, n, "\n".join(map(ast.unparse, node.body))))
    return out


def sides(hunks: DataFrame) -> DataFrame:
    """Hunks of Python files with the definitions of either side as arrays (old, new); wanted: the name of their header."""
    facts = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in FACTS.split(', '))}>>"

    def parse(parts: Iterator) -> Iterator:
        names = [f.split(" ")[0] for f in FACTS.split(", ")]
        for pdf in parts:
            for side, out in (("before", "old"), ("after", "new")):
                pdf[out] = [[dict(zip(names, d)) for d in definitions(t, w)] for t, w in zip(pdf[side], pdf.wanted)]
            yield pdf

    name, _ = defined_name(F.col("header"))
    wanted = F.when(F.trim("header").rlike(r"^(async\s+def|def|class)\s"), F.nullif(name, F.lit("")))
    python = hunks.filter(F.endswith("file", F.lit(".py"))).withColumn("wanted", wanted).select(*[f.split(" ")[0] for f in SIDES.split(", ")])
    return python.mapInPandas(parse, f"{SIDES}, old {facts}, new {facts}")


def meetings(found: DataFrame) -> DataFrame:
    """A row for each name that a hunk defines on either side, with both sides' definitions; null where a side has none.

    It is the outer join of the sides by name, made within the hunk's row. A hunk that defines nothing itself has the
    definition that its header names on both sides: one from inside of it where it can be parsed, else an empty stub.
    """
    own = lambda c: F.filter(c, lambda x: ~x["inner"])
    names = F.array_distinct(F.concat(F.transform(own("old"), lambda x: x["name"]), F.transform(own("new"), lambda x: x["name"])))
    stubbed = (F.size(names) == 0) & F.col("wanted").isNotNull()
    rows = found.withColumn("stub", stubbed).withColumn("name", F.explode(F.when(stubbed, F.array("wanted")).otherwise(names)))
    _, kind = defined_name(F.col("header"))
    empty = F.array().cast("array<string>")
    signature = F.when(kind == "class", F.concat(F.lit("class "), "name")).otherwise(F.concat(F.lit("def "), "name", F.lit("():")))
    stub = F.struct(F.col("name"), kind.alias("kind"), F.lit(True).alias("inner"), signature.alias("signature"), empty.alias("args"), F.lit(0).alias("n_defaults"), F.lit(False).alias("kw_default"), empty.alias("returns"), F.lit(0).alias("guards"), F.lit("").alias("body"))
    of = lambda c: F.get(F.filter(c, lambda x: x["name"] == F.col("name")), F.lit(0))
    side = lambda c: F.when(F.col("stub"), F.coalesce(of(c), stub)).otherwise(of(c))
    return rows.withColumns({"x": side("old"), "y": side("new")})


def hardens(before: Column, after: Column) -> Column:
    """Whether a hunk adds lines, and all lines that it adds hold a guard or a comment."""
    lines = lambda text: F.split(F.regexp_replace(text, r"\n$", ""), "\n")
    added = F.array_except(lines(after), lines(before))
    held = lambda x: F.startswith(F.trim(x), F.lit("#"))
    guard = lambda x: F.exists(F.array(*map(F.lit, GUARDS)), lambda g: F.contains(x, g))
    return (F.size(added) > 0) & F.forall(added, lambda x: held(x) | guard(x))


def labelled(hunks: DataFrame) -> DataFrame:
    """A row for each definition that a hunk of a Python file changes, with the label of the change."""
    met = meetings(sides(hunks))
    # a default of a parameter that must be named always tells sides apart
    written = lambda s, side: F.concat_ws("|", F.array_join(s["args"], ","), s["n_defaults"], F.when(s["kw_default"], side))
    known = lambda s, side: {"exists": s.isNotNull(), "name": F.col("name"), "signature": written(s, side), "returns": s["returns"], "guards": s["guards"], "body": s["body"]}
    x, y = F.col("x"), F.col("y")
    classes = x.isNotNull() & y.isNotNull() & ((x["kind"] == "class") | (y["kind"] == "class"))
    out = met.withColumn("label", F.when(classes, "INTERNAL_CHANGE").otherwise(classify(known(x, "before"), known(y, "after"))))
    harder = (F.col("label") == "INTERNAL_CHANGE") & (F.col("n_added") > 0) & hardens(F.col("before"), F.col("after"))
    named, kind = defined_name(F.col("header"))
    return out.select(
        *KEY, "name", F.when(named == F.col("name"), kind).otherwise(F.coalesce(y["kind"], x["kind"])).alias("kind"), F.when(harder, "HARDENED_ONLY").otherwise(F.col("label")).alias("label"),
        F.coalesce(x["signature"], "header", F.lit("")).alias("before_signature"), F.coalesce(y["signature"], "header", F.lit("")).alias("after_signature"), "n_added", "n_removed",
    )


def module_of(file: Column, root: Column) -> Column:
    """The dotted module of a file, from the import root on; src and lib before the root go, and a missing root is put first."""
    parts = F.split(F.regexp_replace(F.replace(file, F.lit("\\"), F.lit("/")), r"\.py$", ""), "/")
    first = F.coalesce(root, parts[0])
    below = F.when(parts[0].isin("src", "lib") & (F.get(parts, F.lit(1)) == first), F.slice(parts, 2, F.size(parts))).otherwise(parts)
    return F.array_join(F.when((below[0] == first) | (first == ""), below).otherwise(F.concat(F.array(first), below)), ".")


def summary(name: Column, label: Column, added: Column, removed: Column) -> Column:
    """One sentence on a change."""
    # fixed values: the sentences
    said = {
        "HARDENED_ONLY": ("Added validation or guards in ", ""), "SIGNATURE_CHANGED": ("Parameter list changed in ", ""), "RETURN_CHANGED": ("Return behavior changed in ", ""), "RENAMED": ("Symbol renamed (was ", ")"),
        "REMOVED": ("Removed ", " in security patch"), "ADDED": ("Added helper ", " in security patch"), "INTERNAL_CHANGE": ("Internal logic updated in ", ""),
    }
    text = F.concat(F.lit("Modified "), name)
    for k, (a, b) in said.items():
        text = F.when(label == k, F.concat(F.lit(a), name, F.lit(b))).otherwise(text)
    lines = F.concat(F.lit(" (+"), added.cast("string"), F.lit("/-"), removed.cast("string"), F.lit(" lines in hunk)"))
    return F.when((added > 0) | (removed > 0), F.concat(text, lines)).otherwise(text)


def changed_symbols(hunks: DataFrame) -> DataFrame:
    """cve_id, file, fqn, name, kind, label, signatures, lines and summary of each symbol that patches change.

    A symbol in several hunks of a file has the label and signatures of the first and the lines of all. Code files of
    other languages are a symbol of their own; patches that are partial have none.
    """
    whole = looked_into(hunks)
    first = F.min_by(F.struct("kind", "label", "before_signature", "after_signature", F.col("n_added").alias("a"), F.col("n_removed").alias("r")), "hunk").alias("x")
    lines = [F.sum("n_added").alias("n_added"), F.sum("n_removed").alias("n_removed")]
    python = labelled(whole).groupBy("cve_id", "root", "file", "name").agg(first, *lines)
    python = python.select("cve_id", "file", F.concat(module_of(F.col("file"), F.col("root")), F.lit("."), "name").alias("fqn"), "name", "x.kind", "x.label", "x.before_signature", "x.after_signature", "n_added", "n_removed", summary(F.col("name"), F.col("x.label"), F.col("x.a"), F.col("x.r")).alias("summary"))
    extension = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    native = whole.filter(extension.isin(*NATIVE)).groupBy("cve_id", "root", "file").agg(*lines).withColumn("name", F.element_at(F.split("file", "/"), -1))
    told = F.concat(F.lit("Native code change in "), "file", F.lit(" (Python wrapper may still be affected)"))
    native = native.select("cve_id", "file", F.concat_ws(".", F.nullif("root", F.lit("")), "name").alias("fqn"), "name", F.lit("file").alias("kind"), F.lit("INTERNAL_CHANGE").alias("label"), F.lit("").alias("before_signature"), F.lit("").alias("after_signature"), "n_added", "n_removed", told.alias("summary"))
    return python.unionByName(native)
