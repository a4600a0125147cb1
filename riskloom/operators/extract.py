"""Facts from text: line scans in SQL; Python sources and unified diffs through batched parsers, classified in SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE_REFS = "path string, kind string, line int, col int, fqn string, enclosing string, confidence string, entry_route string, entry_method string"


def scan_lines(texts: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """file, line_no, pattern, line: lines that match a pattern, by the first that they match."""
    lines = texts.select("file", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    which = None
    for name, regex in patterns:
        test = F.col("line").rlike(regex)
        which = F.when(test, name) if which is None else which.when(test, name)
    return lines.select("file", (F.col("i") + 1).cast("bigint").alias("line_no"), which.alias("pattern"), "line").filter("pattern is not null")


def _dotted(node) -> str:
    import ast

    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def _entry(decorators) -> tuple[str, str] | None:
    """(route, method) of a function's decorators if one makes it an entry point."""
    import ast

    for d in decorators:
        call = d if isinstance(d, ast.Call) else None
        name = _dotted(call.func if call else d)
        last = name.rsplit(".", 1)[-1]
        if last in ("route", "get", "post", "put", "delete", "patch", "head", "options") and call and "." in name:
            route = call.args[0].value if call.args and isinstance(call.args[0], ast.Constant) else ""
            method = last.upper() if last != "route" else "GET"
            for k in call.keywords:
                if k.arg == "methods" and isinstance(k.value, ast.List) and k.value.elts and isinstance(k.value.elts[0], ast.Constant):
                    method = str(k.value.elts[0].value).upper()
            return str(route), method
        if last in ("task", "shared_task", "command", "group"):
            return f"{last}:", ""
    return None


def source_refs(text: str | None) -> list[tuple]:
    """(kind, line, col, fqn, enclosing, confidence, route, method) of a Python source's imports, calls and attributes.

    Names are resolved through the imports of the file; names of star imports have medium confidence. A source that
    doesn't parse has none.
    """
    import ast

    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return []
    out: list[tuple] = []

    def walk(node, names: dict, stars: list, where: str, entry):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Import):
                for a in child.names:
                    names[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                    out.append(("import", child.lineno, child.col_offset, a.name, where, "HIGH", *entry))
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    full = f"{'.' * child.level}{child.module or ''}".rstrip(".") + f".{a.name}"
                    if a.name == "*":
                        stars.append(child.module or "")
                        full = child.module or ""
                    else:
                        names[a.asname or a.name] = full
                    out.append(("import", child.lineno, child.col_offset, full, where, "MEDIUM" if a.name == "*" else "HIGH", *entry))
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                walk(ast.Module([ast.Expr(d) for d in child.decorator_list], []), names, stars, where, entry)
                walk(ast.Module(child.body, []), dict(names), list(stars), f"{where}.{child.name}" if where else child.name, _entry(child.decorator_list) or entry)
            elif isinstance(child, ast.ClassDef):
                walk(child, dict(names), list(stars), f"{where}.{child.name}" if where else child.name, entry)
            else:
                if isinstance(child, (ast.Call, ast.Attribute)):
                    name = _dotted(child.func if isinstance(child, ast.Call) else child)
                    head, _, rest = name.partition(".")
                    kind = "call" if isinstance(child, ast.Call) else "attribute"
                    if head in names:
                        out.append((kind, child.lineno, child.col_offset, names[head] + (f".{rest}" if rest else ""), where, "HIGH", *entry))
                    elif name and stars and kind == "call":
                        out.append((kind, child.lineno, child.col_offset, f"{stars[-1]}.{name}", where, "MEDIUM", *entry))
                walk(child, names, stars, where, entry)

    walk(tree, {}, [], "", ("", ""))
    return out


def extract_refs(sources: DataFrame) -> DataFrame:
    """Rows of source_refs for each source (path, text)."""

    def parse(parts: Iterator) -> Iterator:
        import pandas as pd

        names = [f.split()[0] for f in SOURCE_REFS.split(", ")]
        for pdf in parts:
            yield pd.DataFrame([(p, *r) for p, t in zip(pdf.path, pdf.text) for r in source_refs(t)], columns=names)

    return sources.select("path", "text").mapInPandas(parse, SOURCE_REFS)


DECORATORS = "path string, kind string, name string, place int, nth int, called boolean, member boolean, last string, literal string, methods array<string>"


def decorators_of(text: str | None) -> list[tuple]:
    """Facts of a source's decorators and of its calls of path with two arguments or more, in order of the source.

    Of a decorator: the function's name and place, which of its decorators it is, whether it is called and a member of
    something, its last name, first literal text and the literal texts of methods=. Of a call of path: the last name of
    its second argument as name, and the first literal.
    """
    import ast

    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return []
    said = lambda n: n.value if isinstance(n, ast.Constant) and isinstance(n.value, str) else None
    out = []
    for place, node in enumerate(ast.walk(tree)):
        for nth, d in enumerate(getattr(node, "decorator_list", ()) if not isinstance(node, ast.ClassDef) else ()):
            call = d if isinstance(d, ast.Call) else None
            target = call.func if call else d
            listed = [said(e) for k in call.keywords if k.arg == "methods" for e in getattr(k.value, "elts", [k.value])] if call else []
            literal = said(call.args[0]) if call and call.args else None
            out.append(("decorator", node.name, place, nth, call is not None, isinstance(target, ast.Attribute), getattr(target, "attr", getattr(target, "id", "")), literal, [x for x in listed if x]))
        if isinstance(node, ast.Call) and len(node.args) > 1 and _dotted(node.func).rsplit(".", 1)[-1] == "path":
            out.append(("url", _dotted(node.args[1]).rsplit(".", 1)[-1], place, 0, True, False, "path", said(node.args[0]), []))
    return out


def extract_decorators(sources: DataFrame) -> DataFrame:
    """Rows of decorators_of for each source (path, text)."""

    def parse(parts: Iterator) -> Iterator:
        import pandas as pd

        names = [f.split(" ")[0] for f in DECORATORS.split(", ")]
        for pdf in parts:
            yield pd.DataFrame([(p, *r) for p, t in zip(pdf.path, pdf.text) for r in decorators_of(t)], columns=names)

    return sources.select("path", "text").mapInPandas(parse, DECORATORS)


#: Decorators that make a function an entry point: last name, whether it must be called, whether a member, framework.
TELLING = (
    ("route", True, False, "flask"), *((verb, True, True, "fastapi") for verb in ("get", "post", "put", "delete", "patch", "head", "options")), ("task", False, True, "celery"), ("shared_task", False, True, "celery"),
    ("command", True, True, "click"), ("group", True, True, "click"),
)


def extract_entry_points(sources: DataFrame) -> DataFrame:
    """path, name, framework, route, method of functions that decorators, or the URL patterns of a urls.py, make entry points.

    A function's first telling decorator counts, the last function of a name, and decorators before URL patterns, of which
    the first that names a view counts. Methods are in capitals; a route without any is a GET.
    """
    facts = extract_decorators(sources)
    telling = facts.sparkSession.createDataFrame(list(TELLING), "last string, must_call boolean, must_own boolean, framework string")
    told = facts.filter("kind = 'decorator'").join(F.broadcast(telling), "last").filter("(called or not must_call) and (member or not must_own)")
    web = F.col("framework").isin("flask", "fastapi")
    method = F.when(F.col("framework") == "flask", F.coalesce(F.upper(F.get("methods", F.lit(0))), F.lit("GET"))).when(web, F.upper("last"))
    info = F.struct("framework", F.when(web, F.col("literal")).alias("route"), method.alias("method"))
    marked = told.groupBy("path", "name").agg(F.max_by(info, F.struct("place", -F.col("nth"))).alias("x")).select("path", "name", "x.*")
    urls = facts.filter("kind = 'url' and name != ''").filter(F.endswith(F.replace("path", F.lit("\\"), F.lit("/")), F.lit("urls.py")))
    views = urls.groupBy("path", "name").agg(F.min_by("literal", "place").alias("route")).join(marked, ["path", "name"], "left_anti")
    return marked.unionByName(views.select("path", "name", F.lit("django").alias("framework"), "route", F.lit("GET").alias("method")))


SIGNATURES = "path string, module string, symbol string, kind string, params array<string>, n_defaults int"


def public_api(text: str | None) -> list[tuple]:
    """(symbol, kind, parameters, number of defaults) of a source's public functions, classes and methods; __init__ counts."""
    import ast

    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return []
    out = []

    def visit(body, prefix: str):
        for n in body:
            public = isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and (not n.name.startswith("_") or n.name == "__init__")
            if public and isinstance(n, ast.ClassDef):
                out.append((prefix + n.name, "class", [], 0))
                visit(n.body, f"{prefix}{n.name}.")
            elif public:
                a = n.args
                out.append((prefix + n.name, "method" if prefix else "function", [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)], len(a.defaults) + sum(d is not None for d in a.kw_defaults)))

    visit(tree.body, "")
    return out


def extract_api(sources: DataFrame) -> DataFrame:
    """Rows of public_api for each source (path, text)."""

    def parse(parts: Iterator) -> Iterator:
        import pandas as pd

        for pdf in parts:
            rows = [(p, p.removesuffix(".py").replace("/", "."), *r) for p, t in zip(pdf.path, pdf.text) for r in public_api(t)]
            yield pd.DataFrame(rows, columns=["path", "module", "symbol", "kind", "params", "n_defaults"])

    return sources.select("path", "text").mapInPandas(parse, SIGNATURES)


FUNCTIONS = "path string, name string, line_start int, line_end int, calls array<string>, guards int, returns int"


def functions_of(text: str | None) -> list[tuple]:
    """(qualified name, first line, last line, called names, guards, returns) of each function of a source."""
    import ast

    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return []
    names = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            names |= {a.asname or a.name.split(".")[0]: a.name if a.asname else a.name.split(".")[0] for a in n.names}
        elif isinstance(n, ast.ImportFrom):
            names |= {a.asname or a.name: f"{n.module or ''}.{a.name}" for a in n.names}
    out = []

    def resolve(call) -> str:
        head, _, rest = _dotted(call.func).partition(".")
        return names.get(head, head) + (f".{rest}" if rest else "")

    def visit(body, prefix: str):
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = [x for part in n.body for x in ast.walk(part)]
                calls = list(dict.fromkeys(resolve(c) for c in inner if isinstance(c, ast.Call) and _dotted(c.func)))
                guards = sum(isinstance(c, ast.Raise) for c in inner) + sum(isinstance(c, ast.Assert) for c in inner)
                out.append((prefix + n.name, n.lineno, n.end_lineno, calls, guards, sum(isinstance(c, ast.Return) for c in inner)))
                visit(n.body, f"{prefix}{n.name}.")
            elif isinstance(n, ast.ClassDef):
                visit(n.body, f"{prefix}{n.name}.")

    visit(tree.body, "")
    return out


def extract_functions(sources: DataFrame) -> DataFrame:
    """Rows of functions_of for each source (path, text)."""

    def parse(parts: Iterator) -> Iterator:
        import pandas as pd

        for pdf in parts:
            rows = [(p, *r) for p, t in zip(pdf.path, pdf.text) for r in functions_of(t)]
            yield pd.DataFrame(rows, columns=["path", "name", "line_start", "line_end", "calls", "guards", "returns"])

    return sources.select("path", "text").mapInPandas(parse, FUNCTIONS)


def resolve_calls(functions: DataFrame) -> DataFrame:
    """src, dst of a call graph: callees of the same file first, then names that one function alone has, else ext::name."""
    calls = functions.select(F.concat("path", F.lit("::"), "name").alias("src"), "path", F.explode("calls").alias("callee")).withColumn("short", F.element_at(F.split("callee", r"\."), -1))
    known = functions.select("path", F.concat("path", F.lit("::"), "name").alias("fn"), F.element_at(F.split("name", r"\."), -1).alias("short"))
    same = known.groupBy("path", "short").agg(F.min("fn").alias("own"))
    unique = known.groupBy("short").agg(F.min("fn").alias("one"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("short", "one")
    return calls.join(same, ["path", "short"], "left").join(unique, "short", "left").select("src", F.coalesce("own", "one", F.concat(F.lit("ext::"), "callee")).alias("dst")).distinct()


HUNKS = "cve_id string, file string, header string, added array<string>, removed array<string>"
_TEST_PATH = re.compile(r"(^|/)(tests?|testing)/|(^|/)test_[^/]*$|\.(png|jpg|gif|pdf|zip|gz|whl)$")


def hunks_of(text: str | None) -> list[tuple]:
    """(file, section header, added lines, removed lines) of each hunk of a unified diff; test and binary files go."""
    out, file, current = [], "", None
    for line in (text or "").split("\n"):
        if line.startswith("+++ "):
            file, current = line[4:].strip().removeprefix("b/"), None
        elif m := re.match(r"@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@ ?(.*)", line):
            current = (file, m[1], [], [])
            if file and not _TEST_PATH.search(file):
                out.append(current)
        elif current is not None and line.startswith("+") and not line.startswith("+++"):
            current[2].append(line[1:])
        elif current is not None and line.startswith("-") and not line.startswith("---"):
            current[3].append(line[1:])
    return out


def extract_hunks(patches: DataFrame) -> DataFrame:
    """Rows of hunks_of for each patch (cve_id, text)."""

    def parse(parts: Iterator) -> Iterator:
        import pandas as pd

        for pdf in parts:
            rows = [(c, *r) for c, t in zip(pdf.cve_id, pdf.text) for r in hunks_of(t)]
            yield pd.DataFrame(rows, columns=["cve_id", "file", "header", "added", "removed"])

    return patches.select("cve_id", "text").mapInPandas(parse, HUNKS)


def classify(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """The label of a symbol's change from facts of either side: exists, name, signature, returns, guards, body.

    The first rule that holds wins; more guards harden a symbol only if its body differs. What no rule names is internal.
    """
    return (
        F.when(~after["exists"] & before["exists"], "REMOVED").when(~before["exists"] & after["exists"], "ADDED").when(~before["exists"] & ~after["exists"], "INTERNAL_CHANGE")
        .when(before["name"] != after["name"], "RENAMED").when(before["signature"] != after["signature"], "SIGNATURE_CHANGED").when(before["returns"] != after["returns"], "RETURN_CHANGED")
        .when((after["guards"] > before["guards"]) & (before["body"] != after["body"]), "HARDENED_ONLY").otherwise("INTERNAL_CHANGE")
    )


def unified_diffs(files: DataFrame) -> DataFrame:
    """path and diff of files (path, old, new) whose texts differ, as unified diffs."""

    def compare(parts: Iterator) -> Iterator:
        import difflib

        import pandas as pd

        for pdf in parts:
            out = []
            for path, old, new in zip(pdf.path, pdf.old, pdf.new):
                if old != new:
                    lines = difflib.unified_diff((old or "").splitlines(True), (new or "").splitlines(True), f"a/{path}", f"b/{path}")
                    out.append((path, "".join(lines)))
            yield pd.DataFrame(out, columns=["path", "diff"])

    return files.select("path", "old", "new").mapInPandas(compare, "path string, diff string")
