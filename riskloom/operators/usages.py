"""Where sources use what an upgrade breaks: names are followed from where they are bound to where they are used, and met with changes by join.

The parser gives uses alone: imports and calls with the full name that they reach. Changes are joined by the first and last
part of that name, so no use is compared with more changes than share both.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.scratch import cut

USES = "file string, kind string, line int, col int, name string, method string, source_line string"


def uses_of(text: str | None) -> list[tuple]:
    """(kind, line, column, full name, method, line of source) of each import and call of a source.

    kind is module or name (of imports) or call. A name stands for what it was last bound to in its own scope or those
    about it: by an import, by the call of a class or function (x = C(), with C() as x, x: C = ..., and :=), by another
    name (y = x), or by a parameter's annotation. self.x that any method binds is known in all methods of its class. What is bound
    to anything else stands for nothing. A call's name is null if it isn't a chain of names, as in f().g(); method is then
    all that is known. A source that doesn't parse has no uses.
    """
    import ast

    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return []
    lines, out = (text or "").split("\n"), []
    scopes = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
    binds, loops, leaves = (ast.Assign, ast.AnnAssign, ast.NamedExpr), (ast.For, ast.AsyncFor, ast.comprehension), (ast.Name, ast.Constant, ast.expr_context)
    comprehensions = (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)

    def chain(node, names: dict) -> str | None:
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if not isinstance(node, ast.Name):
            return None
        parts.append(node.id)
        parts.reverse()
        # the longest beginning that stands for something
        for k in range(len(parts), 0, -1):
            if (known := names.get(".".join(parts[:k]), "")) is None:
                return None
            if known:
                return ".".join([known, *parts[k:]])
        return ".".join(parts)

    def value(node, names: dict) -> str | None:
        while isinstance(node, ast.Await):
            node = node.value
        if isinstance(node, ast.Call):
            return chain(node.func, names)
        if isinstance(node, ast.Name | ast.Attribute):
            head = node
            while isinstance(head, ast.Attribute):
                head = head.value
            return chain(node, names) if isinstance(head, ast.Name) and head.id in names else None
        return None

    def bind(target, what: str | None, names: dict, own: dict | None) -> None:
        if isinstance(target, ast.Name):
            names[target.id] = what
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
            names[f"self.{target.attr}"] = what
            if own is not None and what:
                own.setdefault(f"self.{target.attr}", what)
        elif isinstance(target, ast.Tuple | ast.List):
            for x in target.elts:
                bind(x, None, names, own)

    def note(kind: str, node, name: str | None, method: str | None = None) -> None:
        out.append((kind, node.lineno, node.col_offset, name, method, lines[node.lineno - 1].rstrip()))

    def visit(node, names: dict, own: dict | None) -> None:
        if isinstance(node, leaves):
            return
        if isinstance(node, ast.Import):
            for a in node.names:
                names[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
                note("module", node, a.name)
            return
        if isinstance(node, ast.ImportFrom):
            if node.module:
                note("module", node, node.module)
                for a in node.names:
                    names[a.asname or a.name] = f"{node.module}.{a.name}"
                    note("name", node, f"{node.module}.{a.name}")
            return
        if isinstance(node, ast.ClassDef):
            for d in (*node.decorator_list, *node.bases):
                visit(d, names, own)
            held: dict = {}
            for _ in range(2):  # once for what methods bind, once for what they use
                kept = len(out)
                inner = {**names, **held}
                for x in node.body:
                    visit(x, inner, held)
                if _ == 0:
                    del out[kept:]
            names[node.name] = None if node.name in names else names.get(node.name, "")
            return
        if isinstance(node, scopes):
            inner = {**names, **(own or {})}
            for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
                if a.arg != "self":
                    inner[a.arg] = value(a.annotation, names) or "" if getattr(a, "annotation", None) is not None else ""
            for d in (*getattr(node, "decorator_list", []), *node.args.defaults, *(x for x in node.args.kw_defaults if x)):
                visit(d, names, own)
            for x in node.body if isinstance(node.body, list) else [node.body]:
                visit(x, inner, own)
            return
        if isinstance(node, ast.Call):
            note("call", node, chain(node.func, names), node.func.attr if isinstance(node.func, ast.Attribute) else None)
        if isinstance(node, binds):
            if node.value is not None:
                visit(node.value, names, own)
            what = value(node.value, names)
            if what is None and isinstance(node, ast.AnnAssign):
                what = value(node.annotation, names)
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if not isinstance(target, ast.Name):
                    visit(target, names, own)
                bind(target, what, names, own)
            return
        if isinstance(node, loops):
            visit(node.iter, names, own)
            bind(node.target, None, names, own)
            for x in (*getattr(node, "body", ()), *getattr(node, "orelse", ()), *getattr(node, "ifs", ())):
                visit(x, names, own)
            return
        if isinstance(node, comprehensions):
            inner = dict(names)
            for g in node.generators:
                visit(g, inner, own)
            for x in (node.key, node.value) if isinstance(node, ast.DictComp) else (node.elt,):
                visit(x, inner, own)
            return
        if isinstance(node, ast.withitem):
            visit(node.context_expr, names, own)
            if node.optional_vars is not None:
                bind(node.optional_vars, value(node.context_expr, names), names, own)
            return
        for child in ast.iter_child_nodes(node):
            visit(child, names, own)

    visit(tree, {}, None)
    return out


def extract_uses(sources: DataFrame) -> DataFrame:
    """Rows of uses_of for each source (path, text)."""

    def parse(parts: Iterator) -> Iterator:
        import pandas as pd

        names = [f.split(" ")[0] for f in USES.split(", ")]
        for pdf in parts:
            yield pd.DataFrame([(p, *u) for p, t in zip(pdf.path, pdf.text) for u in uses_of(t)], columns=names)

    return sources.select("path", "text").mapInPandas(parse, USES)


#: Kinds of changes, and the uses that each breaks.
BREAKS = {"CLASS_REMOVED": ("name", "call"), "FUNCTION_REMOVED": ("name", "call"), "METHOD_REMOVED": ("call",), "SIGNATURE_CHANGED": ("call",)}


def _ends(name: Column) -> tuple[Column, Column]:
    return F.substring_index(name, ".", 1), F.substring_index(name, ".", -1)


def breaking(uses: DataFrame, changes: DataFrame) -> DataFrame:
    """Uses that a change breaks: file, line, col, source_line, matched_symbol, change_type and confidence.

    changes: symbol, module, change_type. A use reaches a symbol if their names are equal, or share their last part and
    their first, as packages hand on names from the modules that define them. A removed module breaks its imports and
    those of what lies in it. A call whose receiver is unknown may be to any removed method of its name: confidence LOW.
    Uses are written once, so that sources are parsed once for all three joins.
    """
    uses = cut(uses)
    first, last = _ends(F.col("name"))
    known = uses.filter("name is not null and kind != 'module'").withColumns({"first": first, "last": last})
    c_first, c_last = _ends(F.col("symbol"))
    wanted = changes.filter(F.col("change_type").isin(*BREAKS)).select("symbol", "change_type", c_first.alias("first"), c_last.alias("last")).distinct()
    fits = F.lit(False)
    for change, kinds in BREAKS.items():
        fits = fits | ((F.col("change_type") == change) & F.col("kind").isin(*kinds))
    # a method that is removed is only called as one
    fits = fits & ((F.col("change_type") != "METHOD_REMOVED") | F.col("method").isNotNull())
    shown = ["file", "line", "col", "source_line", F.col("symbol").alias("matched_symbol"), "change_type"]
    by_name = known.join(wanted, ["first", "last"]).filter(fits & (F.contains("name", F.lit(".")) | (F.col("name") == F.col("symbol")))).select(*shown, F.lit("HIGH").alias("confidence"))
    # each import and the modules that it lies in
    parts = F.split("name", r"\.")
    above = uses.filter("kind = 'module'").withColumn("module", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))))
    gone = changes.filter("change_type = 'MODULE_REMOVED'").select("symbol", "module", "change_type").distinct()
    by_module = above.join(gone, "module").select(*shown, F.lit("HIGH").alias("confidence"))
    methods = wanted.filter("change_type = 'METHOD_REMOVED'").withColumnRenamed("last", "method")
    by_method = uses.filter("name is null and method is not null").join(methods, "method").select(*shown, F.lit("LOW").alias("confidence"))
    return by_name.unionByName(by_module).unionByName(by_method).distinct()


def symbol_index(symbols: DataFrame, sinks: DataFrame) -> DataFrame:
    """An index of symbols (cve_id, package, fqn) by the ends of their names, and of public sinks (package, fqn) of the packages that have any.

    A row for each end: suffix (the last parts of the name), depth (how many), whole (the name itself, not a mere end),
    sink, cve_id, package and fqn. Sinks are found by their whole names only.
    """
    parts = F.split("fqn", r"\.")
    named = symbols.filter("fqn != ''").select("cve_id", "package", "fqn").distinct()
    ends = named.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).select(F.array_join(F.slice(parts, F.size(parts) - F.col("depth") + 1, F.col("depth")), ".").alias("suffix"), "depth", (F.col("depth") == F.size(parts)).alias("whole"), F.lit(False).alias("sink"), "cve_id", "package", "fqn")
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    owners = named.select("cve_id", "package").distinct().withColumn("p", plain(F.col("package")))
    public = sinks.select(plain(F.col("package")).alias("p"), "fqn").distinct().join(owners, "p")
    public = public.select(F.col("fqn").alias("suffix"), F.size(parts).alias("depth"), F.lit(True).alias("whole"), F.lit(True).alias("sink"), "cve_id", "package", "fqn")
    return ends.unionByName(public)


def lookups(hits: DataFrame, index: DataFrame) -> DataFrame:
    """hit_id, fqn, suffix, how and targets of each distinct hit (hit_id, fqn): the entry of the index that it finds.

    A hit finds the symbols of its whole name (exact); if there are none, those that share the longest end of its name (suffix).
    A hit is one row however many symbols share the end: targets says how many, and the index has them under suffix.
    """
    parts = F.split("fqn", r"\.")
    ends = hits.select("hit_id", "fqn").distinct().withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).select("hit_id", "fqn", "depth", F.array_join(F.slice(parts, F.size(parts) - F.col("depth") + 1, F.col("depth")), ".").alias("suffix"))
    entries = index.groupBy("suffix").agg(F.count_if("whole").alias("n_whole"), F.count_if(~F.col("sink")).alias("n"))
    found = ends.join(entries, "suffix").withColumn("exact", (F.col("suffix") == F.col("fqn")) & (F.col("n_whole") > 0)).filter("exact or n > 0")
    best = found.groupBy("hit_id", "fqn").agg(F.max_by(F.struct("suffix", "exact", "n", "n_whole"), F.struct("exact", "depth")).alias("x"))
    return best.select("hit_id", "fqn", "x.suffix", F.when(F.col("x.exact"), "exact").otherwise("suffix").alias("how"), F.when(F.col("x.exact"), F.col("x.n_whole")).otherwise(F.col("x.n")).alias("targets"))
