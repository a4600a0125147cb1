"""Queries of patches, of changed symbols in use and of the symbol index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators import patches, usages
from riskloom.operators.scratch import spread
from riskloom.plans.analogs import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


#: A patch for each kind of change; ~ is a line's end, # the row's number.
KINDS = (
    "--- a/src/pkg/m#.py~+++ b/src/pkg/m#.py~@@ -1,2 +1,2 @@~-def f#(a):~+def f#(a, b=1):~     return a~@@ -20 +20,2 @@~ def f#(a):~+    return a~",
    "diff --git a/src/pkg/o#.py b/src/pkg/m#.py~rename from src/pkg/o#.py~rename to src/pkg/m#.py~--- a/src/pkg/o#.py~+++ b/src/pkg/m#.py~@@ -1,3 +1,3 @@~ def f#(a):~     b = a~-    return a~+    return b~",
    "--- a/pkg/m#.py~+++ b/pkg/m#.py~@@ -1,2 +1,4 @@~ def f#(a):~+    if not a:~+        raise ValueError(a)~     return a~",
    "--- /dev/null~+++ b/pkg/n#.py~@@ -0,0 +1,2 @@~+def f#(*, k=2, **rest):~+    pass~",
    "--- a/pkg/n#.py~+++ /dev/null~@@ -1,2 +0,0 @@~-class C#:~-    pass~",
    "--- a/lib/m#.py~+++ b/lib/m#.py~@@ -10,2 +10,2 @@ def f#(x):~     y = x~-    x = 1~+    x = 2~",
    "--- a/pkg/m#.py~+++ b/pkg/m#.py~@@ -10,2 +10,3 @@ async def f#(x):~     y = x~+    if x: check(x)~     z = y~",
    "--- a/src/pkg/fast#.c~+++ b/src/pkg/fast#.c~@@ -1 +1,2 @@~-int x;~+int y;~+int z;~",
    "--- a/pkg/m#.py~+++ b/pkg/m#.py~@@ -1,4 +1,4 @@ class K:~ def f#(*a, k):~     def g():~         return 1~-    return 2~+    return g()~@@ -50,3 +50,3 @@~ class D#:~-    x = 1~+    x = 2~     y = 3~",
    "--- a/pkg/m#.py~+++ b/pkg/m#.py~@@ -1,2 +1,2 @@~ def f#(a, *, k=1):~-    x = a~+    x = k~",
)
TEST = "--- a/tests/t.py~+++ b/tests/t.py~@@ -1 +1 @@~-def t(): pass~+def t(a): pass~"
MANY = "array_join(transform(sequence(1, 21), i -> concat('--- a/f', i, '.py~+++ b/f', i, '.py~@@ -1 +1 @@~-def f(): pass~+def f(a): pass~')), '')"


def diffs(spark: SparkSession, sf: str) -> DataFrame:
    cases = " ".join(f"WHEN {k} THEN '{t}{TEST}'" for k, t in enumerate(KINDS))
    whole = f"CASE WHEN p_partkey % 97 = 5 THEN {MANY} WHEN p_partkey % 89 = 3 THEN '--- a/x.py~+++ b/x.py~@@ -1,9 +1,9 @@~-def f(): pass~' ELSE CASE p_partkey % {len(KINDS)} {cases} END END"
    return view(spark, sf, "part").selectExpr("concat('CVE-', p_partkey) as cve_id", "'pkg' as root", f"replace(replace({whole}, '~', char(10)), '#', cast(p_partkey as string)) as text")


WHOLE = "p AS (SELECT p_partkey AS n, p_partkey % 10 AS k FROM part WHERE p_partkey % 97 <> 5 AND p_partkey % 89 <> 3)"
#: Fixed facts of the kinds: file, name, kind, label, signatures, lines of all hunks and of the first one.
FACTS = """
  (0, 'src/pkg/m#.py', 'pkg.m#.', 'f#', 'function', 'SIGNATURE_CHANGED', 'def f#(a):', 'def f#(a, b=1):', 2, 1, 'Parameter list changed in f# (+1/-1 lines in hunk)'),
  (1, 'src/pkg/m#.py', 'pkg.m#.', 'f#', 'function', 'RETURN_CHANGED', 'def f#(a):', 'def f#(a):', 1, 1, 'Return behavior changed in f# (+1/-1 lines in hunk)'),
  (2, 'pkg/m#.py', 'pkg.m#.', 'f#', 'function', 'HARDENED_ONLY', 'def f#(a):', 'def f#(a):', 2, 0, 'Added validation or guards in f# (+2/-0 lines in hunk)'),
  (3, 'pkg/n#.py', 'pkg.n#.', 'f#', 'function', 'ADDED', '', 'def f#(*, k=2, **rest):', 2, 0, 'Added helper f# in security patch (+2/-0 lines in hunk)'),
  (4, 'pkg/n#.py', 'pkg.n#.', 'C#', 'class', 'REMOVED', 'class C#', '', 0, 2, 'Removed C# in security patch (+0/-2 lines in hunk)'),
  (5, 'lib/m#.py', 'pkg.lib.m#.', 'f#', 'function', 'INTERNAL_CHANGE', 'def f#():', 'def f#():', 1, 1, 'Internal logic updated in f# (+1/-1 lines in hunk)'),
  (6, 'pkg/m#.py', 'pkg.m#.', 'f#', 'function', 'HARDENED_ONLY', 'def f#():', 'def f#():', 1, 0, 'Added validation or guards in f# (+1/-0 lines in hunk)'),
  (7, 'src/pkg/fast#.c', 'pkg.', 'fast#.c', 'file', 'INTERNAL_CHANGE', '', '', 2, 1, 'Native code change in src/pkg/fast#.c (Python wrapper may still be affected)'),
  (8, 'pkg/m#.py', 'pkg.m#.', 'f#', 'function', 'RETURN_CHANGED', 'def f#(*a, k):', 'def f#(*a, k):', 1, 1, 'Return behavior changed in f# (+1/-1 lines in hunk)'),
  (8, 'pkg/m#.py', 'pkg.m#.', 'D#', 'class', 'INTERNAL_CHANGE', 'class D#', 'class D#', 1, 1, 'Internal logic updated in D# (+1/-1 lines in hunk)'),
  (9, 'pkg/m#.py', 'pkg.m#.', 'f#', 'function', 'SIGNATURE_CHANGED', 'def f#(a, *, k=1):', 'def f#(a, *, k=1):', 1, 1, 'Parameter list changed in f# (+1/-1 lines in hunk)')"""


@query("patch_symbols", f"""WITH {WHOLE}, f(k, file, module, name, kind, label, b, a, n_added, n_removed, summary) AS (VALUES {FACTS})
  SELECT concat('CVE-', n) AS cve_id, replace(file, '#', n::VARCHAR) AS file, replace(concat(module, name), '#', n::VARCHAR) AS fqn, replace(name, '#', n::VARCHAR) AS name, kind, label, replace(b, '#', n::VARCHAR) AS before_signature, replace(a, '#', n::VARCHAR) AS after_signature,
    n_added, n_removed, replace(summary, '#', n::VARCHAR) AS summary FROM p JOIN f USING (k)""")
def patch_symbols(spark, sf):
    return patches.changed_symbols(patches.extract_hunks(diffs(spark, sf)))


@query("patch_files", f"""WITH {WHOLE}, f(k, file, old_file, change, n_added, n_removed) AS (VALUES (0, 'src/pkg/m#.py', NULL, 'modified', 2, 1), (1, 'src/pkg/m#.py', 'src/pkg/o#.py', 'renamed', 1, 1), (2, 'pkg/m#.py', NULL, 'modified', 2, 0), (3, 'pkg/n#.py', NULL, 'added', 2, 0),
    (4, 'pkg/n#.py', NULL, 'removed', 0, 2), (5, 'lib/m#.py', NULL, 'modified', 1, 1), (6, 'pkg/m#.py', NULL, 'modified', 1, 0), (7, 'src/pkg/fast#.c', NULL, 'modified', 2, 1), (8, 'pkg/m#.py', NULL, 'modified', 2, 2), (9, 'pkg/m#.py', NULL, 'modified', 1, 1))
  SELECT concat('CVE-', n) AS cve_id, replace(file, '#', n::VARCHAR) AS file, replace(old_file, '#', n::VARCHAR) AS old_file, change, n_added, n_removed, false AS partial FROM p JOIN f USING (k)
  UNION ALL SELECT concat('CVE-', n), 'tests/t.py', NULL, 'modified', 1, 1, false FROM p
  UNION ALL SELECT concat('CVE-', p_partkey), concat('f', i, '.py'), NULL, 'modified', 1, 1, true FROM part, range(1, 22) r(i) WHERE p_partkey % 97 = 5
  UNION ALL SELECT concat('CVE-', p_partkey), 'x.py', NULL, 'modified', 0, 1, true FROM part WHERE p_partkey % 89 = 3 AND p_partkey % 97 <> 5""")
def patch_files(spark, sf):
    return patches.files_changed(patches.extract_hunks(diffs(spark, sf)))


#: A source for each row: uses through variables, self, with, other names and unknown receivers.
SOURCE = (
    "import lib as l~from lib.http import Client, get as g~import old#.sub~~class K:~    def a(self):~        return self.c.send(1)~    def b(self):~        self.c = l.Client()~~def f(q: Client, r):~    c = Client(1)~    d = c~"
    "    d.send(2)~    q.send(3)~    r.send(4)~    make().send(5)~    with l.open_it() as h:~        h.close()~    c = 5~    c.send(6)~    return g(7)~~def h(g):~    return g(8)~"
)
CHANGES = """SELECT * FROM VALUES ('lib.http.Client.send', 'lib.http', 'METHOD_REMOVED'), ('lib.http.get', 'lib.http', 'FUNCTION_REMOVED'), ('lib.open_it.close', 'lib', 'SIGNATURE_CHANGED'), ('lib.Client', 'lib', 'CLASS_REMOVED'), ('other.send', 'other', 'FUNCTION_REMOVED') AS t(symbol, module, change_type)
  UNION ALL SELECT concat('old', p_partkey), concat('old', p_partkey), 'MODULE_REMOVED' FROM {part} WHERE p_partkey % 2 = 0"""
FOUND = """
  (1, 'from lib.http import Client, get as g', 2, 0, 'lib.http.get', 'FUNCTION_REMOVED', 'HIGH'), (1, 'from lib.http import Client, get as g', 2, 0, 'lib.Client', 'CLASS_REMOVED', 'HIGH'),
  (0, 'import old#.sub', 3, 0, 'old#', 'MODULE_REMOVED', 'HIGH'), (1, '        return self.c.send(1)', 7, 15, 'lib.http.Client.send', 'METHOD_REMOVED', 'HIGH'),
  (1, '        self.c = l.Client()', 9, 17, 'lib.Client', 'CLASS_REMOVED', 'HIGH'), (1, '    c = Client(1)', 12, 8, 'lib.Client', 'CLASS_REMOVED', 'HIGH'),
  (1, '    d.send(2)', 14, 4, 'lib.http.Client.send', 'METHOD_REMOVED', 'HIGH'), (1, '    q.send(3)', 15, 4, 'lib.http.Client.send', 'METHOD_REMOVED', 'HIGH'),
  (1, '    make().send(5)', 17, 4, 'lib.http.Client.send', 'METHOD_REMOVED', 'LOW'), (1, '        h.close()', 19, 8, 'lib.open_it.close', 'SIGNATURE_CHANGED', 'HIGH'),
  (1, '    c.send(6)', 21, 4, 'lib.http.Client.send', 'METHOD_REMOVED', 'LOW'), (1, '    return g(7)', 22, 11, 'lib.http.get', 'FUNCTION_REMOVED', 'HIGH')"""


@query("breaking_uses", f"""WITH f(each, source_line, line, col, symbol, change_type, confidence) AS (VALUES {FOUND})
  SELECT concat('m', p_partkey, '.py') AS file, line, col, replace(source_line, '#', p_partkey::VARCHAR) AS source_line, replace(symbol, '#', p_partkey::VARCHAR) AS matched_symbol, change_type, confidence FROM part, f WHERE each = 1 OR p_partkey % 2 = 0""")
def breaking_uses(spark, sf):
    part = view(spark, sf, "part")
    # keys are dealt before texts are made of them
    sources = spread(part.select("p_partkey"), "p_partkey").selectExpr("concat('m', p_partkey, '.py') as path", f"replace(replace('{SOURCE}', '~', char(10)), '#', cast(p_partkey as string)) as text")
    return usages.breaking(usages.extract_uses(sources), spark.sql(CHANGES, part=part))


HITS = "SELECT DISTINCT seq AS hit_id, CASE seq % 4 WHEN 0 THEN fqn WHEN 1 THEN concat('brand', seq % 25, '.mod', seq % 12, '.fn', seq % 31) WHEN 2 THEN concat('x.y.mod', seq % 12, '.fn', seq % 31) ELSE concat('pub', seq % 9, '.load') END AS fqn FROM {refs}"
SINKS = "SELECT concat('Brand#', CAST(k AS STRING)) AS package, concat('pub', CAST(k AS STRING), '.load') AS fqn FROM (SELECT DISTINCT p_partkey % 7 AS k FROM {part}) x"


@query("symbol_lookups", f"""WITH {ctes("symbols", "refs")}, h AS ({HITS.replace("{refs}", "refs")}), k AS ({SINKS.replace("{part}", "part")}), s AS (SELECT DISTINCT cve_id, package, fqn FROM symbols),
  i AS (SELECT string_split(fqn, '.') AS p, unnest(range(1, len(string_split(fqn, '.')) + 1)) AS d, false AS sink FROM s), e AS (SELECT array_to_string(p[len(p) - d + 1:], '.') AS suffix, d = len(p) AS whole, sink FROM i
    UNION ALL SELECT k.fqn, true, true FROM k JOIN (SELECT DISTINCT cve_id, package FROM s) o ON lower(replace(o.package, '#', '')) = lower(replace(k.package, '#', ''))),
  n AS (SELECT suffix, count(*) FILTER (whole) AS n_whole, count(*) FILTER (NOT sink) AS n FROM e GROUP BY suffix),
  x AS (SELECT hit_id, fqn, string_split(fqn, '.') AS p, unnest(range(1, len(string_split(fqn, '.')) + 1)) AS d FROM h), y AS (SELECT hit_id, fqn, d, d = len(p) AS own, array_to_string(p[len(p) - d + 1:], '.') AS suffix FROM x),
  z AS (SELECT hit_id, fqn, d, suffix, own AND n_whole > 0 AS exact, n, n_whole FROM y JOIN n USING (suffix) WHERE own AND n_whole > 0 OR n > 0)
  SELECT hit_id, fqn, suffix, CASE WHEN exact THEN 'exact' ELSE 'suffix' END AS how, CASE WHEN exact THEN n_whole ELSE n END AS targets FROM z QUALIFY row_number() OVER (PARTITION BY hit_id, fqn ORDER BY exact DESC, d DESC) = 1""")
def symbol_lookups(spark, sf):
    hits = spark.sql(HITS, refs=view(spark, sf, "refs"))
    return usages.lookups(hits, usages.symbol_index(view(spark, sf, "symbols"), spark.sql(SINKS, part=view(spark, sf, "part"))))
