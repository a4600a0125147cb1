"""Patches, uses of changed symbols and the symbol index on golden cases and odd input."""

from __future__ import annotations

import pytest

from riskloom.operators import patches, usages
from riskloom.operators.scratch import spread
from riskloom.sources import readers, writers


def symbols(spark, text, root="pkg"):
    rows = spark.createDataFrame([("CVE-1", root, text)], "cve_id string, root string, text string")
    return {r.fqn: r for r in patches.changed_symbols(patches.extract_hunks(rows)).collect()}


def diff(path, *hunks):
    return f"--- a/{path}\n+++ b/{path}\n" + "".join(hunks)


@pytest.mark.parametrize("old, new, label", [
    ("def f(a): return a", "def f(a, b): return a", "SIGNATURE_CHANGED"), ("def f(a=1): return a", "def f(a): return a", "SIGNATURE_CHANGED"), ("def f(*, k=1): return k", "def f(*, k=1): return k or 2", "SIGNATURE_CHANGED"),
    ("def f(*, k): return k", "def f(*, k): return k or 2", "RETURN_CHANGED"), ("def f(a): return a", "def f(a): print(a)", "RETURN_CHANGED"), ("def f(a): return 1", "async def f(a): return 1", "INTERNAL_CHANGE"),
    ("def f(a): a()", "def f(a): assert a", "HARDENED_ONLY"), ("class f: a = 1", "class f: a = 2", "INTERNAL_CHANGE"), ("class f: a = 1", "def f(a): return a", "INTERNAL_CHANGE"), ("x = 1", "def f(): pass", "ADDED"), ("def f(): pass", "x = 1", "REMOVED"),
])
def test_labels(spark, old, new, label):
    got = symbols(spark, diff("pkg/m.py", f"@@ -1 +1 @@\n-{old}\n+{new}\n"))
    assert {k: r.label for k, r in got.items()} == {"pkg.m.f": label}


def test_only_outermost_guards_count(spark):
    body = "@@ -1,3 +1,4 @@\n def f(a):\n     if a:\n+        assert a > 1\n         a()\n"
    assert symbols(spark, diff("pkg/m.py", body))["pkg.m.f"].label == "HARDENED_ONLY"  # by its lines, as no guard is new
    body = body.replace("+        assert a > 1", "+        b = 1")
    assert symbols(spark, diff("pkg/m.py", body))["pkg.m.f"].label == "INTERNAL_CHANGE"


def test_headers_stubs_and_paths(spark):
    hunk = "@@ -5,2 +5,2 @@ {}\n     y = 1\n-    x = 1\n+    x = 2\n"
    assert {k: (r.kind, r.before_signature) for k, r in symbols(spark, diff("src/pkg/a.py", hunk.format("class  K(B):"))).items()} == {"pkg.a.K": ("class", "class K")}
    assert list(symbols(spark, diff("a/b.py", hunk.format("def f(x):")), None)) == ["a.b.f"] and symbols(spark, diff("a/b.py", hunk.format("with x:"))) == {}
    inner = "@@ -1,4 +1,4 @@ def g():\n if x:\n     def g(a):\n-        return 1\n+        return 2\n"
    assert symbols(spark, diff("pkg/m.py", inner))["pkg.m.g"].label == "RETURN_CHANGED"
    for path in ("tests/a.py", "pkg/tests/a.py", "test_a.py", "a_test.py", "x.bin", "notes.md"):
        assert symbols(spark, diff(path, "@@ -1 +1 @@\n-def f(): pass\n+def f(a): pass\n")) == {}


def test_odd_patches(spark):
    texts = [None, "", "no diff", "--- a/x.py\n", "@@ -1 +1 @@\n-a\n+b\n", diff("x.py", "@@ -1,5 +1 @@\n-a\n"), diff("x.py", "@@ -1 +1 @@\n-def f(): pass\n\\ No newline at end of file\n+def f(a): pass\n\\ No newline at end of file\n")]
    rows = spark.createDataFrame([(f"C{k}", None, t) for k, t in enumerate(texts)], "cve_id string, root string, text string")
    hunks = patches.extract_hunks(rows)
    assert {(r.cve_id, r.file, r.partial) for r in patches.files_changed(hunks).collect()} == {("C5", "x.py", True), ("C6", "x.py", False)}
    assert [(r.cve_id, r.fqn) for r in patches.changed_symbols(hunks).collect()] == [("C6", "x.f")]
    assert patches.changed_symbols(patches.extract_hunks(rows.limit(0))).count() == 0
    # a removed line that looks like a header
    tricky = diff("pkg/m.py", "@@ -1,3 +1,2 @@\n def f(a):\n--- a = 1\n-++ b\n     return a\n")
    assert [r.n_removed for r in patches.files_changed(patches.extract_hunks(spark.createDataFrame([("C", "pkg", tricky)], "cve_id string, root string, text string"))).collect()] == [2]


def names(text):
    return [(u[3], u[4]) for u in usages.uses_of(text) if u[0] == "call"]


def test_names_are_followed():
    assert names("import a.b\na.b.c()\n") == [("a.b.c", "c")]
    assert names("from m import C\nwith C() as x, open(p) as y:\n    x.f()\n    y.read()\n") == [("m.C", None), ("open", None), ("m.C.f", "f"), ("open.read", "read")]
    assert names("from m import C\ndef f(C):\n    C()\nC()\n") == [("C", None), ("m.C", None)]
    assert names("from m import C\nx = C()\nfor x in y: x.f()\nx.f()\n") == [("m.C", None), (None, "f"), (None, "f")]
    assert names("from m import C\n[x.f() for x in C()]\nx.f()\n") == [("m.C", None), (None, "f"), ("x.f", "f")]
    assert names("from m import C\nclass K:\n    def a(self): self.c.f()\n    def b(self): self.c = C()\nclass L:\n    def a(self): self.c.f()\n") == [("m.C.f", "f"), ("m.C", None), ("self.c.f", "f")]
    assert names("from m import C\nif (x := C()): x.f()\ny: C = make()\ny.g()\n") == [("m.C", None), ("m.C.f", "f"), ("make", None), ("make.g", "g")]
    assert usages.uses_of(None) == [] == usages.uses_of("def (")


def test_breaking_uses(spark):
    uses = usages.extract_uses(spark.createDataFrame([("a.py", "import gone.x.y, gonest\nfrom gone import k\nimport p\np.q.r()\np.r()\nr()\nz().r()\n"), ("b.py", None)], "path string, text string"))
    changes = spark.createDataFrame([("gone.x", "gone.x", "MODULE_REMOVED"), ("p.q.r", "p.q", "FUNCTION_REMOVED"), ("p.K.r", "p", "METHOD_REMOVED"), ("p.q.r", "p.q", "ADDED")], "symbol string, module string, change_type string")
    got = {(r.line, r.matched_symbol, r.confidence) for r in usages.breaking(uses, changes).collect()}
    assert got == {(1, "gone.x", "HIGH"), (4, "p.q.r", "HIGH"), (5, "p.q.r", "HIGH"), (4, "p.K.r", "HIGH"), (5, "p.K.r", "HIGH"), (7, "p.K.r", "LOW")}


def test_symbol_lookups(spark):
    owned = spark.createDataFrame([("C1", "Py-Yaml", "yaml.loader.load"), ("C2", "x", "x.load"), ("C3", "x", ""), ("C3", "x", None)], "cve_id string, package string, fqn string")
    index = usages.symbol_index(owned, spark.createDataFrame([("pyyaml", "yaml.load"), ("none", "n.load")], "package string, fqn string"))
    hits = spark.createDataFrame([(1, "yaml.load"), (2, "x.load"), (3, "a.loader.load"), (4, "b.load"), (5, "n.dump"), (6, None), (7, "")], "hit_id long, fqn string")
    got = {r.hit_id: (r.suffix, r.how, r.targets) for r in usages.lookups(hits, index).collect()}
    assert got == {1: ("yaml.load", "exact", 1), 2: ("x.load", "exact", 1), 3: ("loader.load", "suffix", 1), 4: ("load", "suffix", 2)}


def test_one_short_name_with_many_owners_stays_linear(spark):
    owned = spark.range(20_000).selectExpr("concat('C', id) as cve_id", "'p' as package", "concat('m', id, '.load') as fqn")
    hits = spark.range(20_000).selectExpr("id as hit_id", "'other.load' as fqn")
    got = usages.lookups(hits, usages.symbol_index(owned, spark.createDataFrame([], "package string, fqn string")))
    assert got.groupBy("how", "targets").count().collect() == [("suffix", 20_000, 20_000)]


def test_sources_are_parsed_once(spark):
    sources = spread(spark.createDataFrame([("a.py", "import lib\nlib.f()\n")], "path string, text string"), "path")
    changes = spark.createDataFrame([("lib.f", "lib", "FUNCTION_REMOVED")], "symbol string, module string, change_type string")
    assert sources.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    found = usages.breaking(usages.extract_uses(sources), changes)
    assert "MapInPandas" not in found._jdf.queryExecution().toString()
    assert [(r.line, r.matched_symbol) for r in found.collect()] == [(2, "lib.f")]


def test_tasks_write_patch_files_under_their_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "_write_through_spark", lambda *_: pytest.fail("the driver renamed the files"))
    rows = [(f"cve-{k}", f'{{"cve_id": "CVE-{k}", "status": "ok"}}') for k in range(20)] + [("CVE-3", '{"cve_id": "CVE-3", "status": "late"}'), ("CVE-20", '{"cve_id": '), ("x/y:z", "{}"), ("CVE-21", None)]
    writers.write_patch_files(spark.createDataFrame(rows, "cve_id string, text string"), str(tmp_path))
    assert {f.name for f in tmp_path.iterdir() if not f.name.startswith(".")} == {f"CVE-{k}.json" for k in range(22)} | {"X_Y%3AZ.json"}
    assert (tmp_path / "CVE-21.json").read_text() == "\n"
    assert {(r.cve_id, r.status) for r in readers.read_patches(spark, str(tmp_path)).collect() if r.cve_id} == {(f"CVE-{k}", "late" if k == 3 else "ok") for k in range(20)}
    assert readers.read_patches(spark, str(tmp_path / "none")).count() == 0
