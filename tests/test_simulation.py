"""Upgrade simulation, outside symbols, entry points and rules of patched symbols on golden cases."""

from __future__ import annotations

from riskloom.operators import commits, extract, graph, simulate


def test_upgrade_pulls_what_it_requires(spark):
    pins = spark.createDataFrame([("p", "app", "1.0"), ("p", "lib", "1.0"), ("p", "old", "1.0"), ("q", "gone", "1.0")], "project string, package string, version string")
    ups = spark.createDataFrame([("p", "app", "2.0", 0)], "project string, package string, target_version string, position int")
    direct = [("app", "1.0", "lib", ">=1.0", "1.0"), ("app", "2.0", "lib", ">=2.0", "2.0"), ("app", "2.0", "new", ">=1.0", "1.0"), ("old", "1.0", "lib", "<2.0", "1.0"), ("lib", "2.0", "base", ">=2.0", "2.0"), ("lib", "1.0", "base", ">=1.0", "1.0")]
    direct = spark.createDataFrame(direct, "parent string, parent_version string, dep string, spec string, dep_version string")
    releases = [(k, v, None) for k in ("app", "lib", "old", "new", "base") for v in ("1.0", "2.0")]
    out = simulate.simulate(pins, ups, direct, spark.createDataFrame(releases, "package string, version string, python_requires string"), "3.11")
    rows = {r.project: r for r in out["summary"].collect()}
    p, q = rows["p"], rows["q"]
    assert (p.verdict, p.status, p.bumped, p.added, p.removed, p.conflicts, p.chain, p.steps) == ("PROCEED_AFTER_RESOLUTION", "ok", 3, 1, 0, 1, 2, 2)
    assert (q.verdict, q.status, q.unresolved) == ("SAFE", "degraded", 1)
    assert [(r.package, r.forced_by) for r in out["chain"].orderBy("layer", "package").collect()] == [("base", "lib"), ("lib", "app")]
    assert [r.package for r in out["steps"].orderBy("part", "place", "package").collect()] == ["old", "app"]
    assert {(r.dep, r.n) for r in out["conflicts"].collect()} == {("lib", 2)}


def test_empty_simulation(spark):
    pins = spark.createDataFrame([], "project string, package string, version string")
    ups = spark.createDataFrame([], "project string, package string, target_version string, position int")
    direct = spark.createDataFrame([], "parent string, parent_version string, dep string, spec string, dep_version string")
    releases = spark.createDataFrame([], "package string, version string, python_requires string")
    assert simulate.simulate(pins, ups, direct, releases, "3.11")["summary"].count() == 0


def test_cycles_are_broken_in_each_group(spark):
    nodes = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", "b"), ("y", "c")], "g string, id string")
    depends = spark.createDataFrame([("x", "a", "b"), ("x", "b", "a"), ("y", "b", "a"), ("y", "c", "b")], "g string, id string, on string")
    assert {(r.g, r.id, r.layer) for r in graph.layers(nodes, depends, ("g",)).collect()} == {("x", "a", 0), ("x", "b", 1), ("y", "a", 0), ("y", "b", 1), ("y", "c", 2)}


def test_symbols_match_by_suffix(spark):
    edges = spark.createDataFrame([("e", "f"), ("f", "ext::pkg.yaml.load"), ("e", "ext::myyaml.load"), ("f", "ext::load")], "src string, dst string")
    starts, symbols = spark.createDataFrame([("e",)], "id string"), spark.createDataFrame([("yaml.load",), ("x.yaml.dump",)], "symbol string")
    assert [(r.symbol, r.hops, r.path) for r in graph.paths_to_symbols(edges, starts, symbols).collect()] == [("yaml.load", 2, ["e", "f", "ext::load"])]


def test_entry_points(spark):
    text = "from v import *\n@app.route('/x')\ndef x(): pass\nurlpatterns = [path('x/', x), path('y/', views.y), re_path('z', z)]\n"
    more = "@login\n@a.route('/q', methods=['post'])\n@a.get('/r')\ndef f(): pass\n@a.task\nclass K: pass\n@task\ndef g(): pass\n@w.delete(p)\ndef h(): pass\n@c.command\ndef i(): pass\n@a.route('/1')\ndef j(): pass\n@a.put('/2')\ndef j(): pass\n"
    sources = [("site\\urls.py", text), ("other.py", text), ("bad.py", "def ("), ("none.py", None), ("more.py", more)]
    rows = extract.extract_entry_points(spark.createDataFrame(sources, "path string, text string")).collect()
    got = {p: sorted((r.name, r.framework, r.route, r.method) for r in rows if r.path == p) for p, _ in sources}
    assert got["site\\urls.py"] == [("x", "flask", "/x", "GET"), ("y", "django", "y/", "GET")] and got["other.py"] == [("x", "flask", "/x", "GET")]
    assert got["bad.py"] == [] == got["none.py"] and got["more.py"] == [("f", "flask", "/q", "POST"), ("h", "fastapi", None, "DELETE"), ("j", "fastapi", "/2", "PUT")]


def test_known_sinks_override_rules(spark):
    resolved = spark.createDataFrame([("a", "r1", "registry"), ("b", "", "none")], "family string, rule_id string, source string")
    sinks = spark.createDataFrame([("b", "m.f(...)"), ("b", "m.f(...)"), ("c", "g(...)"), ("a", "")], "family string, pattern string")
    got = {r.family: (r.rule_id, r.source, r.patterns) for r in commits.symbol_rules(resolved, sinks, "python").collect()}
    assert got == {"a": ("r1", "registry", []), "b": ("symbol-b-python", "symbol", ["m.f(...)"]), "c": ("symbol-c-python", "symbol", ["g(...)"])}


def deep(spark, n: int):
    """Pins of a project on the first of n packages, each of which requires the next one and the last the second; releases 1.0 and 2.0."""
    pins = spark.createDataFrame([("p", "k0", "1.0")], "project string, package string, version string")
    direct = [(f"k{k}", v, f"k{k + 1 if k + 1 < n else 1}", f">={v}", v) for k in range(n) for v in ("1.0", "2.0")]
    return pins, spark.createDataFrame(direct, "parent string, parent_version string, dep string, spec string, dep_version string")


def test_trees_grow_to_their_ends(spark):
    nodes, edges = simulate.trees(*deep(spark, 20))
    assert {(r.package, r.version) for r in nodes.collect()} == {(f"k{k}", "1.0") for k in range(20)} and edges.count() == 20


def test_changes_of_deep_packages_are_counted(spark):
    pins, direct = deep(spark, 19)
    ups = spark.createDataFrame([("p", "k0", "2.0", 0)], "project string, package string, target_version string, position int")
    releases = spark.createDataFrame([(f"k{k}", v, None) for k in range(19) for v in ("1.0", "2.0")], "package string, version string, python_requires string")
    r = simulate.simulate(pins, ups, direct, releases, "3.11", ("summary",))["summary"].first()
    assert (r.bumped, r.added, r.removed, r.chain) == (19, 0, 0, 18)
