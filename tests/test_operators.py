"""Golden values of single operators."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from riskloom.functions import scoring, text, versions
from riskloom.operators import deps, exports, extract, graph, joins, metrics, ml, service, windows
from riskloom.operators import findings as fi
from riskloom.sources import readers, writers
from riskloom.streaming import streams


def test_confusion_and_rates(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, False), (False, False)], "y_true boolean, y_pred boolean")
    r = metrics.rates(metrics.confusion(rows)).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 0, 2, 1)
    assert (r.f1, r.precision, r.recall) == (0.6667, 1.0, 0.5)


def test_empty_metrics(spark):
    none = spark.createDataFrame([], "y_true boolean, y_pred boolean, y_prob double")
    r = metrics.rates(metrics.confusion(none)).first()
    assert (r.tp, r.accuracy, r.f1) == (0, 0.0, 0.0)
    assert metrics.brier(none).first().brier == 0.0
    assert metrics.bins(none, 5).count() == 5


def test_bins_hold_all_rows(spark):
    rows = spark.range(101).select((F.col("id") / 100).alias("y_prob"), (F.col("id") % 2 == 0).alias("y_true"))
    b = metrics.bins(rows, 10).orderBy("bin").collect()
    assert sum(x["count"] for x in b) == 101 and b[-1]["count"] == 11


def test_pagerank(spark):
    nodes = spark.createDataFrame([(x,) for x in ("a", "b", "c", "hub")], "id string")
    edges = spark.createDataFrame([("a", "hub"), ("b", "hub"), ("c", "hub"), ("a", "b"), ("x", "hub")], "src string, dst string")
    r = {x.id: x["rank"] for x in graph.pagerank(nodes, edges, iterations=20).collect()}
    assert abs(sum(r.values()) - 1) < 1e-6 and max(r, key=r.get) == "hub"
    assert graph.pagerank(nodes.limit(0), edges.limit(0)).count() == 0
    top = graph.relative_centrality(spark.createDataFrame(list(r.items()), "id string, rank double"), nodes)
    assert top.filter("id = 'hub'").first().centrality == 1.0


def test_bfs_limit_and_paths(spark):
    edges = spark.createDataFrame([(str(k), str(k + 1)) for k in range(14)] + [("3", "1")], "src string, dst string")
    start = spark.createDataFrame([("0",)], "id string")
    hops = {r.node: r.hops for r in graph.bfs(edges, start, 10).collect()}
    assert hops["10"] == 10 and "11" not in hops and hops["0"] == 0
    paths = graph.tainted_paths(graph.bfs_paths(edges, start, spark.createDataFrame([("3",)], "id string"), 5), spark.createDataFrame([("2",)], "id string"))
    p = paths.first()
    assert (p.hops, p.path, p.tainted) == (3, ["0", "1", "2", "3"], True)


def test_tree_with_cycle(spark):
    requires = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "package string, dep string")
    tree = graph.resolve_tree(requires.filter("package = 'a'").select("package"), requires)
    assert {r.package: r.depth for r in tree.collect()} == {"a": 0, "b": 1, "c": 2}
    assert [(r.root, r.package) for r in graph.cycles(requires, tree).collect()] == [("a", "a")]


def test_layers_break_cycles(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    on = spark.createDataFrame([("b", "a"), ("c", "d"), ("d", "c")], "id string, on string")
    got = {r.id: r.layer for r in graph.layers(nodes, on).collect()}
    assert got["a"] < got["b"] < got["c"] < got["d"]


def test_tree_diff(spark):
    cur = spark.createDataFrame([("urllib3", "1.24.1"), ("gone", "1"), ("same", "1")], "package string, version string")
    tgt = spark.createDataFrame([("urllib3", "2.0.7"), ("new", "1"), ("same", "1")], "package string, version string")
    assert {(r.package, r.change) for r in joins.tree_diff(cur, tgt).collect()} == {("urllib3", "bumped"), ("gone", "removed"), ("new", "added")}


def test_evidence_merge_keeps_one_row(spark):
    kind = "cve_id string, seq int, source string"
    graph_rows = spark.createDataFrame([("c1", 1, "graph")], kind)
    symbols = spark.createDataFrame([("c1", 1, "symbol"), ("c2", 2, "symbol"), ("c2", 1, "symbol")], kind)
    merged = joins.merge_evidence(graph_rows, symbols)
    assert {(r.cve_id, r.seq) for r in merged.collect()} == {("c1", 1), ("c2", 1)}
    assert joins.merge_evidence(merged, symbols).count() == merged.count()


def test_innermost(spark):
    points = spark.createDataFrame([(1, "f", 12), (2, "f", 99)], "hit int, file string, line int")
    ranges = spark.createDataFrame([("f", 1, 1, 50), ("f", 2, 10, 20), ("f", 3, 10, 30)], "file string, range_id int, low int, high int")
    assert {(r.hit, r.range_id) for r in joins.innermost(points, ranges, "file", "line", "hit").collect()} == {(1, 2), (2, None)}


def test_tampered_chain(spark):
    log = spark.createDataFrame([("t", k, f"p{k}") for k in range(3)], "tenant string, seq int, payload string")
    chain = windows.chained(log, "tenant", "seq", "payload")
    assert windows.verify(chain, "tenant", "seq", "payload").first().broken_at is None
    bad = chain.withColumn("payload", F.when(F.col("seq") == 1, "x").otherwise(F.col("payload")))
    assert windows.verify(bad, "tenant", "seq", "payload").first().broken_at == 1


def test_cache_hits(spark):
    files = spark.createDataFrame([("a",), ("b",)], "key string")
    empty = files.limit(0)
    assert metrics.cache_stats(files, empty).first().misses == 2
    again = metrics.cache_stats(files, files).first()
    assert (again.hits, again.hit_rate) == (2, 1.0)


def test_versions(spark):
    df = spark.createDataFrame([("1.10.0", ">=1.9,<2"), ("2.0", "<2.0.0"), ("1.4", "!=1.4.0"), ("1.0", "")], "v string, s string")
    assert [r[0] for r in df.select(versions.satisfies(F.col("v"), F.col("s"))).collect()] == [True, False, False, True]
    full = spark.createDataFrame([("1.4.5", "~=1.4.2"), ("2.0rc1", "<2.0"), ("x", ">=1")], "v string, s string")
    assert [r[0] for r in full.select(versions.satisfies(F.col("v"), F.col("s"))).collect()] == [True, False, True]


def test_source_references(spark):
    code = "import yaml as y\nfrom PIL import Image\nfrom lib import *\n@app.route('/a', methods=['POST'])\ndef f(x):\n    y.load(x)\n    Image.open(x)\n    helper(x)\n"
    rows = extract.extract_refs(spark.createDataFrame([("a.py", code), ("bad.py", "def ("), ("none.py", None)], "path string, text string")).collect()
    calls = {(r.fqn, r.confidence, r.entry_route, r.entry_method) for r in rows if r.kind == "call" and r.enclosing == "f"}
    assert calls == {("yaml.load", "HIGH", "/a", "POST"), ("PIL.Image.open", "HIGH", "/a", "POST"), ("lib.helper", "MEDIUM", "/a", "POST")}
    assert {r.path for r in rows} == {"a.py"}


def test_call_graph(spark):
    files = [("app.py", "from helpers import process\ndef run_job(x):\n    return process(x)\n"), ("helpers.py", "import yaml\ndef process(x):\n    return load_config(x)\ndef load_config(x):\n    return yaml.load(x)\n")]
    edges = extract.resolve_calls(extract.extract_functions(spark.createDataFrame(files, "path string, text string")))
    starts, sinks = spark.createDataFrame([("app.py::run_job",)], "id string"), spark.createDataFrame([("ext::yaml.load",), ("ext::yaml.safe_load",)], "id string")
    got = graph.bfs_paths(edges, starts, sinks, 10).collect()
    assert [(r.sink, r.hops) for r in got] == [("ext::yaml.load", 3)]


def test_hunks():
    diff = "--- a/s.py\n+++ b/s.py\n@@ -1 +1,2 @@ def f(x):\n-a\n+b\n+c\n--- a/tests/t.py\n+++ b/tests/t.py\n@@ -1 +1 @@\n-a\n+b\n"
    assert extract.hunks_of(diff) == [("s.py", "def f(x):", ["b", "c"], ["a"])]


def test_cvss_and_families(spark):
    p = spark.range(1).select(fi.parse_cvss(F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:U/C:H/I:L/A:N")).alias("p")).first().p
    assert (p.attack_vector, p.privileges_required, p.user_interaction, p.impact.confidentiality) == ("network", "none", True, "high")
    df = spark.createDataFrame([("CWE-89",), ("CWE-9-X",)], "cwe string")
    assert {r.family for r in fi.with_family(df, fi.families(spark)).collect()} == {"sql_injection", "cwe_9_x"}


def score_one(spark, **kw):
    base = {"cve_id": "C", "package": "p", "severity": "HIGH", "cvss_score": 9.8, "attack_vector": None, "privileges_required": None, "user_interaction": False, "confidentiality": None, "integrity": None, "availability": None} | kw
    one = spark.createDataFrame([tuple(base.values())], "cve_id string, package string, severity string, cvss_score double, attack_vector string, privileges_required string, user_interaction boolean, confidentiality string, integrity string, availability string")
    return one


def test_floor_and_block(spark):
    epss = spark.createDataFrame([("C", 0.9)], "cve_id string, epss double")
    kev = spark.createDataFrame([], "cve_id string")
    reach = spark.createDataFrame([("C", 1, "HIGH", True)], "cve_id string, hops int, confidence string, tainted boolean")
    exposed = spark.createDataFrame([], "cve_id string, service string")
    hot = scoring.score(score_one(spark), epss, kev, reach, exposed).first()
    assert hot.recommendation == "BLOCK" and hot.reachability_kind == "direct" and hot.confidence == 1.0
    mild = scoring.score(score_one(spark, cvss_score=4.0), epss.limit(0), kev, reach, exposed).first()
    assert mild.raw_risk < 40 and mild.recommendation == "REVIEW"
    cold = scoring.score(score_one(spark), epss.limit(0), kev, reach.limit(0), exposed).first()
    assert cold.recommendation == "PROCEED" and cold.reachability_kind == "transitive"


def test_conflicts(spark):
    requires = spark.createDataFrame([("a", "u", ">=2.0"), ("b", "u", "<2.0"), ("a", "v", ">=1"), ("b", "v", ">=1")], "package string, dep string, spec string")
    resolved = spark.createDataFrame([("u", "2.0.7"), ("v", "1.5")], "package string, version string")
    assert [(r.dep, r.n) for r in deps.conflicts(requires, resolved).collect()] == [("u", 2)]


def test_services(spark):
    asked = spark.createDataFrame([("viewer", "assessment:read", "t", "t"), ("viewer", "assessment:delete", "t", "t"), ("owner", "assessment:delete", "t", "u"), ("nobody", "assessment:read", "t", "t")], "role string, action string, tenant string, resource_tenant string")
    got = {(r.role, r.action): r.allowed for r in service.allowed(asked, service.permissions(spark)).collect()}
    assert list(got.values()).count(True) == 1 and got[("viewer", "assessment:read")]


def test_text(spark):
    df = spark.createDataFrame([("Foo__Bar.baz", "https://github.com/o/r/pull/3/commits/abcdef123456", "src.a.a.lib.b", "<a href='x'>&")], "n string, u string, f string, h string")
    r = df.select(text.normalize_name(F.col("n")).alias("n"), text.canonical_commit(F.col("u")).alias("u"), text.clean_fqn(F.col("f")).alias("f"), text.escape_html(F.col("h")).alias("h")).first()
    assert tuple(r) == ("foo-bar-baz", "https://github.com/o/r/commit/abcdef123456", "a.b", "&lt;a href=&#x27;x&#x27;&gt;&amp;")


def test_sources(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"cve_id": "C", "package": "p", "cwe": ["CWE-89"]}]))
    assert readers.read_findings(spark, str(tmp_path / "f.json")).first().package == "p"
    assert readers.read_findings(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "scan.json").write_text(json.dumps({"Results": [{"Vulnerabilities": [{"VulnerabilityID": "C", "PkgName": "p", "References": ["http://x/commit/1", "y"]}, {"PkgName": "q"}]}]}))
    assert [(r.cve_id, r.commit_urls) for r in readers.read_raw_scan(spark, str(tmp_path / "scan.json")).collect()] == [("C", ["http://x/commit/1"])]
    (tmp_path / "epss.json").write_text(json.dumps({"CVE-1": {"epss": 0.5, "percentile": 0.9}}))
    assert readers.read_epss(spark, str(tmp_path / "epss.json")).first().epss == 0.5
    (tmp_path / "kev.json").write_text(json.dumps({"catalog": ["CVE-1"], "snapshot_date": "2024-01-01"}))
    assert readers.read_kev(spark, str(tmp_path / "kev.json")).first().cve_id == "CVE-1"
    (tmp_path / "req.txt").write_text("# c\nrequests[security]==2.20.0  # pin\n-e ./x\nflask==0.12\nclick>=8\n")
    assert {(r.package, r.version) for r in readers.read_requirements(spark, str(tmp_path / "req.txt")).collect()} == {("requests", "2.20.0"), ("flask", "0.12")}
    toml = spark.createDataFrame([("pyproject.toml", '[tool.poetry.dependencies]\npython = "^3.9"\nflask = "^1.0"\nany = "*"\n'), ("bad", "[")], "path string, text string")
    assert [(r.package, r.version) for r in readers.pins_of_toml(toml).collect()] == [("flask", "1.0")]
    src = tmp_path / "src"
    (src / "venv").mkdir(parents=True)
    (src / "a.py").write_text("x = 1")
    (src / "venv" / "b.py").write_text("x")
    (src / "c.py").write_bytes(b"\0x")
    assert [r.text for r in readers.read_sources(spark, str(src)).collect()] == ["x = 1"]
    (tmp_path / "dep").mkdir()
    graph_json = {"nodes": [{"relation": "SELF", "versionKey": {"name": "A", "version": "1"}}, {"relation": "DIRECT", "versionKey": {"name": "B_b", "version": "2"}}], "edges": [{"fromNode": 0, "toNode": 1, "requirement": ">=1 ; python_version > '3'"}]}
    (tmp_path / "dep" / "g.json").write_text(json.dumps(graph_json))
    assert [tuple(r) for r in readers.direct_dependencies(readers.read_dependency_graphs(spark, str(tmp_path / "dep"))).collect()] == [("a", "1", "b-b", ">=1", "2")]


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("n", "x"), ("n", "x")], "label string, id string")
    edges = spark.createDataFrame([("calls", "x", "x")], "kind string, src string, dst string")
    writers.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/nodes")).count() == 1
    rows = spark.createDataFrame([("t", "s", 1)], "tenant string, scan_id string, n int")
    service.submit(str(tmp_path / "store"), rows)
    assert service.get(spark.read.parquet(str(tmp_path / "store")), "t", "s").count() == 1
    assert service.get(spark.read.parquet(str(tmp_path / "store")), "u", "s").count() == 0
    rule = spark.createDataFrame([("r", "python", "ERROR", "m", ["f(...)"])], "rule_id string, language string, severity string, message string, patterns array<string>")
    assert "pattern: f(...)" in writers.rule_yaml(rule).first().text


def test_exports(spark):
    a = spark.createDataFrame([("C1", "p", "HIGH", 9.0, "BLOCK", "direct"), ("C2", "q", "LOW", 1.0, "PROCEED", "none")], "cve_id string, package string, severity string, cvss_score double, recommendation string, reachability_kind string")
    places = spark.createDataFrame([("C1", "a.py", 0)], "cve_id string, file string, line int")
    got = {(r.rule_id, r.level, r.uri, r.start_line) for r in exports.sarif_rows(a, places).collect()}
    assert got == {("C1", "error", "a.py", 1), ("C2", "note", "requirements.txt", 1)}
    assert {r.cve_id: r.status for r in exports.vex_rows(a).collect()} == {"C1": "affected", "C2": "not_affected"}


def test_model_beats_baseline(spark):
    rows = ml.synthetic(spark, 2000).withColumn("x", ml.features(*map(F.col, ("cvss", "epss", "percentile", "cwe_count", "age_days"))))
    split = windows.temporal_split(rows.withColumn("k", F.lit(1)), "k", ["published_ordinal"], 0.75)
    means, stds = ml.scale(split.filter("train"), 5)
    known = split.withColumn("x", ml.scaled(F.col("x"), means, stds))
    weights, bias = ml.fit(known.filter("train"), 5, rate=0.8, epochs=25)
    r = ml.evaluate(ml.predict(known.filter("not train"), weights, bias)).first()
    assert r.brier < r.brier_baseline and r.accuracy >= 0.7 and weights[0] > 0


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(str(k % 3), float(k)) for k in range(30)], "kind string, value double")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    streams.run_available(streams.counters(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "kind"), str(tmp_path / "out"), str(tmp_path / "state"), "complete")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {tuple(r) for r in streams.counters(rows, "kind").collect()}


#: Eight labelled cases (id, CVSS, EPSS, reachable) and the scores expected of them.
CASES = [
    ("CVE-2023-32681", 6.1, 0.00099, True, 35), ("CVE-2019-10906", 9.8, 0.0203, True, 87), ("CVE-2020-1747", 9.8, 0.0241, True, 87), ("CVE-2020-5313", 6.5, 0.0041, True, 40),
    ("CVE-2018-1000656", 7.5, 0.0112, True, 53), ("CVE-2019-11324", 7.5, 0.0054, False, 3), ("CVE-2020-26137", 6.5, 0.0061, False, 2), ("CVE-2020-25659", 5.9, 0.0021, False, 2),
]


def test_labelled_cases(spark):
    kind = "cve_id string, package string, severity string, cvss_score double, attack_vector string, privileges_required string, user_interaction boolean, confidentiality string, integrity string, availability string, cwe array<string>"
    found = spark.createDataFrame([(c, "p", "HIGH", v, None, None, None, None, None, None, []) for c, v, *_ in CASES], kind)
    epss = spark.createDataFrame([(c, e) for c, _, e, *_ in CASES], "cve_id string, epss double")
    reach = spark.createDataFrame([(c, 1, "HIGH", False) for c, _, _, r, _ in CASES if r], "cve_id string, hops int, confidence string, tainted boolean")
    none = spark.createDataFrame([], "cve_id string, service string")
    got = {r.cve_id: r.raw_risk for r in scoring.score(found, epss, none.select("cve_id"), reach, none).collect()}
    assert got == {c: s for c, *_, s in CASES}
    off = scoring.MODEL | {"exploitability": scoring.MODEL["exploitability"] | {"use_ml_model": False}}
    assert all(r.raw_risk <= got[r.cve_id] for r in scoring.score(found, epss, none.select("cve_id"), reach, none, off).collect())


def test_forged_entries_break_the_chain(spark):
    import hashlib

    log = spark.createDataFrame([(t, k, f"{t}{k}") for t in "ab" for k in range(6)], "tenant string, seq int, payload string")
    rows = [tuple(r) for r in windows.chained(log, "tenant", "seq", "payload").select("tenant", "seq", "payload", "prev_hash", "entry_hash").collect()]
    last = {}
    for t, k, p, before, own in sorted(rows):
        assert before == last.get(t, "0" * 64) and own == hashlib.sha256((before + p).encode()).hexdigest()
        last[t] = own
    broken = lambda rows: {r.tenant: r.broken_at for r in windows.verify(spark.createDataFrame(rows, "tenant string, seq int, payload string, prev_hash string, entry_hash string"), "tenant", "seq", "payload").collect()}
    forged = {r[:2]: list(r) for r in rows}
    forged["a", 1][2] = "other"
    forged["a", 1][4] = hashlib.sha256((forged["a", 1][3] + "other").encode()).hexdigest()
    forged["a", 2][3] = forged["a", 1][4]
    assert broken(rows) == {"a": None, "b": None} and broken([tuple(r) for r in forged.values()]) == {"a": 2, "b": None}
    assert broken([r for r in rows if r[:2] != ("b", 3)]) == {"a": None, "b": 4}
    twice = [*rows, *((t, 9, p, before, own) for t, k, p, before, own in rows if (t, k) == ("a", 4))]
    assert broken(twice) == {"a": 9, "b": None}


def test_layers_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(k,) for k in range(60)], "id int")
    got = {r.id: r.layer for r in graph.layers(nodes, spark.createDataFrame([(k + 1, k) for k in range(59)], "id int, on int")).collect()}
    assert got == {k: k for k in range(60)} and graph.layers(nodes.limit(0), nodes.selectExpr("id", "id as on")).count() == 0


def test_fit_matches_numpy(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(size=(60, 2))
    y = (x[:, 0] - x[:, 1] + r.normal(size=60) > 0).astype(int)
    w, b = np.zeros(2), 0.0
    for _ in range(40):
        gap = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.5 * (x.T @ gap / 60 + 0.01 * w), b - 0.5 * gap.mean()
    got, bias = ml.fit(spark.createDataFrame([(list(map(float, a)), int(k)) for a, k in zip(x, y)], "x array<double>, label int"), 2, rate=0.5, epochs=40, l2=0.01)
    assert np.allclose(got, w) and abs(bias - b) < 1e-9


def test_hits_of_several_names_meet_a_symbol_once(spark):
    hits = spark.createDataFrame([(1, "a.f"), (1, "b.f"), (1, "b.g"), (2, "m.f"), (2, "m.f"), (3, "x.k"), (3, "y.k"), (None, "a.f"), (None, "b.f"), (4, None), (5, "f")], "hit_id long, fqn string")
    symbols = spark.createDataFrame([("c1", "p.f", "f"), ("c1", "q.g", "g"), ("c2", "q.f", "f"), ("c3", "x.k", "k"), ("c3", "y.k", "k")], "cve_id string, fqn string, short_name string")
    got = [tuple(r) for r in joins.match_symbols(hits, symbols).collect()]
    want = [(h, c, "short") for h in (1, 2, None) for c in ("c1", "c2")] + [(3, "c3", "exact")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def plain_ranks(n, edges, iterations=100, tolerance=1e-9, d=0.85):
    r, out = [1.0 / n] * n, [sum(a == k for a, _ in edges) for k in range(n)]
    for done in range(1, iterations + 1):
        loose = sum(x for k, x in enumerate(r) if not out[k])
        new = [(1 - d) / n + d * loose / n] * n
        for a, b in edges:
            new[b] += d * r[a] / out[a]
        gap, r = sum(abs(x - y) for x, y in zip(r, new)), new
        if gap < tolerance:
            break
    return r, done


def ranked(spark, n, edges, **more):
    nodes = spark.createDataFrame([(k,) for k in range(n)], "id int")
    got = {x.id: x["rank"] for x in graph.pagerank(nodes, spark.createDataFrame(edges, "src int, dst int"), **more).collect()}
    return [got[k] for k in range(n)]


def test_pagerank_of_short_paths_writes_few_tables(spark, monkeypatch):
    edges = [(k, 12 + k % 3) for k in range(12)] + [(0, 13), (0, 13), (12, 14)]
    want, rounds = plain_ranks(16, edges)
    written = []
    monkeypatch.setattr(graph, "cut", lambda df, real=graph.cut: written.append(1) or real(df))
    assert max(abs(x - y) for x, y in zip(want, ranked(spark, 16, edges))) < 1e-12
    assert rounds > 20 and len(written) < 5


def test_pagerank_of_long_paths_and_cycles_goes_on(spark):
    for edges, more in (([(k, k + 1) for k in range(11)] + [(3, 0), (3, 5)], {"iterations": 12}), ([(0, 1), (1, 0), (1, 2), (2, 3)], {"iterations": 3}), ([(k, k + 1) for k in range(11)], {"tolerance": 1e-2})):
        want, _ = plain_ranks(12, edges, **more)
        assert max(abs(x - y) for x, y in zip(want, ranked(spark, 12, edges, **more))) < 1e-12


def test_requirers_are_those_of_the_tree_alone(spark, monkeypatch):
    rows = [(f"k{k:02}", f"k{k + 1:02}") for k in range(20)] + [("k02", "k00"), ("k15", "k03"), ("x", "k01"), ("k15", "y"), ("k03", "k05"), ("k03", "k05")]
    requires = spark.createDataFrame(rows, "package string, dep string")
    root = spark.createDataFrame([("k00",)], "package string")
    tree = [r.package for r in graph.resolve_tree(root, requires).collect()]
    want = sorted({(d, p) for p, d in rows if p in tree and d in tree})
    written = []
    monkeypatch.setattr(graph.Grown, "add", lambda self, df, real=graph.Grown.add: written.append(df.columns) or real(self, df))
    found = graph.requirers(root, requires).collect()
    assert sorted((r.package, r.parent) for r in found) == want and all("path" not in c for c in written)


def test_ranks_read_lineitem_once(spark, monkeypatch):
    from riskloom.plans import graphs

    read, real = [], graphs.view
    monkeypatch.setattr(graphs, "view", lambda *a: read.append(a[-1]) or real(*a))
    given, pagerank = [], graph.pagerank
    monkeypatch.setattr(graph, "pagerank", lambda nodes, edges: given.extend([nodes, edges]) or pagerank(nodes, edges))
    for name in ("service_centrality", "centrality_upsert"):
        assert graphs.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert read == ["exposed"] * 2 and len(given) == 4 and not any("lineitem" in f for df in given for f in df.inputFiles())


def test_pairs_of_hits_with_several_names_are_not_shuffled(spark):
    hits = spark.sql("select id % 100 as hit_id, concat('m.f', id div 100) as fqn from range(200)")
    symbols = spark.sql("select concat('c', id) as cve_id, concat('p.f', id % 2) as fqn, concat('f', id % 2) as short_name from range(1000)")
    sc = spark.sparkContext._jsc.sc()

    def sent():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = sent()
    got = [tuple(r) for r in joins.match_symbols(hits, symbols).collect()]
    rows = sum(n for stage, n in sent().items() if stage not in before)
    assert sorted(got) == sorted((h, f"c{c}", "short") for h in range(100) for c in range(1000))
    assert 0 < rows < 20_000  # of 100,000 pairs


def stages_since(spark, seen=()):
    """Stage ids with the rows that each sent on by a shuffle, but for those seen before."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size()) if stages.apply(i).stageId() not in seen}


def test_pairs_of_a_hot_name_are_many_tasks_work_and_small_in_files(spark, tmp_path):
    hits = spark.sql("select id as hit_id, 'm.f' as fqn from range(200)")
    symbols = spark.sql("select concat('c', id) as cve_id, 'p.f' as fqn, 'f' as short_name from range(20000)")
    joins.match_symbols(hits, symbols).write.parquet(str(tmp_path / "pairs"))
    got = spark.read.parquet(str(tmp_path / "pairs")).groupBy("hit_id", "how").agg(F.count("s_cve").alias("n"), F.count_distinct("s_cve").alias("d")).collect()
    assert sorted(map(tuple, got)) == [(h, "short", 20_000, 20_000) for h in range(200)]
    files = [f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")]
    assert sum(f > 20_000 for f in files) >= 4 and sum(files) < 2_000_000  # of 4,000,000 rows


def test_pairs_in_small_parts_are_those_of_brute_force(spark, monkeypatch):
    for k, n in (("PART", 8), ("SMALL", 3), ("BLOCK", 4)):
        monkeypatch.setattr(joins, k, n)
    hits = [(k * 7 % 60 if k % 41 else None, None if k % 17 == 0 else f"{'pqr'[k % 3]}.f{k % 4}" if k % 5 else f"f{k % 4}") for k in range(300)]
    symbols = [(f"c{k % 70}" if k % 23 else None, f"{'ps'[k % 2]}.f{k * k % 5}" if k % 9 else None, f"f{k * k % 5}" if k % 13 else None) for k in range(150)]
    known = {f for _, f, _ in symbols if f}
    want = {(h, c, "exact") for h, f in hits for c, g, _ in symbols if f and f == g}
    want |= {(h, c, "short") for h, f in hits for c, _, s in symbols if f and "." in f and f not in known and f.split(".")[-1] == s}
    got = joins.match_symbols(spark.createDataFrame(hits, "hit_id long, fqn string"), spark.createDataFrame(symbols, "cve_id string, fqn string, short_name string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr) and len({w for *_, w in want}) == 2
