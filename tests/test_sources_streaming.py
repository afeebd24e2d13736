"""Readers, parsers, sinks, streams, and the entry module without the llm subpackage."""

import datetime
import json
import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from codeframe.functions import registry
from codeframe.sources import extract, files, git, patterns, sinks, tools
from codeframe.streaming import events

ROOT = Path(__file__).resolve().parent.parent


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.split("\n")], "value string")


def test_source_tree(spark, tmp_path):
    for name, body in (("src/a.ts", "export function f() {}\n"), ("node_modules/x.ts", ""), (".git/y.ts", ""), ("Dockerfile", "FROM x"), ("src/deep/b.py", "def g():\n  pass\n"), ("notes.xyz", "")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    got = {r.file: r.language for r in files.source_files(spark, str(tmp_path)).collect()}
    assert got == {"src/a.ts": "typescript", "Dockerfile": "dockerfile", "src/deep/b.py": "python"}
    assert files.source_files(spark, str(tmp_path), max_depth=2).count() == 2


def test_json_index_skips_malformed(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text('{"symbol": "f", "hash": "h", "lines": "3-9"}\nnot json\n{"symbol": "g", "lines": "x"}\n')
    assert sorted((r.symbol, r.start_line, r.end_line) for r in files.symbol_index(spark, str(p)).collect()) == [("f", 3, 9), ("g", 0, 0)]


def test_call_graph_text(spark):
    got = files.call_graph(lines(spark, 'h1: ["a", "b:read", "ext:x:y"]\n# note\nh2: []'))
    assert sorted(map(tuple, got.collect())) == [("h1", "a", "call"), ("h1", "b", "read"), ("h1", "ext:x:y", "call")]


def test_toon(spark):
    text = 'version: 2\nsyms[2]{name,args}:\n  f,"a, b"\n  g,c\n  extra,row'
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "doc int, line long, value string")
    assert [r.fields for r in files.toon_rows(rows).orderBy("row").collect()] == [{"name": "f", "args": "a, b"}, {"name": "g", "args": "c"}]
    assert [tuple(r) for r in files.toon_scalars(rows).collect()] == [(1, "version", "2")]
    assert sinks.toon(spark.createDataFrame([(1, "a,b")], "n int, s string"), "t") == 't[1]{n,s}:\n  1,"a,b"'


def test_git(spark):
    got = git.name_status(lines(spark, "M\ta.rs\nR090\told.rs\tnew.rs\n\nD\tb.rs"))
    assert sorted((r.path, r.old_path, r.change_type) for r in got.collect()) == [("a.rs", None, "modified"), ("b.rs", None, "deleted"), ("new.rs", "old.rs", "renamed")]
    assert [tuple(r) for r in git.numstat(lines(spark, "3\t1\ta\n-\t-\tb")).collect()] == [("a", 3, 1), ("b", 0, 0)]
    state = lambda a, b: git.staleness(spark.createDataFrame([a], "sha string, status_hash string"), spark.createDataFrame([b], "sha string, status_hash string")).first().state
    assert (state(("x", "1"), ("x", "1")), state(("x", "1"), ("y", "1")), state((None, None), (None, None))) == ("fresh", "stale", "check_times")


def test_linters(spark):
    for linter, line, want in (
        ("tsc", "a.ts(3,9): error TS2304: no name", ("a.ts", 3, 9, "error", "TS2304")), ("ruff", "a.py:1:2: E501 too long", ("a.py", 1, 2, "warning", "E501")), ("mypy", "a.py:7: note: see [misc]", ("a.py", 7, None, "info", "misc")),
        ("golangci", "m.go:4:5: bad thing (vet)", ("m.go", 4, 5, "warning", "vet")), ("gcc", "x.c:9:1: fatal error: gone [-Wall]", ("x.c", 9, 1, "error", "-Wall")), ("shellcheck", "s.sh:2:3: note: hm [SC1000]", ("s.sh", 2, 3, "info", "SC1000")),
        ("rubocop", "a.rb:1:2: E: Lint/X: bad", ("a.rb", 1, 2, "error", "Lint/X")), ("yamllint", "a.yml:1:2: [warning] w (line-length)", ("a.yml", 1, 2, "warning", "line-length")), ("hadolint", "Dockerfile:3 DL3008 warning: pin", ("Dockerfile", 3, None, "warning", "DL3008")),
        ("dotnet", "A.cs(1,2): warning CS1: m [p.csproj]", ("A.cs", 1, 2, "warning", "CS1")), ("checkstyle", "[WARN] A.java:3:4: m [Rule]", ("A.java", 3, 4, "warning", "Rule")),
    ):
        r = tools.lint_lines(lines(spark, line + "\nunrelated"), linter).collect()
        assert [(x.file, x.line, x.column, x.severity, x.rule) for x in r] == [want], linter
    report = json.dumps([{"filePath": "f.js", "messages": [{"ruleId": "r", "severity": 2, "message": "m", "line": 1, "column": 2, "fix": {"text": "x"}}, {"ruleId": None, "severity": 1, "message": "n"}]}])
    issues = tools.eslint_json(lines(spark, report))
    assert [(r.line, r.severity, r.fix) for r in tools.select_issues(issues, "error", fixable=True).collect()] == [(1, "error", "x")]
    assert tuple(tools.rollup(issues).first()) == (1, 1, 1)
    xml = spark.createDataFrame([("F.java", '<error line="3" column="1" severity="error" message="a &lt; b &amp;amp;" source="X"/>')], "file string, value string")
    assert tools.checkstyle_xml(xml).first().message == "a < b &amp;"


def test_runners(spark):
    run = lambda text, kind: tuple(tools.test_results(spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "run int, line long, value string"), kind).first())
    assert run("x\n3 passed\n== 2 failed, 5 passed, 1 skipped, 1 error in 1s ==", "pytest") == (1, 5, 3, 1, 9)
    assert run("test result: ok. 4 passed; 0 failed; 1 ignored;\ntest result: FAILED. 1 passed; 2 failed; 0 ignored;", "cargo") == (1, 5, 2, 1, 8)
    assert run("Tests:       1 failed, 7 passed, 8 total", "npm") == (1, 7, 1, 0, 8)
    assert run("--- PASS: A (0s)\n--- FAIL: B (0s)\n    --- SKIP: C\nok x", "go") == (1, 1, 1, 1, 3)


def test_patterns_match(spark):
    src = spark.createDataFrame([(1, "python", "try:\n  load(x)\n  loads(y)\n"), (2, "rust", "fn f() {}")], "doc_id long, language string, text string")
    from codeframe.operators import duplicates

    got = duplicates.match_patterns(patterns.fingerprints(src), patterns.catalogue(spark), 0.8).collect()
    assert [(r.doc_id, r.cve_id, r.severity) for r in got] == [(1, "CWE-502-pickle", "critical")]


def test_extraction(spark):
    rust = "use std::fmt;\npub struct P;\n\nimpl P {\n    pub fn run(&self) {\n        if a {\n            helper(1);\n        }\n    }\n}\nfn helper(x: u8) {\n}\n"
    f = spark.createDataFrame([("src/game/p.rs", "rust", rust), ("x.zz", "zz", "fn no() {}")], "file string, language string, text string")
    syms = extract.symbols(f)
    assert sorted((r.symbol, r.kind, r.start_line, r.end_line, r.is_exported, r.cognitive) for r in syms.collect()) == [("P", "struct", 2, 2, True, 0), ("helper", "function", 11, 13, False, 0), ("run", "function", 5, 10, True, 1)]
    assert [tuple(r) for r in extract.imports(f).collect()] == [("src/game/p.rs", "std::fmt")]
    names = {r.hash: r.symbol for r in syms.collect()}
    assert {(r.name, names[r.caller]) for r in extract.calls(f, syms).collect()} == {("helper", "run")}
    assert all(len(h) == 25 and h[8] == ":" for h in names)


def test_sinks(spark, tmp_path):
    root = str(tmp_path / "index")
    symbols = spark.createDataFrame([("h1", "m1"), ("h2", "m2")], "hash string, module string")
    graph = spark.createDataFrame([("h1", "h2")], "caller string, callee string")
    assert sinks.write_index(root, {"graph": graph, "symbols": symbols}) == ["symbols", "graph"]
    assert sinks.write_index(root, {"graph": graph, "symbols": symbols}) == []
    sinks.overwrite_modules(spark.createDataFrame([("h9", "m2")], "hash string, module string"), root + "/symbols")
    assert sorted(r.hash for r in spark.read.parquet(root + "/symbols").collect()) == ["h1", "h9"]
    assert (sinks.batch_size(10), sinks.batch_size(100_000), sinks.batch_size(None)) == (100, 50_000, 5_000)
    sinks.export_graph(str(tmp_path / "x"), symbols, graph, graph, graph, graph)
    assert spark.read.parquet(str(tmp_path / "x/edges")).count() == 1
    assert sinks.json_rows(graph).first().value == '{"caller":"h1","callee":"h2"}'


def test_sql_functions(spark):
    assert registry.register(spark) == sorted(registry.FUNCTIONS)
    assert spark.sql("select cf_edge_kind('a:b:read') as k, cf_loc(3, 9) as n").first() == ("read", 7)


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_throttle_in_batch_and_stream(spark, tmp_path):
    rows = [("a", at(0)), ("a", at(0.3)), ("a", at(0.6)), ("b", at(0.1)), ("a", at(0.9)), ("a", at(1.2))]
    want = {("a", at(0)), ("a", at(0.6)), ("a", at(1.2)), ("b", at(0.1))}
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "key string, ts timestamp, id int")
    assert {(r.key, r.ts) for r in events.throttle_batch(df, "key", "ts", "id", 0.5).collect()} == want
    df.select("key", "ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = events.throttle_stream(stream, "key", "ts", 0.5).writeStream.format("memory").queryName("throttled").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.key, r.ts) for r in spark.sql("select * from throttled").collect()} == want


def test_cooldown_debounce_and_upsert(spark, tmp_path):
    rows = [("p", at(0)), ("p", at(1)), ("q", at(2)), ("p", at(200))]
    spark.createDataFrame(rows, "path string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "in"))
    q = events.cooldown_stream(read(), "path", "ts", "3 seconds").writeStream.format("memory").queryName("cool").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cool").where("path = 'q'").count() == 1 and spark.table("cool").where("path = 'p'").count() <= 2
    q = events.debounce_stream(read(), "ts", "path", "10 seconds", "1 second").writeStream.format("memory").queryName("deb").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [sorted(r.paths) for r in spark.table("deb").orderBy("start").collect()][:1] == [["p", "q"]]
    store = str(tmp_path / "store")
    w = events.upsert_layers(store)
    cols = "hash string, layer long, seq long, state string"
    w(spark.createDataFrame([("h", 0, 1, "active")], cols), 0)
    w(spark.createDataFrame([("h", 0, 2, "deleted"), ("g", 1, 3, "active")], cols), 1)
    w(spark.createDataFrame([("h", 0, 2, "deleted"), ("g", 1, 3, "active")], cols), 1)
    assert sorted((r.hash, r.state) for r in events.current_layers(spark, store).collect()) == [("g", "active"), ("h", "deleted")]
    assert events.as_json(spark.createDataFrame([("t", 1)], "kind string, n int"), "kind", "n").first().value == '{"type":"t","payload":{"n":1}}'


def test_entry_without_the_llm_subpackage(tmp_path):
    for name in ("codeframe", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "codeframe" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'R1_bm25' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert out.returncode == 0, out.stderr


def test_names_are_unique_and_sql_has_queries():
    from codeframe import plans

    assert set(plans.oracle_sql()) <= set(plans.queries())


def test_flagship_is_lazy(spark):
    from codeframe import plans

    assert plans.flagship(spark, "/root/testdata/sf0.001").select(F.count("*")).first()[0] > 0
