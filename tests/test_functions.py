"""Literal facts about expressions and operators."""

import pytest
from pyspark.sql import functions as F

from codeframe.functions import hashing, paths, rules, text
from codeframe.operators import diff, duplicates, graph, incremental, overlay, search


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize("s, want", [("hello", "a430d84680aabd0b"), ("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c")])
def test_fnv(spark, s, want):
    assert one(spark, hashing.fnv1a_hex(F.col("s")), s=s) == want


def test_fnv_of_long_and_wide_text(spark):
    s = "né日" * 4000
    h = 0xCBF29CE484222325
    for b in s.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert one(spark, hashing.fnv1a_hex(F.col("s")), s=s) == f"{h:016x}"
    assert one(spark, hashing.fnv1a(F.col("s")), s=s) % 2**64 == h
    assert one(spark, hashing.fnv1a_hex(F.col("s").cast("string")), s=None) is None


def test_names(spark):
    for n in ("handleUserLogin", "handle_user_login", "handleUser_login"):
        assert one(spark, text.camel_snake(F.col("n")), n=n) == ["handle", "user", "login"]
    terms = one(spark, text.bm25_terms(F.col("n")), n="handleUserAuthentication")
    assert terms == ["handle", "user", "authentication", "handleuserauthentication"]
    assert one(spark, text.bm25_terms(F.col("n")), n="the function is a test") == ["function", "test"]
    for n, want in (("camelCase", ["camel", "Case"]), ("snake_case", ["snake", "case"]), ("simple", ["simple"]), ("XMLParser", ["XMLParser"])):
        assert one(spark, text.split_identifier(F.col("n")), n=n) == want
    for n, want in (("123", 1), ("123456", 2), ("123456789012", 3)):
        assert one(spark, text.word_tokens(F.col("n")), n=n) == want


def test_token_estimates(spark):
    assert one(spark, text.count_tokens(F.col("s")), s="") == 1
    assert one(spark, text.count_tokens(F.col("s")), s="let x = 1;") == 1 + 1 + 1 + 1 + 1 + 1 + 1 + 1
    assert one(spark, text.estimate_tokens(F.col("s")), s="abcdefgh") == 3


def test_similarities(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, hashing.jaccard(a("foo", "bar", "baz"), a("foo", "bar", "qux"))) == 0.5
    assert one(spark, hashing.jaccard(a(), a())) == 1.0
    assert one(spark, hashing.fingerprint_similarity(F.lit(5).cast("long"), F.lit(5).cast("long"))) == 1.0
    assert one(spark, hashing.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_ranges(spark):
    for s, want in (("10-20", (10, 20)), ("10", (0, 0)), ("", (0, 0)), ("a-b", (0, 0)), ("invalid", (0, 0))):
        assert tuple(one(spark, paths.parse_lines(F.col("s")), s=s)) == want
    for s, want in (("45-89", (45, 89)), ("100", (100, 100)), ("", (None, None)), ("abc", (None, None))):
        assert tuple(one(spark, paths.parse_line_range(F.col("s")), s=s)) == want


def test_rules(spark):
    for n, want in ((0, "low"), (1, "low"), (2, "medium"), (3, "medium"), (4, "high"), (10, "high")):
        assert one(spark, rules.risk_level(F.lit(n))) == want
    for n, want in (("useState", True), ("use", False), ("usestuff", False)):
        assert one(spark, rules.is_hook(F.lit(n))) is want
    assert one(spark, rules.is_io(F.lit("fetch"))) is True
    for n, obj, want in (("log", "console", True), ("map", None, True), ("filter", None, True), ("fetchUser", None, False), ("validateInput", None, False)):
        assert one(spark, rules.is_utility_call(F.lit(n), F.lit(obj).cast("string"))) is want
    for n, want in ((1, "simple"), (5, "simple"), (6, "moderate"), (10, "moderate"), (11, "complex"), (21, "very_complex")):
        assert one(spark, rules.complexity_rating(F.lit(n))) == want
    assert one(spark, rules.instability(F.lit(10), F.lit(10))) == 0.5 and one(spark, rules.instability(F.lit(0), F.lit(10))) == 1.0
    for n, want in ((10.0, "critical"), (9.0, "critical"), (8.5, "high"), (7.0, "high"), (5.5, "medium"), (4.0, "medium"), (2.0, "low"), (0.0, "none")):
        assert one(spark, rules.severity_of_cvss(F.lit(n))) == want


def test_optimal_names(spark):
    def run(*names):
        rows = incremental.optimal_names(spark.createDataFrame([(n,) for n in names], "full string")).collect()
        return {r.depth for r in rows}, {r.full: r.short for r in rows}

    assert run("src.game.player", "src.game.enemy", "src.utils.format")[0] == {2}
    assert run("src.game.player", "src.map.player", "src.utils.format")[0] == {1}
    assert run("src.player", "lib.player")[0] == {0}
    depth, names = run("root", "src.game.player", "src.map.player")
    assert depth == {1} and names["root"] == "root" and names["src.map.player"] == "map.player"
    assert run("root")[0] == {0}


def test_merge_blocks(spark):
    m = spark.createDataFrame([("f", n, "x") for n in (1, 2, 3, 20, 21)], "file string, line long, line_text string")
    assert sorted(r.match_count for r in search.merge_blocks(m, 2).collect()) == [2, 3]


def test_bm25_ranks_the_right_document(spark):
    docs = spark.createDataFrame([(1, "authenticate_user login"), (2, "render page"), (3, "login form style page")], "id long, t string")
    t, _ = search.bm25_index(docs, "id", text.bm25_terms(F.col("t")))
    assert search.bm25_search(t, ["authenticate", "login"], 1).first().id == 1


def test_cycles_and_reach(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("b", "a")], "caller string, callee string")
    assert sorted((r.path, r.length) for r in graph.cycles(e).collect()) == [("a>b", 2), ("a>b>c", 3)]
    assert sorted((r.hash, r.depth) for r in graph.callers(e, "c", 2).collect()) == [("a", 2), ("b", 1)]
    assert graph.trace(e, "a", 1, "both").count() >= 5


def test_overlay_and_rebase(spark):
    w = spark.createDataFrame([("h", 0, 1, "active", "f"), ("h", 2, 2, "deleted", "f"), ("g", 0, 3, "active", "f"), ("g", 0, 4, "active", "z")], "hash string, layer long, seq long, state string, file string")
    assert [(r.hash, r.file) for r in overlay.active(w).collect()] == [("g", "z")]
    base = spark.createDataFrame([("a", "1"), ("b", "1")], "hash string, content string")
    over = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "hash string, content string")
    assert {r.hash: r.outcome for r in overlay.rebase(over, base).collect()} == {"a": "dropped", "b": "conflict", "c": "preserved"}


def test_strategies(spark):
    lit = F.lit
    for args, want in (((False, False, 0, 100), "full_rebuild"), ((True, True, 0, 100), "rebase"), ((True, False, 0, 100), "fresh"), ((True, False, 9, 100), "incremental"), ((True, False, 29, 100), "rebase"), ((True, False, 30, 100), "full_rebuild")):
        assert one(spark, rules.update_strategy(*map(lit, args))) == want


def test_greedy_clusters(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (1, 6)], "a long, b long")
    assert {r.member: r.primary for r in duplicates.greedy_clusters(pairs).collect()} == {2: 1, 6: 1, 4: 3}


def test_empty_diff(spark):
    e = spark.createDataFrame([], "k string, v long, risk string")
    assert diff.semantic_diff(e, e, "k", ["v"]).count() == 0


def test_near_pairs_equal_brute_force(spark):
    import random

    r = random.Random(1)
    rows = []
    for i in range(160):
        if rows and r.random() < 0.5:
            calls, names, params = (list(x) if isinstance(x, list) else x for x in rows[r.randrange(len(rows))][1:])
            if r.random() < 0.7 and calls:
                calls[r.randrange(len(calls))] = r.choice("abcdefgh")
            if r.random() < 0.5:
                params = r.randrange(8)
        else:
            calls, names, params = [r.choice("abcdefgh") for _ in range(r.randrange(0, 7))], [r.choice("xyz")], r.randrange(8)
        rows.append((i, calls, names, params))
    sigs = duplicates.signatures(spark.createDataFrame(rows, "doc_id long, calls array<string>, names array<string>, params long"))
    got = {(x.a, x.b): x.similarity for x in duplicates.candidate_pairs(sigs, 64).where("similarity >= 0.8").collect()}
    fp = {x.doc_id: x for x in sigs.collect()}
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    bits = lambda a, b: 1 - ((a ^ b) % 2**64).bit_count() / 64
    first = {}
    for i, c, n, p in rows:
        first.setdefault((tuple(c), tuple(n), p), i)
    want = {}
    for a in first.values():
        for b in first.values():
            x, y = fp[a], fp[b]
            if a < b and abs(x.params - y.params) <= 2 and abs(len(x.calls) - len(y.calls)) <= 3:
                s = jac(x.calls, y.calls) * 0.45 + jac(x.names, y.names) * 0.2 + bits(x.params, y.params) * 0.2 + bits(x.state_fp, y.state_fp) * 0.15
                if round(s, 6) >= 0.8:
                    want[a, b] = round(s, 6)
    assert got == want and len(want) > 50


def _near(rows, least, coarse):
    """Pairs of the first rows of equal signatures, by comparing all of them."""
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
    fnv = lambda xs: __import__("functools").reduce(lambda h, c: ((h ^ c) * 1099511628211) % 2**64, "|".join(sorted(xs)).encode(), 14695981039346656037)
    first = {}
    for i, c, n, p in rows:
        first.setdefault((tuple(sorted(c)), tuple(sorted(n)), p), i)
    out = {}
    for (ca, na, pa), a in first.items():
        for (cb, nb, pb), b in first.items():
            if a < b and (not coarse or abs(pa - pb) <= 2 and abs(len(ca) - len(cb)) <= 3):
                s = jac(ca, cb) * 0.45 + jac(na, nb) * 0.2 + (1 - (pa ^ pb).bit_count() / 64) * 0.2 + (1 - (fnv(na) ^ fnv(nb)).bit_count() / 64) * 0.15
                if round(s, 6) >= least:
                    out[a, b] = round(s, 6)
    return out


def test_near_pairs_of_any_size(spark):
    import random

    r = random.Random(3)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 4000}"
    rows = [(0, [], [], 1), (1, [], [], 2), (2, [], ["A"], 1), (3, [], ["A", "B"], 1), (4, ["x"], ["A|B"], 1), (5, ["x"], ["A", "B"], 1), (6, ["x"], [], 1), (7, ["y"], [], 1)]
    for i in range(8, 200):
        if len(rows) > 20 and r.random() < 0.7:  # a copy without some of its calls, sometimes with another name
            _, c, n, p = r.choice(rows)
            c = [x for x in c if r.random() < r.choice([0.7, 0.95, 1])] + [word() for _ in range(r.randrange(3))]
            n = n + ["N" + word()] if r.random() < 0.3 else n
            rows.append((i, sorted(set(c)), sorted(set(n)), p if r.random() < 0.7 else r.randrange(8)))
        else:
            rows.append((i, sorted({word() for _ in range(r.choice([1, 3, 10, 60]))}), sorted({"N" + word() for _ in range(r.randrange(6))}), r.randrange(8)))
    sigs = duplicates.signatures(spark.createDataFrame(rows, "doc_id long, calls array<string>, names array<string>, params long"))
    for coarse, least in ((False, 0.8), (True, 0.8), (False, 0.9)):
        got = {(x.a, x.b): x.similarity for x in duplicates.candidate_pairs(sigs, 64, least, coarse).collect()}
        want = _near(rows, least, coarse)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)  # Python rounds halves to even
    far = [k for k in _near(rows, 0.8, False) if k not in _near(rows, 0.8, True)]
    assert len(far) > 20  # pairs that the coarse filter would leave out


def test_containment_without_pairs(spark):
    import random

    from codeframe.operators import metrics

    r = random.Random(5)
    rows = [(f"h{i % 380}", r.choice("fg"), s, s + r.randrange(40), r.randrange(9)) for i, s in enumerate(r.choice([-3, 0, 5, 77, 1000]) + r.randrange(60) for _ in range(400))]
    want = {}
    for h, f, s, e, _ in rows:
        for h2, f2, s2, e2, c in rows:
            if f == f2 and h != h2 and s2 >= s and e2 <= e:
                n, w = want.get(h, (0, 0))
                want[h] = n + 1, w + c
    got = metrics.contained(spark.createDataFrame(rows, "hash string, file string, start_line long, end_line long, cognitive long"))
    assert {x.hash: (x.inner_symbols, x.inner_complexity) for x in got.collect()} == want and len(want) > 200
    assert not [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "<=" in x and "(hash" not in x]


def test_innermost_equals_brute_force(spark):
    import random

    r = random.Random(6)
    spans = [(f"h{i}", r.choice("fg"), s, s + r.randrange(-2, 70)) for i, s in enumerate(r.randrange(-5, 300) for _ in range(300))]
    points = sorted({(r.choice("fgx"), r.randrange(-8, 380)) for _ in range(300)})
    want = {}
    for f, line in points:
        over = [(e - s, s, h) for h, g, s, e in spans if f == g and s <= line <= e]
        if over:
            want[f, line] = min(over)[2]
    got = search.innermost(spark.createDataFrame(points, "file string, line long"), spark.createDataFrame(spans, "hash string, file string, start_line long, end_line long"), "file")
    assert {(x.file, x.line): x.hash for x in got.collect()} == want and len(want) > 150
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_classes_shuffle_no_sets(spark):
    rows = [(1, ["a", "b"], [], 1), (2, ["a"], ["b"], 1), (3, ["a", "b"], [], 1), (4, ["ab"], [], 1), (5, None, [], 1), (6, None, [], 1), (7, ["a", "b"], [], None)]
    sigs = spark.createDataFrame(rows, "doc_id long, calls array<string>, names array<string>, params long")
    got = duplicates.classes(sigs)
    assert sorted((x.doc_id, x.class_id, x.copies) for x in got.collect()) == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1)]
    assert sorted(map(tuple, duplicates.class_sizes(sigs).collect())) == [(1, 2), (2, 1), (4, 1)]
    assert all("calls" not in x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


def test_tokens_of_texts_in_one_pass(spark):
    t = "Foo_barBaz  \t\t   qux;(x)\n\nHTTPServer 1234567 the \u00c9tat\u00c9tat a12345678901 Foo_barBaz"
    df = spark.createDataFrame([(t,), ("",), (None,), (" ",)], "t string")
    runs = F.regexp_extract_all("t", F.lit(r"[ \t]+|[\n\r{}\[\]():,;\"']|[^ \t\n\r{}\[\]():,;\"']+"), F.lit(0))
    one_run = lambda r: F.when(r.rlike(r"^[ \t]"), F.floor((F.length(r) + 4) / 5).cast("int")).when(r.rlike(r"^[\n\r{}\[\]():,;\"']"), 1).otherwise(text.word_tokens(r))
    slow = F.greatest(F.aggregate(runs, F.lit(0), lambda s, r: s + one_run(r)), F.lit(1))
    rows = df.select(text.count_tokens(F.col("t")).alias("a"), slow.alias("b"), text.lower_terms(F.col("t")).alias("terms")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[0].a > 20
    assert rows[0].terms == ["foo", "barbaz", "qux", "httpserver", "1234567", "\u00e9tat\u00e9tat", "a12345678901"]
    counts = search.term_counts(spark.createDataFrame([("a b a",), ("b",), ("",)], "t string"), F.array_remove(F.split("t", " "), ""))
    assert sorted(map(tuple, counts.collect())) == [("a", 2, 1), ("b", 2, 2)]
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2


def test_cycles_write_no_path_past_the_middle(spark):
    import random
    from itertools import permutations

    r = random.Random(7)
    e = sorted({(str(r.randrange(1, 14)), str(r.randrange(1, 14))) for _ in range(70)})
    have, nodes = set(e), sorted({x for p in e for x in p})
    want = sorted((">".join(c), n) for n in range(2, 6) for c in permutations(nodes, n) if c[0] == min(c) and all((a, b) in have for a, b in zip(c, c[1:] + c[:1], strict=True)))
    asked = []
    real = graph.F.concat
    graph.F.concat = lambda *c: (asked.append(str(c)), real(*c))[1]
    try:
        got = graph.cycles(spark.createDataFrame(e, "caller string, callee string"), 5)
    finally:
        graph.F.concat = real
    assert sorted(map(tuple, got.collect())) == want and {n for _, n in want} == {2, 3, 4, 5}
    assert len([x for x in asked if "path" in x and "root" not in x]) == 1  # paths from the root grow once, to two steps
