"""Small cases with results worked out by hand, or by plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from repovitals.functions import scalars
from repovitals.operators import clones, composite, findings, graph, history, observer, registry, review, text, timeseries
from repovitals.plans import catalog
from repovitals.sources import coverage, readers


def one(df):
    return df.collect()[0].asDict()


def test_cochange_of_three_commits(spark):
    d = lambda n: dt.datetime(2024, 1, n)
    t = spark.createDataFrame([("c1", "a", d(1)), ("c1", "b", d(1)), ("c2", "a", d(2)), ("c2", "b", d(2)), ("c3", "a", d(3))], "sha string, file string, committed_at timestamp")
    got = one(history.cochange_pairs(t))
    assert (got["left_file"], got["right_file"], got["co_change_count"], got["left_touch_count"], got["right_touch_count"]) == ("a", "b", 2, 3, 2)
    assert got["support"] == got["confidence"] == pytest.approx(2 / 3) and got["last_co_changed_at"] == d(2)
    assert history.cochange_pairs(t, widest=1).count() == 0


def test_wide_commits_are_paired_in_blocks(spark, monkeypatch):
    r = random.Random(3)
    t = [(f"c{c}", f"f{f:03}", dt.datetime(2024, 1, 1 + c)) for c in range(6) for f in r.sample(range(60), 3 if c < 3 else 40)]
    frame = spark.createDataFrame(t, "sha string, file string, committed_at timestamp")
    want = {tuple(x) for x in history.cochange_pairs(frame).collect()}
    monkeypatch.setattr(history, "WIDE", 7)
    assert {tuple(x) for x in history.cochange_pairs(frame).collect()} == want and len(want) > 100


def test_renames_and_aliases(spark):
    names = spark.createDataFrame([("a",), ("x",), ("p",)], "file string")
    moves = spark.createDataFrame([("a", "b"), ("b", "c"), ("p", "q"), ("q", "p")], "old string, new string")
    assert {tuple(r) for r in history.follow_renames(names, moves).collect()} == {("a", "c"), ("x", "x"), ("p", "q")}
    long = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(300)] + [("in", "r0"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0")], "old string, new string")
    some = spark.createDataFrame([("f0",), ("f123",), ("in",), ("r1",), ("f300",)], "file string")
    assert {tuple(r) for r in history.follow_renames(some, long).collect()} == {("f0", "f300"), ("f123", "f300"), ("in", "r2"), ("r1", "r0"), ("f300", "f300")}
    who = spark.createDataFrame([("Al <a@x>", "Al", "a@x"), ("B <b@x>", "B", "b@x")], "author string, name string, email string")
    alias = spark.createDataFrame([("a@x", "al"), ("Al", "albert")], "alias string, canonical string")
    assert {r["canonical"] for r in history.resolve_aliases(who, alias).collect()} == {"albert", "B <b@x>"}


def test_line_survival(spark):
    added = spark.createDataFrame([("f", 1, "alpha beta gamma"), ("f", 2, "same"), ("f", 3, "gone away now"), ("f", 4, "same"), ("f", 5, " ")], "file string, seq int, text string")
    head = spark.createDataFrame([("f", 1, "same"), ("f", 2, "alpha beta gammo"), ("g", 1, "x")], "file string, seq int, text string")
    assert tuple(history.fuzzy_survival(added, head).collect()[0]) == ("f", 4, 1, 1)
    assert tuple(history.exact_survival(added, head).collect()[0]) == ("f", 4, 1)


def test_line_survival_takes_all_lines(spark, tmp_path):
    rows = [(1, 0, "user", "gone\nsecond line\n\nthird line here"), (1, 2, "user", "unlike\nthird line hers\nsecond line"), (2, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in catalog.queries()["line_survival_fuzzy"](spark, str(tmp_path)).collect()] == [("user/1", 3, 1, 1)]


def test_scalars(spark):
    df = spark.sql("SELECT timestamp'2024-01-01' a, timestamp'2024-12-30' b")
    got = one(df.select(scalars.iso_week_key("a").alias("a"), scalars.iso_week_key("b").alias("b"), scalars.week_end("a").alias("e"), scalars.soft_gate(F.lit(2.0), 2, 0.5).alias("g"), scalars.half_life(F.lit(14.0), F.lit(14)).alias("h"), scalars.glob_match(F.lit("src/a/b.ts"), ["src/**"]).alias("m"), scalars.glob_match(F.lit("src/a/b.ts"), ["src/*.ts"]).alias("n"), scalars.entropy(F.lit("aabb")).alias("t"), scalars.non_blank_lines(F.lit("a\n \nb")).alias("l")))
    assert got["a"] == got["b"] == "2024-W01" and got["e"] == dt.datetime(2024, 1, 7, 23, 59, 59, 999000)
    assert (got["g"], got["h"], got["m"], got["n"], got["t"], got["l"]) == (0.5, 0.5, True, False, 1.0, 2)
    assert [r[0] for r in spark.createDataFrame([(x,) for x in ("fooBar", "FooBar", "foo_bar", "foo-bar", "FOO_BAR", "foo")], "n string").select(scalars.casing("n")).collect()] == ["camelCase", "PascalCase", "snake_case", "kebab-case", "UPPER_SNAKE_CASE", "camelCase"]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src int, dst int")
    assert {tuple(r) for r in graph.cycles(edges).collect()} == {(1, 3, 1, 2), (5, 1, 5, 5)}
    assert {tuple(r) for r in graph.reach(edges).collect()} == {(1, 3, 2), (2, 3, 2), (3, 3, 2), (4, 0, 3), (5, 0, 0)}
    assert {tuple(r) for r in graph.depths(edges).collect()} == {(1, 3, True), (2, 3, True), (3, 3, True), (4, 0, False), (5, 1, True)}
    starts = spark.createDataFrame([(1,)], "node int")
    assert {tuple(r) for r in graph.chains(starts, edges).collect()} == {(1, 3, 2, True), (1, 4, 3, False)}
    assert {r[0] for r in graph.spread(spark.createDataFrame([(4,)], "node int"), edges).collect()} == {1, 2, 3, 4}
    exact = {r["node"]: r["reach"] for r in graph.reach(edges).collect()}
    assert {r["node"]: r["reach"] for r in graph.sketches(edges).collect()} == exact


def test_long_chains_and_reach_have_no_last_round(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(36)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)], "src int, dst int")
    starts = spark.createDataFrame([(25,), (100,)], "node int")
    assert {tuple(r) for r in graph.chains(starts, edges).collect()} == {(25, 36, 11, False), (100, 108, 8, True)}
    assert {r["node"]: r["reach"] for r in graph.sketches(edges).collect()}[0] == 36


def test_drift_equals_a_plain_loop(spark):
    r = random.Random(7)
    rows, want = [], {}
    for s in range(12):
        scores = [round(r.random(), 3) for _ in range(r.randrange(1, 30))]
        rows += [(s, i, x) for i, x in enumerate(scores)]
        top, anchor, sums = None, None, {}
        for i, x in enumerate(scores):
            if top is None or x >= top:
                top, anchor, sums = x, None, {}
            else:
                if x < scores[i - 1]:
                    anchor = i
                sums[anchor] = sums.get(anchor, 0) + top - x
        want |= {(s, a): round(v, 9) for a, v in sums.items()}
    got = {(x["series"], x["anchor"]): x["deficit"] for x in timeseries.drift(spark.createDataFrame(rows, "series int, idx int, score double")).collect()}
    assert got == pytest.approx(want)


def test_append_is_idempotent(spark):
    store = spark.createDataFrame([("a", ["a"]), ("w", ["b", "c"])], "sha string, commit_shas array<string>")
    new = spark.createDataFrame([("a",), ("b",), ("d",), ("d",)], "sha string")
    assert [r[0] for r in timeseries.append(store, new).collect()] == ["d"]
    assert timeseries.at_sha(store, "c").first()["sha"] == "w"


def test_adaptive_sampling_finds_a_step():
    asked = []

    def score(places):
        asked.extend(places)
        return [1.0 if p < 777 else 0.0 for p in places]

    got = timeseries.adaptive_indexes(score, 2048)
    assert 776 in got and 777 in got and len(got) < 257 and sorted(asked) == got


def test_observer_groups_and_gates(spark):
    cols = "category string, signal_id string, score double, tier double, weight double, confidence double, grp string, applicability string, authority boolean, provider boolean"
    row = lambda i, s, g="typescript", a="applicable", auth=False, c="review-pain", p=False: (c, i, s, 1.0, 1.0, 1.0, g, a, auth, p)
    df = spark.createDataFrame([row("t1", 1.0), row("t2", 0.0), row("r1", 1.0, "rust"), row("p", 0.0, p=True), row("n", 0.0, a="not_applicable"), row("e", 0.0, a="insufficient_evidence", c="security-risk")], cols)
    assert one(observer.group_mean(df))["mean"] == 0.75
    got = {r["category"]: r["score"] for r in observer.categories(df).collect()}
    assert got["security-risk"] == 1.0 and got["review-pain"] == pytest.approx(1 - (1 / 3) ** 0.25)
    assert one(observer.readiness(df, gate_failed=True))["status"] == "blocked"
    tied = spark.createDataFrame([row("b", 0.5), row("a", 0.5, c="security-risk"), row("c", 0.5, c="architectural-drift")], cols)
    assert one(observer.minimum_dimension(tied, registry.CATEGORIES))["signal_id"] == "c"
    assert one(observer.categories(spark.createDataFrame([row("x", 0.0, auth=True)], cols)))["poison"] == 1.0
    assert [x[0] for x in spark.range(1).select(observer.ceiling(F.lit(1.5), F.lit("structural")), ).collect()] == [[]]


def test_baseline_and_scope(spark):
    f = "signal_id string, hash string, file string, line int, severity string"
    base = spark.createDataFrame([("s", "h1", "f", 1, "warn"), ("s", "h2", "f", 2, "warn")], f)
    head = spark.createDataFrame([("s", "h1", "f", 1, "warn"), ("s", "h3", "f", 9, "block"), ("s", "h4", "g", None, "warn")], f)
    assert {(r["hash"], r["state"]) for r in review.compare(base, head).collect()} == {("h1", "tolerated"), ("h2", "paid"), ("h3", "new"), ("h4", "new")}
    assert one(review.ratchet(base, head))["verdict"] == "fail" and one(review.diff_gate(review.introduced(base, head), ["s"]))["verdict"] == "block"
    hunks = spark.createDataFrame([("f", 5, 200), ("g", 1, 1)], "file string, new_start int, new_lines int")
    assert {r["hash"] for r in review.in_scope(head, hunks).collect()} == {"h3", "h4"}
    specs = spark.createDataFrame([("lib/*",), ("x",)], "pattern string")
    assert {tuple(r) for r in review.imports_match(spark.createDataFrame([("lib/a",), ("lib",), ("library",), ("x",)], "specifier string"), specs).collect()} == {("lib/a", "lib/*"), ("lib", "lib/*"), ("x", "x")}


def test_text(spark):
    diff = spark.createDataFrame([("f", 1, "@@ -1 +2,3 @@ x"), ("f", 2, "+y")], "file string, line_no int, line string")
    assert tuple(text.hunks(diff).collect()[0]) == ("f", 1, 1, 2, 3)
    lines = [("f", 1, "  // repo-allow T-1 until:2024-01-01 why not "), ("f", 2, "// repo-allow T-2"), ("f", 3, "// repo-allow T-3 until:soon x"), ("f", 4, "x() // repo-allow T-4 until:2030-01-01 y"), ("f", 5, "//repo-allow T-5 until:2024-01-01T11:00:00Z z")]
    found = text.bypasses(spark.createDataFrame(lines, "file string, line_no int, line string"), "2024-01-01 23:59:59.500").sort("line_no").collect()
    assert [(r["ticket"], r["reason"], r["expired"]) for r in found] == [("T-1", "why not", False), ("T-3", "x", True), ("T-5", "z", True)]
    names = spark.createDataFrame([("userId", ["user", "id"]), ("idUser", ["id", "user"]), ("usrId", ["usr", "id"]), ("other", ["other"])], "name string, tokens array<string>")
    known = spark.createDataFrame([(["user", "id"],)], "tokens array<string>")
    assert {r["name"]: r["class"] for r in text.term_classes(names, known).collect()} == {"userId": "match", "idUser": "duplicate", "usrId": "conflict", "other": "new"}
    ids = spark.createDataFrame([("apiKey", "AKIA" + "A" * 16), ("secret_token", "q8Zr71xPw0LmVt5c"), ("color", "q8Zr71xPw0LmVt5c"), ("token", "aaaaaaaaaaaaaaaaaaaa")], "name string, value string")
    assert {(r["name"], r["severity"]) for r in text.secrets(ids).collect()} == {("apiKey", "block"), ("secret_token", "warn")}
    assert one(spark.createDataFrame([("src/__tests__/a.test.ts",)], "p string").select(text.taxonomy(F.col("p")).alias("t")))["t"] == ["test"]


def test_composites(spark):
    facts = spark.createDataFrame([("a", 50, 10, 5.0, None, None, 0.5), ("b", 1, 0, 0.1, None, None, None)], "file string, complexity int, churn int, weighted double, ownership double, coverage double, cochange double")
    got = composite.risks(facts).collect()
    assert [r["file"] for r in got] == ["a"] and 0 < got[0]["risk"] < 1
    row = spark.createDataFrame([(0.5, None)], "x double, y double")
    assert one(composite.composite(row, {"x": (F.col("x"), 2, True), "y": (F.col("y"), 1, False)}))["score"] == 0.5
    assert one(composite.composite(row, {"y": (F.col("y"), 1, True)}))["score_missing_required"] is True
    f = spark.createDataFrame([(*[0.5] * 3, *[None] * 5)], ", ".join(f"{k} double" for k in composite.THEORY))
    assert one(composite.theory_index(f)) == {"score": 0.5, "available": 0.49, "applicability": "applicable"}
    breach = spark.createDataFrame([("a", 1.0, None, 3.0, None)], "file string, parser double, unsafe double, violations double, drift double")
    assert one(composite.trust_breach(breach))["score"] == 0.0


def test_nested_clones(spark):
    g = spark.createDataFrame([("in", "f", 2, 3), ("in", "g", 12, 13), ("out", "f", 1, 5), ("out", "g", 10, 20), ("free", "f", 2, 3), ("free", "h", 1, 2)], "hash string, file string, start int, end int")
    assert [r[0] for r in clones.nested(g).collect()] == ["in"]


def test_finding_formulas(spark):
    facts = spark.createDataFrame([("parameter", True, 2), ("unknown", False, 4)], "kind string, boundary boolean, n long")
    got = one(findings.score(facts, "TS-LD-07", 1.0))
    assert got["weighted"] == 16.0 and got["score"] == pytest.approx(1 / (1 + max(16 / 10, 12 / 48)))
    states = findings.contract_states(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "artifact string, source_hash string"), spark.createDataFrame([("a", "1"), ("b", "0"), ("d", "1")], "artifact string, built_from string"))
    assert {r["artifact"]: r["state"] for r in states.collect()} == {"a": "fresh", "b": "stale", "c": "missing", "d": "orphan"}
    assert one(findings.freshness_score(states))["score"] == pytest.approx(1 / (1 + 12 / 8))


def test_readers(spark):
    text_of = lambda s: spark.createDataFrame([(s,)], "value string")
    lcov = "SF:a.ts\nDA:1,1\nDA:2,0\nLF:4\nLH:3\nFNDA:2,f\nBRDA:1,0,0,-\nend_of_record\nSF:b.ts\nend_of_record\n"
    got = {r["file"]: r for r in coverage.summary(coverage.read_lcov(text_of(lcov))).collect()}
    assert (got["a.ts"]["lines"]["covered"], got["a.ts"]["lines"]["total"], got["a.ts"]["branches"]["covered"], got["b.ts"]["state"], got["b.ts"]["lines"]["pct"]) == (3, 4, 0, "zero", 1.0)
    istanbul = coverage.read_istanbul(text_of('{"a": {"s": {"0": 1, "1": 0}, "f": {}, "b": {"0": [1, 0]}}}')).collect()[0]
    assert (istanbul["lines"]["covered"], istanbul["functions"]["pct"], istanbul["branches"]["total"]) == (1, 1.0, 2)
    npm = readers.npm_lock(text_of('{"packages": {"": {"dependencies": {"x": "1"}}, "node_modules/x": {"version": "1.0"}, "node_modules/x/node_modules/y": {"version": "2.0"}}}'))
    assert {(r["name"], r["version"], r["direct"], tuple(r["chain"])) for r in npm.collect()} == {("x", "1.0", True, ("x",)), ("y", "2.0", False, ("x", "y"))}
    cargo = readers.cargo_lock(text_of('[[package]]\nname = "a"\nversion = "1"\ndependencies = [\n "b 2",\n "c",\n]\n\n[[package]]\nname = "b"\nversion = "2"\n'))
    assert {(r["name"], r["version"], tuple(r["dependencies"])) for r in cargo.collect()} == {("a", "1", ("b", "c")), ("b", "2", ())}
    told = lambda df: {(r["name"], r["version"], r["direct"], tuple(r["chain"] or ())) for r in df.collect()}
    bun = '{"workspaces": {"": {"dependencies": {"x": "1"}, "devDependencies": {"d": "1"},},}, "packages": {"x": ["x@1.0.0", "", {"dependencies": {"@s/y": "2", "z": "1"}}, "h"], "@s/y": ["@s/y@2.0.0", "", {}, "h"], "z": ["z@2.0.0", ""], "x/z": ["z@1.0.0", ""], "d": ["d@1.0.0", "", {"dependencies": {"z": "2"}}], "free": ["free@0.1.0", ""],}}'
    assert told(readers.bun_lock(text_of(bun))) == {("x", "1.0.0", True, ("x",)), ("d", "1.0.0", True, ("d",)), ("@s/y", "2.0.0", False, ("x", "@s/y")), ("z", "1.0.0", False, ("x", "z")), ("z", "2.0.0", False, ("d", "z")), ("free", "0.1.0", False, ())}
    pnpm = "lockfileVersion: '9.0'\n\nimporters:\n\n  .:\n    dependencies:\n      x:\n        specifier: ^1\n        version: 1.0.0\n    devDependencies:\n      '@s/y':\n        specifier: ^2\n        version: 2.0.0(x@1.0.0)\n\npackages:\n\n  x@1.0.0:\n    resolution: {integrity: a}\n  '@s/y@2.0.0':\n    resolution: {integrity: b}\n  z@3.1.0:\n    resolution: {integrity: c}\n\nsnapshots:\n\n  x@1.0.0:\n    dependencies:\n      z: 3.1.0\n  '@s/y@2.0.0(x@1.0.0)':\n    dependencies:\n      z: 3.1.0\n  z@3.1.0: {}\n"
    assert told(readers.pnpm_lock(text_of(pnpm))) == {("x", "1.0.0", True, ("x",)), ("@s/y", "2.0.0", True, ("@s/y",)), ("z", "3.1.0", False, ("@s/y", "z"))}
    found, edges = readers.cargo_metadata(text_of('{"packages": [{"id": "a 1", "name": "a", "version": "1"}, {"id": "b 2", "name": "b", "version": "2"}], "workspace_members": ["a 1"], "resolve": {"nodes": [{"id": "a 1", "dependencies": ["b 2"]}]}}'))
    assert {(r["name"], r["member"]) for r in found.collect()} == {("a", True), ("b", False)} and [tuple(r) for r in edges.collect()] == [("a 1", "b 2")]
    log = readers.git_log(text_of("\x01s1\t2024-01-01T00:00:00Z\tAl\n\n3\t1\ta.ts\n-\t-\tb.png\n\x01s2\t2024-01-02T00:00:00Z\tBo\n\n1\t0\ta.ts\n"))
    assert {(r["sha"], r["author"], r["file"], r["added"]) for r in log.collect()} == {("s1", "Al", "a.ts", 3), ("s1", "Al", "b.png", None), ("s2", "Bo", "a.ts", 1)}


def test_registry(spark):
    score = lambda x: lambda facts, cfg, given: spark.range(1).select(F.lit(x).alias("score"))
    s = lambda i, inputs=(), **k: registry.Signal(i, "review-pain", 1.0, "legibility", score(0.5), tuple(inputs), **k)
    r = registry.Registry([s("TS-B", ["A1"]), s("A", aliases=("A1",)), s("RS-C", optional=("missing",), defaults={"n": 1})])
    assert r.order == ["A", "RS-C", "TS-B"] and r.ancestors("TS-B") == ["A", "TS-B"]
    out = registry.run(r, {}, registry.Vector(active={"RS-C": False}))
    assert list(out) == ["A", "TS-B"] and registry.results(r, out).count() == 2
    bad = registry.Signal("BAD", "review-pain", 1.0, "legibility", lambda f, c, g: f["none"].select("x"))
    told = registry.Registry([s("A"), bad, s("N", needs=("absent",))])
    assert {(x["signal_id"], x["score"], x["applicability"]) for x in registry.results(told, registry.run(told, {})).collect()} == {("A", 0.5, "applicable"), ("BAD", 0.0, "failed")}
    for bad in ([s("A"), s("A")], [s("A", ["B"])], [s("A", ["B"]), s("B", ["A"])], [s("A"), s("B", ["A"]), s("C", ["B"]), s("D", ["C"])]):
        with pytest.raises(registry.RegistryError):
            registry.Registry(bad)
    for bad in (registry.Vector(weight={"A": 3}), registry.Vector(config={"RS-C": {"x": 1}}), registry.Vector(active={"zzz": True})):
        with pytest.raises(registry.RegistryError):
            bad.checked(r)
    policies = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "key string, value double")
    got = registry.processed(policies, [("double", lambda d: d.where("key = 'a'").withColumn("value", F.col("value") * 2))]).collect()
    assert {(x["key"], x["value"], tuple(x["decisions"])) for x in got} == {("a", 2.0, ("double",)), ("b", 2.0, ())}


def test_stream_rolls_up_weeks(spark, tmp_path):
    from repovitals.streaming import observations as st

    t = lambda day, h=0: dt.datetime(2024, 1, day, h)
    rows = [("a", t(1), "c", 0.5), ("a", t(1), "c", 0.5), ("b", t(2), "c", 1.0), ("z", dt.datetime(2024, 6, 1), "c", 0.0)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, st.SCHEMA).coalesce(1).write.parquet(src)
    st.append_to(st.once(st.source(spark, src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    q = st.weekly(st.source(spark, str(tmp_path / "out"), st.SCHEMA)).writeStream.format("memory").queryName("weeks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("SELECT category, week_start, score, samples FROM weeks").collect()] == [("c", t(1), 0.75, 2)]
