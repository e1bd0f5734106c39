"""Formulas with expected values worked out by hand from their definitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from repovitals.operators import builtin, clones, elicitation, findings, graph, history, observer, packages, registry, review, text, timeseries
from repovitals.sources import readers


def one(df):
    return df.collect()[0].asDict()


SAMPLES = "id string, outcome string, confidence double, signal string, score double"


def test_pairwise_preference_multiplies_confidences(spark):
    rows = [("a", "accepted", 1.0, "s", 0.9), ("a", "accepted", 1.0, "t", 0.2), ("b", "reverted", 0.5, "s", 0.4), ("b", "reverted", 0.5, "t", 0.21), ("c", "revised", 0.8, "s", 0.97)]
    got = {r["signal"]: r for r in review.pairwise_preference(spark.createDataFrame(rows, SAMPLES)).collect()}
    # s: 0.5 * 0.5 against b; against c -0.07 * 0.8. t: -0.01 against b is ignored; against c, which has no t, 0.2 * 0.8.
    signed, magnitude = 0.5 * 0.5 - 0.07 * 0.8, 0.5 * 0.5 + 0.07 * 0.8
    assert got["s"]["signed"] == pytest.approx(signed) and got["s"]["weight"] == round(1 + 0.6 * signed / magnitude, 2)
    assert got["t"]["signed"] == pytest.approx(0.16) and got["t"]["weight"] == 1.6 and got["t"]["support"] == 1.0
    prior = spark.createDataFrame([("s", 1.9)], "signal string, prior double")
    assert {r["signal"]: r["weight"] for r in review.pairwise_preference(spark.createDataFrame(rows, SAMPLES), prior).collect()}["s"] == 2.0


def test_frequency_and_prior_adjusted_preference(spark):
    rows = [("a", "accepted", 0.5, "s", 0.8), ("b", "revised", 1.0, "s", 0.9), ("c", "accepted", 1.0, "t", 0.3)]
    frame = spark.createDataFrame(rows, SAMPLES)
    got = {r["signal"]: (r["signed"], r["weight"]) for r in review.frequency_preference(frame).collect()}
    assert got["s"] == (pytest.approx(0.2 - 0.9), 0.55) and got["t"] == (pytest.approx(0.15), 1.45)
    pair = {r["signal"]: r["weight"] for r in review.pairwise_preference(frame).collect()}
    adjusted = {r["signal"]: r["weight"] for r in review.prior_adjusted_preference(frame).collect()}
    assert adjusted == pytest.approx({k: 1 + (w - 1) * 3 / 24 for k, w in pair.items()}, abs=0.0051)


def test_pull_request_size(spark):
    lines = spark.createDataFrame([(x,) for x in (100, 200, 300, 400, 500, 600, 5000)], "n int")
    got = [r[0] for r in lines.select(findings.pr_size_score(F.col("n"), F.lit(0.0), F.lit(0.0))).collect()]
    assert got == pytest.approx([1, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4])
    assert one(lines.limit(1).select(findings.pr_size_score(F.lit(5000), F.lit(3.0), F.lit(1.0)).alias("s")))["s"] == 0


def test_missing_dependencies_weigh_by_use(spark):
    declared = spark.createDataFrame([("p", "a", False), ("p", "b", True), ("p", "idle", False)], "owner string, name string, dev boolean")
    used = spark.createDataFrame([("p", "a", "runtime", False), ("p", "b", "runtime", False), ("p", "m1", "type-only", False), ("p", "m2", "dynamic", False), ("q", "m3", "runtime", True), ("q", "m4", "runtime", False), ("p", "t", "runtime", False)], "owner string, name string, usage string, private boolean")
    reached = spark.createDataFrame([("p", "t")], "owner string, name string")
    found = packages.health(declared, used, reached)
    assert {(r["name"], r["problem"], r["weight"]) for r in found.collect()} == {("b", "dev-in-prod", 1.0), ("idle", "unused", 1.0), ("m1", "missing", 0.2), ("m2", "missing", 0.45), ("m3", "missing", 0.45), ("m4", "missing", 1.0), ("t", "transitive", 1.0)}
    assert one(packages.health_score(found, 100, 10))["score"] == pytest.approx(1 - (2.1 / 10 * 1.25 + 1 / 5000 + 2 / 2000))


def test_goodhart_suspicion(spark):
    ids = [f"s{i}" for i in range(5)]
    when = lambda n: dt.datetime(2024, 3, 10 + n)
    latest = spark.createDataFrame([(i, int(when(5).timestamp() * 1000) // (7 * 86_400_000)) for i in ids], "id string, slot long")
    hidden = {r["id"] for r in timeseries.hidden_signals(latest).collect()}
    assert len(hidden) == 1
    make = lambda score: spark.createDataFrame([(f"c{n}", when(n), i, score(n, i in hidden)) for n in range(6) for i in ids], "sha string, ts timestamp, id string, score double")
    flat = one(timeseries.goodhart(make(lambda n, h: 0.5)))
    assert (flat["suspicion"], flat["gap"], flat["points"]) == ("low", 0.0, 6)
    wide = one(timeseries.goodhart(make(lambda n, h: 0.5 if h else 0.6)))
    assert (wide["suspicion"], wide["gap"], wide["velocity"]) == ("elevated", pytest.approx(0.1), 0.0)
    both = one(timeseries.goodhart(make(lambda n, h: 0.5 if h else 0.5 + 0.05 * n)))
    assert (both["suspicion"], both["velocity"]) == ("high", pytest.approx(0.25))
    few = make(lambda n, h: 0.5 if h else 0.45 + 0.015 * n).where("sha IN ('c0', 'c4', 'c5')")
    assert one(timeseries.goodhart(few))["suspicion"] == "low"


def test_overall_backpressure(spark):
    levels = lambda *x: spark.createDataFrame([(v,) for v in x], "level string")
    latest = lambda gate="pass", least=0.9, ready="green": spark.createDataFrame([(gate, least, ready)], "hard_gate_status string, minimum double, readiness_status string")
    level = lambda *a, **k: one(timeseries.overall_level(*a, **k))["level"]
    assert level(levels("green", "yellow"), latest()) == "yellow"
    assert level(levels("green"), latest("fail")) == "red" == level(levels("green"), latest(least=0.39)) == level(levels("green"), latest(), "high")
    assert level(levels("green"), latest(), "elevated") == "yellow" and level(levels("green"), latest(ready="red")) == "red"
    assert level(levels(), latest()) == "unavailable"


def test_trend_beyond_a_thousand_rows_an_instant(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("c", t, f"a{i:05}", 0.0) for i in range(1500)] + [("c", t + dt.timedelta(days=1), f"b{i:05}", 1.0) for i in range(1500)]
    got = {r["sha"]: r["slope"] for r in timeseries.trend(spark.createDataFrame(rows, "category string, ts timestamp, sha string, score double")).collect()}
    assert got["a01499"] is None and got["b00000"] == 1.0 and got["b01100"] == 1.0 and got["b01499"] == 1.0


def test_trend_leaves_old_rows_out(spark):
    r = random.Random(4)
    t = dt.datetime(2024, 1, 1)
    rows = sorted((t + dt.timedelta(hours=r.randrange(24 * 60)), f"{i:03}", round(r.random(), 3)) for i in range(200))
    got = {x["sha"]: x["slope"] for x in timeseries.trend(spark.createDataFrame([("c", *x) for x in rows], "category string, ts timestamp, sha string, score double")).collect()}
    for n, (at, sha, _) in enumerate(rows):
        some = [((b - at).total_seconds() / 86400, s) for b, _, s in rows[: n + 1] if b >= at - dt.timedelta(days=14)]
        mx, my = (sum(v) / len(some) for v in zip(*some, strict=True))
        sxx = sum((x - mx) ** 2 for x, _ in some)
        want = sum((x - mx) * (y - my) for x, y in some) / sxx if sxx else None
        assert (got[sha] is None) == (want is None) and (want is None or abs(got[sha] - want) < 1e-6)


def test_compaction_merges_late_entries(spark):
    columns = "sha string, ts timestamp, source string, weighted_mean double, hard_gate_status string, readiness double, pressure double, pnorm double, local_max double, status string, band string, samples long, commit_shas array<string>"
    row = lambda sha, ts, mean, gate="pass", status="green", most=0.1: (sha, ts, "raw", mean, gate, mean, 1 - mean, 0.1, most, status, status, 1, None)
    old = [row("a", dt.datetime(2024, 1, 1), 0.8), row("b", dt.datetime(2024, 1, 2), 0.6, "fail", "red", 0.7), row("z", dt.datetime(2024, 6, 1), 1.0)]
    first = timeseries.compact(spark.createDataFrame(old, columns))
    late = spark.createDataFrame([row("c", dt.datetime(2024, 1, 4), 0.1, status="yellow")], columns)
    for store, shas, mean in ((first, ["a", "b"], 0.7), (timeseries.compact(first.unionByName(late)), ["a", "b", "c"], 0.5)):
        got = {r["sha"]: r for r in store.collect()}
        week = got["aggregate:2024-W01"]
        assert set(got) == {"z", "aggregate:2024-W01"} and week["commit_shas"] == shas and week["samples"] == len(shas)
        assert week["weighted_mean"] == pytest.approx(mean) and (week["hard_gate_status"], week["status"], week["local_max"]) == ("fail", "red", 0.7)
        assert week["ts"] == dt.datetime(2024, 1, 7, 23, 59, 59, 999000)


def test_conventions(spark):
    names = [("function", "fooBar"), ("function", "foo_bar"), ("function", "x y"), ("class", "a b"), ("const", "FOO_X"), ("const", "foo"), ("const", "k-b"), ("type", "Foo"), ("type", "foo_x")]
    got = {r["kind"]: (r["convention"], r["n"]) for r in text.conventions(spark.createDataFrame(names, "kind string, name string")).collect()}
    assert got == {"function": ("camelCase", 1), "class": ("PascalCase", 0), "const": ("camelCase | UPPER_SNAKE_CASE | kebab-case", 3), "type": ("PascalCase", 1)}
    wanted = spark.createDataFrame([("const", "camelCase | UPPER_SNAKE_CASE"), ("function", "camelCase")], "kind string, convention string")
    assert one(text.naming_score(spark.createDataFrame(names, "kind string, name string"), wanted)) == {"total": 6, "violations": 3, "score": 0.5}
    words = text.terms(spark.createDataFrame([("HTTPServerV2_userId-2",)], "name string"))
    assert [r["term"] for r in words.collect()] == ["http", "server", "v2", "user", "id"]


def test_requests_stop_at_the_first_item_over_budget(spark):
    rows = [("r", 1, "informational", "slow", ["aaaa", "b" * 40]), ("r", 2, "block", "slow", ["aaaa", "c"]), ("r", 3, "required", "wide", None), ("s", 1, "required", "x", ["k"])]
    got = {x["reviewer"]: x for x in review.merge_requests(spark.createDataFrame(rows, "reviewer string, nth int, priority string, reason string, context array<string>"), 30).collect()}
    assert (got["r"]["priority"], got["r"]["reason"], got["r"]["context"], got["r"]["cut"]) == ("block", "slow; wide", ["aaaa", review.CUT], True)
    assert (got["s"]["priority"], got["s"]["context"], got["s"]["cut"]) == ("required", ["k"], False)


def test_divergent_clones(spark):
    head = dt.datetime(2024, 3, 1)
    member = lambda h, i, t, days, sha="s", file="a/x.ts", name="f", n=40: (h, i, t, n, head - dt.timedelta(days=days), f"{sha}{i}", file, name)
    rows = [member("g", 1, "t1", 2), member("g", 2, "t2", 200), member("same", 1, "t", 1), member("same", 2, "t", 1), member("old", 1, "t1", 90), member("old", 2, "t2", 90), member("small", 1, "t1", 1, n=29), member("small", 2, "t2", 1, n=29)]
    rows += [member("fam", i, f"t{i}", 1, file=f"p{i}/x.ts") for i in range(3)]
    frame = spark.createDataFrame(rows, "hash string, id int, text_hash string, tokens int, changed_at timestamp, changed_in string, file string, name string")
    found = clones.inconsistent(frame, F.lit(head))
    assert {(r["hash"], r["divergence"], r["confidence"]) for r in found.collect()} == {("g", 1.0, "high"), ("fam", 1.0, "medium")}
    assert one(clones.divergence_score(found, clones.limited(frame)))["score"] == pytest.approx(1 - (0.25 + 0.12 + 0.04 + min(0.06, 0.03 * 0.5849625)), abs=1e-6)
    assert one(clones.limited(frame, most_groups=1)) == {"limit_hit": True, "cap": 0.95}
    assert one(clones.divergence_score(found.limit(0), clones.limited(frame, most_groups=1)))["score"] == 0.95


def test_diff_tells_churn_from_findings(spark):
    f = "signal_id string, hash string, in_scope boolean"
    base = spark.createDataFrame([("s", "h1", True), ("s", "gone", False), ("t", "old", False)], f)
    head = spark.createDataFrame([("s", "h1", True), ("s", "new", False), ("s", "mine", True), ("t", "t1", False), ("u", "u1", False)], f)
    scores = spark.createDataFrame([("s", 0.5, 0.5), ("t", 0.5, 0.4), ("u", 0.1, 0.1)], "signal_id string, before double, after double")
    assert {(r["hash"], r["change"]) for r in review.diff(base, head, scores).collect()} == {("gone", "resolved"), ("old", "resolved"), ("new", "projection-churn"), ("mine", "introduced"), ("t1", "introduced"), ("u1", "introduced")}


@pytest.mark.parametrize("small", [0, 1000])
def test_strong_components_equal_plain_search(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    r = random.Random(8)
    for n, m in ((12, 18),) if not small else ((12, 18), (30, 36)):
        pairs = {(r.randrange(n), r.randrange(n)) for _ in range(m)} | {(100 + i, 101 + i) for i in range(4)}
        reach = {a: {a} for p in pairs for a in p}
        for _ in reach:
            for a, b in pairs:
                reach[a] |= reach[b]
        frame = spark.createDataFrame(sorted(pairs), "src int, dst int")
        want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach}
        got = graph.strong_components(frame).collect()
        assert {x["node"]: x["component"] for x in got} == want
        counts = {x["node"]: (x["reach"], x["reverse_reach"]) for x in graph.reach(frame).collect()}
        assert counts == {a: (len(reach[a]) - 1, sum(a in v for v in reach.values()) - 1) for a in reach}
        depth = {x["node"]: (x["depth"], x["cyclic"]) for x in graph.depths(frame).collect()}
        members = {c: [a for a in want if want[a] == c] for c in want.values()}

        def longest(c, seen={}):
            if (n, m, c) not in seen:
                own = len(members[c]) if len(members[c]) > 1 else int((c, c) in pairs)
                out = [longest(want[b])[0] + 1 for a, b in pairs if want[a] == c != want[b]]
                beyond = max(out) + (own - 1 if len(members[c]) > 1 else 0) if out else 0
                seen[n, m, c] = max(own, beyond), own > 0 or any(longest(want[b])[1] for a, b in pairs if want[a] == c != want[b])
            return seen[n, m, c]

        assert depth == {a: longest(want[a]) for a in want}


def test_history_readers(spark):
    text_of = lambda s: spark.createDataFrame([(s,)], "value string")
    log = readers.git_commits(text_of("c3\tc2 x1\t2024-01-03T00:00:00Z\tAl\nx1\tc1\t2024-01-02T12:00:00Z\tBo\nc2\tc1\t2024-01-02T00:00:00Z\tAl\nc1\t\t2024-01-01T00:00:00Z\tAl\n"))
    assert one(history.commit_count(log, 90))["commits"] == 3
    assert [r["sha"] for r in history.commit_range(log, "c2", "c3").collect()] == ["x1", "c3"]
    assert {tuple(r) for r in readers.git_renames(text_of("R100\ta\tb\nM\tc\n")).collect()} == {("a", "b")}
    patch = "\x01s1\t2024-01-01T00:00:00Z\n\ndiff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -0,0 +1,2 @@\n+one\n+ \ndiff --git a/g b/g\n--- a/g\n+++ b/g\n@@ -1 +1 @@\n-x\n+two\n"
    assert {(r["file"], r["text"]) for r in readers.git_added_lines(text_of(patch)).collect()} == {("f", "one"), ("g", "two")}
    blame = "\n".join(f"{sha * 40} {n} {n} 1\nauthor A\ncommitter-time {t}\nfilename f\n\tline" for n, sha, t in ((1, "a", 100), (2, "b", 300), (3, "c", 200)))
    blamed = readers.git_blame(spark.createDataFrame([("f", blame)], "file string, value string"))
    places = spark.createDataFrame([(1, "f", 1, 2), (2, "f", 3, 3), (3, "g", 1, 1)], "id int, file string, start int, end int")
    assert {(r["id"], r["changed_in"]) for r in history.last_change(blamed, places).collect()} == {(1, "b" * 40), (2, "c" * 40), (3, None)}
    trees = spark.createDataFrame([("s1", "f", "x")], "sha string, file string, text string")
    assert [r["text"] for r in history.file_at(trees, spark.createDataFrame([("s1", "f"), ("s1", "g")], "sha string, file string")).sort("file").collect()] == ["x", None]
    paths = readers.git_files(text_of("src/a.ts\nsrc/a.test.ts\nb.md\n"))
    assert [r["file"] for r in paths.where(text.included(F.col("file"), [".ts"], ["**/*.test.ts"])).collect()] == ["src/a.ts"]


def test_observation_store_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda *x: spark.createDataFrame([(s, dt.datetime(2024, 1, d), None) for s, d in x], "sha string, ts timestamp, commit_shas array<string>")
    readers.write_observations(rows(("a", 1), ("a", 1), ("b", 2)), path)
    readers.write_observations(rows(("b", 2), ("late", 1)), path)
    assert sorted(r["sha"] for r in spark.read.parquet(path).collect()) == ["a", "b", "late"]
    assert one(readers.observer_json(spark.createDataFrame([(2, 1)], "b int, a int")))["json"] == '{"a":1,"b":2}'
    base = spark.createDataFrame([("s", "h", "f", 1, "d")], "signal_id string, hash string, file string, line int, detail string")
    readers.write_baseline(base, str(tmp_path / "base"))
    assert readers.read_baseline(spark, str(tmp_path / "base")).collect() == base.collect()
    (tmp_path / "g.json").write_text('{"terms": ["x"]}')
    data = readers.reference_data(spark, {"glossary": str(tmp_path / "g.json"), "none": str(tmp_path / "no.json")})
    assert list(data) == ["glossary"] and one(data["glossary"].select(F.variant_get("value", "$.terms[0]", "string").alias("t")))["t"] == "x"


def test_label_facts_and_frameworks(spark):
    fact = lambda c, k: '{"artifact_id": "%s", "classifier": {"id": "c", "version": "1"}, "input": {"scope": "file", "content_hash": "h", "source_paths": ["b", "a"]}, "label": {"kind": "role", "value": "x", "confidence": %s}, "policy": {"enforcement_ceiling": "%s"}}' % (c, k[0], k[1])  # noqa: E731, UP031
    texts = spark.createDataFrame([(fact("one", (0.5, "soft-warning")),), (fact("two", (0.5, "hard-gate")),), (fact("three", (1.5, "informational")),)], "value string")
    got = readers.label_facts(texts).collect()
    assert [r["artifact_id"] for r in got] == ["one"] and got[0]["source_paths"] == ["a", "b"] and len(got[0]["fingerprint"]) == 64
    deps = spark.createDataFrame([("apps/web", "next"), ("apps/x", "convex")], "root string, name string")
    paths = spark.createDataFrame([("apps/web/app/blog/page.tsx",), ("src/page.ts",)], "path string")
    assert {(r["framework"], r["confidence"]) for r in text.frameworks(deps, paths).collect()} == {("nextjs-app-router", "high"), ("convex", "medium")}


def test_quiz_and_suggestions(spark):
    items = [("i1", "a", "x", 1.0), ("i1", "b", "x", 0.4), ("i1", "b", "y", 0.5), ("i2", "a", "x", 0.1), ("i3", "a", "z", 0.9)]
    deltas = elicitation.item_deltas(spark.createDataFrame(items, "item string, side string, signal string, score double"))
    responses = spark.createDataFrame([("i1", "b"), ("i2", "skip")], "item string, answer string")
    got = {r["signal"]: (r["seen"], r["evidence"], r["magnitude"]) for r in elicitation.inference(deltas, responses).collect()}
    assert got == {"x": (1, pytest.approx(-0.6), pytest.approx(0.6)), "y": (1, pytest.approx(0.5), pytest.approx(0.5))}
    assert one(elicitation.next_item(deltas, responses)) == {"item": "i3", "gain": pytest.approx(0.9 * 2 + 0.25)}
    weights = {r["signal"]: r["weight"] for r in elicitation.quiz_weights(elicitation.inference(deltas, responses)).collect()}
    assert weights == {"x": 0.83, "y": 1.17}
    scores = lambda *x: spark.createDataFrame(list(x), "signal string, score double")
    proposed = elicitation.passive_proposal(scores(("x", 0.2), ("y", 0.5), ("z", 0.5)), scores(("x", 0.9), ("y", 0.75), ("z", 0.6)))
    assert [(r["signal"], r["weight"]) for r in proposed.collect()] == [("x", 1.25), ("y", 1.13)]
    told = elicitation.suggestions(spark.createDataFrame([("vector", "canonical"), ("glossary", "draft")], "part string, state string"))
    assert {(r["part"], r["state"]) for r in told.collect()} == {("glossary", "draft"), ("conventions", "missing"), ("baseline", "missing"), ("project-modules", "missing")}


def test_builtin_signals(spark):
    known = builtin.registry()
    assert known.resolve("TS-SL-02").id == "TS-SL-02-inconsistent-clones" and len(known.order) == len(builtin.CATALOG)
    for name, preset in registry.PRESETS.items():
        assert preset.checked(known).weight, name
    entries = registry.ledger(known, registry.PRESETS["ai-slop-defense"], {"TS-LD-01": {"max_complexity": 30}, "TS-LD-02": {"file_loc": 500}})
    told = {(i.split("-")[1] + i.split("-")[2], name): (value, source) for i, name, _, value, source in entries if i.startswith("TS-LD")}
    assert told["LD01", "config.max_complexity"] == (15, "vector") and told["LD02", "config.file_loc"] == (500, "module") and told["LD02", "config.function_loc"] == (50, "signal-default")
    files = spark.createDataFrame([("f", "p", 30, 10)], "file string, package string, complexity int, loc int")
    counts = spark.createDataFrame([("TS-CC-01", "floating", False, 5), ("RS-SL-02", "justified", False, 5)], "signal_id string, kind string, boundary boolean, n long")
    sizes = spark.createDataFrame([("TS-CC-01", 1.0), ("RS-SL-02", 1.0), ("TS-LD-03", 0.0)], "signal_id string, size double")
    gate = spark.createDataFrame([("TS-LD-01", "block"), ("TS-AD-02", "warn")], "signal_id string, severity string")
    seen = builtin.observe({"files": files, "counts": counts, "sizes": sizes}, gate)
    got = {r["signal_id"].rsplit("-", 9)[0] if False else "-".join(r["signal_id"].split("-")[:3]): (r["score"], r["applicability"]) for r in seen["results"].collect()}
    assert got == {"TS-LD-01": (pytest.approx(1 - max(1.0, 10 / 30)), "applicable"), "TS-CC-01": (0.5, "applicable"), "RS-SL-02": (0.8, "applicable"), "TS-LD-03": (1.0, "applicable")}
    assert one(seen["readiness"])["status"] == "red" and one(seen["minimum"])["signal_id"].startswith("TS-LD-01")
    block = spark.createDataFrame([("TS-AD-02", "block")], "signal_id string, severity string")
    assert one(builtin.observe({"files": files}, block)["readiness"])["status"] == "blocked"
    assert one(observer.top_diagnostics(spark.createDataFrame([("s", "info", "a", 1, "h"), ("s", "block", "z", 9, "h")], "signal_id string, severity string, file string, line int, hash string"), 1))["severity"] == "block"


def test_cargo_tree(spark):
    crates = spark.createDataFrame([("a", "1", True), ("b", "1", True), ("b", "2", False)], "name string, version string, used boolean")
    edges = spark.createDataFrame([("a", "b1"), ("b1", "b2")], "src string, dst string")
    assert one(packages.cargo_tree(crates, edges)) == {"pkgs": 3, "duplicates": 1, "depth": 2, "unused": 1}


def test_streams(spark, tmp_path):
    from repovitals.streaming import observations as st

    t = lambda day: dt.datetime(2024, 1, day)
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([("a", t(1), "c", 0.9), ("b", t(2), "c", 0.5), ("d", t(3), "c", 0.7)], st.SCHEMA).coalesce(1).write.parquet(src)
    rows = spark.createDataFrame([("a", t(1), "c", 0.9), ("x", dt.datetime(2020, 1, 1), "c", 0.1)], st.SCHEMA)
    seen = []
    q = st.drift(st.source(spark, src)).writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in seen] == [("c", 0.9, 0.7, pytest.approx(0.6))]
    told = []
    st.notify(st.source(spark, src), lambda b, n: told.append(b.count()), str(tmp_path / "c2")).awaitTermination()
    assert sum(told) == 3
    shaped = lambda: st.source(spark, src).withColumn("commit_shas", F.lit(None).cast("array<string>"))
    st.append_once(shaped(), store, str(tmp_path / "c3")).awaitTermination()
    rows.coalesce(1).write.mode("append").parquet(src)
    st.append_once(shaped(), store, str(tmp_path / "c3")).awaitTermination()
    assert sorted(r["sha"] for r in spark.read.parquet(store).collect()) == ["a", "b", "d", "x"]
    st.sliding(st.source(spark, src)).writeStream.format("memory").queryName("slides").outputMode("append").option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("SELECT max(score) AS m FROM slides").first()["m"] is not None


def test_graphs_without_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert one(graph.hub_score(none)) == {"modules": 0, "hubs": 0, "score": 1.0}
    assert one(graph.propagation_cost(none)) == {"modules": 0, "cost": 0.0, "score": 1.0}


def test_observation_of_a_graph_without_edges(spark):
    seen = builtin.observe({"edges": spark.createDataFrame([], "src long, dst long, weight long")})
    scores = {r["signal_id"]: r["score"] for r in seen["results"].where("applicability = 'applicable'").collect()}
    assert scores["TS-DE-02-fan-in-fan-out"] == 1.0 and scores["TS-DE-03-propagation-cost"] == 1.0


def test_a_signal_without_magnitude_is_not_certain(spark):
    deltas = spark.createDataFrame([("i1", "x", 0.0), ("i2", "x", 0.4)], "item string, signal string, delta double")
    answered = spark.createDataFrame([("i1", "a")], "item string, answer string")
    assert one(elicitation.next_item(deltas, answered)) == {"item": "i2", "gain": pytest.approx(0.4 * (0.5 + 1))}


def test_an_observation_scores_each_signal_once(spark):
    files = spark.createDataFrame([("f", "p", 30, 10)], "file string, package string, complexity int, loc int")
    seen = builtin.observe({"files": files})
    for name in ("results", "categories", "weighted_mean", "readiness", "minimum"):
        read = seen[name].inputFiles()
        assert read and all("/results-" in x for x in read), name
