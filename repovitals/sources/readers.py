"""Readers and writers of the files a repository's facts come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCKED = "name string, version string, direct boolean, chain array<string>"


def npm_lock(texts: DataFrame) -> DataFrame:
    """(name, version, direct, chain) of package-lock.json texts (value): the folders of a path are its chain."""
    schema = "packages map<string, struct<version: string, dependencies: map<string,string>, devDependencies: map<string,string>>>"
    lock = texts.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("l"))
    root = F.coalesce(F.array_union(F.map_keys(F.coalesce(F.col("l.packages")[""]["dependencies"], F.create_map().cast("map<string,string>"))), F.map_keys(F.coalesce(F.col("l.packages")[""]["devDependencies"], F.create_map().cast("map<string,string>")))), F.array().cast("array<string>"))
    each = lock.select(root.alias("root"), F.explode("l.packages").alias("path", "p")).where("path <> ''")
    chain = F.filter(F.transform(F.split("path", "node_modules/"), lambda x: F.regexp_replace(x, "/$", "")), lambda x: x != "")
    return each.withColumn("chain", chain).select(F.element_at("chain", -1).alias("name"), F.col("p.version").alias("version"), ((F.size("chain") == 1) & F.array_contains("root", F.element_at("chain", -1))).alias("direct"), "chain")


def cargo_lock(texts: DataFrame) -> DataFrame:
    """(name, version, dependencies) of Cargo.lock texts (value)."""
    parts = texts.select(F.explode(F.split("value", "\\[\\[package\\]\\]")).alias("p"))
    field = lambda k: F.nullif(F.regexp_extract("p", f'(?m)^{k} = "([^"]*)"', 1), F.lit(""))
    deps = F.regexp_extract_all(F.regexp_extract("p", "(?s)dependencies = \\[(.*?)\\]", 1), F.lit('"([^"]+)"'), F.lit(1))
    return parts.select(field("name").alias("name"), field("version").alias("version"), F.transform(deps, lambda x: F.split(x, " ")[0]).alias("dependencies")).where("name IS NOT NULL")


def _versions(resolved: DataFrame, direct: DataFrame, depends: DataFrame) -> DataFrame:
    """(name, version, direct, chain) of resolved packages (node, name, version): the chain of names that brings each, null if nothing does.

    direct: (node); depends: (src, dst), of nodes."""
    from ..operators.graph import pull_in_chains

    chains = pull_in_chains(direct, depends)
    named = chains.select("node", F.posexplode("chain").alias("i", "step")).join(resolved.select(F.col("node").alias("step"), F.col("name").alias("n")), "step", "left")
    names = named.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("n", "step").alias("n")))).alias("c"))
    told = resolved.join(names, "node", "left").join(direct.select("node").distinct().withColumn("__d", F.lit(True)), "node", "left")
    return told.select("name", "version", F.coalesce("__d", F.lit(False)).alias("direct"), F.transform("c", lambda x: x["n"]).alias("chain"))


def pnpm_lock(texts: DataFrame) -> DataFrame:
    """(name, version, direct, chain) of a pnpm-lock.yaml text (value): importers' dependencies are direct.

    The file is read by its indentation: sections at 0, packages and importers at 2, kinds of dependencies at 4, names at 6."""
    lines = texts.select(F.xxhash64("value").alias("f"), F.posexplode(F.split("value", "\\r?\\n")).alias("no", "line")).where("trim(line) <> '' AND NOT trim(line) LIKE '#%'")
    indent = F.length("line") - F.length(F.ltrim("line"))
    key = F.regexp_replace(F.regexp_extract("line", "^\\s*('[^']*'|[^:\\s][^:]*?(?::[^:\\s][^:]*?)*):(?:\\s|$)", 1), "^'|'$", "")
    value = F.regexp_replace(F.trim(F.regexp_extract("line", ":\\s+(.*)$", 1)), "^'|'$", "")
    from pyspark.sql import Window as W

    upto = W.partitionBy("f").orderBy("no").rowsBetween(W.unboundedPreceding, W.currentRow)
    shaped = lines.withColumn("d", indent).withColumn("k", key).withColumn("v", value)
    at = lambda depth, name, seen: seen.withColumn(name, F.last(F.when(F.col("d") == depth, F.col("k")), True).over(upto))
    for depth, name in ((0, "section"), (2, "item"), (4, "part"), (6, "leaf")):
        shaped = at(depth, name, shaped)
    plain = lambda v: F.regexp_replace(v, "\\(.*$", "")  # noqa: E731  versions without the peers they were resolved with
    node = lambda name, v: F.concat(name, F.lit("@"), plain(v))
    kinds = ["dependencies", "devDependencies", "optionalDependencies"]
    direct = shaped.where((F.col("section") == "importers") & (F.col("d") == 8) & (F.col("k") == "version") & F.col("part").isin(kinds)).select(node(F.col("leaf"), F.col("v")).alias("node")).distinct()
    own = F.regexp_replace(plain(F.col("item")), "^/", "")
    resolved = shaped.where((F.col("section").isin("packages", "snapshots")) & (F.col("d") == 2)).select(own.alias("node")).distinct()
    parts = lambda i: F.regexp_extract("node", "^(@?[^@]+)@(.+)$", i)
    resolved = resolved.withColumn("name", parts(1)).withColumn("version", parts(2)).where("name <> ''")
    depends = shaped.where((F.col("section").isin("packages", "snapshots")) & (F.col("d") == 6) & F.col("part").isin(kinds)).select(own.alias("src"), node(F.col("k"), F.col("v")).alias("dst")).distinct()
    return _versions(resolved, direct, depends)


def bun_lock(texts: DataFrame) -> DataFrame:
    """(name, version, direct, chain) of a bun.lock text (value): workspaces' dependencies are direct; a package's own place
    in the file ("a/b" under "a") tells which of several versions its dependent takes."""
    clean = F.regexp_replace("value", ",(\\s*[}\\]])", "$1")  # commas before an end, which JSON has not
    inner = "struct<dependencies: map<string,string>, devDependencies: map<string,string>, optionalDependencies: map<string,string>>"
    lock = texts.select(F.from_json(clean, f"workspaces map<string, {inner}>, packages map<string, array<string>>", {"mode": "FAILFAST"}).alias("l"))
    each = lock.select(F.explode("l.packages").alias("place", "p"))
    part = lambda i: F.regexp_extract(F.col("p")[0], "^(.+)@([^@]+)$", i)
    none = F.create_map().cast("map<string,string>")
    names = lambda c: F.flatten(F.array(*(F.map_keys(F.coalesce(F.col(f"{c}.{k}"), none)) for k in ("dependencies", "devDependencies", "optionalDependencies"))))
    resolved = each.select(F.col("place").alias("node"), part(1).alias("name"), part(2).alias("version"))
    told = each.withColumn("o", F.from_json(F.get(F.filter("p", lambda x: x.startswith("{")), F.lit(0)), inner)).where("o IS NOT NULL")
    wanted = told.select("place", F.explode(names("o")).alias("need"))
    nested = wanted.select(F.col("place").alias("src"), F.concat("place", F.lit("/"), "need").alias("dst")).join(resolved.select(F.col("node").alias("dst")), "dst", "left_semi")
    plain = wanted.select(F.col("place").alias("src"), F.col("need").alias("dst"), F.concat("place", F.lit("/"), "need").alias("n")).join(resolved.select(F.col("node").alias("n")), "n", "left_anti")
    direct = lock.select(F.explode("l.workspaces").alias("w", "x")).select(F.explode(names("x")).alias("node")).distinct()
    return _versions(resolved, direct, plain.select("src", "dst").unionByName(nested.select("src", "dst")))


def cargo_metadata(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages, edges) of `cargo metadata` texts (value): (id, name, version, member) and resolved (src, dst)."""
    schema = "packages array<struct<id: string, name: string, version: string>>, workspace_members array<string>, resolve struct<nodes: array<struct<id: string, dependencies: array<string>>>>"
    told = texts.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("m"))
    found = told.select(F.explode("m.packages").alias("p"), F.col("m.workspace_members").alias("w")).select("p.*", F.array_contains("w", F.col("p.id")).alias("member"))
    edges = told.select(F.explode("m.resolve.nodes").alias("n")).select(F.col("n.id").alias("src"), F.explode("n.dependencies").alias("dst"))
    return found, edges


def packages(spark: SparkSession, path: str) -> DataFrame:
    """(name, root, dependencies, dev) of package.json files under a glob."""
    schema = "name string, dependencies map<string,string>, devDependencies map<string,string>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("name", F.regexp_replace(F.col("_metadata.file_path"), "/package\\.json$", "").alias("root"), F.map_keys(F.coalesce("dependencies", F.create_map().cast("map<string,string>"))).alias("dependencies"), F.map_keys(F.coalesce("devDependencies", F.create_map().cast("map<string,string>"))).alias("dev"))


def git_log(texts: DataFrame) -> DataFrame:
    """(sha, committed_at, author, file, added) of texts (value) of
    `git log --format=%x01%H%x09%cI%x09%an --numstat`: a binary file's count is null; a file comes once a commit."""
    commits = texts.select(F.explode(F.split("value", "\\x01")).alias("c")).where("trim(c) <> ''").select(F.split("c", "\\n").alias("rows"))
    head = F.split(F.col("rows")[0], "\\t")
    each = commits.select(head[0].alias("sha"), F.to_timestamp(head[1]).alias("committed_at"), head[2].alias("author"), F.explode(F.filter("rows", lambda r: r.rlike("^(\\d+|-)\\t(\\d+|-)\\t."))).alias("r"))
    cell = F.split("r", "\\t")
    return each.groupBy("sha", "committed_at", "author", cell[2].alias("file")).agg(F.sum(F.try_to_number(cell[0], F.lit("999999999"))).cast("long").alias("added"))


def git_commits(texts: DataFrame) -> DataFrame:
    """(sha, parents, committed_at, author) of texts (value) of `git log --format=%H%x09%P%x09%cI%x09%an`."""
    rows = texts.select(F.explode(F.split("value", "\\n")).alias("l")).select(F.split("l", "\\t").alias("c")).where(F.size("c") >= 4)
    return rows.select(F.get("c", F.lit(0)).alias("sha"), F.filter(F.split(F.get("c", F.lit(1)), " "), lambda p: p != "").alias("parents"), F.to_timestamp(F.get("c", F.lit(2))).alias("committed_at"), F.get("c", F.lit(3)).alias("author"))


def git_renames(texts: DataFrame) -> DataFrame:
    """(old, new) of texts (value) of `git log --format= --name-status --find-renames=100%`."""
    cells = texts.select(F.explode(F.split("value", "\\n")).alias("l")).select(F.split("l", "\\t").alias("c"))
    return cells.where((F.size("c") == 3) & F.get("c", F.lit(0)).rlike("^R\\d*$")).select(F.get("c", F.lit(1)).alias("old"), F.get("c", F.lit(2)).alias("new"))


def git_files(texts: DataFrame) -> DataFrame:
    """(file) of texts (value) of `git ls-files`."""
    return texts.select(F.explode(F.split("value", "\\n")).alias("file")).where("file <> ''").distinct()


def git_added_lines(texts: DataFrame) -> DataFrame:
    """(sha, committed_at, file, seq, text) of texts (value) of `git log -p --unified=0 --format=%x01%H%x09%cI`: added lines that aren't blank."""
    commits = texts.select(F.explode(F.split("value", "\\x01")).alias("c")).where("trim(c) <> ''")
    head = F.split(F.split("c", "\\n")[0], "\\t")
    files = commits.select(F.get(head, F.lit(0)).alias("sha"), F.to_timestamp(F.get(head, F.lit(1))).alias("committed_at"), F.explode(F.slice(F.split("c", "(?m)^diff --git .*$"), 2, 1 << 30)).alias("d"))
    lines = files.select("sha", "committed_at", F.regexp_extract("d", "(?m)^\\+\\+\\+ b/(.*)$", 1).alias("file"), F.posexplode(F.split("d", "\\n")).alias("seq", "line")).where("file <> ''")
    return lines.where("line LIKE '+%' AND NOT line LIKE '+++ %'").select("sha", "committed_at", "file", "seq", F.expr("substring(line, 2)").alias("text")).where("trim(text) <> ''")


def git_blame(texts: DataFrame) -> DataFrame:
    """(file, line, sha, at) of rows (file, value) of `git blame --line-porcelain`."""
    heads = F.regexp_extract_all("value", F.lit("(?m)^([0-9a-f]{40}) \\d+ (\\d+)"), F.lit(0))
    times = F.regexp_extract_all("value", F.lit("(?m)^committer-time (\\d+)"), F.lit(1))
    each = texts.select("file", F.explode(F.arrays_zip(heads.alias("h"), times.alias("t"))).alias("x"))
    cell = F.split("x.h", " ")
    return each.select("file", cell[2].cast("int").alias("line"), cell[0].alias("sha"), F.timestamp_seconds(F.col("x.t").cast("long")).alias("at"))


def reference_data(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Canonical JSON artifacts by key: (value variant) each; a path that is missing is left out."""
    out = {}
    for key, path in paths.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            out[key] = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("value"))
    return out


#: What a fact that a model labelled may do at most.
LABEL_CEILINGS = ["informational", "review-route", "soft-warning"]


def label_facts(texts: DataFrame) -> DataFrame:
    """(artifact_id, kind, value, confidence, ceiling, source_paths, fingerprint) of label artifacts (value, JSON), replayed as they are.

    Artifacts with another ceiling or a confidence beyond 0..1 are left out; the fingerprint is of classifier and input."""
    classifier = "struct<id: string, version: string, prompt_id: string, prompt_fingerprint: string, model_id: string>"
    given = "struct<scope: string, content_hash: string, input_fingerprint: string, source_paths: array<string>, symbol: string>"
    schema = f"artifact_id string, classifier {classifier}, input {given}, label struct<kind: string, value: string, confidence: double>, policy struct<enforcement_ceiling: string>"
    a = texts.select(F.from_json("value", schema).alias("a")).select("a.*").withColumn("paths", F.array_sort("input.source_paths"))
    key = F.sha2(F.concat_ws("\x1f", "classifier.id", "classifier.version", "classifier.prompt_id", "classifier.prompt_fingerprint", "classifier.model_id", "input.scope", "input.content_hash", "input.input_fingerprint", F.to_json("paths"), F.coalesce("input.symbol", F.lit(""))), 256)
    fine = F.col("policy.enforcement_ceiling").isin(LABEL_CEILINGS) & F.col("label.confidence").between(0, 1)
    return a.where(fine).select("artifact_id", "label.kind", "label.value", "label.confidence", F.col("policy.enforcement_ceiling").alias("ceiling"), F.col("paths").alias("source_paths"), key.alias("fingerprint"))


def write_observations(rows: DataFrame, path: str) -> None:
    """Appends observations that the store doesn't have (by sha, also inside its aggregates), parted by day."""
    from ..operators.timeseries import append

    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = rows.dropDuplicates(["sha"])
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new = append(spark.read.parquet(path), rows)
    new.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def observer_json(rows: DataFrame) -> DataFrame:
    """(json): a row as one JSON object with fields in order of name, nested ones too, and numbers rounded as the columns are."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("json"))


def write_baseline(rows: DataFrame, path: str) -> None:
    """Writes a baseline's violations in order, in as many files as they take."""
    rows.orderBy("signal_id", "hash").write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("signal_id string, hash string, file string, line int, detail string").json(path)
