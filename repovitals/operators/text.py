"""Facts read from text: suppressions, identifiers, glossary, conventions, hunks, secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import CASINGS, casing, entropy, glob_match, matches_casing


def lines(sources: DataFrame) -> DataFrame:
    """(file, line_no, line) of (file, text)."""
    return sources.select("file", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def bypasses(line_facts: DataFrame, now, marker: str = "[A-Za-z]+-allow") -> DataFrame:
    """(file, line_no, ticket, until, reason, expired) of lines that are a comment `// MARKER TICKET until:DATE reason`.

    A date alone lasts to the end of its day in UTC; one that can't be read, or is past, has expired."""
    pattern = f"^\\s*//\\s*(?:{marker})\\s+(\\S+)\\s+until:(\\S+)\\s+(.+?)\\s*$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    found = line_facts.where(F.col("line").rlike(pattern)).select("file", "line_no", part(1).alias("ticket"), part(2).alias("until"), part(3).alias("reason"))
    at = F.try_to_timestamp(F.when(F.col("until").rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.concat("until", F.lit(" 23:59:59.999"))).otherwise(F.col("until")))
    return found.withColumn("expired", at.isNull() | (at < F.lit(now).cast("timestamp")))


def suppression_score(found: DataFrame, files: int) -> DataFrame:
    """found: (ticket, expired). 1 - (4 expired + missing + .25 justified) / max(100, .25 files)."""
    expired = F.count(F.when(F.col("expired"), 1))
    missing = F.count(F.when(~F.col("expired") & F.col("ticket").isNull(), 1))
    fine = F.count(F.when(~F.col("expired") & F.col("ticket").isNotNull(), 1))
    return found.agg(expired.alias("expired"), missing.alias("missing"), fine.alias("justified"), F.round(1 - F.least(F.lit(1.0), (4 * expired + missing + 0.25 * fine) / max(100.0, 0.25 * files)), 9).alias("score"))


def _split(name: Column) -> Column:
    """The words of an identifier: cut at marks, before the last capital of a run and at small to capital; those with a letter."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w.rlike("[a-z]"))


def terms(identifiers: DataFrame, column: str = "name") -> DataFrame:
    """(..., term): the words of identifiers, split at case changes and marks."""
    return identifiers.withColumn("term", F.explode(_split(F.col(column))))


def glossary(term_facts: DataFrame, least: int = 2) -> DataFrame:
    """(term, frequency, files) of terms (file, term) that come at least so often."""
    return term_facts.groupBy("term").agg(F.count("*").alias("frequency"), F.count_distinct("file").alias("files")).where(F.col("frequency") >= least)


def synonyms(peers: DataFrame, frequency: DataFrame, least: float = 0.75, ratio: float = 0.5) -> DataFrame:
    """(a, b, jaccard): terms whose peers (term, peer) overlap by `least` and whose frequencies (term, n) are alike.

    Terms meet through the peers they share, an equi-join, so terms without one never meet."""
    p = peers.select("term", "peer").distinct()
    size = p.groupBy("term").agg(F.count("*").alias("s"))
    both = p.select(F.col("term").alias("a"), "peer").join(p.select(F.col("term").alias("b"), "peer"), "peer").where("a < b").groupBy("a", "b").agg(F.count("*").alias("i"))
    of = lambda side: size.join(frequency, "term").select(F.col("term").alias(side), F.col("s").alias(f"s{side}"), F.col("n").alias(f"n{side}"))
    met = both.join(of("a"), "a").join(of("b"), "b").withColumn("jaccard", F.col("i") / (F.col("sa") + F.col("sb") - F.col("i")))
    return met.where((F.col("jaccard") >= least) & (F.least("na", "nb") / F.greatest("na", "nb") >= ratio)).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


def _neighbours(term: Column) -> Column:
    """The term and every text it becomes with one character left out: two terms within one edit share one."""
    n = F.length(term)
    return F.array_distinct(F.concat(F.array(term), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, n)))))


def near_misses(names: DataFrame, known: DataFrame) -> DataFrame:
    """(term, known): terms one edit from a known term (known), and not known themselves; an equi-join on deletions."""
    left = names.select("term").distinct().join(known.select(F.col("known").alias("term")), "term", "left_anti")
    a = left.select("term", F.explode(_neighbours(F.col("term"))).alias("k"))
    b = known.select("known", F.explode(_neighbours(F.col("known"))).alias("k"))
    return a.join(b, "k").where("levenshtein(term, known, 1) >= 0").select("term", "known").distinct()


def term_classes(names: DataFrame, known: DataFrame) -> DataFrame:
    """names: (name, tokens array). class: match, duplicate (the same words in another order), conflict or new."""
    key = lambda c: F.array_join(F.array_sort(c), " ")
    exact = known.select(F.array_join("tokens", " ").alias("__e"), F.lit(True).alias("__m")).distinct()
    sorted_ = known.select(key(F.col("tokens")).alias("__k"), F.lit(True).alias("__d")).distinct()
    joined = names.withColumn("__e", F.array_join("tokens", " ")).withColumn("__k", key(F.col("tokens"))).join(exact, "__e", "left").join(sorted_, "__k", "left")
    near = near_misses(joined.where("__m IS NULL AND __d IS NULL").select(F.col("__e").alias("term")), known.select(F.array_join("tokens", " ").alias("known"))).select(F.col("term").alias("__e"), F.lit(True).alias("__c")).distinct()
    out = joined.join(near, "__e", "left")
    return out.select("name", F.when(F.col("__m"), "match").when(F.col("__d"), "duplicate").when(F.col("__c"), "conflict").otherwise("new").alias("class"))


def term_score(classes: DataFrame) -> DataFrame:
    """(total, conflicts, duplicates, new, score) of term_classes(): 1 - (.9 conflicts + .5 duplicates + .15 new) / total."""
    n = lambda k: F.count(F.when(F.col("class") == k, 1))
    cost = 0.9 * n("conflict") + 0.5 * n("duplicate") + 0.15 * n("new")
    score = 1 - F.coalesce(cost / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    return classes.agg(F.count("*").alias("total"), n("conflict").alias("conflicts"), n("duplicate").alias("duplicates"), n("new").alias("new"), F.round(score, 9).alias("score"))


#: What is expected of a kind that has no name to learn from.
DEFAULTS = {"function": "camelCase", "class": "PascalCase", "interface": "PascalCase", "type": "PascalCase", "const": "camelCase | UPPER_SNAKE_CASE", "enum": "PascalCase"}


def conventions(identifiers: DataFrame) -> DataFrame:
    """(kind, convention, n): of identifiers (kind, name) the most frequent casing of each kind, ties by name; of kind const
    all casings that occur, in their order. Names of no known casing don't count; a kind without others has its default."""
    seen = identifiers.select("kind", casing("name").alias("convention"))
    counts = seen.where(F.col("convention") != "unrecognized").groupBy("kind", "convention").agg(F.count("*").alias("n"))
    top = F.max_by(F.struct("convention", "n"), F.struct("n", F.transform(F.split("convention", ""), lambda c: -F.ascii(c)).alias("t")))
    place = lambda c: F.array_position(F.array(*map(F.lit, CASINGS)), c)
    union = F.transform(F.array_sort(F.collect_list(F.struct(place(F.col("convention")).alias("at"), "convention"))), lambda x: x["convention"])
    picked = counts.groupBy("kind").agg(top.alias("top"), F.array_join(union, " | ").alias("all"), F.sum("n").alias("every"))
    const = F.col("kind") == "const"
    chosen = picked.select("kind", F.when(const, F.col("all")).otherwise(F.col("top.convention")).alias("convention"), F.when(const, F.col("every")).otherwise(F.col("top.n")).alias("n"))
    plain = F.element_at(F.create_map(*(F.lit(x) for kv in DEFAULTS.items() for x in kv)), F.col("kind"))
    kinds = identifiers.select("kind").distinct().join(chosen, "kind", "left")
    return kinds.select("kind", F.coalesce("convention", plain).alias("convention"), F.coalesce("n", F.lit(0)).alias("n")).where("convention IS NOT NULL")


def naming_score(identifiers: DataFrame, wanted: DataFrame) -> DataFrame:
    """identifiers: (kind, name); wanted: (kind, convention), alternatives apart by " | ". 1 - violations / total."""
    met = identifiers.join(wanted, "kind")
    fits = F.exists(F.split("convention", " *\\| *"), lambda c: F.coalesce(matches_casing("name", c), F.lit(False)))
    return met.agg(F.count("*").alias("total"), F.count(F.when(~fits, 1)).alias("violations")).withColumn("score", F.round(1 - F.coalesce(F.col("violations") / F.nullif("total", F.lit(0)), F.lit(0.0)), 9))


def taxonomy(path: Column) -> Column:
    """Categories of a source path, by its folders and endings."""
    rules = [("test", "(^|/)(__tests__|tests?|specs?)/|[._](test|spec)\\.[a-z]+$"), ("generated", "(^|/)(generated|gen|dist|build)/|\\.(gen|generated)\\.[a-z]+$"), ("vendor", "(^|/)(vendor|node_modules|third_party)/"), ("docs", "(^|/)docs?/|\\.mdx?$"), ("config", "(^|/)\\.[^/]+$|\\.(json|ya?ml|toml)$|\\.config\\.[a-z]+$"), ("declaration", "\\.d\\.[cm]?ts$")]
    found = F.array_compact(F.array(*(F.when(path.rlike(p), F.lit(n)) for n, p in rules)))
    return F.when(F.size(found) == 0, F.array(F.lit("source"))).otherwise(F.array_distinct(found))


def included(path: Column, extensions: list[str], excludes: list[str] = ()) -> Column:
    """Whether a path has one of the endings and matches no exclusion."""
    ends = F.lit(False)
    for e in extensions:
        ends = ends | path.endswith(e)
    return ends & ~glob_match(path, list(excludes))


#: Framework, the packages whose presence shows it, and the pattern of files that follow its conventions.
FRAMEWORKS = {
    "nextjs-app-router": (("next",), "(^|/)app/(.*/)?(page|layout|route|loading|error|not-found|template|default)\\.[cm]?[jt]sx?$"),
    "solidjs-start": (("@solidjs/start",), "(^|/)src/routes/.+\\.[cm]?[jt]sx?$"),
    "convex": (("convex",), "(^|/)convex/.+\\.[cm]?[jt]s$"),
    "effect": (("effect",), "$^"),
}


def frameworks(dependencies: DataFrame, paths: DataFrame) -> DataFrame:
    """(framework, packages, files, confidence) of dependencies (root, name) and paths (path): high with both kinds of evidence."""
    spark = dependencies.sparkSession
    names = spark.createDataFrame([(k, n) for k, (some, _) in FRAMEWORKS.items() for n in some], "framework string, name string")
    declared = dependencies.join(F.broadcast(names), "name").groupBy("framework").agg(F.count_distinct("root").alias("packages"))
    told = paths.agg(*(F.count(F.when(F.col("path").rlike(p), 1)).alias(k) for k, (_, p) in FRAMEWORKS.items()))
    files = told.select(F.explode(F.array(*(F.struct(F.lit(k).alias("framework"), F.col(f"`{k}`").alias("files")) for k in FRAMEWORKS))).alias("x")).select("x.*")
    confidence = F.when(F.col("files") > 0, "high").otherwise("medium")
    return declared.join(files, "framework").select("framework", "packages", "files", confidence.alias("confidence"))


def owners(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, package): the package whose root is the longest folder prefix. Joined on each folder of a path."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = paths.select("path", F.explode(prefixes).alias("root"))
    return each.join(packages.select("root", "package"), "root").groupBy("path").agg(F.max_by("package", F.length("root")).alias("package"))


def hunks(diff: DataFrame) -> DataFrame:
    """diff: (file, line_no, line) of unified diffs. (file, old_start, old_lines, new_start, new_lines); a count left out is 1."""
    pattern = "^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@"
    n = lambda i: F.coalesce(F.nullif(F.regexp_extract("line", pattern, i), F.lit("")).cast("int"), F.lit(1))
    return diff.where(F.col("line").rlike(pattern)).select("file", n(1).alias("old_start"), n(2).alias("old_lines"), n(3).alias("new_start"), n(4).alias("new_lines"))


def secrets(identifiers: DataFrame, least_entropy: float = 3.5) -> DataFrame:
    """identifiers: (name, value). kind: a known format (block), or a secret's name with a value of high entropy (warn)."""
    known = F.col("value").rlike("^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----.*)$")
    named = F.lower("name").rlike("secret|token|passw(or)?d|api_?key|private_?key")
    vague = named & (F.length("value") >= 16) & (entropy("value") >= least_entropy)
    return identifiers.withColumn("severity", F.when(known, "block").when(vague, "warn")).where("severity IS NOT NULL")
