"""Metrics of commit history: churn, coupling, ownership, line survival."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import materialised
from ..functions.scalars import age_days, half_life


def in_window(facts: DataFrame, days: float, at: str = "committed_at") -> DataFrame:
    """Rows of the last `days` days before the latest row; the anchor is in the data, never the clock."""
    head = facts.agg(F.max(at).alias("head"))
    return facts.join(F.broadcast(head), F.col(at) >= F.col("head") - F.expr(f"INTERVAL {int(days * 86_400)} SECONDS"))


def latest_commits(commits: DataFrame, days: float, most: int) -> DataFrame:
    """The latest `most` commits of the window (ties by sha), with head and `sampled`: whether the cap was reached.

    The anchor is read first, so that the scan gets a literal to prune by."""
    head = commits.agg(F.max("committed_at").alias("head")).first()["head"]
    since = F.lit(head) - F.expr(f"INTERVAL {int(days * 86_400)} SECONDS")
    recent = commits.where(F.col("committed_at") >= since).orderBy(F.desc("committed_at"), "sha").limit(most).withColumn("head", F.lit(head))
    return recent.withColumn("sampled", F.count("*").over(W.partitionBy()) >= most)


def commit_count(commits: DataFrame, days: float) -> DataFrame:
    """(commits): those of the window that are no merges. commits: (sha, committed_at, parents)."""
    return in_window(commits, days).where(F.size("parents") < 2).agg(F.count("*").alias("commits"))


def commit_range(commits: DataFrame, first: str, last: str) -> DataFrame:
    """(sha, committed_at) of commits that `last` holds and `first` doesn't, the oldest first. commits: (sha, committed_at, parents)."""
    from .graph import ancestors

    parents = commits.select("sha", F.explode("parents").alias("parent"))
    inside = ancestors(parents, last).join(ancestors(parents, first), "node", "left_anti")
    return commits.join(inside.withColumnRenamed("node", "sha"), "sha").select("sha", "committed_at").orderBy("committed_at", "sha")


def file_at(trees: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (sha, file) with the file's text there, null where it is missing. trees: (sha, file, text)."""
    return wanted.join(trees.select("sha", "file", "text"), ["sha", "file"], "left")


def last_change(blamed: DataFrame, places: DataFrame, width: int = 64) -> DataFrame:
    """(id, changed_in, changed_at) of places (id, file, start, end): the latest commit of their lines. blamed: (file, line, sha, at).

    A range join by blocks of lines; a place without blamed lines has nulls."""
    block = lambda c: (F.col(c) / width).cast("int")
    spread = places.select("id", "file", "start", "end", F.explode(F.sequence(block("start"), block("end"))).alias("b"))
    met = spread.join(blamed.select("file", "line", "sha", "at", block("line").alias("b")), ["file", "b"]).where("line BETWEEN start AND end")
    last = met.groupBy("id").agg(F.max_by(F.struct("sha", "at"), F.struct("at", "sha")).alias("m")).select("id", F.col("m.sha").alias("changed_in"), F.col("m.at").alias("changed_at"))
    return places.select("id").join(last, "id", "left")


def recent_churn(touches: DataFrame, commits: DataFrame, days: int = 90, most: int = 500) -> DataFrame:
    """(file, touch_count, sampled): commits that touch each file in the window."""
    recent = latest_commits(commits, days, most).select("sha", "sampled")
    return touches.join(F.broadcast(recent), "sha").groupBy("file", "sampled").agg(F.count("*").alias("touch_count")).select("file", "touch_count", "sampled")


def weighted_churn(touches: DataFrame, commits: DataFrame, days: int = 90, most: int = 500, life: float = 14) -> DataFrame:
    """(file, touch_count, weighted, last_touched_at): touches that lose half their weight every `life` days."""
    recent = latest_commits(commits, days, most).select("sha", "head")
    return touches.join(F.broadcast(recent), "sha").groupBy("file").agg(F.count("*").alias("touch_count"), F.round(F.sum(half_life(age_days("committed_at", "head"), life)), 9).alias("weighted"), F.max("committed_at").alias("last_touched_at"))


#: Files of one commit that are paired in one task.
WIDE = 512


def cochange_pairs(touches: DataFrame, least: int = 2, widest: int | None = None) -> DataFrame:
    """Pairs of files that commits change together, with support over commits and confidence over the busier file.

    A commit of more than WIDE files is dealt to blocks, and pairs of blocks meet, so that it is many tasks. widest:
    leave out commits of more files than this, which bounds what one commit adds; None keeps all."""
    plain = materialised(touches.select("sha", "file", "committed_at").dropDuplicates(["sha", "file"]), "touches")
    wide = materialised(plain.groupBy("sha").agg(F.count("*").alias("__n")).where(F.col("__n") > min(WIDE, widest or WIDE)), "wide")
    pairs = plain.select("sha", F.col("file").alias("left_file"), "committed_at").join(plain.select("sha", F.col("file").alias("right_file")), "sha").where("left_file < right_file").select("left_file", "right_file", "committed_at")
    if not wide.isEmpty():
        if widest is not None:
            plain = plain.join(wide.where(F.col("__n") > widest).select("sha"), "sha", "left_anti")
        dealt = plain.join(wide, "sha", "left").withColumn("blocks", F.ceil(F.coalesce("__n", F.lit(1)) / WIDE).cast("int")).withColumn("b", F.pmod(F.xxhash64("file"), F.col("blocks")).cast("int"))
        met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("sha", "committed_at", "file", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
        other = met.select("sha", "i", "j", F.col("file").alias("right_file"), F.col("b").alias("rb"))
        pairs = met.withColumnRenamed("file", "left_file").join(other, ["sha", "i", "j"]).where("left_file < right_file AND (i = j OR b <> rb)").select("left_file", "right_file", "committed_at")
    pairs = pairs.groupBy("left_file", "right_file").agg(F.count("*").alias("co_change_count"), F.max("committed_at").alias("last_co_changed_at")).where(F.col("co_change_count") >= least)
    counts = plain.groupBy("file").agg(F.count("*").alias("n"))
    total = plain.agg(F.count_distinct("sha").alias("commits"))
    of = lambda side: counts.select(F.col("file").alias(f"{side}_file"), F.col("n").alias(f"{side}_touch_count"))
    met = pairs.join(of("left"), "left_file").join(of("right"), "right_file").join(F.broadcast(total))
    support, confidence = F.col("co_change_count") / F.col("commits"), F.col("co_change_count") / F.greatest("left_touch_count", "right_touch_count")
    return met.select("left_file", "right_file", "co_change_count", "left_touch_count", "right_touch_count", F.round(support, 12).alias("support"), F.round(confidence, 12).alias("confidence"), "last_co_changed_at")


def cochange_order(pairs: DataFrame) -> DataFrame:
    """Pairs with the most telling first: by count, confidence, support, then files."""
    return pairs.orderBy(F.desc("co_change_count"), F.desc("confidence"), F.desc("support"), "left_file", "right_file")


def resolve_aliases(authors: DataFrame, aliases: DataFrame) -> DataFrame:
    """authors: (..., author, name, email); aliases: (alias, canonical). The full text is tried, then name, then email."""
    out = authors
    for i, part in enumerate(("author", "name", "email")):
        out = out.join(aliases.select(F.col("alias").alias(part), F.col("canonical").alias(f"__c{i}")), part, "left")
    return out.withColumn("canonical", F.coalesce("__c0", "__c1", "__c2", "author")).drop("__c0", "__c1", "__c2")


def author_share(touches: DataFrame) -> DataFrame:
    """(file, author, n, share): how much of a file's commits each author made."""
    counts = touches.groupBy("file", "author").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("file")), 12))


def bus_factor(touches: DataFrame, files: DataFrame, days: int = 180, least_loc: int = 50) -> DataFrame:
    """(file, loc, bus_factor, primary_author, primary_share, siloed) of files of enough lines touched in the window."""
    counts = in_window(touches, days).groupBy("file", "author").agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("m"), F.col("author").alias("a")))
    by_file = counts.groupBy("file").agg(F.count("*").alias("bus_factor"), first.alias("p"), F.sum("n").alias("all"))
    return by_file.join(files.where(F.col("loc") >= least_loc).select("file", "loc"), "file").select("file", "loc", "bus_factor", F.col("p.a").alias("primary_author"), F.round(-F.col("p.m") / F.col("all"), 12).alias("primary_share"), (F.col("bus_factor") == 1).alias("siloed"))


def silo_score(bus: DataFrame, repo_authors: DataFrame) -> DataFrame:
    """(score, applicability, siloed_files, touched_loc): 1 - min(.35, sum of .45 loc / touched loc over silos).

    repo_authors: (n), the number of authors of the touched files."""
    sums = bus.agg(F.sum("loc").alias("touched_loc"), F.sum(F.when(F.col("siloed"), F.col("loc"))).alias("silo_loc"), F.count(F.when(F.col("siloed"), 1)).alias("siloed_files"))
    score = 1 - F.least(F.lit(0.35), F.coalesce(0.45 * F.col("silo_loc") / F.col("touched_loc"), F.lit(0.0)))
    state = F.when(F.col("touched_loc").isNull(), "insufficient_evidence").when(F.col("n") < 2, "not_applicable").otherwise("applicable")
    return sums.join(F.broadcast(repo_authors)).select(F.round(score, 12).alias("score"), state.alias("applicability"), "siloed_files", F.coalesce("touched_loc", F.lit(0)).alias("touched_loc"))


def exact_survival(added: DataFrame, head: DataFrame) -> DataFrame:
    """(file, introduced, survived): added lines (file, text) still among head's (file, text), each head line used once."""
    count = lambda df, n: df.where("trim(text) <> ''").groupBy("file", F.rtrim("text").alias("text")).agg(F.count("*").alias(n))
    met = count(added, "a").join(count(head, "h"), ["file", "text"], "left")
    return met.groupBy("file").agg(F.sum("a").alias("introduced"), F.sum(F.least("a", F.coalesce("h", F.lit(0)))).alias("survived"))


def fuzzy_survival(added: DataFrame, head: DataFrame, least: float = 0.8) -> DataFrame:
    """(file, introduced, exact, fuzzy): lines matched one to one, first exactly, then each, in order, with its best
    unused line of at least this similarity. Order matters, so a file is one group; added: (file, seq, text)."""

    def near(a: str, b: str) -> float:
        longest = max(len(a), len(b))
        if not longest or min(len(a), len(b)) < least * longest:
            return 0.0
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            diagonal, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
        return 1 - row[-1] / longest

    def match(key: tuple, lines: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        texts = [t.rstrip() for t in lines.sort_values("seq")["text"] if t.strip()]
        free = [t.rstrip() for t in kept.sort_values("seq")["text"]] if len(kept) else []
        left, exact = [], 0
        used = [False] * len(free)
        places: dict[str, list[int]] = {}
        for j, t in enumerate(free):
            places.setdefault(t, []).append(j)
        for t in texts:
            if places.get(t):
                used[places[t].pop(0)] = True
                exact += 1
            else:
                left.append(t)
        fuzzy = 0
        for t in left:
            best, at = 0.0, -1
            for j, o in enumerate(free):
                if not used[j] and (s := near(t, o)) > best:
                    best, at = s, j
            if best >= least:
                used[at] = True
                fuzzy += 1
        return pd.DataFrame({"file": [key[0]], "introduced": [len(texts)], "exact": [exact], "fuzzy": [fuzzy]})

    some = added.select("file", "seq", "text").groupBy("file").cogroup(head.select("file", "seq", "text").toDF("file", "seq", "text").groupBy("file"))
    kind = added.schema["file"].dataType.simpleString()
    return some.applyInPandas(match, f"file {kind}, introduced long, exact long, fuzzy long").where("introduced > 0")


def churn_penalty(survival: DataFrame, tolerated: float = 0.3) -> DataFrame:
    """(score): 1 - min(1, sum over files of churned / introduced / tolerated)."""
    return survival.agg(F.round(1 - F.least(F.lit(1.0), F.coalesce(F.sum((F.col("introduced") - F.col("survived")) / F.col("introduced") / tolerated), F.lit(0.0))), 9).alias("score"))


def added_in_window(touches: DataFrame, newest: int = 14, oldest: int = 28) -> DataFrame:
    """(file, added): lines added between `oldest` and `newest` days before the latest commit."""
    age = age_days("committed_at", "head")
    head = touches.agg(F.max("committed_at").alias("head"))
    return touches.join(F.broadcast(head)).where((age >= newest) & (age <= oldest)).groupBy("file").agg(F.sum("added").alias("added"))


def follow_renames(names: DataFrame, renames: DataFrame) -> DataFrame:
    """names: (file); renames: (old, new). Adds `current`, the end of the chain; on a cycle the last name before it would close.

    Hops double each round: after n rounds a row knows where 2^n renames lead and how many they were."""
    hop = materialised(renames.groupBy("old").agg(F.max("new").alias("new")).where("old <> new"), "renames")
    total = hop.count()
    jump = hop.select("old", "new", F.lit(1).cast("long").alias("n"))
    jumps = [jump]
    while (1 << (len(jumps) - 1)) < total:
        nxt = jump.alias("a").join(jump.alias("b"), F.col("a.new") == F.col("b.old")).select(F.col("a.old").alias("old"), F.col("b.new").alias("new"), (F.col("a.n") + F.col("b.n")).alias("n"))
        jump = materialised(nxt, "renames")
        if jump.isEmpty():
            break
        jumps.append(jump)
    # What a jump of as many hops as there are renames ends at lies on a cycle; all of a cycle's names do.
    ended = jump.isEmpty() or (1 << (len(jumps) - 1)) < total
    loops = materialised((jump.limit(0) if ended else jump).select(F.col("new").alias("old")).distinct(), "cycles")
    stop = loops.withColumn("__stop", F.lit(True))
    now = names.select("file", F.col("file").alias("current"))
    open_ = [j.join(stop.select(F.col("old")), "old", "left_anti") for j in jumps]
    for j in reversed(open_):
        step = j.join(stop.select(F.col("old").alias("new"), "__stop"), "new", "left").where("__stop IS NULL").select(F.col("old").alias("current"), F.col("new").alias("__to"))
        now = materialised(now.join(step, "current", "left").select("file", F.coalesce("__to", "current").alias("current")), "names")
    # What is left: one hop into a cycle, and around it to the name before the one it came in by.
    around = _before_closing(hop, loops)
    last = now.join(hop.withColumnRenamed("old", "current"), "current", "left")
    entered = last.select("file", "current", "new")
    came = entered.join(around.withColumnRenamed("node", "new"), "new", "left").join(around.select(F.col("node").alias("current"), F.col("before").alias("own")), "current", "left")
    return came.select("file", F.coalesce("own", "before", "new", "current").alias("current"))


def _before_closing(hop: DataFrame, loops: DataFrame) -> DataFrame:
    """(node, before): of each name on a cycle the one that is renamed to it there."""
    inside = hop.join(loops, "old", "left_semi")
    return inside.join(loops.withColumnRenamed("old", "new"), "new", "left_semi").select(F.col("new").alias("node"), F.col("old").alias("before"))
