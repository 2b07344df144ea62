"""The deterministic shells of analysis passes: placement, grounding, estimates, diagrams, groups of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexforge.functions import text as T


def place(items: DataFrame, claims: DataFrame, item: str, holder: str, pos: str, leftover: str = "uncategorized") -> DataFrame:
    """Each item with the first holder that claims it; claims of unknown items are dropped, free items go to ``leftover``."""
    known = claims.join(items.select(item), item, "left_semi")
    first = known.groupBy(item).agg(F.min_by(holder, pos).alias(holder))
    return items.join(first, item, "left").withColumn(holder, F.coalesce(holder, F.lit(leftover)))


def owner_by_route(entries: DataFrame, owners: DataFrame, key: str, words: str) -> DataFrame:
    """The owner that an entry's words name, tried from the last; a known word with several owners stops the search."""
    named = owners.groupBy("word").agg(F.count_distinct("owner").alias("k"), F.min("owner").alias("owner"))
    tried = entries.select(key, F.posexplode(F.reverse(words)).alias("n", "word")).join(named, "word")
    first = tried.groupBy(key).agg(F.min_by(F.struct("k", "owner"), "n").alias("x"))
    return entries.join(first, key, "left").withColumn("owner", F.when(F.col("x.k") == 1, F.col("x.owner"))).drop("x")


def resolve_context(files: DataFrame, listed: DataFrame, folders: DataFrame, path: str = "path", support: str = "support") -> DataFrame:
    """A file's context: where it is listed, else that of its longest listed folder, else ``support``."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    near = files.select(path, F.explode(up).alias("folder")).join(folders.select("folder", "context"), "folder").groupBy(path).agg(F.max_by("context", F.length("folder")).alias("by_folder"))
    out = files.join(listed.select(path, F.col("context").alias("by_list")), path, "left").join(near, path, "left")
    return out.withColumn("context", F.coalesce("by_list", "by_folder", F.lit(support))).drop("by_list", "by_folder")


def routes_declared_elsewhere(routes: DataFrame, file: str = "file", segments: str = "segments", least_share: float = 0.5, least_files: int = 3) -> DataFrame:
    """Routes without those of routing files: files most of whose routes other files declare too, by at least so many files.

    A route that more than ``least_files`` files declare gives each of them enough others, so only
    routes of fewer files meet themselves: a hot route is counted, never paired.
    """
    r = routes.select(F.col(file).alias("f"), F.array_join(segments, "/").alias("p")).distinct()
    known = r.join(r.groupBy("p").agg(F.count("*").alias("k")), "p")
    few = known.filter((F.col("k") > 1) & (F.col("k") <= least_files)).select("f", "p")
    others = few.join(few.select(F.col("f").alias("g"), "p"), "p").filter("f <> g").groupBy("f").agg(F.count_distinct("g").alias("files"))
    per = known.groupBy("f").agg(F.count("*").alias("n"), F.count_if(F.col("k") > 1).alias("covered"), F.max(F.col("k") > least_files).alias("enough")).join(others, "f", "left")
    routing = per.filter((F.col("covered") > 0) & (F.col("covered") >= least_share * F.col("n")) & (F.col("enough") | (F.col("files") >= least_files))).select("f")
    drop = known.filter("k > 1").join(routing, "f", "left_semi").select(F.col("f").alias(file), "p")
    return routes.withColumn("p", F.array_join(segments, "/")).join(drop, [file, "p"], "left_anti").drop("p")


def grounded_steps(steps: DataFrame, shown: DataFrame, key: str, pos: str) -> DataFrame:
    """Complete steps, renumbered; their references keep to shown files.  steps: (key, pos, action, refs array<struct<path,...>>)."""
    flat = steps.filter(F.trim("action") != "").select(key, pos, "action", F.explode_outer("refs").alias("r"))
    ok = flat.join(shown.select(F.col("path").alias("__p"), F.lit(True).alias("__s")), F.col("r.path") == F.col("__p"), "left")
    back = ok.groupBy(key, pos, "action").agg(F.count_if(F.coalesce("__s", F.lit(False))).alias("refs"))
    return back.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(pos)))


def grounded_rules(rules: DataFrame, lines: DataFrame, kinds: list[str]) -> DataFrame:
    """Rules of known kinds with a statement, each statement once, that cite code inside its file.

    rules: (pos, kind, statement, path, start, end); lines: (path, n_lines).
    """
    ok = rules.filter(F.col("kind").isin(kinds) & (F.trim("statement") != "")).join(lines, "path").filter((F.col("start") >= 1) & (F.col("end") <= F.col("n_lines")) & (F.col("start") <= F.col("end")))
    w = Window.partitionBy(F.lower(T.one_line(F.col("statement")))).orderBy("pos")
    return ok.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def combined_confidence(steps: DataFrame, key: str, kind: str, verdict: str) -> DataFrame:
    """Mean value of a case's steps; doubtful steps take their verdicts, unjudged ones count for none."""
    from lexforge.operators.scoring import step_value

    return steps.groupBy(key).agg(F.avg(step_value(F.col(kind), F.col(verdict))).alias("confidence"), F.count("*").alias("steps"))


def estimate_miss(low: Column, high: Column, measured: Column, whole: Column) -> Column:
    """How a measure lies to its range: within, missed by a percent of the bound, or only a lower bound when usage is missing."""
    over = F.floor((measured - high) * 100 / high).cast("string")
    under = F.floor((low - measured) * 100 / low).cast("string")
    return F.when(~whole, "lower bound").when(measured > high, F.concat(F.lit("over by "), over, F.lit("%"))).when(measured < low, F.concat(F.lit("under by "), under, F.lit("%"))).otherwise("within")


def sequence_diagram(steps: DataFrame, key: str, pos: str, actor: str, action: str) -> DataFrame:
    """(key, diagram): actors in the order they are met, then each step as an arrow to the next step's actor."""
    xs = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(actor).alias("a"), F.col(action).alias("t"))))
    g = steps.groupBy(key).agg(xs.alias("xs"))
    heads = F.transform(F.array_distinct(F.transform("xs", lambda x: x["a"])), lambda a: F.concat(F.lit("participant "), a))
    arrows = F.transform("xs", lambda x, i: F.concat(x["a"], F.lit("->>"), F.coalesce(F.get("xs", i + 1)["a"], x["a"]), F.lit(": "), x["t"]))
    return g.select(key, F.array_join(F.concat(F.array(F.lit("sequenceDiagram")), heads, arrows), "\n").alias("diagram"))


def mechanical_groups(files: DataFrame, seeds: DataFrame, path: str = "path") -> DataFrame:
    """Files with the seed name that their own name starts with or a folder bears, the longest first, then in order; others are orphans (null)."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    words = T.file_name_words(stem)
    own = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    folders = F.transform(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), lambda f: F.array_join(T.file_name_words(f), " "))
    hits = files.select(path, F.explode(F.array_distinct(F.concat(own, folders))).alias("name")).join(seeds.select("name").distinct(), "name")
    w = Window.partitionBy(path).orderBy(F.desc(F.length("name")), "name")
    best = hits.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(path, F.col("name").alias("group"))
    return files.join(best, path, "left")


def merge_small(groups: DataFrame, item: str, group: str, folder: str) -> DataFrame:
    """Groups of one item move to the group with most items in the same folder."""
    size = groups.groupBy(group).agg(F.count("*").alias("k"))
    alone = groups.join(size.filter("k = 1"), group, "left_semi")
    big = groups.join(size.filter("k > 1"), group, "left_semi").groupBy(folder, group).agg(F.count("*").alias("n"))
    best = big.withColumn("__n", F.row_number().over(Window.partitionBy(folder).orderBy(F.desc("n"), group))).filter("__n = 1").select(folder, F.col(group).alias("__to"))
    moved = alone.join(best, folder).select(item, "__to")
    return groups.join(moved, item, "left").withColumn(group, F.coalesce("__to", group)).drop("__to")


def changed_snapshot(old: DataFrame, new: DataFrame) -> bool:
    """Whether a new snapshot differs from the newest saved one, as bags of rows."""
    cols = sorted(new.columns)
    a, b = old.select(*cols), new.select(*cols)
    return not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty()
