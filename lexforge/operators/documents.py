"""Operators over documentation records: surfaces, actors, reviews, budgets, chunks, answers, histories of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexforge.functions import text as T
from lexforge.operators.graphs import kept

GENERIC_STEMS = "index mod main init url urls route view handler".split()  # fixed values


# ---- text of records


def class_name(path: Column) -> Column:
    """The class that a file's stem names; generic stems name none."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\..*$", "")
    parts = F.transform(F.split(stem, "[_-]"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.right(w, F.length(w) - 1)))
    return F.when(~F.lower(stem).isin(GENERIC_STEMS), F.array_join(parts, ""))


def static_segments(path: Column) -> Column:
    """A route's segments without placeholders, versions and extensions."""
    return F.filter(T.route_segments(path), lambda s: (s != "*") & ~s.rlike("^v[0-9]+$"))


def heading_anchor(heading: Column) -> Column:
    return F.replace(F.regexp_replace(F.lower(F.trim(heading)), r"[^\p{L}\p{N} _-]", ""), F.lit(" "), F.lit("-"))


def json_answer(answer: Column) -> Column:
    """The JSON value of an answer: what a fence holds if it begins like one, else from the first bracket to where it closes, whatever stands around.

    Brackets are counted over the pieces between quotes and brackets; those inside strings don't count.
    """
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", 1)
    rest = F.regexp_extract(answer, r"(?s)([\{\[].*)$", 1)
    pieces = F.regexp_extract_all(rest, F.lit(r'(?s)"(?:[^"\\]|\\.)*"|[\{\}\[\]]|[^"\{\}\[\]]+|"'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(a: Column, x: Column) -> Column:
        depth = a["depth"] + F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)
        n = a["n"] + 1
        return F.struct(depth.alias("depth"), n.alias("n"), F.when((a["end"] == 0) & (depth == 0) & x.isin("}", "]"), n).otherwise(a["end"]).alias("end"))

    end = F.aggregate(pieces, start, step, lambda a: a["end"])
    bare = F.when(end > 0, F.array_join(F.slice(pieces, F.lit(1), end), "")).otherwise(rest)
    return F.when(fenced != "", fenced).otherwise(bare)


def part_marker(n: Column, total: Column, text: Column) -> Column:
    return F.when(total > 1, F.concat(F.lit("(part "), n.cast("string"), F.lit("/"), total.cast("string"), F.lit(") "), text)).otherwise(text)


def without_part_marker(text: Column) -> Column:
    return F.regexp_replace(text, r"^\(part [0-9]+/[0-9]+\) ", "")


def line_window(text: Column, start: int, end: int, most: int = 400, most_chars: int = 400) -> Column:
    """Lines start..end (from 1), ``most`` of them and each cut."""
    return F.transform(F.slice(F.split(text, "\n"), start, min(end - start + 1, most)), lambda x: F.left(x, F.lit(most_chars)))


def chunks(docs: DataFrame, key: str, text: str, size: int, most: int = 8) -> DataFrame:
    """(key, nth, total, chunk): whole lines up to about ``size`` characters; a full chunk is cut after its last blank line if past its half; a longer line is cut by characters."""

    def cut(value: str) -> list[str]:
        out, held, used = [], [], 0
        for line in (value or "").splitlines(keepends=True):
            while len(line) > size:
                if held:
                    out.append("".join(held))
                    held, used = [], 0
                out.append(line[:size])
                line = line[size:]
            if used + len(line) > size:
                blank = max((i for i, x in enumerate(held) if not x.strip()), default=-1)
                at = blank + 1 if sum(map(len, held[: blank + 1])) > size // 2 else len(held)
                out.append("".join(held[:at]))
                held = held[at:]
                used = sum(map(len, held))
            held.append(line)
            used += len(line)
        return [*out, "".join(held)][:most] if held else out[:most]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, len(cs), c) for k, t in zip(b["k"], b["t"], strict=True) for cs in [cut(t)] for i, c in enumerate(cs)]
            yield pd.DataFrame(rows, columns=["k", "nth", "total", "chunk"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, nth int, total int, chunk string").withColumnRenamed("k", key)


# ---- sources in structured text


def flat_catalog(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, key, text): strings of JSON translation catalogs, by dotted keys of up to three levels."""
    one = F.from_json(content, "map<string,string>")
    level = files.select(path, F.explode(one).alias("key", "text"))
    for _ in range(2):
        nested = F.col("text").startswith("{")
        deeper = level.filter(nested).select(path, "key", F.explode(F.from_json("text", "map<string,string>")).alias("k", "text")).select(path, F.concat_ws(".", "key", "k").alias("key"), "text")
        level = level.filter(~nested).unionByName(deeper)
    return level


def manifest(files: DataFrame, path: str, content: str, most: int = 40) -> DataFrame:
    """(path, name, description, dependencies) of JSON manifests."""
    m = F.from_json(content, "name string, description string, dependencies map<string,string>, devDependencies map<string,string>")
    deps = F.concat(F.coalesce(F.map_keys("m.dependencies"), F.array()), F.coalesce(F.map_keys("m.devDependencies"), F.array()))
    return files.select(path, m.alias("m")).select(path, "m.name", "m.description", F.slice(F.array_distinct(deps), 1, most).alias("dependencies"))


def renamed_log(commits: DataFrame, starts: DataFrame, limit: int, hops: int = 8) -> DataFrame:
    """The newest commits of each path, followed under its former names.  commits: (path, seq, renamed_from).

    A hop reads the commits of the names that are still followed; they are kept, so a hop doesn't
    repeat those before.  A start that has its ``limit`` goes no further.
    """
    commits = kept(commits)
    tracked = starts.select("start", F.col("start").alias("path"), F.lit(None).cast("bigint").alias("before"))
    found = None
    for _ in range(hops):
        here = tracked.join(commits, "path").filter(F.col("before").isNull() | (F.col("seq") < F.col("before")))
        born = here.groupBy("start", "path").agg(F.max(F.when(F.col("renamed_from").isNotNull(), F.col("seq"))).alias("born"))
        own = here.join(born, ["start", "path"]).filter(F.col("born").isNull() | (F.col("seq") >= F.col("born")))
        w = Window.partitionBy("start", "path").orderBy(F.desc("seq"))
        step = kept(own.withColumn("__n", F.row_number().over(w)).select("start", "path", "seq", "renamed_from", "born", "__n"))
        rows = step.filter(F.col("__n") <= limit).select("start", "path", "seq")
        found = rows if found is None else found.unionByName(rows)
        tracked = step.filter((F.col("seq") == F.col("born")) & (F.col("__n") < limit)).select("start", F.col("renamed_from").alias("path"), F.col("seq").alias("before"))
        if tracked.isEmpty():
            break
    w = Window.partitionBy("start").orderBy(F.desc("seq"))
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


# ---- records


def name_mentions(files: DataFrame, path: str, content: str, most_shared: int = 3, least: int = 4) -> DataFrame:
    """(path, refs): how many other files mention a file's name; names of more than ``most_shared`` files count for none."""
    stem = T.normalize_name(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))
    owners = files.select(F.col(path).alias("owner"), stem.alias("key"))
    few = owners.join(owners.groupBy("key").agg(F.count("*").alias("k")).filter(F.col("k") <= most_shared).drop("k"), "key")
    words = F.filter(F.split(content, r"[^\p{L}\p{N}_]+"), lambda w: F.octet_length(w) >= least)
    said = files.select(F.col(path).alias("src"), F.explode(F.array_distinct(F.transform(words, T.normalize_name))).alias("key"))
    hits = said.join(few, "key").filter("src <> owner").groupBy("owner").agg(F.count("*").alias("refs"))
    return files.select(path).join(hits.withColumnRenamed("owner", path), path, "left").withColumn("refs", F.coalesce("refs", F.lit(0)))


def surface_resources(entries: DataFrame, resource: str, verb: str, file: str, pos: str) -> DataFrame:
    """Per resource without case: entries, verbs in the order they are first met, files."""
    e = entries.select(F.lower(resource).alias("resource"), F.col(file).alias("f"), F.col(pos).alias("p"), F.posexplode(F.split(verb, r"\s*,\s*")).alias("n", "v"))
    lists = F.array_sort(F.collect_list(F.struct("p", "n", "v")))
    return e.groupBy("resource").agg(F.count_distinct("p").alias("entries"), F.array_distinct(F.transform(lists, lambda x: x["v"])).alias("verbs"), F.array_sort(F.collect_set("f")).alias("files"))


def outdated(work: DataFrame, sections: DataFrame, recorded: DataFrame, current: DataFrame, cited: DataFrame) -> DataFrame:
    """Human work whose section's fingerprint differs, or of which a still cited file has another hash than recorded.

    work: (id, print); sections: (id, print); recorded: (id, path, hash); current: (path, hash); cited: (id, path).
    """
    moved = recorded.join(cited, ["id", "path"], "left_semi").join(current.withColumnRenamed("hash", "now"), "path", "left").filter(~F.col("hash").eqNullSafe(F.col("now"))).select("id").distinct().withColumn("moved", F.lit(True))
    s = sections.withColumnRenamed("print", "now_print")
    return work.join(s, "id", "left").join(moved, "id", "left").select("id", (~F.col("print").eqNullSafe(F.col("now_print")) | F.coalesce("moved", F.lit(False))).alias("outdated"))


def actor_matrix(steps: DataFrame, primaries: DataFrame) -> DataFrame:
    """(actor, feature, part): starts where an actor is primary, else takes part."""
    a = primaries.select("actor", "feature", F.lit(2).alias("p")).unionByName(steps.select("actor", "feature", F.lit(1).alias("p")))
    return a.groupBy("actor", "feature").agg(F.when(F.max("p") == 2, "starts").otherwise("takes part").alias("part"))


def review_progress(sections: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per kind: sections, reviewed ones by status, outdated ones."""
    j = sections.join(reviews, ["kind", "id"], "left")
    n = lambda s: F.count_if(F.col("status") == s)
    return j.groupBy("kind").agg(F.count("*").alias("sections"), n("validated").alias("validated"), n("wrong").alias("wrong"), n("to_review").alias("to_review"), F.count_if(F.coalesce("outdated", F.lit(False))).alias("outdated"))


def majority_owner(mentions: DataFrame, owners: DataFrame) -> DataFrame:
    """(key, owner): whose files mention a key most; the first on a tie; keys that none mentions are left out."""
    n = mentions.join(owners, "file").groupBy("key", "owner", "owner_pos").agg(F.sum("n").alias("n")).filter("n > 0")
    w = Window.partitionBy("key").orderBy(F.desc("n"), "owner_pos")
    return n.withColumn("__k", F.row_number().over(w)).filter("__k = 1").select("key", "owner", "n")


def step_tally(steps: DataFrame, group: str, check: str) -> DataFrame:
    return steps.groupBy(group).agg(*[F.count_if(F.col(check) == c).alias(c) for c in ("pass", "ungrounded", "doubtful", "broken")])


def pattern_coverage(lines: DataFrame, group: str, line: str, expected: str, pattern: str, most_breadth: float = 0.5) -> DataFrame:
    """Share of expected lines that a pattern matches; invalid when it matches too many of all."""
    hit = F.col(line).rlike(pattern)
    out = lines.groupBy(group).agg(F.avg(F.when(F.col(expected), hit.cast("double"))).alias("coverage"), F.avg(hit.cast("double")).alias("breadth"))
    return out.withColumn("coverage", F.when(F.col("breadth") <= most_breadth, F.col("coverage")))


# ---- budgets


def water_fill(needs: dict[str, float], shares: dict[str, float], total: float) -> dict[str, float]:
    """A budget over kinds by percentage; what a kind doesn't need goes to the others by their shares.  A handful of kinds, so plain Python."""
    out, left, open_ = {}, total, set(needs)
    while open_:
        weight = sum(shares[k] for k in open_)
        full = [k for k in sorted(open_) if needs[k] <= left * shares[k] / weight]
        if not full:
            return out | {k: left * shares[k] / weight for k in open_}
        for k in full:
            out[k] = needs[k]
            open_.remove(k)
        left = total - sum(out.values())
    return out


def even_shares(rows: DataFrame, group: str, key: str, size: str, total: int) -> DataFrame:
    """Each row's share of ``total``: the shortest first, an even part of what is left, no more than its size."""
    xs = F.array_sort(F.collect_list(F.struct(F.col(size).cast("bigint").alias("size"), F.col(key).alias("key"))))
    kind = rows.schema[key].dataType.simpleString()
    start = F.struct(F.lit(total).cast("bigint").alias("left"), F.array().cast(f"array<struct<key:{kind},share:bigint>>").alias("out"))
    grouped = rows.groupBy(group).agg(xs.alias("xs"))

    def step(a: Column, x: Column) -> Column:
        share = F.least(x["size"], F.floor(a["left"] / (F.size("xs") - F.size(a["out"]))))
        return F.struct((a["left"] - share).alias("left"), F.concat(a["out"], F.array(F.struct(x["key"].alias("key"), share.alias("share")))).alias("out"))

    return grouped.select(group, F.inline(F.aggregate("xs", start, step, lambda a: a["out"]))).withColumnRenamed("key", key)
