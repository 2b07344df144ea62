"""Secret scans: token-like strings of whole texts, false positives removed by a random forest.

Candidates are runs of 16 or more token characters.  Their features are whole numbers: length,
shares of digits and capitals, character transitions, common letter pairs, dictionary coverage,
distinct characters, neighbouring words on both sides, what stands right before, and the path.  The forest is
trained by numpy on labelled findings (a bounded list; by default drawn by rule from a seed) and
becomes nested CASE expressions, so scoring is built-in functions over the arrays of one row: no
shuffle, no Python on the executors.

Defined results: null and empty texts have no findings; each occurrence is a finding of its own,
told apart by its word and its place in it; repeated rows give repeated findings; a null path
counts as an empty one; an empty table gives an empty result; very long texts are one array of words in one task, like any
other; ``scan`` reads the named columns only, ``redact`` keeps all others, whatever their names.
"""

from __future__ import annotations

import functools
import random
import re
import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CHARS, TREES, DEPTH, FINDINGS, THRESHOLD, MASK = 16, 15, 5, 3000, 0.5, "[SECRET]"
_WORD = r"[ \t\n\x0B\f\r]+"
#: A run of token characters; parts that full stops join (as in signed web tokens) are one candidate.
_TOKEN = r"[A-Za-z0-9_+/-]{16,}(?:\.[A-Za-z0-9_+/-]{16,}){0,2}={0,2}"
# Frequent letter pairs and words of English and of code.
_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|nt|to|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ch|ll|be|ma|si|om|ur|ie|sc|qu|ci|ue|la|os"
_WORDS = "the|and|for|with|that|this|from|have|name|user|test|example|sample|config|index|table|default|service|file|path|data|value|time|type|list|model|client|server|version|request|response|controller|manager|update|create|delete|order|account|invoice|number|string|token|secret|password|key"
_GOOD = "secret|token|passw|pwd|api.?key|auth|bearer|credential|private|access.?key"
_BAD = "example|dummy|sample|placeholder|commit|sha[0-9]*|md5|hash|checksum|uuid|digest|revision|integrity|http"
_SET = """[:=] ?["']?$"""
_TEST_PATH = "test|example|sample|fixture|mock|docs?/"
_CHANGE = "[a-z][^a-z]|[A-Z][^A-Z]|[0-9][^0-9]"
NAMES = ("chars", "digits", "capitals", "transitions", "pairs", "dictionary", "variety", "hexadecimal", "separators", "near_good", "near_bad", "assigned", "test_path", "after_good", "after_bad")


def features(c: Column, before: Column, path: Column, after: Column) -> list[Column]:
    """The features of a candidate, by NAMES.  before: two words and what the candidate's own word has before it; after: the two words behind."""
    n, low = F.length(c), F.lower(c)
    share = lambda x: F.floor(100 * x / n).cast("int")
    count = lambda s, p: F.regexp_count(s, F.lit(p))
    flag = lambda x: x.cast("int")
    near = F.lower(before)
    return [n, share(count(c, "[0-9]")), share(count(c, "[A-Z]")), share(count(c, _CHANGE)), share(count(low, _PAIRS)), share(n - F.length(F.regexp_replace(low, _WORDS, ""))), share(F.size(F.array_distinct(F.split(c, "")))), flag(c.rlike("^[0-9a-f]+$")), count(c, "[/_-]"), flag(near.rlike(_GOOD)), flag(near.rlike(_BAD)), flag(before.rlike(_SET)), flag(F.coalesce(F.lower(path).rlike(_TEST_PATH), F.lit(False))), flag(F.lower(after).rlike(_GOOD)), flag(F.lower(after).rlike(_BAD))]


def features_sql(c: str = "c", before: str = "before", path: str = "path", after: str = "after") -> list[str]:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    count = lambda s, p: f"len(regexp_extract_all({s}, {q(p)}))"
    share = lambda x: f"cast(floor(100 * ({x}) / length({c})) as int)"
    flag = lambda s, p: f"cast(coalesce(regexp_matches({s}, {q(p)}), false) as int)"
    return [f"length({c})", share(count(c, "[0-9]")), share(count(c, "[A-Z]")), share(count(c, _CHANGE)), share(count(f"lower({c})", _PAIRS)), share(f"length({c}) - length(regexp_replace(lower({c}), {q(_WORDS)}, '', 'g'))"), share(f"len(list_distinct(string_split({c}, '')))"), flag(c, "^[0-9a-f]+$"), count(c, "[/_-]"), flag(f"lower({before})", _GOOD), flag(f"lower({before})", _BAD), flag(before, _SET), flag(f"lower({path})", _TEST_PATH), flag(f"lower({after})", _GOOD), flag(f"lower({after})", _BAD)]


def features_py(c: str, before: str, path: str, after: str) -> list[int]:
    n, low = len(c), c.lower()
    share = lambda x: 100 * x // n
    count = lambda s, p: sum(1 for _ in re.finditer(p, s))
    flag = lambda s, p: int(re.search(p, s) is not None)
    return [n, share(count(c, "[0-9]")), share(count(c, "[A-Z]")), share(count(c, _CHANGE)), share(count(low, _PAIRS)), share(n - len(re.sub(_WORDS, "", low))), share(len(set(c))), flag(c, "^[0-9a-f]+$"), count(c, "[/_-]"), flag(before.lower(), _GOOD), flag(before.lower(), _BAD), flag(before, _SET), flag(path.lower(), _TEST_PATH), flag(after.lower(), _GOOD), flag(after.lower(), _BAD)]


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, path, after, 1 if a secret): drawn by rule."""
    r = random.Random(seed)
    any_of = lambda chars, k: "".join(r.choices(chars, k=k))
    pairs = _PAIRS.split("|")
    syllables = lambda: "".join(r.choice(pairs) for _ in range(r.randrange(8, 14)))
    words = _WORDS.split("|")
    some = lambda k, join: join.join(r.choice(words) for _ in range(k))
    plain = lambda: f"{syllables()[:6]} {syllables()[:4]} "
    b64 = string.ascii_letters + string.digits
    keys = ["token", "secret", "api_key", "apikey", "password", "auth_token", "access_key", "client_secret", "private_key"]
    assigned = lambda: f'{syllables()[:5]} {r.choice(keys)} {r.choice(["= ", "=", ": "])}{r.choice([chr(34), chr(39), ""])}'
    true = [lambda: any_of("0123456789abcdef", r.choice([32, 40, 64])), lambda: any_of(b64, r.randrange(20, 48)), lambda: any_of(b64 + "+/", r.randrange(24, 44)) + "=", lambda: "AKIA" + any_of(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + any_of(b64, 36), lambda: "sk_live_" + any_of(b64, 24)]
    false = [syllables, lambda: syllables().capitalize(), lambda: syllables().upper(), lambda: some(3, "_") + "_id", lambda: "".join(w.capitalize() for w in some(4, " ").split()), lambda: some(4, "/"), lambda: some(4, "-"), lambda: any_of(string.digits, r.randrange(16, 24)), lambda: r.choice("xX0a-_") * r.randrange(16, 40), lambda: "your_" + some(2, "_") + "_here", lambda: some(4, "_").upper(), lambda: any_of("-_=#", 3) * 6]
    hashes = [lambda: f"{r.choice(['commit', 'sha1', 'sha256', 'md5', 'checksum', 'revision', 'integrity'])} {r.choice(['', ': ', '= '])}", lambda: f"see http {r.choice(['example', 'uuid'])}="]
    paths = ["src/app.py", "config/prod.yaml", "src0", "src7", "lib/main.go", ""]
    behind = lambda: r.choice([plain(), plain(), "", f"# {r.choice(keys)}", f"is the {r.choice(keys)}"])
    signed = lambda: "ey" + ".".join(any_of(b64 + "_-", r.randrange(18, 44)) for _ in range(3))
    out = []
    for _ in range(n):
        x, path = r.random(), r.choice(paths)
        if x < 0.26:
            out.append((r.choice(true)(), assigned(), path, behind(), 1))
        elif x < 0.3:
            out.append((signed(), assigned() if r.random() < 0.7 else plain(), path, behind(), 1))
        elif x < 0.38:
            out.append((r.choice(true)(), plain(), path, behind(), 1))
        elif x < 0.47:
            out.append((any_of("0123456789abcdef", r.choice([32, 40, 64])), r.choice(hashes)(), path, plain(), 0))
        elif x < 0.5:
            out.append((any_of("0123456789abcdef", r.choice([32, 40, 64])), plain(), path, f"{r.choice(['checksum', 'md5', 'sha256', 'digest', '(commit)'])} {syllables()[:5]}", 0))
        elif x < 0.54:
            out.append((r.choice(true)(), assigned(), r.choice(["tests/fixtures/keys.py", "docs/example.md", "mock/data.json"]), behind(), 0))
        else:
            out.append((r.choice(false)(), assigned() if r.random() < 0.25 else plain(), path, plain(), 0))
    return [x for x in out if re.fullmatch(_TOKEN, x[0])]


Tree = tuple  # (share of secrets in thousandths,) or (feature, most, low tree, high tree)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[Tree]:
    """A random forest: bootstrapped rows, a third of the features at each split, Gini gain."""
    rng = np.random.Generator(np.random.PCG64(seed))

    def split(rows: np.ndarray, left: int) -> Tree:
        t = y[rows]
        p = t.mean()
        if left == 0 or len(rows) < 10 or p in (0, 1):
            return (round(1000 * float(p)),)
        best = (1e-9, None, None)
        for f in rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, c = x[rows, f][order], np.cumsum(t[order])
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            k = k[(k >= 4) & (len(rows) - k >= 4)]
            if len(k):
                a, b = c[k - 1] / k, (c[-1] - c[k - 1]) / (len(rows) - k)
                gain = p * (1 - p) - (k * a * (1 - a) + (len(rows) - k) * b * (1 - b)) / len(rows)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], int(f), int(v[k[i] - 1]))
        _, f, most = best
        if f is None:
            return (round(1000 * float(p)),)
        low = x[rows, f] <= most
        return (f, most, split(rows[low], left - 1), split(rows[~low], left - 1))

    return [split(rng.integers(0, len(x), len(x)), depth) for _ in range(trees)]


@functools.cache
def default_forest() -> tuple[Tree, ...]:
    found = labelled_findings()
    return tuple(grow(np.array([features_py(*f[:4]) for f in found]), np.array([f[4] for f in found])))


def votes(forest: tuple[Tree, ...], x: list[int]) -> float:
    def one(t: Tree) -> int:
        while len(t) > 1:
            t = t[2] if x[t[0]] <= t[1] else t[3]
        return t[0]

    return sum(map(one, forest)) / (1000 * len(forest))


def _tree_column(t: Tree, x: Column) -> Column:
    if len(t) == 1:
        return F.lit(t[0])
    return F.when(x[NAMES[t[0]]] <= t[1], _tree_column(t[2], x)).otherwise(_tree_column(t[3], x))


def _tree_sql(t: Tree) -> str:
    return str(t[0]) if len(t) == 1 else f"case when {NAMES[t[0]]} <= {t[1]} then {_tree_sql(t[2])} else {_tree_sql(t[3])} end"


def findings(words: Column, path: Column, forest: tuple[Tree, ...] | None = None, threshold: float = THRESHOLD) -> Column:
    """array<struct<word_no, nth, secret, score>> of a row's confirmed findings.

    words: a column that holds the words, not the expression for them, which each lambda would evaluate anew.
    """
    forest = forest or default_forest()

    def candidates(w: Column) -> Column:
        def of(i: Column) -> Column:
            word = F.get(w, i)
            near = F.concat_ws(" ", F.get(w, i - 2), F.get(w, i - 1))
            after = F.concat_ws(" ", F.get(w, i + 1), F.get(w, i + 2))
            return F.transform(F.regexp_extract_all(word, F.lit(_TOKEN), F.lit(0)), lambda c, n: F.struct(i.alias("word_no"), n.alias("nth"), c.alias("secret"), F.concat(near, F.lit(" "), F.call_function("substring_index", word, c, F.lit(1))).alias("before"), after.alias("after")))

        return F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.length(F.get(w, i)) >= MIN_CHARS), of))

    described = F.transform(candidates(words), lambda x: F.struct(x["word_no"].alias("word_no"), x["nth"].alias("nth"), x["secret"].alias("secret"), *[f.alias(k) for f, k in zip(features(x["secret"], x["before"], path, x["after"]), NAMES, strict=True)]))

    def scored(x: Column) -> Column:
        total = functools.reduce(Column.__add__, [_tree_column(t, x) for t in forest])
        return F.struct(x["word_no"].alias("word_no"), x["nth"].alias("nth"), x["secret"].alias("secret"), (total / (1000.0 * len(forest))).alias("score"))

    return F.filter(F.transform(described, scored), lambda x: x["score"] >= threshold)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", forest: tuple[Tree, ...] | None = None) -> DataFrame:
    """(id, word_no, nth, secret, score): one row a confirmed finding."""
    words = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("own"), F.col(path_col).alias("path"), F.split(text_col, _WORD).alias("words"))
    found = words.select("own", findings(F.col("words"), F.col("path"), forest).alias("found"))
    # Outer: else the optimizer tests for an empty array before the words are split, and so splits for every use.
    return found.select("own", F.inline_outer("found")).filter(F.col("secret").isNotNull()).select(F.col("own").alias(id_col), "word_no", "nth", "secret", F.round("score", 6).alias("score"))


def redact(docs: DataFrame, text_col: str = "text", path_col: str = "source", forest: tuple[Tree, ...] | None = None) -> DataFrame:
    """The documents, confirmed secrets masked in their texts; all other columns stay as they are, whatever their names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, path = (names[docs.columns.index(c)] for c in (text_col, path_col))
    secret = F.transform(findings(F.col("words"), F.col(path), forest), lambda x: x["secret"])
    # The longest first: a secret that is part of another must not break it.
    longest = F.array_sort(F.array_distinct(secret), lambda a, b: F.length(b) - F.length(a))
    found = docs.toDF(*names).withColumn("words", F.split(text, _WORD)).withColumn("found", longest)
    masked = found.withColumn(text, F.aggregate("found", F.col(text), lambda t, s: F.replace(t, s, F.lit(MASK))))
    return masked.select(*names).toDF(*docs.columns)


def findings_sql(table: str = "documents", forest: tuple[Tree, ...] | None = None, threshold: float = THRESHOLD) -> str:
    """(doc_id, word_no, nth, secret, score) of the same findings."""
    forest = forest or default_forest()
    cols = ", ".join(f"{f} as {k}" for f, k in zip(features_sql(), NAMES, strict=True))
    score = " + ".join(_tree_sql(t) for t in forest)
    return f"""
with w as (select doc_id, coalesce(source, '') as path, regexp_split_to_array(text, '{_WORD}') as w from {table} where text is not null),
i as (select doc_id, path, w, unnest(list_filter(range(len(w)), lambda j: length(w[j + 1]) >= {MIN_CHARS})) as i from w),
c as (select doc_id, path, i, w[i + 1] as word, case when i >= 2 then w[i - 1] || ' ' else '' end || case when i >= 1 then w[i] else '' end as near, concat_ws(' ', w[i + 2], w[i + 3]) as after, regexp_extract_all(w[i + 1], '{_TOKEN}') as found from i),
n as (select doc_id, path, i as word_no, word, near, after, found, unnest(range(len(found))) as nth from c),
x as (select doc_id, path, word_no, nth, after, found[nth + 1] as c, near || ' ' || string_split(word, found[nth + 1])[1] as before from n),
f as (select doc_id, word_no, nth, c, {cols} from x),
s as (select doc_id, word_no, nth, c, ({score}) / {1000.0 * len(forest)} as score from f)
select doc_id, cast(word_no as int) as word_no, cast(nth as int) as nth, c as secret, round(score, 6) as score from s where score >= {threshold}"""
