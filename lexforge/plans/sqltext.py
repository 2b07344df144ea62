"""The text scalars as DuckDB SQL, for the queries' oracles."""

from __future__ import annotations

from lexforge.functions import text as T


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listing(words: list[str]) -> str:
    return ", ".join(lit(w) for w in words)


def tokens(x: str) -> str:
    hump = rf"regexp_replace({x}, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g')"
    split = rf"list_filter(regexp_split_to_array(translate(lower({hump}), '{T.SEARCH_ACCENTS[0]}', '{T.SEARCH_ACCENTS[1]}'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"list_transform({split}, lambda w: case when length(w) > 3 and suffix(w, 's') and not suffix(w, 'ss') then w[:-2] else w end)"


def query_terms(x: str) -> str:
    return f"list_sort(list_distinct(list_filter({tokens(x)}, lambda w: w not in ({listing(T.stop_terms())}))))"


def normalized(x: str) -> str:
    low = rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"
    return f"(case when suffix({low}, 's') and strlen({low}) > 4 then {low}[:-2] else {low} end)"


def folded(x: str) -> str:
    out = f"translate(regexp_replace(lower({x}), '[\\x{{0300}}-\\x{{036f}}]', '', 'g'), '{''.join(T.LATIN.values())}', '{''.join(k * len(v) for k, v in T.LATIN.items())}')"
    for a, b in T.LATIN_PAIRS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def slug(x: str) -> str:
    s = f"trim(regexp_replace({folded(x)}, '[^a-z0-9]+', ' ', 'g'))"
    return f"(case when {s} = '' then 'unnamed' else replace({s}, ' ', '-') end)"


def scored(docs: str, queries: str) -> str:
    """CTEs from docs(doc, text) and queries(query, text): s(query, doc, matched, score, held, terms, weight)."""
    return f"""
tok as (select doc, {tokens("coalesce(text, '')")} as t from ({docs})),
len as (select doc, len(t) as length from tok),
post as (select term, doc, count(*) as tf from (select doc, unnest(t) as term from tok) group by all),
stat as (select count(*)::double as n, avg(length) as mean from len),
qt as (select query, unnest(t) as term, len(t) as terms from (select query, {query_terms("coalesce(text, '')")} as t from ({queries}))),
dfs as (select term, count(*)::double as df from post group by term),
qi as (select query, qt.term, terms, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) as idf from qt left join dfs using (term), stat),
wt as (select query, sum(idf) as weight from qi group by query),
s0 as (select query, doc, count(*) as matched, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score, sum(idf) as held, any_value(terms) as terms from qi join post using (term) join len using (doc), stat group by query, doc),
s as (select * from s0 join wt using (query))"""


HALF = "matched * 2 >= terms"
RELEVANT = "matched * 2 >= terms and held > weight * 0.5 * (1 + 1e-5)"


def ranked(source: str, where: str, top: int | None) -> str:
    limit = f"qualify rank <= {top}" if top else ""
    return f"select query, row_number() over (partition by query order by round(score, 6) desc, doc) as rank, doc, matched, round(score, 6) as score from {source} where {where} {limit}"
