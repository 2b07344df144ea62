"""Documentation records made from the shared tables, as selects that both engines read.

A nation stands for a domain, a part for a feature, an order for a use case, a line for an entry
point, a step or a rule, a supplier for a source file.
"""

from __future__ import annotations


def text(x: str) -> str:
    return f"cast({x} as string)"


def score(x: str, parts: int, none: int) -> str:
    """Tenths or the like of a number, null for every so many."""
    return f"case when {x} % {none} = 0 then null else cast({x} % {parts} as double) / {parts} end"


DOMAINS = f"select n_nationkey as pos, concat('d', {text('n_nationkey')}) as slug, n_name as name, {score('n_nationkey', 10, 5)} as confidence from nation"
FEATURES = f"""select p_partkey as pos, concat('feature-', {text('p_partkey')}) as slug, concat('d', {text('p_size % 30')}) as domain, p_name as name,
  p_partkey % 7 = 0 as back_office, p_partkey % 11 = 0 as technical, {score('p_partkey', 10, 4)} as confidence from part"""
USE_CASES = f"""select o_orderkey as pos, concat('uc-', {text('o_orderkey')}) as slug, concat('feature-', {text('o_custkey')}) as feature, {score('o_orderkey', 10, 6)} as confidence,
  {score('o_orderkey', 8, 5)} as business, {score('o_orderkey', 4, 3)} as narrative_check from orders"""
FILES = f"select s_suppkey as pos, concat('src/m', {text('s_suppkey % 9')}, '/file_', {text('s_suppkey')}, '.py') as path, s_name as name, s_nationkey as nation from supplier"
_FILE = f"concat('src/m', {text('l_suppkey % 9')}, '/file_', {text('l_suppkey')}, '.py')"
LINES = f"""select l_orderkey * 10 + l_linenumber as pos, {_FILE} as path, concat('feature-', {text('l_partkey')}) as feature, concat('uc-', {text('l_orderkey')}) as use_case,
  concat('op', {text('l_partkey % 40')}) as name, concat({_FILE}, '#op', {text('l_partkey % 40')}) as id, concat('r', {text('l_suppkey % 60')}) as resource, l_returnflag as kind, l_linenumber as nth,
  cast(l_quantity as bigint) as start_line, cast(l_quantity as bigint) + l_linenumber as end_line, l_partkey as part, l_suppkey as supplier from lineitem"""
