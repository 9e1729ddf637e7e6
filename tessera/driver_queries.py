"""Queries over the driver's tables, and hand-written SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.views import CODE, TABLES, code, tables

# -- over projections of the tables: name -> (relations, program, SQL)

_EDGE, _UP = TABLES["edge"][1], TABLES["up"][1]
_CLOSED = f"WITH RECURSIVE edge AS ({_EDGE}), tc AS (SELECT a, b FROM edge UNION SELECT tc.a, edge.b FROM tc JOIN edge ON tc.b = edge.a) "
_TREE = f"WITH RECURSIVE up AS ({_UP}), w AS (SELECT c, p FROM up UNION SELECT up.c, w.p FROM up JOIN w ON up.p = w.c) "
_TC = "tc(X, Y) :- edge(X, Y). tc(X, Z) :- tc(X, Y), edge(Y, Z). "

PROGRAMS: dict[str, tuple[str, str, str]] = {
    "scan": ("nation", "?- nation(N, Name, R).", "SELECT n_nationkey AS n, n_name AS name, n_regionkey AS r FROM nation"),
    "filter_const": ("customer", '?- customer(C, N, "BUILDING").', "SELECT c_custkey AS c, c_nationkey AS n FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_wrong_type": ("customer", '?- customer(C, "7", Seg).', "SELECT c_custkey AS c, c_mktsegment AS seg FROM customer WHERE 1 = 0"),
    "wildcard": ("orders", "?- orders(_, _, S, P).", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "cmp_eq": ("part", "?- part(P, _, _, _, S), P = S.", "SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s FROM part WHERE p_partkey = p_size"),
    "cmp_ne": ("nation", "?- nation(N, _, R), N != R.", "SELECT n_nationkey AS n, n_regionkey AS r FROM nation WHERE n_nationkey <> n_regionkey"),
    "cmp_lt": ("part", "?- part(P, _, _, _, S), S < 10.", "SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s FROM part WHERE p_size < 10"),
    "cmp_le": ("part", "?- part(P, _, _, _, S), S <= 10.", "SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s FROM part WHERE p_size <= 10"),
    "cmp_gt": ("part", "?- part(P, _, _, _, S), S > 40.", "SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s FROM part WHERE p_size > 40"),
    "cmp_ge": ("part", "?- part(P, _, _, _, S), S >= 40.", "SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s FROM part WHERE p_size >= 40"),
    "arith_add": ("part", "?- part(P, _, _, _, S), T = P + S.", "SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s, CAST(p_partkey + p_size AS BIGINT) AS t FROM part"),
    "arith_sub": ("part", "?- part(P, _, _, _, S), T = 50 - S.", "SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s, CAST(50 - p_size AS BIGINT) AS t FROM part"),
    "arith_mul": ("part", "?- part(P, _, _, _, S), T = S * S.", "SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s, CAST(p_size * p_size AS BIGINT) AS t FROM part"),
    "arith_div": ("part", "?- part(P, _, _, _, S), T = P / S.", "SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s, CAST(p_partkey // p_size AS BIGINT) AS t FROM part"),
    "str_prefix": ("part", '?- part(P, _, B, _, _), prefix(B, "Brand#1").', "SELECT p_partkey AS p, p_brand AS b FROM part WHERE starts_with(p_brand, 'Brand#1')"),
    "str_suffix": ("part", '?- part(P, _, B, _, _), suffix(B, "3").', "SELECT p_partkey AS p, p_brand AS b FROM part WHERE ends_with(p_brand, '3')"),
    "str_contains": ("part", '?- part(P, N, _, _, _), contains(N, "ol").', "SELECT p_partkey AS p, p_name AS n FROM part WHERE contains(p_name, 'ol')"),
    "str_match": ("part", '?- part(P, N, _, _, _), match(N, "^(red|blue) .*[rt]$").', "SELECT p_partkey AS p, p_name AS n FROM part WHERE regexp_matches(p_name, '^(red|blue) .*[rt]$')"),
    "str_on_int": ("part", '?- part(P, N, _, _, S), contains(S, "1").', "SELECT p_partkey AS p, p_name AS n, CAST(p_size AS BIGINT) AS s FROM part WHERE 1 = 0"),
    "assign_const": ("region", '?- region(R, N), K = "region".', "SELECT r_regionkey AS r, r_name AS n, 'region' AS k FROM region"),
    "join_inner": ("orders customer nation", "?- orders(O, C, _, P), customer(C, N, _), nation(N, Name, _).", "SELECT o_orderkey AS o, c_custkey AS c, o_orderpriority AS p, n_nationkey AS n, n_name AS name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"),
    "join_theta": ("nation", "?- nation(N, _, R), nation(M, _, R), N < M.", "SELECT a.n_nationkey AS n, a.n_regionkey AS r, b.n_nationkey AS m FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_self": ("supplier", "?- supplier(S, N), supplier(T, N), S != T.", "SELECT a.s_suppkey AS s, a.s_nationkey AS n, b.s_suppkey AS t FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey"),
    "join_cross": ("region nation", "?- region(R, _), nation(N, _, _).", "SELECT r_regionkey AS r, n_nationkey AS n FROM region CROSS JOIN nation"),
    "join_semi": ("customer orders", '?- customer(C, N, _), orders(_, C, "F", _).', "SELECT c_custkey AS c, c_nationkey AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "anti_ground": ("orders li", '?- orders(O, C, _, _), !hot(O). hot(O) :- li(O, _, _, _, "R", _).', "SELECT o_orderkey AS o, o_custkey AS c FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "anti_exist": ("customer orders", '?- customer(C, N, _), !orders(_, C, "P", _).', "SELECT c_custkey AS c, c_nationkey AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "anti_global": ("region nation", '?- region(R, N), !nation(_, "nowhere", _).', "SELECT r_regionkey AS r, r_name AS n FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = 'nowhere')"),
    "between_check": ("part", "?- part(P, _, _, _, S), between(10, 20, S).", "SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s FROM part WHERE p_size BETWEEN 10 AND 20"),
    "count_group": ("nation customer", "?- nation(N, Name, _), K = count{ C : customer(C, N, _) }.", "SELECT n_nationkey AS n, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS k FROM nation"),
    "count_zero": ("customer orders", '?- customer(C, _, _), K = count{ O : orders(O, C, "P", _) }, K = 0.', "SELECT c_custkey AS c, CAST(0 AS BIGINT) AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "count_scalar": ("event", "?- N = count{ U : event(_, U, _) }.", "SELECT count(DISTINCT user_id) AS n FROM events"),
    "count_const": ("event", '?- N = count{ 1 : event(_, _, "click") }.', "SELECT CAST(count(*) > 0 AS BIGINT) AS n FROM events WHERE event_type = 'click'"),
    "count_nested": ("region nation customer", "?- region(R, _), K = count{ N : nation(N, _, R), M = count{ C : customer(C, N, _) }, M > 55 }.", "SELECT r_regionkey AS r, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) > 55) AS k FROM region"),
    "count_filter": ("supplier li", '?- supplier(S, _), K = count{ O : li(O, _, _, S, "R", _), !li(O, 1, _, S, _, _) }.', "SELECT s_suppkey AS s, (SELECT count(DISTINCT l_orderkey) FROM lineitem x WHERE x.l_suppkey = s_suppkey AND l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_linenumber = 1 AND y.l_suppkey = s_suppkey)) AS k FROM supplier"),
    "count_having": ("event", "?- user(U), K = count{ E : event(E, U, _) }, K > 60. user(U) :- event(_, U, _).", "SELECT user_id AS u, count(*) AS k FROM events GROUP BY user_id HAVING count(*) > 60"),
    "count_scoped": ("nation region", "?- A = count{ X : nation(X, _, _) }, B = count{ X : region(X, _) }.", "SELECT (SELECT count(*) FROM nation) AS a, (SELECT count(*) FROM region) AS b"),
    "union": ("customer supplier", "?- there(N). there(N) :- customer(_, N, _). there(N) :- supplier(_, N).", "SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier"),
    "intersect": ("doc label", '?- doc(D, "en", _), label(D, 1, _).', "SELECT doc_id AS d FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1"),
    "except": ("doc label", "?- doc(D, L, _), !label(D, _, _).", "SELECT doc_id AS d, lang AS l FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "distinct": ("turn", "?- turn(_, T, R).", "SELECT DISTINCT turn AS t, role AS r FROM conversations"),
    "facts_inline": ("region", 'alias("ASIA", "east"). alias("EUROPE", "west"). ?- region(R, N), alias(N, A).', "SELECT r_regionkey AS r, r_name AS n, CASE r_name WHEN 'ASIA' THEN 'east' ELSE 'west' END AS a FROM region WHERE r_name IN ('ASIA', 'EUROPE')"),
    "rule_user": ("orders customer", 'big(C) :- customer(C, _, "MACHINERY"). ?- big(C), orders(O, C, "O", _).', "SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_orderstatus = 'O'"),
    "tc_right": ("up", "w(C, P) :- up(C, P). w(C, A) :- up(C, P), w(P, A). ?- w(C, A).", _TREE + "SELECT c, p AS a FROM w"),
    "tc_right_seeded": ("up", "w(C, P) :- up(C, P). w(C, A) :- up(C, P), w(P, A). ?- w(150, A).", _TREE + "SELECT p AS a FROM w WHERE c = 150"),
    "tc_doubling": ("up", "w(C, P) :- up(C, P). w(C, A) :- w(C, P), w(P, A). ?- w(C, 3).", _TREE + "SELECT c FROM w WHERE p = 3"),
    # nodes of a tree are of one generation where they are as deep, which SQL can say without the recursion over pairs
    "same_generation": ("up", "sg(X, Y) :- up(X, P), up(Y, P). sg(X, Y) :- up(X, A), up(Y, B), sg(A, B). ?- sg(37, Y).", f"WITH RECURSIVE up AS ({_UP}), d AS (SELECT CAST(0 AS BIGINT) AS x, 0 AS k UNION SELECT up.c, d.k + 1 FROM up JOIN d ON up.p = d.x) SELECT x AS y FROM d WHERE k = (SELECT k FROM d WHERE x = 37)"),
    "mutual": ("up", "even(0). even(C) :- up(C, P), odd(P). odd(C) :- up(C, P), even(P). ?- even(X).", f"WITH RECURSIVE up AS ({_UP}), d AS (SELECT CAST(0 AS BIGINT) AS x, 0 AS k UNION SELECT up.c, 1 - d.k FROM up JOIN d ON up.p = d.x) SELECT x FROM d WHERE k = 0"),
    "repeated_var": ("edge", "?- edge(X, X).", f"WITH edge AS ({_EDGE}) SELECT a AS x FROM edge WHERE a = b"),
    "tc_linear": ("edge", _TC + "?- tc(X, Y).", _CLOSED + "SELECT a AS x, b AS y FROM tc"),
    "tc_seeded": ("edge", _TC + "?- tc(5, Y).", _CLOSED + "SELECT b AS y FROM tc WHERE a = 5"),
    "tc_seeded_end": ("edge", _TC + "?- tc(X, 5).", _CLOSED + "SELECT a AS x FROM tc WHERE b = 5"),
    "tc_sideways": ("edge region", _TC + '?- region(R, "ASIA"), tc(R, Y).', _CLOSED + "SELECT CAST(r_regionkey AS BIGINT) AS r, b AS y FROM tc JOIN region ON a = r_regionkey WHERE r_name = 'ASIA'"),
    "stratified": ("edge", _TC + "loop(X) :- tc(X, X). node(X) :- edge(X, _). ?- node(X), !loop(X).", _CLOSED + "SELECT DISTINCT a AS x FROM edge WHERE a NOT IN (SELECT a FROM tc WHERE a = b)"),
    "between_gen": ("part", "?- part(P, _, _, _, S), between(S, 5, X).", "SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s, CAST(x AS BIGINT) AS x FROM part, range(0, 6) t(x) WHERE x >= p_size"),
    # spans grow with the line number: equal lengths never contain each other
    "containment": ("li", "?- span(P, A, B), span(P, C, D), A <= C, D <= B, A < C. span(P, A, B) :- li(A, L, P, _, _, _), K = L * 300, B = A + K.", "WITH span AS (SELECT DISTINCT l_partkey AS p, l_orderkey AS a, CAST(l_orderkey + 300 * l_linenumber AS BIGINT) AS b FROM lineitem) SELECT x.p, x.a, x.b, y.a AS c, y.b AS d FROM span x JOIN span y ON x.p = y.p AND x.a <= y.a AND y.b <= x.b AND x.a < y.a"),
    "ground_goal": ("region", '?- region(_, "ASIA").', "SELECT true AS holds WHERE EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA')"),
    "mixed_column": ("region", "v(X) :- region(X, _). v(N) :- region(_, N). ?- v(X).", "SELECT concat('i:', r_regionkey) AS x FROM region UNION SELECT concat('s:', r_name) FROM region"),
}

# -- over the code graph: every predicate of the rule library

_REF = "ref(Sym, Path, Row, At, Src, Role, Prov)"
#: Derived relations in SQL, written by hand.
DERIVED = """
exported AS (SELECT s FROM visibility WHERE vis = 'public' UNION SELECT d.s FROM name_export e JOIN def d ON d.f = e.f AND d.name = e.name
  UNION SELECT v.s FROM exported x JOIN parent p ON p.parent = x.s JOIN visibility v ON v.s = p.child WHERE v.vis = 'inherited'),
ambiguous AS (SELECT name FROM def GROUP BY name HAVING count(DISTINCT s) > 1),
open_def AS (SELECT DISTINCT d.s, d.name FROM def d JOIN exported x ON x.s = d.s WHERE d.name NOT IN (SELECT name FROM ambiguous)),
trait_sym AS (SELECT DISTINCT s FROM def WHERE kind IN ('trait', 'interface', 'class')),
written AS (SELECT f, type AS name FROM name_impl UNION SELECT f, trait FROM name_impl),
impl_sym AS (SELECT w.f, w.name AS n, d.s FROM written w JOIN def d ON d.f = w.f AND d.name = w.name
  UNION SELECT w.f, w.name, o.s FROM written w JOIN open_def o ON o.name = w.name WHERE NOT EXISTS (SELECT 1 FROM def l WHERE l.f = w.f AND l.name = w.name)),
implements AS (SELECT s, t, 'exact' AS prov FROM scip_impl
  UNION SELECT a.s, b.s, 'name' FROM name_impl i JOIN impl_sym a ON a.f = i.f AND a.n = i.type JOIN impl_sym b ON b.f = i.f AND b.n = i.trait
    WHERE b.s IN (SELECT s FROM trait_sym) AND a.s <> b.s AND NOT EXISTS (SELECT 1 FROM scip_impl x WHERE x.s = a.s AND x.t = b.s)),
scip_claim AS (SELECT DISTINCT f, line, col FROM scip_ref WHERE s IN (SELECT s FROM def UNION SELECT s FROM extern)),
loose AS (SELECT * FROM name_ref n WHERE NOT EXISTS (SELECT 1 FROM scip_claim c WHERE c.f = n.f AND c.line = n.line AND c.col = n.col)),
ref AS (SELECT s, f, line, col, fr, role, 'exact' AS prov FROM scip_ref WHERE s IN (SELECT s FROM def UNION SELECT s FROM extern)
  UNION SELECT d.s, n.f, n.line, n.col, n.fr, 'read', 'name' FROM loose n JOIN def d ON d.f = n.f AND d.name = n.name
  UNION SELECT o.s, n.f, n.line, n.col, n.fr, 'read', 'name' FROM loose n JOIN open_def o ON o.name = n.name WHERE NOT EXISTS (SELECT 1 FROM def l WHERE l.f = n.f AND l.name = n.name)),
symbol_at AS (SELECT DISTINCT d.f, CAST(unnest(range(l1, l2 + 1)) AS BIGINT) AS line, d.s FROM def d JOIN def_span p ON p.s = d.s),
width AS (SELECT s, max(l2 - l1) AS widest, min(l2 - l1) AS narrowest FROM def_span GROUP BY s),
tighter_at AS (SELECT DISTINCT a.f, a.line, a.s FROM symbol_at a JOIN symbol_at b ON a.f = b.f AND a.line = b.line AND a.s <> b.s JOIN width u ON u.s = a.s JOIN width v ON v.s = b.s WHERE u.widest > v.narrowest),
callable AS (SELECT unnest(['function', 'method', 'constructor', 'macro']) AS kind),
calls_at AS (SELECT DISTINCT r.fr, r.s, r.f, r.line, r.prov FROM ref r JOIN def d ON d.s = r.s AND d.kind IN (SELECT kind FROM callable) JOIN def e ON e.s = r.fr AND e.kind <> 'module'),
calls AS (SELECT DISTINCT fr AS a, s AS b FROM calls_at),
calls_exact AS (SELECT DISTINCT fr AS a, s AS b FROM calls_at WHERE prov = 'exact'),
reaches AS (SELECT a, b FROM calls UNION SELECT r.a, c.b FROM reaches r JOIN calls c ON c.a = r.b),
reaches_exact AS (SELECT a, b FROM calls_exact UNION SELECT r.a, c.b FROM reaches_exact r JOIN calls_exact c ON c.a = r.b),
within AS (SELECT child AS c, parent AS a FROM parent UNION SELECT p.child, w.a FROM parent p JOIN within w ON w.c = p.parent),
place AS (SELECT DISTINCT d.s, d.f, d.name, p.l1 AS line FROM def d JOIN def_span p ON p.s = d.s),
is_test AS (SELECT f FROM file WHERE regexp_matches(f, '(^|/)(tests?|__tests__)/') OR regexp_matches(f, '_test\\.(go|py|rs)$') OR regexp_matches(f, '(^|/)(test_[^/]*|tests|conftest)\\.py$') OR regexp_matches(f, '\\.(test|spec)\\.(ts|tsx|js|jsx)$')
  UNION SELECT f FROM scip_ref WHERE role = 'test'),
depends AS (SELECT DISTINCT r.f, d.f AS g, r.prov FROM ref r JOIN def d ON d.s = r.s WHERE d.f <> r.f),
ref_outside AS (SELECT DISTINCT d.s, d.f, r.prov FROM ref r JOIN def d ON d.s = r.s WHERE r.f <> d.f),
dead_export AS (SELECT DISTINCT d.s FROM def d JOIN exported x ON x.s = d.s WHERE NOT EXISTS (SELECT 1 FROM ref_outside o WHERE o.s = d.s AND o.f = d.f)),
dead_export_exact AS (SELECT DISTINCT d.s FROM def d JOIN exported x ON x.s = d.s JOIN resolved z ON z.s = d.s WHERE NOT EXISTS (SELECT 1 FROM ref_outside o WHERE o.s = d.s AND o.f = d.f AND o.prov = 'exact')),
entrypoint AS (SELECT DISTINCT s FROM def WHERE kind IN (SELECT kind FROM callable) AND s NOT IN (SELECT b FROM calls)),
entrypoint_exact AS (SELECT DISTINCT s FROM def WHERE kind IN (SELECT kind FROM callable) AND s IN (SELECT s FROM resolved) AND s NOT IN (SELECT b FROM calls_exact)),
uses_package AS (SELECT DISTINCT r.f, e.package AS p, r.prov FROM ref r JOIN extern e ON e.s = r.s),
about AS (SELECT s, 'sig' AS rel, sig AS a, '' AS b, CAST(0 AS BIGINT) AS l FROM def_sig UNION SELECT s, 'doc', doc, '', 0 FROM def_doc UNION SELECT s, 'defined', f, name, line FROM place
  UNION SELECT p.child, 'parent', x.f, x.name, x.line FROM parent p JOIN place x ON x.s = p.parent UNION SELECT c.b, 'caller', x.f, x.name, x.line FROM calls c JOIN place x ON x.s = c.a
  UNION SELECT c.a, 'callee', x.f, x.name, x.line FROM calls c JOIN place x ON x.s = c.b UNION SELECT i.s, 'implements', x.f, x.name, x.line FROM implements i JOIN place x ON x.s = i.t
  UNION SELECT i.t, 'implementor', x.f, x.name, x.line FROM implements i JOIN place x ON x.s = i.s UNION SELECT c.b, 'test', x.f, x.name, x.line FROM calls c JOIN place x ON x.s = c.a WHERE x.f IN (SELECT f FROM is_test)
  UNION SELECT s, 'extern', package, version, 0 FROM extern)
"""

#: name -> (goal, SQL over DERIVED)
CODE_QUERIES: dict[str, tuple[str, str]] = {
    "d01_exported": ("?- exported(S).", "SELECT s FROM exported"),
    "d02_implements": ("?- implements(S, T, Prov).", "SELECT s, t, prov FROM implements"),
    "d03_trait_sym": ("?- trait_sym(S).", "SELECT s FROM trait_sym"),
    "d04_impl_sym": ("?- impl_sym(F, N, S).", "SELECT f, n, s FROM impl_sym"),
    "d05_scip_claim": ("?- scip_claim(F, Line, Col).", "SELECT f, line, col FROM scip_claim"),
    "d06_ref": ("?- ref(S, F, Line, Col, Fr, Role, Prov).", "SELECT s, f, line, col, fr, role, prov FROM ref"),
    "d07_local_def": ("?- local_def(F, N).", "SELECT DISTINCT f, name AS n FROM def"),
    "d08_named": ("?- named(N).", "SELECT DISTINCT name AS n FROM def"),
    "d09_ambiguous": ("?- ambiguous(N).", "SELECT name AS n FROM ambiguous"),
    "d10_symbol_at": ("?- symbol_at(F, Line, S).", "SELECT f, line, s FROM symbol_at"),
    "d11_innermost_at": ("?- innermost_at(F, Line, S).", "SELECT f, line, s FROM symbol_at EXCEPT SELECT f, line, s FROM tighter_at"),
    "d12_tighter_at": ("?- tighter_at(F, Line, S).", "SELECT f, line, s FROM tighter_at"),
    "d13_callable": ("?- callable(K).", "SELECT kind AS k FROM callable"),
    "d14_calls_at": ("?- calls_at(Fr, S, F, L, Prov).", "SELECT fr, s, f, line AS l, prov FROM calls_at"),
    "d15_calls": ("?- calls(A, B).", "SELECT a, b FROM calls"),
    "d16_calls_exact": ("?- calls_exact(A, B).", "SELECT a, b FROM calls_exact"),
    "d17_impact_of": ('?- def(S, _, _, "fn_752"), impact_of(S, C).', "SELECT DISTINCT d.s, r.a AS c FROM def d JOIN reaches r ON r.b = d.s WHERE d.name = 'fn_752'"),
    "d17_impact_of_const": ('?- impact_of("sym 752", C).', "SELECT a AS c FROM reaches WHERE b = 'sym 752'"),
    "d18_reach_of": ('?- reach_of("sym 1953", C).', "SELECT b AS c FROM reaches WHERE a = 'sym 1953'"),
    "d19_impact_of_exact": ('?- impact_of_exact("sym 752", C).', "SELECT a AS c FROM reaches_exact WHERE b = 'sym 752'"),
    "d20_reach_of_exact": ('?- reach_of_exact("sym 1953", C).', "SELECT b AS c FROM reaches_exact WHERE a = 'sym 1953'"),
    "d21_reaches": ("?- reaches(A, B).", "SELECT a, b FROM reaches"),
    "d22_recursive": ("?- recursive(S).", "SELECT a AS s FROM reaches WHERE a = b"),
    "d23_reaches_exact": ("?- reaches_exact(A, B).", "SELECT a, b FROM reaches_exact"),
    "d24_recursive_exact": ("?- recursive_exact(S).", "SELECT a AS s FROM reaches_exact WHERE a = b"),
    "d25_file_of": ("?- file_of(S, F).", "SELECT DISTINCT s, f FROM def"),
    "d26_at": ("?- at(S, F, L).", "SELECT DISTINCT s, f, line AS l FROM place"),
    "d27_within": ("?- within(C, A).", "SELECT c, a FROM within"),
    "d27_within_seeded": ('?- within("sym 150", A).', "SELECT a FROM within WHERE c = 'sym 150'"),
    "d28_is_test": ("?- is_test(F).", "SELECT f FROM is_test"),
    "d29_about": ("?- about(S, Rel, A, B, L).", "SELECT s, rel, a, b, l FROM about"),
    "d30_depends": ("?- depends(F, G).", "SELECT DISTINCT f, g FROM depends"),
    "d31_dead_export": ("?- dead_export(S).", "SELECT s FROM dead_export"),
    "d32_ref_outside": ("?- ref_outside(S, F).", "SELECT DISTINCT s, f FROM ref_outside"),
    "d33_entrypoint": ("?- entrypoint(S).", "SELECT s FROM entrypoint"),
    "d34_def_lines": ("?- def_lines(S, N).", "SELECT DISTINCT s, l2 - l1 + 1 AS n FROM def_span"),
    "d35_undocumented_export": ("?- undocumented_export(S).", "SELECT s FROM exported WHERE s NOT IN (SELECT s FROM def_doc)"),
    "d36_uses_package": ("?- uses_package(F, P).", "SELECT DISTINCT f, p FROM uses_package"),
    "d37_dead_export_exact": ("?- dead_export_exact(S).", "SELECT s FROM dead_export_exact"),
    "d38_ref_outside_exact": ("?- ref_outside_exact(S, F).", "SELECT s, f FROM ref_outside WHERE prov = 'exact'"),
    "d39_entrypoint_exact": ("?- entrypoint_exact(S).", "SELECT s FROM entrypoint_exact"),
    "d40_depends_exact": ("?- depends_exact(F, G).", "SELECT f, g FROM depends WHERE prov = 'exact'"),
    "d41_uses_package_exact": ("?- uses_package_exact(F, P).", "SELECT f, p FROM uses_package WHERE prov = 'exact'"),
    "d42_tier": (
        "?- tier(Rel, A, B, Prov).",
        """SELECT 'calls' AS rel, a, b, CASE WHEN (a, b) IN (SELECT (a, b) FROM calls_exact) THEN 'exact' ELSE 'name' END AS prov FROM calls
        UNION ALL SELECT 'depends', f, g, min(prov) FROM depends GROUP BY f, g UNION ALL SELECT 'uses_package', f, p, min(prov) FROM uses_package GROUP BY f, p
        UNION ALL SELECT 'dead_export', s, '', CASE WHEN s IN (SELECT s FROM dead_export_exact) THEN 'exact' ELSE 'name' END FROM dead_export
        UNION ALL SELECT 'entrypoint', s, '', CASE WHEN s IN (SELECT s FROM entrypoint_exact) THEN 'exact' ELSE 'name' END FROM entrypoint""",
    ),
    "b1_functions": ('?- def(S, F, "function", N).', "SELECT DISTINCT s, f, name AS n FROM def WHERE kind = 'function'"),
    "b5_innermost_about": ('?- innermost_at("src/core/f3.rs", 12, S), about(S, Rel, A, B, L).', "SELECT s, rel, a, b, l FROM about WHERE s IN (SELECT s FROM symbol_at WHERE f = 'src/core/f3.rs' AND line = 12 AND s NOT IN (SELECT s FROM tighter_at WHERE f = 'src/core/f3.rs' AND line = 12))"),
    "b6_imports": ('?- import(F, M, _), prefix(F, "src/ui/"), contains(M, "db").', "SELECT DISTINCT f, module AS m FROM import WHERE starts_with(f, 'src/ui/') AND contains(module, 'db')"),
    "b7_dead_in_core": ('?- dead_export(S), file_of(S, F), prefix(F, "src/core/").', "SELECT DISTINCT d.s, d.f FROM dead_export x JOIN def d ON d.s = x.s WHERE starts_with(d.f, 'src/core/')"),
    "b8_fan_in": ('?- def(S, _, "function", _), N = count{ X : calls(X, S) }.', "SELECT DISTINCT d.s, (SELECT count(*) FROM calls WHERE b = d.s) AS n FROM def d WHERE kind = 'function'"),
    "anchor_join": ("?- def(S, F, _, _), def_name(S, Line, Col), scip_ref(T, F, Line, Col, _, _).", "SELECT DISTINCT d.s, d.f, n.line, n.col, r.s AS t FROM def d JOIN def_name n ON n.s = d.s JOIN scip_ref r ON r.f = d.f AND r.line = n.line AND r.col = n.col"),
}


def _program(relations: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = tables(spark, sf_dir, *relations.split()).dataframe(text)
        return df.toDF(*(c.lower() for c in df.columns))

    return run


def _code(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = code(spark, sf_dir).dataframe(text)
        return df.toDF(*(c.lower() for c in df.columns))

    return run


def widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir, "customer", "supplier")
    e.load_rules("there(N) :- customer(_, N, _).")
    e.load_rules("there(N) :- supplier(S, N), S < 5.")
    return e.dataframe("?- there(N).").toDF("n")


def shadowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir, "region")
    e.load_rules("r(N) :- region(_, N).")
    return e.dataframe('r(N) :- region(K, N), K < 2. ?- r(N).').toDF("n")


def limit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap on rows as a feature: the first ones in the order of the rendered rows."""
    a = tables(spark, sf_dir, "part").query('?- part(P, N, "Brand#11", _, _).', limit=20)
    return spark.createDataFrame(a.rows, "p bigint, n string")


def span_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.sweep import innermost_enclosing
    from tessera.sources.views import register, relation

    register(spark, sf_dir)
    spans = relation(spark, "def").join(relation(spark, "def_span"), "s").select("f", "s", "b1", F.expr("b2 + 1000 * (l2 - l1)").alias("b2"))
    return innermost_enclosing(spans, "f", "s", "b1", "b2")


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.census import census as of

    return of(code(spark, sf_dir))


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.census import collisions as of

    e = tables(spark, sf_dir, "li")
    return of(e.base["li"][0].select(F.col("c2").alias("s"), F.col("c3").alias("f")))


def collisions_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.census import collisions_at as of

    e = code(spark, sf_dir)
    e.fill({"scip_ref"})
    return of(e.base["scip_ref"][0].toDF("s", "f", "line", "col", "fr", "role"))


_SWEEP = f"""WITH {CODE}, x AS (SELECT d.f, d.s, b1, b2 + 1000 * (l2 - l1) AS b2, row_number() OVER (PARTITION BY d.f ORDER BY b1, b2 + 1000 * (l2 - l1) DESC, d.s) AS k FROM def d JOIN def_span p ON p.s = d.s),
owned AS (SELECT a.f, a.k, max(b.k) AS o FROM x a JOIN x b ON a.f = b.f AND b.k < a.k AND b.b2 > a.b1 GROUP BY a.f, a.k)
SELECT x.f, x.s, y.s AS owner FROM x LEFT JOIN owned w ON w.f = x.f AND w.k = x.k LEFT JOIN x y ON y.f = w.f AND y.k = w.o"""
_RELATIONS = "file def def_span def_name def_sig def_doc parent visibility resolved import scip_ref name_ref scip_impl name_impl extern name_export".split()

EXTRA: dict[str, tuple[Callable, str]] = {
    "widen": (widened, "SELECT CAST(c_nationkey AS BIGINT) AS n FROM customer UNION SELECT CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_suppkey < 5"),
    "shadow": (shadowed, "SELECT r_name AS n FROM region WHERE r_regionkey < 2"),
    "limit_rows": (limit_rows, "SELECT p_partkey AS p, p_name AS n FROM part WHERE p_brand = 'Brand#11' ORDER BY CAST(p_partkey AS VARCHAR), p_name LIMIT 20"),
    "span_sweep": (span_sweep, _SWEEP),
    "census": (census, f"WITH {CODE} " + " UNION ALL ".join(f"SELECT '{r}' AS what, '' AS value, count(*) AS n FROM {r}" for r in _RELATIONS) + " UNION ALL SELECT 'kind', kind, count(*) FROM def GROUP BY kind UNION ALL SELECT 'role', role, count(*) FROM scip_ref GROUP BY role UNION ALL SELECT 'language', lang, count(*) FROM file GROUP BY lang UNION ALL SELECT 'anchored', '', count(DISTINCT s) FROM def WHERE s IN (SELECT s FROM resolved)"),
    "collisions_at": (collisions_at, f"WITH {CODE} SELECT f, line, col, count(DISTINCT s) AS n FROM scip_ref GROUP BY f, line, col HAVING count(DISTINCT s) > 1"),
    "collisions": (collisions, "SELECT CAST(l_partkey AS BIGINT) AS s, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1"),
}


def _wide(sql: str) -> str:
    """The 32-bit columns that a query returns, as BIGINT."""
    return re.sub(r"((?:\b[a-z]\.)?\b(?:n_nationkey|n_regionkey|r_regionkey|c_nationkey|s_nationkey)) AS (\w+)\b(?!\))", r"CAST(\1 AS BIGINT) AS \2", sql)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(CODE_QUERIES["b6_imports"][0])(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _program(v[0], v[1]) for k, v in PROGRAMS.items()} | {k: _code(v[0]) for k, v in CODE_QUERIES.items()} | {k: v[0] for k, v in EXTRA.items()}


def oracle_sql() -> dict[str, str]:
    return {k: _wide(v[2]) for k, v in PROGRAMS.items()} | {k: f"WITH RECURSIVE {CODE}, {DERIVED} {v[1]}" for k, v in CODE_QUERIES.items()} | {k: v[1] for k, v in EXTRA.items()}
