"""The SQL that callers may send, family by family, over contracts with an admit rule, and the same for DuckDB.

``{C}`` and its like stand for a contract's table here and for the admitted rows
of the raw table there. Where the dialects differ, the second text is DuckDB's.
"""

from __future__ import annotations

_ROWS = {
    "C": ("customer", "c_acctbal > -500", "row.c_acctbal > -500.0", "c_custkey c_name c_nationkey c_acctbal c_mktsegment"),
    "O": ("orders", "o_totalprice > 1000", "row.o_totalprice > 1000.0", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate"),
    "L": ("lineitem", "l_quantity >= 2", "row.l_quantity >= 2.0", "l_orderkey l_linenumber l_quantity l_discount l_returnflag l_linestatus"),
    "N": ("nation", "n_nationkey >= 0", "row.n_nationkey >= 0", "n_nationkey n_name n_regionkey"),
    "R": ("region", "r_regionkey < 4", "row.r_regionkey < 4", "r_regionkey r_name"),
}

DOCUMENTS = [{"contract": f"open/{t}", "binding": {"parquet": f"{t}.parquet"}, "expose": [{"name": n} for n in columns.split()], "rules": [{"id": "some", "op": "admit", "expr": rule}]} for t, _, rule, columns in _ROWS.values()]

_SQL: dict[str, str | tuple[str, str]] = {
    # joins
    "sql_join_right": "SELECT r_name, n_name FROM {R} r RIGHT JOIN {N} n ON r.r_regionkey = n.n_regionkey",
    "sql_join_full": "SELECT c.c_custkey, s.k FROM (SELECT * FROM {C} x WHERE c_custkey < 200) c FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM {O} o WHERE o_custkey BETWEEN 100 AND 300 GROUP BY o_custkey) s ON c.c_custkey = s.k",
    "sql_join_cross": "SELECT r_name, n_name FROM {R} r CROSS JOIN {N} n",
    "sql_join_theta": "SELECT a.n_name AS a, b.n_name AS b FROM {N} a JOIN {N} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_join_lateral": "SELECT r.r_name, x.n FROM {R} r, LATERAL (SELECT count(*) AS n FROM {N} n WHERE n.n_regionkey = r.r_regionkey) x",
    "sql_join_semi": "SELECT c_custkey FROM {C} c WHERE c_custkey IN (SELECT o_custkey FROM {O} o WHERE o_totalprice > 300000)",
    "sql_join_anti": "SELECT c_custkey FROM {C} c WHERE NOT EXISTS (SELECT 1 FROM {O} o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 200000)",
    "sql_not_in": "SELECT n_name FROM {N} n WHERE n_regionkey NOT IN (SELECT r_regionkey FROM {R} r WHERE r_regionkey > 1)",
    # aggregates
    "sql_sum_avg": "SELECT l_returnflag, sum(l_quantity) AS s, round(avg(l_discount), 6) AS a FROM {L} l GROUP BY l_returnflag",
    "sql_statistics": "SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 4) AS v, round(corr(l_quantity, l_discount), 6) AS r, round(covar_pop(l_quantity, l_discount), 6) AS cv FROM {L} l GROUP BY l_linestatus",
    "sql_percentile": ("SELECT o_orderstatus, round(median(o_totalprice), 4) AS m, round(percentile(o_totalprice, 0.9), 4) AS p FROM {O} o GROUP BY o_orderstatus", "SELECT o_orderstatus, round(median(o_totalprice), 4) AS m, round(quantile_cont(o_totalprice, 0.9), 4) AS p FROM {O} o GROUP BY o_orderstatus"),
    "sql_approximate": "SELECT abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) < 0.25 * count(DISTINCT o_custkey) AS near FROM {O} o",
    "sql_filter": "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 150000) AS n, sum(o_custkey) FILTER (WHERE o_custkey % 2 = 0) AS s FROM {O} o GROUP BY o_orderstatus",
    "sql_bool_bit": "SELECT n_regionkey, bool_and(n_nationkey > 3) AS a, bool_or(n_nationkey > 20) AS o, bit_xor(n_nationkey) AS x FROM {N} n GROUP BY n_regionkey",
    "sql_list": ("SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), '|') AS names FROM {N} n GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM {N} n GROUP BY n_regionkey"),
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM {L} l GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_grouping_sets": "SELECT l_returnflag, l_linestatus, max(l_quantity) AS m FROM {L} l GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "sql_having": "SELECT c_nationkey, count(*) AS n FROM {C} c GROUP BY c_nationkey HAVING count(*) > 55",
    "sql_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM {L} l",
    # windows
    "sql_ranks": "SELECT o_orderkey, row_number() OVER w AS rn, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, ntile(4) OVER w AS t FROM {O} o WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)",
    "sql_offsets": "SELECT o_orderkey, lag(o_orderkey, 2) OVER w AS a, lead(o_orderkey) OVER w AS b, first_value(o_orderkey) OVER w AS f, nth_value(o_orderkey, 2) OVER w AS s, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM {O} o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "sql_frames": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS near, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 2000 PRECEDING AND CURRENT ROW) AS upto FROM {O} o",
    # order, sets, subqueries
    "sql_order_offset": "SELECT c_custkey, c_acctbal FROM {C} c ORDER BY CASE WHEN c_acctbal > 9000 THEN NULL ELSE c_acctbal END DESC NULLS LAST, c_custkey LIMIT 15 OFFSET 5",
    "sql_nulls_first": "SELECT c_custkey FROM {C} c ORDER BY nullif(c_custkey % 50, 0) NULLS FIRST, c_custkey LIMIT 40",
    "sql_union_all": "SELECT n_regionkey AS k FROM {N} n UNION ALL SELECT r_regionkey FROM {R} r",
    "sql_intersect_all": "SELECT n_regionkey AS k FROM {N} n INTERSECT ALL SELECT c_nationkey FROM {C} c WHERE c_custkey < 90",
    "sql_except_all": "SELECT n_regionkey AS k FROM {N} n EXCEPT ALL SELECT r_regionkey FROM {R} r",
    "sql_except": "SELECT c_custkey AS k FROM {C} c EXCEPT SELECT o_custkey FROM {O} o WHERE o_totalprice > 200000",
    "sql_intersect": "SELECT c_custkey AS k FROM {C} c INTERSECT SELECT o_custkey FROM {O} o WHERE o_totalprice > 250000",
    "sql_scalar_subquery": "SELECT o_orderkey FROM {O} o WHERE o_totalprice > (SELECT 2 * avg(o_totalprice) FROM {O} p)",
    "sql_correlated": "SELECT c_custkey, (SELECT max(o_orderkey) FROM {O} o WHERE o.o_custkey = c.c_custkey) AS last FROM {C} c",
    "sql_values": "SELECT n.n_name, v.w FROM {N} n JOIN (VALUES (1, 'a'), (3, 'b'), (99, 'c')) AS v(k, w) ON n.n_nationkey = v.k",
    "sql_unnest": ("SELECT r_name, x FROM {R} r LATERAL VIEW explode(sequence(1, r_regionkey)) t AS x WHERE r_regionkey > 0", "SELECT r_name, unnest(range(1, r_regionkey + 1)) AS x FROM {R} r WHERE r_regionkey > 0"),
    "sql_reach": ("WITH RECURSIVE e AS (SELECT n_regionkey AS a, n_nationkey AS b FROM {N} n), t(id, depth) AS (SELECT 1, 0 UNION ALL SELECT e.b, t.depth + 1 FROM t JOIN e ON e.a = t.id WHERE t.depth < 3) SELECT DISTINCT id FROM t",) * 2,
    # functions
    "sql_strings": ("SELECT n_nationkey, length(n_name) AS n, lower(n_name) AS lo, lpad(n_name, 12, '.') AS p, substring(n_name, 2, 3) AS s, locate('A', n_name) AS at, replace(n_name, 'A', '_') AS r, concat_ws('-', n_name, 'x') AS c, regexp_replace(n_name, '[AEIOU]+', '*') AS v, trim(concat('  ', n_name, ' ')) AS t, n_name LIKE '%AN%' AS l, split(n_name, 'A')[0] AS f, reverse(n_name) AS b FROM {N} n", "SELECT n_nationkey, length(n_name) AS n, lower(n_name) AS lo, lpad(n_name, 12, '.') AS p, substring(n_name, 2, 3) AS s, instr(n_name, 'A') AS at, replace(n_name, 'A', '_') AS r, concat_ws('-', n_name, 'x') AS c, regexp_replace(n_name, '[AEIOU]+', '*', 'g') AS v, trim(concat('  ', n_name, ' ')) AS t, n_name LIKE '%AN%' AS l, split(n_name, 'A')[1] AS f, reverse(n_name) AS b FROM {N} n"),
    "sql_math": "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, cast(floor(c_acctbal / 7) AS bigint) AS f, cast(ceil(c_acctbal / 7) AS bigint) AS c, round(sqrt(abs(c_acctbal)), 6) AS q, round(power(c_custkey, 2), 3) AS p, round(ln(c_custkey + 1), 6) AS l, round(exp(c_custkey / 1000.0), 6) AS e, c_custkey % 7 AS m, cast(sign(c_acctbal) AS int) AS s, round(sin(c_custkey), 6) AS t FROM {C} c",
    "sql_dates": ("SELECT o_orderkey, year(o_orderdate) AS y, extract(month FROM o_orderdate) AS m, cast(date_trunc('month', o_orderdate) AS date) AS t, cast(date_add(cast(o_orderdate AS date), 10) AS date) AS a, datediff(cast(o_orderdate AS date), DATE '1992-01-01') AS d, date_format(o_orderdate, 'yyyy/MM') AS f, to_date('2020-02-03') AS c FROM {O} o", "SELECT o_orderkey, year(o_orderdate) AS y, extract(month FROM o_orderdate) AS m, cast(date_trunc('month', o_orderdate) AS date) AS t, cast(o_orderdate::date + INTERVAL 10 DAY AS date) AS a, datediff('day', DATE '1992-01-01', o_orderdate::date) AS d, strftime(o_orderdate, '%Y/%m') AS f, DATE '2020-02-03' AS c FROM {O} o"),
    "sql_conditions": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS k, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS s, greatest(c_custkey, 100) AS g, least(c_custkey, 100) AS l, try_cast(substring(c_name, 10, 20) AS int) AS n, cast(c_acctbal AS int) IS NULL AS u FROM {C} c",
    "sql_arrays": ("SELECT n_nationkey, size(a) AS n, element_at(a, 2) AS e, array_contains(a, 3) AS h, array_join(transform(filter(a, x -> x % 2 = 1), x -> x * 10), ',') AS t, array_join(slice(a, 2, 2), ',') AS s, array_join(array_distinct(flatten(array(a, a))), ',') AS f, exists(a, x -> x > 20) AS q FROM (SELECT n_nationkey, array(n_nationkey, n_regionkey, 3) AS a FROM {N} n) t", "SELECT n_nationkey, len(a) AS n, a[2] AS e, list_contains(a, 3) AS h, array_to_string(list_transform(list_filter(a, lambda x: x % 2 = 1), lambda x: x * 10), ',') AS t, array_to_string(a[2:3], ',') AS s, array_to_string(CASE WHEN a[1] = a[2] AND a[1] = 3 THEN [3] WHEN a[1] = a[2] THEN [a[1], 3] WHEN a[1] = 3 THEN [3, a[2]] WHEN a[2] = 3 THEN [a[1], 3] ELSE a END, ',') AS f, len(list_filter(a, lambda x: x > 20)) > 0 AS q FROM (SELECT n_nationkey, [n_nationkey, n_regionkey, 3] AS a FROM {N} n) t"),
    "sql_maps": ("SELECT n_nationkey, m['a'] AS a, size(map_keys(m)) AS k, element_at(map_values(m), 2) AS v, s.name AS w FROM (SELECT n_nationkey, map('a', n_regionkey, 'b', 7) AS m, named_struct('name', n_name) AS s FROM {N} n) t", "SELECT n_nationkey, m['a'] AS a, len(map_keys(m)) AS k, map_values(m)[2] AS v, s.name AS w FROM (SELECT n_nationkey, MAP {{'a': n_regionkey, 'b': 7}} AS m, {{'name': n_name}} AS s FROM {N} n) t"),
    "sql_json": ("SELECT n_nationkey, get_json_object(j, '$.k') AS k, from_json(j, 'k int, n string').n AS n, length(to_json(named_struct('a', n_nationkey))) AS l FROM (SELECT n_nationkey, concat('{{\"k\":', n_nationkey, ',\"n\":\"', n_name, '\"}}') AS j FROM {N} n) t", "SELECT n_nationkey, json_extract_string(j, '$.k') AS k, json_extract_string(j, '$.n') AS n, length(to_json({{'a': n_nationkey}})) AS l FROM (SELECT n_nationkey, concat('{{\"k\":', n_nationkey, ',\"n\":\"', n_name, '\"}}') AS j FROM {N} n) t"),
    "sql_hashes": ("SELECT n_nationkey, sha2(n_name, 256) AS s, md5(n_name) AS m, sha1(n_name) AS o FROM {N} n", "SELECT n_nationkey, sha256(n_name) AS s, md5(n_name) AS m, sha1(n_name) AS o FROM {N} n"),
    "barrier_division": "SELECT count(*) AS n FROM {C} c WHERE c_custkey > 3 AND 100.0 / c_custkey < 30 AND c_custkey % 2 = 1",
    "quoted_name": ('SELECT count(*) AS n FROM "open/nation" WHERE n_regionkey = 2', "SELECT count(*) AS n FROM {N} n WHERE n_regionkey = 2"),
}


def _filled(text: str, raw: bool) -> str:
    return text.format(**{k: f"(SELECT * FROM {t} WHERE {where})" if raw else f"open_{t}" for k, (t, where, _, _) in _ROWS.items()})


SPARK_SQL = {n: _filled(s if isinstance(s, str) else s[0], raw=False) for n, s in _SQL.items()}
DUCKDB_SQL = {n: _filled(s if isinstance(s, str) else s[1], raw=True) for n, s in _SQL.items()}
