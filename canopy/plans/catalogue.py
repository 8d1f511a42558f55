"""All queries outside the llm subpackage, each with the DuckDB SQL that checks it.

Numbers are rounded on both sides; ties are broken by ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conditions, dates, maths, operators, patterns, strings, unicode, values
from ..operators import analytics, collections, nodes, search
from ..operators.transactions import Transactions
from ..sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its name, with the SQL that checks it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def number(c: Column, digits: int = 6) -> Column:
    """A value as a rounded double, to compare with SQL's own numbers."""
    return F.round(c.cast("double"), digits)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """^G(region, nation, customer, order) = status."""
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return nodes.of_table(joined, "^G", [F.col(k) for k in ("n_regionkey", "n_nationkey", "c_custkey", "o_orderkey")], F.col("o_orderstatus"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as operations: id (user), seq (event_id), kind, value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.round("value", 4).cast("string").alias("value"))


#: The tree's rows in SQL.
_TREE = "SELECT n_regionkey AS r, n_nationkey AS n, c_custkey AS c, o_orderkey AS o, o_orderstatus AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


# --- tally and walk -------------------------------------------------------------------------------------------


@query("""
WITH t AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL)
SELECT '^T("' || a || '","' || b || '")' AS ref, CAST(q AS VARCHAR) AS value,
       coalesce(lead('^T("' || a || '","' || b || '")') OVER (ORDER BY a, b), '') AS next FROM t
""")
def tally_walk(spark, sf_dir):
    sums = nodes.tally(table(spark, sf_dir, "lineitem"), "^T", [F.col("l_returnflag"), F.col("l_linestatus")], F.col("l_quantity"))
    return nodes.walk(sums).select("ref", "value", "next")


def flagship(spark, sf_dir):
    return tally_walk(spark, sf_dir)


# --- expression operators -------------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, round(q + s, 6) AS added, round(q - s, 6) AS subtracted, round(q * s, 6) AS multiplied,
       round(CASE WHEN m = 0 THEN 0 ELSE q / m END, 6) AS divided, CASE WHEN m = 0 THEN 0 ELSE trunc(-q / m) + 0.0 END AS int_divided,
       CASE WHEN m = 0 THEN 0 ELSE -q - m * floor(-q / m) END AS modulo, CASE WHEN m = 0 THEN 0 ELSE q - -m * floor(q / -m) END AS modulo_negative,
       round(q ** 2, 6) AS powered, -q AS minus, q AS plus
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS s, CAST(l_linenumber - 1 AS DOUBLE) AS m FROM lineitem)
""")
def expr_arithmetic(spark, sf_dir):
    t = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("q"), F.col("l_discount").cast("string").alias("s"), (F.col("l_linenumber") - 1).cast("string").alias("m")))
    q, s, m = F.col("q"), F.col("s"), F.col("m")
    back = operators.minus(q)
    made = {
        "added": operators.add(q, s), "subtracted": operators.subtract(q, s), "multiplied": operators.multiply(q, s), "divided": operators.divide(q, m),
        "int_divided": operators.int_divide(back, m), "modulo": operators.modulo(back, m), "modulo_negative": operators.modulo(q, operators.minus(m)),
        "powered": operators.power(q, F.lit("2")), "minus": back, "plus": operators.plus(q),
    }
    return t.select("l_orderkey", "l_linenumber", *[number(c).alias(k) for k, c in made.items()])


@query("""
SELECT p_partkey, CASE WHEN p_size = 15 THEN '1' ELSE '0' END AS eq, CASE WHEN p_size <> 15 THEN '1' ELSE '0' END AS ne,
       CASE WHEN p_size < 15 THEN '1' ELSE '0' END AS lt, CASE WHEN p_size > 15 THEN '1' ELSE '0' END AS gt,
       CASE WHEN p_size >= 15 THEN '1' ELSE '0' END AS ge, CASE WHEN p_size <= 15 THEN '1' ELSE '0' END AS le,
       CASE WHEN p_name > 'm' THEN '1' ELSE '0' END AS string_gt, CASE WHEN CAST(p_size AS VARCHAR) > '2' THEN '1' ELSE '0' END AS follows,
       CASE WHEN CAST(p_size AS VARCHAR) <= '2' THEN '1' ELSE '0' END AS not_follows,
       CASE WHEN contains(p_name, 'e') THEN '1' ELSE '0' END AS contains, CASE WHEN contains(p_name, 'e') THEN '0' ELSE '1' END AS not_contains,
       CASE WHEN p_size > 2 THEN '1' ELSE '0' END AS sorts_after, p_name || p_brand AS concatenated,
       CASE WHEN p_size % 2 = 0 THEN '1' ELSE '0' END AS negated, CASE WHEN p_size % 2 = 1 AND p_size % 3 > 0 THEN '1' ELSE '0' END AS anded,
       CASE WHEN p_size % 2 = 1 OR p_size % 3 > 0 THEN '1' ELSE '0' END AS ored
FROM part
""")
def expr_compare(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    fifteen, odd, third = F.lit("15.0"), (F.col("p_size") % 2).cast("string"), F.concat((F.col("p_size") % 3).cast("string"), F.lit("apples"))
    made = {
        "eq": operators.equal(size, fifteen), "ne": operators.unequal(size, fifteen), "lt": operators.less(size, fifteen), "gt": operators.greater(size, fifteen),
        "ge": operators.not_less(size, fifteen), "le": operators.not_greater(size, fifteen), "string_gt": operators.greater(name, F.lit("m")),
        "follows": operators.follows(size, F.lit("2")), "not_follows": operators.not_follows(size, F.lit("2")), "contains": operators.contains(name, F.lit("e")),
        "not_contains": operators.not_contains(name, F.lit("e")), "sorts_after": operators.sorts_after(size, F.lit("2")), "concatenated": operators.concat(name, F.col("p_brand")),
        "negated": operators.negation(odd), "anded": operators.both(odd, third), "ored": operators.either(odd, third),
    }
    return p.select("p_partkey", *[c.alias(k) for k, c in made.items()])


@query("""
SELECT o_orderkey, CASE WHEN regexp_full_match(o_orderpriority, '[0-9][!-/:-@\\[-`{-~].*') THEN '1' ELSE '0' END AS priority,
       CASE WHEN regexp_full_match(o_orderpriority, '[0-9]-[A-Z]{4,6}') THEN '1' ELSE '0' END AS bounded,
       CASE WHEN regexp_full_match(o_orderpriority, '[0-9]-[A-Z]{4,6}') THEN '0' ELSE '1' END AS not_bounded
FROM orders
""".replace("\\\\", "\\"))
def pattern_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = F.col("o_orderpriority")
    return o.select("o_orderkey", patterns.matches(c, "1N1P.E").alias("priority"), patterns.matches(c, '1N1"-"4.6U').alias("bounded"), patterns.not_matches(c, '1N1"-"4.6U').alias("not_bounded"))


@query("""
SELECT p_partkey, CASE WHEN regexp_full_match(p_brand, '[A-Z][a-z]*#[0-9]*') THEN '1' ELSE '0' END AS brand,
       CASE WHEN regexp_full_match(p_name, '[A-Za-z0-9]+ .*') THEN '1' ELSE '0' END AS two_words FROM part
""")
def pattern_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", patterns.matches(F.col("p_brand"), '1U.L1"#".N').alias("brand"), patterns.matches(F.col("p_name"), '1.AN1" ".E').alias("two_words"))


# --- string functions -----------------------------------------------------------------------------------------


@query("""
SELECT c_custkey, ascii(substr(c_name, 3, 1)) AS code, -1 AS code_beyond, 'M' || 'x' AS chars, substr(c_name, 2, 3) AS extracted, left(c_name, 1) AS extracted_one,
       CASE WHEN instr(c_name, '#') > 0 THEN instr(c_name, '#') + 1 ELSE 0 END AS found, lpad(CAST(c_custkey AS VARCHAR), 12, ' ') AS justified,
       lpad(printf('%.2f', c_acctbal), 14, ' ') AS justified_number, length(c_name) AS len, length(c_name) - length(replace(c_name, '0', '')) + 1 AS n_pieces,
       split_part(c_name, '#', 1) AS first_piece, split_part(c_name, '#', 2) AS second_piece, c_name AS both_pieces, reverse(c_name) AS reversed,
       translate(c_name, 'Cu0', 'Kv') AS translated, upper(c_name) AS raised, lower(c_name) AS lowered, octet_length(encode(c_name)) AS bytes,
       ltrim(c_name, 'Cu') AS stripped, substr(c_name, 3, 4) AS sub, split_part(c_name, '#', 1) || '#X' AS set_second, c_name || '##Y' AS set_fourth,
       left(c_name, 1) || '--' || substr(c_name, 4) AS set_chars
FROM customer
""")
def string_functions(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    c = F.col("c_name")
    made = {
        "code": strings.ascii_code(c, 3), "code_beyond": strings.ascii_code(c, 99), "chars": strings.char(77, 120), "extracted": strings.extract(c, 2, 4), "extracted_one": strings.extract(c),
        "found": strings.find(c, "#").cast("bigint"), "justified": strings.justify(F.col("c_custkey"), 12), "justified_number": strings.justify(F.col("c_acctbal"), 14, 2, signed=True), "len": strings.length(c).cast("bigint"),
        "n_pieces": strings.length(c, "0").cast("bigint"), "first_piece": strings.piece(c, "#"), "second_piece": strings.piece(c, "#", 2), "both_pieces": strings.piece(c, "#", 1, 2), "reversed": strings.reverse(c),
        "translated": strings.translate(c, "Cu0", "Kv"), "raised": strings.convert(c, "U"), "lowered": strings.convert(c, "L"), "bytes": strings.width(c).cast("bigint"), "stripped": strings.strip(c, "<", "Cu"),
        "sub": strings.substr(c, 3, 4), "set_second": strings.set_piece(c, "#", 2, F.lit("X")), "set_fourth": strings.set_piece(c, "#", 4, F.lit("Y")), "set_chars": strings.set_extract(c, 2, F.lit("--"), 3),
    }
    return t.select("c_custkey", *[x.alias(k) for k, x in made.items()])


@query("""
SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN '(' || format('{:,.2f}', abs(s_acctbal)) || ')' ELSE format('{:,.2f}', s_acctbal) END AS accounted,
       CASE WHEN s_acctbal < 0 THEN '-' ELSE '+' END || format('{:.3f}', abs(s_acctbal)) AS signed_,
       CASE WHEN length(s_name) - length(replace(s_name, 'r', '')) > 0 THEN 1 ELSE 0 END AS has_r
FROM supplier
""")
def string_fnumber(spark, sf_dir):
    t = table(spark, sf_dir, "supplier")
    c = F.col("s_acctbal").cast("string")
    return t.select("s_suppkey", strings.fnumber(c, "P,", 2).alias("accounted"), strings.fnumber(c, "+", 3).alias("signed_"), F.when(strings.find(F.col("s_name"), "r") > 0, 1).otherwise(0).alias("has_r"))


@query("""
SELECT page_id, len(string_split(url, '/')) AS n_pieces, split_part(url, '/', 3) AS host, array_to_string(string_split(url, '/')[4:5], '/') AS path FROM pages
""")
def string_pieces(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", strings.length(u, "/").cast("bigint").alias("n_pieces"), strings.piece(u, "/", 3).alias("host"), strings.piece(u, "/", 4, 5).alias("path"))


@query("""
SELECT o, 4 AS n_subs, CAST(n AS VARCHAR) AS second, '^G' AS name, '^G(' || r || ',' || n || ',' || c || ',' || o || ')' AS ref FROM (""" + _TREE + ")")
def reference_functions(spark, sf_dir):
    t = tree(spark, sf_dir).withColumn("ref", strings.reference(F.col("name"), F.col("subs")))
    r = F.col("ref")
    return t.select(F.element_at("subs", 4).cast("bigint").alias("o"), strings.qlength(r).alias("n_subs"), strings.qsubscript(r, 2).alias("second"), strings.qsubscript(r, 0).alias("name"), "ref")


@query("""
SELECT doc_id, length(text) AS points, octet_length(encode(left(text, 1))) AS first_bytes, substr(text, 6, 10) AS part, reverse(text) AS reversed,
       translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS raised,
       regexp_full_match(split_part(text, ' ', 2), '([A-Za-z]|[^\\x00-\\x7f])+') AS alpha, regexp_full_match(left(text, 1), '[0-9]+') AS digit,
       CASE WHEN length(text) > 2 THEN unicode(substr(text, 3, 1)) ELSE -1 END AS point, CASE WHEN text = '' THEN '' ELSE chr(unicode(left(text, 1))) END AS again
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
""".replace("\\\\", "\\"))
def unicode_functions(spark, sf_dir):
    c = F.col("text")
    t = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    made = {
        "points": unicode.count(c).cast("bigint"), "first_bytes": unicode.char_bytes(c).cast("bigint"), "part": unicode.slice_of(c, 5, 10), "reversed": unicode.reverse(c), "raised": unicode.upper(c),
        "alpha": unicode.is_alpha(strings.piece(c, " ", 2)), "digit": unicode.is_digit(F.substring(c, 1, 1)), "point": unicode.code_point(c, 2), "again": unicode.from_code_point(unicode.code_point(c, 0)),
    }
    return t.select("doc_id", *[x.alias(k) for k, x in made.items()])


# --- mathematics, dates, conditions, JSON ---------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, round(abs(-q), 6) AS absolute, round(acos(d), 6) AS arccos, round(asin(d), 6) AS arcsin, round(atan(q), 6) AS arctan, round(cos(q), 6) AS cos,
       round(exp(d), 6) AS exp, round(ln(q), 6) AS ln, round(q ** 1.5, 6) AS power, round(sin(q), 6) AS sin, round(sqrt(q), 6) AS sqrt, round(tan(d), 6) AS tan,
       (CAST(q AS BIGINT) >> 2) & 1 AS bit2
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d FROM lineitem)
""")
def math_functions(spark, sf_dir):
    t = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("q"), F.col("l_discount").cast("string").alias("d")))
    q, d = F.col("q"), F.col("d")
    made = {
        "absolute": maths.zabs(operators.minus(q)), "arccos": maths.arccos(d), "arcsin": maths.arcsin(d), "arctan": maths.arctan(q), "cos": maths.cos(q), "exp": maths.exp(d), "ln": maths.ln(q),
        "power": maths.power(q, F.lit("1.5")), "sin": maths.sin(q), "sqrt": maths.sqrt(q), "tan": maths.tan(d),
    }
    return t.select("l_orderkey", "l_linenumber", *[number(c).alias(k) for k, c in made.items()], maths.bit(q, 2).cast("bigint").alias("bit2"))


@query("""
SELECT event_id, date_diff('day', DATE '1840-12-31', CAST(ts AS DATE)) || ',' || (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) AS horolog,
       strftime(ts, '%Y-%m-%d') AS zdate, strftime(ts, '%H:%M:%S') AS ztime, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso, strftime(ts, '%d/%m/%y %I:%M %p') AS twelve
FROM events
""")
def date_functions(spark, sf_dir):
    t = table(spark, sf_dir, "events").withColumn("h", dates.horolog(F.col("ts").cast("timestamp")))
    h = F.col("h")
    return t.select("event_id", h.alias("horolog"), dates.zdate(h).alias("zdate"), dates.ztime(h).alias("ztime"), dates.zdatetime(h).alias("iso"), dates.zdatetime(h, "DD/MM/YY 12:MI AM").alias("twelve"))


@query("""
SELECT event_id, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'middle' ELSE '' END AS selected,
       CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE 'other' END AS cased, CASE WHEN event_type = 'error' THEN 'none' ELSE event_type END AS got,
       json_extract_string(props, '$.k') AS k
FROM events
""")
def condition_functions(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    value, kind = F.col("value").cast("string"), F.col("event_type")
    return t.select(
        "event_id",
        conditions.select((operators.greater(value, F.lit("50")), F.lit("high")), (operators.greater(value, F.lit("10")), F.lit("middle"))).alias("selected"),
        conditions.case(kind, ("click", "c"), ("view", "v"), default="other").alias("cased"),
        conditions.get(F.when(kind == "error", "").otherwise(kind), "none").alias("got"),
        F.get_json_object(conditions.json_parse(F.col("props")), "$.k").alias("k"),
    )


# --- node store -----------------------------------------------------------------------------------------------


@query("SELECT c AS asked, coalesce(v, '?') AS value FROM (SELECT c_custkey AS c FROM customer) LEFT JOIN (" + _TREE.replace("c_custkey AS c,", "c_custkey AS cc,") + ") ON cc = c AND o = c")
def node_get(spark, sf_dir):
    t, c = tree(spark, sf_dir), table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    asked = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.lit("^G").alias("name"), F.array(*[F.col(k).cast("string") for k in ("n_regionkey", "n_nationkey", "c_custkey", "c_custkey")]).alias("subs"), "c_custkey")
    return nodes.get(t, asked, "?").select(F.col("c_custkey").alias("asked"), "value")


@query("""
WITH t AS (""" + _TREE + """),
a AS (SELECT CAST(c_custkey AS VARCHAR) AS sub, n_regionkey AS r, n_nationkey AS n, c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c AS asked, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.c = a.c) THEN 10 ELSE 0 END AS data FROM a
""")
def node_data(spark, sf_dir):
    t, c, n = tree(spark, sf_dir), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    asked = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.lit("^G").alias("name"), F.array(*[F.col(k).cast("string") for k in ("n_regionkey", "n_nationkey", "c_custkey")]).alias("subs"), "c_custkey")
    return nodes.data(t, asked).select(F.col("c_custkey").alias("asked"), "data")


@query("""
WITH t AS (SELECT DISTINCT r, n, c FROM (""" + _TREE + """))
SELECT c, coalesce(CAST(lead(c) OVER w AS VARCHAR), '') AS next, coalesce(CAST(lag(c) OVER w AS VARCHAR), '') AS previous FROM t WINDOW w AS (PARTITION BY r, n ORDER BY c)
""")
def node_order(spark, sf_dir):
    s = nodes.siblings(tree(spark, sf_dir)).filter(F.size("parent") == 2)
    return s.select(F.col("sub").cast("bigint").alias("c"), "next", "previous")


@query("""
WITH t AS (SELECT DISTINCT r, n, c FROM (""" + _TREE + """)), a AS (SELECT DISTINCT r, n FROM t)
SELECT r, n, coalesce(CAST((SELECT min(c) FROM t WHERE t.r = a.r AND t.n = a.n AND c > 500) AS VARCHAR), '') AS after,
       coalesce(CAST((SELECT max(c) FROM t WHERE t.r = a.r AND t.n = a.n AND c < 500) AS VARCHAR), '') AS before,
       CAST((SELECT min(c) FROM t WHERE t.r = a.r AND t.n = a.n) AS VARCHAR) AS first, CAST((SELECT max(c) FROM t WHERE t.r = a.r AND t.n = a.n) AS VARCHAR) AS last
FROM a
""")
def node_order_from(spark, sf_dir):
    t = tree(spark, sf_dir)
    ends = nodes.first_last(t).filter(F.size("parent") == 2)
    asked = ends.select("name", "parent", F.lit("500").alias("sub"))
    after = nodes.order(t, asked).select("name", "parent", F.col("found").alias("after"))
    before = nodes.order(t, asked, backward=True).select("name", "parent", F.col("found").alias("before"))
    out = ends.join(after, ["name", "parent"]).join(before, ["name", "parent"])
    return out.select(F.element_at("parent", 1).cast("int").alias("r"), F.element_at("parent", 2).cast("int").alias("n"), "after", "before", "first", "last")


@query("""
WITH t AS (SELECT *, '^G(' || r || ',' || n || ',' || c || ',' || o || ')' AS ref FROM (""" + _TREE + """))
SELECT ref, coalesce(lead(ref) OVER (ORDER BY r, n, c, o), '') AS next, coalesce(lag(ref) OVER (ORDER BY r, n, c, o), '') AS previous FROM t
""")
def node_query(spark, sf_dir):
    return nodes.walk(tree(spark, sf_dir)).select("ref", "next", "previous")


@query("SELECT c || '/' || o AS path, v AS value FROM (" + _TREE + ") WHERE r = 1 AND n = 1")
def node_descendants(spark, sf_dir):
    return nodes.descendants(tree(spark, sf_dir), "^G", "1", "1").select(F.array_join("subs", "/").alias("path"), "value")


@query("SELECT r, count(*) AS n FROM (" + _TREE + ") WHERE NOT (r = 1 AND n = 1) AND r <> 0 GROUP BY r")
def node_kill(spark, sf_dir):
    left = nodes.kill(nodes.kill(tree(spark, sf_dir), "^G", "1", "1"), "^G", "0")
    return left.groupBy(F.element_at("subs", 1).cast("int").alias("r")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r, count(*) AS n FROM (" + _TREE + ") WHERE o % 7 <> 0 AND c % 11 <> 0 GROUP BY r")
def node_kill_many(spark, sf_dir):
    t = tree(spark, sf_dir)
    roots = t.filter(F.element_at("subs", 4).cast("bigint") % 7 == 0).select("name", "subs").unionByName(t.filter(F.element_at("subs", 3).cast("bigint") % 11 == 0).select("name", F.slice("subs", 1, 3).alias("subs")).distinct())
    return nodes.kill_all(t, roots).groupBy(F.element_at("subs", 1).cast("int").alias("r")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT name, value, count(*) AS n FROM (
  SELECT '^G' AS name, v AS value FROM (""" + _TREE + """) UNION ALL
  SELECT '^H', v FROM (""" + _TREE + """ WHERE n_regionkey = 2) UNION ALL SELECT '^H', 'own') GROUP BY ALL
""")
def node_merge(spark, sf_dir):
    t = tree(spark, sf_dir)
    own = nodes.of_rows(spark, [("^H", ["kept"], "own"), ("^X", ["1"], "gone")])
    both = nodes.kill_except(nodes.merge(t.unionByName(own), "^H", "^G", of=("2",)), "^G", "^H")
    return both.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT '^A' AS name, '1' AS path, 'new' AS value UNION ALL SELECT '^A', '2', 'two' UNION ALL SELECT '^B', '1/x', 'inner'")
def node_transactions(spark, sf_dir):
    t = Transactions(nodes.of_rows(spark, [("^A", ["1"], "old"), ("^A", ["2"], "two"), ("^B", ["1"], "b"), ("^B", ["1", "y"], "c")]))
    t.start()
    t.set("^A", "1", "new")
    t.start()
    t.kill("^A")
    t.rollback()
    t.start()
    t.kill("^B", "1")
    t.set("^B", "1", "x", "inner")
    t.commit()
    t.commit()
    t.start()
    t.set("^C", "lost")
    t.rollback()
    return t.view().select("name", F.array_join("subs", "/").alias("path"), "value")


@query("""
SELECT l_orderkey, l_linenumber, d.price FROM lineitem l ASOF LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS price FROM orders GROUP BY 1) d ON CAST(l.l_shipdate AS DATE) >= d.day
""")
def as_of_join(spark, sf_dir):
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("price"))
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))
    return nodes.as_of(asked, days, [], "day", "price").select("l_orderkey", "l_linenumber", "price")


@query("SELECT user_id AS id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS counter FROM events")
def node_increment(spark, sf_dir):
    return nodes.increment(event_log(spark, sf_dir), ["id"], ["seq"]).select("id", "seq", F.col("counter").cast("bigint").alias("counter"))


# --- collections ----------------------------------------------------------------------------------------------


@query("SELECT user_id AS id, string_agg(event_type, ',' ORDER BY event_id) AS items, count(*) AS len FROM events GROUP BY user_id")
def collection_array(spark, sf_dir):
    a = collections.array(event_log(spark, sf_dir).withColumn("value", F.col("kind")))
    return a.select("id", F.array_join("items", ",").alias("items"), F.col("len").cast("bigint").alias("len"))


@query("SELECT user_id AS id, coalesce(list(event_type ORDER BY event_id)[3], '') AS value FROM events GROUP BY user_id")
def collection_array_get(spark, sf_dir):
    return collections.array_get(event_log(spark, sf_dir).withColumn("value", F.col("kind")), 2)


@query("""
WITH m AS (SELECT user_id AS id, event_type AS key, max(event_id) AS last FROM events GROUP BY ALL HAVING max(event_id) % 5 <> 0)
SELECT id, key, round(value, 4) AS value FROM m JOIN events ON event_id = last
""")
def collection_map(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumns({"key": F.col("kind"), "op": F.when(F.col("seq") % 5 == 0, "del").otherwise("set")})
    return collections.mapping(log).select("id", "key", number(F.col("value"), 4).alias("value"))


@query("""
WITH m AS (SELECT user_id AS id, event_type AS key FROM events GROUP BY ALL HAVING max(event_id) % 5 <> 0)
SELECT id, string_agg(key, ',' ORDER BY key) AS keys, count(*) AS len FROM m GROUP BY id
""")
def collection_map_keys(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumns({"key": F.col("kind"), "op": F.when(F.col("seq") % 5 == 0, "del").otherwise("set")})
    return collections.map_keys(collections.mapping(log)).select("id", "keys", F.col("len").cast("bigint").alias("len"))


@query("SELECT user_id AS id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items, count(DISTINCT event_type) AS len FROM events GROUP BY user_id")
def collection_sorted(spark, sf_dir):
    s = collections.sorted_values(event_log(spark, sf_dir).withColumn("value", F.col("kind")))
    return s.select("id", "items", F.col("len").cast("bigint").alias("len"))


@query("SELECT user_id AS id, event_type AS value FROM events GROUP BY ALL HAVING max(event_id) % 3 <> 0")
def collection_set(spark, sf_dir):
    log = event_log(spark, sf_dir).select("id", "seq", F.col("kind").alias("value"), F.when(F.col("seq") % 3 == 0, "del").otherwise("add").alias("op"))
    return collections.distinct_set(log)


@query("""
WITH l AS (SELECT user_id AS id, event_type AS value, event_id, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS s FROM events),
b AS (SELECT id, value, arg_max(s, event_id) - least(min(s), 0) AS n FROM l GROUP BY ALL)
SELECT id, CAST(sum(n) AS BIGINT) AS len, count(*) AS unique_len FROM b WHERE n > 0 GROUP BY id
""")
def collection_bag(spark, sf_dir):
    log = event_log(spark, sf_dir).select("id", "seq", F.col("kind").alias("value"), F.when(F.col("seq") % 3 == 0, "del").otherwise("add").alias("op"))
    return collections.bag_size(collections.bag(log))


def _push_pop(spark, sf_dir) -> DataFrame:
    return event_log(spark, sf_dir).select("id", "seq", "value", F.when(F.col("kind") == "purchase", "pop").otherwise("push").alias("op"))


#: Removals that find something, counted as the running sum's new lows are left out.
_OK = """
WITH a AS (SELECT user_id AS id, event_id AS seq, round(value, 4) AS value, event_type = 'purchase' AS pop,
                  sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events),
b AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM a),
ok AS (SELECT id, seq, value, pop FROM b WHERE NOT pop OR s >= low)
"""


@query(_OK + """, n AS (SELECT *, row_number() OVER (PARTITION BY id, pop ORDER BY seq) AS k FROM ok)
SELECT x.id, x.seq, y.value FROM n x JOIN n y ON x.id = y.id AND x.k = y.k AND x.pop AND NOT y.pop
""")
def collection_queue(spark, sf_dir):
    return collections.queue_pairs(_push_pop(spark, sf_dir)).select("id", "seq", number(F.col("value"), 4).alias("value"))


@query(_OK + """, n AS (SELECT *, row_number() OVER (PARTITION BY id, pop ORDER BY seq) AS k, count(*) FILTER (pop) OVER (PARTITION BY id) AS gone FROM ok)
SELECT id, value, k - gone AS place FROM n WHERE NOT pop AND k > gone
""")
def collection_queue_rest(spark, sf_dir):
    r = collections.queue_rest(_push_pop(spark, sf_dir))
    return r.select("id", number(F.col("value"), 4).alias("value"), F.col("place").cast("bigint").alias("place"))


@query(_OK + """, h AS (SELECT *, sum(CASE WHEN pop THEN -1 ELSE 1 END) OVER (PARTITION BY id ORDER BY seq) AS height FROM ok)
SELECT p.id, p.seq, (SELECT arg_max(q.value, q.seq) FROM h q WHERE q.id = p.id AND NOT q.pop AND q.seq < p.seq AND q.height = p.height + 1) AS value FROM h p WHERE p.pop
""")
def collection_stack(spark, sf_dir):
    return collections.stack_pairs(_push_pop(spark, sf_dir)).select("id", "seq", number(F.col("value"), 4).alias("value"))


@query(_OK + """, h AS (SELECT *, sum(CASE WHEN pop THEN -1 ELSE 1 END) OVER (PARTITION BY id ORDER BY seq) AS height FROM ok),
l AS (SELECT *, min(height) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS least FROM h)
SELECT id, CAST(height AS BIGINT) AS place, value FROM l WHERE NOT pop AND coalesce(least, height) >= height
""")
def collection_stack_rest(spark, sf_dir):
    r = collections.stack_rest(_push_pop(spark, sf_dir))
    return r.select("id", F.col("place").cast("bigint").alias("place"), number(F.col("value"), 4).alias("value"))


#: A user's events in order as operations, replayed one at a time in SQL.
_STEPS = "o AS (SELECT user_id AS id, event_type AS kind, event_id AS seq, CAST(round(value, 4) AS VARCHAR) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)"


@query("WITH RECURSIVE " + _STEPS + """,
d AS (SELECT id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS held FROM (SELECT DISTINCT id FROM o)
  UNION ALL SELECT o.id, o.k, CASE kind WHEN 'click' THEN [seq] || held WHEN 'purchase' THEN held[2:] WHEN 'error' THEN held[:len(held) - 1] ELSE held || [seq] END FROM d JOIN o ON o.id = d.id AND o.k = d.k + 1)
SELECT id, array_to_string(held, ',') AS items, len(held) AS len FROM (SELECT id, arg_max(held, k) AS held FROM d GROUP BY id)
""")
def collection_deque(spark, sf_dir):
    ops = {"click": "addfirst", "view": "addlast", "purchase": "popfirst", "error": "poplast"}
    op = F.coalesce(F.create_map(*[F.lit(x) for p in ops.items() for x in p])[F.col("kind")], F.lit("addlast"))
    return collections.deques(event_log(spark, sf_dir).withColumns({"op": op, "value": F.col("seq").cast("string")}))


@query("SELECT user_id AS id, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events) WHERE b <= 5")
def collection_ring(spark, sf_dir):
    r = collections.ring(event_log(spark, sf_dir).withColumn("value", F.col("kind")), 5)
    return r.select("id", "value", F.col("place").cast("bigint").alias("place"))


#: A cache of two keys for each user: even events put, odd ones get.
_CACHE = "WITH RECURSIVE " + _STEPS + """,
c AS (SELECT id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS held, 0 AS hits, 0 AS misses FROM (SELECT DISTINCT id FROM o)
  UNION ALL SELECT o.id, o.k, CASE WHEN seq % 2 = 1 AND NOT list_contains(held, kind) THEN held ELSE (list_filter(held, lambda x: x <> kind) || [kind])[-2:] END,
    hits + CAST(seq % 2 = 1 AND list_contains(held, kind) AS INT), misses + CAST(seq % 2 = 1 AND NOT list_contains(held, kind) AS INT) FROM c JOIN o ON o.id = c.id AND o.k = c.k + 1),
z AS (SELECT id, arg_max(held, k) AS held, max(hits) AS hits, max(misses) AS misses FROM c GROUP BY id)
"""


def _cache_log(spark, sf_dir) -> DataFrame:
    return event_log(spark, sf_dir).select("id", "seq", F.col("kind").alias("key"), F.when(F.col("seq") % 2 == 0, "put").otherwise("get").alias("op"), "value")


@query(_CACHE + "SELECT id, held[i] AS key, len(held) - i + 1 AS back FROM (SELECT id, held, unnest(range(1, len(held) + 1)) AS i FROM z)")
def collection_lru(spark, sf_dir):
    return collections.lru(_cache_log(spark, sf_dir), 2).select("id", "key", F.col("back").cast("bigint").alias("back"))


@query(_CACHE + "SELECT id, hits, misses, array_to_string(held, ',') AS keys FROM z")
def collection_lru_replay(spark, sf_dir):
    return collections.lru_replay(_cache_log(spark, sf_dir), 2).select("id", "hits", "misses", "keys")


@query("SELECT o_custkey, o_totalprice, rank FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS rank FROM orders) WHERE rank <= 3")
def collection_heap(spark, sf_dir):
    h = collections.heap(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", 3)
    return h.withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark, sf_dir):
    return collections.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 20)


# --- analytic structures --------------------------------------------------------------------------------------


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag")
def bitset_count(spark, sf_dir):
    return analytics.bits_count(analytics.bits(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey"), ["l_returnflag"])


@query("SELECT count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def bitset_union(spark, sf_dir):
    a, r = (analytics.bits(table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == f), [], "l_partkey") for f in "AR")
    return analytics.bits_or(a, r).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


@query("SELECT count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'A')")
def bitset_intersect(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return analytics.bits_and(t.filter("l_returnflag = 'A'"), t.filter("l_returnflag <> 'A'"), "l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT p_name FROM part WHERE starts_with(p_name, 'b')")
def trie_autocomplete(spark, sf_dir):
    return analytics.autocomplete(table(spark, sf_dir, "part"), "p_name", "b")


@query("SELECT left(p_name, n) AS prefix, count(DISTINCT p_name) AS n FROM (SELECT p_name, unnest(range(1, length(p_name) + 1)) AS n FROM part) GROUP BY 1")
def trie_prefixes(spark, sf_dir):
    return analytics.prefixes(table(spark, sf_dir, "part"), "p_name", (1 << 31) - 1)


@query("""
WITH s AS (SELECT item_id, p - 1 AS pos, substr(text, CAST(p AS BIGINT)) AS suffix FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS p FROM benchmark))
SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY suffix) AS rank FROM s
""")
def suffix_array(spark, sf_dir):
    s = analytics.suffixes(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return s.select("item_id", F.col("pos").cast("bigint").alias("pos"), F.col("rank").cast("bigint").alias("rank"))


@query("SELECT item_id, p - 1 AS pos FROM (SELECT item_id, text, unnest(range(1, length(text) - 1)) AS p FROM benchmark) WHERE substr(text, CAST(p AS BIGINT), 2) = 'an'")
def suffix_search(spark, sf_dir):
    o = analytics.occurrences(table(spark, sf_dir, "benchmark"), "item_id", "text", "an")
    return o.select("item_id", F.col("pos").cast("bigint").alias("pos"))


@query("SELECT conv_id, length(string_agg(text, '' ORDER BY turn, text)) AS len, substr(string_agg(text, '' ORDER BY turn, text), 11, 20) AS part FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def rope(spark, sf_dir):
    r = analytics.rope(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text")
    return r.select("conv_id", F.col("len").cast("bigint").alias("len"), analytics.rope_substring(r, 10, 20).alias("part"))


@query("SELECT p_partkey, true AS maybe FROM part")
def bloom_no_false_negatives(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return analytics.bloom_maybe(p.select("p_partkey", "p_brand"), "p_brand", analytics.bloom(p, "p_brand", 4096), 4096).select("p_partkey", "maybe")


_CODES = "list_transform(string_split({}, ''), lambda x: CAST(unicode(x) AS UBIGINT))"


@query("SELECT c_custkey, CAST(list_reduce([CAST(7 AS UBIGINT)] || " + _CODES.format("c_name") + ", lambda h, c: (h * 31 + c) % 4294967296) AS BIGINT) AS h FROM customer")
def fold_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", analytics.fold_hash(F.col("c_name"), 7).alias("h"))


_FNV = "CAST(list_reduce([CAST(2166136261 AS UBIGINT)] || " + _CODES + ", lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS VARCHAR)"


def _merkle_sql(deepest: int) -> str:
    """Ranges from the root down, then hashes from the deepest level up, a table for each."""
    halves = "SELECT level + 1, a, a + (b - a + 1) // 2 FROM r WHERE b - a > 1 UNION ALL SELECT level + 1, a + (b - a + 1) // 2, b FROM r WHERE b - a > 1"
    sql = f"WITH RECURSIVE r AS (SELECT 0 AS level, CAST(0 AS BIGINT) AS a, count(*) AS b FROM benchmark UNION ALL SELECT * FROM ({halves}))"
    sql += f", l AS (SELECT level, a, b, {_FNV.format('text')} AS hash FROM r JOIN benchmark ON item_id = a WHERE b - a = 1), h{deepest} AS (SELECT * FROM l WHERE level = {deepest})"
    for k in range(deepest - 1, -1, -1):
        both = _FNV.format("x.hash || y.hash")
        sql += f", h{k} AS (SELECT * FROM l WHERE level = {k} UNION ALL SELECT r.level, r.a, r.b, {both} FROM r JOIN h{k + 1} x ON x.a = r.a JOIN h{k + 1} y ON y.b = r.b WHERE r.level = {k} AND r.b - r.a > 1 AND x.b = y.a)"
    return sql + " " + " UNION ALL ".join(f"SELECT level, a AS lo, b AS hi, hash FROM h{k}" for k in range(deepest + 1))


#: For up to 1,024 items.
@query(_merkle_sql(10))
def merkle_tree(spark, sf_dir):
    return analytics.merkle(table(spark, sf_dir, "benchmark"), "item_id", "text")


#: Customers and suppliers of a nation, and nations of a region, as edges.
_EDGES = """(SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"), F.lit(1.0).alias("weight"))
    return edge(c, "c", "c_custkey", "n", "c_nationkey").unionByName(edge(s, "s", "s_suppkey", "n", "s_nationkey")).unionByName(edge(n, "n", "n_nationkey", "r", "n_regionkey"))


@query("SELECT src, count(*) AS degree FROM (SELECT src, dst FROM " + _EDGES + " UNION SELECT dst, src FROM " + _EDGES + ") GROUP BY src")
def graph_degrees(spark, sf_dir):
    return analytics.degrees(analytics.graph_edges(graph(spark, sf_dir), directed=False)).select("src", "degree")


@query("SELECT (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM " + _EDGES + " UNION SELECT dst FROM " + _EDGES + ")) AS nodes, (SELECT count(*) FROM " + _EDGES + ") AS edges")
def graph_counts(spark, sf_dir):
    return analytics.graph_counts(graph(spark, sf_dir), directed=False)


@query("""
WITH RECURSIVE e AS (SELECT src, dst FROM """ + _EDGES + """ UNION SELECT dst, src FROM """ + _EDGES + """),
b AS (SELECT 'r1' AS node, 0 AS level UNION SELECT e.dst, b.level + 1 FROM b JOIN e ON e.src = b.node WHERE b.level < 8)
SELECT node, min(level) AS level FROM b GROUP BY node
""")
def graph_bfs(spark, sf_dir):
    return analytics.bfs(analytics.graph_edges(graph(spark, sf_dir), directed=False), ["r1"])


@query("""
WITH RECURSIVE e AS (SELECT src, dst FROM """ + _EDGES + """ UNION SELECT dst, src FROM """ + _EDGES + """),
b AS (SELECT src AS node, src AS c FROM e UNION SELECT e.dst, b.c FROM b JOIN e ON e.src = b.node)
SELECT node, min(c) AS component FROM b GROUP BY node
""")
def graph_components(spark, sf_dir):
    return analytics.connected(graph(spark, sf_dir))


#: Quantities by part and supplier, and discounts by supplier and line, in 20 classes each.
_QUANTITIES = "SELECT l_partkey % 20 AS i, l_suppkey % 20 AS j, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY ALL"
_DISCOUNTS = "SELECT l_suppkey % 20 AS i, CAST(l_linenumber AS BIGINT) AS j, CAST(sum(l_discount * 100) AS DOUBLE) AS v FROM lineitem GROUP BY ALL"


def coo(spark: SparkSession, sf_dir: str, i: str, j: str, v: str) -> DataFrame:
    """A sparse matrix of sums over lineitem."""
    return table(spark, sf_dir, "lineitem").groupBy(F.expr(i).alias("i"), F.expr(j).cast("bigint").alias("j")).agg(F.expr(f"sum({v})").alias("v"))


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coo(spark, sf_dir, "l_partkey % 20", "l_suppkey % 20", "l_quantity")


def discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coo(spark, sf_dir, "l_suppkey % 20", "l_linenumber", "l_discount * 100")


@query("SELECT i, j, round(sum(v), 4) AS v FROM (" + _QUANTITIES + " UNION ALL " + _DISCOUNTS + ") GROUP BY ALL")
def matrix_add(spark, sf_dir):
    return analytics.matrix_add(quantities(spark, sf_dir), discounts(spark, sf_dir)).withColumn("v", F.round("v", 4))


@query("SELECT a.i, b.j, round(sum(a.v * b.v), 2) AS v FROM (" + _QUANTITIES + ") a JOIN (" + _DISCOUNTS + ") b ON a.j = b.i GROUP BY ALL")
def matrix_multiply(spark, sf_dir):
    return analytics.matrix_multiply(quantities(spark, sf_dir), discounts(spark, sf_dir)).withColumn("v", F.round("v", 2))


@query("SELECT j AS i, i AS j, v FROM (" + _QUANTITIES + ")")
def matrix_transpose(spark, sf_dir):
    return analytics.transpose(quantities(spark, sf_dir))


@query("SELECT r.i, c.j, round(coalesce(v, 0), 4) AS v FROM (SELECT unnest(range(20)) AS i) r CROSS JOIN (SELECT unnest(range(20)) AS j) c LEFT JOIN (" + _DISCOUNTS + ") m ON m.i = r.i AND m.j = c.j")
def matrix_dense(spark, sf_dir):
    d = analytics.dense(discounts(spark, sf_dir), 20, 20)
    return d.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.round("v", 4).alias("v"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS prefix FROM events")
def fenwick_prefix(spark, sf_dir):
    p = analytics.prefix_sums(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value")
    return p.select("event_id", F.round("prefix", 4).alias("prefix"))


@query("""
SELECT q.o_orderkey, count(e.value) AS n, round(sum(e.value), 2) AS sum, min(e.value) AS min, max(e.value) AS max
FROM (SELECT o_orderkey, o_orderkey % 3000 AS lo, o_orderkey % 3000 + o_custkey * 3 AS hi FROM orders) q LEFT JOIN events e ON e.event_id BETWEEN q.lo AND q.hi GROUP BY q.o_orderkey
""")
def segment_ranges(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3000).alias("lo"), (F.col("o_orderkey") % 3000 + F.col("o_custkey") * 3).alias("hi"))
    r = analytics.range_aggregates(table(spark, sf_dir, "events"), asked, "event_id", "value", 512)
    return r.select("o_orderkey", "n", F.round("sum", 2).alias("sum"), "min", "max")


@query("SELECT event_id, min(value) OVER w AS low, max(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def segment_sliding(spark, sf_dir):
    return analytics.sliding(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value", 3).select("event_id", "low", "high")


@query("SELECT count(*) AS n FROM events WHERE event_type = 'click' AND event_id BETWEEN 100 AND 800")
def wavelet_count(spark, sf_dir):
    return analytics.count_in_range(table(spark, sf_dir, "events"), "event_id", "event_type", "click", 100, 800)


@query("""
SELECT o_orderkey, count(*) AS n, min(l_orderkey) AS first, max(l_orderkey) AS last FROM (SELECT o_orderkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS low FROM orders) o
JOIN (SELECT l_orderkey, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem) l ON low <= d + 2 AND d <= low + 5 GROUP BY o_orderkey
""")
def interval_overlap(spark, sf_dir):
    day = lambda c: F.datediff(F.to_date(c), F.lit("1990-01-01"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", day("o_orderdate").alias("low")).withColumn("high", F.col("low") + 5)
    # equal intervals overlap the same ones, so they go as one row
    q = table(spark, sf_dir, "lineitem").groupBy(day("l_shipdate").alias("qlow")).agg(F.count(F.lit(1)).alias("m"), F.min("l_orderkey").alias("a"), F.max("l_orderkey").alias("b"))
    met = analytics.overlaps(o, q.withColumn("qhigh", F.col("qlow") + 2), 32)
    return met.groupBy("o_orderkey").agg(F.sum("m").alias("n"), F.min("a").alias("first"), F.max("b").alias("last"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def membership(spark, sf_dir):
    bad = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return analytics.members(table(spark, sf_dir, "orders"), bad, "o_custkey").select("o_orderkey")


@query("""
SELECT q.vec_id AS qid, arg_min(p.vec_id, {'d': (CAST(p.embedding[1] AS DOUBLE) - q.embedding[1]) ** 2 + (CAST(p.embedding[2] AS DOUBLE) - q.embedding[2]) ** 2, 'i': p.vec_id}) AS id
FROM embeddings p, embeddings q WHERE q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id GROUP BY q.vec_id
""")
def kd_nearest(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return analytics.nearest_point(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("p")), asked, 2, own=False).select("qid", "id")


# --- search ---------------------------------------------------------------------------------------------------

_WORDS = "string_split_regex(lower(coalesce(text, '')), '[\\s,.!?;:()\\[\\]{}\"'']')"


@query("SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(" + _WORDS + ") AS term FROM documents) WHERE term <> '' GROUP BY term")
def bm25_terms(spark, sf_dir):
    return search.bm25_index(table(spark, sf_dir, "documents")).terms


def _bm25_sql(terms: list[str], k: int) -> str:
    columns = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN t{i} > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len_ / avg_)) ELSE 0 END" for i in range(len(terms)))
    return (
        f"WITH c AS (SELECT doc_id, len(w) AS len_, {columns} FROM (SELECT doc_id, {_WORDS} AS w FROM documents)), s AS (SELECT count(*) AS n, avg(len_) AS avg_, {stats} FROM c), "
        f"h AS (SELECT doc_id, {score} AS score FROM c, s) SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM h WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {k}"
    )


@query(_bm25_sql(["the", "license", "enthe"], 15))
def bm25_top(spark, sf_dir):
    b = search.bm25(table(spark, sf_dir, "documents"), "the License enthe", 15)
    return b.select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


QUERY_VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST([" + ", ".join(map(str, QUERY_VECTOR)) + "] AS DOUBLE[]))"


@query("SELECT vec_id AS doc_id, round(" + _COSINE + ", 6) AS score, row_number() OVER (ORDER BY " + _COSINE + " DESC, vec_id) AS rank FROM embeddings ORDER BY rank LIMIT 10")
def cosine_top(spark, sf_dir):
    k = search.knn(table(spark, sf_dir, "embeddings"), QUERY_VECTOR, 10)
    return k.select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "WITH a AS (" + _bm25_sql(["the", "license", "enthe"], 20) + "), b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY " + _COSINE + " DESC, vec_id) AS rank FROM embeddings ORDER BY rank LIMIT 20), "
    "f AS (SELECT doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT doc_id, rank FROM a UNION ALL SELECT doc_id, rank FROM b) GROUP BY doc_id) "
    "SELECT doc_id, round(score, 6) AS score FROM f ORDER BY f.score DESC, doc_id LIMIT 10"
)
def hybrid_top(spark, sf_dir):
    h = search.hybrid(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), "the License enthe", QUERY_VECTOR, 10)
    return h.select("doc_id", F.round("score", 6).alias("score"))


@query("""
WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS term, split_part(p_name, ' ', 2) AS synonym FROM part), q AS (SELECT DISTINCT term FROM w WHERE left(term, 1) < 'd')
SELECT term, term AS "to" FROM q UNION SELECT q.term, synonym FROM q JOIN w USING (term)
""")
def thesaurus_expansion(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(strings.piece(F.col("p_name"), " ", 1).alias("term"), strings.piece(F.col("p_name"), " ", 2).alias("synonym")).distinct()
    return search.expanded(w.filter(F.left("term", F.lit(1)) < "d").select("term").distinct(), w)


# --- hierarchy of totals (an extension) -----------------------------------------------------------------------


@query("SELECT coalesce(CAST(r AS VARCHAR), '') || '/' || coalesce(CAST(n AS VARCHAR), '') AS path, count(*) AS orders FROM (" + _TREE + ") GROUP BY ROLLUP (r, n)")
def rollup_paths(spark, sf_dir):
    t = tree(spark, sf_dir).select(F.element_at("subs", 1).alias("r"), F.element_at("subs", 2).alias("n"))
    return t.rollup("r", "n").agg(F.count(F.lit(1)).alias("orders")).select(F.concat(values.text(F.col("r")), F.lit("/"), values.text(F.col("n"))).alias("path"), "orders")
