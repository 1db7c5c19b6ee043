"""SQL counterparts of the named queries, for a reference run on the same tables."""

from __future__ import annotations

from daybook.registry.queries import AFTER_ALL, MID_MONTH, MONTH_END

# The two readings of the sample tables (see daybook.sources.sample).
ORDER_BOOK = """
book AS (
    SELECT o_orderkey AS order_no, CAST(o_orderdate AS DATE) AS d, c_nationkey AS rep,
           CAST(o_totalprice AS DECIMAL(18,2)) AS amt
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey
),
people AS (
    SELECT n_nationkey AS id, n_name AS name, n_regionkey <> 0 AS is_rep FROM nation
)"""

LINE_BOOK = """
book AS (
    SELECT l_orderkey AS order_no, CAST(l_shipdate AS DATE) AS d, CAST(l_suppkey AS INTEGER) AS rep,
           l_partkey AS prod, CAST(l_extendedprice AS DECIMAL(18,2)) AS amt
    FROM lineitem
),
people AS (
    SELECT CAST(s_suppkey AS INTEGER) AS id, s_name AS name, s_nationkey <> 0 AS is_rep FROM supplier
)"""

#: Orders whose spelled date is read; the spelling goes by the order number.
SPELLED_BOOK = ORDER_BOOK.replace(
    "ON c_custkey = o_custkey", "ON c_custkey = o_custkey WHERE o_orderkey % 4 <> 3")

LATEST = "(SELECT max(d) FROM book)"


def day(text: str) -> str:
    return f"DATE '{text}'"


def anchored(book: str, anchor: str) -> str:
    """The book and one row of bounds: today, first of this and of the last month."""
    return f"""WITH {book},
bounds AS (
    SELECT today, CAST(date_trunc('month', today) AS DATE) AS m0,
           CAST(date_trunc('month', today) - INTERVAL 1 MONTH AS DATE) AS m1
    FROM (SELECT {anchor} AS today)
)"""


def total(condition: str = "true") -> str:
    return f"CAST(sum(amt) FILTER (WHERE {condition}) AS DECIMAL(28,2))"


def cents(expression: str) -> str:
    return f"CAST(({expression}) * 100 AS HUGEINT)"


def half_up(numerator: str, denominator: str) -> str:
    """Integer quotient of non-negative integers, halves up."""
    return f"((2 * ({numerator}) + ({denominator})) // (2 * ({denominator})))"


def fixed(number: str, digits: int) -> str:
    """A non-negative integer of 1/10^digits as decimal text."""
    unit = 10 ** digits
    return f"(CAST(({number}) // {unit} AS VARCHAR) || '.' || lpad(CAST(({number}) % {unit} AS VARCHAR), {digits}, '0'))"


# ── Reports ──────────────────────────────────────────────────────────────────

SAME_DAY = "d >= m1 AND d < m0 AND day(d) <= day(today)"


def summary(book: str, anchor: str) -> str:
    return f"""{anchored(book, anchor)},
counted AS (
    SELECT any_value(b.today) AS today,
           count(d) FILTER (WHERE d = b.today) AS n_day, {total('d = b.today')} AS r_day,
           count(d) FILTER (WHERE d >= m0) AS n_mtd, {total('d >= m0')} AS r_mtd,
           count(d) FILTER (WHERE {SAME_DAY}) AS n_same, {total(SAME_DAY)} AS r_same,
           count(d) FILTER (WHERE d < m0) AS n_prev, {total('d < m0')} AS r_prev
    FROM bounds b LEFT JOIN book ON d >= m1 AND d <= b.today
)
SELECT today AS data_date, n_day AS today_orders, r_day AS today_revenue,
       CASE WHEN n_mtd > 0 THEN strftime(today, '%b %Y') END AS mtd_label,
       nullif(n_mtd, 0) AS mtd_orders, r_mtd AS mtd_revenue,
       n_same AS prev_same_orders, r_same AS prev_same_revenue,
       CASE WHEN n_prev > 0 THEN strftime(today - INTERVAL 1 MONTH, '%b %Y') END AS prev_full_label,
       nullif(n_prev, 0) AS prev_full_orders, r_prev AS prev_full_revenue
FROM counted"""


def card(anchor: str, condition: str, select: str, having: str) -> str:
    return f"""{anchored(ORDER_BOOK, anchor)},
chosen AS (SELECT * FROM book, bounds WHERE {condition})
SELECT {select} FROM chosen {having}"""


def today_card(anchor: str) -> str:
    return card(anchor, "d = today",
                f"any_value(today) AS data_date, count(*) AS today_orders, {total()} AS today_revenue",
                "HAVING count(*) > 0")


def same_day_card(anchor: str) -> str:
    return card(anchor, SAME_DAY,
                f"count(*) AS prev_same_day_orders, {total()} AS prev_same_day_revenue", "")


def leaderboard(book: str, anchor: str, target: int = 125) -> str:
    return f"""{anchored(book, anchor)},
counted AS (
    SELECT rep, count(*) FILTER (WHERE d = today) AS n_day, {total('d = today')} AS r_day,
           count(*) FILTER (WHERE d >= m0) AS n_mtd, {total('d >= m0')} AS r_mtd,
           count(*) FILTER (WHERE d < m0) AS n_prev
    FROM book, bounds WHERE d >= m1 AND d <= today GROUP BY rep
)
SELECT row_number() OVER (ORDER BY n_mtd DESC, id) AS rank, name AS sales_rep,
       n_day AS day_orders, coalesce(r_day, CAST(0 AS DECIMAL(28,2))) AS day_revenue,
       n_mtd AS mtd_orders, coalesce(r_mtd, CAST(0 AS DECIMAL(28,2))) AS mtd_revenue,
       CAST({fixed(half_up(cents('r_mtd'), 'n_mtd'), 2)} AS DECIMAL(28,2)) AS arpu,
       CAST({target} AS INTEGER) AS target,
       CAST({half_up('100 * n_mtd', str(target))} AS DECIMAL(20,0)) AS target_pct,
       n_prev AS prev_month_orders
FROM counted JOIN people ON id = rep
WHERE is_rep AND n_mtd > 0"""


def destinations(anchor: str, limit: str = "LIMIT 10") -> str:
    return f"""{anchored(LINE_BOOK, anchor)}
SELECT coalesce(n_name, p_brand) AS destination_name, count(*) AS order_count
FROM bounds JOIN book ON d >= m0 AND d <= today JOIN part ON p_partkey = prod
LEFT JOIN nation ON 'Brand#' || n_nationkey = p_brand AND n_regionkey <> 0
GROUP BY 1 ORDER BY order_count DESC, destination_name {limit}"""


def daily(book: str, anchor: str) -> str:
    return f"""{anchored(book, anchor)}
SELECT d AS date, strftime(d, '%d/%m') AS date_label, count(*) AS daily_orders, {total()} AS daily_revenue
FROM book, bounds WHERE d BETWEEN today - INTERVAL 60 DAY AND today GROUP BY d ORDER BY d"""


def monthly(book: str, anchor: str) -> str:
    return f"""{anchored(book, anchor)}
SELECT strftime(m, '%b ''%y') AS month_label, m AS month_start,
       count(*) AS monthly_orders, {total()} AS monthly_revenue
FROM (SELECT CAST(date_trunc('month', d) AS DATE) AS m, d, amt, today, m0 FROM book, bounds)
WHERE d <= today AND d >= m0 - INTERVAL 11 MONTH GROUP BY m ORDER BY m"""


# ── Display ──────────────────────────────────────────────────────────────────

def rupees(value: str) -> str:
    c = cents(f"coalesce({value}, 0)")
    return (f"'₹' || CASE WHEN {c} >= 10000000 THEN {fixed(half_up(c, '100000'), 2)} || 'L' "
            f"WHEN {c} >= 100000 THEN {fixed(half_up(c, '1000'), 2)} || 'K' "
            f"ELSE CAST({half_up(c, '100')} AS VARCHAR) END")


def count_text(name: str) -> str:
    return f"coalesce(CAST({name} AS VARCHAR), '0') AS {name}"


def summary_display(anchor: str) -> str:
    def money(name: str) -> str:
        return f"{rupees(name)} || ' Revenue' AS {name}"

    return f"""SELECT strftime(data_date, '%d %b %Y') AS data_date,
    {count_text('today_orders')}, {money('today_revenue')},
    upper(coalesce(mtd_label, 'MTD')) AS mtd_label, {count_text('mtd_orders')}, {money('mtd_revenue')},
    {count_text('prev_same_orders')}, {money('prev_same_revenue')},
    upper(coalesce(prev_full_label, 'Prev Month')) AS prev_full_label,
    {count_text('prev_full_orders')}, {money('prev_full_revenue')}
FROM ({summary(ORDER_BOOK, anchor)})"""


def leaderboard_display(anchor: str, target: int) -> str:
    day_cents = cents("day_revenue")
    return f"""SELECT CAST(rank AS VARCHAR) AS rank, sales_rep, {count_text('day_orders')},
    CASE WHEN day_revenue > 0 THEN '₹' || {fixed(half_up(day_cents, '10000'), 1)} ELSE '' END AS day_revenue,
    {count_text('mtd_orders')}, {rupees('mtd_revenue')} AS mtd_revenue,
    '₹' || CAST({half_up(cents('arpu'), '100')} AS VARCHAR) AS arpu,
    CAST(target_pct AS VARCHAR) || '%' AS target_pct,
    CAST(least(target_pct, 100) AS INTEGER) AS bar_width,
    CAST(target AS VARCHAR) AS target, {count_text('prev_month_orders')}
FROM ({leaderboard(ORDER_BOOK, anchor, target)})"""


# ── JSON ─────────────────────────────────────────────────────────────────────

def json_object(**fields: str) -> str:
    """An object's text; a field is ``text`` (quoted) or ``number``."""
    parts = []
    for name, kind in fields.items():
        value = f"CAST({name} AS VARCHAR)"
        if kind == "text":
            value = f"'\"' || {value} || '\"'"
        parts.append(f"'\"{name}\":' || coalesce({value}, 'null')")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


SUMMARY_JSON = json_object(
    data_date="text", today_orders="number", today_revenue="number",
    mtd_label="text", mtd_orders="number", mtd_revenue="number",
    prev_same_orders="number", prev_same_revenue="number",
    prev_full_label="text", prev_full_orders="number", prev_full_revenue="number")
LEADERBOARD_JSON = json_object(
    rank="number", sales_rep="text", day_orders="number", day_revenue="number",
    mtd_orders="number", mtd_revenue="number", arpu="number", target="number",
    target_pct="number", prev_month_orders="number")
DESTINATION_JSON = json_object(destination_name="text", order_count="number")
DAY_JSON = json_object(date="text", date_label="text", daily_orders="number", daily_revenue="number")
MONTH_JSON = json_object(
    month_label="text", month_start="text", monthly_orders="number", monthly_revenue="number")


def json_rows(json: str, query: str) -> str:
    return f"SELECT {json} AS json FROM ({query})"


def json_list(json: str, key: str, query: str) -> str:
    return f"(SELECT '[' || coalesce(string_agg({json}, ',' ORDER BY {key}), '') || ']' FROM ({query}))"


def charts(anchor: str) -> str:
    days = json_list(DAY_JSON, "date", daily(ORDER_BOOK, anchor))
    months = json_list(MONTH_JSON, "month_start", monthly(ORDER_BOOK, anchor))
    return f"SELECT '{{\"daily\":' || {days} || ',\"monthly\":' || {months} || '}}' AS json"


# ── Loads ────────────────────────────────────────────────────────────────────

def product_rows(name: str = "p_name", where: str = "", key: str = "INTEGER", limit: str = "INTEGER") -> str:
    return f"""SELECT CAST(p_partkey AS {key}) AS prod_id, CAST(p_size AS {limit}) AS data_limit,
    CAST(p_retailprice AS DECIMAL(10,2)) AS amount, {name} AS product_name,
    p_brand || ' ,' || p_type AS coverage_destinations FROM part {where}"""


ONCE = "CASE WHEN CAST(p_retailprice AS DECIMAL(10,2)) < 1000 THEN p_name ELSE 'again' END"

DUPLICATE_KEYS = """
SELECT '{0}' AS table_name, count(*) AS bad_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows
FROM (SELECT {1}, count(*) AS n FROM {2} GROUP BY 1 HAVING count(*) > 1)"""


# ── Changed books and rows left out ──────────────────────────────────────────

def spelled_orders(days: str) -> str:
    """Orders of a book that every second order was added to, with their dates moved on."""
    day = f"CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) + CAST({days} AS INTEGER) END"
    return f"""
            SELECT o_orderkey AS order_no, CAST(o_custkey AS INTEGER) AS user_id, {day} AS order_date,
                   CAST(date_trunc('month', {day}) AS DATE) AS order_month, CAST(o_totalprice AS DECIMAL(18,2)) AS amount
            FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0"""


MOVED_BOOK = LINE_BOOK.replace(
    "CAST(l_shipdate AS DATE) AS d",
    "CASE WHEN strftime(l_shipdate, '%Y-%m') = '1996-05' THEN DATE '1996-06-01' ELSE CAST(l_shipdate AS DATE) END AS d")

GAPS_BOOK = LINE_BOOK.replace(
    "CAST(l_suppkey AS INTEGER) AS rep", "CASE WHEN l_orderkey % 3 <> 0 THEN CAST(l_suppkey AS INTEGER) END AS rep").replace(
    "CAST(l_extendedprice AS DECIMAL(18,2)) AS amt",
    "CASE WHEN l_orderkey % 5 <> 0 AND l_suppkey % 4 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS amt")


def gaps_destinations(anchor: str) -> str:
    return f"""{anchored(GAPS_BOOK, anchor)},
covered AS (
    SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN '' ELSE p_brand END AS code
    FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 NOT IN (0, 1)
)
SELECT coalesce(n_name, code) AS destination_name, count(*) AS order_count
FROM bounds JOIN book ON d >= m0 AND d <= today JOIN covered ON p_partkey = prod
LEFT JOIN nation ON 'Brand#' || n_nationkey = code AND n_regionkey <> 0
GROUP BY 1"""


LINE_BREAKS = """
            SELECT o_orderkey AS order_no,
                   strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) ELSE '' END AS order_date_time
            FROM orders"""


def oracle_sql() -> dict[str, str]:
    end, mid, after = day(MONTH_END), day(MID_MONTH), day(AFTER_ALL)
    march = f"(SELECT max(d) FROM book WHERE strftime(d, '%Y-%m') = '1998-03')"
    return {
        "orders_parsed": """
            SELECT o_orderkey AS order_no, CAST(o_custkey AS INTEGER) AS user_id,
                   CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS order_date,
                   CAST(o_totalprice AS DECIMAL(18,2)) AS amount
            FROM orders""",
        "date_quality": """
            SELECT CASE WHEN o_orderkey % 4 <> 3 THEN 'parsed' ELSE 'unknown spelling' END AS date_state,
                   count(*) AS rows
            FROM orders GROUP BY 1""",
        "unreadable_dates": """
            SELECT o_orderkey AS order_no, strftime(o_orderdate, '%Y-%m-%d') AS order_date_time
            FROM orders WHERE o_orderkey % 4 = 3""",
        "load_check": """
            SELECT 'users' AS table_name, count(*) AS rows FROM nation
            UNION ALL SELECT 'products', count(*) FROM part
            UNION ALL SELECT 'destinations', count(*) FROM nation WHERE n_regionkey <> 0
            UNION ALL SELECT 'orders', count(*) FROM orders
            UNION ALL SELECT 'orders_parsed (valid dates)', count(*) FROM orders WHERE o_orderkey % 4 <> 3""",
        "primary_key_check": " UNION ALL ".join([
            DUPLICATE_KEYS.format("users", "n_nationkey", "nation"),
            DUPLICATE_KEYS.format("products", "p_partkey", "part"),
            DUPLICATE_KEYS.format("destinations", "n_nationkey", "nation"),
            DUPLICATE_KEYS.format("orders", "o_orderkey", "orders"),
            DUPLICATE_KEYS.format("lines", "l_orderkey", "lineitem")]),
        "product_insert_if_absent": """
            SELECT s_suppkey AS id, s_name AS label FROM supplier
            UNION ALL
            SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FROM orders
            WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""",
        "csv_load_users": """
            SELECT CAST(c_custkey AS INTEGER) AS user_id,
                   '"' || c_name || '",' || chr(10) || c_mktsegment AS name,
                   CAST(c_nationkey AS VARCHAR) AS country_code, CAST(NULL AS VARCHAR) AS mobile,
                   CAST(1 AS INTEGER) AS user_role
            FROM customer""",
        "csv_load_products": product_rows(),
        "csv_load_destinations": """
            SELECT 'N' || n_nationkey AS destination_id, n_regionkey AS destination_type,
                   n_name AS destination_name, CAST(NULL AS VARCHAR) AS flag_path,
                   'A, ' || n_name || chr(10) AS included_destinations,
                   CAST(n_regionkey % 2 AS INTEGER) AS is_active
            FROM nation""",
        "csv_load_orders": """
            SELECT o_orderkey AS order_no, CAST(o_custkey AS INTEGER) AS user_id,
                   CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS order_date,
                   CASE WHEN o_orderkey % 4 <> 3
                        THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS order_month,
                   CAST(o_totalprice AS DECIMAL(10,2)) AS amount
            FROM orders""",
        "csv_insert_all_or_nothing": product_rows(ONCE),
        "csv_insert_good_rows": product_rows(ONCE, "WHERE p_size <= 40"),
        "csv_quarantine": """
            SELECT 'data_limit is no int: unlimited' AS reason, count(*) AS rows
            FROM part WHERE p_size > 40 HAVING count(*) > 0""",
        "type_widening": product_rows(key="BIGINT", limit="VARCHAR"),
        "anchor_latest": "SELECT CAST(max(o_orderdate) AS DATE) AS today FROM orders",
        "anchor_month": """
            SELECT CAST(max(o_orderdate) AS DATE) AS today FROM orders
            WHERE strftime(o_orderdate, '%Y-%m') = '1998-03'""",
        "anchor_month_empty": """
            SELECT coalesce(CAST(max(o_orderdate) AS DATE), DATE '2004-02-29') AS today FROM orders
            WHERE strftime(o_orderdate, '%Y-%m') = '2004-02'""",
        "q1_today": today_card(LATEST),
        "q2_mtd": card(
            LATEST, "d >= m0", f"strftime(any_value(today), '%b %Y') AS month_label, "
            f"count(*) AS mtd_orders, {total()} AS mtd_revenue", "HAVING count(*) > 0"),
        "q3_prev_same_day": same_day_card(LATEST),
        "q4_prev_month": card(
            LATEST, "d >= m1 AND d < m0", f"strftime(any_value(m1), '%b %Y') AS month_label, "
            f"count(*) AS prev_month_orders, {total()} AS prev_month_revenue", "HAVING count(*) > 0"),
        "q1_today_empty": today_card(after),
        "q3_prev_same_day_mid_month": same_day_card(mid),
        "summary_latest": summary(ORDER_BOOK, LATEST),
        "summary_month_end": summary(ORDER_BOOK, end),
        "summary_mid_month": summary(ORDER_BOOK, mid),
        "summary_empty": summary(ORDER_BOOK, after),
        "summary_month": summary(ORDER_BOOK, march),
        "summary_month_empty": summary(ORDER_BOOK, day("2001-09-30")),
        "summary_stored_fact": summary(SPELLED_BOOK, LATEST),
        "summary_stored_rollup": summary(LINE_BOOK, LATEST),
        "leaderboard_stored_rollup": leaderboard(LINE_BOOK, LATEST),
        "destinations_stored_rollup": destinations(LATEST),
        "rollup_rows": f"""WITH {LINE_BOOK}
            SELECT 'days' AS table_name, count(*) AS rows FROM (SELECT DISTINCT d FROM book)
            UNION ALL SELECT 'creators', count(*) FROM (SELECT DISTINCT d, rep FROM book)
            UNION ALL SELECT 'products', count(*) FROM (SELECT DISTINCT d, prod FROM book)""",
        "summary_rollup": summary(LINE_BOOK, mid),
        "leaderboard_latest": leaderboard(ORDER_BOOK, LATEST),
        "leaderboard": leaderboard(ORDER_BOOK, end),
        "leaderboard_target": leaderboard(ORDER_BOOK, mid, 8),
        "leaderboard_suppliers": leaderboard(LINE_BOOK, end),
        "leaderboard_blocks": """
            SELECT CAST(l_suppkey AS INTEGER) AS created_by, count(*) AS orders,
                   row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS rank
            FROM lineitem GROUP BY l_suppkey""",
        "leaderboard_rollup": leaderboard(LINE_BOOK, end),
        "top_destinations_latest": destinations(LATEST),
        "top_destinations": destinations(end),
        "all_destinations": destinations(end, ""),
        "top_destinations_rollup": destinations(end),
        "daily_trend_latest": daily(ORDER_BOOK, LATEST),
        "daily_trend": daily(ORDER_BOOK, end),
        "daily_trend_rollup": daily(LINE_BOOK, end),
        "monthly_trend_latest": monthly(ORDER_BOOK, LATEST),
        "monthly_trend": monthly(ORDER_BOOK, mid),
        "monthly_trend_rollup": monthly(LINE_BOOK, mid),
        "daily_rollup": f"""WITH {LINE_BOOK}
            SELECT d AS order_date, rep AS created_by, prod AS product_id,
                   count(*) AS orders, {total()} AS revenue
            FROM book GROUP BY ALL""",
        "summary_display": summary_display(mid),
        "summary_display_empty": summary_display(after),
        "leaderboard_display": leaderboard_display(end, 8),
        "destinations_display": f"SELECT destination_name AS name, CAST(order_count AS VARCHAR) AS badge "
                                f"FROM ({destinations(end)})",
        "daily_chart": f"SELECT date, date_label AS label, daily_orders AS orders "
                       f"FROM ({daily(ORDER_BOOK, end)})",
        "monthly_chart": f"SELECT month_start, month_label AS label, monthly_orders AS orders "
                         f"FROM ({monthly(ORDER_BOOK, mid)})",
        "summary_json": json_rows(SUMMARY_JSON, summary(ORDER_BOOK, mid)),
        "summary_json_empty": json_rows(SUMMARY_JSON, summary(ORDER_BOOK, after)),
        "leaderboard_json": json_rows(LEADERBOARD_JSON, leaderboard(ORDER_BOOK, end)),
        "destinations_json": json_rows(DESTINATION_JSON, destinations(end)),
        "charts_json": charts(end),
        "csv_export": f"SELECT CAST(date AS VARCHAR) AS date, date_label, "
                      f"CAST(daily_orders AS VARCHAR) AS daily_orders, "
                      f"CAST(daily_revenue AS VARCHAR) AS daily_revenue FROM ({daily(ORDER_BOOK, end)})",
        "rollup_refreshed": f"""WITH {MOVED_BOOK}
            SELECT d AS order_date, rep AS created_by, prod AS product_id, count(*) AS orders, {total()} AS revenue,
                   CAST(date_trunc('month', d) AS DATE) AS order_month
            FROM book GROUP BY ALL""",
        "fact_appended": """
            SELECT o_orderkey AS order_no, CAST(o_custkey AS INTEGER) AS user_id,
                   CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS order_date,
                   CASE WHEN o_orderkey % 4 <> 3 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS order_month,
                   CAST(o_totalprice AS DECIMAL(18,2)) AS amount
            FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""",
        "fact_appended_moved": spelled_orders("CASE WHEN o_orderkey % 3 <> 0 THEN 0 ELSE 40 END"),
        "orders_corrected": spelled_orders("CASE WHEN o_orderkey % 2 = 0 THEN 40 ELSE 0 END"),
        "rollup_deltas": """
            SELECT CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS order_date,
                   CAST(count(*) AS BIGINT) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS revenue
            FROM orders GROUP BY 1""",
        "summary_pinned": summary(ORDER_BOOK.replace(
            "LEFT JOIN customer ON c_custkey = o_custkey", "LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 3"), mid),
        "late_orders": """
            SELECT CASE WHEN o_orderkey % 4 <> 3 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS order_month, count(*) AS orders
            FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 GROUP BY 1""",
        "widened_by_version": """
            SELECT CAST(p_partkey AS BIGINT) AS prod_id, p_brand AS brand, CASE WHEN p_partkey % 2 = 1 THEN CAST(p_size AS INTEGER) END AS size
            FROM part""",
        "csv_load_orders_line_breaks": LINE_BREAKS,
        "csv_load_orders_by_blocks": LINE_BREAKS,
        "csv_quarantine_twice": """
            SELECT 'data_limit is no int: unlimited' AS reason, count(*) AS rows
            FROM part WHERE p_size > 40 HAVING count(*) > 0""",
        "leaderboard_gaps": leaderboard(GAPS_BOOK, end),
        "destinations_gaps": gaps_destinations(end),
        "destinations_array": f"SELECT {json_list(DESTINATION_JSON, 'order_count DESC, destination_name', destinations(end))} AS json",
        "leaderboard_array": json_rows(LEADERBOARD_JSON, leaderboard(LINE_BOOK, end)),
        "sql_text_parameters": """
            SELECT CAST(o_orderdate AS DATE) AS order_date, count(*) AS orders FROM orders
            WHERE o_orderkey % 4 <> 3 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'
            GROUP BY 1""",
    }
