"""DuckDB SQL fragments mirroring the test-table adapters (oracle side only)."""

STD = """std AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderkey AS VARCHAR) AS order_id,
         o_orderdate AS order_date, o_totalprice AS order_total
  FROM orders)"""

RAW_DIRTY = """raw1 AS (
  SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END AS cust,
         o_orderkey AS ord,
         CASE WHEN o_orderkey % 53 = 0 THEN 'n/a' ELSE CAST(o_orderdate AS VARCHAR) END AS date_txt,
         CASE WHEN o_orderkey % 89 = 0 THEN NULL
              WHEN o_orderkey % 53 = 0 THEN 'n/a'
              WHEN o_orderkey % 101 = 0 THEN '0.0'
              WHEN o_orderkey % 13 = 0 THEN CAST(-o_totalprice AS VARCHAR)
              ELSE CAST(o_totalprice AS VARCHAR) END AS total_txt,
         CAST(1 + o_orderkey % 7 AS DOUBLE) AS qty,
         o_totalprice / CAST(1 + o_orderkey % 7 AS DOUBLE) AS price,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 10 AS DOUBLE) END AS sat
  FROM orders),
raw AS (SELECT * FROM raw1 UNION ALL SELECT * FROM raw1 WHERE ord % 10 = 0)"""

DIRTY = RAW_DIRTY + """,
dirty AS (
  SELECT CAST(cust AS VARCHAR) AS customer_id, CAST(ord AS VARCHAR) AS order_id,
         TRY_CAST(date_txt AS TIMESTAMP) AS order_date,
         CASE WHEN isnan(TRY_CAST(total_txt AS DOUBLE)) THEN NULL ELSE TRY_CAST(total_txt AS DOUBLE) END AS order_total,
         qty AS quantity, price AS unit_price, sat AS satisfaction
  FROM raw)"""

LINES = """lines AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS customer_id, CAST(o.o_orderkey AS VARCHAR) AS order_id,
         o.o_orderdate AS order_date,
         CASE WHEN l.l_returnflag = 'R' THEN -(l.l_extendedprice * (1 - l.l_discount))
              ELSE l.l_extendedprice * (1 - l.l_discount) END AS order_total,
         l.l_quantity AS quantity
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

EVENTS = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS customer_id, CAST(event_id AS VARCHAR) AS order_id,
         ts AS order_date, CASE WHEN isnan(value) THEN NULL ELSE value END AS order_total
  FROM events WHERE event_type = 'purchase')"""


def days(a: str, b: str) -> str:
    """Whole days from a to b, floored."""
    return f"CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000) AS BIGINT)"


def agg_orders(src: str, keep: str = "> 0", sat: bool = False) -> str:
    s = ", avg(satisfaction) AS satisfaction" if sat else ""
    return f"""SELECT customer_id, order_id, order_date,
         coalesce(sum(order_total), 0) AS order_total{s}
  FROM {src}
  WHERE customer_id IS NOT NULL AND order_id IS NOT NULL AND order_date IS NOT NULL
  GROUP BY customer_id, order_id, order_date
  HAVING coalesce(sum(order_total), 0) {keep}"""


def rfm(src: str) -> str:
    """RFM CTE body over an orders CTE ``src``."""
    return f"""SELECT customer_id, {days('last', 'ref')} AS Recency, CAST(cnt AS BIGINT) AS Frequency,
         mon AS Monetary
  FROM (SELECT customer_id, max(last) AS last, count(*) AS cnt, sum(m) AS mon
        FROM (SELECT customer_id, order_id, sum(order_total) AS m, max(order_date) AS last
              FROM {src} GROUP BY customer_id, order_id) GROUP BY customer_id) pc,
       (SELECT max(order_date) + INTERVAL 1 DAY AS ref FROM {src}) r"""


def rules_case(code: str, rules, mode: str = "first", match: str = "full", default="'Other'") -> str:
    wrap = {"full": "^(?:{})$", "prefix": "^(?:{})", "search": "{}"}[match]
    ordered = list(rules) if mode == "first" else list(reversed(rules))
    whens = " ".join(f"WHEN regexp_matches({code}, '{wrap.format(p)}') THEN '{n}'" for p, n in ordered)
    return f"CASE {whens} ELSE {default} END"


def scored(src: str, q: int = 5) -> str:
    """RFM scores over an rfm CTE ``src`` (S1 for R and M, S2 for F, S3 code)."""
    probs = ", ".join(repr(i / q) for i in range(q + 1))
    inner_r = " + ".join(f"CAST(Recency > er[{j + 1}] AS INTEGER)" for j in range(1, q))
    inner_m = " + ".join(f"CAST(Monetary > em[{j + 1}] AS INTEGER)" for j in range(1, q))
    return f"""SELECT customer_id, Recency, Frequency, Monetary,
         CAST({q} - ({inner_r}) AS INTEGER) AS Recency_score,
         CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ({q} * (rn - 1) + n - 2) // (n - 1)) END AS INTEGER) AS Frequency_score,
         CAST(1 + ({inner_m}) AS INTEGER) AS Monetary_score
  FROM (SELECT *, row_number() OVER (ORDER BY Frequency, customer_id) AS rn FROM {src}) s,
       (SELECT quantile_cont(Recency, [{probs}]) AS er, quantile_cont(Monetary, [{probs}]) AS em,
               count(*) AS n FROM {src}) e"""


def with_code(src: str) -> str:
    return f"""SELECT *, CAST(Recency_score AS VARCHAR) || CAST(Frequency_score AS VARCHAR)
         || CAST(Monetary_score AS VARCHAR) AS RFM_Score FROM {src}"""
