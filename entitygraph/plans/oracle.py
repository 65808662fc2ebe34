"""DuckDB SQL text for the oracle side of the registered queries.

The SQL restates each query's semantics independently of the Spark code,
over the same parquet tables (views ``customer``, ``orders``, ``pages`` ...).
"""

from __future__ import annotations

from ..schema import PAGERANK_ITERATIONS, PAGERANK_RESET

AS_OF = "2001-12-31"

TRADE_CTES = """
li AS (SELECT l_suppkey, l_partkey, max(l_shipdate) AS d FROM lineitem GROUP BY l_suppkey, l_partkey),
raw_v AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id, 'customer' AS t, c_name AS label, CAST(o.d AS DATE) AS last_seen
    FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY o_custkey) o
      ON o.o_custkey = customer.c_custkey
  UNION ALL
  SELECT 's' || CAST(s_suppkey AS VARCHAR), 'supplier', s_name, CAST(x.d AS DATE)
    FROM supplier LEFT JOIN (SELECT l_suppkey, max(d) AS d FROM li GROUP BY l_suppkey) x ON x.l_suppkey = supplier.s_suppkey
  UNION ALL
  SELECT 'p' || CAST(p_partkey AS VARCHAR), 'part', p_name, CAST(x.d AS DATE)
    FROM part LEFT JOIN (SELECT l_partkey, max(d) AS d FROM li GROUP BY l_partkey) x ON x.l_partkey = part.p_partkey
  UNION ALL
  SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'nation', n_name, CAST(NULL AS DATE) FROM nation
  UNION ALL
  SELECT 'r' || CAST(r_regionkey AS VARCHAR), 'region', r_name, CAST(NULL AS DATE) FROM region
),
raw_e AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS src, 'n' || CAST(c_nationkey AS VARCHAR) AS dst FROM customer
  UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation
  UNION ALL SELECT 's' || CAST(l_suppkey AS VARCHAR), 'p' || CAST(l_partkey AS VARCHAR) FROM li
)"""

WEB_CTES = r"""
pg AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, html FROM pages),
lk AS (SELECT 'p:' || CAST(page_id AS VARCHAR) AS page, host,
              unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS link FROM pg),
raw_v AS (
  SELECT DISTINCT 'h:' || host AS id, 'host' AS t, host AS label, CAST(NULL AS DATE) AS last_seen FROM pg
  UNION ALL SELECT 'p:' || CAST(page_id AS VARCHAR), 'page', url, CAST(NULL AS DATE) FROM pg
  UNION ALL SELECT DISTINCT 'u:' || host || link, 'url', host || link, CAST(NULL AS DATE) FROM lk
),
raw_e AS (
  SELECT DISTINCT src, dst FROM (
    SELECT 'h:' || host AS src, 'p:' || CAST(page_id AS VARCHAR) AS dst FROM pg
    UNION ALL SELECT page, 'u:' || host || link FROM lk)
)"""

# cleaned graph over raw_v / raw_e: dedupe ids (newest last_seen, then t,
# label), drop null ids, keep edges whose two ends are vertices
def clean_ctes(raw_v: str = "raw_v", raw_e: str = "raw_e") -> str:
    return f"""
v AS (
  SELECT id, t, label, last_seen FROM {raw_v} WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_seen DESC NULLS LAST, t NULLS FIRST, label NULLS FIRST) = 1
),
e AS (
  SELECT src, dst FROM {raw_e}
  WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)
)"""


CLEAN_CTES = clean_ctes()


def pagerank_ctes(iterations: int = PAGERANK_ITERATIONS, reset: float = PAGERANK_RESET) -> str:
    """``pr(id, pagerank)`` over ``v``/``e``: the rounds unrolled as CTEs."""
    keep = 1.0 - reset
    parts = ["deg AS (SELECT src, count(*) AS outdeg FROM e GROUP BY src)",
             "ew AS (SELECT src, dst, count(*) AS mult FROM e GROUP BY src, dst)",
             "r0 AS (SELECT id, CAST(1.0 AS DOUBLE) AS r FROM v)"]
    for i in range(1, iterations + 1):
        parts.append(
            f"r{i} AS (SELECT v.id, CAST({reset!r} AS DOUBLE) + CAST({keep!r} AS DOUBLE) * coalesce(c.s, 0.0) AS r "
            f"FROM v LEFT JOIN (SELECT ew.dst, sum(ew.mult * (p.r / d.outdeg)) AS s FROM ew "
            f"JOIN r{i - 1} p ON p.id = ew.src JOIN deg d ON d.src = ew.src GROUP BY ew.dst) c ON c.dst = v.id)")
    parts.append(f"pr AS (SELECT id, r * (SELECT count(*) FROM v) / (SELECT sum(r) FROM r{iterations}) AS pagerank "
                 f"FROM r{iterations})")
    return ",\n".join(parts)


def metrics_ctes(half_life: float = 30.0, as_of: str = AS_OF) -> str:
    """``nm``: node metrics over ``v`` and ``pr``."""
    return f"""
rw AS (
  SELECT v.id, v.label, v.t, v.last_seen, pr.pagerank,
         CASE WHEN v.last_seen IS NULL THEN 1.0
              ELSE power(0.5, CAST(date_diff('day', v.last_seen, DATE '{as_of}') AS DOUBLE) / {float(half_life)!r}) END
           AS recency_weight
  FROM v JOIN pr ON pr.id = v.id
),
rt AS (SELECT *, pagerank * recency_weight AS pagerank_temporal FROM rw),
nm AS (
  SELECT id, label, t, last_seen, pagerank,
         round(pagerank / (SELECT sum(pagerank) FROM rt) * 100.0, 6) AS pr_percent,
         recency_weight, pagerank_temporal,
         round(pagerank_temporal / (SELECT sum(pagerank_temporal) FROM rt) * 100.0, 6) AS pr_temporal_percent
  FROM rt
)"""


def components_ctes(v: str = "v", e: str = "e") -> str:
    """``comp(id, component)`` over ``v``/``e`` by reachability closure
    (use on graphs of small components only)."""
    return f"""
und AS (SELECT src AS a, dst AS b FROM {e} WHERE src <> dst UNION SELECT dst, src FROM {e} WHERE src <> dst),
reach(s, id) AS (SELECT id, id FROM {v} UNION SELECT r.s, u.b FROM reach r JOIN und u ON u.a = r.id),
comp AS (SELECT s AS id, min(id) AS component FROM reach GROUP BY s)"""


def label_propagation_ctes(rounds: int = 10, v: str = "v", e: str = "e") -> str:
    """``comp(id, component)`` over ``v``/``e`` by min-label propagation,
    ``rounds`` unrolled (exact when ``rounds`` >= the graph's diameter)."""
    parts = [f"und AS (SELECT src AS a, dst AS b FROM {e} WHERE src <> dst UNION SELECT dst, src FROM {e} WHERE src <> dst)",
             f"l0 AS (SELECT id, id AS c FROM {v})"]
    for i in range(1, rounds + 1):
        parts.append(
            f"l{i} AS (SELECT l.id, least(l.c, coalesce(m.mc, l.c)) AS c FROM l{i - 1} l LEFT JOIN "
            f"(SELECT u.a AS id, min(p.c) AS mc FROM und u JOIN l{i - 1} p ON p.id = u.b GROUP BY u.a) m "
            f"ON m.id = l.id)")
    parts.append(f"comp AS (SELECT id, c AS component FROM l{rounds})")
    return ",\n".join(parts)


def layers_ctes(max_depth: int = 16, metric: str = "pr_percent") -> str:
    """``roots(component, root)`` and ``lay(component, id, root, layer)``;
    needs ``comp``, ``und`` and ``nm``."""
    return f"""
roots AS (
  SELECT component, id AS root FROM (
    SELECT c.component, c.id, row_number() OVER (PARTITION BY c.component
             ORDER BY coalesce(nm.{metric}, 0.0) DESC, c.id) AS rn
    FROM comp c LEFT JOIN nm ON nm.id = c.id) WHERE rn = 1
),
walk(component, root, id, layer) AS (
  SELECT component, root, root, 0 FROM roots
  UNION
  SELECT w.component, w.root, u.b, w.layer + 1 FROM walk w JOIN und u ON u.a = w.id WHERE w.layer < {max_depth}
),
lay AS (
  SELECT c.component, c.id, r.root, CAST(coalesce(x.layer, 0) AS INTEGER) AS layer
  FROM comp c JOIN roots r ON r.component = c.component
  LEFT JOIN (SELECT id, min(layer) AS layer FROM walk GROUP BY id) x ON x.id = c.id
)"""


def with_ctes(*blocks: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(b.strip().rstrip(",") for b in blocks if b.strip())
