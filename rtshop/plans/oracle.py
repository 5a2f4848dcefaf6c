"""SQL counterparts of the registered queries, for DuckDB over the same sample tables."""

from __future__ import annotations

from rtshop.functions import scalars as S

_LOG = """
log AS (
  SELECT event_id, 'mid_' || user_id AS mid, CAST(user_id AS VARCHAR) AS uid, CAST(user_id % 7 AS VARCHAR) AS ar,
         event_type AS ch, 'v' || (k % 5) AS vc, event_type <> 'error' AS has_page,
         CASE WHEN event_type = 'error' OR k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN '' ELSE 'p' || k END
           AS last_page_id,
         ms AS ts, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS dt,
         strftime(make_timestamp(ms * 1000), '%H') AS hr
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, epoch_us(ts) // 1000 AS ms FROM events)
),
first_page AS (SELECT * FROM log WHERE has_page AND coalesce(last_page_id, '') = '')
"""
_DAU = _LOG + """,
dau AS (
  SELECT mid, uid, ar, ch, vc, dt, hr, ts FROM first_page
  QUALIFY row_number() OVER (PARTITION BY dt, mid ORDER BY ts, event_id) = 1
),
hourly AS (SELECT dt, hr, count(*) AS cnt FROM dau GROUP BY dt, hr)
"""

_ARRIVAL = "TIMESTAMP '2024-01-01' + to_seconds(({key} * 7919) % 2592000)"
_TEXT = "'%Y-%m-%d %H:%M:%S'"
_ORDERS = f"""
order_info AS (
  SELECT o_orderkey AS id, o_orderkey % 26 AS province_id, o_orderstatus AS order_status, o_custkey AS user_id,
         o_totalprice AS total_amount, CAST(0 AS DOUBLE) AS activity_reduce_amount,
         CAST(0 AS DOUBLE) AS coupon_reduce_amount, o_totalprice AS original_total_amount,
         CAST(0 AS DOUBLE) AS feight_fee, CAST(0 AS DOUBLE) AS feight_fee_reduce,
         strftime(arrived + to_seconds(900), {_TEXT}) AS expire_time, CAST(NULL AS VARCHAR) AS refundable_time,
         strftime(arrived, {_TEXT}) AS create_time, strftime(o_orderdate, {_TEXT}) AS operate_time,
         strftime(arrived, '%Y-%m-%d') AS create_date, strftime(arrived, '%H') AS create_hour, arrived,
         o_orderpriority AS priority
  FROM (SELECT *, {_ARRIVAL.format(key="o_orderkey")} AS arrived FROM orders)
)
"""
_DETAILS = f"""
order_detail AS (
  SELECT l_orderkey * 1000000000 + (l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 1299709
           + CAST(l_quantity AS BIGINT) * 15485863) % 1000000000 AS id,
         l_orderkey AS order_id, l_partkey AS sku_id, p_retailprice AS order_price,
         CAST(l_quantity AS BIGINT) AS sku_num, p_name AS sku_name, strftime(arrived, {_TEXT}) AS create_time,
         l_extendedprice AS split_total_amount, CAST(0 AS DOUBLE) AS split_activity_amount,
         CAST(0 AS DOUBLE) AS split_coupon_amount, arrived
  FROM (SELECT *, {_ARRIVAL.format(key="l_orderkey")}
                  + to_seconds((l_partkey * 7 + l_suppkey * 13 + l_linenumber * 131) % 1501 - 300) AS arrived
        FROM lineitem) LEFT JOIN part ON p_partkey = l_partkey
)
"""
_DIMS = """
user_info AS (
  SELECT c_custkey AS id, c_name AS name, DATE '1965-01-01' + CAST(c_custkey * 37 % 16000 AS INTEGER) AS birthday,
         CASE WHEN c_custkey % 50 = 7 THEN NULL WHEN c_custkey % 3 = 0 THEN 'F' ELSE 'M' END AS gender
  FROM customer
),
base_province AS (
  SELECT n_nationkey AS id, n_name AS name, CAST(n_nationkey * 1000 + 110000 AS VARCHAR) AS area_code,
         'CN-' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso_code, 'CN-P' || n_nationkey AS iso_3166_2
  FROM nation
)
"""
_AGE = "CAST((DATE '2024-01-01' - u.birthday) // 365 AS INTEGER)"
_WIDE_COLUMNS = f"""
  d.id AS detail_id, o.id AS order_id, d.sku_id, d.order_price, d.sku_num, d.sku_name, d.split_total_amount,
  d.split_activity_amount, d.split_coupon_amount, o.province_id, o.order_status, o.user_id, o.total_amount,
  o.activity_reduce_amount, o.coupon_reduce_amount, o.original_total_amount, o.feight_fee, o.feight_fee_reduce,
  o.expire_time, o.refundable_time, d.create_time, o.operate_time, o.create_date, o.create_hour,
  p.name AS province_name, p.area_code AS province_area_code, p.iso_3166_2 AS province_3166_2_code,
  p.iso_code AS province_iso_code, {_AGE} AS user_age, u.gender AS user_gender, o.create_date AS dt
"""
_FACTS = f"{_ORDERS}, {_DETAILS}, {_DIMS}"
_WIDE = f"""{_FACTS},
order_wide AS (
  SELECT {_WIDE_COLUMNS}
  FROM order_detail d JOIN order_info o ON o.id = d.order_id
  LEFT JOIN user_info u ON u.id = o.user_id LEFT JOIN base_province p ON p.id = o.province_id
)
"""
_HITS = _WIDE + """,
hits AS (
  SELECT * FROM order_wide
  WHERE list_has_all(regexp_extract_all(lower(sku_name), '[a-z0-9]+'), ['red', 'widget'])
),
ages AS (
  SELECT dt, user_age, count(*) AS cnt, sum(CAST(split_total_amount AS DECIMAL(18,2))) AS amount
  FROM hits WHERE user_age IS NOT NULL GROUP BY dt, user_age
  QUALIFY row_number() OVER (PARTITION BY dt ORDER BY count(*) DESC, user_age) <= 100
),
genders AS (
  SELECT dt, user_gender, count(*) AS cnt, sum(CAST(split_total_amount AS DECIMAL(18,2))) AS amount
  FROM hits WHERE user_gender IS NOT NULL GROUP BY dt, user_gender
  QUALIFY row_number() OVER (PARTITION BY dt ORDER BY count(*) DESC, user_gender) <= 2
),
all_ages AS (
  SELECT dt, user_age, sum(CAST(split_total_amount AS DECIMAL(18,2))) AS amount
  FROM hits WHERE user_age IS NOT NULL GROUP BY dt, user_age
),
all_genders AS (
  SELECT dt, user_gender, sum(CAST(split_total_amount AS DECIMAL(18,2))) AS amount
  FROM hits WHERE user_gender IS NOT NULL GROUP BY dt, user_gender
),
whole AS (SELECT dt, sum(amount) AS total FROM all_ages GROUP BY dt)
"""


def _percent(part: str) -> str:
    ratio = f"CAST(coalesce({part}, 0) AS DOUBLE) / nullif(CAST(w.total AS DOUBLE), 0)"
    return f"coalesce(floor({ratio} * 1000 + 0.5) / 10, 0.0)"


_CUSTOMER_CHANGES = """
changes AS (
  SELECT c_custkey AS id, 0 AS seq, 'INSERT' AS op, c_name AS name, 'M' AS gender, c_mktsegment AS segment
  FROM customer
  UNION ALL SELECT c_custkey, 1, 'UPDATE', c_name || '_t', '', NULL FROM customer
  WHERE c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')
  UNION ALL SELECT c_custkey, 2, 'UPDATE', c_name || '_u', '', NULL FROM customer
  WHERE c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')
  UNION ALL SELECT c_custkey, 3, 'DELETE', c_name || '_d', NULL, NULL FROM customer
  WHERE c_mktsegment = 'MACHINERY'
)
"""
_MERGED = """
merged AS (
  SELECT id, arg_max(name, seq) FILTER (WHERE name <> '') AS name,
         arg_max(gender, seq) FILTER (WHERE gender <> '') AS gender,
         arg_max(segment, seq) FILTER (WHERE segment <> '') AS segment, max(seq) AS last
  FROM changes GROUP BY id
)
"""
_MERGED_ROWS = f"WITH {_CUSTOMER_CHANGES}, {_MERGED} SELECT CAST(id AS VARCHAR) AS id, name, gender, segment FROM merged"
_ROWKEY = ("CASE WHEN length(CAST({0} AS VARCHAR)) < 10 THEN reverse(lpad(CAST({0} AS VARCHAR), 10, '0')) "
           "ELSE reverse(CAST({0} AS VARCHAR)) END")

_ORDER_JSON = """'{"id":"' || o_orderkey || '","user_id":"' || o_custkey || '","order_status":"' || o_orderstatus
  || '","total_amount":"' || CAST(o_totalprice AS DECIMAL(18,2)) || '"}'"""
_CLOSED_JSON = """'{"id":"' || o_orderkey || '","order_status":"CLOSED"}'"""
_DETAIL_JSON = """'{"id":"' || concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) || '","order_id":"'
  || l_orderkey || '","sku_id":"' || l_partkey || '","split_total_amount":"'
  || CAST(l_extendedprice AS DECIMAL(18,2)) || '"}'"""
_ROUTED = f"""
routed AS (
  SELECT 'DWD_ORDER_INFO_I' AS topic, CAST(o_orderkey AS VARCHAR) AS key, {_ORDER_JSON} AS value FROM orders
  UNION ALL SELECT 'DWD_ORDER_INFO_U', CAST(o_orderkey AS VARCHAR), {_ORDER_JSON} FROM orders
  WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'DWD_ORDER_INFO_U', CAST(o_orderkey AS VARCHAR), {_CLOSED_JSON} FROM orders
  WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'DWD_ORDER_INFO_D', CAST(o_orderkey AS VARCHAR), {_ORDER_JSON} FROM orders
  WHERE o_orderpriority = '5-LOW'
  UNION ALL SELECT 'DWD_ORDER_DETAIL_I', CAST(l_orderkey AS VARCHAR), {_DETAIL_JSON} FROM lineitem
  UNION ALL SELECT 'DWD_ORDER_DETAIL_U', CAST(l_orderkey AS VARCHAR), {_DETAIL_JSON} FROM lineitem
  WHERE l_returnflag = 'R'
)
"""
_CORRECTED = _WIDE + """,
corrected AS (
  SELECT * REPLACE (CASE WHEN sku_num % 4 = 3 THEN 'green gizmo' ELSE sku_name END AS sku_name,
                    CASE WHEN sku_num % 4 = 3 THEN 2 * split_total_amount ELSE split_total_amount END AS split_total_amount)
  FROM order_wide
),
own AS (SELECT *, regexp_extract_all(lower(sku_name), '[a-z0-9]+') AS terms FROM corrected)
"""
_LOG_COLUMNS = "event_id, mid, uid, ar, ch, vc, has_page, last_page_id, ts, dt, hr"
_NEAR = "epoch_us(d.arrived) - epoch_us(o.arrived) BETWEEN -600000000 AND 600000000"

ORACLE: dict[str, str] = {
    "log_normalize": f"WITH {_LOG} SELECT {_LOG_COLUMNS} FROM log",
    "first_page_views": f"WITH {_LOG} SELECT {_LOG_COLUMNS} FROM first_page",
    "first_page_window_count":
        f"WITH {_LOG} SELECT ts // 5000 * 5000 AS window_start, count(*) AS cnt FROM first_page GROUP BY 1",
    "dau_detail": f"WITH {_DAU} SELECT * FROM dau",
    "dau_total": f"WITH {_DAU} SELECT dt, count(*) AS total FROM dau GROUP BY dt",
    "dau_hourly": f"WITH {_DAU} SELECT dt, hr, cnt FROM hourly",
    "dau_hourly_compare": f"""
        WITH {_DAU},
        spine AS (
          SELECT dt, lpad(CAST(h AS VARCHAR), 2, '0') AS hr
          FROM (SELECT DISTINCT dt FROM hourly), (SELECT unnest(range(24)) AS h)
        )
        SELECT s.dt, s.hr, coalesce(t.cnt, 0) AS today, coalesce(y.cnt, 0) AS yesterday
        FROM spine s LEFT JOIN hourly t ON t.dt = s.dt AND t.hr = s.hr
        LEFT JOIN hourly y ON CAST(y.dt AS DATE) + 1 = CAST(s.dt AS DATE) AND y.hr = s.hr""",
    "cdc_route_facts": f"WITH {_ROUTED} SELECT topic, key, value FROM routed",
    "topic_partitions": f"""
        WITH {_ROUTED}
        SELECT topic, count(DISTINCT key) AS topic_keys, count(*) AS messages, CAST(0 AS BIGINT) AS split_keys
        FROM routed GROUP BY topic""",
    "dim_merge_latest": _MERGED_ROWS,
    "dim_merge_deletes": f"{_MERGED_ROWS} WHERE last < 3",
    "dim_merge_compacted": f"{_MERGED_ROWS} WHERE last < 3",
    "dim_merge_open": f"""
        WITH {_CUSTOMER_CHANGES}, {_MERGED}
        SELECT 'DIM_USER_INFO' AS dim_table, {_ROWKEY.format("id")} AS rowkey, name, cell
        FROM (
          SELECT id, 'id' AS name, CAST(id AS VARCHAR) AS cell FROM merged
          UNION ALL SELECT id, 'name', name FROM merged
          UNION ALL SELECT id, 'gender', gender FROM merged
          UNION ALL SELECT id, 'segment', segment FROM merged
        )""",
    "dim_rowkey": f"SELECT c_custkey, {_ROWKEY.format('c_custkey')} AS rowkey FROM customer",
    "bootstrap_envelope": """
        SELECT 'shop' AS database, 'user_info' AS "table", 'INSERT' AS type, 'id' AS pk, count(*) AS row_count,
               CAST(sum(c_custkey) AS BIGINT) AS id_sum, CAST(0 AS BIGINT) AS oversized FROM customer
        UNION ALL
        SELECT 'shop', 'base_province', 'INSERT', 'id', count(*), CAST(sum(n_nationkey) AS BIGINT), 0 FROM nation""",
    "order_typed_rows": f"WITH {_ORDERS} SELECT * EXCLUDE (arrived, priority) FROM order_info",
    "detail_typed_rows": f"WITH {_DETAILS} SELECT * EXCLUDE (arrived) FROM order_detail",
    "detail_set_collapse":
        f"WITH {_DETAILS} SELECT DISTINCT id, order_id, sku_id, sku_num, split_total_amount FROM order_detail",
    "order_with_user": f"""
        WITH {_ORDERS}, {_DIMS}
        SELECT o.id, o.user_id, o.total_amount, {_AGE} AS user_age, u.gender AS user_gender
        FROM order_info o LEFT JOIN user_info u ON u.id = o.user_id""",
    "order_user_as_of": f"""
        WITH {_ORDERS}, {_DIMS}
        SELECT o.id, o.user_id, CAST((CAST(o.arrived AS DATE) - u.birthday) // 365 AS INTEGER) AS user_age,
               CASE WHEN u.id IS NULL THEN NULL WHEN u.id % 3 = 0 THEN 'M'
                    WHEN o.arrived >= TIMESTAMP '2024-01-01' + to_seconds(u.id * 104729 % 1296000 + 1296000) THEN 'X'
                    WHEN o.arrived >= TIMESTAMP '2024-01-01' + to_seconds(u.id * 7919 % 1296000) THEN 'F'
                    ELSE 'M' END AS user_gender
        FROM order_info o LEFT JOIN user_info u ON u.id = o.user_id""",
    "snapshot_handoff": f"""
        WITH {_DIMS}
        SELECT CAST(u.id AS VARCHAR) AS id,
               CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN u.name || '_u' ELSE u.name END AS name, u.gender
        FROM user_info u JOIN customer ON c_custkey = u.id""",
    "order_with_province": f"""
        WITH {_ORDERS}, {_DIMS}
        SELECT o.id, o.province_id, p.name AS province_name, p.area_code AS province_area_code,
               p.iso_3166_2 AS province_3166_2_code, p.iso_code AS province_iso_code
        FROM order_info o LEFT JOIN base_province p ON p.id = o.province_id""",
    "order_detail_full_outer": f"""
        WITH {_ORDERS}, {_DETAILS}
        SELECT coalesce(o.id, d.order_id) AS order_id, d.id AS detail_id,
               CASE WHEN o.id IS NULL THEN 'detail' WHEN d.id IS NULL THEN 'order' ELSE 'both' END AS match
        FROM order_info o FULL OUTER JOIN order_detail d ON d.order_id = o.id""",
    "order_detail_interval": f"""
        WITH {_ORDERS}, {_DETAILS}
        SELECT o.id AS order_id, d.id AS detail_id,
               (epoch_us(d.arrived) - epoch_us(o.arrived)) // 1000000 AS lag_seconds
        FROM order_info o JOIN order_detail d ON d.order_id = o.id AND {_NEAR}""",
    "order_detail_hot": f"""
        WITH {_ORDERS}, {_DETAILS}
        SELECT o.id AS order_id, d.id AS detail_id,
               (epoch_us(d.arrived) - epoch_us(o.arrived)) // 1000000 AS lag_seconds
        FROM order_info o JOIN order_detail d ON d.order_id = o.id AND {_NEAR}""",
    "order_wide": f"WITH {_WIDE} SELECT * FROM order_wide",
    "upsert_latest_by_id": f"""
        WITH {_ORDERS}
        SELECT create_date AS dt, id,
               CASE WHEN priority = '5-LOW' THEN 'DROPPED' WHEN order_status = 'F' THEN 'CLOSED' ELSE order_status
               END AS order_status, total_amount,
               CAST(CASE WHEN priority = '5-LOW' THEN 2 WHEN order_status = 'F' THEN 1 ELSE 0 END AS BIGINT) AS save
        FROM order_info""",
    "sale_search_total": f"WITH {_HITS} SELECT dt, count(*) AS total FROM hits GROUP BY dt",
    "sale_search_page": f"WITH {_HITS} SELECT * FROM hits ORDER BY detail_id LIMIT 20 OFFSET 20",
    "sale_age_agg":
        f"WITH {_HITS} SELECT dt, user_age, cnt, CAST(amount AS DOUBLE) AS order_amount FROM ages",
    "sale_gender_agg":
        f"WITH {_HITS} SELECT dt, user_gender, cnt, CAST(amount AS DOUBLE) AS order_amount FROM genders",
    "sale_age_share": f"""
        WITH {_HITS},
        bands AS (
          SELECT dt, CASE WHEN user_age < 20 THEN 0 WHEN user_age < 30 THEN 1 ELSE 2 END AS band,
                 sum(amount) AS amount
          FROM all_ages GROUP BY 1, 2
        ),
        labels_ AS (SELECT 0 AS band, '{S.AGE_BANDS[0]}' AS name UNION ALL SELECT 1, '{S.AGE_BANDS[1]}'
                    UNION ALL SELECT 2, '{S.AGE_BANDS[2]}')
        SELECT w.dt, '{S.AGE_TITLE}' AS title, l.name, {_percent("b.amount")} AS value
        FROM whole w CROSS JOIN labels_ l LEFT JOIN bands b ON b.dt = w.dt AND b.band = l.band""",
    "sale_gender_share": f"""
        WITH {_HITS},
        sides AS (
          SELECT dt, CASE WHEN user_gender = 'M' THEN '{S.GENDER_MALE}' ELSE '{S.GENDER_FEMALE}' END AS name,
                 sum(amount) AS amount
          FROM all_genders GROUP BY 1, 2
        ),
        days AS (SELECT dt FROM whole UNION SELECT dt FROM all_genders),
        labels_ AS (SELECT '{S.GENDER_MALE}' AS name UNION ALL SELECT '{S.GENDER_FEMALE}')
        SELECT y.dt, '{S.GENDER_TITLE}' AS title, l.name, {_percent("s.amount")} AS value
        FROM days y CROSS JOIN labels_ l LEFT JOIN whole w ON w.dt = y.dt
        LEFT JOIN sides s ON s.dt = y.dt AND s.name = l.name""",
    "province_sales": f"""
        WITH {_WIDE}
        SELECT province_name, province_area_code, province_iso_code, province_3166_2_code,
               CAST(sum(sku_num) AS BIGINT) AS sku_num,
               CAST(sum(CAST(split_total_amount AS DECIMAL(18,2))) AS DOUBLE) AS order_amount
        FROM order_wide GROUP BY ALL""",
    "search_topk_highlight": r"""
        SELECT p_name, p_retailprice, regexp_replace(p_name, '\b(red|widget)\b', '<span>\1</span>', 'gi') AS highlight
        FROM part WHERE list_has_any(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ['red', 'widget'])
        ORDER BY p_retailprice DESC, p_partkey LIMIT 2""",
    "report_realtime_hour": f"""
        WITH {_DAU}
        SELECT lpad(CAST(h AS VARCHAR), 2, '0') AS hr, coalesce(t.cnt, 0) AS today, coalesce(y.cnt, 0) AS yesterday
        FROM (SELECT unnest(range(24)) AS h)
        LEFT JOIN hourly t ON t.dt = '2024-01-10' AND t.hr = lpad(CAST(h AS VARCHAR), 2, '0')
        LEFT JOIN hourly y ON y.dt = '2024-01-09' AND y.hr = lpad(CAST(h AS VARCHAR), 2, '0')""",
    "report_sale_stat": f"""
        WITH {_HITS},
        parts AS (
          SELECT CASE WHEN user_age < 20 THEN '{S.AGE_BANDS[0]}' WHEN user_age < 30 THEN '{S.AGE_BANDS[1]}'
                 ELSE '{S.AGE_BANDS[2]}' END AS name, sum(amount) AS amount
          FROM all_ages WHERE dt = '2024-01-10' GROUP BY 1
          UNION ALL
          SELECT CASE WHEN user_gender = 'M' THEN '{S.GENDER_MALE}' ELSE '{S.GENDER_FEMALE}' END, sum(amount)
          FROM all_genders WHERE dt = '2024-01-10' GROUP BY 1
        ),
        labels_ (title, name) AS (VALUES
          ('{S.AGE_TITLE}', '{S.AGE_BANDS[0]}'), ('{S.AGE_TITLE}', '{S.AGE_BANDS[1]}'),
          ('{S.AGE_TITLE}', '{S.AGE_BANDS[2]}'), ('{S.GENDER_TITLE}', '{S.GENDER_MALE}'),
          ('{S.GENDER_TITLE}', '{S.GENDER_FEMALE}'))
        SELECT l.title, l.name, {_percent("p.amount")} AS value
        FROM labels_ l LEFT JOIN parts p ON p.name = l.name LEFT JOIN whole w ON w.dt = '2024-01-10'""",
    "sale_hits_index": f"""
        WITH {_CORRECTED}
        SELECT dt, detail_id, sku_name, sku_num, split_total_amount FROM own
        WHERE dt = '2024-01-10' AND list_has_all(terms, ['red', 'widget'])""",
    "sale_page_index": f"""
        WITH {_CORRECTED}
        SELECT dt, detail_id, sku_name, sku_num, split_total_amount FROM own
        WHERE dt = '2024-01-10' AND list_contains(terms, 'gizmo') ORDER BY detail_id LIMIT 20 OFFSET 40""",
    "sale_relevant_page": f"""
        WITH {_CORRECTED},
        day AS (SELECT detail_id, sku_name, terms FROM own WHERE dt = '2024-01-10' AND sku_name IS NOT NULL),
        stats AS (SELECT count(*) AS n, avg(len(terms)) AS mean,
                         count(*) FILTER (WHERE list_contains(terms, 'red')) AS red,
                         count(*) FILTER (WHERE list_contains(terms, 'gizmo')) AS gizmo FROM day),
        parts AS (
          SELECT d.*, n, red, gizmo, 1.2 * (0.25 + 0.75 * len(terms) / mean) AS norm,
                 CAST(len(list_filter(terms, lambda x: x = 'red')) AS DOUBLE) AS tf_red,
                 CAST(len(list_filter(terms, lambda x: x = 'gizmo')) AS DOUBLE) AS tf_gizmo
          FROM day d, stats WHERE list_has_any(terms, ['red', 'gizmo'])
        )
        SELECT detail_id, sku_name,
               round(ln(1.0 + (n - gizmo + 0.5) / (gizmo + 0.5)) * tf_gizmo * 2.2 / (tf_gizmo + norm)
                     + ln(1.0 + (n - red + 0.5) / (red + 0.5)) * tf_red * 2.2 / (tf_red + norm), 6) AS score
        FROM parts ORDER BY score DESC, detail_id LIMIT 20 OFFSET 20""",
    "sale_cube_kept": f"""
        WITH {_CORRECTED}
        SELECT dt, user_age, user_gender, count(*) AS cnt,
               CAST(sum(CAST(split_total_amount AS DECIMAL(18,2))) AS DOUBLE) AS amount
        FROM own WHERE list_has_all(terms, ['red', 'widget']) GROUP BY 1, 2, 3""",
    "stream_dau": f"""
        WITH {_DAU}
        SELECT * FROM dau
        UNION ALL SELECT 'ahead', 'u', '1', 'web', 'v1', '2099-01-01', '00', 4070908800000""",
    "stream_rejects": f"""
        WITH {_DAU}
        SELECT 'devices' AS what, count(DISTINCT (dt, mid)) AS cnt FROM first_page WHERE event_id % 10 <> 0
        UNION ALL
        SELECT 'rejects', (SELECT count(*) FROM log WHERE event_id % 20 = 0)
                          + (SELECT count(*) FROM first_page WHERE event_id % 20 = 10)""",
    "stream_cdc_route": f"WITH {_ROUTED} SELECT topic, key, value FROM routed",
    "stream_dim_merge": _MERGED_ROWS,
    "stream_dim_roll": f"""
        WITH {_CUSTOMER_CHANGES}, {_MERGED},
        early AS (
          SELECT CAST(id AS VARCHAR) AS id, arg_max(name, seq) FILTER (WHERE name <> '') AS name,
                 arg_max(gender, seq) FILTER (WHERE gender <> '') AS gender,
                 arg_max(segment, seq) FILTER (WHERE segment <> '') AS segment
          FROM changes WHERE seq < 3 GROUP BY 1
        )
        SELECT 'meanwhile' AS phase, * FROM early UNION ALL SELECT 'rolled', * FROM early
        UNION ALL SELECT 'end', CAST(id AS VARCHAR), name, gender, segment FROM merged""",
    "day_table_roll": f"""
        WITH {_ORDERS},
        early AS (SELECT create_date AS dt, CASE WHEN order_status = 'F' THEN 'CLOSED' ELSE order_status END AS order_status,
                         count(*) AS cnt FROM order_info GROUP BY 1, 2)
        SELECT 'meanwhile' AS phase, * FROM early UNION ALL SELECT 'rolled', * FROM early
        UNION ALL
        SELECT 'end', create_date, CASE WHEN priority = '5-LOW' THEN 'DROPPED' WHEN order_status = 'F' THEN 'CLOSED'
               ELSE order_status END AS status, count(*) FROM order_info GROUP BY 2, 3""",
    "stream_order_wide": f"""
        WITH {_FACTS}
        SELECT {_WIDE_COLUMNS}
        FROM order_detail d JOIN order_info o ON o.id = d.order_id AND {_NEAR}
        LEFT JOIN user_info u ON u.id = o.user_id LEFT JOIN base_province p ON p.id = o.province_id""",
    "stream_chain": f"""
        WITH {_FACTS}
        SELECT o.create_date AS dt, d.id AS detail_id, d.order_id, d.sku_name, d.split_total_amount, {_AGE} AS user_age,
               u.gender AS user_gender, p.name AS province_name
        FROM order_detail d JOIN order_info o ON o.id = d.order_id AND {_NEAR}
        LEFT JOIN user_info u ON u.id = o.user_id LEFT JOIN base_province p ON p.id = o.province_id""",
    "stream_progress": f"""
        WITH {_DAU}
        SELECT 'dau' AS job, (SELECT count(*) FROM log) AS input_rows, CAST(0 AS BIGINT) AS gaps,
               CAST(0 AS BIGINT) AS refused""",
}
