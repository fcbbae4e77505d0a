"""The same queries as SQL over the given tables, for a second engine to check."""

from __future__ import annotations

from cartloom.functions.requests import EMPTY_RECORDS
from cartloom.functions.words import STOP_WORDS
from cartloom.operators.features import PAIR_EXT, PRODUCT_KEY, SERVING_FEATURES, USER_EXT
from cartloom.operators.profile import FEATURES
from cartloom.plans.queries import RARE_PURCHASES

BASE = """
placed AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS d,
         row_number() OVER w AS n, lag(o_orderdate) OVER w AS prev,
         count(*) OVER (PARTITION BY o_custkey) AS total
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
),
m_orders AS (
  SELECT order_id, user_id,
         CASE WHEN n < total THEN 'prior' WHEN user_id % 3 <> 0 THEN 'train' ELSE 'test' END AS eval_set,
         CAST(n AS INTEGER) AS order_number,
         CAST(dayofweek(d) AS INTEGER) AS order_dow,
         CAST(order_id % 24 AS INTEGER) AS order_hour_of_day,
         CAST(date_diff('day', prev, d) % 31 AS DOUBLE) AS days_since_prior_order
  FROM placed
),
line_base AS (
  SELECT l_orderkey AS order_id,
         ((l_partkey % 200) * (l_partkey % 200) * (l_partkey % 200)) // 40000 AS product_id,
         min(l_linenumber) AS ln
  FROM lineitem GROUP BY 1, 2
),
m_lines AS (
  SELECT b.order_id, b.product_id,
         CAST(row_number() OVER (PARTITION BY b.order_id ORDER BY ln, product_id) AS INTEGER) AS add_to_cart_order,
         CAST(o.order_number > min(o.order_number) OVER (PARTITION BY o.user_id, b.product_id) AS INTEGER) AS reordered,
         o.eval_set
  FROM line_base b JOIN m_orders o USING (order_id)
),
m_prior AS (SELECT order_id, product_id, add_to_cart_order, reordered FROM m_lines WHERE eval_set = 'prior'),
m_train AS (SELECT order_id, product_id, add_to_cart_order, reordered FROM m_lines WHERE eval_set = 'train'),
prior_orders AS (SELECT * FROM m_orders WHERE eval_set = 'prior'),
train_orders AS (SELECT * FROM m_orders WHERE eval_set = 'train'),
m_aisles AS (
  SELECT CAST(row_number() OVER (ORDER BY p_brand) AS INTEGER) AS aisle_id, p_brand AS aisle
  FROM (SELECT DISTINCT p_brand FROM part)
),
m_departments AS (
  SELECT CAST(row_number() OVER (ORDER BY p_type) AS INTEGER) AS department_id, p_type AS department
  FROM (SELECT DISTINCT p_type FROM part)
),
part_ids AS (
  SELECT ((p_partkey % 200) * (p_partkey % 200) * (p_partkey % 200)) // 40000 AS product_id, *
  FROM part
),
m_products AS (
  SELECT product_id, p_name || ' ' || p_type AS product_name, aisle_id, department_id
  FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY p_partkey) AS i FROM part_ids)
  JOIN m_aisles ON aisle = p_brand JOIN m_departments ON department = p_type
  WHERE i = 1
),
prior_op AS (
  SELECT p.*, o.user_id, o.order_number, o.order_dow, o.order_hour_of_day, o.days_since_prior_order
  FROM m_prior p JOIN prior_orders o USING (order_id)
),
user_ext AS (
  SELECT o.*, l.* EXCLUDE (user_id),
         CAST(user_total_reorders AS DOUBLE) / user_total_products AS user_reorder_rate,
         CAST(user_total_products AS DOUBLE) / user_total_orders AS user_avg_basket_size
  FROM (
    SELECT user_id, count(order_id) AS user_total_orders,
           avg(days_since_prior_order) AS user_avg_days_between,
           coalesce(stddev_samp(days_since_prior_order), 0) AS user_std_days_between,
           min(days_since_prior_order) AS user_min_days_between,
           max(days_since_prior_order) AS user_max_days_between,
           avg(order_hour_of_day) AS user_avg_order_hour,
           coalesce(stddev_samp(order_hour_of_day), 0) AS user_std_order_hour
    FROM prior_orders GROUP BY user_id
  ) o LEFT JOIN (
    SELECT user_id, count(product_id) AS user_total_products,
           count(DISTINCT product_id) AS user_unique_products,
           CAST(sum(reordered) AS BIGINT) AS user_total_reorders
    FROM prior_op GROUP BY user_id
  ) l ON o.user_id = l.user_id
),
by_product AS (
  SELECT product_id, count(order_id) AS product_total_orders, avg(reordered) AS product_reorder_rate,
         avg(add_to_cart_order) AS product_avg_cart_pos,
         coalesce(stddev_samp(add_to_cart_order), 0) AS product_std_cart_pos,
         count(DISTINCT user_id) AS product_unique_users
  FROM prior_op GROUP BY product_id
),
product_named AS (
  SELECT b.*, p.product_name, p.aisle_id, p.department_id, d.department, a.aisle
  FROM by_product b LEFT JOIN m_products p USING (product_id)
  LEFT JOIN m_departments d USING (department_id) LEFT JOIN m_aisles a USING (aisle_id)
),
dept_rates AS (
  SELECT department, avg(product_reorder_rate) AS dept_avg_reorder_rate
  FROM product_named WHERE department IS NOT NULL GROUP BY department
),
aisle_rates AS (
  SELECT aisle, avg(product_reorder_rate) AS aisle_avg_reorder_rate
  FROM product_named WHERE aisle IS NOT NULL GROUP BY aisle
),
product_ext AS (
  SELECT n.*, dept_avg_reorder_rate, aisle_avg_reorder_rate
  FROM product_named n LEFT JOIN dept_rates USING (department) LEFT JOIN aisle_rates USING (aisle)
),
pair_base AS (
  SELECT user_id, product_id, count(order_id) AS up_times_ordered,
         CAST(sum(reordered) AS BIGINT) AS up_reorder_count,
         avg(add_to_cart_order) AS up_avg_cart_position,
         min(order_number) AS up_first_order_number, max(order_number) AS up_last_order_number
  FROM prior_op GROUP BY user_id, product_id
),
user_last AS (SELECT user_id, max(order_number) AS user_max_order FROM prior_orders GROUP BY user_id),
pair_ext AS (
  SELECT user_id, product_id, up_times_ordered, up_reorder_count, up_avg_cart_position,
         up_first_order_number, up_last_order_number,
         CAST(up_reorder_count AS DOUBLE) / up_times_ordered AS up_reorder_rate,
         up_last_order_number - up_first_order_number AS up_orders_span,
         CAST(up_times_ordered AS DOUBLE) / (up_last_order_number - up_first_order_number + 1) AS up_buy_frequency,
         user_max_order,
         user_max_order - up_last_order_number AS up_orders_since_last,
         1.0::DOUBLE / (user_max_order - up_last_order_number + 1) AS up_recency_score
  FROM pair_base LEFT JOIN user_last USING (user_id)
),
matrix AS (
  SELECT p.user_id, p.product_id, o.order_id, {pair}, {user}, {product},
         CAST(coalesce(t.reordered, 0) AS INTEGER) AS reordered
  FROM pair_ext p JOIN train_orders o ON o.user_id = p.user_id
  LEFT JOIN user_ext u ON u.user_id = p.user_id
  LEFT JOIN product_ext q ON q.product_id = p.product_id
  LEFT JOIN m_train t ON t.order_id = o.order_id AND t.product_id = p.product_id
),
f1 AS (
  SELECT * FROM (
    SELECT user_id, max(order_number) AS u_total_orders,
           avg(days_since_prior_order) AS u_avg_days_between_orders
    FROM m_orders GROUP BY user_id
  ) LEFT JOIN (
    SELECT user_id, avg(basket) AS u_avg_basket_size
    FROM (SELECT order_id, max(add_to_cart_order) AS basket FROM m_prior GROUP BY order_id)
    JOIN m_orders USING (order_id) GROUP BY user_id
  ) USING (user_id) LEFT JOIN (
    SELECT user_id, avg(reordered) AS u_reorder_ratio
    FROM m_prior JOIN m_orders USING (order_id) GROUP BY user_id
  ) USING (user_id)
),
f4 AS (
  SELECT product_id, count(*) AS p_total_purchases, avg(reordered) AS p_reorder_prob,
         avg(add_to_cart_order) AS p_avg_cart_position
  FROM m_prior GROUP BY product_id
),
f5 AS (
  SELECT user_id, product_id, up_total_purchases, up_first_order_num, up_last_order_num,
         CAST(up_total_purchases AS DOUBLE) / (total - up_first_order_num + 1) AS up_order_rate,
         CAST(up_total_purchases AS DOUBLE) / total AS up_order_rate_since_first_play
  FROM (
    SELECT user_id, product_id, count(*) AS up_total_purchases,
           min(order_number) AS up_first_order_num, max(order_number) AS up_last_order_num
    FROM m_prior JOIN m_orders USING (order_id) GROUP BY user_id, product_id
  ) JOIN (SELECT user_id, max(order_number) AS total FROM m_orders GROUP BY user_id) USING (user_id)
),
f9 AS (
  SELECT user_id, product_id, {serving}
  FROM f5 LEFT JOIN f1 USING (user_id) LEFT JOIN f4 USING (product_id)
),
past_f1 AS (
  SELECT user_id, max(order_number) AS u_total_orders, avg(days_since_prior_order) AS u_avg_days_between_orders,
         avg(basket) AS u_avg_basket_size, CAST(sum(r) AS DOUBLE) / sum(n) AS u_reorder_ratio
  FROM prior_orders LEFT JOIN (
    SELECT order_id, max(add_to_cart_order) AS basket, sum(reordered) AS r, count(*) AS n
    FROM m_prior GROUP BY order_id) USING (order_id)
  GROUP BY user_id
),
past_f9 AS (
  SELECT user_id, product_id, up_times_ordered AS up_total_purchases,
         up_first_order_number AS up_first_order_num, up_last_order_number AS up_last_order_num,
         CAST(up_times_ordered AS DOUBLE) / (u_total_orders - up_first_order_number + 1) AS up_order_rate,
         CAST(up_times_ordered AS DOUBLE) / u_total_orders AS up_order_rate_since_first_play,
         past_f1.* EXCLUDE (user_id), f4.* EXCLUDE (product_id)
  FROM pair_base JOIN past_f1 USING (user_id) LEFT JOIN f4 USING (product_id)
),
scored AS (SELECT user_id, product_id, up_order_rate AS reorder_probability FROM f5),
ranked AS (
  SELECT s.*, CAST(row_number() OVER (PARTITION BY user_id ORDER BY reorder_probability DESC, product_id) AS INTEGER) AS rank,
         product_name
  FROM scored s LEFT JOIN m_products USING (product_id)
),
popular AS (
  SELECT product_id, product_name, coalesce(p_reorder_prob, 0) AS reorder_probability,
         CAST(row_number() OVER (ORDER BY p_reorder_prob DESC, p_total_purchases DESC, product_id) AS INTEGER) AS rank
  FROM f4 LEFT JOIN m_products USING (product_id)
),
eval AS (
  SELECT m.user_id, m.product_id, m.reordered, s.reorder_probability AS score
  FROM matrix m JOIN scored s USING (user_id, product_id)
),
asked AS (
  SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS user_id
  FROM customer
),
known AS (SELECT DISTINCT user_id FROM m_orders JOIN m_prior USING (order_id)),
requests AS (
  SELECT c_custkey AS request_id, CASE c_custkey % 8
    WHEN 0 THEN '{{"dataframe_records": [' || plain || ']}}'
    WHEN 1 THEN plain
    WHEN 2 THEN '{{"user_id": "' || c_custkey || '", "top_k": "' || k || '"}}'
    WHEN 3 THEN '{{"user_id": ' || c_custkey || '}}'
    WHEN 4 THEN '{{"user_id": ' || c_custkey
    WHEN 5 THEN '{{"dataframe_records": []}}'
    WHEN 6 THEN '{{"top_k": ' || k || '}}'
    ELSE '{{"user_id": ' || (c_custkey + 1000000000) || ', "top_k": ' || k || ', "threshold": ' || t || '}}'
    END AS raw
  FROM (
    SELECT *, '{{"user_id": ' || c_custkey || ', "top_k": ' || k || ', "threshold": ' || t || '}}' AS plain
    FROM (SELECT c_custkey, c_custkey % 12 + 1 AS k, '0.' || (c_custkey % 5) AS t FROM customer)
  )
),
opened AS (
  SELECT request_id, json_valid(raw) AS ok,
         CASE WHEN json_valid(raw) THEN raw END AS doc FROM requests
),
fields AS (
  SELECT request_id, ok, json_exists(doc, '$.dataframe_records') AS wrapped,
         CASE WHEN json_exists(doc, '$.dataframe_records')
              THEN json_extract(doc, '$.dataframe_records[0]') ELSE CAST(doc AS JSON) END AS r
  FROM opened
),
parsed AS (
  SELECT request_id, CASE WHEN error IS NULL THEN user_id END AS user_id,
         CASE WHEN error IS NULL THEN top_k END AS top_k,
         CASE WHEN error IS NULL THEN threshold END AS threshold, error
  FROM (
    SELECT request_id, try_cast(json_extract_string(r, '$.user_id') AS BIGINT) AS user_id,
           coalesce(try_cast(json_extract_string(r, '$.top_k') AS BIGINT), 10) AS top_k,
           coalesce(try_cast(json_extract_string(r, '$.threshold') AS DOUBLE), 0.0) AS threshold,
           CASE WHEN NOT ok THEN 'Invalid input format: not JSON'
                WHEN wrapped AND r IS NULL THEN '{empty}'
                WHEN json_extract_string(r, '$.user_id') IS NULL THEN 'Invalid input format: user_id'
                END AS error
    FROM fields
  )
),
answers AS (
  SELECT q.request_id, q.user_id,
         CASE WHEN k.user_id IS NULL THEN 'Global Popularity' ELSE 'Personalized' END AS mode,
         x.rank, x.product_id, x.product_name, x.reorder_probability, CAST(NULL AS VARCHAR) AS error
  FROM parsed q LEFT JOIN known k USING (user_id)
  LEFT JOIN (
    SELECT request_id, r.* EXCLUDE (user_id) FROM parsed p JOIN ranked r USING (user_id)
    WHERE error IS NULL AND r.rank <= top_k AND r.reorder_probability >= threshold
    UNION ALL BY NAME
    SELECT request_id, c.* FROM parsed p JOIN popular c ON c.rank <= top_k AND c.reorder_probability >= threshold
    WHERE error IS NULL AND user_id NOT IN (SELECT user_id FROM known)
  ) x ON x.request_id = q.request_id
  WHERE error IS NULL
  UNION ALL
  SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, error FROM parsed WHERE error IS NOT NULL
)
"""


def _base() -> str:
    def cols(names, prefix):
        return ", ".join(f"{prefix}.{n}" for n in names)

    return BASE.format(
        pair=cols(PAIR_EXT, "p"),
        user=cols(USER_EXT, "u"),
        product=cols(PRODUCT_KEY, "q"),
        serving=", ".join(f"coalesce({c}, 0) AS {c}" for c in SERVING_FEATURES),
        empty=EMPTY_RECORDS,
    )


def _median(v: str) -> str:
    return f"CAST(median({v}) AS DOUBLE)"


TABLES = {
    "orders": (
        "m_orders",
        ["order_id", "user_id", "eval_set", "order_number", "order_dow", "order_hour_of_day",
         "days_since_prior_order"],
    ),
    "order_products__prior": ("m_prior", ["order_id", "product_id", "add_to_cart_order", "reordered"]),
    "order_products__train": ("m_train", ["order_id", "product_id", "add_to_cart_order", "reordered"]),
    "products": ("m_products", ["product_id", "product_name", "aisle_id", "department_id"]),
    "aisles": ("m_aisles", ["aisle_id", "aisle"]),
    "departments": ("m_departments", ["department_id", "department"]),
}
TEXT_COLUMNS = {"eval_set", "product_name", "aisle", "department"}


def _numeric() -> dict[str, tuple[str, list[str]]]:
    return {t: (rel, [c for c in cols if c not in TEXT_COLUMNS]) for t, (rel, cols) in TABLES.items()}


def _shapes() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, {len(cols)} AS n_columns FROM {rel}"
        for t, (rel, cols) in TABLES.items()
    )


PRODUCT_EXT = [
    "product_id", "product_total_orders", "product_reorder_rate", "product_avg_cart_pos",
    "product_std_cart_pos", "product_unique_users", "product_name", "aisle_id", "department_id",
    "department", "aisle", "dept_avg_reorder_rate", "aisle_avg_reorder_rate",
]
PAIRS = ["user_id", "product_id", *PAIR_EXT[:8], "user_max_order", *PAIR_EXT[8:]]
MATRIX = ["user_id", "product_id", "order_id", *PAIR_EXT, *USER_EXT, *PRODUCT_KEY, "reordered"]
FEATURE_TABLES = {
    "user_features": ("user_ext", ["user_id", *USER_EXT]),
    "product_features": ("product_ext", PRODUCT_EXT),
    "user_product_features": ("pair_ext", PAIRS),
    "final_features_train": ("matrix", MATRIX),
}


def _sums(relations: dict[str, tuple[str, list[str]]]) -> str:
    parts = []
    for name, (rel, cols) in relations.items():
        each = ", ".join(
            f"{{'column_name': '{c}', 'n_values': count({c}), 'total': round(coalesce("
            f"sum(CAST({f'length({c})' if c in TEXT_COLUMNS else c} AS DOUBLE)), 0), 3)}}"
            for c in cols
        )
        parts.append(
            f"SELECT '{name}' AS table_name, n_rows, unnest(per_column, recursive := true) "
            f"FROM (SELECT count(*) AS n_rows, [{each}] AS per_column FROM {rel})"
        )
    return " UNION ALL ".join(parts)


def _missing() -> str:
    parts = []
    for name, table in (
        ("orders", "orders"),
        ("order_products_train", "order_products__train"),
        ("products", "products"),
    ):
        rel, cols = TABLES[table]
        per = " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, count(*) AS total FROM {rel}"
            for c in cols
        )
        parts.append(
            f"SELECT '{name}' AS table_name, column_name, n_missing, "
            f"CAST(n_missing AS DOUBLE) / total * 100 AS pct_missing FROM ({per}) WHERE n_missing > 0"
        )
        checks = " AND ".join(f"count(*) = count({c})" for c in cols)
        parts.append(f"SELECT '{name}', NULL, 0, 0.0 FROM {rel} HAVING {checks}")
    return " UNION ALL ".join(parts)


def _describe() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, "
        f"CAST(max({c}) AS DOUBLE) AS max FROM {rel}"
        for t, (rel, cols) in _numeric().items()
        for c in cols
    )


def _correlations() -> str:
    relations = dict(_numeric())
    relations["user_feat"] = ("user_ext", ["user_id", *USER_EXT])
    relations["prod_feat"] = (
        "product_ext",
        ["product_id", "product_total_orders", "product_reorder_rate", "product_avg_cart_pos",
         "product_std_cart_pos", "product_unique_users", "dept_avg_reorder_rate",
         "aisle_avg_reorder_rate"],
    )
    relations["up_feat"] = ("pair_ext", ["user_id", "product_id", *PAIR_EXT[:8], "user_max_order", *PAIR_EXT[8:]])
    relations["final_df"] = (
        "matrix",
        ["user_id", "product_id", "order_id", *PAIR_EXT, *USER_EXT, *PRODUCT_KEY, "reordered"],
    )
    parts = []
    for t, (rel, cols) in relations.items():
        if len(cols) < 2:
            continue
        entries = ", ".join(
            f"{{'x': '{a}', 'y': '{b}', 'r': round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) + 0.0::DOUBLE, "
            f"'ok': min({a}) < max({a}) AND min({b}) < max({b})}}"
            for a in cols
            for b in cols
        )
        parts.append(
            f"SELECT '{t}' AS table_name, e.x AS x, e.y AS y, e.r AS r "
            f"FROM (SELECT unnest([{entries}]) AS e FROM {rel}) WHERE e.ok"
        )
    return " UNION ALL ".join(parts)


def _catalogue() -> str:
    relations = {
        "orders": "(SELECT CAST(order_number = 1 AS INTEGER) AS is_first_order FROM m_orders)",
        "user_feat": "user_ext",
        "prod_feat": "product_ext",
        "up_feat": "pair_ext",
    }
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{f}' AS feature, '{kind}' AS kind, '{method}' AS method, "
        f"'{text.replace(chr(39), chr(39) * 2)}' AS description, count(*) AS n_rows, count({f}) AS n_present, "
        f"round(CAST(min({f}) AS DOUBLE), 6) AS min_value, round(CAST(max({f}) AS DOUBLE), 6) AS max_value "
        f"FROM {relations[t]}"
        for t, f, kind, method, text in FEATURES
    )


def _tfidf(source: str, key: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
      WITH src AS ({source}),
      tok AS (
        SELECT {key}, unnest(regexp_extract_all(lower(coalesce(txt, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
        FROM src
      ),
      kept AS (SELECT * FROM tok WHERE term NOT IN ({stop})),
      vocab AS (
        SELECT term, count(DISTINCT {key}) AS df FROM kept GROUP BY term
        ORDER BY count(*) DESC, term LIMIT 1000
      ),
      tf AS (
        SELECT {key}, term, count(*) AS tf, any_value(df) AS df FROM kept JOIN vocab USING (term) GROUP BY 1, 2
      ),
      w AS (
        SELECT {key}, term, tf * (ln((1 + (SELECT count(*) FROM src))::DOUBLE / (1 + df)) + 1) AS w FROM tf
      )
      SELECT {key}, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY {key})), 6) AS weight FROM w
    """


PARTS = "SELECT p_partkey AS product_id, p_name || ' ' || p_type AS txt FROM part"
DOCS = "SELECT doc_id, text AS txt FROM documents"

PREDICTED = "rank, product_id, product_name, reorder_probability"
DEPARTMENTS = """(
  SELECT department, count(*) AS n_lines, avg(reordered) AS reorder_rate
  FROM m_train JOIN m_products USING (product_id) JOIN m_departments USING (department_id)
  GROUP BY department)"""
HITS = """(
  SELECT user_id, count(hit) AS hits, any_value(n_actual) AS n_actual FROM (
    SELECT t.user_id, t.product_id, a.hit FROM (
      SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id) AS i
      FROM eval) t
    LEFT JOIN (SELECT user_id, product_id, 1 AS hit FROM eval WHERE reordered = 1) a USING (user_id, product_id)
    WHERE i <= 10)
  JOIN (SELECT user_id, count(*) AS n_actual FROM eval WHERE reordered = 1 GROUP BY user_id) USING (user_id)
  GROUP BY user_id)"""
CURVE = """(
  SELECT score, pos, neg,
         coalesce(sum(pos) OVER w, 0) AS pos_above, coalesce(sum(neg) OVER w, 0) AS neg_above
  FROM (SELECT score, sum(reordered) AS pos, sum(1 - reordered) AS neg FROM eval GROUP BY score)
  WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _routed(people: str, k: int, threshold: float) -> str:
    return f"""
      SELECT user_id, 'Personalized' AS mode, {PREDICTED} FROM {people} JOIN ranked USING (user_id)
      WHERE rank <= {k} AND reorder_probability >= {threshold}
      UNION ALL
      SELECT user_id, 'Global Popularity', {PREDICTED} FROM {people}
      JOIN popular ON rank <= {k} AND reorder_probability >= {threshold}
      WHERE user_id NOT IN (SELECT user_id FROM known)"""


def _error(low: str, a: str, b: str) -> str:
    return f"""
      SELECT round(avg(score) FILTER ({low}), 6) AS {a}, round(avg(score) FILTER (NOT ({low})), 6) AS {b},
             count(*) FILTER ({low}) AS n_{a}, count(*) FILTER (NOT ({low})) AS n_{b}
      FROM f9 JOIN eval USING (user_id, product_id)"""


def _rounded(select: str, *columns: str) -> str:
    changes = ", ".join(f"round({c}, 6) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({changes}) FROM ({select})"


USER_STD = ("user_std_days_between", "user_std_order_hour")
GROUP_RATES = ("dept_avg_reorder_rate", "aisle_avg_reorder_rate")


def _matrix_columns(*keys: str) -> str:
    return ", ".join([*keys, *PAIR_EXT, *USER_EXT, *PRODUCT_KEY])


def _past_features() -> str:
    return ", ".join(
        "0.0::DOUBLE AS p_avg_cart_position"
        if c == "p_avg_cart_position"
        else f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}"
        for c in SERVING_FEATURES
    )


def _newton(rounds: int, depth: int, bins: int, rate: float) -> str:
    """The trees of ``boosting.fit_newton`` on all labelled pairs, a few CTEs a level."""
    rows = f"""
        SELECT row_number() OVER (ORDER BY user_id, product_id) AS rid, coalesce(t.reordered, 0) AS y, x.*
        FROM (SELECT user_id, product_id, {", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in SERVING_FEATURES)}
              FROM past_f9) x
        JOIN train_orders USING (user_id) LEFT JOIN m_train t USING (order_id, product_id)"""
    each = " UNION ALL ".join(f"SELECT rid, {i} AS f, {c} AS x FROM nw_rows" for i, c in enumerate(SERVING_FEATURES))
    steps = {
        "nw_rows": rows,
        "nw_each": each,
        "nw_ranked": """
            SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) - 1 AS r,
                   count(*) OVER (PARTITION BY f) AS n, max(x) OVER (PARTITION BY f) AS top FROM nw_each""",
        "nw_cuts": f"""
            SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) - 1 AS b FROM (
              SELECT DISTINCT f, x FROM nw_ranked JOIN (SELECT unnest(range(1, {bins})) AS k) ON r = k * n // {bins}
              WHERE x < top)""",
        "nw_bins": """
            SELECT rid, e.f, count(c.x) AS b FROM nw_each e LEFT JOIN nw_cuts c ON c.f = e.f AND c.x < e.x
            GROUP BY rid, e.f""",
        "nw_margin0": "SELECT rid, y, 0.0::DOUBLE AS m FROM nw_rows",
    }
    found = []
    for r in range(rounds):
        steps[f"nw_slope{r}"] = f"""
            SELECT rid, CAST(round((p - y) * 16777216) AS BIGINT) AS g, CAST(round(p * (1 - p) * 16777216) AS BIGINT) AS h
            FROM (SELECT rid, y, 1.0::DOUBLE / (1 + exp(-m)) AS p FROM nw_margin{r})"""
        steps[f"nw_node{r}_0"] = f"SELECT rid, 0 AS node, true AS live FROM nw_slope{r}"
        for level in range(depth):
            at = f"{r}_{level}"
            steps[f"nw_sum{at}"] = f"""
                SELECT node, f, b, sum(g) AS g, sum(h) AS h FROM nw_node{at} JOIN nw_slope{r} USING (rid)
                JOIN nw_bins USING (rid) WHERE live GROUP BY ALL"""
            steps[f"nw_side{at}"] = f"""
                SELECT node, f, b, CAST(sum(g) OVER w AS DOUBLE) / 16777216 AS gl, CAST(sum(h) OVER w AS DOUBLE) / 16777216 AS hl,
                       CAST(sum(g) OVER a AS DOUBLE) / 16777216 AS g, CAST(sum(h) OVER a AS DOUBLE) / 16777216 AS h,
                       CAST(sum(g) OVER a - sum(g) OVER w AS DOUBLE) / 16777216 AS gr,
                       CAST(sum(h) OVER a - sum(h) OVER w AS DOUBLE) / 16777216 AS hr
                FROM nw_sum{at} WINDOW w AS (PARTITION BY node, f ORDER BY b), a AS (PARTITION BY node, f)"""
            steps[f"nw_split{at}"] = f"""
                SELECT node, f, b, gain FROM (
                  SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, b) AS i FROM (
                    SELECT *, gl * gl / (hl + 1) + gr * gr / (hr + 1) - g * g / (h + 1) AS gain FROM nw_side{at}
                    WHERE hl >= 1 AND hr >= 1) WHERE gain > 0) WHERE i = 1"""
            steps[f"nw_node{r}_{level + 1}"] = f"""
                SELECT n.rid, CASE WHEN s.node IS NULL THEN n.node ELSE 2 * n.node + 1 + CAST(q.b > s.b AS INTEGER) END AS node,
                       s.node IS NOT NULL AS live
                FROM nw_node{at} n LEFT JOIN nw_split{at} s ON n.live AND s.node = n.node
                LEFT JOIN nw_bins q ON q.rid = n.rid AND q.f = s.f"""
            found.append(f"""
                SELECT {r} AS round, node, list_extract({list(SERVING_FEATURES)}, s.f + 1) AS feature, round(c.x, 6) AS cut,
                       round(gain, 3) AS gain, CAST(NULL AS DOUBLE) AS weight
                FROM nw_split{at} s JOIN nw_cuts c ON c.f = s.f AND c.b = s.b""")
        steps[f"nw_leaf{r}"] = f"""
            SELECT node, -(CAST(sum(g) AS DOUBLE) / 16777216) / (CAST(sum(h) AS DOUBLE) / 16777216 + 1) * {rate}::DOUBLE AS weight
            FROM nw_node{r}_{depth} JOIN nw_slope{r} USING (rid) GROUP BY node"""
        steps[f"nw_margin{r + 1}"] = f"""
            SELECT rid, y, m + weight AS m FROM nw_margin{r} JOIN nw_node{r}_{depth} USING (rid) JOIN nw_leaf{r} USING (node)"""
        found.append(f"SELECT {r}, node, NULL, NULL, NULL, round(weight, 6) FROM nw_leaf{r}")
    ctes = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps.items())
    return f"WITH {ctes} {' UNION ALL '.join(found)}"


F1 = ["user_id", "u_total_orders", "u_avg_days_between_orders", "u_avg_basket_size", "u_reorder_ratio"]
F4 = ["product_id", "p_total_purchases", "p_reorder_prob", "p_avg_cart_position"]


def _selects() -> dict[str, str]:
    flag = "hash_percent < 20"
    percent = "CAST(('0x' || substr(md5(user_id || '-' || product_id || '-42'), 1, 8))::BIGINT % 100 AS INTEGER)"
    tested = f"""SELECT user_id, product_id, coalesce(t.reordered, 0) AS reordered
        FROM (SELECT user_id, product_id, {percent} AS hash_percent FROM pair_base)
        JOIN train_orders USING (user_id) LEFT JOIN m_train t USING (order_id, product_id) WHERE {flag}"""
    trained = f"""SELECT x.* FROM (SELECT *, {percent} AS hash_percent FROM past_f9) x
        JOIN train_orders USING (user_id) WHERE NOT {flag}"""
    gap = "(SELECT nullif(days_since_prior_order, 0) AS v FROM prior_orders WHERE days_since_prior_order <> 0)"
    baskets = "(SELECT order_id, count(product_id) AS v FROM m_train GROUP BY order_id)"
    per_user = "(SELECT user_id, count(order_id) AS v FROM prior_orders GROUP BY user_id)"
    confusion = """(SELECT count(*) FILTER (score > 0.5 AND reordered = 1) AS tp,
        count(*) FILTER (score > 0.5 AND reordered <> 1) AS fp,
        count(*) FILTER (score <= 0.5 AND reordered = 1) AS fn,
        count(*) FILTER (score <= 0.5 AND reordered <> 1) AS tn FROM eval)"""
    return {
        "scan_select_limit": "SELECT order_id, user_id, order_number FROM m_orders ORDER BY order_id LIMIT 1000",
        "table_shapes": _shapes(),
        "sink_roundtrip": _sums(FEATURE_TABLES),
        "csv_load_all": _sums(TABLES),
        "sample_user_ids": "SELECT DISTINCT user_id FROM m_orders WHERE user_id IS NOT NULL ORDER BY user_id LIMIT 10",
        "split_eval_set": "SELECT *, eval_set AS part FROM m_orders",
        "missing_report": _missing(),
        "quality_first_order": """
            SELECT count(*) FILTER (days_since_prior_order IS NULL) AS n_missing_gaps,
                   count(*) FILTER (days_since_prior_order IS NULL AND order_number <> 1) AS n_violations
            FROM m_orders""",
        "orders_first_flag": """
            SELECT * REPLACE (coalesce(days_since_prior_order, 0) AS days_since_prior_order),
                   CAST(order_number = 1 AS INTEGER) AS is_first_order FROM m_orders""",
        "join_prior_orders": "SELECT * FROM prior_op",
        "join_line_department": """
            SELECT m_train.*, department FROM m_train JOIN m_products USING (product_id)
            JOIN m_departments USING (department_id)""",
        "join_line_department_salted": """
            SELECT m_train.*, department FROM m_train JOIN m_products USING (product_id)
            JOIN m_departments USING (department_id)""",
        "orders_in_slices": "SELECT * FROM m_orders",
        "semi_sampled_users": """
            SELECT user_id, count(*) AS n_orders, CAST(sum(order_number) AS BIGINT) AS sum_order_number,
                   CAST(coalesce(sum(n), 0) AS BIGINT) AS n_lines
            FROM m_orders LEFT JOIN (SELECT order_id, count(*) AS n FROM m_prior GROUP BY order_id) USING (order_id)
            WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM m_orders)
              ORDER BY md5(user_id || '-42'), user_id LIMIT 1500)
            GROUP BY user_id""",
        "candidates": """
            SELECT p.user_id, p.product_id, o.order_id FROM pair_base p
            JOIN train_orders o ON o.user_id = p.user_id""",
        "cold_users_anti": "SELECT user_id FROM asked WHERE user_id NOT IN (SELECT user_id FROM known)",
        "overview_counts": """
            SELECT count(*) AS n_orders, count(*) FILTER (eval_set = 'prior') AS prior_orders,
                   count(*) FILTER (eval_set = 'train') AS train_orders,
                   count(*) FILTER (eval_set = 'test') AS test_orders,
                   count(DISTINCT user_id) AS n_users FROM m_orders""",
        "target_distribution": """
            SELECT CAST(sum(reordered) AS BIGINT) AS n_reordered, count(*) FILTER (reordered = 0) AS n_new,
                   avg(reordered) * 100 AS pct_reordered, (1 - avg(reordered)) * 100 AS pct_new FROM m_train""",
        "orders_per_user_stats": f"""
            SELECT min(v) AS min_orders, {_median("v")} AS median_orders, max(v) AS max_orders,
                   CAST(count(*) FILTER (v > 10) AS DOUBLE) / count(*) * 100 AS pct_above FROM {per_user}""",
        "orders_by_dow": """
            SELECT d.i AS order_dow, ['Sun','Mon','Tue','Wed','Thu','Fri','Sat'][d.i + 1] AS day, n_orders,
                   coalesce(d.i = (SELECT order_dow FROM m_orders GROUP BY order_dow
                                   ORDER BY count(*) DESC, order_dow LIMIT 1), false) AS is_top_day
            FROM (SELECT CAST(range AS INTEGER) AS i FROM range(7)) d
            LEFT JOIN (SELECT order_dow, count(*) AS n_orders FROM m_orders GROUP BY order_dow) c
              ON c.order_dow = d.i""",
        "orders_by_hour": """
            SELECT order_hour_of_day, n_orders,
                   row_number() OVER (ORDER BY n_orders DESC, order_hour_of_day) = 1 AS is_peak_hour
            FROM (SELECT order_hour_of_day, count(*) AS n_orders FROM m_orders GROUP BY 1)""",
        "order_gap_stats": f"""
            SELECT avg(v) AS mean_gap, {_median("v")} AS median_gap,
                   CAST(count(*) FILTER (v BETWEEN 6 AND 8) AS DOUBLE) / count(*) * 100 AS pct_weekly,
                   CAST(count(*) FILTER (v BETWEEN 28 AND 30) AS DOUBLE) / count(*) * 100 AS pct_monthly
            FROM {gap}""",
        "orders_by_gap": """
            SELECT days_since_prior_order, count(*) AS n_orders FROM m_orders
            WHERE days_since_prior_order IS NOT NULL GROUP BY 1""",
        "basket_size_stats": f"""
            SELECT {_median("v")} AS median_size, avg(v) AS mean_size, max(v) AS max_size FROM {baskets}""",
        "basket_size_hist": f"""
            SELECT b.bin, round(lo + (b.bin - 1) * (hi - lo) / 40, 6) AS bin_low,
                   round(lo + b.bin * (hi - lo) / 40, 6) AS bin_high,
                   count(x.v) AS n_orders
            FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 41)) b,
                 (SELECT min(least(v, 40))::DOUBLE AS lo, max(least(v, 40))::DOUBLE AS hi FROM {baskets}) e
            LEFT JOIN (SELECT least(v, 40)::DOUBLE AS v FROM {baskets}) x
              ON b.bin = least(floor((x.v - lo) / ((hi - lo) / 40)) + 1, 40)
            GROUP BY b.bin, lo, hi""",
        "reorder_by_cart_pos": """
            SELECT add_to_cart_order, avg(reordered) AS reorder_rate FROM m_train GROUP BY 1
            ORDER BY 1 LIMIT 20""",
        "reorder_at_cart_pos": """
            SELECT CAST(p AS INTEGER) AS add_to_cart_order,
                   coalesce((SELECT avg(reordered) FROM m_train WHERE add_to_cart_order = p), 0) AS reorder_rate
            FROM (SELECT unnest([1, 5, 10]) AS p)""",
        "department_volume": f"SELECT department, n_lines FROM {DEPARTMENTS}",
        "department_reorder": f"SELECT department, round(reorder_rate, 3) AS reorder_rate FROM {DEPARTMENTS}",
        "department_top5": f"SELECT department, n_lines FROM {DEPARTMENTS} ORDER BY n_lines DESC, department LIMIT 5",
        "correlation_matrix": _correlations(),
        "describe_table": _describe(),
        "feature_catalogue": _catalogue(),
        "feature_catalogue_counts": " UNION ALL ".join(
            f"SELECT '{by}' AS counted_by, {by} AS value, count(*) AS n_features "
            f"FROM ({_catalogue()}) WHERE n_present > 0 GROUP BY {by}"
            for by in ("method", "table_name")
        ),
        "dept_aisle_rates": """
            SELECT 'department' AS level, department AS name, round(dept_avg_reorder_rate, 6) AS avg_reorder_rate
            FROM dept_rates UNION ALL
            SELECT 'aisle', aisle, round(aisle_avg_reorder_rate, 6) FROM aisle_rates""",
        "user_features": "SELECT * FROM f1",
        "user_features_ext": _rounded(f"SELECT user_id, {', '.join(USER_EXT)} FROM user_ext", *USER_STD),
        "product_features": "SELECT * FROM f4",
        "product_features_ext": _rounded(
            "SELECT * FROM product_ext", "product_std_cart_pos", *GROUP_RATES
        ),
        "interaction_features": "SELECT * FROM f5",
        "interaction_features_ext": "SELECT * FROM pair_ext",
        "feature_matrix": _rounded(
            f"""SELECT {_matrix_columns("user_id", "product_id")} FROM pair_ext
            LEFT JOIN user_ext USING (user_id) LEFT JOIN product_ext USING (product_id)""",
            *USER_STD,
            *GROUP_RATES,
        ),
        "training_matrix": _rounded("SELECT * FROM matrix", *USER_STD, *GROUP_RATES),
        "label_balance": """
            SELECT count(*) AS n_rows, CAST(sum(reordered) AS BIGINT) AS n_positive,
                   count(*) FILTER (reordered = 0) AS n_negative, avg(reordered) AS positive_rate FROM matrix""",
        "serving_matrix": "SELECT * FROM f9",
        "align_features": f"""
            SELECT user_id, product_id, {_past_features()}
            FROM past_f9 JOIN (SELECT user_id FROM train_orders) USING (user_id)""",
        "package_roundtrip": _sums(
            {
                "user_features": ("f1", F1),
                "product_features": ("f4", F4),
                "orders": TABLES["orders"],
                "prior": TABLES["order_products__prior"],
                "products": TABLES["products"],
            }
        )
        + f" UNION ALL SELECT 'scores', count(*), 'features', 0, {len(SERVING_FEATURES)}::DOUBLE FROM ({tested})",
        "model_checks": " UNION ALL ".join(
            f"SELECT '{name}' AS model, count(*) AS n_rows, CAST(sum(user_id) AS BIGINT) AS sum_user_id, "
            f"CAST(sum(product_id) AS BIGINT) AS sum_product_id, CAST(sum(reordered) AS BIGINT) AS n_positive, "
            f"count(*) AS n_in_range, count(*) AS n_consistent FROM ({tested})"
            for name in ("logistic", "forest", "boosted")
        ),
        "model_learns": " UNION ALL ".join(
            f"SELECT '{name}' AS model, count(*) AS n_rows, true AS ranks_better_than_chance, true AS varies FROM ({tested.replace(f'WHERE {flag}', '')})"
            for name in ("logistic", "forest", "boosted", "newton")
        ),
        "logistic_certificate": " UNION ALL ".join(
            f"SELECT '{f}' AS term, count(*) AS n_rows, round(avg(coalesce({f}, 0)), 6) AS mean, "
            f"round(stddev_samp(coalesce({f}, 0)), 6) AS deviation, 0.0::DOUBLE AS gradient, true AS curves_upwards, "
            f"true AS agrees FROM ({trained})"
            for f in SERVING_FEATURES
        )
        + f" UNION ALL SELECT 'intercept', count(*), 0, 1, 0, true, true FROM ({trained})",
        "newton_trees": _newton(rounds=2, depth=3, bins=16, rate=0.1),
        "text_tfidf": _tfidf(PARTS, "product_id"),
        "text_tfidf_documents": _tfidf(DOCS, "doc_id"),
        "text_svd_checks": " UNION ALL ".join(
            f"""SELECT '{name}' AS source, (SELECT count(*) FROM ({source})) AS n_rows,
                CAST(count(DISTINCT {key}) AS DOUBLE) AS squared_norm, true AS residual_adds_up, true AS orthonormal,
                true AS lengths_are_values, true AS vectors_are_scaled FROM ({_tfidf(source, key)})"""
            for name, source, key in (("product_name", PARTS, "product_id"), ("text", DOCS, "doc_id"))
        ),
        "top_k_per_user": "SELECT user_id, product_id, reorder_probability, rank FROM ranked WHERE rank <= 10",
        "temporal_split": """
            SELECT order_id, user_id, order_number,
                   CASE WHEN order_number = max(order_number) OVER (PARTITION BY user_id)
                        THEN 'holdout' ELSE 'history' END AS split FROM m_orders""",
        "sample_users": """
            SELECT user_id FROM (SELECT DISTINCT user_id FROM m_orders)
            ORDER BY md5(user_id || '-42'), user_id LIMIT 1500""",
        "hash_split": f"""
            SELECT user_id, product_id, CASE WHEN {flag} THEN 'test' ELSE 'train' END AS split
            FROM (SELECT user_id, product_id, {percent} AS hash_percent FROM pair_base)""",
        "recommend_personal": f"""
            SELECT user_id, {PREDICTED} FROM ranked WHERE rank <= 10 AND reorder_probability >= 0.1""",
        "recommend_cold": f"SELECT {PREDICTED} FROM popular WHERE rank <= 10 AND reorder_probability >= 0.05",
        "recommend_routed": _routed("asked", 5, 0.2),
        "recommend_summary": f"""
            SELECT user_id, count(*) AS n_items, max(reorder_probability) AS highest_probability,
                   any_value(mode) AS mode FROM ({_routed("asked", 10, 0.0)}) GROUP BY user_id""",
        "batch_top10": _routed("(SELECT c_custkey AS user_id FROM customer)", 10, 0.0),
        "parse_requests": "SELECT * FROM parsed",
        "score_requests": "SELECT * FROM answers",
        "score_requests_store": "SELECT * FROM answers",
        "nightly_increments": "SELECT user_id, product_id, reorder_probability, rank FROM ranked",
        "score_requests_json": "SELECT * FROM answers",
        "score_requests_stream": "SELECT * EXCLUDE (request_id) FROM answers",
        "precision_recall_at_k": f"""
            SELECT round(coalesce(avg(hits / 10.0::DOUBLE), 0), 6) AS precision_at_k,
                   round(coalesce(avg(CAST(hits AS DOUBLE) / n_actual), 0), 6) AS recall_at_k,
                   count(*) AS n_users FROM {HITS}""",
        "per_user_hits": f"""
            SELECT user_id, hits, n_actual, CAST(hits AS DOUBLE) / 10 AS precision,
                   CAST(hits AS DOUBLE) / n_actual AS recall FROM {HITS}""",
        "accuracy": "SELECT avg(CAST(CAST(score > 0.5 AS INTEGER) = reordered AS INTEGER)) AS accuracy FROM eval",
        "roc_auc": f"""
            SELECT round(sum(neg * (pos_above + pos / 2.0)) / (sum(pos) * sum(neg))::DOUBLE, 6) AS roc_auc
            FROM {CURVE}""",
        "f1_pr": f"""
            SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
                   coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
                   coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM {confusion}""",
        "average_precision": f"""
            SELECT round(sum(pos * (pos_above + pos)::DOUBLE / (pos_above + pos + neg_above + neg)) / sum(pos), 6)
              AS average_precision FROM {CURVE}""",
        "error_cold_users": _error("u_total_orders <= 5", "cold_users", "regular_users"),
        "error_rare_items_default": _error(
            "p_total_purchases < 50", "rare_items", "popular_items"
        ),
        "error_rare_items": _error(
            f"p_total_purchases < {RARE_PURCHASES}", "rare_items", "popular_items"
        ),
    }


def oracle_sql() -> dict[str, str]:
    """SQL per query; the model and SVD queries have no SQL form."""
    base = _base()
    return {name: f"WITH {base}\nSELECT * FROM ({select})" for name, select in _selects().items()}
