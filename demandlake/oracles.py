"""The SQL that says what each registered query returns, written from the rules alone.

Common table expressions build the inputs step by step; a key names the last one it needs
and its own statement.
"""

from __future__ import annotations

_POSTINGS = """
postings AS (
  SELECT o_orderkey AS seq,
         '  ' || lower(p_name) || ' ' AS job_title,
         CASE WHEN o_orderkey % 53 = 0 THEN '' ELSE ' ' || lower(c_name) || ' ' END AS company_name,
         CASE CAST(o_orderkey % 7 AS INT)
              WHEN 0 THEN 'TP.HCM - Ha Noi' WHEN 1 THEN 'HaNoi' WHEN 2 THEN 'Da Nang '
              WHEN 3 THEN 'Ho Chi Minh' WHEN 4 THEN n_name WHEN 5 THEN ''
              ELSE 'Ha Noi - Da Nang' END AS location,
         '[''' || replace(p_name, ' ', ''', ''') || ''', '''']' AS skills_required,
         CASE WHEN o_orderkey % 97 = 0 THEN 'n/a'
              ELSE substr(CAST(o_orderdate AS VARCHAR), 1, 10) END AS date_posted,
         'https://jobs.example/' ||
           CAST(o_orderkey - CASE WHEN o_orderkey % 11 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS job_link,
         CASE o_orderpriority WHEN '1-URGENT' THEN ' data analyst'
              WHEN '2-HIGH' THEN 'backend engineer ' WHEN '3-MEDIUM' THEN 'DevOps'
              WHEN '4-NOT SPECIFIED' THEN 'QA tester' ELSE 'AI researcher' END AS job_category,
         CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN ' At Office' WHEN 1 THEN 'Hybrid'
              WHEN 2 THEN 'Remote' WHEN 3 THEN 'WFH' WHEN 4 THEN NULL
              ELSE 'flexible' END AS work_mode
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
)"""


def _initcap(text: str) -> str:
    return (
        f"array_to_string(list_transform(string_split(lower(trim({text})), ' '), "
        "lambda w: upper(w[1]) || w[2:]), ' ')"
    )


def _city(entry: str) -> str:
    return (
        f"CASE WHEN lower({entry}) LIKE '%hcm%' OR lower({entry}) LIKE '%hochiminh%' THEN 'Ho Chi Minh' "
        f"WHEN lower({entry}) LIKE '%hanoi%' OR lower({entry}) LIKE '%ha noi%' THEN 'Ha Noi' "
        f"WHEN lower({entry}) LIKE '%da nang%' THEN 'Da Nang' ELSE trim({entry}) END"
    )


_CITIES = f"list_transform(string_split(trim(location), ' - '), lambda e: {_city('e')})"
_FIRST_CITY = f"list_filter({_CITIES}, lambda c: c <> '')[1]"
_SKILLS = (
    r"list_filter(list_transform(string_split_regex(regexp_replace(lower(skills_required), "
    r"'[\[\]'']', '', 'g'), ',\s*'), lambda s: upper(trim(s))), lambda s: s <> '')"
)
_WORK_MODE = """CASE
  WHEN regexp_matches(lower(work_mode), 'office|onsite') THEN 'At Office'
  WHEN regexp_matches(lower(work_mode), 'hybrid|mix|partly|part-time') THEN 'Hybrid'
  WHEN regexp_matches(lower(work_mode), 'remote|home|wfh') THEN 'Remote'
  ELSE 'At Office' END"""


def _clean(source: str) -> str:
    return f"""
  SELECT * FROM (
    SELECT seq, {_initcap('job_title')} AS job_title, upper(trim(company_name)) AS company_name,
           {_FIRST_CITY} AS location, {_SKILLS} AS skills_required,
           try_cast(date_posted AS DATE) AS date_posted, job_link, job_category,
           {_WORK_MODE} AS work_mode
    FROM {source})
  WHERE job_title <> '' AND company_name <> '' AND location <> '' AND job_link <> ''
    AND date_posted IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY job_link ORDER BY seq) = 1"""


_SILVER = f"{_POSTINGS}, silver AS ({_clean('postings')})"
_CATEGORY = _initcap("job_category")
_FACT = f"""{_SILVER}, fact AS (
  SELECT job_link, job_title, skill_name, location AS city, company_name,
         {_CATEGORY} AS category_name, work_mode,
         CAST(strftime(date_posted, '%Y%m%d') AS INT) AS date_id, date_posted
  FROM (SELECT *, unnest(list_distinct(list_transform(skills_required, lambda s: upper(s)))) AS skill_name
        FROM silver))"""
_MONTHLY = f"""{_FACT}, monthly AS (
  SELECT category_name AS job_category, make_date(year(date_posted), month(date_posted), 1) AS ds,
         count(*) AS y
  FROM fact GROUP BY ALL)"""
_SPLIT = f"""{_MONTHLY}, split AS (
  SELECT job_category, ds, y, count(*) OVER (PARTITION BY job_category) AS n_points,
         row_number() OVER (PARTITION BY job_category ORDER BY ds) AS position
  FROM monthly), marked AS (
  SELECT *, position <= CAST(floor(n_points * 0.8::DOUBLE) AS BIGINT) AS is_train FROM split)"""
_LINES = """
lines AS (
  SELECT o_custkey AS customer_id, l_partkey AS product_id,
         CAST(o_orderdate AS DATE) AS order_date, p_type AS category_name,
         CAST(l_quantity AS INT) AS quantity,
         floor(100 * l_extendedprice / l_quantity) / 100 AS price,
         l_extendedprice AS total_price,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 5 AS INT) END AS review_score,
         ' ' || lower(o_orderpriority) AS payment_method, n_name AS city,
         CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(18 + c_custkey % 50 AS INT) END AS age
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""


def _exact_sum(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(18,4))) AS DOUBLE)"


_STATS = f"""{_LINES}, stats AS (
  SELECT product_id, CAST(sum(quantity) AS BIGINT) AS prod_total_qty,
         {_exact_sum('price')} / count(price) AS prod_avg_price,
         count(DISTINCT customer_id) AS prod_unique_buyers
  FROM lines GROUP BY product_id)"""
_FEATURES = f"""{_STATS}, features AS (
  SELECT customer_id, product_id, order_date, year(order_date) AS year, month(order_date) AS month,
         day(order_date) AS day, dayofweek(order_date) + 1 AS dow, quantity, price, total_price,
         review_score, upper(trim(payment_method)) AS payment_method, city, gender, age,
         prod_total_qty, prod_avg_price, prod_unique_buyers
  FROM lines LEFT JOIN stats USING (product_id))"""
_RFM = f"""{_LINES}, rfm AS (
  SELECT customer_id, date_diff('day', max(order_date), (SELECT max(order_date) FROM lines)) AS recency,
         count(*) AS frequency, {_exact_sum('total_price')} AS monetary
  FROM lines GROUP BY customer_id)"""


def _trend(source: str, name: str) -> str:
    """Least squares over days since 1970 from exact sums."""
    x = "date_diff('day', DATE '1970-01-01', ds)"
    return f"""sums_{name} AS (
  SELECT job_category, CAST(count(*) AS DOUBLE) AS n, CAST(sum({x}) AS DOUBLE) AS sx,
         CAST(sum(y) AS DOUBLE) AS sy, CAST(sum({x} * {x}) AS DOUBLE) AS sxx,
         CAST(sum({x} * y) AS DOUBLE) AS sxy, CAST(sum(y * y) AS DOUBLE) AS syy
  FROM {source} GROUP BY job_category), slopes_{name} AS (
  SELECT *, coalesce((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 0) AS b FROM sums_{name}
), {name} AS (
  SELECT job_category, (sy - b * sx) / n AS a, b,
         sqrt(greatest((n * syy - sy * sy) - b * (n * sxy - sx * sy), 0)) / n AS noise
  FROM slopes_{name})"""


_FRAME = f"""{_MONTHLY}, last_day_of AS (
  SELECT job_category, max(ds) AS last_ts FROM monthly GROUP BY job_category), frame AS (
  SELECT job_category, ds, 'history' AS kind FROM monthly
  UNION ALL
  SELECT job_category,
         last_day(date_trunc('month', last_ts) + to_months(CAST(i + CASE WHEN last_day(last_ts) = last_ts
           THEN 1 ELSE 0 END AS INT))) AS ds, 'future' AS kind
  FROM last_day_of, range(3) AS r(i))"""
_FITTED = f"""{_FRAME}, {_trend('monthly', 'line')}, fitted AS (
  SELECT job_category, ds, kind, a + b * date_diff('day', DATE '1970-01-01', ds) AS yhat, noise
  FROM frame JOIN line USING (job_category))"""
_WEEKLY = f"""{_FACT}, daily AS (
  SELECT category_name AS job_category, date_posted AS ds, CAST(count(*) AS DOUBLE) AS y
  FROM fact GROUP BY ALL), span AS (
  SELECT job_category, min(ds) AS lo, max(ds) AS hi FROM daily GROUP BY job_category), grid AS (
  SELECT job_category, CAST(unnest(generate_series(
           lo + CAST((7 - dayofweek(lo)) % 7 AS INT), hi + CAST((7 - dayofweek(hi)) % 7 AS INT),
           INTERVAL 7 DAY)) AS DATE) AS ds
  FROM span), known AS (
  SELECT g.job_category, g.ds, d.y FROM grid g LEFT JOIN daily d
    ON g.job_category = d.job_category AND g.ds = d.ds), spanned AS (
  SELECT job_category, ds,
         last_value(y IGNORE NULLS) OVER before AS y0,
         last_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER before AS t0,
         first_value(y IGNORE NULLS) OVER after AS y1,
         first_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER after AS t1
  FROM known
  WINDOW before AS (PARTITION BY job_category ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         after AS (PARTITION BY job_category ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_SILVER_COLUMNS = (
    "seq, job_title, company_name, location, array_to_string(skills_required, '|') AS skills, "
    "date_posted, job_link, job_category, work_mode"
)
_POSTING_COLUMNS = (
    "job_title, company_name, location, skills_required, date_posted, job_link, job_category, work_mode"
)
_EARLIER = "date_posted < '1999-01-01'"
_LINE_TYPES = {
    "customer_id": "bigint", "product_id": "bigint", "order_date": "date", "category_name": "string",
    "quantity": "int", "price": "double", "total_price": "double", "review_score": "int",
    "payment_method": "string", "city": "string", "gender": "string", "age": "int",
}
_LINE_CHECKS = ("customer_id", "order_date", "product_id", "price", "quantity", "total_price")
_FACT_CHECKS = {
    "customer": "customer_id", "product": "product_id", "category": "category_name", "city": "city",
    "payment": "payment_method", "date": "order_date",
}


def _avg(column: str) -> str:
    return f"round({_exact_sum(column)} / count({column}), 2)"


def _suite() -> str:
    def row(check: str, table: str, value: str) -> str:
        return f"SELECT '{check}' AS check_name, '{table}' AS table_name, CAST({value} AS DOUBLE) AS value FROM lines"

    off = "count(*) FILTER (WHERE abs(total_price - quantity * price) > 0.01)"
    rows = [row("total_rows", "ecommerce_clean", "count(*)")]
    rows += [row(f"null_{c}", "ecommerce_clean", f"count(*) FILTER (WHERE {c} IS NULL)") for c in _LINE_CHECKS]
    rows += [
        row("invalid_rows", "ecommerce_clean",
            "count(*) FILTER (WHERE quantity <= 0 OR price <= 0 OR total_price <= 0)"),
        row("mismatch_count", "ecommerce_clean", off),
        *(row(f"avg_{c}", "ecommerce_clean", _avg(c)) for c in ("price", "quantity", "total_price")),
        row("drifted_categories", "ecommerce_clean",
            "count(DISTINCT category_name) FILTER (WHERE category_name <> upper(trim(category_name)))"),
        "SELECT 'payment_method=' || coalesce(payment_method, 'NULL'), 'ecommerce_clean', "
        "CAST(count(*) AS DOUBLE) FROM lines GROUP BY payment_method",
        row("total_rows", "fact_sales", "count(*)"),
        *(row(f"null_{n}", "fact_sales", f"count(*) FILTER (WHERE {c} IS NULL)")
          for n, c in _FACT_CHECKS.items()),
        row("mismatch_count", "fact_sales", off),
        row("total_revenue", "fact_sales", "round(sum(CAST(total_price AS DECIMAL(18,4))), 2)"),
        row("unique_customers", "dim_customer", "count(DISTINCT customer_id)"),
        row("unique_products", "dim_product", "count(DISTINCT product_id)"),
        row("start_date", "dim_date", "CAST(strftime(min(order_date), '%Y%m%d') AS INT)"),
        row("end_date", "dim_date", "CAST(strftime(max(order_date), '%Y%m%d') AS INT)"),
    ]
    return "\nUNION ALL\n".join(rows)


def _first_by(columns: str) -> str:
    others = "age, category_name, city, customer_id, gender, payment_method, price, quantity, review_score, total_price"
    order = ", ".join(f"{c} NULLS FIRST" for c in others.split(", "))
    return (
        f"SELECT {columns} FROM lines QUALIFY row_number() OVER "
        f"(PARTITION BY product_id ORDER BY order_date DESC, {order}) = 1"
    )


_GRID = "(0.7::DOUBLE + 0.6::DOUBLE * i / 14)"
_CURVES = f"""{_LINES}, sums AS (
  SELECT product_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS sx,
         CAST(sum(quantity) AS DOUBLE) AS sy, CAST(sum(CAST(x AS HUGEINT) * x) AS DOUBLE) AS sxx,
         CAST(sum(CAST(x AS HUGEINT) * quantity) AS DOUBLE) AS sxy
  FROM (SELECT product_id, quantity, CAST(round(price * 10000) AS BIGINT) AS x FROM lines)
  GROUP BY product_id), curves AS (
  SELECT product_id, (sy - b * sx) / n AS base, b * 10000 AS slope, sx / 10000 / n AS price
  FROM (SELECT *, coalesce((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 0) AS b FROM sums)
), offers AS (
  SELECT product_id, i, price * {_GRID} AS price,
         price * {_GRID} * greatest(base + slope * (price * {_GRID}), 0) AS revenue
  FROM curves, range(15) AS r(i) WHERE price > 0)"""

_SKILL_GROUP = """CASE WHEN regexp_matches(skill_name, 'PYTHON|DATA|SPARK|SQL') THEN 'Data/Backend'
  WHEN regexp_matches(skill_name, 'AWS|DEVOPS|DOCKER|KUBERNETES') THEN 'DevOps/Cloud'
  WHEN regexp_matches(skill_name, 'REACT|ANGULAR|FRONTEND|VUE') THEN 'Frontend' ELSE 'Other' END"""
_REGION = """CASE city WHEN 'Ha Noi' THEN 'Bắc' WHEN 'Da Nang' THEN 'Trung'
  WHEN 'Ho Chi Minh' THEN 'Nam' ELSE 'Khác' END"""
_CATEGORY_GROUP = """CASE
  WHEN regexp_matches(category_name, 'Data|Analytics|BI') THEN 'Data & Analytics'
  WHEN regexp_matches(category_name, 'Backend|Frontend|Fullstack|Software|Engineer') THEN 'Software Engineering'
  WHEN regexp_matches(category_name, 'DevOps|Cloud|SRE|SysOps') THEN 'DevOps / Cloud / Infra'
  WHEN regexp_matches(category_name, 'AI|Machine Learning|Computer Vision|Deep Learning') THEN 'AI & ML'
  WHEN regexp_matches(category_name, 'Security|Pentest|Cyber') THEN 'Security'
  WHEN regexp_matches(category_name, 'Manager|Director|C-level|Lead') THEN 'Management'
  WHEN regexp_matches(category_name, 'Tester|QA') THEN 'QA / Testing' ELSE 'Other' END"""


def _statements() -> dict[str, tuple[str, str]]:
    """The common table expressions and the statement of each key."""
    earlier_links = f"SELECT job_link FROM postings WHERE {_EARLIER}"
    return {
        # Ingest
        "csv_roundtrip": (_POSTINGS, f"SELECT {_POSTING_COLUMNS} FROM postings"),
        "raw_merge": (_POSTINGS, f"""
            SELECT seq, {_POSTING_COLUMNS} FROM postings QUALIFY row_number() OVER
              (PARTITION BY job_link ORDER BY CASE WHEN {_EARLIER} THEN 0 ELSE 1 END, seq) = 1"""),
        "bronze_append": (_POSTINGS, f"""
            SELECT *, 'ITviec' AS source FROM postings WHERE job_link NOT IN ({earlier_links})
            QUALIFY row_number() OVER (PARTITION BY job_link ORDER BY seq) = 1"""),
        "load_audit": (_POSTINGS, f"""
            SELECT 'bronze' AS table_name, step, CASE step WHEN 1 THEN old WHEN 2 THEN total_ - old ELSE 0 END
              AS added, CASE step WHEN 1 THEN old ELSE total_ END AS total
            FROM (SELECT count(DISTINCT job_link) FILTER (WHERE {_EARLIER}) AS old,
                         count(DISTINCT job_link) AS total_ FROM postings),
                 (VALUES (1), (2), (3)) AS s(step)"""),
        # Silver
        "silver_clean": (_SILVER, f"SELECT {_SILVER_COLUMNS} FROM silver"),
        "silver_incremental": (
            f"{_POSTINGS}, stored AS ({_clean('(SELECT * FROM postings WHERE ' + _EARLIER + ')')}), "
            "fresh AS (SELECT * FROM postings WHERE job_link NOT IN (SELECT job_link FROM stored)), "
            f"silver AS ({_clean('fresh')})",
            f"SELECT {_SILVER_COLUMNS} FROM silver"),
        "work_mode_norm": (_POSTINGS, f"""
            SELECT raw_mode, {_WORK_MODE.replace('work_mode', 'raw_mode')} AS work_mode, count(*) AS cnt
            FROM (SELECT work_mode AS raw_mode FROM postings) GROUP BY ALL"""),
        "location_norm": (_POSTINGS, f"""
            SELECT location AS raw_location, {_FIRST_CITY} AS city, count(*) AS cnt
            FROM postings GROUP BY ALL"""),
        "location_explode": (_POSTINGS, f"""
            SELECT seq, CAST(i AS INT) AS position, places[i + 1] AS city
            FROM (SELECT seq, places, unnest(range(len(places))) AS i
                  FROM (SELECT seq, {_CITIES} AS places FROM postings))
            WHERE places[i + 1] <> ''"""),
        "skills_array": (_POSTINGS, f"""
            SELECT seq, array_to_string(found, '|') AS skills, CAST(len(found) AS INT) AS n_skills
            FROM (SELECT seq, {_SKILLS} AS found FROM postings)"""),
        # Gold
        "dim_skill": (_FACT, f"SELECT DISTINCT skill_name, {_SKILL_GROUP} AS skill_group FROM fact"),
        "dim_location": (_SILVER, f"""
            SELECT DISTINCT city, {_REGION} AS region, 'Vietnam' AS country
            FROM (SELECT location AS city FROM silver)"""),
        "dim_company": (_SILVER, "SELECT DISTINCT company_name, CAST(NULL AS VARCHAR) AS industry FROM silver"),
        "dim_date": (_SILVER, """
            SELECT DISTINCT CAST(strftime(date_posted, '%Y%m%d') AS INT) AS date_id, date_posted,
                   CAST(day(date_posted) AS INT) AS day, CAST(month(date_posted) AS INT) AS month,
                   CAST(quarter(date_posted) AS INT) AS quarter, CAST(year(date_posted) AS INT) AS year,
                   monthname(date_posted) AS month_name, dayname(date_posted) AS day_of_week
            FROM silver"""),
        "dim_job_category": (_SILVER, f"""
            SELECT DISTINCT category_name, {_CATEGORY_GROUP} AS category_group
            FROM (SELECT {_CATEGORY} AS category_name FROM silver)"""),
        "dim_work_mode": (_SILVER, "SELECT DISTINCT work_mode FROM silver"),
        "fact_job_posting": (_FACT, "SELECT *, date_id AS snapshot_date, CAST(1 AS INT) AS post_count FROM fact"),
        "fact_partition_counts": (_FACT, "SELECT date_id, count(*) AS row_count FROM fact GROUP BY date_id"),
        # A link that an earlier crawl has keeps its row of then.
        "gold_refresh": (
            _FACT.replace(_clean("postings"), _clean("bronze")).replace(_POSTINGS, f"""{_POSTINGS}, bronze AS (
  SELECT * FROM postings
  QUALIFY row_number() OVER (PARTITION BY job_link ORDER BY CASE WHEN {_EARLIER} THEN 0 ELSE 1 END, seq) = 1)"""),
            "SELECT date_id, count(*) AS row_count FROM fact GROUP BY date_id",
        ),
        # Quality
        "dq_totals": (_LINES, "SELECT count(*) AS total_rows FROM lines"),
        "dq_nulls": (_LINES, "SELECT " + ", ".join(
            f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in _LINE_CHECKS) + " FROM lines"),
        "dq_fact_null_fks": (_LINES, "SELECT " + ", ".join(
            f"count(*) FILTER (WHERE {c} IS NULL) AS null_{n}" for n, c in _FACT_CHECKS.items()) + " FROM lines"),
        "dq_nonpositive": (_LINES, """
            SELECT count(*) AS invalid_rows FROM lines
            WHERE quantity <= 0 OR price <= 0 OR total_price <= 0"""),
        "dq_text_format": (_LINES, """
            SELECT DISTINCT category_name FROM lines WHERE category_name <> upper(trim(category_name))
            ORDER BY category_name LIMIT 10"""),
        "dq_total_mismatch": (_LINES, """
            SELECT count(*) AS mismatch_count, t AS table_name
            FROM lines, (VALUES ('ecommerce_clean'), ('fact_sales')) AS v(t)
            WHERE abs(total_price - quantity * price) > 0.01 GROUP BY t"""),
        "dq_distinct_keys": (_LINES, """
            SELECT count(DISTINCT customer_id) AS unique_customers,
                   count(DISTINCT product_id) AS unique_products FROM lines"""),
        "dq_value_freq": (_LINES, """
            SELECT payment_method, count(*) AS cnt FROM lines GROUP BY payment_method"""),
        "dq_averages": (_LINES, "SELECT " + ", ".join(
            f"{_avg(c)} AS avg_{c}" for c in ("price", "quantity", "total_price")) + " FROM lines"),
        "dq_date_span": (_LINES, "SELECT min(order_date) AS start_date, max(order_date) AS end_date FROM lines"),
        "dq_revenue": (_LINES, """
            SELECT CAST(round(sum(CAST(total_price AS DECIMAL(18,4))), 2) AS DOUBLE) AS total_revenue
            FROM lines"""),
        "dq_preview": (_LINES, "SELECT DISTINCT customer_id AS customerid FROM lines ORDER BY 1 LIMIT 10"),
        "dq_schema": (_LINES, "\nUNION ALL\n".join(
            f"SELECT 'ecommerce_clean' AS table_name, CAST({i} AS INT) AS position, '{c}' AS column_name, "
            f"'{t}' AS data_type, count({c}) AS non_null FROM lines"
            for i, (c, t) in enumerate(_LINE_TYPES.items(), start=1))),
        "dq_suite": (_LINES, _suite()),
        # Series
        "postings_monthly": (_FACT, """
            SELECT CAST(year(date_posted) AS INT) AS year, CAST(month(date_posted) AS INT) AS month,
                   category_name AS job_category, count(*) AS total_jobs FROM fact GROUP BY ALL"""),
        "postings_daily": (_FACT, """
            SELECT date_posted AS ds, category_name AS job_category, count(*) AS total_jobs
            FROM fact GROUP BY ALL"""),
        "series_eligibility": (_MONTHLY, """
            SELECT job_category, count(*) AS n_points, CASE WHEN count(*) < 3 THEN 'skip'
                   WHEN count(*) < 6 THEN 'fit_all' ELSE 'evaluate' END AS plan
            FROM monthly GROUP BY job_category"""),
        "train_test_split_time": (_SPLIT, """
            SELECT job_category, ds, y, n_points, CAST(position AS INT) AS position, is_train FROM marked"""),
        "weekly_interpolate": (_WEEKLY, """
            SELECT job_category, ds, round(coalesce(y0 + (y1 - y0) *
                   (date_diff('day', t0, ds) / nullif(date_diff('day', t0, t1), 0)), y0), 6) AS y
            FROM spanned WHERE y0 IS NOT NULL"""),
        "future_frame": (_FRAME, "SELECT job_category, CAST(ds AS DATE) AS ds, kind FROM frame"),
        "forecast_trend": (_FITTED, """
            SELECT job_category, CAST(ds AS DATE) AS ds, kind, round(yhat, 6) AS yhat,
                   round(yhat - 1.2815515655446004 * noise, 6) AS yhat_lower,
                   round(yhat + 1.2815515655446004 * noise, 6) AS yhat_upper FROM fitted"""),
        "forecast_metrics": (
            f"{_SPLIT}, train AS (SELECT * FROM marked WHERE is_train), {_trend('train', 'line')}, scored AS ("
            "SELECT job_category, y, a + b * date_diff('day', DATE '1970-01-01', ds) AS yhat "
            "FROM marked JOIN line USING (job_category) WHERE NOT is_train)", """
            SELECT job_category, round(avg(abs(y - yhat)), 6) AS MAE,
                   round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS RMSE,
                   round(avg(abs((y - yhat) / nullif(y, 0))) * 100, 6) AS MAPE,
                   round(CASE WHEN count(*) < 2 THEN NULL
                     WHEN var_pop(y) > 0 THEN 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*))
                     WHEN sum((y - yhat) * (y - yhat)) = 0 THEN 1.0 ELSE 0.0 END, 6) AS R2_Score
            FROM scored GROUP BY job_category"""),
        # Retail
        "time_features": (_LINES, """
            SELECT CAST(year(order_date) AS INT) AS year, CAST(month(order_date) AS INT) AS month,
                   CAST(day(order_date) AS INT) AS day, CAST(dayofweek(order_date) + 1 AS INT) AS dow,
                   count(*) AS cnt, CAST(sum(quantity) AS BIGINT) AS quantity
            FROM lines GROUP BY ALL"""),
        "product_stats": (_STATS, "SELECT * FROM stats"),
        "product_features": (_STATS, """
            SELECT customer_id, product_id, order_date, quantity, total_price, prod_total_qty,
                   prod_avg_price, prod_unique_buyers FROM lines LEFT JOIN stats USING (product_id)"""),
        "order_line_features": (_FEATURES, """
            SELECT * REPLACE (CAST(year AS INT) AS year, CAST(month AS INT) AS month,
                              CAST(day AS INT) AS day, CAST(dow AS INT) AS dow) FROM features"""),
        "customer_rfm_days": (_LINES, f"""
            SELECT customer_id, max(order_date) AS last_purchase, count(DISTINCT order_date) AS freq_days,
                   {_exact_sum('total_price')} AS monetary FROM lines GROUP BY customer_id"""),
        "rfm": (_RFM, "SELECT * REPLACE (CAST(recency AS INT) AS recency) FROM rfm"),
        "rfm_scaled": (_RFM, "SELECT customer_id, " + ", ".join(
            f"round(coalesce(({c} - (SELECT avg({c}) FROM rfm)) / nullif((SELECT stddev_samp({c}) FROM rfm), 0), 0), 6)"
            f" AS {c}_z" for c in ("recency", "frequency", "monetary")) + " FROM rfm"),
        "impute_median": (_LINES, """
            SELECT customer_id, product_id, order_date, coalesce(payment_method, 'NA') AS payment_method,
                   coalesce(review_score, 0) AS review_score,
                   coalesce(CAST(age AS DOUBLE), (SELECT CAST(median(age) AS DOUBLE) FROM lines), 0) AS age
            FROM lines"""),
        "category_codes": (_LINES, """
            SELECT payment_method, CAST(dense_rank() OVER (ORDER BY payment_method) - 1 AS INT) AS code, cnt
            FROM (SELECT coalesce(payment_method, 'NA') AS payment_method, count(*) AS cnt
                  FROM lines GROUP BY 1)"""),
        "product_representative": (_LINES, _first_by("*")),
        "price_grid": (f"{_STATS}, latest AS ({_first_by('product_id, price AS own_price')})", f"""
            SELECT product_id, CAST(i AS INT) AS grid_index, base_price, base_price * {_GRID} AS price
            FROM (SELECT product_id, coalesce(nullif(prod_avg_price, 0), own_price) AS base_price
                  FROM latest LEFT JOIN stats USING (product_id)), range(15) AS r(i)
            WHERE base_price > 0"""),
        "price_best": (_CURVES, """
            SELECT product_id, round(price, 4) AS best_price, round(revenue, 4) AS estimated_revenue
            FROM offers QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY revenue DESC, i) = 1"""),
        # Reports
        "report_market_overview": (_FACT, f"""
            , jobs AS (SELECT DISTINCT job_link, category_name, CAST(NULL AS VARCHAR) AS industry,
                       {_CATEGORY_GROUP} AS category_group FROM fact)
            SELECT NULL AS industry, NULL AS category_group, NULL AS category_name, 'total' AS level,
                   count(*) AS active_jobs FROM jobs
            UNION ALL SELECT industry, NULL, NULL, 'industry', count(*) FROM jobs GROUP BY industry
            UNION ALL SELECT NULL, category_group, NULL, 'category_group', count(*) FROM jobs GROUP BY category_group
            UNION ALL SELECT NULL, category_group, category_name, 'category', count(*)
              FROM jobs GROUP BY category_group, category_name"""),
        "report_geography": (_FACT, f"""
            SELECT {_REGION} AS region, city, 'Vietnam' AS country,
                   count(DISTINCT job_link) AS active_jobs, count(*) AS skill_demand
            FROM fact GROUP BY city"""),
        "report_history_vs_forecast": (_FITTED, """
            SELECT job_category, ds, 'history' AS kind, CAST(y AS DOUBLE) AS jobs FROM monthly
            UNION ALL
            SELECT job_category, CAST(ds AS DATE), 'forecast', round(yhat, 6) FROM fitted WHERE kind = 'future'"""),
    }


def oracle_sql() -> dict[str, str]:
    return {key: f"WITH {tables.strip()}{statement if statement.lstrip().startswith(',') else ' ' + statement}"
            for key, (tables, statement) in _statements().items()}
