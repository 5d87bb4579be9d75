"""SQL for the same results, run by DuckDB on the same Parquet tables."""

from __future__ import annotations

from stayscope.plans.catalog import AREA_A, AREA_B, BOROUGH_NAMES, FILTERS
from stayscope.schema import (
    CATEGORICAL_FEATURES,
    CLEAN_SCHEMA,
    CORRELATION_COLUMNS,
    FEATURED_SCHEMA,
    NUMERIC_FEATURES,
    RAW_SCHEMA,
    REQUEST_BOUNDS,
    ROOM_TYPES,
)
from stayscope.sources.order_listings import FIXTURE_REFERENCE_DATE

ORACLE_SQL: dict[str, str] = {}


def rnd(x: str, digits: int) -> str:
    return f"cast(round(cast(cast(cast({x} as double) as varchar) as decimal(38,15)), {digits}) as double)"


def pct(part: str, whole: str, digits: int = 1) -> str:
    return rnd(f"({part}) * cast(100 as double) / ({whole})", digits)


def title(c: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, '[a-zA-Z]+|[^a-zA-Z]+'), "
        "lambda w: upper(w[1:1]) || lower(w[2:])), '')"
    )


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def names(columns) -> str:
    return ", ".join(columns)


def texts(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ---- The tables every query starts from ----

RAW = """
stays as (
  select l_orderkey, count(*) as cnt, sum(l_quantity) as qty, max(l_shipdate) as shipped
  from lineitem group by l_orderkey
),
raw as (
  select o.o_orderkey as id,
    case when o.o_orderkey % 997 = 0 then null
      else concat('  ', o.o_orderpriority, ' listing ', cast(o.o_orderkey as varchar), ' ') end as name,
    o.o_custkey as host_id,
    case when o.o_custkey % 211 = 0 then null else c.c_name end as host_name,
    case when o.o_orderkey % 13 = 0 then concat(' ', lower(r.r_name), ' ')
      else lower(r.r_name) end as neighbourhood_group,
    concat(lower(n.n_name), '''s d', cast(o.o_custkey % 20 as varchar)) as neighbourhood,
    case o.o_orderstatus when 'F' then 'Entire home/apt' when 'O' then 'Private room'
      else 'Shared room' end as room_type,
    cast(floor((o.o_totalprice - 1000) / 500) as int) as price,
    cast(case when o.o_orderkey % 50 = 0 then 30 + o.o_custkey % 300
      else 1 + o.o_custkey % 14 end as int) as minimum_nights,
    cast(coalesce(s.cnt, 0) as int) as number_of_reviews,
    cast(cast(s.shipped as date) as varchar) as last_review,
    cast(s.qty as double) / 32 as reviews_per_month,
    cast(count(*) over (partition by o.o_custkey) as int) as calculated_host_listings_count,
    cast(o.o_orderkey % 366 as int) as availability_365
  from orders o
  join customer c on o.o_custkey = c.c_custkey
  join nation n on c.c_nationkey = n.n_nationkey
  join region r on n.n_regionkey = r.r_regionkey
  left join stays s on s.l_orderkey = o.o_orderkey
)"""

CLEAN = f"""{RAW},
priced as (select * from raw where price > 0),
caps as (
  select quantile_cont(cast(price as double), 0.99) as price_cap,
    quantile_cont(cast(minimum_nights as double), 0.99) as nights_cap
  from priced
),
cleaned as (
  select id, {strip("coalesce(name, 'Unknown')")} as name, host_id,
    {strip("coalesce(host_name, 'Unknown')")} as host_name,
    {title(strip("neighbourhood_group"))} as neighbourhood_group,
    {title(strip("neighbourhood"))} as neighbourhood,
    {strip("room_type")} as room_type,
    least(cast(price as double), price_cap) as price,
    least(cast(minimum_nights as double), nights_cap) as minimum_nights,
    number_of_reviews, try_cast(last_review as date) as last_review,
    coalesce(reviews_per_month, 0) as reviews_per_month,
    calculated_host_listings_count, availability_365
  from priced, caps
)"""

AVAILABILITY = """case when availability_365 < 0 then null
      when availability_365 <= 30 then 'Rarely Available'
      when availability_365 <= 90 then 'Occasionally'
      when availability_365 <= 180 then 'Moderately'
      when availability_365 <= 365 then 'Highly Available' end"""
PACE = """case when reviews_per_month = 0 then 'No Reviews' when reviews_per_month <= 1 then 'Low'
      when reviews_per_month <= 3 then 'Medium' else 'High' end"""
SEGMENT = """case when price < 0 then null when price <= 75 then 'Budget' when price <= 150 then 'Mid'
      when price <= 300 then 'Premium' when price is not null then 'Luxury' end"""

FEATURE_SQL = {
    "price_per_review": "case when number_of_reviews > 0 then "
    + rnd("price / number_of_reviews", 2)
    + " else 0 end",
    "is_reviewed": "cast(number_of_reviews > 0 as int)",
    "host_is_superhost_proxy": "cast(calculated_host_listings_count >= 5 as int)",
    "availability_ratio": "round(availability_365 / cast(365 as double), 4)",
    "availability_category": AVAILABILITY,
    "review_score_category": PACE,
    "price_category": SEGMENT,
    "is_long_term": "cast(minimum_nights >= 30 as int)",
    "name_length": "cast(length(coalesce(name, '')) as int)",
    "last_review_year": "cast(year(last_review) as int)",
    "last_review_month": "cast(month(last_review) as int)",
    "days_since_last_review": f"cast(date_diff('day', last_review, date '{FIXTURE_REFERENCE_DATE}') as int)",
    "neighbourhood_median_price": "quantile_cont(price, 0.5) over (partition by neighbourhood)",
    "neighbourhood_group_median_price": "quantile_cont(price, 0.5) over (partition by neighbourhood_group)",
}
FEAT = (
    f"{CLEAN},\nfeat as (select *, "
    + ", ".join(f"{sql} as {c}" for c, sql in FEATURE_SQL.items())
    + " from cleaned)"
)
NEEDED = CATEGORICAL_FEATURES + NUMERIC_FEATURES + ["price"]
HASH = "cast('0x' || substr(md5(cast(id as varchar) || ':{seed}'), 1, 8) as bigint)"
ML = f"""{FEAT},
mlrows as (
  select id, {names(NEEDED)}, cast({HASH.format(seed=42)} % 100 < 20 as int) as is_test,
    cast({HASH.format(seed=43)} % 5 as int) as fold
  from feat where days_since_last_review is not null
),
train as (select * from mlrows where is_test = 0),
test as (select * from mlrows where is_test = 1)"""
REQUESTS = f"""{CLEAN},
asked as (
  select id as request_id,
    case when neighbourhood_group like ' %' then neighbourhood_group
      else {title("neighbourhood_group")} end as neighbourhood_group,
    neighbourhood, room_type, minimum_nights, number_of_reviews, reviews_per_month,
    calculated_host_listings_count, availability_365,
    cast(length(coalesce(name, '')) as int) as name_length
  from raw
)"""


def add(name: str, tables: str, sql: str) -> None:
    ORACLE_SQL[name] = f"with {tables.strip()}\n{sql}"


def hist(src: str, column: str, bins: int, where: str = "true", extra: str = "") -> str:
    """Bins by their edges; ``extra`` adds constant columns."""
    return f"""(
  with s as (select cast({column} as double) as x from {src} where {column} is not null and {where}),
  b as (select case when min(x) = max(x) then min(x) - 0.5 else min(x) end as lo,
    case when min(x) = max(x) then max(x) + 0.5 else max(x) end as hi from s),
  e as (select g.bin, lo + (hi - lo) / {bins} * (g.bin - 1) as bin_low,
    case when g.bin < {bins} then lo + (hi - lo) / {bins} * g.bin else hi + 1 end as bin_end
    from b, range(1, {bins + 1}) g(bin))
  select e.bin, e.bin_low, count(s.x) as n{extra}
  from e left join s on s.x >= e.bin_low and s.x < e.bin_end group by e.bin, e.bin_low
)"""


# ---- Sources and sinks ----

add(
    "load_listings",
    RAW,
    """select id, name, host_id, host_name, neighbourhood_group, neighbourhood, room_type,
  case when id % 10 = 1 or price is null then null when id % 10 = 0 then price + 0.25 else price end::double as price,
  minimum_nights::double as minimum_nights, number_of_reviews, last_review, reviews_per_month,
  calculated_host_listings_count, availability_365,
  case when id % 10 = 1 and price is not null then 1 else 0 end as n_unread from raw""",
)
for key in ("load_featured", "load_cached", "save_table", "engineer_features"):
    add(key, FEAT, f"select {names(FEATURED_SCHEMA.names)} from feat")
add("select_ml_columns", ML, f"select {names(NEEDED)} from mlrows")
add(
    "write_modes",
    CLEAN,
    """select a.* from (select neighbourhood, count(*) as n,
  quantile_cont(price, 0.5) as neighbourhood_median_price from cleaned group by neighbourhood) a, range(2)""",
)
add(
    "verify_load",
    CLEAN,
    "select count(*) as table_rows, count(*) as source_rows, true as matches from cleaned",
)

# ---- Profiling ----

SPARK_TYPES = {f.name: f.dataType.simpleString() for f in RAW_SCHEMA}
MISSING = " union all ".join(
    f"select '{c}' as column_name, '{t}' as dtype, count(*) - count({c}) as missing_count, count(*) as n_rows from raw"
    for c, t in SPARK_TYPES.items()
)
add(
    "schema_report",
    RAW,
    f"select column_name, dtype, missing_count, {pct('missing_count', 'n_rows', 2)} as missing_pct, "
    f"n_rows, {len(SPARK_TYPES)} as n_columns from ({MISSING})",
)
add("profile_shape", RAW, f"select count(*) as n_rows, {len(SPARK_TYPES)} as n_columns from raw")
add(
    "profile_missing",
    RAW,
    f"select column_name, missing_count, {pct('missing_count', 'n_rows', 2)} as missing_pct "
    f"from ({MISSING}) where missing_count > 0",
)
add(
    "profile_duplicates",
    RAW,
    f"select cast(sum(n - 1) as bigint) as duplicate_rows from "
    f"(select count(*) as n from (select * from raw union all select * from raw where id % 7 = 0) "
    f"group by {names(RAW_SCHEMA.names)})",
)
NUMBERS = [c for c, t in SPARK_TYPES.items() if t != "string"]
add(
    "profile_numeric",
    RAW,
    " union all ".join(
        f"select '{c}' as column_name, count({c}) as count, {rnd(f'avg({c})', 4)} as mean, "
        f"{rnd(f'stddev_samp({c})', 4)} as std, cast(min({c}) as double) as min, "
        + "".join(
            f"quantile_cont(cast({c} as double), {p / 100}) as p{p}, " for p in (25, 50, 75)
        )
        + f"cast(max({c}) as double) as max, count(*) - count({c}) as null_count from raw"
        for c in NUMBERS
    ),
)
WORDS = [c for c, t in SPARK_TYPES.items() if t == "string"]
add(
    "profile_categorical",
    RAW
    + ", vals as ("
    + " union all ".join(
        f"select '{c}' as column_name, {c} as value, count(*) as n from raw where {c} is not null group by {c}"
        for c in WORDS
    )
    + """), ranked as (
  select *, count(*) over (partition by column_name) as distinct_values,
    cast(row_number() over (partition by column_name order by n desc, value) as int) as rank from vals)""",
    f"select column_name, distinct_values, rank, value, n as count, "
    f"{pct('n', '(select count(*) from raw)')} as pct from ranked where rank <= 5",
)
add(
    "profile_price",
    RAW,
    f"""select 'price' as price_column, 'int' as dtype, cast(min(price) as double) as min,
  cast(max(price) as double) as max, {rnd("avg(price)", 2)} as mean,
  count(*) filter (price = 0) as zero_values, count(*) filter (price < 0) as negative_values,
  quantile_cont(cast(price as double), 0.5) as median from raw""",
)
add(
    "validate_cleaned",
    CLEAN,
    f"""select count(*) as n_rows, {len(CLEAN_SCHEMA)} as n_columns,
  case when count(*) > count(last_review)
    then 'last_review=' || cast(count(*) - count(last_review) as varchar) else '' end as remaining_nulls,
  min(price) as price_min, max(price) as price_max, {rnd("avg(price)", 2)} as price_mean,
  max(minimum_nights) as minimum_nights_max,
  string_agg(distinct room_type, '|' order by room_type) as room_types,
  string_agg(distinct neighbourhood_group, '|' order by neighbourhood_group) as boroughs
from cleaned""",
)
CATEGORIES = ["availability_category", "review_score_category", "price_category"]
add(
    "feature_summary",
    FEAT,
    " union all ".join(
        [
            f"select '{c}' as feature, cast(null as varchar) as value, cast(null as bigint) as count, "
            f"{rnd(f'avg({c})', 2)} as mean, cast(min({c}) as double) as min, "
            f"cast(max({c}) as double) as max from feat"
            for c in FEATURE_SQL
            if c not in CATEGORIES
        ]
        + [
            f"select '{c}', {c}, count(*), null, null, null from feat where {c} is not null group by {c}"
            for c in CATEGORIES
        ]
    ),
)

# ---- Cleaning ----

add("drop_zero_prices", RAW, f"select {names(RAW_SCHEMA.names)} from raw where price > 0")
add("cap_price", CLEAN, "select id, least(cast(price as double), price_cap) as price from priced, caps")
add(
    "cap_minimum_nights",
    CLEAN,
    "select id, least(cast(minimum_nights as double), nights_cap) as minimum_nights from priced, caps",
)
add(
    "fill_missing_text",
    RAW,
    "select id, coalesce(name, 'Unknown') as name, coalesce(host_name, 'Unknown') as host_name from raw",
)
add(
    "fix_reviews",
    RAW,
    "select id, last_review, coalesce(reviews_per_month, 0) as reviews_per_month from raw",
)
add("parse_last_review", RAW, "select id, try_cast(last_review as date) as last_review from raw")
add(
    "strip_whitespace",
    RAW,
    "select id, "
    + ", ".join(
        f"{strip(c)} as {c}"
        for c in ("name", "host_name", "neighbourhood_group", "neighbourhood", "room_type")
    )
    + " from raw",
)
add(
    "title_case",
    RAW,
    f"select id, {title('neighbourhood_group')} as neighbourhood_group, "
    f"{title('neighbourhood')} as neighbourhood from raw",
)
add(
    "reset_index",
    RAW,
    "select id, row_number() over (order by id) - 1 as row_index from raw where price > 0",
)
add("clean", CLEAN, f"select {names(CLEAN_SCHEMA.names)} from cleaned")

# ---- Features ----

FEATURE_KEYS = {
    "price_per_review": ["price_per_review"],
    "is_reviewed": ["is_reviewed"],
    "superhost_proxy": ["host_is_superhost_proxy"],
    "availability_ratio": ["availability_ratio"],
    "availability_category": ["availability_category"],
    "review_score_category": ["review_score_category"],
    "price_category": ["price_category"],
    "is_long_term": ["is_long_term"],
    "name_length": ["name_length"],
    "date_features": ["last_review_year", "last_review_month", "days_since_last_review"],
    "area_price_encoding": ["neighbourhood_median_price", "neighbourhood_group_median_price"],
}
for key, columns in FEATURE_KEYS.items():
    add(key, FEAT, f"select id, {names(columns)} from feat")

# ---- Market reports ----

P2, AVG_P = rnd("avg(price)", 2), "avg(price)"
add(
    "market_summary",
    FEAT,
    f"""select count(*) as total_listings, count(distinct host_id) as total_hosts,
  count(distinct neighbourhood) as total_neighbourhoods, {P2} as avg_price,
  quantile_cont(price, 0.5) as median_price, min(price) as min_price, max(price) as max_price,
  {rnd("avg(availability_365)", 1)} as avg_availability_days from feat""",
)
add(
    "borough_summary",
    FEAT,
    f"""select neighbourhood_group as borough, count(*) as total_listings, {P2} as avg_price,
  {rnd("min(price)", 2)} as min_price, {rnd("max(price)", 2)} as max_price,
  {pct("count(*)", "(select count(*) from feat)")} as market_share_pct
from feat group by 1""",
)
add(
    "room_type_breakdown",
    FEAT,
    f"""select room_type, count(*) as listing_count, {P2} as avg_price,
  {rnd("quantile_cont(price, 0.5)", 2)} as median_price,
  {pct("count(*)", "(select count(*) from feat)")} as share_pct
from feat group by 1""",
)
add(
    "top_neighbourhoods",
    FEAT,
    f"""select neighbourhood, neighbourhood_group as borough, count(*) as listing_count,
  {P2} as avg_price, {rnd("quantile_cont(price, 0.5)", 2)} as median_price
from feat group by 1, 2 having count(*) >= 30
order by avg_price desc, neighbourhood, borough limit 15""",
)
add(
    "price_category_mix",
    FEAT,
    f"""select borough, price_category, n as listing_count,
  {pct("n", "sum(n) over (partition by borough)")} as pct_within_borough
from (select neighbourhood_group as borough, price_category, count(*) as n from feat
  where price_category is not null group by all)""",
)
add(
    "room_type_crosstab",
    FEAT,
    "select neighbourhood_group as borough, "
    + ", ".join(
        rnd(f"avg(price) filter (room_type = '{r}')", 0) + f" as {c}"
        for r, c in zip(ROOM_TYPES, ("avg_entire_home", "avg_private_room", "avg_shared_room"))
    )
    + " from feat group by 1",
)
HOST_MEANS = f"""{P2} as avg_price, {rnd("avg(number_of_reviews)", 1)} as avg_reviews,
  {rnd("avg(availability_365)", 1)} as avg_availability"""
add(
    "top_hosts",
    FEAT,
    f"""select host_id, host_name, count(*) as listing_count, {HOST_MEANS}
from feat group by 1, 2 order by listing_count desc, host_id, host_name limit 10""",
)
add(
    "superhost_compare",
    FEAT,
    f"""select if(host_is_superhost_proxy = 1, 'Proxy Superhost (5+ listings)',
    'Regular Host (1–4 listings)') as host_type,
  count(distinct host_id) as host_count, count(*) as total_listings, {HOST_MEANS}
from feat group by 1""",
)
add(
    "most_reviewed_hosts",
    FEAT,
    f"""select * exclude (host_id) from (
  select host_id, host_name, count(*) as listing_count,
    {rnd("avg(number_of_reviews)", 1)} as avg_reviews_per_listing,
    cast(sum(number_of_reviews) as bigint) as total_reviews, {P2} as avg_price
  from feat group by 1, 2 having count(*) >= 3
  order by avg_reviews_per_listing desc, host_id, host_name limit 10)""",
)


def mix(category: str) -> str:
    return f"""select {category}, n as listing_count, avg_price, {pct("n", "sum(n) over ()")} as share_pct
from (select {category}, count(*) as n, {P2} as avg_price from feat
  where {category} is not null group by 1)"""


add("availability_mix", FEAT, mix("availability_category"))
add("review_category_mix", FEAT, mix("review_score_category"))
add(
    "availability_by_area_type",
    FEAT,
    f"""select neighbourhood_group as borough, room_type,
  {rnd("avg(availability_365)", 1)} as avg_days_available, {P2} as avg_price,
  count(*) as listing_count from feat group by 1, 2""",
)
add(
    "review_activity",
    FEAT,
    f"""select neighbourhood_group as borough, count(*) as total_listings,
  cast(sum(number_of_reviews) as bigint) as total_reviews,
  {rnd("avg(number_of_reviews)", 1)} as avg_reviews,
  {rnd("avg(reviews_per_month)", 2)} as avg_reviews_per_month,
  count(*) filter (is_reviewed = 1) as listings_with_reviews,
  {pct("count(*) filter (is_reviewed = 1)", "count(*)")} as pct_reviewed
from feat group by 1""",
)


def area_prices(least: int) -> str:
    return f"""{FEAT}, areas as (
  select neighbourhood, neighbourhood_group as borough, count(*) as listing_count, {P2} as avg_price
  from feat group by 1, 2 having count(*) >= {least})"""


add(
    "rank_in_borough",
    area_prices(20),
    """select *, cast(rank() over (partition by borough order by avg_price desc) as int)
  as price_rank_within_borough
from areas order by borough, price_rank_within_borough, neighbourhood limit 30""",
)
add(
    "running_totals",
    area_prices(30),
    f"""select *, cast(sum(listing_count) over (order by avg_price desc) as bigint) as cumulative_listings,
  {rnd("avg(avg_price) over (order by avg_price desc, neighbourhood, borough rows between 2 preceding and current row)", 2)}
  as rolling_3_avg_price
from areas order by avg_price desc, neighbourhood, borough limit 20""",
)
PERCENTILE = f"""select id, name, neighbourhood_group as borough, room_type, price,
  {rnd("percent_rank() over (partition by neighbourhood_group order by price) * 100", 1)}
  as price_percentile_in_borough from feat"""
add("price_percentile_all", FEAT, PERCENTILE)
add(
    "price_percentile",
    FEAT,
    PERCENTILE + " order by borough, price_percentile_in_borough desc, id limit 20",
)

# ---- Exploratory datasets ----

add(
    "hist_price",
    FEAT,
    f"""select * from {hist("feat", "price", 60, extra=", 'all' as view")}
union all select * from {hist("feat", "price", 60, "price <= 400", ", 'zoomed' as view")}""",
)
add("hist_availability", FEAT, f"select * from {hist('feat', 'availability_365', 50)}")
add(
    "hist_reviews_per_month",
    FEAT,
    f"select * from {hist('feat', 'reviews_per_month', 50, 'reviews_per_month > 0')}",
)
add("hist_minimum_nights", FEAT, f"select * from {hist('feat', 'minimum_nights', 45)}")
add(
    "box_price_room_type",
    FEAT
    + """, boxes as (select room_type, quantile_cont(price, 0.25) as q1,
  quantile_cont(price, 0.5) as median, quantile_cont(price, 0.75) as q3 from feat group by 1)""",
    f"""select room_type, q1, median, q3,
  min(price) filter (price between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whisker_low,
  max(price) filter (price between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whisker_high,
  count(*) filter (price not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as outliers,
  cast(list_position([{texts(ROOM_TYPES)}], room_type) as int) as position
from feat join boxes using (room_type) group by room_type, q1, median, q3""",
)
AVG4 = rnd("avg(price)", 4)


def borough_avg(src: str) -> str:
    return f"select neighbourhood_group, {AVG4} as avg_price from {src} group by 1"


def top15(src: str, least: int) -> str:
    return f"""select neighbourhood, {AVG4} as avg_price from {src}
group by 1 having count(*) >= {least} order by avg_price desc, neighbourhood limit 15"""


add("avg_price_borough", FEAT, borough_avg("feat"))
add("top15_neighbourhoods", FEAT, top15("feat", 30))
add(
    "room_type_counts",
    FEAT,
    f"""select room_type, n, {pct("n", "sum(n) over ()")} as pct
from (select room_type, count(*) as n from feat group by 1)""",
)
add(
    "correlation_matrix",
    FEAT,
    " union all ".join(
        f"select '{a}' as column_a, '{b}' as column_b, "
        f"case when stddev_pop({a}) > 0 and stddev_pop({b}) > 0 then {rnd(f'corr({a}, {b})', 6)} end as correlation "
        f"from (select {a}, {b} from feat where {a} is not null and {b} is not null)"
        if a != b
        else f"select '{a}' as column_a, '{a}' as column_b, "
        f"case when stddev_pop({a}) > 0 then cast(1 as double) end as correlation from feat"
        for a in CORRELATION_COLUMNS
        for b in CORRELATION_COLUMNS
    ),
)
add(
    "category_by_borough",
    FEAT,
    "select neighbourhood_group, "
    + ", ".join(
        f'count(*) filter (price_category = \'{c}\') as "{c}"'
        for c in ("Budget", "Mid", "Premium", "Luxury")
    )
    + " from feat where price_category is not null group by 1",
)
add(
    "top_hosts_by_name",
    FEAT,
    """select host_name, count(id) as listing_count from feat where host_name is not null
group by 1 order by listing_count desc, host_name limit 10""",
)
add(
    "sample_price_reviews",
    FEAT,
    f"""select id, number_of_reviews, price, room_type,
  (select quantile_cont(cast(number_of_reviews as double), 0.98) from feat) as reviews_p98
from feat order by {HASH.format(seed=42)}, id limit 5000""",
)

# ---- Dashboard datasets ----

add(
    "kpis",
    FEAT,
    f"""select count(*) as total_listings, count(distinct host_id) as unique_hosts,
  count(distinct neighbourhood) as neighbourhoods, {AVG4} as avg_price,
  quantile_cont(price, 0.5) as median_price from feat""",
)
add(
    "market_by_borough",
    FEAT,
    f"""select neighbourhood_group as "Borough", count(id) as "Listings", {P2} as "Avg_Price",
  {rnd("quantile_cont(price, 0.5)", 2)} as "Median_Price",
  {rnd("avg(availability_365)", 2)} as "Avg_Availability" from feat group by 1""",
)
FILTERED = f"""{FEAT}, chosen as (select * from feat
  where neighbourhood_group in ({texts(FILTERS["boroughs"])})
    and room_type in ({texts(FILTERS["room_types"])}) and price >= 10 and price <= 400)"""
add("filter_listings", FILTERED, f"select {names(FEATURED_SCHEMA.names)} from chosen")
add(
    "filter_options",
    FEAT,
    """select distinct 'borough' as option, neighbourhood_group as value from feat
union all select distinct 'room_type', room_type from feat
union all select 'price_min', cast(cast(floor(min(price)) as int) as varchar) from feat
union all select 'price_max', cast(cast(floor(max(price)) as int) as varchar) from feat""",
)
add("filtered_histogram", FILTERED, f"select * from {hist('chosen', 'price', 60)}")
add("filtered_room_mix", FILTERED, "select room_type, count(*) as n from chosen group by 1")
add("filtered_borough_avg", FILTERED, borough_avg("chosen"))
add("filtered_top15", FILTERED, top15("chosen", 30))
add(
    "filtered_borough_room",
    FILTERED,
    f"select neighbourhood_group, room_type, {AVG4} as avg_price from chosen group by 1, 2",
)
add(
    "areas_of_borough",
    FEAT,
    "select distinct neighbourhood from feat where neighbourhood_group = 'Asia'",
)
TWO = f"{FEAT}, two as (select * from feat where neighbourhood in ({texts([AREA_A, AREA_B])}))"
METRICS = {
    "Total Listings": ("count(*)", 0),
    "Avg Price": ("avg(price)", 2),
    "Median Price": ("quantile_cont(price, 0.5)", 2),
    "Avg Availability": ("avg(availability_365)", 2),
    "Avg Reviews": ("avg(number_of_reviews)", 2),
}


def one_area(expr: str, digits: int, area: str) -> str:
    return f"(select {rnd(expr, digits)} from two where neighbourhood = {texts([area])})"


add(
    "compare_areas",
    TWO,
    " union all ".join(
        f"select '{m}' as metric, {one_area(e, d, AREA_A)} as area_a, {one_area(e, d, AREA_B)} as area_b"
        for m, (e, d) in METRICS.items()
    ),
)
add(
    "compare_area_hist",
    TWO
    + """, b as (select min(price) as lo, max(price) as hi from two),
e as (select distinct neighbourhood, g.bin, lo + (hi - lo) / 40 * (g.bin - 1) as bin_low,
  case when g.bin < 40 then lo + (hi - lo) / 40 * g.bin else hi + 1 end as bin_end
  from two, b, range(1, 41) g(bin))""",
    """select e.neighbourhood, e.bin, e.bin_low, count(t.id) as n
from e left join two t on t.neighbourhood = e.neighbourhood and t.price >= e.bin_low and t.price < e.bin_end
group by 1, 2, 3""",
)
add(
    "compare_room_mix",
    TWO,
    "select neighbourhood, room_type, count(*) as n from two group by 1, 2",
)
add(
    "benchmark_price",
    FEAT
    + """, asked as (select id, neighbourhood, room_type,
  greatest(10, least(neighbourhood_median_price, 799)) as predicted_price from feat),
groups as (select neighbourhood, room_type, count(*) as cnt, quantile_cont(price, 0.5) as med,
  avg(price) as mean, min(price) as lowest, max(price) as highest from feat group by 1, 2),
cheaper as (select a.neighbourhood, a.room_type, a.predicted_price, count(f.id) as below
  from (select distinct neighbourhood, room_type, predicted_price from asked) a
  left join feat f on f.neighbourhood = a.neighbourhood and f.room_type = a.room_type
    and f.price < a.predicted_price group by 1, 2, 3)""",
    f"""select a.neighbourhood, a.room_type, a.predicted_price, a.id,
  case when cnt >= 5 then {rnd("med", 2)} end as area_median,
  case when cnt >= 5 then {rnd("mean", 2)} end as area_mean,
  case when cnt >= 5 then lowest end as area_min, case when cnt >= 5 then highest end as area_max,
  case when cnt >= 5 then {rnd("below * cast(100 as double) / cnt", 2)} end as pct_cheaper
from asked a join groups using (neighbourhood, room_type)
join cheaper using (neighbourhood, room_type, predicted_price)""",
)

# ---- Models ----

add("train_test_split", ML, "select id, is_test from mlrows")
CODES = ", ".join(
    f"code_{c} as (select v, cast(row_number() over (order by v) - 1 as int) as code "
    f"from (select distinct {c} as v from train))"
    for c in CATEGORICAL_FEATURES
)
add(
    "ordinal_encode",
    f"{ML}, {CODES}",
    "select id, "
    + ", ".join(
        f"coalesce((select code from code_{c} where v = {c}), -1) as {c}_code" for c in CATEGORICAL_FEATURES
    )
    + " from test",
)
add(
    "standard_scale",
    ML
    + ", facts as (select "
    + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in NUMERIC_FEATURES)
    + " from train)",
    "select id, "
    + ", ".join(
        f"case when s_{c} > 0 then {rnd(f'({c} - m_{c}) / s_{c}', 5)} else 0 end as {c}_scaled"
        for c in NUMERIC_FEATURES
    )
    + " from test, facts",
)
add(
    "fit_linear_one_feature",
    ML,
    f"""select {rnd("regr_slope(price, neighbourhood_median_price)", 4)} as slope,
  {rnd("regr_intercept(price, neighbourhood_median_price)", 4)} as intercept from train""",
)
SPLIT_COLUMNS = (
    "neighbourhood_group_median_price", "minimum_nights", "calculated_host_listings_count", "name_length", "number_of_reviews",
)


def split_search(name: str, l1: float, l2: float, leaf: float, least: int) -> str:
    """Best split of all features by second-order gain, squared error around the mean."""
    shrunk = lambda g: f"(sign({g}) * greatest(abs({g}) - {l1}, 0))"
    score = lambda g, n: f"({shrunk(g)} ** 2 / ({n} + {l2}))"
    value = lambda g, n: f"(-{shrunk(g)} / ({n} + {l2}))"
    return f"""(select '{name}' as penalties, feature, threshold, {rnd("gain", 3)} as gain,
  {rnd(value("gl", "nl"), 3)} as left_value, {rnd(value("g - gl", "n - nl"), 3)} as right_value
  from (select *, ({score("gl", "nl")} + {score("g - gl", "n - nl")} - {score("g", "n")}) / 2 - {leaf} as gain
    from sides where nl >= {least} and n - nl >= {least}) where gain > 0
  order by gain desc, place, threshold limit 1)"""


add(
    "boost_splits",
    ML
    + ", long as ("
    + " union all ".join(
        f"select {i} as place, '{c}' as feature, cast({c} as double) as x, (select avg(price) from train) - price as g0 from train"
        for i, c in enumerate(SPLIT_COLUMNS)
    )
    + """), per_value as (select place, feature, x as threshold, sum(g0) as gv, count(*) as nv from long group by all),
sides as (select *, sum(gv) over w as gl, sum(nv) over w as nl, sum(gv) over (partition by place) as g,
  sum(nv) over (partition by place) as n from per_value window w as (partition by place order by threshold))""",
    f"select * from {split_search('none', 0, 0, 0, 1)} union all select * from {split_search('all', 500, 250, 100, 50)}",
)

PREPARED = ", ".join(
    [
        f"cast(coalesce((select code from code_{c} where v = {c}), -1) as double) as {c}_x"
        for c in CATEGORICAL_FEATURES
    ]
    + [
        f"case when s_{c} > 0 then {rnd(f'({c} - m_{c}) / s_{c}', 5)} else 0 end as {c}_x"
        for c in NUMERIC_FEATURES
    ]
)
add(
    "preprocess",
    f"{ML}, {CODES}, facts as (select "
    + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in NUMERIC_FEATURES)
    + " from train)",
    f"select id, {PREPARED} from test, facts",
)
LINE = f"""{ML}, line as (
  select regr_slope(price, neighbourhood_median_price) as k,
    regr_intercept(price, neighbourhood_median_price) as d from train),
fitted as (select id, price, k * neighbourhood_median_price + d as guess from test, line)"""
add("load_model", LINE, f"select id, price, {rnd('guess', 3)} as prediction from fitted")


def metrics(prediction: str) -> str:
    return f"""{rnd(f"sqrt(avg((price - {prediction}) ** 2))", 2)} as rmse,
  {rnd(f"avg(abs(price - {prediction}))", 2)} as mae,
  {rnd(f"1 - sum((price - {prediction}) ** 2) / (var_pop(price) * count(*))", 4)} as r2"""


add("evaluate", ML, f"select {metrics('neighbourhood_median_price')} from test")
add("save_model", LINE, f"select 'LinearRegression' as model, {metrics('guess')} from fitted")
add(
    "model_metadata",
    LINE,
    f"""select 'LinearRegression' as model, {metrics("guess")}, 'xgboost_v1' as model_version,
  16 as features_used, 'price (USD per night)' as target from fitted""",
)
add(
    "cross_validate_linear",
    ML
    + """, line as (select k.fold, regr_slope(t.price, t.neighbourhood_median_price) as k,
  regr_intercept(t.price, t.neighbourhood_median_price) as d
  from range(5) k(fold) join train t on t.fold <> k.fold group by 1)""",
    f"""select cast(t.fold as int) as fold,
  {rnd("sqrt(avg((t.price - k * t.neighbourhood_median_price - d) ** 2))", 2)} as rmse
from train t join line on line.fold = t.fold group by 1""",
)
add(
    "cross_validate_least_squares",
    ML
    + """, z as (select *, cast(neighbourhood_median_price as double) as x1, cast(minimum_nights as double) as x2 from train),
c as (select k.fold, var_pop(x1) as c11, var_pop(x2) as c22, covar_pop(x1, x2) as c12, covar_pop(x1, price) as c1y,
  covar_pop(x2, price) as c2y, avg(x1) as m1, avg(x2) as m2, avg(price) as my
  from range(5) k(fold) join z on z.fold <> k.fold group by 1),
line as (select *, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) as b1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) as b2 from c)""",
    f"""select cast(z.fold as int) as fold,
  {rnd("sqrt(avg((price - my - b1 * (x1 - m1) - b2 * (x2 - m2)) ** 2))", 2)} as rmse
from z join line on line.fold = z.fold group by 1""",
)
RIVALS = {
    "Borough": "neighbourhood_group_median_price",
    "Area": "neighbourhood_median_price",
    "AreaAgain": "neighbourhood_median_price",
}
add(
    "compare_models",
    ML,
    "select position, model, rmse, mae, r2, "
    "cast(row_number() over (order by rmse, position) = 1 as int) as is_best from ("
    + " union all ".join(
        f"select {i} as position, '{m}' as model, {metrics(p)} from test"
        for i, (m, p) in enumerate(RIVALS.items())
    )
    + ")",
)
FOLDS = f"""{ML}, medians as (
  select k.fold, t.neighbourhood_group, quantile_cont(t.price, 0.5) as prediction
  from range(5) k(fold) join train t on t.fold <> k.fold group by 1, 2),
scores as (select t.fold, {rnd("sqrt(avg((t.price - m.prediction) ** 2))", 2)} as rmse
  from train t join medians m on m.fold = t.fold and m.neighbourhood_group = t.neighbourhood_group
  group by 1)"""
add("cross_validate", FOLDS, "select fold, rmse from scores")
add(
    "cv_summary",
    FOLDS,
    f"select {rnd('avg(rmse)', 2)} as mean_rmse, {rnd('stddev_pop(rmse)', 2)} as std_rmse from scores",
)
add(
    "actual_vs_predicted",
    ML,
    """select price as actual, neighbourhood_median_price as predicted,
  (select greatest(max(price), max(neighbourhood_median_price)) from test) as axis_max from test""",
)
add(
    "residuals",
    ML + ", left_over as (select price - neighbourhood_median_price as residual from test)",
    f"select * from {hist('left_over', 'residual', 60)}",
)

# ---- Scoring ----

CHECKS = {
    "neighbourhood_group": f"neighbourhood_group in ({texts(BOROUGH_NAMES)})",
    "neighbourhood": "length(neighbourhood) between 2 and 100",
    "room_type": f"room_type in ({texts(ROOM_TYPES)})",
    **{c: f"{c} between {lo} and {hi}" for c, (lo, hi) in REQUEST_BOUNDS.items()},
}
VIOLATIONS = ", ".join(f"case when {ok} then null else '{c}' end" for c, ok in CHECKS.items())
add(
    "validate_requests",
    REQUESTS,
    f"select request_id, concat_ws('|', {VIOLATIONS}) as violations from asked",
)
SCORED = f"""{REQUESTS},
areas as (select neighbourhood as area, quantile_cont(price, 0.5) as med from cleaned group by 1),
boroughs as (select neighbourhood_group as area, quantile_cont(price, 0.5) as med from cleaned group by 1),
valid as (
  select asked.* exclude (neighbourhood_group, neighbourhood),
    {title(strip("neighbourhood_group"))} as neighbourhood_group,
    {title(strip("neighbourhood"))} as neighbourhood
  from asked where concat_ws('|', {VIOLATIONS}) = ''),
ready as (
  select v.* exclude (minimum_nights), v.minimum_nights,
    coalesce(a.med, b.med, 106) as neighbourhood_median_price,
    coalesce(b.med, 106) as neighbourhood_group_median_price,
    cast(number_of_reviews > 0 as int) as is_reviewed,
    cast(calculated_host_listings_count >= 5 as int) as host_is_superhost_proxy,
    round(availability_365 / cast(365 as double), 4) as availability_ratio,
    cast(minimum_nights >= 30 as int) as is_long_term,
    cast(277.95 as double) as days_since_last_review
  from valid v left join areas a on a.area = v.neighbourhood
  left join boroughs b on b.area = v.neighbourhood_group)"""
add(
    "scoring_features",
    SCORED,
    f"select request_id, {names(CATEGORICAL_FEATURES + NUMERIC_FEATURES)} from ready",
)
add(
    "score_saved",
    ML + SCORED.removeprefix(CLEAN)
    + f""", line as (select regr_slope(price, neighbourhood_median_price) as k,
  regr_intercept(price, neighbourhood_median_price) as d from train),
fact as (select {rnd("avg(abs(price - k * neighbourhood_median_price - d))", 2)} as mae from test, line),
priced_requests as (
  select *, {rnd("greatest(10, least(k * neighbourhood_median_price + d, 799))", 2)} as p from ready, line, fact)""",
    f"""select request_id, p as predicted_price, {rnd("greatest(10, p - mae)", 2)} as price_range_low,
  {rnd("least(799, p + mae)", 2)} as price_range_high, 'USD' as currency,
  'line_v1' as model_version, neighbourhood_group as borough, neighbourhood, room_type,
  minimum_nights as min_nights from priced_requests""",
)
add(
    "score_stream_rejected",
    REQUESTS,
    f"select request_id, concat_ws('|', {VIOLATIONS}) as violations from asked where concat_ws('|', {VIOLATIONS}) <> ''",
)
for key in ("score", "score_stream"):
    add(
        key,
        SCORED
        + f""", priced_requests as (
  select *, {rnd("greatest(10, least(neighbourhood_median_price - 100, 799))", 2)} as p from ready)""",
        f"""select request_id, p as predicted_price, {rnd("greatest(10, p - 47.2)", 2)} as price_range_low,
  {rnd("least(799, p + 47.2)", 2)} as price_range_high, 'USD' as currency,
  'xgboost_v1' as model_version, neighbourhood_group as borough, neighbourhood, room_type,
  minimum_nights as min_nights from priced_requests""",
    )
