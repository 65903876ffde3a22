"""Registered queries of the record operators, each over whole tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.flow import Flow
from recordloom.functions import domain
from recordloom.functions.coerce import text
from recordloom.functions.keys import kind_of
from recordloom.operators import collate as C
from recordloom.operators import join as J
from recordloom.operators import ordering as O
from recordloom.operators import reshape as S
from recordloom.operators import rows as R
from recordloom.operators.profile import profile
from recordloom.plans.order import PLACE, numbered, placed
from recordloom.plans.store import fresh_path
from recordloom.sinks import raster, writers
from recordloom.sources import lines as L
from recordloom.streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LINEITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
EVENTS = ["event_id"]


def query(sql: str | None = None):
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- filter, project, compute ------------------------------------------------------------


@query("SELECT event_id, event_type, value FROM events WHERE value > 50 AND event_type <> 'error'")
def grep_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return R.grep(events, "{{value}} > 50 AND {{event_type}} <> 'error'").select("event_id", "event_type", "value")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F')")
def grep_invert(spark, sf_dir):
    return R.grep(table(spark, sf_dir, "orders"), "{{o_orderstatus}} = 'F'", invert=True).select("o_orderkey", "o_orderstatus")


@query("""WITH m AS (SELECT event_id, value, value > 95 AS hit FROM events),
w AS (SELECT *, max(hit::INT) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM m)
SELECT event_id, value FROM w WHERE near = 1""")
def grep_context(spark, sf_dir):
    return R.grep_context(table(spark, sf_dir, "events"), "value > 95", EVENTS, before=1, after=2).select("event_id", "value")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem""")
def xform_project(spark, sf_dir):
    out = R.xform(table(spark, sf_dir, "lineitem"), {"revenue": "round({{l_extendedprice}} * (1 - {{l_discount}}), 4)"})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "revenue")


@query("""SELECT o_orderkey, unnest(['status', 'priority']) AS field, unnest([o_orderstatus, o_orderpriority]) AS val FROM orders""")
def xform_many(spark, sf_dir):
    code = """array(struct({{o_orderkey}} as o_orderkey, 'status' as field, {{o_orderstatus}} as val),
        struct({{o_orderkey}} as o_orderkey, 'priority' as field, {{o_orderpriority}} as val))"""
    return R.xform_many(table(spark, sf_dir, "orders"), code)


@query("""SELECT event_id, lag(value) OVER (ORDER BY event_id) AS before_value, lead(value) OVER (ORDER BY event_id) AS after_value FROM events""")
def xform_neighbours(spark, sf_dir):
    out = R.xform_neighbours(table(spark, sf_dir, "events").select("event_id", "value"), EVENTS, 1, 1)
    return out.select("event_id", F.get("B", 0)["value"].alias("before_value"), F.get("A", 0)["value"].alias("after_value"))


@query("SELECT c_name || ':' || c_mktsegment AS value FROM customer")
def eval_text(spark, sf_dir):
    return R.evaluate(table(spark, sf_dir, "customer"), "{{c_name}} || ':' || {{c_mktsegment}}")


@query("""SELECT event_id, event_type, first_value(round(value, 2)) OVER (PARTITION BY event_type ORDER BY event_id) AS first_value FROM events""")
def annotate(spark, sf_dir):
    out = R.annotate(table(spark, sf_dir, "events"), ["event_type"], {"first_value": "round({{value}}, 2)"}, EVENTS)
    return out.select("event_id", "event_type", "first_value")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def assert_holds(spark, sf_dir):
    return R.ensure(table(spark, sf_dir, "orders"), "{{o_totalprice}} > -1e18").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def expandjson_typed(spark, sf_dir):
    out = R.expand_json(table(spark, sf_dir, "events"), ["props"], {"props": "k bigint"})
    return out.select("event_id", F.col("props.k").alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def expandjson_variant(spark, sf_dir):
    out = R.expand_json(table(spark, sf_dir, "events"), ["props"])
    return out.select("event_id", F.try_variant_get("props", "$.k", "bigint").alias("k"))


@query("""SELECT n_nationkey * 10 + k AS id, n_name AS parent FROM nation, (SELECT unnest([1, 2]) AS k)""")
def generate(spark, sf_dir):
    code = "transform(array(1, 2), k -> struct(cast({{n_nationkey}} * 10 + k as int) as id))"
    return R.generate(table(spark, sf_dir, "nation"), code).select("id", F.col("_chain.n_name").alias("parent"))


@query("""SELECT o_orderkey * 10 + k AS id, o_orderstatus AS parent FROM orders, (SELECT unnest([1, 2, 3]) AS k)""")
def generate_orders(spark, sf_dir):
    code = "transform(sequence(1, 3), k -> struct({{o_orderkey}} * 10 + k as id))"
    return R.generate(table(spark, sf_dir, "orders"), code).select("id", F.col("_chain.o_orderstatus").alias("parent"))


@query("SELECT event_id, CAST(floor(epoch(ts) / 3600) * 3600 AS DOUBLE) AS n_ts FROM events")
def normalizetime_strict(spark, sf_dir):
    out = R.normalize_time(table(spark, sf_dir, "events"), "ts", "1h")
    return out.select("event_id", F.col("n_ts").cast("double").alias("n_ts"))


@query("""WITH RECURSIVE s AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS i, floor(epoch(ts) / 60) * 60 AS b FROM events),
n AS (SELECT i, event_id, b AS v FROM s WHERE i = 1
UNION ALL SELECT s.i, s.event_id, CASE WHEN s.b = n.v + 60 THEN n.v ELSE s.b END FROM n JOIN s ON s.i = n.i + 1)
SELECT event_id, CAST(v AS DOUBLE) AS n_ts FROM n""")
def normalizetime_loose(spark, sf_dir):
    out = R.normalize_time(table(spark, sf_dir, "events"), "ts", 60, EVENTS, strict=False)
    return out.select("event_id", F.col("n_ts").cast("double").alias("n_ts"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS day, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders")
def parsedate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    out = R.parse_date(orders, "o_orderdate", output="day", write="%Y/%m/%d")
    return R.parse_date(out, "o_orderdate", output="seconds", to_epoch=True).select("o_orderkey", "day", "seconds")


# --- grouping -----------------------------------------------------------------------------


@query("""SELECT json_extract_string(props, '$.k')::BIGINT % 5 AS bucket, event_type, count(*) AS count, round(sum(value), 4) AS total,
round(avg(value), 4) AS mean, list_sort(list(value))[least(floor(count(*) * 90 / 100)::BIGINT, count(*) - 1) + 1] AS p90, count(DISTINCT user_id) AS users
FROM events WHERE event_type <> 'error' GROUP BY 1, 2""")
def flagship(spark, sf_dir):
    """Embedded JSON, filter, group with exact percentile and distinct count."""
    rows = R.expand_json(table(spark, sf_dir, "events"), ["props"], {"props": "k bigint"})
    rows = R.grep(rows, "{{event_type}} <> 'error'")
    out = C.collate(
        rows, [("bucket", F.col("props.k") % 5), "event_type"],
        ["count", "total=sum,value", "mean=avg,value", "p90=perc,90,value", "users=dcount,user_id"], EVENTS,
    )
    return rounded(out, "total", "mean")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_quantity), 4) AS sum_l_quantity, round(avg(l_extendedprice), 4) AS mean,
min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY ALL""")
def collate_basic(spark, sf_dir):
    specs = ["count", "sum,l_quantity", "mean=avg,l_extendedprice", "low=min,l_discount", "high=max,l_discount"]
    out = C.collate(table(spark, sf_dir, "lineitem"), ["!^l_returnflag|^l_linestatus!"], specs)
    return rounded(out, "sum_l_quantity", "mean")


@query("SELECT count(*) AS count, round(sum(o_totalprice), 2) AS total FROM orders HAVING count(*) > 0")
def collate_all(spark, sf_dir):
    return rounded(C.collate(table(spark, sf_dir, "orders"), [], ["count", "total=sum,o_totalprice"]), "total", digits=2)


@query("""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'ALL' ELSE l_returnflag END AS l_returnflag,
CASE WHEN grouping(l_linestatus) = 1 THEN 'ALL' ELSE l_linestatus END AS l_linestatus, count(*) AS count, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def collate_cube(spark, sf_dir):
    keys = ["l_returnflag", "l_linestatus"]
    return C.collate(table(spark, sf_dir, "lineitem"), keys, ["count", "suppliers=dcount,l_suppkey"], cube=True)


@query("""WITH g AS (SELECT user_id % 7 AS part, count(*) AS count FROM events GROUP BY 1)
SELECT part, count FROM g""")
def collate_text_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return C.collate(events, [("part", F.col("user_id") % 7)], ["count"], EVENTS, as_text=True)


@query("""SELECT event_id, event_type, count(*) OVER w AS count, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY event_type)""")
def collate_each(spark, sf_dir):
    out = C.collate_each(table(spark, sf_dir, "events"), ["event_type"], ["count", "total=sum,value"])
    return rounded(out.select("event_id", "event_type", "count", "total"), "total")


@query("""SELECT event_id, user_id, count(*) OVER w AS count, round(sum(value) OVER w, 4) AS total FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def collate_running(spark, sf_dir):
    return rounded(C.collate_running(table(spark, sf_dir, "events"), ["user_id"], ["count", "total=sum,value"], EVENTS), "total")


@query("""SELECT event_id, count(*) OVER w AS count, round(sum(value) OVER w, 3) AS total, round(avg(sqrt(value)) OVER w, 6) AS mean, min(value) OVER w AS low,
max(value) OVER w AS high, round(var_pop(sqrt(value)) OVER w, 6) AS spread, count(DISTINCT user_id) OVER w AS users, first(event_type) OVER w AS first_type,
arg_max(event_id, (value, event_id)) OVER w AS high_id FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def collate_running_all(spark, sf_dir):
    """One stream of all records."""
    events = table(spark, sf_dir, "events").withColumn("root", F.sqrt("value"))
    specs = ["count", "total=sum,value", "mean=avg,root", "low=min,value", "high=max,value", "spread=var,root", "users=dcount,user_id"]
    out = C.collate_running(events, [], [*specs, "first_type=first,event_type", "top=recformax,value"], EVENTS)
    out = rounded(rounded(out, "total", digits=3), "mean", "spread", digits=6)
    return out.withColumn("high_id", F.col("top.event_id")).drop("top")


@query("""SELECT event_id, event_type, count(*) OVER w AS count, round(stddev_pop(value) OVER w, 4) AS deviation, count(DISTINCT user_id % 50) OVER w AS users,
first(event_id) OVER w AS first_id, round(CASE WHEN count(*) OVER w > 1 THEN covar_pop(value, user_id) OVER w ELSE 0 END, 1) AS covariance FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def collate_running_spread(spark, sf_dir):
    """A few large groups."""
    events = table(spark, sf_dir, "events").withColumn("part", F.col("user_id") % 50)
    specs = ["count", "deviation=stddev,value", "users=dcount,part", "f=firstrec", "covariance=cov,value,user_id"]
    out = C.collate_running(events, ["event_type"], specs, EVENTS).withColumn("first_id", F.col("f.event_id")).drop("f")
    return rounded(rounded(out, "deviation"), "covariance", digits=1)


@query("""WITH c AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id))::INT AS s FROM events),
r AS (SELECT *, sum(s) OVER (ORDER BY event_id) AS run FROM c)
SELECT CAST(run AS BIGINT) AS run, event_type, count(*) AS count, max(value) AS high FROM r GROUP BY run, event_type""")
def collate_adjacent(spark, sf_dir):
    return C.collate_adjacent(table(spark, sf_dir, "events"), ["event_type"], ["count", "high=max,value"], EVENTS)


@query("""WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i, user_id % 40 AS part FROM events),
p AS (SELECT *, lag(i) OVER (PARTITION BY part ORDER BY i) AS prev FROM e),
g AS (SELECT p.i, count(DISTINCT q.part) AS between_keys FROM p JOIN e q ON q.i > p.prev AND q.i < p.i GROUP BY 1),
o AS (SELECT p.*, CASE WHEN prev IS NULL OR coalesce(between_keys, 0) >= 30 THEN p.i END AS opens FROM p LEFT JOIN g ON g.i = p.i),
r AS (SELECT *, max(opens) OVER (PARTITION BY part ORDER BY i) AS began FROM o)
SELECT began, part, count(*) AS count, max(event_id) AS last_id FROM r GROUP BY 1, 2""")
def collate_keylru(spark, sf_dir):
    """At most 30 groups are open."""
    events = table(spark, sf_dir, "events").withColumn("part", F.col("user_id") % 40)
    return C.collate_recent(events, "part", 30, ["count", "last_id=max,event_id"], EVENTS).withColumn("last_id", F.col("last_id").cast("bigint"))


@query("""SELECT event_id, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS high FROM events
WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) QUALIFY row_number() OVER (ORDER BY event_id) >= 5""")
def collate_rolling(spark, sf_dir):
    return rounded(C.collate_rolling(table(spark, sf_dir, "events"), 5, ["total=sum,value", "high=max,value"], EVENTS), "total")


@query("""SELECT l_returnflag, round(var_pop(l_quantity), 4) AS variance, round(stddev_pop(l_quantity), 4) AS deviation,
round(covar_pop(l_quantity, l_extendedprice), 2) AS covariance, round(corr(l_quantity, l_extendedprice), 6) AS correlation
FROM lineitem GROUP BY 1""")
def agg_spread(spark, sf_dir):
    specs = ["variance=var,l_quantity", "deviation=stddev,l_quantity", "covariance=cov,l_quantity,l_extendedprice", "correlation=corr,l_quantity,l_extendedprice"]
    out = C.collate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], specs)
    return rounded(rounded(rounded(out, "variance", "deviation"), "covariance", digits=2), "correlation", digits=6)


@query("""SELECT l_linestatus, round(regr_intercept(l_extendedprice, l_quantity), 3) AS alpha, round(regr_slope(l_extendedprice, l_quantity), 4) AS beta,
round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)), 4) AS beta_se
FROM lineitem GROUP BY 1""")
def agg_linreg(spark, sf_dir):
    out = C.collate(table(spark, sf_dir, "lineitem"), ["l_linestatus"], ["r=linreg,l_quantity,l_extendedprice"])
    out = out.select("l_linestatus", "r.alpha", "r.beta", "r.beta_se")
    return rounded(rounded(out, "beta", "beta_se"), "alpha", digits=3)


@query("""WITH m AS (SELECT event_type, count(value) AS count, avg(value) AS mean, var_pop(value) AS variance, sum(value) AS s1, sum(value**2) AS s2, sum(value**3) AS s3, sum(value**4) AS s4
FROM events GROUP BY 1)
SELECT event_type, count, round(mean, 4) AS mean, round(variance, 3) AS variance,
round((s3 / count - 3 * mean * s2 / count + 2 * mean**3) / variance**1.5, 4) AS skewness,
round((s4 / count - 4 * mean * s3 / count + 6 * mean**2 * s2 / count - 3 * mean**4) / variance**2, 4) AS kurtosis FROM m""")
def agg_moments(spark, sf_dir):
    out = C.collate(table(spark, sf_dir, "events"), ["event_type"], ["m=ord2uni,value"])
    out = out.select("event_type", "m.count", "m.mean", "m.variance", "m.skewness", "m.kurtosis")
    return rounded(rounded(out, "mean", "skewness", "kurtosis"), "variance", digits=3)


@query("""SELECT l_returnflag, count(*) AS count, round(covar_pop(l_quantity, l_extendedprice), 2) AS covariance, round(corr(l_quantity, l_extendedprice), 6) AS correlation,
round(regr_slope(l_extendedprice, l_quantity), 4) AS beta FROM lineitem GROUP BY 1""")
def agg_two_moments(spark, sf_dir):
    out = C.collate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["m=ord2biv,l_quantity,l_extendedprice"])
    out = out.select("l_returnflag", "m.count", "m.covariance", "m.correlation", "m.beta")
    return rounded(rounded(rounded(out, "covariance", digits=2), "correlation", digits=6), "beta")


@query("""SELECT event_type, list_sort(list(value))[least(floor(count(*) * 50 / 100)::BIGINT, count(*) - 1) + 1] AS p50,
list_sort(list(value))[least(floor(count(*) * 99 / 100)::BIGINT, count(*) - 1) + 1] AS p99 FROM events GROUP BY 1""")
def agg_percentile(spark, sf_dir):
    out = C.collate(table(spark, sf_dir, "events"), ["event_type"], ["p50=perc,50,value", "m=percmap,99 50,value"])
    return out.select("event_type", "p50", F.col("m")["99"].alias("p99"))


@query("""WITH c AS (SELECT event_type, user_id, count(*) AS ct, min(event_id) AS o FROM events GROUP BY 1, 2)
SELECT event_type, arg_min(user_id::VARCHAR, (-ct, o)) AS top_user, count(*) AS users FROM c GROUP BY 1""")
def agg_mode(spark, sf_dir):
    return C.collate(table(spark, sf_dir, "events"), ["event_type"], ["top_user=mode,user_id", "users=dcount,user_id"], EVENTS)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg_countby(spark, sf_dir):
    out = C.collate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["m=countby,l_linestatus"])
    return out.select("l_returnflag", F.explode("m").alias("l_linestatus", "n"))


@query("""SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type, min(event_id) AS first_id, max(event_id) AS last_id
FROM events GROUP BY 1""")
def agg_first_last(spark, sf_dir):
    specs = ["first_type=first,event_type", "last_type=last,event_type", "f=firstrec", "l=lastrec"]
    out = C.collate(table(spark, sf_dir, "events"), ["user_id"], specs, EVENTS)
    return out.select("user_id", "first_type", "last_type", F.col("f.event_id").alias("first_id"), F.col("l.event_id").alias("last_id"))


@query("""SELECT event_type, arg_max(event_id, (value, event_id)) AS high_id, arg_min(event_id, (value, -event_id)) AS low_id FROM events GROUP BY 1""")
def agg_record_for(spark, sf_dir):
    out = C.collate(table(spark, sf_dir, "events"), ["event_type"], ["h=recformax,value", "l=recformin,value"], EVENTS)
    return out.select("event_type", F.col("h.event_id").alias("high_id"), F.col("l.event_id").alias("low_id"))


@query("""SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, string_agg(DISTINCT substr(n_name, 1, 1), '' ORDER BY substr(n_name, 1, 1)) AS letters,
len(list(n_name))::INTEGER AS n FROM nation GROUP BY 1""")
def agg_concatenate(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("letter", F.substring("n_name", 1, 1))
    specs = ["names=concatenate,|,n_name", "letters=uconcat,,letter", "a=array,n_name"]
    out = C.collate(nation, ["n_regionkey"], specs, ["n_nationkey"])
    return out.select("n_regionkey", F.replace("names", F.lit("|"), F.lit(",")).alias("names"), "letters", F.size("a").alias("n"))


@query("""SELECT n_regionkey, unnest(list_sort(list_distinct(list(substr(n_name, 1, 1))))) AS letter FROM nation GROUP BY 1""")
def agg_uarray(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("letter", F.substring("n_name", 1, 1))
    out = C.collate(nation, ["n_regionkey"], ["u=uarray,letter"])
    return out.select("n_regionkey", F.explode("u").alias("letter"))


@query("SELECT n_regionkey, n_name AS name, n_nationkey AS nationkey FROM nation")
def agg_values_to_keys(spark, sf_dir):
    out = C.collate(table(spark, sf_dir, "nation"), ["n_regionkey"], ["m=vk,n_name,n_nationkey"], ["n_nationkey"])
    return out.select("n_regionkey", F.explode("m").alias("name", "nationkey"))


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def agg_records(spark, sf_dir):
    out = C.collate(table(spark, sf_dir, "nation"), ["n_regionkey"], ["r=records"], ["n_nationkey"])
    return out.select(F.explode("r").alias("r")).select("r.n_regionkey", "r.n_nationkey", "r.n_name")


@query("""SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_quantity > 49), 0) AS large, round(sum(l_tax) FILTER (WHERE l_quantity > 49), 4) AS tax,
round(100 * avg(l_discount), 4) AS percent FROM lineitem GROUP BY 1""")
def domain_subset(spark, sf_dir):
    large = "{{l_quantity}} > 49"
    specs = [
        ("large", domain.subset(large, domain.named("count"))),
        ("tax", domain.subset(large, domain.named("sum", "l_tax"))),
        ("percent", domain.transformed(domain.named("average", "l_discount"), lambda c: c * 100)),
    ]
    return rounded(C.collate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], specs), "tax", "percent")


@query("""SELECT l_linestatus, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_discount), 4) AS l_discount, round(avg(l_tax), 4) AS l_tax FROM lineitem GROUP BY 1""")
def domain_for_field(spark, sf_dir):
    made = domain.for_field("quantity|discount|tax", lambda n: domain.named("average", n))
    out = C.collate(table(spark, sf_dir, "lineitem"), ["l_linestatus"], [("f", made)])
    return rounded(out.select("l_linestatus", "f.l_quantity", "f.l_discount", "f.l_tax"), "l_quantity", "l_discount", "l_tax")


@query("""SELECT n_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS folded, max(n_nationkey) AS reduced FROM nation GROUP BY 1""")
def domain_folds(spark, sf_dir):
    specs = [
        ("folded", domain.fold(F.lit(0).cast("bigint"), "cast({{n_nationkey}} as bigint)", lambda a, x: a + x)),
        ("reduced", domain.map_reduce("{{n_nationkey}}", lambda a, x: F.greatest(a, x))),
    ]
    return C.collate(table(spark, sf_dir, "nation"), ["n_regionkey"], specs, ["n_nationkey"])


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS types, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS kinds,
string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY 1""")
def agg_lists(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = C.collate(events, ["user_id"], ["types=concatenate,|,event_type", "kinds=uconcat,+,event_type", "ids=array,event_id"], EVENTS)
    return out.withColumn("types", F.replace("types", F.lit("|"), F.lit(","))).withColumn("ids", F.concat_ws(",", F.col("ids").cast("array<string>")))


@query("""SELECT user_id, unnest(list_sort(list_distinct(list(event_type)))) AS kind FROM events GROUP BY 1""")
def agg_uarray_users(spark, sf_dir):
    out = C.collate(table(spark, sf_dir, "events"), ["user_id"], ["u=uarray,event_type"])
    return out.select("user_id", F.explode("u").alias("kind"))


@query("""SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def agg_values_to_keys_users(spark, sf_dir):
    out = C.collate(table(spark, sf_dir, "events"), ["user_id"], ["m=vk,event_type,value"], EVENTS)
    return out.select("user_id", F.explode("m").alias("event_type", "value"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders""")
def agg_records_orders(spark, sf_dir):
    out = C.collate(table(spark, sf_dir, "orders"), ["o_custkey"], ["r=records"], ["o_orderkey"])
    out = out.select(F.posexplode("r").alias("place", "r"))
    return out.select("r.o_custkey", "r.o_orderkey", "r.o_totalprice", F.col("place").cast("bigint").alias("place"))


@query("""SELECT o_custkey, CAST(sum(o_orderkey % 7) AS BIGINT) AS folded, max(o_orderkey) AS reduced FROM orders GROUP BY 1""")
def domain_folds_orders(spark, sf_dir):
    specs = [
        ("folded", domain.fold(F.lit(0).cast("bigint"), "cast({{o_orderkey}} % 7 as bigint)", lambda a, x: a + x)),
        ("reduced", domain.map_reduce("{{o_orderkey}}", lambda a, x: F.greatest(a, x))),
    ]
    return C.collate(table(spark, sf_dir, "orders"), ["o_custkey"], specs, ["o_orderkey"])


# --- join ------------------------------------------------------------------------------------

_SIDES = """WITH i AS (SELECT o_orderkey AS id, o_custkey AS ref, o_orderstatus AS tag FROM orders),
d AS (SELECT CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_custkey END AS cust, c_mktsegment AS tag, c_name FROM customer) """


def _sides(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("ref"), F.col("o_orderstatus").alias("tag"))
    # All customers, of whom one segment has no key, so that both sides have rows without a match.
    key = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_custkey"))
    return orders, table(spark, sf_dir, "customer").select(key.alias("cust"), F.col("c_mktsegment").alias("tag"), "c_name")


_JOINED = "SELECT id, ref, cust, CASE WHEN c_name IS NULL THEN i.tag ELSE d.tag END AS tag, c_name FROM i {} JOIN d ON ref = cust"


@query(_SIDES + _JOINED.format("INNER"))
def join_inner(spark, sf_dir):
    return J.join(*_sides(spark, sf_dir), [("ref", "cust")])


@query(_SIDES + _JOINED.format("RIGHT"))
def join_left(spark, sf_dir):
    return J.join(*_sides(spark, sf_dir), [("ref", "cust")], "left")


@query(_SIDES + _JOINED.format("LEFT"))
def join_right(spark, sf_dir):
    return J.join(*_sides(spark, sf_dir), [("ref", "cust")], "right")


@query(_SIDES + _JOINED.format("FULL"))
def join_outer(spark, sf_dir):
    return J.join(*_sides(spark, sf_dir), [("ref", "cust")], "outer")


@query("""SELECT c_custkey, c_name, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey""")
def join_two_keys(spark, sf_dir):
    out = J.join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), [("c_nationkey", "s_nationkey"), ("c_custkey", "s_suppkey")])
    return out.select("c_custkey", "c_name", "s_suppkey")


@query("SELECT c_name, o_orderkey, round(c_acctbal + o_totalprice, 2) AS both FROM orders JOIN customer ON o_custkey = c_custkey")
def join_operation(spark, sf_dir):
    changes = {"o_orderkey": "i.o_orderkey", "both": "round(d.c_acctbal + i.o_totalprice, 2)"}
    out = J.join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), [("o_custkey", "c_custkey")], changes=changes)
    return out.select("c_name", "o_orderkey", "both")


@query("""SELECT c_custkey, c_name, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""")
def join_accumulate(spark, sf_dir):
    out = J.join_accumulate(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), [("o_custkey", "c_custkey")], ["o_orderkey"], keep_unmatched=True)
    return out.select("c_custkey", "c_name", "o_orderkey", "o_orderstatus")


# --- order ------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_top(spark, sf_dir):
    """A top-100 report."""
    return O.sort(table(spark, sf_dir, "orders"), ["o_totalprice=-n"], ["o_orderkey"]).limit(100).select("o_orderkey", "o_totalprice")


def _with_place(ordered):
    """Each row's place in a sorted frame, so that the SQL twin sees the order."""
    return numbered(placed(ordered), [PLACE]).withColumnRenamed(PLACE, "place")


@query("""SELECT c_custkey, c_mktsegment, c_acctbal,
row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) - 1 AS place FROM customer""")
def sort_keys(spark, sf_dir):
    ordered = O.sort(table(spark, sf_dir, "customer"), ["c_mktsegment=*", "c_acctbal=-num"], ["c_custkey"])
    return _with_place(ordered).select("c_custkey", "c_mktsegment", "c_acctbal", "place")


@query("""SELECT o.event_id, o.event_type, o.value, e.n, row_number() OVER (ORDER BY o.value, o.event_id) - 1 AS place
FROM events o JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) e USING (event_type)""")
def fluent_join(spark, sf_dir):
    """Joined records keep the place that the sort gave them, though both sides have one."""
    events = Flow(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ("event_id",))
    kinds = events.collate(["event_type"], ["n=count"]).df.withColumn("event_id", F.lit(-1).cast("bigint"))
    joined = events.sort("value=n").join(Flow(kinds.withColumn(PLACE, F.lit(0)).drop("event_id"), (PLACE,)), [("event_type", "event_type")])
    return numbered(joined.df, list(joined.order)).select("event_id", "event_type", "value", "n", F.col(PLACE).alias("place"))


@query("""SELECT event_id, user_id, event_type FROM events
QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)""")
def multiplex_uniq(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return S.by_group(rows, ["user_id"], O.uniq, keys=["event_type"], order=EVENTS)


@query("""WITH b AS (SELECT event_type, min(event_id) AS b FROM events WHERE value > 90 GROUP BY 1),
e AS (SELECT event_type, min(event_id) AS e FROM events JOIN b USING (event_type) WHERE event_id >= b AND user_id % 1000 = 7 GROUP BY 1)
SELECT event_id, event_type, value FROM events JOIN b USING (event_type) LEFT JOIN e USING (event_type) WHERE event_id >= b AND (e IS NULL OR event_id <= e)""")
def multiplex_substream(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    out = S.by_group(rows, ["event_type"], O.substream, order=EVENTS, begin="{{value}} > 90", end="{{user_id}} % 1000 = 7")
    return out.select("event_id", "event_type", "value")


@query("""WITH c AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w)::INT AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS count, max(value) AS high FROM r GROUP BY user_id, run, event_type""")
def multiplex_adjacent(spark, sf_dir):
    return S.by_group(
        table(spark, sf_dir, "events"), ["user_id"], C.collate_adjacent, keys=["event_type"], aggregates=["count", "high=max,value"], order=EVENTS
    )


@query("""SELECT event_id, event_type, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS high FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) >= 4""")
def multiplex_rolling(spark, sf_dir):
    specs = ["total=sum,value", "high=max,value"]
    return rounded(S.by_group(table(spark, sf_dir, "events"), ["event_type"], C.collate_rolling, size=4, aggregates=specs, order=EVENTS), "total")


@query("""WITH m AS (SELECT event_id, event_type, value, value > 95 AS hit FROM events),
w AS (SELECT *, max(hit::INT) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM m)
SELECT event_id, event_type, value FROM w WHERE near = 1""")
def multiplex_context(spark, sf_dir):
    out = S.by_group(table(spark, sf_dir, "events"), ["event_type"], R.grep_context, condition="value > 95", order=EVENTS, before=1, after=2)
    return out.select("event_id", "event_type", "value")


@query("""SELECT event_id, user_id, lag(value) OVER w AS before_value, lead(value) OVER w AS after_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def multiplex_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    out = S.by_group(rows, ["user_id"], R.xform_neighbours, order=EVENTS, before=1, after=1)
    return out.select("event_id", "user_id", F.get("B", 0)["value"].alias("before_value"), F.get("A", 0)["value"].alias("after_value"))


@query("""WITH RECURSIVE s AS (SELECT event_id, user_id % 100 AS part, row_number() OVER (PARTITION BY user_id % 100 ORDER BY event_id) AS i, floor(epoch(ts) / 3600) * 3600 AS b FROM events),
n AS (SELECT part, i, event_id, b AS v FROM s WHERE i = 1
UNION ALL SELECT s.part, s.i, s.event_id, CASE WHEN s.b = n.v + 3600 THEN n.v ELSE s.b END FROM n JOIN s ON s.i = n.i + 1 AND s.part = n.part)
SELECT event_id, part, CAST(v AS DOUBLE) AS n_ts FROM n""")
def multiplex_loose_time(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("part", F.col("user_id") % 100)
    out = S.by_group(rows, ["part"], R.normalize_time, key="ts", span="1h", order=EVENTS, strict=False)
    return out.select("event_id", "part", F.col("n_ts").cast("double").alias("n_ts"))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) > 10")
def multiplex_skip(spark, sf_dir):
    return S.by_group(table(spark, sf_dir, "events"), ["event_type"], O.skip, n=10, order=EVENTS).select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 5")
def topn_by_key(spark, sf_dir):
    return O.topn(table(spark, sf_dir, "events"), 5, ["event_type"], EVENTS).select("event_id", "event_type")


@query("SELECT event_id, ts FROM events ORDER BY event_id LIMIT 10")
def head(spark, sf_dir):
    """The first ten records."""
    return O.head(table(spark, sf_dir, "events"), 10, EVENTS).select("event_id", "ts")


@query("SELECT event_id FROM events ORDER BY event_id OFFSET 100")
def skip_first(spark, sf_dir):
    return O.skip(table(spark, sf_dir, "events"), 100, EVENTS).select("event_id")


@query("SELECT event_id, value, row_number() OVER (ORDER BY event_id DESC) - 1 AS place FROM events")
def reverse(spark, sf_dir):
    return _with_place(O.reverse(table(spark, sf_dir, "events"), EVENTS)).select("event_id", "value", "place")


@query("SELECT n_name AS name, n_regionkey, NULL::INTEGER AS r_regionkey FROM nation UNION ALL SELECT r_name, NULL, r_regionkey FROM region")
def concat(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    return O.concat(nation, table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), "r_regionkey"))


@query("""SELECT event_id AS id, user_id, NULL::DOUBLE AS o_totalprice FROM events UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders""")
def concat_streams(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id")
    return O.concat(events, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"))


@query("""SELECT event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id)""")
def uniq_adjacent(spark, sf_dir):
    return O.uniq(table(spark, sf_dir, "events"), ["event_type"], EVENTS).select("event_id", "event_type")


@query("""SELECT event_id, round(lead(value) OVER (ORDER BY event_id) - value, 4) AS value FROM events QUALIFY lead(event_id) OVER (ORDER BY event_id) IS NOT NULL""")
def delta(spark, sf_dir):
    return rounded(O.delta(table(spark, sf_dir, "events"), ["value"], EVENTS).select("event_id", "value"), "value")


@query("""SELECT event_id, user_id, round(lead(value) OVER w - value, 4) AS value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY lead(event_id) OVER w IS NOT NULL""")
def delta_by_key(spark, sf_dir):
    out = S.by_group(table(spark, sf_dir, "events"), ["user_id"], O.delta, keys=["value"], order=EVENTS)
    return rounded(out.select("event_id", "user_id", "value"), "value")


@query("""WITH b AS (SELECT min(event_id) AS b FROM events WHERE value > 99), e AS (SELECT min(event_id) AS e FROM events, b WHERE event_id >= b AND value < 1)
SELECT event_id, value FROM events, b, e WHERE event_id >= b AND (e IS NULL OR event_id <= e)""")
def substream(spark, sf_dir):
    return O.substream(table(spark, sf_dir, "events"), EVENTS, "{{value}} > 99", "{{value}} < 1").select("event_id", "value")


# --- reshape ----------------------------------------------------------------------------------


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def decollate_split(spark, sf_dir):
    return S.decollate(table(spark, sf_dir, "part"), ["split,p_name, ,word"]).select("p_partkey", "word")


@query("SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def decollate_unarray(spark, sf_dir):
    return S.decollate(table(spark, sf_dir, "embeddings"), ["unarray,embedding,x"]).select("vec_id", "x")


@query("SELECT o_orderkey, unnest(['status', 'total']) AS name, unnest([o_orderstatus, CAST(o_custkey AS VARCHAR)]) AS val FROM orders")
def decollate_unhash(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    held = orders.withColumn("data", F.create_map(F.lit("status"), "o_orderstatus", F.lit("total"), F.col("o_custkey").cast("string")))
    return S.decollate(held, ["unhash,data,name,val"]).select("o_orderkey", "name", "val")


@query("SELECT vec_id, embedding[1] AS \"v-e-0\", embedding[2] AS \"v-e-1\", label AS \"v-label\" FROM embeddings")
def flatten(spark, sf_dir):
    held = table(spark, sf_dir, "embeddings").select("vec_id", F.struct(F.slice("embedding", 1, 2).alias("e"), "label").alias("v"))
    return S.flatten(held, ["v"], depth=2)


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events)
SELECT CAST(i AS INTEGER) AS i, max(event_id) FILTER (WHERE event_type = 'click') AS click, max(event_id) FILTER (WHERE event_type = 'view') AS view FROM r GROUP BY 1""")
def stream2table(spark, sf_dir):
    out = S.stream_to_table(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", EVENTS)
    got = lambda n: F.col(n)["event_id"] if n in out.columns else F.lit(None).cast("bigint")
    return out.select("i", got("click").alias("click"), got("view").alias("view"))


@query("""SELECT l_returnflag, CAST(arg_max(l_linenumber, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FILTER (WHERE l_linestatus = 'F') AS VARCHAR) AS "F_l_linenumber",
CAST(arg_max(l_partkey, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) FILTER (WHERE l_linestatus = 'O') AS VARCHAR) AS "O_l_partkey" FROM lineitem GROUP BY 1""")
def toptable(spark, sf_dir):
    out = S.pivot(table(spark, sf_dir, "lineitem"), ["l_linestatus", "FIELD"], ["l_returnflag"], ["l_linenumber", "l_partkey"], LINEITEM)
    return out.select("l_returnflag", "F_l_linenumber", "O_l_partkey")


# --- text in and out ----------------------------------------------------------------------------


@query("""SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/?#]+)', 2) AS host FROM pages WHERE regexp_matches(url, '^(https?)://([^/?#]+)')""")
def fromre(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("value"))
    return L.parse_re(pages, r"^(https?)://([^/?#]+)", ["scheme", "host"])


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part")
def fromsplit(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("value"))
    return L.parse_split(part, " ", ["a", "b"], strict=True, width=2)


@query("SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def fromkv(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    blocks = nation.select("n_nationkey", F.format_string("name=%s\nregion=%d\nodd", "n_name", "n_regionkey").alias("value"))
    return L.fields_of_map(L.parse_kv(blocks, "=", "\n"), "record", ["name", "region"])


@query("SELECT event_id, event_type AS type, CAST(user_id AS VARCHAR) AS user FROM events")
def fromkv_events(spark, sf_dir):
    """The last of two entries of one key counts."""
    blocks = table(spark, sf_dir, "events").select("event_id", F.format_string("type=old\nuser=%d\ntype=%s\nodd\na=b=c", "user_id", "event_type").alias("value"))
    return L.fields_of_map(L.parse_kv(blocks, "=", "\n"), "record", ["type", "user"])


@query("""SELECT event_id, 'h' || user_id AS rhost, event_type AS path, CAST(user_id % 500 AS VARCHAR) AS status FROM events""")
def fromapache(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    made = F.format_string('h%d - - [10/Oct/2000:13:55:36 -0700] "GET %s HTTP/1.0" %03d 23 "-" "agent"', "user_id", "event_type", F.col("user_id") % 500)
    out = L.parse_apache(events.select("event_id", made.alias("value")))
    return out.select("event_id", "rhost", "path", F.col("status").cast("int").cast("string").alias("status"))


@query("""SELECT event_id, 'h' || user_id AS rhost, '/' || event_type || '\\' AS path, CASE WHEN event_id % 3 = 0 THEN 'a"b' WHEN event_id % 3 = 1 THEN '-' END AS agent,
CASE WHEN event_id % 3 = 2 THEN 'v' || user_id END AS vhost FROM events""")
def fromapache_trailing(spark, sf_dir):
    """Lines with text behind the last field, escaped quotes and a host in front."""
    events = table(spark, sf_dir, "events")
    head = F.format_string('h%d - - [10/Oct/2000:13:55:36 -0700] "GET /%s\\ HTTP/1.0" 200 23', "user_id", "event_type")
    line = (
        F.when(F.col("event_id") % 3 == 0, F.concat(head, F.lit(' "-" "a\\"b" extra 17')))
        .when(F.col("event_id") % 3 == 1, F.concat(head, F.lit(' "-" "-" 17')))
        .otherwise(F.concat(F.format_string("v%d ", "user_id"), head, F.lit(" 5 more")))
    )
    out = L.parse_apache(events.select("event_id", line.alias("value")), ["combined", "common", "vhost"])
    return out.select("event_id", "rhost", "path", F.replace("agent", F.lit('\\"'), F.lit('"')).alias("agent"), "vhost")


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS file_size, event_type || ' x' AS filename, ['a', 'b', 'm'][event_id % 3 + 1] AS transfer_type,
['o', 'i', 'd', 'a', 'S', 'm'][event_id % 6 + 1] AS direction, ['C', 'X', '_', 'CU'][event_id % 4 + 1] AS special_action_flag FROM events""")
def fromxferlog(spark, sf_dir):
    pick = lambda *c: F.get(F.array(*map(F.lit, c)), (F.col("event_id") % len(c)).cast("int"))
    line = F.concat_ws(
        " ", F.lit("Mon Oct  1 17:09:23 2001 0 host"), F.col("user_id").cast("string"), "event_type", F.lit("x"), pick("a", "b", "m"),
        pick("C", "X", "_", "CU"), pick("o", "i", "d", "a", "S", "m"), F.lit("w tmp ftp 0 * c"),
    )
    out = L.parse_xferlog(table(spark, sf_dir, "events").select("event_id", line.alias("value")))
    return out.select("event_id", "file_size", "filename", "transfer_type", "direction", "special_action_flag")


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'even' END AS even, CASE WHEN user_id % 2 = 1 THEN 'odd' END AS odd,
CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS kind FROM events""")
def fromre_optional(spark, sf_dir):
    """A group that takes no part is null, one that matches nothing is empty."""
    kind = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type"))
    line = F.concat(F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"), F.lit("="), kind, F.lit(";"))
    return L.parse_re(table(spark, sf_dir, "events").select("event_id", line.alias("value")), "^(?:(even)|(odd))=([^;]*)", ["even", "odd", "kind"])


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS region, string_agg(n_name, ' ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1""")
def frommultire(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    grouped = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    lines = grouped.select("n_regionkey", F.posexplode(F.concat(
        F.array(F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))),
        F.array(F.concat(F.lit("names "), F.array_join(F.transform("l", lambda e: e["n_name"]), " "))),
    )).alias("line", "value"))
    patterns = [(r"^region (\d+)", ["region"], "pre"), (r"^names (.*)", ["names"], "post")]
    return L.parse_multi_re(lines, patterns, ["line"], by=["n_regionkey"]).select("region", "names")


@query("""SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, CASE WHEN value > 50 THEN CAST(user_id AS VARCHAR) END AS user,
CAST(max(CASE WHEN event_id % 100 = 0 THEN event_id END) OVER (ORDER BY event_id) AS VARCHAR) AS block FROM events""")
def frommultire_stream(spark, sf_dir):
    """All events as one stream of lines, up to four a record; the block's line stays for the records behind it."""
    events = table(spark, sf_dir, "events")
    texts = F.array(
        F.when(F.col("event_id") % 100 == 0, F.format_string("block %d", "event_id")), F.format_string("id %d", "event_id"),
        F.format_string("kind %s", "event_type"), F.when(F.col("value") > 50, F.format_string("user %d", "user_id")),
    )
    lines = events.select("event_id", F.posexplode(F.array_compact(texts)).alias("line", "value"))
    patterns = [(r"^block (\d+)", ["block"], "pre"), (r"^id (\d+)", ["id"], "pre"), (r"^kind (.*)", ["kind"], ""), (r"^user (\d+)", ["user"], "")]
    out = L.parse_multi_re(lines, patterns, ["event_id", "line"], by=[], keep=["block"])
    return out.select("id", "kind", "user", "block")


@query("""SELECT CAST(r_regionkey AS VARCHAR) || ',' || r_name AS value FROM region""")
def tocsv(spark, sf_dir):
    return writers.csv_lines(table(spark, sf_dir, "region"), ["r_regionkey", "r_name"])


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS value FROM region""")
def tojsonlines(spark, sf_dir):
    return writers.json_lines(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query("""SELECT c_custkey, c_name || chr(10) || '"' || c_mktsegment || '", "' AS note, c_acctbal FROM customer""")
def fromcsv(spark, sf_dir):
    """Quoted line breaks, delimiters and quotes, written and read back with types."""
    customer = table(spark, sf_dir, "customer")
    note = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", "'))
    path = fresh_path(spark, "csv")
    writers.write_csv(customer.select("c_custkey", note.alias("note"), "c_acctbal"), path, ["c_custkey", "note", "c_acctbal"])
    out = L.read_csv(spark, path, header=True, infer=True)
    return out.withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query("""SELECT o_orderkey, o_orderstatus || '}{"' AS mark, o_totalprice, o_custkey AS first_key, o_orderkey AS second_key FROM orders""")
def tojsonarray(spark, sf_dir):
    """One array over several files, read back."""
    orders = table(spark, sf_dir, "orders")
    path = fresh_path(spark, "json-array")
    mark = F.concat("o_orderstatus", F.lit('}{"')).alias("mark")
    writers.write_json_array(orders.select("o_orderkey", mark, "o_totalprice", F.array("o_custkey", "o_orderkey").alias("keys")).repartition(5), path)
    out = L.read_json_array(spark, path)
    return out.select("o_orderkey", "mark", "o_totalprice", F.get("keys", 0).alias("first_key"), F.get("keys", 1).alias("second_key"))


@query("""SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def fromjsonarray(spark, sf_dir):
    """Nested objects of one array with line breaks inside."""
    events = table(spark, sf_dir, "events")
    path = fresh_path(spark, "json-objects")
    shown = F.to_json(F.struct("event_id", "event_type", F.from_json("props", "k bigint").alias("props")), {"pretty": "true"})
    events.select(F.concat(shown, F.lit(",")).alias("value")).write.text(path)
    return L.read_json_array(spark, path, schema="event_id bigint, event_type string, props struct<k: bigint>").select("event_id", "event_type", "props.k")


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n, min(value) OVER () AS a, max(value) OVER () AS z FROM events),
d AS (SELECT i, CAST(floor(i / (n - 1) * 139 + 0.5) AS INTEGER) AS x, CAST(floor((value - a) / (z - a) * 63 + 0.5) AS INTEGER) AS y FROM n)
SELECT x, arg_min(y, i) AS first, arg_max(y, i) AS last, min(y) AS low, max(y) AS high FROM d GROUP BY 1""")
def tochart_line(spark, sf_dir):
    """The dot columns of a line through all events."""
    return raster.line_columns(table(spark, sf_dir, "events"), EVENTS, ["value"], 140, 64)[0].drop("series")


@query("""WITH n AS (SELECT *, min(l_quantity) OVER () AS a, max(l_quantity) OVER () AS b, min(l_extendedprice) OVER () AS c, max(l_extendedprice) OVER () AS d FROM lineitem)
SELECT CAST(floor((l_quantity - a) / (b - a) * 139 + 0.5) AS INTEGER) AS x, CAST(floor((l_extendedprice - c) / (d - c) * 63 + 0.5) AS INTEGER) AS y,
count(*) AS n FROM n GROUP BY 1, 2""")
def tochart_scatter(spark, sf_dir):
    """The dots of a scatter of all line items."""
    return raster.scatter_dots(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_extendedprice"], 140, 64)[0]


@query("""SELECT o_orderkey || ',' || o_orderstatus || ',' || chr(34) || o_orderpriority || ',' || chr(34) || chr(34) || 'x' || chr(34) AS value FROM orders""")
def tocsv_orders(spark, sf_dir):
    """Values with delimiters and quotes."""
    orders = table(spark, sf_dir, "orders").withColumn("note", F.concat("o_orderpriority", F.lit(',"x')))
    return writers.csv_lines(orders, ["o_orderkey", "o_orderstatus", "note"])


@query("""SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","note":null,"at":{"user_id":' || user_id || '}}' AS value FROM events""")
def tojsonlines_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return writers.json_lines(events.select("event_id", "event_type", F.lit(None).cast("string").alias("note"), F.struct("user_id").alias("at")))


@query("SELECT CAST(l_quantity AS BIGINT)::VARCHAR AS q, count(*) AS n FROM lineitem GROUP BY 1")
def number_text(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return C.collate(rows, [("q", text(F.floor("l_quantity").cast("double"), rows.schema["l_quantity"].dataType))], ["n=count"])


# --- events -------------------------------------------------------------------------------------


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_batch(spark, sf_dir):
    made = {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)}
    return E.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], made, "1 day").drop("end")


@query("""WITH g AS (SELECT *, (ts - lag(ts) OVER w >= INTERVAL '30 minutes')::INT AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(coalesce(n, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions_batch(spark, sf_dir):
    out = E.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], {"n": F.count(F.lit(1))}, "1 day")
    return out.select("user_id", "start", "n")


# --- fluent form and field profile ------------------------------------------------------------------


@query("""SELECT 'c_mktsegment' AS field, count(*) AS records, count(c_mktsegment) / count(*) AS filled, min(c_mktsegment) AS example FROM customer
UNION ALL SELECT 'c_name', count(*), count(c_name) / count(*), min(c_name) FROM customer""")
def profile_fields(spark, sf_dir):
    return profile(table(spark, sf_dir, "customer").select("c_mktsegment", "c_name")).select("field", "records", "filled", "example")


@query("""SELECT event_type, count(*) AS count, round(sum(value), 4) AS total, arg_min(event_id, (-value, event_id)) AS top_id
FROM events WHERE value < 90 GROUP BY 1""")
def fluent_chain(spark, sf_dir):
    flow = Flow(table(spark, sf_dir, "events"), ("event_id",)).grep("{{value}} < 90").sort("value=-n")
    out = flow.collate(["event_type"], ["count", "total=sum,value", "top_id=first,event_id"])
    return rounded(out.df, "total")


FLAGSHIP = flagship
