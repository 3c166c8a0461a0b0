"""Ledger analytics: loans, holdings, interest, conversion, dilution, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.ranking import numbered
from foliant.plans.registry import query
from foliant.tables import table

RUN_DATE = "2001-01-01"


def day_fraction(start: Column, end: Column, basis: str) -> Column:
    """Year fraction between two dates: act/365, act/360, 30/360 (no February rule) or act/act."""
    days = F.datediff(end, start)
    if basis == "act/365":
        return days / 365.0
    if basis == "act/360":
        return days / 360.0
    if basis == "30/360":
        d1, d2 = F.least(F.dayofmonth(start), F.lit(30)), F.dayofmonth(end)
        d2 = F.when((d2 == 31) & (d1 == 30), 30).otherwise(d2)
        return (360 * (F.year(end) - F.year(start)) + 30 * (F.month(end) - F.month(start)) + d2 - d1) / 360.0
    length = lambda y: F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 366.0).otherwise(365.0)
    first, last = F.year(start), F.year(end)
    head = F.datediff(F.make_date(first + 1, F.lit(1), F.lit(1)), start) / length(first)
    tail = F.datediff(end, F.make_date(last, F.lit(1), F.lit(1))) / length(last)
    return F.when(first == last, days / length(first)).otherwise(head + tail + (last - first - 1))


_LEN = "CASE WHEN year({d}) % 4 = 0 AND (year({d}) % 100 <> 0 OR year({d}) % 400 = 0) THEN 366.0::DOUBLE ELSE 365.0::DOUBLE END"


@query(f"""WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS a, DATE '{RUN_DATE}' AS b FROM orders WHERE o_orderdate::DATE < DATE '{RUN_DATE}')
SELECT o_orderkey, round((b - a) / 365.0::DOUBLE, 8) AS act365, round((b - a) / 360.0::DOUBLE, 8) AS act360,
  round((360 * (year(b) - year(a)) + 30 * (month(b) - month(a)) + (CASE WHEN day(b) = 31 AND least(day(a), 30) = 30 THEN 30 ELSE day(b) END) - least(day(a), 30)) / 360.0::DOUBLE, 8) AS d30360,
  round(CASE WHEN year(a) = year(b) THEN (b - a) / {_LEN.format(d="a")} ELSE (make_date(year(a) + 1, 1, 1) - a) / {_LEN.format(d="a")} + (b - make_date(year(b), 1, 1)) / {_LEN.format(d="b")} + (year(b) - year(a) - 1) END, 8) AS actact FROM d""")
def year_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year fractions by four day-count rules."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.to_date(F.lit(RUN_DATE)).alias("b")).where("a < b")
    names = {"act365": "act/365", "act360": "act/360", "d30360": "30/360", "actact": "act/act"}
    return d.select("o_orderkey", *[F.round(day_fraction(F.col("a"), F.col("b"), b), 8).alias(n) for n, b in names.items()])


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_extendedprice END AS own FROM lineitem),
t AS (SELECT *, o_totalprice AS total, count(*) OVER w AS n, count(own) OVER w AS stated, coalesce(sum(own) OVER w, 0) AS paid FROM l JOIN orders ON o_orderkey = l_orderkey WINDOW w AS (PARTITION BY l_orderkey))
SELECT l_orderkey, l_linenumber, round(CASE WHEN n = 1 THEN total WHEN stated = 0 THEN total / n WHEN own IS NOT NULL THEN own ELSE greatest(total - paid, 0) / (n - stated) END, 6) AS amount FROM t""")
def apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A single lender has the total; without amounts equal parts; the missing share what is left."""
    own = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", own.alias("own"))
    l = l.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("total")), "l_orderkey")
    w = Window.partitionBy("l_orderkey")
    n, stated, paid = F.count("*").over(w), F.count("own").over(w), F.coalesce(F.sum("own").over(w), F.lit(0.0))
    amount = F.when(n == 1, F.col("total")).when(stated == 0, F.col("total") / n).when(F.col("own").isNotNull(), F.col("own")).otherwise(F.greatest(F.col("total") - paid, F.lit(0.0)) / (n - stated))
    return l.select("l_orderkey", "l_linenumber", F.round(amount, 6).alias("amount"))


@query("""SELECT o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status, year(o_orderdate)::INT AS year,
  count(*)::BIGINT AS loans, count(DISTINCT o_custkey)::BIGINT AS lenders, count(DISTINCT o_custkey) > 10 AS over_10, count(DISTINCT o_custkey) > 20 AS over_20, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL""")
def loan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans of identical terms (null equals null), their lenders, and the 10/20 rule (strictly more)."""
    o = table(spark, sf_dir, "orders").withColumns({"status": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), "year": F.year("o_orderdate")})
    lenders = F.countDistinct("o_custkey")
    return o.groupBy("o_orderpriority", "status", "year").agg(F.count("*").alias("loans"), lenders.alias("lenders"), (lenders > 10).alias("over_10"), (lenders > 20).alias("over_20"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT max(n)::BIGINT AS most, max(n) > 10 AS over_10, max(n) > 20 AS over_20 FROM (SELECT count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus, date_trunc('month', o_orderdate))")
def ten_twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus", F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("m")).agg(F.countDistinct("o_custkey").alias("n"))
    return g.agg(F.max("n").alias("most"), (F.max("n") > 10).alias("over_10"), (F.max("n") > 20).alias("over_20"))


@query("""WITH l AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE upper(trim(substr(n_name, 1, 3))) END AS currency, r_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT r_name, round(sum(o_totalprice), 2) AS total, count(DISTINCT currency)::BIGINT AS currencies, CASE WHEN count(DISTINCT currency) <= 1 THEN round(sum(o_totalprice), 2) END AS consolidated FROM l GROUP BY r_name""")
def outstanding_by_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals; consolidated only where at most one currency is stated."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    l = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    currency = F.when(F.col("n_nationkey") % 5 != 0, F.upper(F.trim(F.substring("n_name", 1, 3))))
    total = F.round(F.sum("o_totalprice"), 2)
    return l.groupBy("r_name").agg(total.alias("total"), F.countDistinct(currency).alias("currencies"), F.when(F.countDistinct(currency) <= 1, total).alias("consolidated"))


@query("SELECT o_custkey, count(*)::BIGINT AS loans, round(sum(o_totalprice), 2) AS total, row_number() OVER (ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey) AS position FROM orders GROUP BY o_custkey")
def lender_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lender's loans and total, and its position by total."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("loans"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return numbered(g, -F.col("total"), "o_custkey")


def compound(principal: Column, rate: float, start: Column, end: Column) -> Column:
    """Balance with interest added at each anniversary; once 29 February is clipped to 28 it stays there."""
    state = F.struct(principal.alias("b"), start.alias("d"))
    years = F.year(end) - F.year(start)
    step = lambda s, _: F.when(F.add_months(s["d"], 12) <= end, F.struct((s["b"] * (1 + rate)).alias("b"), F.add_months(s["d"], 12).alias("d"))).otherwise(s)
    last = F.aggregate(F.when(years > 0, F.sequence(F.lit(1), years)).otherwise(F.array().cast("array<int>")), state, step)
    return last["b"] * (1 + rate * F.datediff(end, last["d"]) / 365.0)


@query(f"""WITH RECURSIVE w AS (
  SELECT o_orderkey, o_totalprice AS b, o_orderdate::DATE AS d, DATE '{RUN_DATE}' AS e, o_totalprice AS p, o_orderdate::DATE AS s FROM orders WHERE o_orderdate::DATE < DATE '{RUN_DATE}'
  UNION ALL SELECT o_orderkey, b * 1.05::DOUBLE, (d + INTERVAL 1 YEAR)::DATE, e, p, s FROM w WHERE (d + INTERVAL 1 YEAR)::DATE <= e),
last AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY d DESC) = 1)
SELECT o_orderkey, round(p * (1 + 0.05::DOUBLE * (e - s) / 365.0::DOUBLE), 6) AS simple, round(b * (1 + 0.05::DOUBLE * (e - d) / 365.0::DOUBLE), 6) AS compound FROM last""")
def accrued_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan balances at a date, with simple and with annually compounded interest of 5 %."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"), F.to_date("o_orderdate").alias("s"), F.to_date(F.lit(RUN_DATE)).alias("e")).where("s < e")
    simple = F.col("p") * (1 + 0.05 * F.datediff("e", "s") / 365.0)
    return o.select("o_orderkey", F.round(simple, 6).alias("simple"), F.round(compound(F.col("p"), 0.05, F.col("s"), F.col("e")), 6).alias("compound"))


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, p_retailprice AS round_price, l_discount, l_extendedprice / l_quantity AS cap, p_retailprice * 0.5::DOUBLE AS floor, 0.9::DOUBLE * p_retailprice AS nominal FROM lineitem JOIN part ON p_partkey = l_partkey),
p AS (SELECT *, round_price * (1 - abs(l_discount)) AS by_discount FROM i), q AS (SELECT *, least(by_discount, cap) AS low FROM p)
SELECT l_orderkey, l_linenumber, round(greatest(low, floor), 8) AS price, CASE WHEN low < floor THEN 'floor' WHEN cap <= by_discount THEN 'cap' ELSE 'discount' END AS binding, greatest(low, floor) < nominal AS below_nominal FROM q""")
def conversion_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower of discount and cap price (a tie is the cap's), not below the floor; warning below nominal."""
    i = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    i = i.withColumns({"by_discount": F.col("p_retailprice") * (1 - F.abs("l_discount")), "cap": F.col("l_extendedprice") / F.col("l_quantity"), "floor": F.col("p_retailprice") * 0.5})
    i = i.withColumn("low", F.least("by_discount", "cap"))
    price = F.greatest("low", "floor")
    binding = F.when(F.col("low") < F.col("floor"), "floor").when(F.col("cap") <= F.col("by_discount"), "cap").otherwise("discount")
    return i.select("l_orderkey", "l_linenumber", F.round(price, 8).alias("price"), binding.alias("binding"), (price < 0.9 * F.col("p_retailprice")).alias("below_nominal"))


@query("""WITH n AS (SELECT o_orderkey, o_totalprice AS balance, 1000000.0::DOUBLE AS shares, 8000000.0::DOUBLE AS pre, 2000000.0::DOUBLE AS inv FROM orders),
m AS (SELECT n.*, method, CASE method WHEN 'pre_money' THEN pre / shares WHEN 'percent_ownership' THEN (pre - balance) / shares ELSE pre / (shares + balance / (pre / shares)) END AS price FROM n, (VALUES ('pre_money'), ('percent_ownership'), ('dollars_invested')) v(method)),
c AS (SELECT *, balance / (price * 0.8::DOUBLE) AS note_shares, inv / price AS new_shares FROM m)
SELECT o_orderkey, method, round(price, 4) AS price, round(100 * note_shares / (shares + note_shares + new_shares), 4) AS ownership FROM c""")
def round_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced-round conversion of each note by three methods: price and the note's ownership."""
    shares, pre, invested = 1_000_000.0, 8_000_000.0, 2_000_000.0
    n = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("balance"), F.explode(F.array(*[F.lit(m) for m in ("pre_money", "percent_ownership", "dollars_invested")])).alias("method"))
    price = F.when(F.col("method") == "pre_money", pre / shares).when(F.col("method") == "percent_ownership", (pre - F.col("balance")) / shares).otherwise(pre / (shares + F.col("balance") / (pre / shares)))
    n = n.withColumn("price", price).withColumn("note", F.col("balance") / (F.col("price") * 0.8))
    return n.select("o_orderkey", "method", F.round("price", 4).alias("price"), F.round(100 * F.col("note") / (shares + F.col("note") + invested / F.col("price")), 4).alias("ownership"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS total FROM orders)
SELECT o_orderkey, round(0.01::DOUBLE * (greatest(total - 1000000, 0) - greatest(total - o_totalprice - 1000000, 0)), 6) AS duty FROM r""")
def stamp_duty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One percent of what goes beyond a million over a customer's lifetime."""
    o = table(spark, sf_dir, "orders")
    total = F.sum("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    over = lambda x: F.greatest(x - 1_000_000, F.lit(0.0))
    return o.withColumn("total", total).select("o_orderkey", F.round(0.01 * (over(F.col("total")) - over(F.col("total") - F.col("o_totalprice"))), 6).alias("duty"))


@query("""WITH h AS (SELECT l_returnflag AS class, sum(l_quantity) AS extracted, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE l_quantity * 1.002::DOUBLE END) AS stated FROM lineitem GROUP BY 1)
SELECT class, round(extracted, 2) AS extracted, round(stated, 2) AS stated, CASE WHEN abs(extracted - stated) / stated <= 0.005 THEN 'ok' ELSE 'differs' END AS status FROM h""")
def issued_vs_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings by class against stated totals; half a percent may be off."""
    stated = F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(F.col("l_quantity") * 1.002)
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("class")).agg(F.sum("l_quantity").alias("extracted"), F.sum(stated).alias("stated"))
    return h.select("class", F.round("extracted", 2).alias("extracted"), F.round("stated", 2).alias("stated"), F.when(F.abs(F.col("extracted") - F.col("stated")) / F.col("stated") <= 0.005, "ok").otherwise("differs").alias("status"))


@query("""WITH h AS (SELECT l_suppkey AS holder, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS held, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS diluted FROM lineitem GROUP BY 1),
f AS (SELECT holder, coalesce(diluted, held, 0) AS fd FROM h)
SELECT holder, round(fd, 2) AS fully_diluted, round(100 * fd / sum(fd) OVER (), 6) AS percent FROM f WHERE fd <> 0""")
def fully_diluted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fully diluted shares by holder: the diluted count, else the holdings; zero is dropped."""
    held, diluted = F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")))
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("holder")).agg(F.coalesce(diluted, held, F.lit(0.0)).alias("fd")).where("fd <> 0")
    total = f.agg(F.sum("fd").alias("total"))
    return f.join(F.broadcast(total)).select("holder", F.round("fd", 2).alias("fully_diluted"), F.round(100 * F.col("fd") / F.col("total"), 6).alias("percent"))  # one row


@query("""WITH y AS (SELECT o_custkey, year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)
SELECT a.o_custkey, a.year, b.total AS prev, a.total AS curr FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND a.year = b.year + 1 WHERE a.total < b.total""")
def snapshot_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holders whose total shrank from one yearly snapshot to the next."""
    y = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("curr"))
    w = Window.partitionBy("o_custkey").orderBy("year")
    y = y.withColumn("prev", F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("curr").over(w)))
    return y.where("curr < prev").select("o_custkey", "year", "prev", "curr")


@query("""WITH v AS (SELECT DISTINCT year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders WHERE o_totalprice >= 0.99 * (SELECT max(o_totalprice) FROM orders)),
d AS (SELECT o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders),
c AS (SELECT o_orderkey, d.m, b.m AS before, a.m AS after FROM d ASOF LEFT JOIN v b ON d.m >= b.m ASOF LEFT JOIN v a ON d.m <= a.m),
n AS (SELECT o_orderkey, m, CASE WHEN after IS NULL OR m - before <= after - m THEN before ELSE after END AS near FROM c)
SELECT o_orderkey, make_date((near - 1) // 12, (near - 1) % 12 + 1, 1) AS nearest, abs(m - near)::INT AS gap FROM n""")
def nearest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join of all orders to the nearest version on either side, by month, the earlier one on a tie.

    Versions are the months of orders within a hundredth of the largest. Both sides meet in one
    sorted stream by month: the last version before and the first after are the only candidates, so
    no pairs are formed; the stream has a row for each month.
    """
    o = table(spark, sf_dir, "orders")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    largest = o.agg((0.99 * F.max("o_totalprice")).alias("least"))
    v = o.join(F.broadcast(largest)).where(F.col("o_totalprice") >= F.col("least")).select(month.alias("m")).distinct().withColumn("vm", F.col("m"))  # one row
    months = o.select(month.alias("m")).distinct().join(v, "m", "left")
    before = F.last("vm", True).over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("vm", True).over(Window.orderBy("m").rowsBetween(0, Window.unboundedFollowing))
    near = months.select("m", before.alias("b"), after.alias("a")).withColumn("n", F.when(F.col("a").isNull() | (F.col("m") - F.col("b") <= F.col("a") - F.col("m")), F.col("b")).otherwise(F.col("a")))
    near = near.select("m", F.make_date(F.floor((F.col("n") - 1) / 12).cast("int"), ((F.col("n") - 1) % 12 + 1).cast("int"), F.lit(1)).alias("nearest"), F.abs(F.col("m") - F.col("n")).alias("gap"))
    return o.select("o_orderkey", month.alias("m")).join(near, "m").select("o_orderkey", "nearest", "gap")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders)
SELECT o_custkey, min(o_orderkey) AS o_orderkey, count(*) > 1 AS ambiguous FROM r WHERE r = 1 GROUP BY o_custkey""")
def latest_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest application; a tie is reported as ambiguous."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("o_orderkey"), (F.count("*") > 1).alias("ambiguous"))
    return g.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "ambiguous")).alias("l")).select("o_custkey", "l.o_orderkey", "l.ambiguous")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' WHEN (o_orderdate + INTERVAL 24 MONTH)::DATE + 30 < DATE '{RUN_DATE}' THEN 'expired' ELSE 'running' END AS status FROM orders""")
def maturity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired once 30 days have passed since maturity; unknown without a maturity."""
    due = F.date_add(F.add_months(F.to_date("o_orderdate"), 24), 30)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "unknown").when(due < F.to_date(F.lit(RUN_DATE)), "expired").otherwise("running").alias("status"))


@query("""WITH f AS (SELECT r_name AS currency, CASE r_name WHEN 'EUROPE' THEN 0.95::DOUBLE WHEN 'ASIA' THEN 0.0065::DOUBLE WHEN 'AMERICA' THEN 0.9::DOUBLE END AS rate, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT currency, round(sum(o_totalprice * rate), 2) AS converted, count(*) FILTER (rate IS NULL)::BIGINT AS set_aside FROM f GROUP BY currency""")
def fx_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in the reporting currency; those without a rate are set aside."""
    rates = spark.createDataFrame([("EUROPE", 0.95), ("ASIA", 0.0065), ("AMERICA", 0.9)], "currency string, rate double")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("currency"))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = o.join(F.broadcast(rates), "currency", "left")  # the rates given
    return o.groupBy("currency").agg(F.round(F.sum(F.col("o_totalprice") * F.col("rate")), 2).alias("converted"), F.count_if(F.col("rate").isNull()).alias("set_aside"))
