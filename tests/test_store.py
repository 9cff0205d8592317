"""The stored grain: one-pass loads, replaced years, merged partials, plans."""

import datetime



from pyspark.sql import functions as F

from ledgerlight.operators import kpis
from ledgerlight.sources import sales as src
from ledgerlight.sources import store as st

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_loads_add_up_and_years_are_replaced(spark, tmp_path):
    raw, store = src.star_rows(spark, SF), st.SalesStore(spark, str(tmp_path))
    s = src.sales_fact(spark, SF).cache()
    store.load(raw.filter("year(order_date) <= 1997"), 1)
    early = s.filter("year <= 1997")
    assert rows(store.annual()) == rows(kpis.annual(early).select(store.annual().columns))
    counts = store.load(raw.filter("year(order_date) >= 1997"), 2)
    assert counts["years"] == list(range(1997, 2002)) and counts["kept"] == s.filter("year >= 1997").count()
    store.load(raw.filter("year(order_date) = 1999"), 3)  # again: nothing changes
    for name in ("annual", "region_quarter", "top_products"):
        mine = getattr(store, name)()
        assert rows(mine) == rows(getattr(kpis, name)(s).select(mine.columns)), name
    assert store.grain().count() == s.count() and store.rejects().count() == 0
    half = raw.filter("year(order_date) = 1999 and line_number = 1")
    assert store.load(half, 4)["kept"] == half.count()  # the year now holds that load alone
    kept = s.filter("year <> 1999 or line_number = 1")
    assert rows(store.annual()) == rows(kpis.annual(kept).select(store.annual().columns))


def test_partitions_are_pruned_and_the_load_is_one_scan(spark, tmp_path):
    store = st.SalesStore(spark, str(tmp_path))
    store.load(src.star_rows(spark, SF), 1)
    plan = store.grain().filter("year = 1998")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "= 1998)]" in plan


def test_broken_lines(spark, tmp_path):
    lines = [
        "row_id,order_id,order_date,ship_date,ship_mode,customer_id,customer_name,segment,country,city,state,postal_code,region,product_id,category,sub_category,product_name,sales",
        "1,o1,05/01/2017,06/01/2017,m,1,n,s,c,t,st,1,R,1,C,P,name,10.5",
        '2,o1,05/01/2017,06/01/2017,m,1,n,s,c,t,st,1,R,1,C,P,"a, quoted name",2',
        "3,o2,31/02/2017,06/01/2017,m,1,n,s,c,t,st,1,R,1,C,P,name,10.5",
        "4,o3,05/01/2018,06/01/2017,m,1,n,s,c,t,st,1,R,1,C,P,name,abc",
        "5,o4,05/01/2018",
        "6,o5,05/01/2018,06/01/2017,m,2,n,s,c,t,st,1,R,2,C,P,name,-3",
        "7,o6,05/01/2018,06/01/2017,m,2,n,s,c,t,st,1,R,2,C,P,name,4,more,5",
    ]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    store = st.SalesStore(spark, str(tmp_path / "store"))
    counts = store.load(st.read_csv_lines(spark, str(tmp_path / "a.csv")), 7)
    assert counts == {"rows": 7, "malformed": 2, "sales": 1, "date": 1, "kept": 3, "years": [2017, 2018]}
    rejects = {r.line or r.order_id: (r.reason, r.load_id) for r in store.rejects().collect()}
    assert rejects == {lines[5]: ("malformed", 7), lines[7]: ("malformed", 7), "o2": ("date", 7), "o3": ("sales", 7)}
    assert [(r.year, r.sales, r.orders, r.clients) for r in store.annual().orderBy("year").collect()] == [(2017, 12.5, 1, 1), (2018, -3.0, 1, 1)]
    strict = st.SalesStore(spark, str(tmp_path / "strict"))
    assert strict.load(st.read_csv_lines(spark, str(tmp_path / "a.csv")), 1, keep_non_positive=False)["sales"] == 2


def test_nothing_kept(spark, tmp_path):
    raw = src.star_rows(spark, SF).withColumn("sales", F.lit(None).cast("decimal(12,2)")).limit(3)
    store = st.SalesStore(spark, str(tmp_path))
    assert store.load(raw, 1) == {"rows": 3, "malformed": 0, "sales": 3, "date": 0, "kept": 0, "years": []}
    assert store.rejects().count() == 3
    none = st.SalesStore(spark, str(tmp_path / "none"))
    assert none.load(raw.filter("false"), 1)["rows"] == 0


def test_ids_beyond_a_bucket(spark, tmp_path):
    day = datetime.date(2020, 1, 1)
    data = [(i * 40_000 % 1_000_003, day, i % 70_001, "s", "r", "c", "p", i % 5, "n", 1.0) for i in range(3000)]
    raw = spark.createDataFrame(data, "order_id long, order_date date, customer_id long, segment string, region string, category string, sub_category string, product_id long, product_name string, sales double")
    raw = raw.withColumns({"ship_date": F.col("order_date"), "line_number": F.lit(1)})
    store = st.SalesStore(spark, str(tmp_path))
    store.load(raw, 1)
    row = store.annual().first()
    assert (row.orders, row.clients, row.products) == (len({d[0] for d in data}), len({d[2] for d in data}), 5)
