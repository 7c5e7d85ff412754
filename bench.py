"""Time the headline queries and print one JSON line.

Every query runs to completion with all its columns into a sink that drops the rows. Queries on the
defective version read it from the version table, which is written once and timed as ``write_v1``.
"""

import json
import os
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])  # for Python workers

HEADLINE = [
    "write_v1",
    "sales_total_revenue",
    "sales_average_order_value",
    "sales_growth_latest_period",
    "cust_new_vs_returning_monthly",
    "cust_top_customers",
    "cust_revenue_deciles",
    "cust_segment_summary",
    "cust_rfm_table",
    "prod_top_by_revenue",
    "prod_pareto",
    "cat_revenue_quantity_contribution",
    "time_revenue_daily",
    "time_revenue_monthly",
    "time_yoy_growth",
    "geo_revenue_by_country",
    "disc_band_summary",
    "disc_revenue_association",
    "pay_summary",
    "beh_order_value_deciles",
    "beh_basket_summary",
    "loy_inter_purchase_days",
    "loy_cohort_retention",
    "kpi_block",
    "trend_weekly",
    "category_split",
    "product_table",
    "rfm_code_segments",
    "eda_summary",
    "eda_histogram",
    "eda_pearson",
    "eda_spearman",
    "dq_profile",
    "dq_weighted_score",
    "dq_near_duplicates",
    "clean_log",
    "clean_rows",
    "profile_columns",
    "type_table",
    "star_fact_sales",
    "star_measures",
    "claims_report_documents",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from tillview.plans import quality_queries, registry
    from tillview.session import drop_staged, local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", tempfile.mkdtemp(prefix="tillview-bench-"))
    spark.conf.set("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8"))
    queries = registry.all_queries()
    only = sys.argv[1:]
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the executor threads
    times = {}
    for name in HEADLINE if not only else list(queries) if only == ["all"] else only:
        start = time.perf_counter()
        if name == "write_v1":
            quality_queries.raw(spark, folder)
        else:
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if only:
            print(name, times[name], file=sys.stderr, flush=True)
    line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder).removeprefix("sf")}
    print(json.dumps(line))
    drop_staged(spark)
    spark.stop()


if __name__ == "__main__":
    main()
