"""Traffic report over page addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketloom.functions.scalars import exprs, url_host, url_parameter, url_path


def url_report(pages: DataFrame, url: str = "url") -> DataFrame:
    """Pages per host, campaign source and first path segment."""
    parsed = pages.selectExpr(
        f"{url_host(url)} AS host",
        f"{url_parameter(url, 'utm_source')} AS utm_source",
        f"split_part({url_path(url)}, '/', 1) AS section",
    )
    return parsed.groupBy("host", "utm_source", "section").agg(*exprs("count(*) AS pages"))
