"""Alerts and explanations that are stored more than once."""

from datetime import datetime

from tidemark.operators import evidence


def test_an_explanation_stored_twice_lists_its_alert_once(spark):
    day = datetime(2024, 1, 2)
    companies = spark.createDataFrame([(1, "A", "a")], "id long, ticker string, name string")
    alerts = spark.createDataFrame([(3, 1, day), (4, 1, day), (4, 1, day)], "id long, company_id long, triggered_at timestamp")
    alerts = alerts.selectExpr("*", "'z' AS alert_type", "'high' AS severity", "'' AS explanation", "false AS resolved")
    news = spark.createDataFrame([(7, "h", "s", day, 0.5)], "id long, headline string, source string, published_at timestamp, sentiment_score double")
    links = spark.createDataFrame([(7, 1)], "article_id long, company_id long")
    told = spark.createDataFrame([(3, "generated", "x", [7]), (3, "generated", "y", [7]), (3, "generated", "y", [7])], "alert_id long, status string, narrative string, cited_ids array<long>")
    (row,) = evidence.risk_detail(companies, alerts, news, links, told, "a").collect()
    assert [(a.alert_id, a.explanation and a.explanation.narrative) for a in row.alerts] == [(3, "y"), (4, None), (4, None)]
