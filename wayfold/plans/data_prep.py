"""Queries of the general data-preparation operators (problems 3 and 6)."""

from __future__ import annotations

from wayfold.operators.features import feature_rows, feature_table
from wayfold.operators.multivalue import split_values
from wayfold.runtime import load


def p3_found(spark, d):
    """Problem 3: every value of the tag fields in a row of its own."""
    return split_values(load(spark, d, "articles"), "article_id", ["tags", "type_tags"])


def p6_found(spark, d):
    """Problem 6: count and recency of each user's event types."""
    return feature_rows(load(spark, d, "user_rec_history"), load(spark, d, "rec_event_types")).select("user_id", "event_type", "n_events", "days_since_last")


def p6_features(spark, d):
    """Problem 6: the wide table, one row per user."""
    return feature_table(load(spark, d, "user_rec_history"), load(spark, d, "rec_event_types"))


QUERIES = {f.__name__: f for f in (p3_found, p6_found, p6_features)}

SQL = {
    "p6_found": """
      WITH e AS (SELECT DISTINCT trim(user_id, chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288)) AS user_id, article_id, ts, clicked, preference FROM user_rec_history)
      SELECT user_id, event_type, count(*) AS n_events,
             ((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(max(ts))) // 86400000000)::BIGINT AS days_since_last
      FROM e JOIN rec_event_types t ON t.clicked = e.clicked AND t.pref_tenths = round(e.preference::DOUBLE * 10)
      WHERE user_id <> '' GROUP BY 1, 2""",
    "p6_features": """
      WITH h AS (SELECT trim(user_id, chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288)) AS user_id, article_id, ts, clicked, preference FROM user_rec_history),
      u AS (SELECT DISTINCT user_id FROM h WHERE user_id <> ''),
      s AS (SELECT user_id, event_type, count(*) AS n, max(ts) AS last, sum(preference::DOUBLE) AS total
            FROM (SELECT DISTINCT * FROM h) e JOIN rec_event_types t ON t.clicked = e.clicked AND t.pref_tenths = round(e.preference::DOUBLE * 10) GROUP BY 1, 2)
      SELECT u.user_id, list(coalesce(n, 0) ORDER BY t.event_type) AS n_events,
             list(((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(last)) // 86400000000)::BIGINT ORDER BY t.event_type) AS days_since_last,
             list(coalesce(total, 0) ORDER BY t.event_type) AS totals
      FROM u CROSS JOIN rec_event_types t LEFT JOIN s ON s.user_id = u.user_id AND s.event_type = t.event_type GROUP BY 1""",
}
