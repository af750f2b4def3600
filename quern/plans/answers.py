"""Queries on models' answers: each user is a request, their events its items, told in JSON of many shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import answers as A

from .book import query

_JSON = """e AS (SELECT user_id, event_id, event_id % 8 AS m FROM events),
  j AS (SELECT user_id, event_id, CASE m WHEN 0 THEN '{"id": "' || event_id || '"}' WHEN 1 THEN '{"id": ' || event_id || ', "translation": "t"}' WHEN 2 THEN '"just text"' WHEN 3 THEN '{"id": "z' || event_id || '", "translation": "t"}'
      WHEN 4 THEN '{"id": "' || event_id || '", "translation": "first"}, {"translation": "second", "id": " ' || event_id || '"}' WHEN 5 THEN '{"id": "' || event_id || '", "translation": " "}' ELSE '{"id": "' || event_id || '", "translation": "t' || event_id || '", "more": [1, {"a": null}]}' END AS item FROM e),
  a AS (SELECT user_id, list(event_id::VARCHAR) AS expected, CASE user_id % 7 WHEN 0 THEN 'oops [' WHEN 1 THEN '[' || string_agg(item, ', ' ORDER BY event_id) || ']' WHEN 2 THEN '{"other": []}' WHEN 3 THEN '{"translations": {"x": 1}}' ELSE '{"usage": {"total": ' || COUNT(*) || '}, "translations": [' || string_agg(item, ', ' ORDER BY event_id) || ']}' END AS answer FROM j GROUP BY user_id),
  p AS (SELECT *, CASE WHEN NOT json_valid(answer) THEN 'not_json' WHEN json_type(answer) = 'ARRAY' THEN NULL WHEN json_extract(answer, '$.translations') IS NULL THEN 'envelope_missing' WHEN json_type(answer, '$.translations') <> 'ARRAY' THEN 'items_not_array' END AS issue FROM a),
  h AS (SELECT user_id, expected, CASE WHEN json_type(answer) = 'ARRAY' THEN answer::JSON ELSE json_extract(answer, '$.translations') END AS held FROM p WHERE issue IS NULL),
  x AS (SELECT user_id, expected, unnest(json_extract(held, '$[*]')) AS item, CAST(generate_subscripts(json_extract(held, '$[*]'), 1) - 1 AS INT) AS i FROM h),
  y AS (SELECT *, trim(json_extract_string(item, '$.id')) AS id, json_extract_string(item, '$.translation') AS said, CASE WHEN json_type(item) <> 'OBJECT' THEN 'item_not_object' WHEN coalesce(json_type(item, '$.id'), 'NULL') = 'NULL' OR coalesce(json_type(item, '$.translation'), 'NULL') = 'NULL' THEN 'missing_field'
      WHEN json_type(item, '$.id') <> 'VARCHAR' OR json_type(item, '$.translation') <> 'VARCHAR' THEN 'wrong_type' WHEN trim(json_extract_string(item, '$.translation')) = '' THEN 'empty_field' WHEN NOT list_contains(expected, trim(json_extract_string(item, '$.id'))) THEN 'unknown_id' END AS bad FROM x),
  z AS (SELECT *, CASE WHEN bad IS NULL AND row_number() OVER (PARTITION BY user_id, id, bad IS NULL ORDER BY i) > 1 THEN 'duplicate_id' ELSE bad END AS code FROM y)"""


def _answers(t):
    e, m = F.col("event_id").cast("string"), F.col("event_id") % 8
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    item = (
        F.when(m == 0, put('{"id": "', e, '"}')).when(m == 1, put('{"id": ', e, ', "translation": "t"}')).when(m == 2, '"just text"').when(m == 3, put('{"id": "z', e, '", "translation": "t"}'))
        .when(m == 4, put('{"id": "', e, '", "translation": "first"}, {"translation": "second", "id": " ', e, '"}')).when(m == 5, put('{"id": "', e, '", "translation": " "}'))
        .otherwise(put('{"id": "', e, '", "translation": "t', e, '", "more": [1, {"a": null}]}'))
    )
    rows = t("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("item")))).alias("all"))
    listed = F.array_join(F.transform("all", lambda x: x["item"]), ", ")
    u = F.col("user_id") % 7
    answer = F.when(u == 0, "oops [").when(u == 1, put("[", listed, "]")).when(u == 2, '{"other": []}').when(u == 3, '{"translations": {"x": 1}}').otherwise(put('{"usage": {"total": ', F.size("all").cast("string"), '}, "translations": [', listed, "]}"))
    return rows.select(F.col("user_id").alias("request_id"), F.transform("all", lambda x: x["event_id"].cast("string")).alias("expected"), answer.alias("answer"))


@query("answer_items", f"WITH {_JSON} SELECT user_id AS request_id, i AS index, id, said AS translation FROM z WHERE code IS NULL")
def answer_items(t):
    """Items that keep the contract."""
    return A.read_answers(_answers(t), "translation")[0].select("request_id", "index", F.trim(F.col("fields")["id"]).alias("id"), F.col("fields")["translation"].alias("translation"))


@query("answer_issues", f"WITH {_JSON} SELECT user_id AS request_id, i AS index, code FROM z WHERE code IS NOT NULL UNION ALL SELECT user_id, -1, issue FROM p WHERE issue IS NOT NULL")
def answer_issues(t):
    """What was refused, and why."""
    return A.read_answers(_answers(t), "translation")[1].select("request_id", F.coalesce("index", F.lit(-1)).alias("index"), "code")


@query("answer_retry", f"WITH {_JSON} SELECT user_id AS request_id, unnest(expected) AS id FROM a EXCEPT SELECT user_id, id FROM z WHERE code IS NULL")
def answer_retry(t):
    """Ids to ask for again."""
    return A.read_answers(_answers(t), "translation")[2]


@query("answer_fields", f"WITH {_JSON} SELECT user_id AS request_id, CASE WHEN json_valid(answer) THEN json_extract_string(answer, '$.usage.total') END AS total FROM a")
def answer_fields(t):
    """A nested field of each answer."""
    return A.project(_answers(t), {"total": "$.usage.total"}).select("request_id", "total")
