"""Queries on events and conversations, with their DuckDB statements. ``events`` stands for logs, traces and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import refusals as R
from fathomline.functions import text as T
from fathomline.operators import answers as A
from fathomline.operators import corpus as C
from fathomline.operators import telemetry as M
from fathomline.sources.tables import read


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def micros(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", "user_id", "event_type", "value", M.seconds().alias("us"))


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.latency_summary(events(spark, d), "event_type", "value")


def tumbling(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "events", "total")


def sliding(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(F.window("ts", "6 hours", "3 hours").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.round(F.max("value"), 4).alias("top")).select(F.unix_micros("w.start").alias("start_us"), "events", "top")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return M.sessions(events(spark, d), "user_id", "ts", 1800).select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "events")


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return C.latest(events(spark, d), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


def latest_turns(spark: SparkSession, d: str) -> DataFrame:
    return C.latest(read(spark, d, "conversations"), ["conv_id"], F.desc("turn")).select("conv_id", "turn", "role")


def retention(spark: SparkSession, d: str) -> DataFrame:
    """The newest hundred events of each user."""
    return C.newest(events(spark, d), ["user_id"], 100, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """Daily sums and their running total by type, with a price for each type."""
    e = events(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("amount"))
    price = F.when(F.col("event_type") == "purchase", 0.5).when(F.col("event_type") == "click", 0.01).otherwise(0.0)
    return e.withColumn("cost", F.round(F.col("n") * price, 6))


def props_extract(spark: SparkSession, d: str) -> DataFrame:
    """Values out of JSON texts, counted by type."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, d).groupBy("event_type", (k % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


def outcome_tallies(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("value") < 1, "unchanged").otherwise("queued")
    return events(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def job_states(spark: SparkSession, d: str) -> DataFrame:
    return M.job_states(events(spark, d), "user_id", "event_id", "event_type")


def late_writes(spark: SparkSession, d: str) -> DataFrame:
    """Events in the order of their value as if they had arrived so: which would come after a later one of their user."""
    e = events(spark, d).withColumn("arrived", F.struct("value", "event_id"))
    return M.in_order(e, "user_id", "event_id", "arrived").select("event_id", "late")


def backoff_due(spark: SparkSession, d: str) -> DataFrame:
    """When each user's source is checked next: errors since the last other event double the wait."""
    e = micros(spark, d).groupBy("user_id").agg(F.max("us").alias("last"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"))
    interval = F.when(F.col("user_id") % 5 != 0, (F.col("user_id") % 4 + 1) * 600.0)
    due = M.refresh_due(F.floor(F.col("last") / 1e6).cast("double"), interval, F.col("errors") % 12)
    return e.select("user_id", due.alias("due"))


def due_queue(spark: SparkSession, d: str) -> DataFrame:
    """The ten earliest due of each interval."""
    q = backoff_due(spark, d).filter("due is not null").withColumn("lane", F.col("user_id") % 4)
    return C.newest(q, ["lane"], 10, F.col("due"), F.col("user_id")).select("lane", "user_id")


def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return M.token_bucket(micros(spark, d), "user_id", "us", 1).select("event_id", F.round("wait", 3).alias("wait"))


def throttled(spark: SparkSession, d: str) -> DataFrame:
    return M.throttled(micros(spark, d), "user_id", "us", 3600).select("event_id", "told")


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return M.cache_hits(micros(spark, d), "user_id", "us", 7200).groupBy("user_id").agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.count(F.lit(1)).alias("lookups"))


def shared_runs(spark: SparkSession, d: str) -> DataFrame:
    """Equal requests (of a user and type) within ten minutes of the one before share its run."""
    e = events(spark, d).withColumn("request", F.concat_ws(":", "user_id", "event_type"))
    return M.sessions(e, "request", "ts", 600).select("request", F.unix_micros("session_start").alias("start_us"), "events")


def admitted(spark: SparkSession, d: str) -> DataFrame:
    return M.admitted(events(spark, d).withColumn("size", F.ceil("value").cast("long")), "user_id", "event_id", "size", 500).select("event_id", "admitted")


def history_tail(spark: SparkSession, d: str) -> DataFrame:
    return A.history_tail(read(spark, d, "conversations"), 4, 100)


def exchanges(spark: SparkSession, d: str) -> DataFrame:
    return A.exchanges(read(spark, d, "conversations")).select("conv_id", "turn", F.char_length("question").cast("long").alias("question_chars"), F.char_length("answer").cast("long").alias("answer_chars"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as answers that cite sources by markers made from their turn."""
    c = read(spark, d, "conversations").filter("role = 'assistant'")
    mark = F.format_string(" [%d, %d-%d] costs %d,%03d.0 [9-2]", F.col("turn") + 1, F.col("turn") % 3 + 1, F.col("turn") % 3 + 3, F.col("turn"), F.col("conv_id") % 1000)
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), "conv_id", "turn", F.when(F.col("turn") % 4 != 1, F.concat("text", mark)).otherwise(F.col("text")).alias("answer"))


def citations_used(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d)
    return a.select("answer_id", F.array_join(T.cited_numbers(F.col("answer"), F.lit(5)).cast("array<string>"), ",").alias("cited"), R.status(F.col("answer"), F.lit(5)).alias("status"))


def cited_sources(spark: SparkSession, d: str) -> DataFrame:
    """Answers' markers against the earlier turns of their conversation as numbered sources."""
    c = read(spark, d, "conversations")
    sources = answers(spark, d).select("answer_id", "conv_id", F.col("turn").alias("t")).join(c.select("conv_id", "turn"), "conv_id").filter("turn < t").select("answer_id", (F.col("turn") + 1).cast("int").alias("source_number"), "turn")
    return A.cited_sources(answers(spark, d), sources).select("answer_id", F.col("source_number").cast("long").alias("source_number"))


def fact_checks(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("answer_id", A.states_fact(F.col("answer"), ["the", "de"], [["costs", "[1"]], ["3"]).alias("states"))


def continuations(spark: SparkSession, d: str) -> DataFrame:
    """Answers cut in two with a repeated tail, joined again."""
    a = answers(spark, d).filter(F.char_length("answer") > 60)
    both = A.joined_continuation(F.expr("left(answer, 50)"), F.expr("substring(answer, 31)"))
    return a.select("answer_id", (both == F.col("answer")).alias("whole"))


def summary_parts(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's turns packed into parts of at most 600 weighted characters."""
    c = read(spark, d, "conversations").select("conv_id", "turn", (T.weighted_length(F.col("text")) + 48).alias("size"))
    return M.packed_parts(c, "conv_id", "turn", "size", 600)


def batch_shares(spark: SparkSession, d: str) -> DataFrame:
    """Twelve parts shared among the conversations of a question, fewer than there are among all of them."""
    n = read(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("need")).withColumn("question", (F.col("conv_id") / 5).cast("long"))
    return M.batch_shares(n, "question", "conv_id", "need", 12)


def claims_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Whole assistant turns in which a marker follows each sentence and so opens the next."""
    c = read(spark, d, "conversations").filter("role = 'assistant'")
    cite = lambda x: F.concat(F.translate(x, "[]", "()"), F.when(x.rlike(r"[.!?。！？]$"), "").otherwise("."), F.lit(" ["), (F.char_length(x) % 7 + 1).cast("string"), F.lit("]"))
    answer = F.array_join(F.transform(T.sentences(F.col("text")), cite), " ")
    return A.claims_by_source(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), answer.alias("answer")))


def backfilled(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts as answers to which the documents that hold them are sources."""
    docs, items = read(spark, d, "documents"), read(spark, d, "benchmark")
    held = C.label_passages(docs, items).join(docs.select("doc_id", "text"), "doc_id").select(F.col("item_id").alias("answer_id"), F.col("doc_id").alias("source_number"), "text")
    return A.backfilled(items.select(F.col("item_id").alias("answer_id"), F.col("text").alias("answer")), held)


US = "epoch_us(ts)"
#: Events numbered by user in order: o (user_id, event_id, us, i).
IN_ORDER = f"o AS (SELECT user_id, event_id, {US} AS us, row_number() OVER (PARTITION BY user_id ORDER BY {US}, event_id) AS i FROM events)"
#: A token bucket's state after its refill: one token a minute, one at most.
HAVE = "least(1.0::DOUBLE, f.have + (o.us / 1e6 - f.last) / 60)"
ANSWERS = """
answers AS (SELECT conv_id * 100 + turn AS answer_id, conv_id, turn, text || CASE WHEN turn % 4 <> 1 THEN format(' [{}, {}-{}] costs {},{:03d}.0 [9-2]', turn + 1, turn % 3 + 1, turn % 3 + 3, turn, conv_id % 1000) ELSE '' END AS answer
  FROM conversations WHERE role = 'assistant')"""
CITED = """
cited AS (SELECT answer_id, conv_id, turn, answer, CASE WHEN turn % 4 <> 1 THEN list_sort(list_distinct(list_concat([turn + 1], range(turn % 3 + 1, turn % 3 + 4)))) ELSE [] END AS marks FROM answers)"""
DUE = """
due AS (SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN last + least((user_id % 4 + 1) * 600.0::DOUBLE * power(2.0, least(errors % 12, 30)), greatest(86400.0::DOUBLE, (user_id % 4 + 1) * 600.0::DOUBLE)) END AS due
  FROM (SELECT user_id, floor(max(epoch_us(ts)) / 1e6) AS last, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id))"""


REQUESTS = "(SELECT *, user_id || ':' || event_type AS request FROM events)"


def sessions_sql(key: str, gap: int, source: str = "events") -> str:
    return f"""f AS (SELECT *, CASE WHEN {US} - lag({US}) OVER w > {gap}000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS session FROM f)"""


QUERIES = {
    f.__name__: f
    for f in (latency_summary, tumbling, sliding, sessions, latest_per_key, latest_turns, retention, usage_totals, props_extract, outcome_tallies, job_states, late_writes, backoff_due, due_queue, token_bucket, throttled, cache_hits, shared_runs, admitted, history_tail, exchanges, citations_used, cited_sources, claims_by_source, backfilled, fact_checks, continuations, summary_parts, batch_shares)
}

ORACLE = {
    "latency_summary": "SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 1) AS mean FROM events GROUP BY 1",
    "tumbling": f"SELECT ({US} // 3600000000) * 3600000000 AS start_us, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding": f"SELECT (({US} // 10800000000) - k) * 10800000000 AS start_us, count(*) AS events, round(max(value), 4) AS top FROM events, range(0, 2) t(k) GROUP BY 1",
    "sessions": f"WITH {sessions_sql('user_id', 1800)} SELECT user_id, min({US}) AS start_us, max({US}) AS end_us, count(*) AS events FROM s GROUP BY user_id, session",
    "latest_per_key": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "latest_turns": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "retention": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 100",
    "usage_totals": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS amount, round(count(*) * CASE event_type WHEN 'purchase' THEN 0.5::DOUBLE WHEN 'click' THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END, 6) AS cost FROM events GROUP BY 1, 2",
    "props_extract": "SELECT event_type, (props->>'$.k')::BIGINT % 10 AS bucket, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2",
    "outcome_tallies": "SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 1 THEN 'unchanged' ELSE 'queued' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2",
    "job_states": "SELECT user_id, arg_max(event_type, event_id) AS state, count(*) AS steps FROM events GROUP BY 1",
    "late_writes": "SELECT event_id, coalesce(max(event_id) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > event_id, false) AS late FROM events",
    "backoff_due": f"WITH {DUE} SELECT user_id, due FROM due",
    "due_queue": f"WITH {DUE} SELECT user_id % 4 AS lane, user_id FROM due WHERE due IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id % 4 ORDER BY due, user_id) <= 10",
    "shared_runs": f"WITH {sessions_sql('request', 600, REQUESTS)} SELECT request, min({US}) AS start_us, count(*) AS events FROM s GROUP BY request, session",
    "admitted": "SELECT event_id, sum(ceil(value)) OVER w <= 500 OR row_number() OVER w = 1 AS admitted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "history_tail": """WITH b AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS b FROM conversations)
SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN left(text, 100) ELSE text END AS text FROM b WHERE turn >= b QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4""",
    "exchanges": """WITH n AS (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, length(text) AS question_chars, length(answer) AS answer_chars FROM n WHERE role = 'user' AND next = 'assistant'""",
    "citations_used": f"""WITH {ANSWERS}, {CITED} SELECT answer_id, array_to_string(list_filter(marks, lambda x: x <= 5 OR x = turn + 1 AND x <= 5), ',') AS cited,
  CASE WHEN len(list_filter(marks, lambda x: x <= 5)) > 0 THEN 'answered' ELSE 'uncited' END AS status FROM cited""",
    "cited_sources": f"""WITH {ANSWERS}, {CITED}, m AS (SELECT answer_id, conv_id, turn, unnest(marks) AS source_number FROM cited)
SELECT answer_id, source_number FROM m WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = m.conv_id AND c.turn < m.turn AND c.turn + 1 = m.source_number)""",
    "claims_by_source": r"""WITH s AS (SELECT conv_id * 100 + turn AS answer_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: regexp_matches(x, '\S')) AS l
FROM conversations WHERE role = 'assistant')
SELECT answer_id, unnest(range(len(l))) AS sentence_no, unnest(list_transform(l, lambda x: length(x) % 7 + 1)) AS source_number FROM s""",
    "batch_shares": """WITH n AS (SELECT conv_id, floor(conv_id / 5)::BIGINT AS question, greatest(count(*), 1) AS need FROM conversations GROUP BY 1),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY question) AS k FROM n WINDOW w AS (PARTITION BY question ORDER BY need, conv_id)),
r AS (WITH RECURSIVE f AS (SELECT question, conv_id, i, k, greatest(1, least(need, 12 // k)) AS share, 12 - greatest(1, least(need, 12 // k)) AS remaining FROM o WHERE i = 1
  UNION ALL SELECT o.question, o.conv_id, o.i, o.k, greatest(1, least(o.need, f.remaining // (o.k - o.i + 1))), f.remaining - greatest(1, least(o.need, f.remaining // (o.k - o.i + 1))) FROM f JOIN o ON o.question = f.question AND o.i = f.i + 1) SELECT * FROM f)
SELECT question, conv_id, share::BIGINT AS share FROM r""",
    "continuations": f"WITH {ANSWERS} SELECT answer_id, true AS whole FROM answers WHERE length(answer) > 60",
    "token_bucket": f"""WITH RECURSIVE {IN_ORDER},
f AS (SELECT user_id, event_id, i, 0.0::DOUBLE AS have, us / 1e6 AS last, 0.0::DOUBLE AS wait FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.event_id, o.i, CASE WHEN {HAVE} >= 1 THEN {HAVE} - 1 ELSE {HAVE} END, o.us / 1e6, CASE WHEN {HAVE} >= 1 THEN 0 ELSE (1 - {HAVE}) * 60 END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT event_id, round(wait, 3) AS wait FROM f""",
    "throttled": f"""WITH RECURSIVE {IN_ORDER},
f AS (SELECT user_id, event_id, i, us AS last, 0::BIGINT AS held, 1::BIGINT AS told FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.event_id, o.i, CASE WHEN o.us - f.last >= 3600000000 THEN o.us ELSE f.last END, CASE WHEN o.us - f.last >= 3600000000 THEN 0 ELSE f.held + 1 END, CASE WHEN o.us - f.last >= 3600000000 THEN f.held + 1 ELSE 0 END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT event_id, told FROM f""",
    "cache_hits": f"""WITH RECURSIVE {IN_ORDER},
f AS (SELECT user_id, i, us AS stored, 0 AS hit FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, CASE WHEN o.us - f.stored <= 7200000000 THEN f.stored ELSE o.us END, (o.us - f.stored <= 7200000000)::INT FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, sum(hit)::BIGINT AS hits, count(*) AS lookups FROM f GROUP BY 1""",
    "summary_parts": f"""WITH RECURSIVE o AS (SELECT conv_id, turn, least(length(text) + 2 * len(regexp_extract_all(text, '{T.CJK}')) + 48, 600) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, turn, i, n AS used, 1::BIGINT AS part FROM o WHERE i = 1
  UNION ALL SELECT o.conv_id, o.turn, o.i, CASE WHEN f.used > 0 AND f.used + o.n > 600 THEN o.n ELSE f.used + o.n END, f.part + (f.used > 0 AND f.used + o.n > 600)::INT FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)
SELECT conv_id, turn, part FROM f""",
    "fact_checks": f"""WITH {ANSWERS} SELECT answer_id, (contains(lower(answer), 'the') OR contains(lower(answer), 'de')) AND (contains(lower(answer), 'costs') OR contains(lower(answer), '[1')) AND NOT regexp_matches(lower(answer), '(^|[^0-9])3([^0-9]|$)') AS states FROM answers""",
}
