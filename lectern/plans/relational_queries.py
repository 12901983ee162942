"""The relational layer over orders, customers, events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import prompts as P
from ..operators import relational as R
from .registry import Tables, query


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer""")
def children_per_parent(t: Tables):
    return R.counts_per_parent(t.customer.select("c_custkey"), "c_custkey", {"n_orders": (t.orders, "o_custkey")})


@query("""SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_lines, (SELECT count(*) FROM events WHERE user_id = s_suppkey) AS n_events, (SELECT count(*) FROM customer WHERE c_custkey = s_suppkey) AS n_customers FROM supplier""")
def multi_counts_per_user(t: Tables):
    kinds = {"n_lines": (t.lineitem, "l_suppkey"), "n_events": (t.events, "user_id"), "n_customers": (t.customer, "c_custkey")}
    return R.counts_per_parent(t.supplier.select("s_suppkey"), "s_suppkey", kinds)


@query("""SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def messages_per_conversation(t: Tables):
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"))


@query("""SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""")
def inner_equi(t: Tables):
    orders = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    return orders.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def scope_semi(t: Tables):
    return R.in_scope(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")).select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def scope_anti(t: Tables):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders""")
def scope_intersection(t: Tables):
    return t.customer.where("c_acctbal > 0").select("c_custkey").intersect(t.orders.select(F.col("o_custkey").alias("c_custkey")))


@query("""SELECT c_custkey, array_to_string(CASE WHEN c_custkey % 3 = 0 THEN [1, 2, 3] ELSE list_filter([c_custkey % 5, 2, 9, 2], lambda x: list_contains([1, 2, 3], x)) END, ',') AS ids FROM customer""")
def clamp_ids(t: Tables):
    allowed = F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])
    asked = F.when(F.col("c_custkey") % 3 != 0, F.array((F.col("c_custkey") % 5).cast("long"), *[F.lit(i).cast("long") for i in (2, 9, 2)]))
    return t.customer.select("c_custkey", F.array_join(R.clamp_ids(asked, allowed).cast("array<string>"), ",").alias("ids"))


@query("""SELECT count(*) AS n FROM orders WHERE false""")
def empty_scope(t: Tables):
    return R.in_scope(t.orders, "o_custkey", t.customer.where("false").select("c_custkey")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1""")
def status_histogram(t: Tables):
    return R.histogram(t.orders, "o_orderstatus")


@query("""SELECT (SELECT count(*) FROM customer) AS n_users, (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM documents WHERE lang = 'en') AS n_en, (SELECT count(*) FROM conversations) AS n_messages""")
def system_stats(t: Tables):
    docs = t.documents.agg(F.count("*").alias("n_docs"), F.count_if(F.col("lang") == "en").alias("n_en"))
    users, messages = t.customer.agg(F.count("*").alias("n_users")), t.conversations.agg(F.count("*").alias("n_messages"))
    return users.crossJoin(docs).crossJoin(messages)


@query("""WITH n AS (SELECT max(ts) AS now FROM events) SELECT count(*) FILTER (WHERE ts > now - INTERVAL 7 DAY) AS last_7d, count(*) FILTER (WHERE ts > now - INTERVAL 30 DAY) AS last_30d FROM events, n""")
def recent_windows(t: Tables):
    now = t.events.agg(F.max("ts").alias("now"))
    return R.recent_counts(t.events.crossJoin(F.broadcast(now)), "ts", F.col("now"), [7, 30])


@query("""SELECT user_id, event_type, first(event_id ORDER BY ts, event_id) AS event_id, first(ts ORDER BY ts, event_id) AS ts, last(value ORDER BY ts, event_id) FILTER (WHERE event_id % 3 <> 0 AND value IS NOT NULL) AS value, last(props ORDER BY ts, event_id) FILTER (WHERE event_id % 5 <> 0 AND props IS NOT NULL) AS props FROM events GROUP BY 1, 2""")
def upsert_coalesce(t: Tables):
    rows = t.events.withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value"))).withColumn("props", F.when(F.col("event_id") % 5 != 0, F.col("props")))
    rows = rows.withColumn("at", F.col("ts")).withColumn("no", F.col("event_id"))
    return R.upsert_coalesce(rows, ["user_id", "event_type"], ["at", "no"], ["event_id", "ts"], ["value", "props"])


@query("""SELECT user_id, event_type, arg_max(event_id, (event_id % 3 = 0, ts, event_id)) AS event_id FROM events GROUP BY 1, 2""")
def upsert_latest(t: Tables):
    rows, key, order = t.events.select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]
    target = R.upsert_latest(rows.limit(0), rows.where("event_id % 3 != 0"), key, order)
    return R.upsert_latest(target, rows.where("event_id % 3 = 0"), key, order).select("user_id", "event_type", "event_id")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY early DESC, ts, event_id) AS n FROM (SELECT *, event_id < 500 AS early FROM events)) WHERE n = 1""")
def insert_ignore(t: Tables):
    rows, order = t.events.select("user_id", "event_type", "event_id", "ts"), ["ts", "event_id"]
    first = R.insert_ignore(rows.limit(0), rows.where("event_id < 500"), ["user_id", "event_type"], order)
    return R.insert_ignore(first, rows.where("event_id >= 500"), ["user_id", "event_type"], order).select("user_id", "event_type", "event_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'moved' WHEN c_custkey % 4 = 1 THEN NULL ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN 1.5 ELSE c_acctbal END AS c_acctbal FROM customer""")
def partial_update(t: Tables):
    key, text = F.col("c_custkey"), lambda v: F.lit(v).cast("string")
    both = F.create_map(F.lit("c_mktsegment"), text("moved"), F.lit("c_acctbal"), text("1.5"))
    changes = t.customer.where("c_custkey % 4 < 2").select("c_custkey", F.when(key % 4 == 0, both).otherwise(F.create_map(F.lit("c_mktsegment"), text(None))).alias("values"))
    return R.partial_update(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), changes, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("""SELECT (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS n_customers, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS n_orders""")
def delete_cascade(t: Tables):
    kept = R.delete_cascade(t.customer, [(t.orders, "o_custkey")], t.customer.where("c_acctbal < 0"), "c_custkey")
    return kept[0].agg(F.count("*").alias("n_customers")).crossJoin(kept[1].agg(F.count("*").alias("n_orders")))


@query("""SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0) THEN o_custkey END AS o_custkey FROM orders""")
def set_null(t: Tables):
    return R.set_null(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer.where("c_acctbal >= 0"), "c_custkey")


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'new' ELSE role END AS role FROM conversations WHERE conv_id % 5 <> 0 OR turn < 2""")
def replace_all(t: Tables):
    rows = t.conversations.select("conv_id", "turn", "role")
    fresh = rows.where("conv_id % 5 = 0 AND turn < 2").withColumn("role", F.lit("new"))
    return R.replace_documents(rows, fresh, "conv_id").unionByName(rows.limit(0))


@query("""SELECT DISTINCT source, CASE WHEN source IN ('src1', 'src2') THEN 'g_' || source ELSE 'new_' || source END AS group_id, source NOT IN ('src1', 'src2') AS created FROM documents""")
def find_or_create(t: Tables):
    known = t.documents.where("source IN ('src1', 'src2')").select("source", F.concat(F.lit("g_"), "source").alias("group_id")).distinct()
    return R.find_or_create(t.documents, known, "source", "group_id", F.concat(F.lit("new_"), "source"))


@query("""SELECT event_type AS verdict, count(*) AS n_runs, CAST(sum(event_id) AS BIGINT) AS a_tokens, round(avg(value), 6) AS a_ms, CAST(sum(user_id) AS BIGINT) AS b_tokens, round(avg(value * 2), 6) AS b_ms FROM events GROUP BY 1""")
def ab_summary(t: Tables):
    runs = t.events.select(F.col("event_type").alias("verdict"), "event_id", "user_id", "value", (F.col("value") * 2).alias("value2"))
    out = E.arm_summary(runs, {"a": ("event_id", "value"), "b": ("user_id", "value2")}, "verdict")
    return out.withColumns({c: F.round(c, 6) for c in ("a_ms", "b_ms")})


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events WHERE event_type = 'click' GROUP BY 1""")
def push_targets_latest(t: Tables):
    return t.events.where("event_type = 'click'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("""SELECT coalesce(CASE WHEN lang <> 'en' THEN source END, '__ungrouped__') AS bucket, count(*) AS n FROM documents GROUP BY 1""")
def grouped_buckets(t: Tables):
    return t.documents.groupBy(F.coalesce(F.when(F.col("lang") != "en", F.col("source")), F.lit("__ungrouped__")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def recent_first(t: Tables):
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN user_id END AS group_id, CASE WHEN event_type <> 'click' THEN event_id END AS scope_doc FROM events""")
def scope_exclusivity(t: Tables):
    group = F.when(F.col("event_type") == "click", F.col("user_id"))
    return t.events.select("event_id", group.alias("group_id"), F.when(group.isNull(), F.col("event_id")).alias("scope_doc"))


@query("""SELECT conv_id, string_agg(CAST(turn AS VARCHAR) || ':' || role, ',' ORDER BY turn, role) AS children FROM conversations GROUP BY 1""")
def ordered_children(t: Tables):
    child = F.struct("turn", "role", F.concat(F.col("turn").cast("string"), F.lit(":"), "role").alias("s"))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["s"]), ",").alias("children"))


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n = 1""")
def first_per_group(t: Tables):
    rank = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return t.conversations.withColumn("n", rank).where("n = 1").select("conv_id", "turn", "role")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority IS NOT NULL""")
def state_filter(t: Tables):
    return t.orders.where(F.col("o_orderstatus").isin("O", "P") & F.col("o_orderpriority").isNotNull()).select("o_orderkey")


@query("""WITH n AS (SELECT max(ts) AS now FROM events), last AS (SELECT user_id, max(ts) AS sent, count(*) FILTER (WHERE event_type = 'click') AS attempts FROM events GROUP BY 1)
SELECT user_id, sent > now - INTERVAL 60 SECOND AS waits, CASE WHEN sent + INTERVAL 600 SECOND < now OR attempts >= 5 THEN 'expired' WHEN user_id % 3 = 0 THEN 'wrong' ELSE 'ok' END AS answer FROM last, n""")
def code_checks(t: Tables):
    """One-time codes, as though each user's last event had sent one and each click had tried it; a third of the users enter another."""
    now = t.events.agg(F.max("ts").alias("now"))
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("sent"), F.count_if(F.col("event_type") == "click").alias("attempts")).crossJoin(F.broadcast(now))
    code = F.when(F.col("user_id") % 3 == 0, "other").otherwise(F.col("user_id").cast("string"))
    answer = P.check_code(F.sha2(F.col("user_id").cast("string"), 256), P.expires(F.col("sent")), F.col("attempts"), code, F.col("now"))
    return last.select("user_id", P.in_cooldown(F.col("sent"), F.col("now")).alias("waits"), answer.alias("answer"))
