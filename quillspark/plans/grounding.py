"""Queries of grounded answers, sentences that name a subject, and histories of procedures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import grounding as G
from quillspark.operators import procedures as P
from quillspark.plans.catalog import query


def _worded(spark, d):
    """A reply for each part to three statements about it: one sentence that they support, one with a number that they lack, one without a citation and one that cites what there is not."""
    p = spark.read.parquet(f"{d}/part.parquet").withColumnRenamed("p_partkey", "request_id")
    size, more = F.col("p_size").cast("string"), (F.col("p_size") + 1000).cast("string")
    said = F.array(F.concat(F.lit("  The type is "), F.col("p_type")), F.lit(" "), F.concat(F.lit("The size is "), size, F.lit(" units")), F.concat(F.lit("Made by "), F.col("p_brand")))
    statements = G.numbered(p.select("request_id", F.posexplode(said).alias("place", "statement")))
    reply = F.concat(F.lit("It is "), F.col("p_type"), F.lit(" , of size "), size, F.lit(". [1][2] It weighs "), more, F.lit(" [2]! Nobody knows? Made by "), F.col("p_brand"), F.lit("[7]. So it is [3][3]."))
    return p.select("request_id", reply.alias("reply")), statements


_FIRST = "'It is ' || p_type || ', of size ' || cast(p_size as varchar) || '.'"
query("gr1_grounded_sentences", flat=True, sql=(
    f"select p_partkey as request_id, unnest([{_FIRST}, 'It weighs ' || cast(p_size + 1000 as varchar) || '!', 'Nobody knows?', 'Made by ' || p_brand || '.', 'So it is.']) as text, unnest(['1,2', '2', '', '7', '3']) as citations, unnest([null, 'UNSUPPORTED_NUMBER', 'NO_CITATION', 'NO_SUCH_STATEMENT', null]) as problem from part"))(
    lambda spark, d: G.grounded(*_worded(spark, d)).select("request_id", "text", F.array_join("citations", ",").alias("citations"), "problem"))
query("gr1_explanations", flat=True, sql=f"select p_partkey as request_id, {_FIRST} || ' So it is.' as text, cast(2 as bigint) as n_kept, cast(3 as bigint) as n_removed, false as insufficient from part")(lambda spark, d: G.explanations(*_worded(spark, d)))
_SUBJECT = "case lang when 'de' then 'und' when 'fr' then 'les' when 'es' then 'que' else 'the' end"
query("t14_naming_sentences", flat=True, sql=(
    f"with parted as (select doc_id, {_SUBJECT} as subject, string_split(replace(regexp_replace(text, '([.!?])(\\s|$)', '\\1' || chr(1) || '\\2', 'g'), chr(10), chr(10) || chr(1)), chr(1)) as pieces from documents where text is not null),"
    " placed as (select doc_id, subject, unnest(range(1, len(pieces) + 1)) as i, unnest(pieces) as piece, unnest(list_transform(range(1, len(pieces) + 1), lambda k: k)) as k from parted), spots as (select *, coalesce(sum(length(piece)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as before from placed),"
    " found as (select doc_id, i, cast(before + length(regexp_extract(piece, '^\\s*')) as int) as s, trim(regexp_replace(piece, '\\s+', ' ', 'g')) as sentence, length(regexp_replace(piece, '^\\s+|\\s+$', '', 'g')) as n from spots where contains(lower(piece), subject)),"
    f" numbered as (select *, row_number() over (partition by doc_id order by i) as place from found) select doc_id as text_id, place, s as \"start\", cast(s + n as int) as \"end\", sentence from numbered where place <= {G.MOST_NAMING}"))(
    lambda spark, d: G.naming(spark.read.parquet(f"{d}/documents.parquet").where("text is not null").select(F.col("doc_id").alias("text_id"), "text", F.expr(_SUBJECT.replace("varchar", "string")).alias("subject"))))


def _runs(spark, d):
    """Events as runs of a user's procedure (purchases verify it, errors fail it, clicks say nothing), its versions (signups), and the times that are asked for (views)."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("subject_id"), F.col("event_id"), "event_type", F.col("ts").alias("at"))
    status = F.when(F.col("event_type") == "purchase", "VERIFIED").when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "click", "INCONCLUSIVE")
    runs = e.select("subject_id", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), status.alias("status"), "at").where("status is not null")
    return runs, e.where("event_type = 'signup'").select("subject_id", F.col("event_id").alias("version"), "at"), e.where("event_type = 'view'").select("subject_id", "at")


_RUNS = "case event_type when 'purchase' then 'VERIFIED' when 'error' then 'FAILED' when 'click' then 'INCONCLUSIVE' end"
query("pm1_procedure_states", flat=True, sql=(
    f"with runs as (select user_id, event_id, {_RUNS} as status, ts from events where event_type in ('purchase', 'error', 'click')), versions as (select user_id, event_id as version, ts from events where event_type = 'signup'), asked as (select distinct user_id, ts from events where event_type = 'view'),"
    " versioned as (select r.*, v.version from runs r asof left join versions v on v.user_id = r.user_id and v.ts <= r.ts), now as (select a.*, v.version from asked a asof left join versions v on v.user_id = a.user_id and v.ts <= a.ts)"
    " select n.user_id as subject_id, epoch_us(n.ts) as at_us, n.version, count(r.event_id) as executions, count(*) filter (r.status = 'VERIFIED') as successes, count(*) filter (r.status = 'FAILED') as failures, epoch_us(max(r.ts) filter (r.status = 'VERIFIED')) as last_verified_us, arg_max(r.status, row(r.ts, r.event_id)) as last_status, count(*) filter (r.status = 'VERIFIED' and r.version is not distinct from n.version) > 0 as verified from now n left join versioned r on r.user_id = n.user_id and r.ts <= n.ts group by n.user_id, n.ts, n.version"))(
    lambda spark, d: P.states(*_runs(spark, d)).select("subject_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "version", "executions", "successes", "failures", F.unix_micros(F.col("last_verified").cast("timestamp")).alias("last_verified_us"), "last_status", "verified"))
