"""The queries of this subpackage: one for each operator over its whole table, and the pipeline."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat, decontam, langid, mixing, phrases, pii, quality, secrets, simhash, tokens, toxicity, trie
from quillspark.llm.common import crc_mod, new_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    names = F.array(*map(F.lit, (*secrets.KINDS, secrets.LEARNT)))
    base = F.filter("found", lambda x: x["kind"] < len(secrets.KINDS))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(i: int) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_checksums(spark, path)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = crc_mod("doc_id", toxicity.PARTS)
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(part != toxicity.HELD_OUT))
    held_out = F.coalesce(part == toxicity.HELD_OUT, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(chat.events(table(spark, sf_dir, "conversations")), chat.EXCHANGES)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))

    def written(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    base = F.concat(*map(written, pii.KINDS))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, written(pii.EXTRA)), ",").alias("spans"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = crc_mod("doc_id", langid.PARTS)
    model = langid.fit(docs.where(part != langid.HELD_OUT))
    return langid.predict(docs, model).select("doc_id", F.coalesce(part == langid.HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_prefixes(table(spark, sf_dir, "conversations")).drop("digest")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = str(Path(__file__).resolve().parents[2])
    if root not in sys.path:
        sys.path.append(root)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = [op1_secret_scan, op2_simhash_neardup, op3_quality_rules, op4_token_files, op5_toxicity, op6_tool_calls, op7_personal_data, op8_language_id, op9_source_mix, op10_decontamination, op11_bpe_words, op12_collocations, op13_prefix_trie, pipeline]
    return {q.__name__: q for q in found}


#: crc32 of an id written in decimal, bit by bit.
_CRC = "xor(list_reduce([4294967295::bigint] || list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i::bigint, 1))::bigint), lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)"
OP13_SQL = f"""
with turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as place from conversations where conv_id is not null),
every_id as (select conv_id, conv_id - conv_id % 5 as base, {_CRC} % 9 as h from (select distinct conv_id from turns)),
rebuilt as (
  select e.conv_id, 0 as part, t.place, t.role, t.text from every_id e join turns t on t.conv_id = e.base and t.place <= e.h
  union all select e.conv_id, 1, t.place, t.role, t.text from every_id e join turns t on t.conv_id = e.conv_id and t.place > e.h),
paths as (select e.conv_id, coalesce(p.path, []) as path from every_id e left join (select conv_id, list(struct_pack(r := role, t := text) order by part, place) as path from rebuilt group by conv_id) p using (conv_id)),
prefixes as (select conv_id, d as depth, path[1:d] as node, len(path) = d as ends from (select conv_id, path, unnest(range(0, len(path) + 1)) as d from paths)),
nodes as (select depth, node, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '') as ids from prefixes group by depth, node),
valued as (select n.*, (select count(*) from nodes c where c.depth = n.depth + 1 and c.node[1:n.depth] = n.node) as n_children, case when depth = 0 then 0 else (n_convs - 1) * strlen(node[depth].t) end as saved from nodes n),
sums as (select a.depth, a.node, sum((b.n_children = 0)::int) as n_leaves, sum(b.saved) as saved_tokens from valued a join valued b on b.depth >= a.depth and b.node[1:a.depth] = a.node group by a.depth, a.node)
select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(v.ids) as ends_sha256
from valued v join sums s on s.depth = v.depth and s.node = v.node left join nodes p on p.depth = v.depth - 1 and p.node = v.node[1:v.depth - 1]
"""

#: Pieces and words by position, so that phrases are neighbours within a piece; the count of every phrase of one to three words decides cuts.
OP12_SQL = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
split as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') as w from pieces),
grams as (
  select lang, 1 as k, unnest(w) as phrase from split
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from split
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from split),
f as (select lang, k, phrase, count(*) as f, string_split(phrase, ' ') as w from grams group by lang, k, phrase),
totals as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select * from f where k > 1 and f >= 10),
cuts as (select c.lang, c.k, c.phrase, c.f, u.i, array_to_string(c.w[1:u.i], ' ') as head, array_to_string(c.w[u.i + 1:], ' ') as tail from c, unnest([1, 2]) as u(i) where u.i < c.k),
scored as (select cuts.lang, cuts.k, cuts.phrase, cuts.f as a, x.f as l, y.f as r, cuts.i, ((1000000::hugeint * cuts.f * cuts.f) // (x.f::hugeint * y.f))::bigint as score from cuts join f x on x.lang = cuts.lang and x.phrase = cuts.head join f y on y.lang = cuts.lang and y.phrase = cuts.tail),
worst as (select * from scored qualify row_number() over (partition by lang, phrase order by score, i) = 1),
covered as (select lang, phrase, max(f) as f from (select lang, w[1] || ' ' || w[2] as phrase, f from c where k = 3 union all select lang, w[2] || ' ' || w[3], f from c where k = 3) group by lang, phrase),
kept as (select worst.* from worst left join covered on worst.k = 2 and covered.lang = worst.lang and covered.phrase = worst.phrase where covered.f is null or 100 * covered.f < 50 * worst.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept join totals using (lang) qualify rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """SQL cannot express the others (hash functions, learned models, token files); tests hold them against brute force."""
    return {"op12_collocations": OP12_SQL, "op13_prefix_trie": OP13_SQL}
