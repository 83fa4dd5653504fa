"""The queries of this subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_topk, op2_shards, op3_langid, op4_simhash, op5_suffix, op6_urls, op7_substring, op8_bpe, op9_decontam, op10_warc, op11_quality, op12_whitening, op13_merkle
from .common import Scratch


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", Scratch(spark))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_shards.shard_documents(table(spark, sf_dir, "documents"), Scratch(spark))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_langid.language_id(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_simhash.digest(op4_simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark)))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_suffix.digest(op5_suffix.suffix_dedup(table(spark, sf_dir, "documents"), Scratch(spark)))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_urls.filter_urls(table(spark, sf_dir, "pages"), Scratch(spark))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_substring.digest(op7_substring.substring_dedup(table(spark, sf_dir, "documents"), Scratch(spark)))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_bpe.digest(op8_bpe.bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary()))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_warc.round_trip(table(spark, sf_dir, "pages"), Scratch(spark))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_quality.digest(op11_quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))[0])


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_merkle.digest(op13_merkle.manifest(table(spark, sf_dir, "documents"), Scratch(spark), tampered=op13_merkle.every_seventh()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_topk, op2_sharding, op3_language_id, op4_simhash_near_dedup, op5_suffix_array_dedup, op6_url_filters, op7_substring_dedup, op8_bpe_codec, op9_decontamination, op10_warc_round_trip, op11_quality_rules, op12_embedding_whitening, op13_merkle_manifest)
}

def _quality_sql() -> str:
    """Rules, tuning and exact binomial tails of operator 11."""
    o = op11_quality
    values = " union all ".join(f"select doc_id, stratum, digest, base_failed, '{r}' as rule, least(1000, {a} * 1000 // greatest({b}, 1)) as value from c" for r, (a, b) in o.RULES.items())
    return rf"""
        with w as (select doc_id, text, lang, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, row_number() over () as r from documents),
        g as (select r, p, w[p:p+{o.WINDOW - 1}] as k from (select r, w, unnest(generate_series(1, len(w) - {o.WINDOW - 1})) as p from w)),
        again as (select r, p from g join (select r, k from g group by r, k having count(*) > 1) using (r, k)),
        rep as (select r, count(distinct i) as n from (select r, unnest(generate_series(p, p + {o.WINDOW - 1})) as i from again) group by r),
        x as (select *, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from w),
        c as (select doc_id, coalesce('=' || lang, '') as stratum, md5(coalesce(text, '')) as digest, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
                cast(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
                cast(len(lines) as bigint) as n_lines, cast(length(regexp_replace(coalesce(text, ''), '[^!?]', '', 'g')) as bigint) as n_loud, cast(length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) as bigint) as n_capitals,
                cast(len(list_filter(list_zip(w[1:len(w) - 1], w[2:]), lambda z: z[1] = z[2])) as bigint) as n_stutter, len(w) < {o.LEAST_WORDS} or 100 * coalesce(rep.n, 0) > {o.MOST_REPEATED} * len(w) as base_failed
              from x left join rep using (r)),
        v as ({values}),
        told as (select doc_id, max(quality) as quality from labels where quality is not null group by doc_id),
        texts as (select stratum, digest, rule, any_value(value) as value, max(quality) > 0 as good, instr('02468ace', left(digest, 1)) > 0 as tuning from v join told using (doc_id) where not base_failed group by stratum, digest, rule),
        cuts as (select unnest(generate_series(1, 1000)) as cut),
        sums as (select stratum, rule, cut, count(*) filter (good and value >= cut) as good, count(*) filter (not good and value >= cut) as bad from texts, cuts where tuning group by stratum, rule, cut),
        best as (select stratum, rule, max(bad - {o.GOOD_WEIGHT} * good) as gain from sums group by stratum, rule having gain > 0),
        top as (select stratum, rule, max(cut) as top from sums join best using (stratum, rule) where bad - {o.GOOD_WEIGHT} * good = gain group by stratum, rule),
        tuned as (select t.stratum, t.rule, (min(b.cut) + max(t.top) + 1) // 2 as tuned from top t join sums a on a.stratum = t.stratum and a.rule = t.rule and a.cut = t.top join sums b on b.stratum = t.stratum and b.rule = t.rule and a.good = b.good and a.bad = b.bad group by t.stratum, t.rule),
        held as (select stratum, rule, cut, count(*) filter (good) as n, count(*) filter (good and value >= cut) as rejected from texts join tuned using (stratum, rule), cuts where not tuning group by stratum, rule, cut),
        asked as (select distinct stratum, rule, n, {o.RISK} / (select count(*) from tuned t where t.stratum = held.stratum) as risk, {o.DELTA} / (select count(*) from tuned) as level from held),
        tails as (select stratum, rule, r, level, sum(exp(lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1) + r * ln(risk) + (n - r) * ln(1 - risk))) over (partition by stratum, rule order by r) as tail
                  from (select *, unnest(generate_series(0, n)) as r from asked)),
        allowed as (select stratum, rule, max(r) as most from tails where tail <= level group by stratum, rule),
        cutoffs as (select stratum, rule, greatest(min(cut), any_value(tuned)) as cutoff from held join allowed using (stratum, rule) join tuned using (stratum, rule) where rejected <= most group by stratum, rule),
        broken as (select stratum, doc_id, digest, string_agg(distinct rule, ',' order by rule) as rules from v join cutoffs using (stratum, rule) where value >= cutoff and not base_failed group by stratum, doc_id, digest)
        select c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rules is null as kept, case when base_failed then 'base' else coalesce(rules, '') end as rejected_by
        from c left join broken b on c.stratum = b.stratum and c.digest = b.digest and c.doc_id is not distinct from b.doc_id
    """


#: DuckDB SQL over the same tables.  The others have no SQL form (random draws, models, XXH64) and are
#: tested against brute force, the library or an exact round trip.
ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings where vec_id is not null and len(embedding) > 0
                   and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(list_transform(q.v, lambda x: cast(x as double)), list_transform(c.v, lambda x: cast(x as double))) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
        select query_id, cast(rank as integer) as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
    """,
    "op7_substring_dedup": r"""
        with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        g as (select doc_id, p, w[p:p+12] as k from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as p from d)),
        f as (select k, min(doc_id) as first from g group by k),
        hit as (select distinct doc_id, unnest(generate_series(p, p + 12)) as i from g join f using (k) where first < doc_id),
        gone as (select doc_id, list(i) as gone from hit group by doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
               sha256(coalesce(list_aggregate(list_filter(w, lambda x, i: gone is null or not list_contains(gone, i)), 'string_agg', ' '), '')) as kept_sha256
        from d left join gone using (doc_id)
    """,
    "op10_warc_round_trip": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        m as (select h, max(page_id) as main from p where strlen(h) >= 1000 group by h)
        select page_id, cast(strlen(p.h) as bigint) as payload_bytes, sha1(p.h) as payload_digest,
               case when main is not null and main <> page_id then 'revisit' else 'response' end as record_type,
               case when main is not null and main <> page_id then main end as refers_to
        from p left join m on p.h = m.h
    """,
    "op11_quality_rules": _quality_sql(),
    "op13_merkle_manifest": """
        with recursive f as (select doc_id, lang, n_chars,
                coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as a,
                coalesce(strlen(text) || ':' || text, '-') as b, coalesce('=' || lang, '') as tree from documents),
        l as (select *, sha256(a || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') || b) as leaf, sha256(a || coalesce(strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1), '-') || b) as changed,
                list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
                    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [cast(0 as bigint), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) as state from f),
        i as (select doc_id, tree, leaf, case when xor(state, 4294967295) % 7 = 0 then changed else leaf end as shown, row_number() over (partition by tree order by doc_id, leaf) - 1 as idx, count(*) over (partition by tree) as n from l),
        lower_nodes as (select tree, 0 as level, idx, n, leaf as node from i
                  union all select tree, level + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(node, '' order by idx)) from lower_nodes where n > 1 group by tree, level, idx // 2),
        sub as (select tree, node as subroot, row_number() over (order by encode(tree)) - 1 as idx, count(*) over () as n from lower_nodes where n = 1),
        upper_nodes as (select 0 as level, idx, n, subroot as node from sub
                  union all select level + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(node, '' order by idx)) from upper_nodes where n > 1 group by level, idx // 2),
        walk as (select doc_id, leaf, i.tree, sub.subroot, 0 as stage, 0 as level, i.idx, i.n, sub.idx as tree_idx, sub.n as trees, shown as folded, '' as proof from i join sub using (tree)
                  union all select doc_id, leaf, w.tree, subroot, case when w.n = 1 then 1 else stage end, case when w.n = 1 then 0 else w.level + 1 end,
                         case when w.n = 1 then tree_idx else w.idx // 2 end, case when w.n = 1 then trees else (w.n + 1) // 2 end, tree_idx, trees,
                         case when w.n = 1 then folded when w.idx % 2 = 1 then sha256(coalesce(a.node, b.node, '') || folded) else sha256(folded || coalesce(a.node, b.node, '')) end,
                         proof || case when w.n = 1 then '' else coalesce(a.node, b.node, '') end
                  from walk w left join lower_nodes a on w.stage = 0 and a.tree = w.tree and a.level = w.level and a.idx = xor(w.idx, 1) and w.n > 1
                              left join upper_nodes b on w.stage = 1 and b.level = w.level and b.idx = xor(w.idx, 1) and w.n > 1
                  where not (w.stage = 1 and w.n = 1))
        select doc_id, leaf, subroot, (select node from upper_nodes where n = 1) as root, sha256(proof) as proof_sha256, folded as folded_root, folded = (select node from upper_nodes where n = 1) as verified
        from walk where stage = 1 and n = 1
    """,
}
