"""Further named queries: prompts, reflection, metrics, collections, retrievers and lookups, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.functions import prompts as pr
from calibrant.functions import text as t
from calibrant.operators import conformal as cf
from calibrant.operators import fusion
from calibrant.operators import search as s
from calibrant.plans import models, systems
from calibrant.plans.queries import _LISTS, _METRICS, _TOKENS, HTML_SQL, PROBS, TRIMMED, _evaluated, _limits, _lists, option_rows, query, read
from calibrant.sources import datasets as ds
from calibrant.sources.index import Collections
from calibrant.streaming import running_coverage


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_fill(template: str, **parts: str) -> str:
    out, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [quoted(head), parts[name]]
    return " || ".join([*out, quoted(rest)])


# ---- prompts -----------------------------------------------------------------------------------------------------

_TECH = "case turn % 4 when 0 then 'direct' when 1 then 'cot' when 2 then 'rag' else 'selfrag' end"
_CTX = "case when conv_id % 3 = 0 then '' else role || ' context' end"
_MODEL = "case conv_id % 6 when 0 then 'Meta-Llama-3' when 1 then 'mistral-7b' when 2 then 'Falcon' when 3 then 'mpt-30b' when 4 then 'DialoGPT' else 'other' end"
_USER = f"case when tech = 'cot' then {sql_fill(chr(10).join(['Let' + chr(39) + 's think step by step.', '', '{q}', '', 'Please provide your reasoning and then give your final answer']) + pr.ASK.split('final answer', 1)[1], q='text')} when tech in ('rag', 'selfrag') and ctx <> '' then {sql_fill('Context information: {c}' + chr(10) * 2 + 'Question: {q}' + chr(10) * 2 + pr.ASK, c='ctx', q='text')} else {sql_fill('{q}' + chr(10) * 2 + pr.ASK, q='text')} end"
_SYS = f"{quoted(pr.SYSTEM)} || case when tech = 'cot' then {quoted(pr.ADD['cot'])} when tech in ('rag', 'selfrag') and ctx <> '' then {quoted(pr.ADD['context'])} else '' end"
_CHAT = "case " + " ".join(f"when contains(lower(model), {quoted(k)}) then {sql_fill(x, system='sys', user='usr')}" for k, x in pr.FAMILIES if k) + f" else {sql_fill(pr.FAMILIES[-1][1], system='sys', user='usr')} end"


@query(f"select conv_id, turn, {_CHAT} as prompt from (select *, {_USER} as usr, {_SYS} as sys from (select *, {_TECH} as tech, {_CTX} as ctx, {_MODEL} as model from conversations))")
def prompt_templates(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", pr.prompt(F.col("text"), F.expr(_TECH), F.expr(_CTX), F.expr(_MODEL)).alias("prompt"))


def _confidence_sql(told: str, tail: str) -> str:
    return f"'a</s>' || role || '</s> Your previous confidence for each answer is ' || {told} || {quoted(tail)} || '</s>b'"


_LAST = ". My answer to follow the format is:\n\n"


@query(f"""select conv_id, turn, {_confidence_sql("format('A: {:.4f}, B: {:.4f}, C: {:.4f}', p, 0.25::double, 0.75 - p)", _LAST)} as aware,
    {_confidence_sql("format('A: {:.4f}, B: {:.4f}, C: {:.4f}', 0.75 - p, p, 0.25::double)", _LAST)} as attack, {_confidence_sql("'A: 0.25, B: 0.25, C: 0.25, D: 0.25'", ". My reason and answer to follow the format is:" + chr(10) * 2)} as defense,
    'a</s>' || role || '</s>b' as normal from (select *, (turn % 5 + 1) / 16.0::double as p from conversations)""")
def confidence_prompts(spark, d):
    p = (F.col("turn") % 5 + 1) / F.lit(16.0)
    text = F.concat(F.lit("a</s>"), "role", F.lit("</s>b"))
    three, four = (F.array(*map(F.lit, letters)) for letters in ("ABC", "ABCD"))
    probs = F.array(p, F.lit(0.25), 0.75 - p)
    told = {m: pr.with_confidence(text, four if m == "defense" else three, probs, m, "</s>") for m in ("aware", "attack", "defense", "normal")}
    return read(spark, d, "conversations").select("conv_id", "turn", *[c.alias(m) for m, c in told.items()])


_PASSAGES = f"select item_id, case when len(p) = 0 then [c] else p end as passages from (select item_id, c, list_filter(list_transform(string_split(c, chr(10) || '-'), lambda x: {TRIMMED}), lambda x: x <> '') as p from (select item_id, chr(10) || '- ' || array_to_string(docs, chr(10) || '- ') as c from ({_LISTS})))"


@query(f"select item_id, passages, {sql_fill('Answer the multiple choice question using the provided context.' + chr(10) + 'Respond with one letter in the format Answer|X.' + chr(10) + 'Question: {q}' + chr(10) + 'Answer:', q='cast(item_id as varchar)')} as prefix, true as plain_is_null from ({_PASSAGES})")
def packed_passages(spark, d):
    docs = t.context(F.col("docs"), None, 10**6)
    both = pr.unpacked(pr.passage_prompt(F.col("item_id").cast("string"), docs))
    return _lists(spark, d).select("item_id", both["passages"].alias("passages"), both["prefix"].alias("prefix"), pr.unpacked(F.concat(F.lit("no json "), F.col("docs")[0])).isNull().alias("plain_is_null"))


@query(f"""select item_id, case when len(docs) > 1 then array_to_string(list_transform(range(1, len(docs)), lambda i: 'Intermediate query ' || i || ': ' || docs[i] || chr(10) || 'Intermediate answer ' || i || ': ' || left(docs[i + 1], 500)), chr(10)) else 'Nothing yet' end as past from ({_LISTS})""")
def chain_of_queries(spark, d):
    n = F.size("docs") - 1
    queries, answers = F.slice("docs", F.lit(1), n), F.transform(F.slice("docs", F.lit(2), n), lambda a: pr.parsed_response(a))
    return _lists(spark, d).select("item_id", pr.past_pairs(queries, answers).alias("past"))


@query("""select conv_id, turn, case when turn % 2 = 0 then text else trim(text) end as answer, left(text, 500) as short from conversations""")
def response_parsing(spark, d):
    asked = F.concat(F.lit("prompt of "), F.col("role"))
    said = F.when(F.col("turn") % 2 == 0, F.concat(asked, F.lit("assistant\n\n"), "text")).otherwise(F.concat(asked, F.col("text")))
    return read(spark, d, "conversations").select("conv_id", "turn", pr.response_only(said, asked).alias("answer"), pr.parsed_response(F.col("text")).alias("short"))


@query("""select conv_id, turn, case turn % 3 when 0 then 1.0::double when 1 then 0.0::double end as relevance, case turn % 4 when 0 then 1.0::double when 1 then 0.7::double when 2 then 0.0::double end as support, cast(5 - turn % 5 as integer) as utility, turn % 2 = 0 as retrieve from conversations""")
def reflection_scores(spark, d):
    n = F.col("turn")
    pick = lambda k, *tokens: F.element_at(F.array(*map(F.lit, tokens)), (n % k + 1).cast("int"))
    said = F.concat(pick(2, "<|retrieve|>", "<|no_retrieve|>"), F.col("text"), pick(3, "<|relevant|>", "<|irrelevant|>", ""), pick(4, "<|fully_supported|>", "<|partially_supported|>", "<|no_support|>", ""), F.lit("<|utility:"), (5 - n % 5).cast("string"), F.lit("|><|utility:0|>"))
    r = t.reflection(said)
    return read(spark, d, "conversations").select("conv_id", "turn", t.reflection_scores(r).alias("s"), t.needs_retrieval(r).alias("retrieve")).select("conv_id", "turn", "s.*", "retrieve")


@query(f"""select item_id, array_to_string(list_transform(docs, lambda x, i: 'k' || i || ': ' || x), chr(10)) as pairs, array_to_string(docs, chr(10)) as lines from ({_LISTS})""")
def choice_forms(spark, d):
    pairs = F.transform("docs", lambda x, i: F.struct(F.concat(F.lit("k"), (i + 1).cast("string")).alias("key"), x.alias("value")))
    return _lists(spark, d).select("item_id", t.choice_pairs(pairs).alias("pairs"), t.choice_lines(F.col("docs")).alias("lines"))


@query("""select conv_id, turn, case when conv_id % 4 = 0 then 'RAPTOR Analysis: ' || text when turn % 3 = 0 then role else role || chr(10) || chr(10) || 'RAPTOR Analysis: ' || text end as context, length(trim(text)) > 50 as long_enough from conversations""")
def tree_context(spark, d):
    own = F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.col("role"))
    new = F.when((F.col("turn") % 3 == 0) & (F.col("conv_id") % 4 != 0), " ").otherwise(F.col("text"))
    both = F.when(own == "", F.concat(F.lit("RAPTOR Analysis: "), new)).otherwise(t.merged_context(own, new, "\n\nRAPTOR Analysis: "))
    return read(spark, d, "conversations").select("conv_id", "turn", both.alias("context"), (F.length(t.strip(F.col("text"))) > systems.RaptorLlm.LEAST).alias("long_enough"))


# ---- probabilities and metrics -----------------------------------------------------------------------------------


@query("select vec_id, [case when vec_id % 3 = 0 then 0.25 else round(exp(-1.0) / (exp(-1.0) + exp(-2.0) + exp(vec_id % 7 * -1.0)), 9) end, case when vec_id % 3 = 0 then 0.25 else round(exp(-2.0) / (exp(-1.0) + exp(-2.0) + exp(vec_id % 7 * -1.0)), 9) end, case when vec_id % 3 = 0 then 0.25 else round(exp(vec_id % 7 * -1.0) / (exp(-1.0) + exp(-2.0) + exp(vec_id % 7 * -1.0)), 9) end, case when vec_id % 3 = 0 then 0.25 else 0.0 end] as probs from embeddings")
def softmax_of_logprobs(spark, d):
    top = F.create_map(F.lit("A"), F.lit(-1.0), F.lit("B"), F.lit(-2.0), F.lit("C"), -(F.col("vec_id") % 7).cast("double"), F.lit("the"), F.lit(-0.1))
    none = F.create_map(F.lit("x"), F.lit(-1.0))
    logits = fusion.option_logits(F.array(*map(F.lit, "ABCD")), F.when(F.col("vec_id") % 3 == 0, none).otherwise(top))
    return read(spark, d, "embeddings").select("vec_id", F.transform(fusion.softmax(logits), lambda p: F.round(p, 9)).alias("probs"))


@query("select vec_id, round(sqrt(list_inner_product(list_transform(embedding, lambda x: cast(3 * x as double)), list_transform(embedding, lambda x: cast(3 * x as double)))), 5) as norm, 1.0::double as unit from embeddings")
def unit_vectors(spark, d):
    v = F.transform("embedding", lambda x: (3 * x).cast("double"))
    u = s.unit(v)
    return read(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(s.dot(v, v)), 5).alias("norm"), F.round(s.dot(u, u), 9).alias("unit"))


@query(f"with {PROBS} select list(n order by sample_id) as lac_set_sizes, list(a order by sample_id) as aps_set_sizes from (select sample_id, cast(count(*) filter (in_lac) as integer) as n, cast(count(*) filter (in_aps) as integer) as a from s group by sample_id)")
def set_size_lists(spark, d):
    rows = option_rows(spark, d)
    return cf.set_sizes(rows.where("split = 'test'"), _limits(rows))


@query(f"select accuracy, round((lac_coverage + aps_coverage) / 2, 6) as coverage, round((lac_avg_set_size + aps_avg_set_size) / 2, 6) as set_size from (with {PROBS} {_METRICS.format(skip='')})")
def combined_metrics(spark, d):
    rows = option_rows(spark, d)
    return cf.combined(cf.metrics(rows.where("split = 'test'"), _evaluated(spark, d), _limits(rows)))


@query(f"""with {PROBS} select split, sample_id, round(sum((p - cast(correct as integer)) * (p - cast(correct as integer))), 6) as brier, cast(count(*) filter (p > 0.1) as integer) as likely from r group by split, sample_id""")
def custom_metrics(spark, d):
    known = cf.CustomMetrics()
    known.add("brier", lambda probs: F.round(F.aggregate(probs, F.lit(0.0), lambda a, x: a + F.pow(x["p"] - x["correct"].cast("int"), F.lit(2))), 6))
    known.add("likely", lambda probs: F.size(F.filter(probs, lambda x: x["p"] > 0.1)))
    return known.compute(option_rows(spark, d))


@query("""select vec_id as sample_id, 'q' || vec_id as question, case when vec_id % 4 <> 0 then 'said ' || vec_id else '' end as generated_response, case when vec_id % 4 = 0 then 'Unknown' when vec_id % 5 = 0 then 'Unknown' else 'B' end as predicted_answer,
    case when vec_id % 4 = 0 then 0 else 2 end as options_scored, case when vec_id % 4 <> 0 then 'x' end as technique from embeddings""")
def normalised_results(spark, d):
    e = read(spark, d, "embeddings")
    samples = e.select(F.col("vec_id").alias("sample_id"), F.concat(F.lit("q"), "vec_id").alias("question"))
    probs = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(o).alias("opt"), F.lit(0.5).alias("p")) for i, o in enumerate("AB")])
    results = e.where("vec_id % 4 <> 0").select(F.col("vec_id").alias("sample_id"), F.lit("other").alias("question"), F.concat(F.lit("said "), "vec_id").alias("generated_response"), F.when(F.col("vec_id") % 5 > 0, "B").alias("predicted_answer"), probs.alias("probs"), F.lit("x").alias("technique"))
    return cf.normalised(samples, results).select("sample_id", "question", "generated_response", "predicted_answer", F.size("probs").alias("options_scored"), "technique")


@query("select doc_id, [cast(lang = 'en' as integer), cast(lang = 'fr' as integer), 0] as strict, case when lang = 'en' then ['e'] when lang = 'fr' then ['F'] else [] end as matched from documents")
def label_match_guarded(spark, d):
    options, labels = F.array(F.lit("e"), F.lit("F"), F.lit("x")), F.array(F.upper(F.substring("lang", 1, 1)), F.lit("y"))
    labels = F.transform(labels, lambda x: F.when(x == "E", F.when(F.col("lang") == "en", "E").otherwise("z")).otherwise(x))
    return read(spark, d, "documents").select("doc_id", t.label_match_strict(options, labels).alias("strict"), t.matched_options(options, labels).alias("matched"))


_LINES = (("Total Samples: {}", "total_samples"), ("Accuracy: {:.4f}", "accuracy"), ("LAC Coverage: {:.4f}", "lac_coverage"), ("APS Coverage: {:.4f}", "aps_coverage"), ("LAC Avg Set Size: {:.4f}", "lac_avg_set_size"), ("APS Avg Set Size: {:.4f}", "aps_avg_set_size"), ("  LAC Threshold: {:.4f}", "lac_threshold"), ("  APS Threshold: {:.4f}", "aps_threshold"))


@query(f"with mm as (with {PROBS} {_METRICS.format(skip='')}), tt as (with {PROBS} select * from th where alpha = 0.1) " + " union all ".join(f"select {i} as line, format({quoted(form)}, {c}) as text from mm, tt" for i, (form, c) in enumerate(_LINES)))
def result_report(spark, d):
    rows = option_rows(spark, d)
    limits = _limits(rows)
    return ds.report(cf.metrics(rows.where("split = 'test'"), _evaluated(spark, d), limits).join(F.broadcast(limits), F.lit(True)))


@query(f"with {PROBS} select split, sample_id, opt, p from r where p > 0")
def option_explode(spark, d):
    rows = option_rows(spark, d)
    nested = rows.groupBy("split", "sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", "opt", "p"))).alias("probs"))
    return systems.long_probs(nested, "split", "sample_id").where("p > 0")


# ---- corpora, collections, retrievers ----------------------------------------------------------------------------

_OWN = "page_id % 3 <> 0"


def _with_results(spark, d) -> DataFrame:
    """Pages as samples: two results of their own, or a pointer to shared corpora."""
    kind = "array<struct<page_snippet: string, page_result: string, persistent_storage: array<string>>>"
    two = F.array(F.struct(F.col("url").alias("page_snippet"), F.col("html").alias("page_result"), F.lit(None).cast("array<string>").alias("persistent_storage")), F.struct(F.lit(None).cast("string").alias("page_snippet"), F.lit("<b>x</b>").alias("page_result"), F.lit(None).cast("array<string>").alias("persistent_storage")))
    names = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("nations"), F.lit("unknown"))).otherwise(F.array(F.lit("regions"), F.lit("nations")))
    shared = F.array(F.struct(F.lit("").alias("page_snippet"), F.lit("").alias("page_result"), names.alias("persistent_storage")))
    return read(spark, d, "pages").select(F.col("page_id").alias("sample_id"), F.when(F.expr(_OWN), two.cast(kind)).otherwise(shared.cast(kind)).alias("search_results"))


@query(f"select page_id as sample_id, 0 as doc_pos, concat(url, chr(10), chr(10), {HTML_SQL.format(x='html')}) as text from pages where {_OWN} union all select page_id, 1, chr(10) || chr(10) || 'x' from pages where {_OWN}")
def own_documents(spark, d):
    return systems.own_documents(_with_results(spark, d))


@query(f"""select page_id as sample_id, request, doc_id, text from (select page_id, 0 as request, n_nationkey as doc_id, n_name as text from pages, nation where not ({_OWN}) and page_id % 2 = 0
    union all select page_id, 1, n_nationkey, n_name from pages, nation where not ({_OWN}) and page_id % 2 <> 0 union all select page_id, 0, r_regionkey, r_name from pages, region where not ({_OWN}) and page_id % 2 <> 0)""")
def shared_documents(spark, d):
    corpora = ds.Corpora({"nations": read(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("text")), "regions": read(spark, d, "region").select(F.col("r_regionkey").alias("doc_id"), F.col("r_name").alias("text"))})
    return systems.shared_documents(_with_results(spark, d), corpora).select("sample_id", "doc_pos.request", "doc_pos.doc_id", "text")


@query("select item_id as query_id, cast(i as integer) as rank, ([" + ", ".join(map(quoted, systems.FIXED_DOCS)) + "])[i] as chunk, round(1.1 - i * 0.1::double, 1) as score from benchmark, (select unnest(range(1, 4)) as i)")
def fixed_retriever(spark, d):
    return systems.fixed_retriever(read(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), 3)


@query("select item_id as query_id, cast(i as integer) as rank, (['one two...', 'three', ''])[i] as chunk, 1.0::double as score from benchmark, (select unnest(range(1, 4)) as i)")
def provided_documents(spark, d):
    return systems.provided_retriever(["one two three", "three"], 7)(read(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), 3)


@query("select vec_id, label, cast((label * 7 + vec_id) % 10 as bigint) as grp from embeddings")
def group_modulo(spark, d):
    e = read(spark, d, "embeddings")
    most = e.agg(F.max("label").alias("most"))
    return e.join(F.broadcast(most), F.lit(True)).select("vec_id", "label", F.pmod(F.col("label") * 7 + F.col("vec_id"), F.col("most") + 1).alias("grp"))


#: The stand-in model answers with the last 7, 10 and 4 words: as many as its instructions have.
@query("""select item_id as sample_id, list_filter(l, lambda q, i: q <> '' and list_position(l, q) = i) as queries from (select item_id, [text, array_to_string(w[greatest(len(w) - 6, 1):], ' '), array_to_string(w[greatest(len(w) - 9, 1):], ' '),
    array_to_string(w[greatest(len(w) - 3, 1):], ' ')] as l from (select item_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from benchmark))""")
def query_fan_out(spark, d):
    samples = read(spark, d, "benchmark").select(F.col("item_id").alias("sample_id"), F.col("text").alias("question"))
    return systems.FusionLlm().fan_out(samples).select("sample_id", "queries")


@query("select item_id as sample_id, cast(i as integer) as member, round(1.1 - i * 0.1::double, 1) as weight, ([" + ", ".join(map(quoted, systems.FIXED_DOCS)) + "])[i] as context from benchmark, (select unnest(range(1, 6)) as i)")
def ensemble_members(spark, d):
    samples = read(spark, d, "benchmark").select(F.col("item_id").alias("sample_id"), F.col("text").alias("question"))
    return systems.Replug(systems.fixed_retriever).members(samples).select("sample_id", "member", "weight", "context")


_CHUNKS = f"""pt as (select db_index, doc_id, i as chunk_id, array_to_string(w[i * 90 + 1:i * 90 + 100], ' ') as chunk, row_number() over (partition by db_index order by doc_id, i) - 1 as point_id from
    (select doc_id % 3 as db_index, doc_id, w, unnest(range(0, (len(w) + 89) // 90)) as i from (select doc_id, {_TOKENS} as w from documents)))"""


def _collections(spark, d) -> Collections:
    docs = read(spark, d, "documents").select((F.col("doc_id") % 3).cast("int").alias("db_index"), "doc_id", "text")
    return Collections.build(docs, {0: "a", 1: "b", 2: "c"}, size=100, overlap=10)


@query(f"with {_CHUNKS} select cast(db_index as integer) as db_index, point_id, doc_id, cast(chunk_id as integer) as chunk_id, chunk from pt where db_index = 1 and point_id > 20 and point_id <= 60")
def scrolled_points(spark, d):
    return _collections(spark, d).scroll(1, 20, 40).select("db_index", "point_id", "doc_id", "chunk_id", "chunk")


@query(f"with {_CHUNKS} select cast(db_index as integer) as db_index, point_id, chunk from pt where db_index = 2 and point_id % 7 = 0 and point_id < 1000")
def looked_up_points(spark, d):
    wanted = spark.range(1500).where("id % 7 = 0 and id < 1000").select(F.lit(2).alias("db_index"), F.col("id").alias("point_id"))
    return _collections(spark, d).retrieve(wanted).select("db_index", "point_id", "chunk")


@query(f"with {_CHUNKS}, n as (select db_index, count(*) as n from pt group by db_index) select cast(db_index as integer) as db_index, point_id, doc_id, chunk from pt where db_index = 0 union all select 0, n + row_number() over (order by item_id) - 1, item_id, array_to_string({_TOKENS}, ' ') from benchmark, n where db_index = 0")
def appended_points(spark, d):
    index = _collections(spark, d)
    index.append(read(spark, d, "benchmark").select(F.lit(0).alias("db_index"), F.col("item_id").alias("doc_id"), "text"), size=100, overlap=10)
    return index.points.where("db_index = 0").select("db_index", "point_id", "doc_id", "chunk")


@query("""select source, count(distinct lang) as samples, count(*) as docs, round(count(*) / count(distinct lang), 2) as docs_per_sample, cast(sum(length(text)) as bigint) as chars, round(sum(length(text)) / count(*), 2) as chars_per_doc,
    cast(sum(w) as bigint) as words, round(sum(w) / count(*), 2) as words_per_doc from (select *, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as w from documents) group by source""")
def dataset_statistics(spark, d):
    words = F.size(t.tokens(F.col("text")))
    n = F.count(F.lit(1))
    return read(spark, d, "documents").groupBy("source").agg(F.count_distinct("lang").alias("samples"), n.alias("docs"), F.round(n / F.count_distinct("lang"), 2).alias("docs_per_sample"), F.sum(F.length("text")).alias("chars"), F.round(F.sum(F.length("text")) / n, 2).alias("chars_per_doc"), F.sum(words).cast("long").alias("words"), F.round(F.sum(words) / n, 2).alias("words_per_doc"))


STOP = ["the", "of", "and", "to", "in", "de", "la"]
_SPACE = f"""tw as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]{{2,}}'), lambda x: not list_contains([{', '.join(map(quoted, STOP))}], x)) as w from documents),
    tt as (select doc_id, term, count(*) as tf from (select doc_id, unnest(list_concat(w, case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end)) as term from tw) group by all),
    vv as (select term, count(*) as df, sum(tf) as every from tt group by term order by every desc, term limit 300), nn as (select count(*) as n from documents),
    ww as (select doc_id, term, tf * (ln((n + 1) / (df + 1)) + 1) as x from tt join vv using (term), nn), uu as (select doc_id, term, x / sqrt(sum(x * x) over (partition by doc_id)) as w from ww)"""


def _space(spark, d) -> s.TfIdf:
    return s.TfIdf(read(spark, d, "documents").select("doc_id", "text"), STOP, 2, 300)


@query(f"with {_SPACE} select doc_id, count(*) as terms, round(sum(w), 6) as total from uu group by doc_id")
def tfidf_features(spark, d):
    return _space(spark, d).vectors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("w"), 6).alias("total"))


@query(f"""with {_SPACE}, qq as (select doc_id as query_id, term, w as q from uu where doc_id % 40 = 0)
    select query_id, doc_id, score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select query_id, doc_id, round(sum(q * w), 6) as score from qq join uu using (term) group by all)) where rank <= 5""")
def tfidf_topk(spark, d):
    asked = read(spark, d, "documents").where("doc_id % 40 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return _space(spark, d).search(asked, 5)


@query("select c_custkey, c_name, 'dated' as how from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3 union all select c_custkey, c_name, 'any' from customer where c_mktsegment = 'BUILDING' union all select c_custkey, c_name, 'games' from customer where c_custkey in (1, 5, 9)")
def knowledge_lookups(spark, d):
    c = read(spark, d, "customer")
    games = c.select(F.col("c_mktsegment").alias("date"), F.col("c_nationkey").cast("string").alias("team_name"), "c_custkey", "c_name")
    tables = ds.Knowledge({"sports_nba_get_games_on_date": games, "sports_nba_get_play_by_play_data_by_game_ids": c.withColumn("game_id", F.col("c_custkey"))})
    told = {"dated": tables.call("sports", "nba_get_games_on_date", date="BUILDING", team_name="3"), "any": tables.call("sports", "nba_get_games_on_date", date="BUILDING"), "games": tables.call("sports", "nba_get_play_by_play_data_by_game_ids", game_ids=[1, 5, 9])}
    dated, every, by_id = (df.select("c_custkey", "c_name", F.lit(k).alias("how")) for k, df in told.items())
    return dated.unionByName(every).unionByName(by_id)


@query("select n_name as config from nation where n_nationkey not in (select r_regionkey from region)")
def configs_not_run(spark, d):
    done = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_nationkey") == F.col("r_regionkey")).select(F.col("n_name").alias("config"))
    return ds.not_yet_run(read(spark, d, "nation").select(F.col("n_name").alias("config")), done)


@query("select cast(date_trunc('hour', ts) as timestamp) as start, count(*) as n, cast(sum(cast(value / 1000 >= 1.0 - 0.6::double as integer)) as bigint) as covered from events group by 1")
def windowed_coverage(spark, d):
    rows = read(spark, d, "events").select("ts", (F.col("value") / 1000).alias("p_correct"))
    return running_coverage(rows, 0.6).select(F.col("window.start").alias("start"), "n", "covered")


@query()
def embedding_retrieval(spark, d):
    """The documents that a hashed embedder finds for each benchmark text (no SQL: SHA-256 buckets)."""
    find = systems.embedding_retriever(read(spark, d, "documents").select("doc_id", "text"), models.hashed_embedder())
    return find(read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 3)
