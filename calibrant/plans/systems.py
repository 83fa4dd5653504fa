"""Question-answering systems as dataflows, with models behind interfaces (see ``models``).

Samples have ``sample_id, question, options, query_time`` and may have ``context``.  A system adds a context by retrieval, makes a prompt by
its technique, and a scorer gives a logit for each option; ``answer`` returns the samples with ``context, prompt, probs, predicted_answer, technique`` and
what the system adds.  Results stay with their key, so a row that fails loses nothing but its own answer.

Retriever: ``(queries(query_id, query), k) -> (query_id, rank, chunk[, score])``.  Scorer: ``rows(prompt, options, context) -> + logits``.
Generator: a factory for ``models.generate``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.functions import prompts as pr
from calibrant.functions import text as t
from calibrant.functions.text import context, document_text, fusion_context, merged_context, newest_first_context, thought_context, tokens
from calibrant.operators import fusion, search, tree
from calibrant.operators.chunk import chunk
from calibrant.plans import models
from calibrant.sources.tables import Workspace

Retriever = Callable[[DataFrame, int], DataFrame]
#: The documents of the fixed retriever (fixed values); the n-th has a score of 1 - (n - 1) / 10.
FIXED_DOCS = (
    "This is a sample document about science and mathematics.",
    "Historical information and context for various topics.",
    "General knowledge and factual information database.",
    "Educational content covering multiple subject areas.",
    "Reference material for questions and answers.",
)
QUERY_TIME = "March 1, 2025"


def overlap_score(rows: DataFrame) -> DataFrame:
    """Logit of an option: how many of its words (and those of its letter) the context holds."""
    words = tokens(F.lower(F.coalesce("context", F.lit(""))))
    return rows.withColumn("logits", F.transform("options", lambda o: F.size(F.array_intersect(tokens(F.lower(o)), words)).cast("double")))


def model_scorer(factory: Callable, batch: int = 40) -> Callable[[DataFrame], DataFrame]:
    """A scorer that runs a model in batches; failed rows have uniform probabilities and an error."""
    return lambda rows: models.with_errors(models.score(rows, factory, batch), "logits", F.transform("options", lambda o: F.lit(0.0)))


def with_probabilities(rows: DataFrame) -> DataFrame:
    """Nested softmax of ``logits``: ``probs array<struct<pos, opt, p>>`` in option order, and the first best option."""
    probs = F.transform(F.arrays_zip("options", fusion.softmax(F.col("logits")).alias("e")), lambda x, i: F.struct(i.alias("pos"), x["options"].alias("opt"), F.round(x["e"], 9).alias("p")))
    return with_best(rows.withColumn("probs", probs))


def with_best(rows: DataFrame) -> DataFrame:
    """``predicted_answer``: the first option of highest probability."""
    best = F.array_max(F.transform("probs", lambda x: F.struct(x["p"].alias("p"), (-x["pos"]).alias("o"), x["opt"].alias("opt"))))
    return rows.withColumn("predicted_answer", best["opt"])


def long_probs(answered: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("sample_id",)
    return answered.select(*keys, F.explode("probs").alias("x")).select(*keys, "x.opt", "x.p")


def nested_probs(samples: DataFrame, flat: DataFrame, missing: Column) -> DataFrame:
    """``probs`` in option order from ``(sample_id, opt, p)``; options without a row have ``missing``."""
    m = flat.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("opt", "p"))).alias("m"))
    probs = F.transform("options", lambda o, i: F.struct(i.alias("pos"), o.alias("opt"), F.coalesce(F.try_element_at("m", o), missing).alias("p")))
    return with_best(samples.join(m, "sample_id", "left").withColumn("probs", probs)).drop("m")


def retrieved(samples: DataFrame, query: Column, retriever: Retriever, k: int) -> DataFrame:
    """``docs``: the hits' chunks by rank; empty where nothing was found."""
    samples = samples.persist()  # the query set: a round's state is read by the search, which counts it, and by the next round
    hits = retriever(samples.select(F.col("sample_id").alias("query_id"), query.alias("query")), k)
    docs = hits.groupBy(F.col("query_id").alias("sample_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"]).alias("docs"))
    return samples.join(docs, "sample_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))


def said(text: Column, otherwise: Column) -> Column:
    """What a model said, or ``otherwise`` where it said nothing."""
    return F.coalesce(F.nullif(t.strip(text), F.lit("")), otherwise)


def distinct_queries(question: Column, generated: Column) -> Column:
    """The question first, then each other query once, blank ones left out."""
    return F.array_distinct(F.filter(F.concat(F.array(question), F.transform(generated, lambda q: t.strip(q))), lambda q: q != ""))


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


# ---- documents and retrievers ------------------------------------------------------------------------------------


def own_documents(samples: DataFrame) -> DataFrame:
    """``sample_id, doc_pos, text`` of the documents that samples bring along (``search_results``), where they do not point to shared corpora."""
    own = samples.where(t.shared_corpora(F.col("search_results")).isNull())
    each = own.select("sample_id", F.posexplode("search_results").alias("doc_pos", "r"))
    return each.select("sample_id", "doc_pos", document_text(F.col("r.page_snippet"), F.col("r.page_result")).alias("text"))


def shared_documents(samples: DataFrame, corpora) -> DataFrame:
    """``sample_id, doc_pos, text`` of the shared corpora that samples point to, by the position of the name and the document; unknown names give none.

    Told row by row.  ``corpora``: ``sources.datasets.Corpora``.
    """
    names = samples.select("sample_id", F.posexplode(t.shared_corpora(F.col("search_results"))).alias("request", "corpus"))
    every = corpora.get(sorted(corpora.tables))
    docs = every.select("corpus", "doc_id", "text").join(names, "corpus")
    return docs.select("sample_id", F.struct("request", "doc_id").alias("doc_pos"), "text")


def fixed_retriever(queries: DataFrame, k: int) -> DataFrame:
    """The same documents for every query."""
    rows = [(i + 1, text, round(1 - i / 10, 1)) for i, text in enumerate(FIXED_DOCS[:k])]
    docs = queries.sparkSession.createDataFrame(rows, "rank int, chunk string, score double")
    return queries.select("query_id").join(F.broadcast(docs), F.lit(True))


def provided_retriever(documents: list[str], most: int | None = None) -> Retriever:
    """Given documents for every query, score 1; cut to ``most`` characters, padded with empty ones up to k."""

    def run(queries: DataFrame, k: int) -> DataFrame:
        rows = [(i + 1, (documents + [""] * k)[i], 1.0) for i in range(k)]
        docs = queries.sparkSession.createDataFrame(rows, "rank int, chunk string, score double")
        text = t.ellipsis(F.col("chunk"), most) if most else F.col("chunk")
        return queries.select("query_id").join(F.broadcast(docs), F.lit(True)).withColumn("chunk", text)

    return run


def bm25_retriever(docs: DataFrame) -> Retriever:
    """Over ``docs (doc_id, text)``."""
    index = search.Bm25(docs)

    def run(queries: DataFrame, k: int) -> DataFrame:
        hits = search.bounded(index.search(queries, k), queries, k)
        return docs.select("doc_id", F.col("text").alias("chunk")).join(hits, "doc_id").select("query_id", "rank", "chunk", "score")

    return run


def embedding_retriever(docs: DataFrame, embedder: Callable, vectors: DataFrame | None = None) -> Retriever:
    """By cosine over ``docs (doc_id, text)``, whose vectors come from the embedder or a table ``vectors (doc_id, v)`` computed elsewhere."""
    known = vectors.select("doc_id", "v") if vectors is not None else models.embed(docs.select("doc_id", "text"), embedder, "text", "v").select("doc_id", "v")
    known = known.select(F.col("doc_id").alias("chunk_id"), search.unit(F.col("v")).alias("c_vec"))

    def run(queries: DataFrame, k: int) -> DataFrame:
        asked = models.embed(queries.select("query_id", "query"), embedder, "query", "q").select("query_id", search.unit(F.col("q")).alias("q_vec"))
        hits = search.bounded(search.dense_topk(asked, known, k), queries, k)
        return docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk")).join(hits, "chunk_id").select("query_id", "rank", "chunk", "score")

    return run


def grouped_retriever(docs: DataFrame, embedder: Callable) -> Retriever:
    """As ``embedding_retriever`` among a sample's own documents: ``docs (sample_id, text)``; query ids are sample ids."""
    known = models.embed(docs.select("sample_id", "text"), embedder, "text", "v")
    known = known.select("sample_id", F.struct(F.xxhash64("text").alias("h"), "text").alias("chunk_id"), search.unit(F.col("v")).alias("c_vec"))

    def run(queries: DataFrame, k: int) -> DataFrame:
        asked = models.embed(queries.select("query_id", "query"), embedder, "query", "q")
        asked = asked.select("query_id", F.col("query_id").alias("sample_id"), search.unit(F.col("q")).alias("q_vec"))
        return search.dense_topk(asked, known, k, "sample_id").select("query_id", "rank", F.col("chunk_id.text").alias("chunk"), "score")

    return run


def two_lists(semantic: Retriever, other: Retriever | None, queries: DataFrame, k: int = 10, other_k: int = 3) -> DataFrame:
    """``query_id, semantic, other``: chunks of two retrievers as two lists; without the second one its list is empty."""
    listed = lambda hits, name: hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"]).alias(name))
    none = F.array().cast("array<string>")
    out = queries.select("query_id").join(listed(semantic(queries, k), "semantic"), "query_id", "left").withColumn("semantic", F.coalesce("semantic", none))
    if other is None:
        return out.withColumn("other", none)
    return out.join(listed(other(queries, other_k), "other"), "query_id", "left").withColumn("other", F.coalesce("other", none))


# ---- systems -----------------------------------------------------------------------------------------------------


class System:
    """A dataflow with its default k, batch size and technique."""

    k, batch, technique, method = 10, 40, "direct", "normal"
    default_generator = staticmethod(models.echo_generator())

    def __init__(self, retriever: Retriever | None = None, scorer=overlap_score, generator: Callable | None = None, model: str = "default", technique: str | None = None, method: str | None = None, eos: str = "</s>", embedder: Callable | None = None, workspace: Workspace | None = None):
        self.retriever, self.scorer, self.generator, self.model, self.eos = retriever, scorer, generator or self.default_generator, model, eos
        self.embedder, self.workspace = embedder or models.hashed_embedder(), workspace
        self.technique, self.method = technique or self.technique, method or self.method
        if self.technique not in pr.TECHNIQUES:
            raise ValueError(f"unknown technique {self.technique!r}; known: {pr.TECHNIQUES}")

    def contexts(self, samples: DataFrame) -> DataFrame:
        return samples if has_column(samples, "context") else samples.withColumn("context", F.lit(None).cast("string"))

    def prompted(self, rows: DataFrame) -> DataFrame:
        technique = F.lit(self.technique)
        return rows.withColumns({"technique": technique, "prompt": pr.prompt(F.col("question"), technique, F.col("context"), F.lit(self.model))})

    def scored(self, rows: DataFrame) -> DataFrame:
        """Probabilities; a method other than ``normal`` asks twice, the second time with the first confidence in the prompt."""
        told = with_probabilities(self.scorer(rows))
        if self.method == "normal":
            return told
        before = F.transform("probs", lambda x: x["p"])
        again = told.withColumn("prompt", pr.with_confidence(F.col("prompt"), F.col("options"), before, self.method, self.eos))
        return with_probabilities(self.scorer(again.drop("logits", "logits_error", "probs", "predicted_answer")))

    def answer(self, samples: DataFrame) -> DataFrame:
        return self.scored(self.prompted(self.contexts(samples)))

    def generated(self, rows: DataFrame, asked: Column, out: str) -> DataFrame:
        """A column of generated text, without the prompt."""
        told = models.generate(rows.withColumn("__asked", asked), self.generator, "__asked", out, self.batch)
        return told.withColumn(out, F.coalesce(pr.response_only(F.col(out), F.col("__asked")), F.lit(""))).drop("__asked", f"{out}_error")


class SimpleLlm(System):
    """No retrieval."""


class SimpleRag(System):
    """Retrieval with the question."""

    batch, technique = 2, "rag"

    def query(self) -> Column:
        return F.col("question")

    def contexts(self, samples):
        when = F.coalesce("query_time", F.lit(QUERY_TIME)) if has_column(samples, "query_time") else F.lit(QUERY_TIME)
        return retrieved(samples, self.query(), self.retriever, self.k).withColumn("context", context(F.col("docs"), when))


class HydeLlm(System):
    """A context that the sample brings along, as a passage that would answer the question."""

    technique = "hyde"


class HydeRag(SimpleRag):
    """Retrieval with a generated passage that would answer the question; with the question where none is generated."""

    technique = "hyde"

    def query(self) -> Column:
        return said(F.col("passage"), F.col("question"))

    def contexts(self, samples):
        return super().contexts(self.generated(samples, pr.passage_request(F.col("question")), "passage"))


class FusionLlm(System):
    """Fan-out of a question into reworded queries, for retrieval by others; answers with the context that the sample brings along."""

    technique, queries, default_generator = "fusion", 3, staticmethod(models.tail_generator)

    def fan_out(self, samples: DataFrame) -> DataFrame:
        """``queries``: the question and up to ``queries`` distinct generated ones."""
        told, names = samples, [f"__query{i}" for i in range(self.queries)]
        for i, name in enumerate(names):
            told = self.generated(told, pr.rewording_prompt(F.col("question"), i), name)
        return told.withColumn("queries", distinct_queries(F.col("question"), F.array(*names))).drop(*names)


class FusionRag(FusionLlm):
    """Several rewordings of the question, fused by reciprocal ranks; the question itself comes first."""

    batch = 2

    def contexts(self, samples):
        each = self.fan_out(samples).select("sample_id", F.posexplode("queries").alias("query_no", "query")).withColumn("query_id", F.struct("sample_id", "query_no"))
        hits = self.retriever(each.select("query_id", "query"), self.k).select("query_id.sample_id", "query_id.query_no", "rank", F.col("chunk").alias("doc"))
        order = fusion.rrf(hits).where(F.col("position") <= self.k)
        docs = order.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "doc"))), lambda x: x["doc"]).alias("docs"))
        return samples.join(docs, "sample_id", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>"))).withColumn("context", fusion_context(F.col("docs")))


class RatLlm(System):
    """Reasoning in steps: a given number of thoughts is generated, split and carried along with the answer."""

    technique, batch, rounds = "rat", 20, 3

    def thoughts(self, samples: DataFrame) -> DataFrame:
        """``thoughts``: the lines of a generated reasoning, at least ``rounds`` of them (padded with '')."""
        asked = pr.fill("Question: {q}\n\nProvide exactly {n} reasoning steps, one a line, then the final answer.", q=F.col("question"), n=F.lit(str(self.rounds)))
        told = self.generated(samples, asked, "reasoned")
        return told.withColumn("thoughts", t.thoughts(F.col("reasoned"), F.lit("\x00"), self.rounds)).drop("reasoned")


class RatRag(RatLlm):
    """Reasoning that is revised thought by thought: each round generates a query from the reasoning so far, retrieves, and has the reasoning revised with the evidence.

    A round's state is a written table: with a ``workspace`` of the same root a job goes on after the last round that it finished.
    """

    batch = 2

    def contexts(self, samples):
        workspace = self.workspace or Workspace(samples.sparkSession)
        question, reasoning = F.col("question"), F.col("reasoning")
        when = F.coalesce("query_time", F.lit(QUERY_TIME)) if has_column(samples, "query_time") else F.lit(QUERY_TIME)
        state = workspace.step("rat-0", lambda: self.thoughts(samples).withColumn("reasoning", F.col("thoughts")[0]))
        for i in range(self.rounds):

            def revised(state=state, i=i):
                asked = workspace.step(f"rat-{i + 1}-asked", lambda: self.generated(state, pr.search_prompt(question, reasoning), "search"))
                found = retrieved(asked, said(F.col("search"), question), self.retriever, self.k).withColumn("evidence", thought_context(F.col("docs")))
                told = self.generated(found, pr.revision_prompt(question, reasoning, F.col("evidence")), "revised")
                last = F.concat("evidence", F.lit("\nReasoning: "), "revised")
                told = told.withColumn("reasoning", last if i == self.rounds - 1 else F.concat("revised", F.lit("\n"), F.col("thoughts")[i + 1]))
                return told.drop("search", "docs", "evidence", "revised")

            state = workspace.step(f"rat-{i + 1}", revised)
        return state.withColumn("context", F.concat(F.lit("Step-by-step reasoning with evidence:\n"), reasoning, F.lit("\nQuery Time: "), when))


class CoRag(System):
    """A chain of generated sub-queries with their answers; documents are prepended, newest first.

    Documents are those of the question, found once and read by every round; with ``by_subquery`` each round searches with its sub-query.
    A round's state is a written table, as in ``RatRag``.
    """

    technique, batch, rounds, by_subquery = "rag", 8, 3, False

    def contexts(self, samples):
        workspace = self.workspace or Workspace(samples.sparkSession)
        none, question = F.array().cast("array<string>"), F.col("question")
        start = samples.withColumns({"past": none, "subqueries": none, "subanswers": none})
        state = workspace.step("co-0", lambda: start if self.by_subquery else retrieved(start, question, self.retriever, self.k))
        for i in range(self.rounds):

            def answered(state=state, i=i):
                asked = self.generated(state, pr.subquery_prompt(question, F.col("subqueries"), F.col("subanswers")), "sub")
                asked = asked.withColumn("sub", pr.parsed_response(said(F.col("sub"), question)))
                if self.by_subquery:
                    asked = retrieved(workspace.step(f"co-{i + 1}-asked", lambda: asked.drop("docs")), F.col("sub"), self.retriever, self.k)
                told = self.generated(asked, pr.subanswer_prompt(F.col("sub"), F.col("docs")), "said")
                told = told.withColumns({"past": F.concat("past", "docs"), "subqueries": F.array_append("subqueries", F.col("sub")), "subanswers": F.array_append("subanswers", pr.parsed_response(F.col("said")))})
                return told.drop("sub", "said")

            state = workspace.step(f"co-{i + 1}", answered)
        return state.withColumn("context", newest_first_context(F.col("past"))).drop("docs")

    def prompted(self, rows):
        chain = pr.final_prompt(F.col("context"), F.col("subqueries"), F.col("subanswers"))
        return rows.withColumns({"technique": F.lit(self.technique), "prompt": pr.chat(F.lit(pr.SYSTEM), pr.fill("{c}\n\n## Main query\n{q}\n\n" + pr.ASK, c=chain, q=F.col("question")), F.lit(self.model))})


class RaptorLlm(System):
    """A long text that the sample brings along becomes a tree of summaries; what a question finds in it is the context."""

    #: A text is worth a tree from more than this many characters on (fixed value).
    LEAST = 50
    #: Of a chunk, the words; of a tree, the nodes that a question is answered from.
    CHUNK, NODES = 100, 5

    def tree(self, rows: DataFrame, workspace: Workspace | None = None) -> DataFrame:
        """Nodes of all levels over the chunks of each row's own ``context``; see ``operators.tree``."""
        chunks = rows.select("sample_id", F.posexplode(chunk(F.col("context"), "sentence", size=self.CHUNK)).alias("pos", "text"))
        chunks = chunks.select("sample_id", F.lpad(F.col("pos").cast("string"), 10, "0").alias("node"), "text")

        def condense(clusters: DataFrame) -> DataFrame:
            return self.generated(clusters, pr.fill("Summarise the following texts.\n\n{t}", t=F.array_join("texts", "\n\n")), "text")

        embed = lambda nodes: models.embed(nodes, self.embedder, "text", "v").drop("v_error").where("v is not null")
        return tree.build(chunks, embed, condense, workspace or Workspace(rows.sparkSession))

    def condensed(self, samples: DataFrame) -> DataFrame:
        """``raptor_answer``, told from the nodes nearest to the question, where there is a long context of its own, else null."""
        rows = System.contexts(self, samples)
        long = rows.where(F.length(t.strip(F.coalesce("context", F.lit("")))) > self.LEAST)
        if not long.limit(1).count():
            return rows.withColumns({"raptor_answer": F.lit(None).cast("string"), "raptor_used": F.lit(False)})
        nodes = RaptorLlm.tree(self, long)
        asked = models.embed(long.select("sample_id", "question"), self.embedder, "question", "q").select(F.col("sample_id").alias("query_id"), "sample_id", F.col("q").alias("q_vec"))
        hits = tree.tree_topk(asked, nodes, RaptorLlm.NODES).select(F.col("query_id").alias("sample_id"), "level", "node", "rank")
        found = nodes.join(hits, ["sample_id", "level", "node"]).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("found"))
        told = self.generated(long.select("sample_id", "question").join(found, "sample_id"), pr.subanswer_prompt(F.col("question"), F.col("found")), "raptor_answer")
        told = told.select("sample_id", F.nullif(t.strip("raptor_answer"), F.lit("")).alias("raptor_answer"))
        return rows.join(told, "sample_id", "left").withColumn("raptor_used", F.col("raptor_answer").isNotNull())

    def contexts(self, samples):
        return self.condensed(samples).withColumn("context", F.when(F.col("raptor_used"), F.concat(F.lit("RAPTOR Analysis: "), "raptor_answer")).otherwise(F.col("context")))

    def prompted(self, rows):
        technique = F.when(F.col("raptor_used"), "rag").otherwise(self.technique)
        return rows.withColumns({"technique": technique, "prompt": pr.prompt(F.col("question"), technique, F.col("context"), F.lit(self.model))})


class RaptorRag(SimpleRag):
    """Retrieval, and behind the retrieved context the condensed one of the sample's own long text."""

    def contexts(self, samples):
        own = RaptorLlm.condensed(self, samples).withColumnRenamed("context", "own")
        found = SimpleRag.contexts(self, own)
        both = merged_context(F.col("context"), F.col("raptor_answer"), "\n\nRAPTOR Analysis: ")
        return found.withColumn("context", F.nullif(F.when(F.coalesce("context", F.lit("")) == "", F.concat(F.lit("RAPTOR Analysis: "), "raptor_answer")).otherwise(both), F.lit(""))).withColumn("rag_enhanced", F.size("docs") > 0)

    LEAST, CHUNK = RaptorLlm.LEAST, RaptorLlm.CHUNK


class SelfLlm(System):
    """A model that may answer with reflection tokens; they are parsed from its response."""

    technique, default_generator = "selfrag", staticmethod(models.reflecting_generator)

    def reflected(self, rows: DataFrame) -> DataFrame:
        """``reflection``: the tokens of a generated response."""
        told = models.generate(rows, self.generator, "prompt", "generated_response", self.batch)
        return told.withColumn("reflection", t.reflection(F.coalesce("generated_response", F.lit("")))).drop("generated_response_error")

    def decisions(self, samples: DataFrame) -> DataFrame:
        """``retrieve``: whether the model asks for documents, by its reflection token."""
        asked = pr.fill("Question: {q}\nOptions: {o}\n\nDo you need to retrieve information to answer this question?", q=F.col("question"), o=F.array_join("options", ", "))
        told = models.generate(samples.withColumn("__asked", asked), self.decider, "__asked", "__said", self.batch)
        return told.withColumn("retrieve", t.needs_retrieval(t.reflection(F.coalesce("__said", F.lit(""))))).drop("__asked", "__said", "__said_error")

    decider = staticmethod(models.retrieval_decider)

    def answer(self, samples):
        return self.reflected(super().answer(samples))


class SelfRag(SelfLlm):
    """Documents only where the model asks for them; an answer for each candidate context, the best by reflection scores."""

    k = 5

    def candidates(self, samples: DataFrame) -> DataFrame:
        """A row for each candidate context: ``candidate, context, docs, retrieve``."""
        told = self.decisions(samples)
        found = retrieved(told.where("retrieve"), F.col("question"), self.retriever, self.k)
        base = found.unionByName(told.where("not retrieve").withColumn("docs", F.array().cast("array<string>")))
        fan = fusion.fan_out(base.select("sample_id", "docs"))
        return base.drop("context").join(fan, "sample_id")

    def answer(self, samples):
        rows = self.reflected(self.prompted(self.candidates(samples)))
        scores = rows.select("sample_id", "candidate", t.reflection_scores(F.col("reflection")).alias("s")).select("sample_id", "candidate", "s.*")
        best = fusion.best_candidate(scores).select("sample_id", "candidate", F.col("composite").alias("composite_score"), F.col("relevance").alias("relevance_score"), F.col("support").alias("support_score"), (F.coalesce("utility", F.lit(3)) / 5).alias("utility_score"))
        return self.scored(rows.join(best, ["sample_id", "candidate"]))


class Replug(System):
    """One answer for each retrieved document, averaged with retrieval scores as weights."""

    k, batch, technique = 5, 20, "rag"
    weighted, most = True, 1000

    def members(self, samples: DataFrame) -> DataFrame:
        """A row for each document: ``member, weight, context``; a sample without documents has one empty member."""
        hits = self.retriever(samples.select(F.col("sample_id").alias("query_id"), F.col("question").alias("query")), self.k)
        score = F.col("score") if has_column(hits, "score") else 1.1 - 0.1 * F.col("rank")
        docs = hits.select(F.col("query_id").alias("sample_id"), F.col("rank").alias("member"), score.cast("double").alias("weight"), t.ellipsis(F.col("chunk"), self.most).alias("doc"))
        rows = System.contexts(self, samples).join(docs, "sample_id", "left").withColumns({"member": F.coalesce("member", F.lit(1)), "weight": F.coalesce("weight", F.lit(1.0))})
        return rows.withColumn("context", F.coalesce(F.nullif(t.strip(F.coalesce("doc", F.lit(""))), F.lit("")), "context")).drop("doc")

    def answer(self, samples):
        scored = self.scored(self.prompted(self.members(samples)))
        mean = fusion.ensemble(long_probs(scored, "sample_id", "member", "weight"), self.weighted)
        sizes = scored.groupBy("sample_id").agg(F.count(F.lit(1)).alias("ensemble_size"))
        return nested_probs(samples.join(sizes, "sample_id", "left"), mean, 1.0 / F.size("options")).withColumn("technique", F.lit("replug"))


class ReplugRag(Replug):
    """Plain retrieval and the ensemble, fused; the ensemble's samples have the retrieved context, too."""

    batch, strategy, weights = 2, "weighted", fusion.WEIGHTS

    def answer(self, samples):
        rag = SimpleRag(self.retriever, self.scorer, model=self.model).answer(samples)
        first = rag.select("sample_id", F.substring("context", 1, 500).alias("found"))
        richer = System.contexts(self, samples).join(first, "sample_id", "left")
        richer = richer.withColumn("context", F.when(F.coalesce("context", F.lit("")) == "", F.col("found")).otherwise(merged_context(F.col("context"), F.col("found")))).drop("found")
        fused = fusion.fuse(long_probs(rag), long_probs(super().answer(richer)), self.strategy, self.weights)
        return nested_probs(samples, fused, F.lit(0.0)).withColumn("technique", F.lit("replug_rag"))


class FidLlm(System):
    """Each passage of the context is read with the question by itself; an option's score is its best over the passages, renormalised."""

    batch, technique = 80, "rag"

    def answer(self, samples):
        rows = self.contexts(samples).withColumns({"technique": F.lit(self.technique), "fid_prefix": pr.passage_prefix(F.col("question"))})
        rows = rows.withColumn("passages", t.split_passages(F.col("context")))
        reader = pr.reader_input(F.col("fid_prefix"), F.array_join("options", "\n"))
        each = rows.select("sample_id", "options", F.posexplode("passages").alias("position", "context"), reader.alias("prompt"))
        told = with_probabilities(self.scorer(each))
        best = fusion.max_over_positions(long_probs(told, "sample_id", "position"))
        out = nested_probs(rows, best, 1.0 / F.size("options"))
        return out.withColumn("prompt", pr.packed(F.col("passages"), F.col("fid_prefix")))


class FidRag(FidLlm):
    """Passages are the retrieved documents of the sample itself."""

    def contexts(self, samples):
        return SimpleRag.contexts(self, samples)

    query = SimpleRag.query


REGISTRY: dict[str, type[System]] = {
    "simplellm": SimpleLlm, "simplerag": SimpleRag, "hydellm": HydeLlm, "hyderag": HydeRag, "fusionllm": FusionLlm, "fusionrag": FusionRag,
    "ratllm": RatLlm, "ratrag": RatRag, "raptorllm": RaptorLlm, "raptorrag": RaptorRag, "selfllm": SelfLlm, "selfrag": SelfRag,
    "replugllm": Replug, "replugrag": ReplugRag, "fidllm": FidLlm, "fidrag": FidRag, "corag": CoRag,
}


def register(name: str, system: type[System]) -> None:
    """Add a system of one's own."""
    REGISTRY[name.lower()] = system


def get_system(name: str, **options) -> System:
    if name.lower() not in REGISTRY:
        raise ValueError(f"unknown system {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name.lower()](**options)


def list_systems() -> dict[str, str]:
    return {k: (v.__doc__ or "").strip().splitlines()[0] for k, v in sorted(REGISTRY.items())}
