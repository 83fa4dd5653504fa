"""RatRag and CoRag pass on all that they retrieve."""

import pytest
from pyspark.sql import functions as F

from calibrant.plans import systems
from calibrant.sources.tables import Workspace


def test_evidence_is_whole(spark):
    asked = []

    def retriever(queries, k):
        asked.append(queries)
        ranks = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank")
        return queries.select("query_id", ranks).withColumn("chunk", F.concat(F.lit("evidence"), "rank", F.lit(" "), F.repeat(F.lit("x"), 350)))

    samples = spark.createDataFrame([(1, "q" * 380, ["a", "b"], "now")], "sample_id int, question string, options array<string>, query_time string")
    rat = systems.RatRag(retriever).contexts(samples).first()["context"]
    assert rat.startswith("Step-by-step reasoning with evidence:\nevidence1 ") and all(f"evidence{i} " in rat for i in range(1, 11))
    for by_subquery in (False, True):
        system = systems.CoRag(retriever)
        system.by_subquery = by_subquery
        past = system.contexts(samples).first()["context"]
        assert all(f"evidence{i} " in past for i in range(1, 11))


def scripted():
    """A generator that answers by the first words of the prompt."""

    def model(prompts):
        for p in prompts:
            if p.startswith("Question:"):
                yield "one\ntwo\nthree\nAnswer|A"
            elif p.startswith("Write a detailed passage"):
                yield "a passage"
            elif p.startswith("Write only a search query"):
                yield "search " + p.split("Reasoning so far:\n")[1].split("\n\nQuestion:")[0].replace("\n", " ")
            elif p.startswith("Revise"):
                yield "revised(" + p.split("Reasoning so far:\n")[1].split("\n\nQuestion:")[0].replace("\n", " ") + ")"
            elif p.startswith("Ask one simple"):
                yield f"sub {p.count('Intermediate query')}"
            else:
                yield "answer"

    return lambda: lambda prompts: list(model(prompts))


def test_rounds_ask_the_model_and_resume(spark):
    """Queries are generated from the state of a round; a job that failed goes on after the last round that was written."""
    asked = []

    def retriever(queries, k):
        asked.append(queries.first()["query"])
        if len(asked) == fail:
            raise RuntimeError("lost")
        return queries.select("query_id", F.lit(1).alias("rank"), F.concat(F.lit("found by "), "query").alias("chunk"))

    samples = spark.createDataFrame([(1, "why", ["a", "b"], "now")], "sample_id int, question string, options array<string>, query_time string")
    want = ["search one", "search revised(one) two", "search revised(revised(one) two) three"]
    end = "revised(revised(revised(one) two) three)"
    root, fail = Workspace(spark).root, 2
    with pytest.raises(RuntimeError):
        systems.RatRag(retriever, generator=scripted(), workspace=Workspace(spark, root)).contexts(samples)
    out = systems.RatRag(retriever, generator=scripted(), workspace=Workspace(spark, root)).contexts(samples).first()
    assert asked == [want[0], want[1], want[1], want[2]]
    assert out["context"] == f"Step-by-step reasoning with evidence:\nfound by {want[2]}\nReasoning: {end}\nQuery Time: now"
    asked, fail = [], 0
    co = systems.CoRag(retriever, generator=scripted())
    assert co.contexts(samples).first()["subqueries"] == ["sub 0", "sub 1", "sub 2"] and asked == ["why"]
    co.by_subquery, asked = True, []
    assert co.contexts(samples).first()["subanswers"] == ["answer"] * 3 and asked == ["sub 0", "sub 1", "sub 2"]
    asked = []
    assert systems.HydeRag(retriever, generator=scripted()).contexts(samples).first()["passage"] == "a passage" and asked == ["a passage"]
