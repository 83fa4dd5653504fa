"""Prompts as column functions: questions, chat wrappers, confidence texts, chains of sub-queries.

Instructions to a model are parameters; the defaults below are our own wording.  The marker ``Answer|X`` and the wrappers of model families
are what other code parses, and fixed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calibrant.functions.text import SPACES, confidence_text, inject, rotated, split_passages, strip

#: How an answer is asked for (fixed value: the answer parser reads this marker).
ASK = "Please provide your final answer in the format Answer|X where X is your answer for the multiple choice question, which can be A, B, C, D, ..."
#: Techniques that read a context.
WITH_CONTEXT = ("rag", "hyde", "fusion", "rat", "selfrag")
TECHNIQUES = ("direct", "cot", *WITH_CONTEXT)
SYSTEM = "You answer multiple choice questions. End with Answer|X, where X is the letter of your choice, and nothing after it."
ADD = {"cot": " Reason step by step first.", "context": " Use the context that is given."}
#: Chat wrappers by model family: a substring of the lower-cased model name, tried in this order, and the last for all others (fixed values).
FAMILIES = (
    ("llama", "<s>[INST] <<SYS>>\n{system}\n<</SYS>>\n\n{user} [/INST]\n\n"),
    ("mistral", "<s>[INST] {system}\n\n{user} [/INST]"),
    ("falcon", "User: {system}\n\n{user}\n\nAssistant:"),
    ("mpt", "<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n"),
    ("gpt", "{system}\n\n{user}\n\nResponse:"),
    ("", "### Instruction:\n{system}\n\n### Input:\n{user}\n\n### Response:"),
)
METHODS = ("normal", "aware", "attack", "defense")


def fill(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` places as a concatenation of columns."""
    out, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [F.lit(head), parts[name]]
    return F.concat(*out, F.lit(rest))


def user_message(question: Column, technique: Column, context: Column, ask: str = ASK) -> Column:
    """Step by step for ``cot``; question behind its context for techniques that read one, if there is any; else the question."""
    plain = fill("{q}\n\n" + ask, q=question)
    stepwise = fill("Let's think step by step.\n\n{q}\n\nPlease provide your reasoning and then give your final answer" + ask.split("final answer", 1)[1], q=question)
    informed = fill("Context information: {c}\n\nQuestion: {q}\n\n" + ask, c=context, q=question)
    has = F.coalesce(context, F.lit("")) != ""
    return F.when(technique == "cot", stepwise).when(technique.isin(*WITH_CONTEXT) & has, informed).otherwise(plain)


def system_message(technique: Column, context: Column, system: str = SYSTEM) -> Column:
    has = F.coalesce(context, F.lit("")) != ""
    return F.concat(F.lit(system), F.when(technique == "cot", ADD["cot"]).when(technique.isin(*WITH_CONTEXT) & has, ADD["context"]).otherwise(""))


def chat(system: Column, user: Column, model: Column) -> Column:
    """The wrapper of the model's family."""
    low, out = F.lower(model), None
    for key, template in FAMILIES:
        text = fill(template, system=system, user=user)
        out = text if not key and out is None else out.otherwise(text) if not key else F.when(F.contains(low, F.lit(key)), text) if out is None else out.when(F.contains(low, F.lit(key)), text)
    return out


def prompt(question: Column, technique: Column, context: Column, model: Column, system: str = SYSTEM) -> Column:
    return chat(system_message(technique, context, system), user_message(question, technique, context), model)


def with_confidence(text: Column, options: Column, probs: Column, method: str, eos: str) -> Column:
    """A prompt that states a previous confidence: the true one (``aware``), one rotated by an option (``attack``) or a uniform one (``defense``)."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {METHODS}")
    if method == "normal":
        return text
    n = F.size(options)
    told = {
        "aware": lambda: confidence_text(options, probs),
        "attack": lambda: confidence_text(options, rotated(probs)),
        "defense": lambda: F.array_join(F.transform(options, lambda o: F.concat(o, F.lit(": "), (F.lit(1.0) / n).cast("string"))), ", "),
    }[method]()
    tail = ". My reason and answer to follow the format is:\n\n" if method == "defense" else ". My answer to follow the format is:\n\n"
    return inject(text, F.concat(F.lit(" Your previous confidence for each answer is "), told, F.lit(tail)), eos)


# ---- passages that are encoded one by one ----------------------------------------------------------------------


def passage_prefix(question: Column) -> Column:
    return fill("Answer the multiple choice question using the provided context.\nRespond with one letter in the format Answer|X.\nQuestion: {q}\nAnswer:", q=question)


def packed(passages: Column, prefix: Column) -> Column:
    """Passages and prefix as one JSON text, the form in which they share a prompt column with plain prompts."""
    return F.to_json(F.struct(passages.alias("passages"), prefix.alias("prefix")))


def unpacked(text: Column) -> Column:
    """``struct<passages, prefix>`` of a packed prompt; null for any other text."""
    parsed = F.from_json(text, "passages array<string>, prefix string")
    return F.when(parsed["passages"].isNotNull() & parsed["prefix"].isNotNull(), parsed)


def passage_prompt(question: Column, context: Column) -> Column:
    return packed(split_passages(context), passage_prefix(question))


def reader_input(prefix: Column, choices: Column) -> Column:
    """Prefix, choices and the request for a letter."""
    return F.concat(F.rtrim(prefix, F.lit(SPACES)), F.lit("\nChoices:\n"), choices, F.lit("\nAnswer with only the letter (A, B, C, or D): |Answer"))


# ---- chains ----------------------------------------------------------------------------------------------------


def past_pairs(queries: Column, answers: Column) -> Column:
    """Numbered intermediate queries and answers; 'Nothing yet' for none."""
    lines = F.transform(F.arrays_zip(queries.alias("q"), answers.alias("a")), lambda x, i: F.concat(F.lit("Intermediate query "), (i + 1).cast("string"), F.lit(": "), x["q"], F.lit("\nIntermediate answer "), (i + 1).cast("string"), F.lit(": "), x["a"]))
    return F.when(F.size(queries) > 0, F.array_join(lines, "\n")).otherwise("Nothing yet")


def subquery_prompt(question: Column, queries: Column, answers: Column) -> Column:
    return fill("Ask one simple follow-up question that helps to answer the main query.\n\n## Previous intermediate queries and answers\n{past}\n\n## Main query to answer\n{q}", past=past_pairs(queries, answers), q=question)


def subanswer_prompt(subquery: Column, documents: Column) -> Column:
    return fill('Answer the query from the documents only, or say "No relevant information found".\n\n## Documents\n{docs}\n\n## Query\n{q}', docs=strip(F.array_join(documents, "\n\n")), q=subquery)


def final_prompt(context: Column, queries: Column, answers: Column) -> Column:
    return fill("Give a final answer to the main query; intermediate answers may be wrong.\n\n## Documents\n{docs}\n\n## Intermediate queries and answers\n{past}\n", docs=strip(context), past=past_pairs(queries, answers))


def search_prompt(question: Column, reasoning: Column) -> Column:
    return fill("Write only a search query for evidence that helps to check the reasoning.\n\nReasoning so far:\n{r}\n\nQuestion: {q}", r=reasoning, q=question)


def revision_prompt(question: Column, reasoning: Column, evidence: Column) -> Column:
    return fill("Revise the reasoning step by step with the evidence and end with Answer|X.\n\nEvidence found:\n{e}\n\nReasoning so far:\n{r}\n\nQuestion: {q}", e=evidence, r=reasoning, q=question)


def passage_request(question: Column) -> Column:
    return fill("Write a detailed passage that answers this question.\n\nQuestion: {q}", q=question)


#: Ways to ask for another query; a line each, the question below it.
REWORDINGS = ("Ask the same question in other words:", "Ask a related question that is about the same topic:", "Ask a simpler question:")


def rewording_prompt(question: Column, n: int) -> Column:
    return fill(REWORDINGS[n % len(REWORDINGS)] + "\n{q}", q=question)


def parsed_response(response: Column, most: int = 500) -> Column:
    return F.substring(response, 1, most)


def response_only(response: Column, asked: Column, turn: str = "assistant\n\n") -> Column:
    """What a model added: the part behind the last turn marker, or the text without the prompt."""
    return F.when(F.contains(response, F.lit(turn)), F.element_at(F.split(response, turn), -1)).otherwise(strip(F.replace(response, asked, F.lit(""))))
