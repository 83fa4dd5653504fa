"""Text column functions: cleaning, context and prompt assembly, answer parsing."""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is not text (fixed values).
DROPPED = ("script", "style", "meta", "link", "head", "title")
#: Entities of the pages, for the SQL of the queries (fixed values).
ENTITIES = (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&amp;", "&"))
CONTEXT_CHARS = 4000


#: A tag: a quoted value may hold ``>`` (possessive and bounded, so that a stray quote costs nothing).
TAG = r"""</?[A-Za-z](?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>=]++|=){0,200}+>"""
REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


#: White space at the ends of a text, as Unicode has it (line feeds and non-breaking spaces, too).
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """The text without white space at its ends; Spark's own ``trim`` takes spaces only."""
    return F.btrim(text, F.lit(SPACES))


def decoded_references(x: Column) -> Column:
    """Character references: decimal, hexadecimal, and the 252 names of HTML 4 (Python's table); unknown ones stay.

    Each different reference of a text is replaced once, the ampersand's own last, so nothing is decoded twice.
    """
    names = F.create_map(*[F.lit(v) for name, code in sorted(name2codepoint.items()) for v in (f"&{name};", chr(code) if name != "nbsp" else " ")], F.lit("&apos;"), F.lit("'"))

    def char(r: Column) -> Column:
        digits = F.when(F.lower(F.substring(r, 1, 3)) == "&#x", F.conv(F.substring(r, F.lit(4), F.length(r) - 4), 16, 10)).otherwise(F.substring(r, F.lit(3), F.length(r) - 3)).cast("long")
        valid = (digits > 0) & (digits < 0x110000) & ~digits.between(0xD800, 0xDFFF)
        point = F.when(digits == 160, F.lit(" ")).when(valid, F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        return F.when(F.startswith(r, F.lit("&#")), point).otherwise(F.coalesce(F.try_element_at(names, r), r))

    last = lambda r: F.when(r.isin("&amp;", "&#38;", "&#038;", "&#x26;", "&#X26;"), 1).otherwise(0)
    found = F.array_sort(F.transform(F.array_distinct(F.regexp_extract_all(x, F.lit(REFERENCE), F.lit(0))), lambda r: F.struct(last(r).alias("last"), r.alias("r"))))
    return F.when(F.contains(x, F.lit("&")), F.aggregate(found, x, lambda text, r: F.replace(text, r["r"], char(r["r"])))).otherwise(x)


def html_to_text(html: Column) -> Column:
    """Visible text: dropped elements and comments go, tags become spaces, references are decoded, white space collapses; null is ''."""
    x = F.coalesce(html, F.lit(""))
    x = F.regexp_replace(x, "(?s)<!--.*?-->", " ")
    for tag in DROPPED:
        x = F.regexp_replace(x, f"(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>", " ")
    x = F.regexp_replace(F.regexp_replace(x, TAG, " "), "(?s)<[^>]*>", " ")
    # the text is an element that the inner function gets, so the tags are taken out once
    x = F.transform(F.array(x), decoded_references)[0]
    return strip(F.regexp_replace(x, "\\s+", " "))


def strip_if_html(doc: Column) -> Column:
    """Tags go only where the text has one; content of scripts stays."""
    return F.when(F.contains(doc, F.lit("<")), strip(F.regexp_replace(F.regexp_replace(doc, "(?s)<[^>]*>", " "), "\\s+", " "))).otherwise(doc)


def document_text(snippet: Column, html: Column) -> Column:
    return F.concat(F.coalesce(snippet, F.lit("")), F.lit("\n\n"), html_to_text(html))


def context(docs: Column, query_time: Column | None = None, chars: int = CONTEXT_CHARS) -> Column:
    """Bulleted documents cut to ``chars`` before the query time is appended; null for no documents."""
    body = F.substring(F.concat(F.lit("\n- "), F.array_join(docs, "\n- ")), 1, chars)
    if query_time is not None:
        body = F.concat(body, F.lit("\nQuery Time: "), query_time)
    return F.when(F.size(docs) > 0, body)


def fusion_context(docs: Column, chars: int = CONTEXT_CHARS) -> Column:
    """As ``context`` without a leading line break or query time; '- ' for no documents."""
    return F.substring(F.concat(F.lit("- "), F.array_join(docs, "\n- ")), 1, chars)


def thought_context(chunks: Column, blanks: str | None = None) -> Column:
    """Each chunk cut to 1000 characters, lines, all cut to 4000, trimmed: of white space, or of ``blanks`` only."""
    text = F.substring(F.array_join(F.transform(chunks, lambda c: F.substring(c, 1, 1000)), "\n"), 1, 4000)
    return strip(text) if blanks is None else F.btrim(text, F.lit(blanks))


def shared_corpora(search_results: Column) -> Column:
    """Names of the shared corpora that a row points to (its first search result); null if it brings its own documents.

    Told row by row, so a batch may mix both kinds.
    """
    first = F.get(search_results, 0)["persistent_storage"]
    return F.when(F.size(F.coalesce(first, F.array().cast("array<string>"))) > 0, first)


def newest_first_context(docs: Column, limit: int = 5000) -> Column:
    """Numbered documents, newest in front, adding none once over ``limit`` characters."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))
    step = lambda a, d: F.when(F.length(a["text"]) > limit, a).otherwise(F.struct(F.concat(F.lit("Doc "), (a["n"] + 1).cast("string"), F.lit(": "), d, F.lit("\n"), a["text"]).alias("text"), (a["n"] + 1).alias("n")))
    return F.aggregate(F.reverse(docs), start, step, lambda a: a["text"])


def merged_context(old: Column, new: Column, head: str = "\n\nAdditional Context: ") -> Column:
    blank = strip(F.coalesce(new, F.lit(""))) == ""
    return F.when(blank, F.coalesce(old, F.lit(""))).otherwise(F.concat(F.coalesce(old, F.lit("")), F.lit(head), new))


def split_passages(text: Column) -> Column:
    """Bulleted passages, trimmed, without blanks; the whole text if there are none; one empty passage without text."""
    parts = F.filter(F.transform(F.split(text, "\n-"), lambda p: strip(p)), lambda p: p != "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array(F.lit(""))).when(F.size(parts) == 0, F.array(text)).otherwise(parts)


def choice_lines(options: Column) -> Column:
    """Options as they are, one a line."""
    return F.array_join(options, "\n")


def choice_pairs(pairs: Column) -> Column:
    """``array<struct<key, value>>`` (``map_entries`` of a map) as ``k: v`` lines."""
    return F.array_join(F.transform(pairs, lambda x: F.concat_ws(": ", x["key"], x["value"])), "\n")


def choices(options: Column) -> Column:
    """Lettered option lines."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(": "), o)), "\n")


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def answer_prefix(response: Column, marker: str = "Answer|") -> Column:
    """Up to and including the last marker; the whole text without one."""
    at = F.length(response) - F.instr(F.reverse(response), marker[::-1]) + 1
    return F.when(F.contains(response, F.lit(marker)), F.substring(response, F.lit(1), at)).otherwise(response)


def answer_letter(response: Column) -> Column:
    """Marked letter, lone letter, letter at the end, first letter of A-E anywhere, else A."""
    text = strip(F.coalesce(response, F.lit("")))
    tries = [F.regexp_extract(text, "Answer\\|\\s*([A-E])", 1), F.regexp_extract(text, "^([A-E])$", 1), F.regexp_extract(text, "\\b([A-E])[.)]\\s*$", 1), F.regexp_extract(text, "([A-E])", 1)]
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tries], F.lit("A"))


def inject(prompt: Column, text: str | Column, eos: str) -> Column:
    """Insert a part before the last part."""
    parts = F.split(prompt, re.sub(r"([^\w\s])", r"\\\1", eos))
    n = F.size(parts)
    text = F.lit(text) if isinstance(text, str) else text
    return F.array_join(F.concat(F.slice(parts, F.lit(1), n - 1), F.array(text), F.slice(parts, n, F.lit(1))), eos)


def confidence_text(options: Column, probs: Column) -> Column:
    return F.array_join(F.transform(F.arrays_zip(options.alias("o"), probs.alias("p")), lambda x: F.format_string("%s: %.4f", x["o"], x["p"])), ", ")


def rotated(probs: Column) -> Column:
    """The last element first."""
    n = F.size(probs)
    return F.when(n < 2, probs).otherwise(F.concat(F.slice(probs, -1, 1), F.slice(probs, F.lit(1), n - 1)))


#: Reflection tokens and what they mean, in the order in which they are looked for (fixed values).
REFLECTION = {
    "retrieval": (("<|retrieve|>", "retrieve"), ("<|no_retrieve|>", "no_retrieve")),
    "relevance": (("<|relevant|>", "relevant"), ("<|irrelevant|>", "irrelevant")),
    "support": (("<|fully_supported|>", "supported"), ("<|partially_supported|>", "partially_supported"), ("<|no_support|>", "no_support")),
    "utility": tuple((f"<|utility:{i}|>", i) for i in range(5, 0, -1)),
}
#: The same in brackets, as some models write them.
BRACKETED = {
    "retrieval": (("[No Retrieval]", "no_retrieval"), ("[Retrieval]", "retrieval")),
    "relevance": (("[Irrelevant]", "irrelevant"), ("[Relevant]", "relevant")),
    "support": (("[Fully supported]", "full"), ("[Partially supported]", "partial"), ("[No support / Contradictory]", "none")),
    "utility": tuple((f"[Utility:{i}]", i) for i in range(5, 0, -1)),
}
#: Scores of reflection values (fixed values); what is missing counts 0.5, and 3 of 5 for utility.
RELEVANCE = {"relevant": 1.0, "irrelevant": 0.0}
SUPPORT = {"supported": 1.0, "partially_supported": 0.7, "no_support": 0.0}


def reflection(text: Column, tokens: dict = REFLECTION) -> Column:
    """Reflection tokens by containment, the first that fits; utility is the highest of 5 to 1."""
    told = {k: F.coalesce(*[F.when(F.contains(text, F.lit(t)), F.lit(v)) for t, v in pairs]) for k, pairs in tokens.items()}
    return F.struct(*[c.alias(k) for k, c in told.items()])


def reflection_scores(tokens: Column) -> Column:
    """``struct<relevance, support, utility>`` as numbers for ``best_candidate``; null where a token is missing."""
    number = lambda c, of: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in of.items()])
    return F.struct(number(tokens["relevance"], RELEVANCE).alias("relevance"), number(tokens["support"], SUPPORT).alias("support"), tokens["utility"].alias("utility"))


def needs_retrieval(tokens: Column) -> Column:
    return F.coalesce(tokens["retrieval"] == "retrieve", F.lit(False))


def thoughts(response: Column, prompt: Column, limit: int) -> Column:
    """Lines without blanks and the last one; those after ``limit`` are glued to the first; padded with ''."""
    lines = F.filter(F.split(F.replace(response, prompt, F.lit("")), "\n"), lambda x: strip(x) != "")
    lines = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))
    first = F.array_join(F.concat(F.slice(lines, 1, 1), F.slice(lines, limit + 1, 100000)), "\n")
    out = F.when(F.size(lines) > limit, F.concat(F.array(first), F.slice(lines, 2, limit - 1))).otherwise(lines)
    return F.concat(out, F.array_repeat(F.lit(""), limit))


def tokens(text: Column) -> Column:
    """Words between white space (Unicode), case and punctuation kept."""
    return F.filter(F.split(text, "(?U)\\s+"), lambda t: t != "")


def matched_options(options: Column, labels: Column) -> Column:
    """The options that equal a label, as they are spelled, each once."""
    clean = lambda x: F.lower(strip(x))
    return F.array_distinct(F.filter(options, lambda o: F.exists(labels, lambda x: clean(x) == clean(o))))


def label_match_strict(options: Column, labels: Column) -> Column:
    """As ``label_match``; raises unless options and labels are single characters."""
    single = lambda c: F.forall(c, lambda x: F.length(x) == 1)
    return F.when(single(options) & single(labels), label_match(options, labels)).otherwise(F.raise_error(F.lit("options and labels must be single characters")).cast("array<int>"))


def label_match(options: Column, labels: Column) -> Column:
    """1 for each option equal to a label after trimming and lower-casing."""
    clean = lambda x: F.lower(strip(x))
    return F.transform(options, lambda o: F.exists(labels, lambda x: clean(x) == clean(o)).cast("int"))
