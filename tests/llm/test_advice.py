"""Cases of the review of round 1: inputs that earlier versions cut short."""

import random

from calibrant.llm import op9_decontam as op9
from calibrant.llm.common import Scratch

TEXTS, ITEMS = "doc_id long, text string", "item_id long, text string"


def made_up(r, n, letters="abcdefghij"):
    return ["".join(r.choices(letters, k=r.randrange(3, 8))) for _ in range(n)]


def leaks(spark, rows, items):
    got = op9.contaminated(spark.createDataFrame(rows, TEXTS), spark.createDataFrame(items, ITEMS), Scratch(spark)).collect()
    return {(x["doc_id"], x["item_id"]) for x in got}


def test_item_in_a_third_of_all_rows(spark):
    r = random.Random(11)
    word = made_up(r, 2000)
    text = lambda n: " ".join(r.choices(word, k=n))
    items = [(i, text(20 + i)) for i in range(6)]
    rows = [(i, text(60) + " " + items[0][1] + " " + text(60) if i % 3 == 0 else text(150)) for i in range(600)] + [(900, text(40) + " " + items[1][1])]
    got = leaks(spark, rows, items)
    assert got == {(i, 0) for i in range(0, 600, 3)} | {(900, 1)} == op9.brute_force(rows, items)


def test_short_items(spark):
    r = random.Random(13)
    word = made_up(r, 500)
    text = lambda n: " ".join(r.choices(word, k=n))
    items = [(1, "Who wrote the book of Yx?"), (2, "book"), (3, "the the"), (4, text(20)), (5, "?!"), (6, None)]
    rows = [(1, text(50) + " who WROTE, the book of yx " + text(9)), (2, "who wrote the book"), (3, "of yx?"), (4, text(5) + " the\nthe the"), (5, "who wrote the good book of yx"), (6, items[3][1]), (7, "the"), (8, None)]
    want = {(1, 1), (1, 2), (2, 2), (5, 2), (4, 3), (6, 4)}
    assert leaks(spark, rows, items) == want == op9.brute_force(rows, items)
    assert leaks(spark, rows, items[:3]) == want - {(6, 4)}


def paraphrased(r, word, text, share):
    return " ".join(r.choice(word) if r.random() < share else w for w in text.split())


def test_paraphrases_of_many_items(spark):
    """Every pair that meets the LCS limit and the answer check in some window is found, whatever the latent space keeps."""
    r = random.Random(17)
    word = made_up(r, 4000)
    text = lambda n: " ".join(r.choices(word, k=n))
    items = [(i, text(r.randrange(15, 60))) for i in range(250)]
    rows = [(3 * i + k, " ".join([text(r.randrange(60)), paraphrased(r, word, x, share), text(r.randrange(60))])) for i, x in items for k, share in enumerate((0.2, 0.3, 0.38))]
    want = set().union(*(op9.brute_force([row], [items[k // 3]]) for k, row in enumerate(rows)))
    got = leaks_of(spark, rows, items, answer=0.0)
    assert len(want) > 400 and want <= set(got)  # the operator's windows are wider than the stretches of brute force
    assert {pair for pair, share in got.items() if share >= op9.ANSWER} <= set(leaks_of(spark, rows, items)) <= set(got)


def leaks_of(spark, rows, items, **options):
    got = op9.contaminated(spark.createDataFrame(rows, TEXTS), spark.createDataFrame(items, ITEMS), Scratch(spark), **options).collect()
    return {(x["doc_id"], x["item_id"]): x["answer_share"] for x in got}
