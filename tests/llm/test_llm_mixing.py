import math
import random
from collections import defaultdict

import llm_cases
import pytest
from pyspark.sql import functions as F

from plainspeak.llm import mixing


def fill(children, given):
    """(weight, supply) of siblings: raise everyone's level until the budget is spent."""
    low, high = 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        if sum(min(s, level * w) for w, s in children) > given:
            high = level
        else:
            low = level
    return [min(s, low * w) for w, s in children]


def brute_budgets(leaves, weights, total):
    def down(paths, depth, given):
        if depth == 3:
            return {paths[0]: given}
        groups = defaultdict(list)
        for p in paths:
            groups[p[: depth + 1]].append(p)
        names = sorted(groups)
        parts = fill([(weights.get(n, 1.0), sum(leaves[p] for p in groups[n])) for n in names], given)
        out = {}
        for n, part in zip(names, parts):
            out |= down(groups[n], depth + 1, part)
        return out

    return down(sorted(leaves), 0, min(total, sum(leaves.values())))


@pytest.mark.parametrize("seed", range(3))
def test_budgets_against_brute_force(spark, seed):
    r = random.Random(seed)
    leaves = {
        (d, lang, s): r.choice([0, r.randint(1, 50), r.randint(1, 5000)])
        for d in "abc" for lang in ("en", "de") for s in "xyz" if r.random() < 0.8
    }
    weights = {("a",): 3.0, ("b",): 0.5, ("a", "en"): 2.0, ("c", "de", "x"): 0.0}
    total = sum(leaves.values()) * r.choice([0.2, 0.7, 1.0])
    frame = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "domain string, lang string, source string, supply long")
    got = {(x["domain"], x["lang"], x["source"]): x["budget"] for x in mixing.leaf_budgets(frame, weights, total).collect()}
    want = brute_budgets(leaves, weights, total)
    assert set(got) == set(want)
    for p in want:
        assert abs(got[p] - want[p]) <= 1.0 + 1e-6 * want[p], p


def documents(spark, n=3000):
    rows = spark.range(n)
    source = F.when(F.col("id") % 3 == 0, "s0").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")))
    lang = F.when(F.col("id") % 5 < 3, "en").otherwise("de")
    text = F.repeat(F.lit("word "), (F.col("id") % 50).cast("int"))
    return rows.select(F.col("id").alias("doc_id"), text.alias("text"), lang.alias("lang"), source.alias("source"))


def test_prefixes_of_seeded_epochs(spark):
    docs = documents(spark)
    domain = F.when(F.col("source") == "s0", "big").otherwise("small")
    weights = {("big",): 0.1, ("small",): 0.9, ("small", "en", "s1"): 50.0}
    leaves = {(x["domain"], x["lang"], x["source"]): x for x in mixing.plan(
        docs.select(*mixing._prepared(docs, domain, "doc_id", mixing.words())), weights, 0.9, 2).collect()}
    taken = defaultdict(lambda: defaultdict(dict))
    for r in mixing.mix(docs, domain, weights, 0.9, 2).collect():
        taken[r["domain"], r["lang"], r["source"]][r["epoch"]][r["doc_id"]] = r["tokens"]
    assert any(x["epochs"] == 2 for x in leaves.values()) and any(x["epochs"] == 0 for x in leaves.values())
    every = defaultdict(dict)
    order = docs.select("*", domain.alias("domain"), F.col("doc_id").alias("id"), mixing.words().alias("tokens"),
                        *[mixing._order(F.lit(e), mixing.SEED).alias(f"h{e}") for e in range(3)])
    for r in order.collect():
        every[r["domain"], r["lang"], r["source"]][r["doc_id"]] = (r["tokens"], (r["h0"], r["h1"], r["h2"]))
    for path, plan in leaves.items():
        mine, epochs = every[path], taken[path]
        for e in range(plan["epochs"]):
            assert set(epochs[e]) == set(mine)
        want, spent = set(), 0
        if plan["rest"] > 0:
            for doc in sorted(mine, key=lambda d: ((mine[d][1][plan["epochs"]]) % 2**64, d)):
                spent += mine[doc][0]
                if spent > plan["rest"]:
                    break
                want.add(doc)
        assert set(epochs[plan["epochs"]]) == want
        assert sum(t for e in epochs.values() for t in e.values()) <= plan["budget"]


def test_same_selection_for_one_epoch(spark):
    docs = documents(spark, 600)
    domain = F.col("source")
    one = {r["doc_id"] for r in mixing.mix(docs, domain, {}, 0.5, 1).collect()}
    chosen = mixing.chosen(docs, domain, {}, 0.5)
    assert chosen.columns == docs.columns and {r["doc_id"] for r in chosen.collect()} == one
    assert 0 < len(one) < 600


def test_odd_rows(spark):
    docs = llm_cases.rows(spark)
    everything = mixing.chosen(docs, F.col("source"), {}, 1.0)
    assert everything.columns == docs.columns and everything.count() == len(llm_cases.ROWS)
    part = mixing.mix(docs, F.col("source"), {}, 0.3, 3).collect()
    assert math.fsum(r["tokens"] for r in part) <= 0.3 * 80_100
    assert {r["lang"] for r in mixing.mix(docs, F.lit(None), {}, 1.0).collect()} == {"", "en", "de", "fr", "es"}
    assert mixing.mix(llm_cases.none(spark), F.col("source"), {}, 0.5).count() == 0
    assert mixing.chosen(llm_cases.none(spark), F.col("source"), {}, 0.5).count() == 0
