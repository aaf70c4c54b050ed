"""Vocabulary and document frequencies of tree models come from all rows, also where the tree sees few."""

from plainspeak.plans import training


def test_words_of_rows_that_the_tree_does_not_see(spark):
    rows = [(f"shared own{i} {'good' if i % 2 else 'bad'}", i % 2) for i in range(40)]
    train = spark.createDataFrame(rows, "text_clean string, label_id int")
    model = training.fit("decision_tree", train, rows=10)
    assert len(model.stages[1].vocabulary) == 43 and model.stages[2].numDocs == 40
    assert training.predictions(model, train).filter("prediction = label_id").count() == 40


def test_telling_terms_against_a_table_by_hand(spark):
    rows = [(["a", "b", "b"], 0), (["a", "c"], 0), (["b", "c"], 1), (["c"], 1), (["c", "d"], 2), (["c"], None), ([], 2)]
    docs = spark.createDataFrame(rows, "words array<string>, label_id int")
    labelled = [(set(w), c) for w, c in rows if c is not None]

    def chi2(word):
        total = 0.0
        for c in {0, 1, 2}:
            for present in (True, False):
                seen = sum((word in w) == present and k == c for w, k in labelled)
                expected = sum((word in w) == present for w, _ in labelled) * sum(k == c for _, k in labelled) / len(labelled)
                total += (seen - expected) ** 2 / expected if expected else 0.0
        return total

    order = sorted("abcd", key=lambda w: (-round(chi2(w), 9), -sum(w in x for x, _ in labelled), w))
    vocabulary = ["d", "c", "b", "a"]
    for k in range(1, 5):
        assert training.telling_terms(docs, vocabulary, "label_id", k) == sorted(vocabulary.index(w) for w in order[:k])


def test_trees_see_all_rows_and_few_words(spark):
    rows = [(f"noise{i} noise{i % 7} {'good' if i % 2 else 'bad'}", i % 2) for i in range(700)]
    train = spark.createDataFrame(rows, "text_clean string, label_id int")
    model = training.fit("decision_tree", train, terms=5)
    assert len(model.stages[3].getIndices()) == 5 and len(model.stages[1].vocabulary) == 702
    assert model.stages[4].numFeatures == 5
    assert training.predictions(model, train).filter("prediction = label_id").count() == 700
