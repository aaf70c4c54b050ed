"""Words and pairs counted in whole texts: against plain Python, by small chunks, with odd white space."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from plainspeak.functions.fixed_values import WHITESPACE_CHARACTERS
from plainspeak.operators import counts, lookup, phrases


def texts():
    rng = random.Random(4)
    gaps = [" ", "  ", *WHITESPACE_CHARACTERS]
    made = ["".join(rng.choice(["a", "b", "É", "d​", "ee"]) + rng.choice(gaps) for _ in range(rng.randrange(9))) for _ in range(80)]
    return [*made, None, "", " ", "　a b\x85", " a"]


def plain(texts):
    found = Counter()
    for t in texts:
        w = (t or "").split()
        found.update(w)
        found.update(map("{} {}".format, w, w[1:]))
        found[counts.ALL] += len(w)
    return found


def test_words_and_pairs_in_whole_texts(spark):
    docs = spark.createDataFrame([(t,) for t in texts()], "t string")
    want = plain(texts())
    got = {r["term"]: r["n"] for r in counts.count_terms(docs, "t", pairs=True).collect()}
    assert got == want
    often = counts.count_terms(docs, "t", pairs=True, least=5).collect()
    assert {r["term"]: r["n"] for r in often} == {k: n for k, n in want.items() if n >= 5 or k == counts.ALL}
    assert counts.count_terms(docs.limit(0), "t", pairs=True).count() == 0


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_counts_do_not_depend_on_chunks(monkeypatch, size):
    monkeypatch.setattr(counts, "CHUNK_BYTES", size)
    column = pa.array(texts(), pa.string())
    batches = [pa.record_batch({"text": column[i : i + 30]}) for i in range(0, len(column), 30)]
    rows = pa.Table.from_batches(list(counts._counted(True, 3)(batches)))
    found = {}
    for b in range(3):
        mine = counts._added(1)(rows.filter(pa.compute.equal(rows["bucket"], b)))
        assert not found.keys() & set(mine["term"].to_pylist())  # a term is in one bucket
        found.update(zip(mine["term"].to_pylist(), mine["n"].to_pylist()))
    assert found == plain(texts())


def test_bytes_that_are_no_text():
    broken = pa.Array.from_buffers(pa.string(), 2, pa.array([b"a \xff", b"b\xa0c"], pa.binary()).buffers())
    words, rows = counts.split_words(pa.chunked_array([broken]))
    assert words.to_pylist() == ["a", "�", "b�c"] and rows.tolist() == [0, 0, 1]


def test_the_lexicon_is_counted_once_and_not_by_rows_of_words(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    docs = spark.createDataFrame([(t,) for t in texts()], "t string")
    found = phrases.fit_phrases(docs, "t", min_count=1, threshold=0.0, discount=0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan  # reads stored counts only, however often it looks up
    assert "inline" not in plan and "Aggregate" not in plan
    want = plain(texts())
    assert {(r["a"], r["b"]): r["n"] for r in found.collect()} == {tuple(k.split(" ")): n for k, n in want.items() if " " in k}
