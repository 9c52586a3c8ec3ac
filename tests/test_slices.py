import numpy as np
import pyarrow as pa

from textshield.operators import slices
from textshield.operators.chunking import chunk_recursive, separators_for, split_text
from textshield.operators.embedding import hash_embed


def test_ranges_cover_all_in_order():
    sizes = np.array([3, 0, 9, 1, 1, 50, 2, 0])
    found = list(slices.ranges(sizes, 10))
    assert [i for a, b in found for i in range(a, b)] == list(range(8))
    assert all(sizes[a:b].sum() <= 10 or b == a + 1 for a, b in found)
    assert list(slices.ranges(sizes[:0], 10)) == []


def test_few_texts_are_python_objects_at_once(monkeypatch):
    """Of a batch no more texts than the limit allows are turned into Python values at a time."""
    texts = pa.array(["x" * 100, None, ""] * 200).slice(3)
    held, ranges = [], slices.ranges

    def watched(sizes, most):
        for first, last in ranges(sizes, most):
            held.append(int(sizes[first:last].sum()))
            yield first, last

    monkeypatch.setattr(slices, "ranges", watched)
    out = slices.mapped(texts, lambda t: t and t.upper(), pa.string(), 1000)
    assert out.to_pylist() == [t and t.upper() for t in texts.to_pylist()]
    assert sum(held) == 199 * 100 and max(held) == 1000


def test_results_do_not_depend_on_slices(spark, monkeypatch):
    texts = [None, "", "a b c " * 50, "one two\n\nthree", "w" * 3000, "b a"] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    rows = {r.id: r.embedding for r in hash_embed(df).collect()}
    alone = {i: hash_embed(df.where(f"id = {i}")).first().embedding for i in (0, 2, 3, 5)}
    assert all(rows[i] == v for i, v in alone.items()) and len(rows) == len(texts)
    # lists of words longer than a slice and empty ones keep their owners
    batch = pa.RecordBatch.from_pydict({"w": [["a"] * 9, None, [], ["b"], ["c"] * 4]})
    parts = list(slices.sliced([batch.slice(1), batch], "w", 4))
    assert [r for p in parts for r in p.to_pydict()["w"]] == [None, [], ["b"], ["c"] * 4, ["a"] * 9, None, [], ["b"], ["c"] * 4]
    cut = {r.id: [] for r in df.collect()}
    for r in chunk_recursive(df).orderBy("id", "chunk_ix").collect():
        cut[r.id].append(r.chunk)
    sep = separators_for()
    from textshield.fixed_values import CHUNK_OVERLAP, CHUNK_SIZE
    assert cut == {i: split_text(t, sep, CHUNK_SIZE, CHUNK_OVERLAP) if t else [] for i, t in enumerate(texts)}
