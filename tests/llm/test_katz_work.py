"""What the language model does to a block, without Spark."""

import numpy as np
import pyarrow as pa
import pytest

from textshield.llm import katz
from textshield.llm.blocks import mix


@pytest.mark.parametrize("values", [
    np.zeros(0, np.int64), np.array([5]), np.array([3, 0, 3, 3, 1], np.uint8), np.array([7, 1 << 62, 7, 0], np.int64),
    np.array([(1 << 64) - 1, 9, 1 << 63, 9], np.uint64), np.arange(1 << 17, dtype=np.int64)[::-1] // 3 << 30,
    np.random.default_rng(3).integers(0, 1 << 63, 5000, dtype=np.uint64) % np.uint64(700),
])
def test_distinct(values):
    kept, place, at = katz.distinct(values)
    assert kept.dtype == values.dtype and kept.tolist() == np.unique(values).tolist()
    assert (kept[place] == values).all() and (values[at] == kept).all()


def request_of(text: str, split: int, order: int = 2) -> tuple[katz.Block, katz.Request]:
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([True, False]), pa.array([text, "b zz a"])], ["key", "train", "text"])
    (row,) = katz._blocks(iter([batch]))
    docs, (words, seen) = katz.expand(row.column(1)[0].as_py()), katz.expand(row.column(2)[0].as_py())
    model = {"parts": 4, "documents": 1, "split": split, "first": {0: np.uint64(0)}, "discounts": {}, "hot": {}, "numbers": 99}
    block = katz.Block(docs, model)
    block.answer_words({0: (seen, katz.tight(np.arange(len(katz.loose(words)), dtype=np.uint64)))})
    return block, block.ask(order)


@pytest.mark.parametrize("split", [1 << 16, 10])
@pytest.mark.parametrize("order", [2, 3])
def test_a_request_holds_the_ngrams_of_its_block(split, order):
    block, request = request_of("a b c d e f a c " * 40, split, order)
    columns = [block.tokens, *(block.earlier(reach) for reach in range(1, order))]
    grams = list(zip(*(c.tolist() for c in columns)))
    found = [tuple(c[i].item() for c in columns) for i in request.first]
    assert len(found) == len(set(found)) and [found[i] for i in request.row] == grams
    # heads are numbered one by one, the n-grams of a part and a head stand together
    heads = [(p, *g[1:]) for p, g in zip(request.part.tolist(), found)]
    assert [heads[i] for i in request.head_at] == list(dict.fromkeys(heads))
    assert len(set(zip(request.pair_head.tolist(), heads))) == len(request.head_at)
    assert (request.hot.any() and (request.part > 0).any()) if split == 10 and order == 2 else True


def test_a_request_hashes_words_not_tokens(monkeypatch):
    """Only n-grams of split words and histories need a hash of their own."""
    hashed = []
    monkeypatch.setattr(katz, "mix", lambda x: hashed.append(len(x)) or mix(x))
    block, request = request_of("a b c d e f a c " * 400, 1 << 16, 3)
    assert len(block.tokens) > 3000 and sum(hashed) < 100 and not request.hot.any()
