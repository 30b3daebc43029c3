"""What a Python worker holds on to beside its next tasks."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sedimill.llm import packing, textnp

PATH = public_tokenizers.path("word_bpe_49k.json")
BATCH = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])


def _run(batches):
    for b in batches:
        textnp.powers(1000)
        yield b


def test_what_a_task_no_longer_needs_is_given_back():
    out = textnp.lean(_run)(iter([BATCH, BATCH]))
    assert next(out).equals(BATCH) and 1000 <= len(textnp._powers[0]) <= 1_100_000
    assert len(list(out)) == 1 and [len(p) for p in textnp._powers] == [1, 1]
    assert textnp.powers(3)[0].tolist()[1] == int(np.uint64(0x9E3779B97F4A7C15))  # made anew


@pytest.mark.parametrize("forget", [True, False])
def test_the_tokenizer_and_its_words_go_before_another_step(forget):
    before = [x.tolist() for x in packing.word_ids(PATH)([b"the data, of THE day"])]
    assert len(list(textnp.lean(_run, forget=forget)(iter([BATCH])))) == 1
    assert (PATH in packing._tokenizers) != forget  # packing's own next task finds them
    assert [x.tolist() for x in packing.word_ids(PATH)([b"the data, of THE day"])] == before
