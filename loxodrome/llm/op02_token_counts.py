"""Token counts by a finite-state tokenizer compiled from a sentencepiece BPE model.

The model's pieces become a deterministic transducer whose transitions carry emitted-token counts
(:mod:`loxodrome.llm.transducer`). A text is cut into chunks; each chunk acts on the transducer's state by a
short map, and the maps compose associatively, by a parallel prefix scan. No shuffle: one pass.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); every row counts, repeated ones too; other
columns of the input are ignored; a text of any length is worked on whole, in chunks of fixed size.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loxodrome.llm.bpe_dp import Vocabulary
from loxodrome.llm.frames import SLICE_BYTES, narrow, per_slice, resident
from loxodrome.llm.transducer import CountingTransducer

_SPACE = "▁"


def piece_counter(model_file: str) -> CountingTransducer:
    """The transducer of a BPE model with byte fallback, a dummy prefix and an identity normaliser."""

    def make() -> CountingTransducer:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        ranks = {model.id_to_piece(i): i for i in ids}
        if any(_SPACE in p.lstrip(_SPACE) for p in ranks):
            raise ValueError("a piece holds a space mark after another character; space marks aren't barriers then")
        vocabulary = Vocabulary(ranks, {i: -model.get_score(i) for i in ids})
        return CountingTransducer(vocabulary, _SPACE, lambda c: len(chr(c).encode()))

    return resident(("pieces", model_file), make)


def token_counts(df: DataFrame, model_file: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row."""

    def make():
        counter = piece_counter(model_file)

        def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            # the dummy prefix; in the texts, the space mark itself is a space too
            plain = pc.replace_substring(texts, _SPACE, " ")
            prefixed = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", plain, ""))
            n = pa.array(counter.count_column(prefixed))
            return pa.RecordBatch.from_arrays([rows.column(0), pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

        return work

    return per_slice(narrow(df, id_col, text_col), f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean", text_col, make, 4 * SLICE_BYTES, keeps=True)
