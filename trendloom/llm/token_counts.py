"""Token counts: pieces are counted once per distinct pre-token.

Under the vocabularies served here no piece crosses a pre-token boundary, so the
number of tokens of a text is the sum over its distinct pre-tokens of frequency
times pieces. Documents become blocks of (pre-token code, frequency) pairs with
a dictionary each; the dictionaries' tokens, packed by a hash of the token, meet part by part, where each
distinct one is encoded once; the counts go back to the blocks and are summed. Ids are
never built for a text.

For the SentencePiece model the boundary rule is checked against the vocabulary
when the model is loaded: the normaliser is the identity with a leading blank, a piece holds blanks only
at its start, and no piece holds a line feed beside other characters. A model
without that shape is refused.

Defined results: null or empty text has 0 bytes and 0 tokens; equal texts get
equal counts; white space of every kind and strings that look like special
tokens are ordinary text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import materialize, parts_for, size_hint

#: Fixed value: the character that stands for a blank.
BLANK = "▁"
PRE_TOKEN = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")
RESULT = "doc_id long, n_bytes long, n_tokens long"


def pre_tokens(text: str) -> list[str]:
    return PRE_TOKEN.findall(BLANK + text.replace(" ", BLANK)) if text else []


@lru_cache(maxsize=2)
def encoder(model_file: str):
    """A processor without the leading blank, for pre-tokens; refuses models whose pieces cross boundaries."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    crossing = [p for p in pieces if re.search(f"[^{BLANK}]{BLANK}", p) or ("\n" in p and p != "\n")]
    if crossing or sp.normalize("a  ﬁ ") != f"{BLANK}a {BLANK}ﬁ{BLANK}":
        raise ValueError(f"{model_file}: pieces or normaliser cross pre-token boundaries {crossing[:3]}")
    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def count_pieces(packs: DataFrame, model_file: str) -> DataFrame:
    """(block, part, data) -> (block, part, pieces): packs of one part meet, and each distinct token of it is encoded once.

    What is held is the distinct tokens of one part.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, now, known = encoder(model_file), None, {}
        for batch in batches:
            out = []
            for part, data in zip(batch["part"].to_pylist(), batch["data"]):
                if part != now:
                    now, known = part, {}
                tokens = blocks.unpack_tokens(data.as_py())
                fresh = [t for t in tokens if t not in known]
                if fresh:
                    known.update(zip(fresh, map(len, sp.encode(fresh, num_threads=1))))
                out.append(blocks.squeeze(np.fromiter(map(known.__getitem__, tokens), np.uint32, len(tokens))))
            yield pa.record_batch({"block": batch["block"], "part": batch["part"], "pieces": pa.array(out, pa.binary())})

    return packs.mapInArrow(counted, "block long, part int, pieces binary")


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_tokens."""
    parts = min(16384, parts_for(size_hint(docs), 8 << 20, 48))
    made = materialize(blocks.build_bags(docs, pre_tokens, parts), "token-blocks")
    asked = made.select("block", F.explode("packs").alias("p")).select("block", "p.part", "p.data")
    answers = count_pieces(asked.repartition("part").sortWithinPartitions("part"), model_file)

    def summed(key: tuple, held: pa.Table, got: pa.Table) -> pa.Table:
        pieces = [blocks.expand(p, np.uint32) for _, p in sorted(zip(got["part"].to_pylist(), got["pieces"].to_pylist()))]
        found = np.concatenate([*pieces, np.zeros(0, np.uint32)]).astype(np.int64)
        ids, sizes, totals = [], [], []
        for row in held.to_pylist():
            lens = np.array(row["lens"], np.int64)
            gaps, counts = blocks.expand(row["gaps"], np.uint32).astype(np.int64), blocks.expand(row["counts"], np.uint32).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(lens)])
            run = np.cumsum(gaps)
            before = np.concatenate([[0], run])[at[:-1]]  # each document's codes start anew
            codes = run - np.repeat(before, lens)
            sums = np.concatenate([[0], np.cumsum(found[codes] * counts)])
            totals.append(sums[at[1:]] - sums[at[:-1]])
            ids += row["doc_ids"]
            sizes += row["n_bytes"]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(np.concatenate(totals) if totals else [], pa.int64())})

    return made.drop("packs").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(summed, RESULT)


__all__ = ["count_pieces", "encoder", "pre_tokens", "token_counts"]
