"""Cross-entropy difference: how much more a document looks like the target than like the background.

Two n-gram models over the same words, of the same order and smoothing, neither of them pruned: one of the target texts, one of all
texts. A document's score is the mean over its tokens of target loss minus background loss; low scores are in-domain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import narrow
from proofline.llm.ngrams import vocabulary, words
from proofline.llm.wordpairs import text_losses

ORDER = 2
UNTRAINED = float(np.log(0x110000))


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER,
    word_share: float = 0.0, least_share: float = 0.0,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss (nats a token) and score, their difference.

    ``target``: the in-domain texts, with a column ``text_col``. Counts cover every text of both tables, and every n-gram is kept.
    ``word_share``: words of a smaller share of all are one token; by default each word is one of its own. Null and empty
    texts have no tokens and null losses; rows of equal ids are scored each by itself; without target texts all target losses
    are those of unknown words.
    """
    if order != ORDER or least_share:
        raise ValueError("models are of word pairs, and no pair is dropped")
    rows = narrow(docs, doc_id=id_col, text=text_col)
    tokens = words(vocabulary(rows, word_share) if word_share else None)
    summed = text_losses(rows, narrow(target, text=text_col), tokens, UNTRAINED)
    target_loss, background_loss = (F.try_divide(F.col(c), F.col("n_tokens")) for c in ("target", "background"))
    return summed.select(
        "doc_id", "n_tokens", target_loss.alias("target_loss"), background_loss.alias("background_loss"),
        (target_loss - background_loss).alias("score"),
    )
