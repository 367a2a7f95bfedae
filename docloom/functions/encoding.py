"""Fixed-length encoding and masking of token ids, each ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED_LABEL = -100


def add_boundaries(ids: Column, start_id: int, end_id: int, max_length: int) -> Column:
    """``<s> ids </s>``, the ids cut so that both boundaries fit."""
    body = F.slice(ids, 1, max_length - 2)
    return F.concat(F.array(F.lit(start_id)), body, F.array(F.lit(end_id)))


def pad_ids(ids: Column, max_length: int, pad_id: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad_id), max_length)), 1, max_length)


def attention_mask(ids: Column, max_length: int) -> Column:
    """1 for each position that carries a token, 0 for padding; ``ids`` are the unpadded ids."""
    positions = F.sequence(F.lit(1), F.lit(max_length))
    return F.transform(positions, lambda i: (i <= F.size(ids)).cast("int"))


def _hash32(seed: int, kind: str, row: Column, position: Column) -> Column:
    """32 bits that depend on the arguments alone, hence not on partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(f"{seed}{kind}"), row.cast("string"), position.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mlm_mask(
    ids: Column,
    row: Column,
    *,
    mask_id: int,
    vocab_size: int,
    special_count: int,
    probability: float = 0.15,
    seed: int = 42,
) -> Column:
    """Masked-language-model inputs: array of ``(input_id, label)`` structs.

    Ids below ``special_count`` are never chosen. Of the chosen ones 80 % become ``mask_id``, 10 % a
    random ordinary id and 10 % stay; the label is the original id there and -100 elsewhere.
    """
    scale = float(2**32)

    def one(token: Column, position: Column) -> Column:
        chosen = (token >= special_count) & (_hash32(seed, "", row, position) / scale < probability)
        action = _hash32(seed, "a", row, position) / scale
        draw = _hash32(seed, "r", row, position) % (vocab_size - special_count) + special_count
        masked = (
            F.when(action < 0.8, F.lit(mask_id)).when(action < 0.9, draw.cast("int")).otherwise(token)
        )
        # One condition for both fields: a lambda computes its hash anew for every use.
        hidden = F.struct(masked.alias("input_id"), token.alias("label"))
        return F.when(chosen, hidden).otherwise(F.struct(token.alias("input_id"), F.lit(IGNORED_LABEL).alias("label")))

    return F.transform(ids, one)
