"""Training rows: token views of a pair, shuffled batches, left padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmill.functions.chat import ChatStyle, message, render_chat
from prefmill.functions.derive import settle
from prefmill.functions.keys import dense_index, row_count
from prefmill.functions.permute import permuted
from prefmill.functions.tokens import Tokenizer, hashed_tokenizer
from prefmill.session import bound_batches

# The three token views of a pair.
VIEWS = ("chosen", "rejected", "context")


def shuffled_batches(
    rows: DataFrame, batch_size: int, key: tuple[str, ...] = ("instance_id", "pair_idx"),
    seed=42, epoch: int = 0, bits: int = 16,
) -> DataFrame:
    """Add ``batch_id`` and ``batch_pos``: a random order per (seed, epoch), cut in batches.

    ``key`` must be unique; its values are told apart whatever they hold. The order is a dense index, so batches are full but for the
    last one and no single task sorts everything. Each batch ends up inside one
    partition, where tokens and padding can be worked out without a further shuffle: put
    the batches together while rows are still text. ``rows`` is read twice (index offsets
    and rows), so pass a written table.
    """
    keyed = rows.withColumn("_key", F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))
    indexed = dense_index(keyed, "_key", f"{seed}:{epoch}", out="_idx", bits=bits)
    return (
        indexed.withColumn("batch_id", F.expr(f"_idx div {int(batch_size)}"))
        .withColumn("batch_pos", F.pmod("_idx", F.lit(batch_size)).cast("int"))
        .drop("_key", "_idx")
        .repartition("batch_id")
    )


def epoch_batches(
    rows: DataFrame, batch_size: int, epochs: int, key: tuple[str, ...] = ("instance_id", "pair_idx"), seed=42,
    bits: int = 16,
) -> DataFrame:
    """Every row once an epoch, with ``epoch``, ``batch_id`` and ``batch_pos``.

    The rows are numbered once. The order of an epoch is a keyed permutation of these numbers, so where a row stands
    in any epoch follows from its number alone and no epoch sorts anew. Epochs hold the same rows in
    other batches; all batches but an epoch's last are full. ``key`` must be unique, and ``rows`` a written table.
    """
    keyed = rows.withColumn("_key", F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))
    indexed = dense_index(keyed, "_key", str(seed), out="_idx", bits=bits)
    repeated = settle(indexed, {"_n": row_count(rows)}).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    placed = settle(repeated, {"_at": permuted(F.col("_idx"), F.col("_n"), seed, F.col("epoch"))})
    return placed.select(
        *rows.columns, "epoch", F.expr(f"_at div {int(batch_size)}").alias("batch_id"),
        F.pmod("_at", F.lit(batch_size)).cast("int").alias("batch_pos"),
    )


def token_views(
    pairs: DataFrame, tokenizer: Tokenizer | None = None, style: ChatStyle = ChatStyle()
) -> DataFrame:
    """Ids and mask of prompt + chosen, prompt + rejected, and prompt with open reply.

    Nothing is truncated.
    """
    bound_batches(pairs.sparkSession)
    tokenizer = tokenizer or hashed_tokenizer()
    asked = message("user", F.col("prompt"))

    def answered(side: str) -> Column:
        return render_chat(F.array(asked, message("assistant", F.col(side))), style)

    texts = {
        "chosen": answered("chosen"),
        "rejected": answered("rejected"),
        "context": render_chat(F.array(asked), style, reply=True),
    }
    keys = [c for c in pairs.columns if c not in ("prompt", "chosen", "rejected")]
    ids = pairs.select(*keys, *[tokenizer(texts[v]).alias(f"input_ids_{v}") for v in VIEWS])
    masks = {
        f"attention_mask_{v}": F.array_repeat(F.lit(1), F.size(f"input_ids_{v}")) for v in VIEWS
    }
    return ids.withColumns(masks)


def pad_batches(batched: DataFrame, pad_id: int = 0) -> DataFrame:
    """Left-pad each view to its longest row in the batch; padding has mask 0, ids mask 1.

    A window holds one batch, so its size is the batch size. Masks follow from the sizes, so
    they are made behind the window and none is sorted.
    """
    batch = Window.partitionBy("batch_id")
    masks = [f"attention_mask_{v}" for v in VIEWS]
    longest = {f"_max_{v}": F.max(F.size(f"input_ids_{v}")).over(batch) for v in VIEWS}
    padded = {}
    for v in VIEWS:
        size = F.size(f"input_ids_{v}")
        missing = F.col(f"_max_{v}") - size
        padded[f"attention_mask_{v}"] = F.concat(F.array_repeat(F.lit(0), missing), F.array_repeat(F.lit(1), size))
        padded[f"input_ids_{v}"] = F.concat(F.array_repeat(F.lit(pad_id), missing), F.col(f"input_ids_{v}"))
    return batched.drop(*masks).withColumns(longest).withColumns(padded).drop(*longest)
